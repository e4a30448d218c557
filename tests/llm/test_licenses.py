"""The license scan against brute force over all windows."""

import random
import re

from metrelle.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingled(text):
    m = list(WORD.finditer(re.sub("[A-Z]", lambda x: x[0].lower(), text)))
    return [((a[0], b[0]), a.start(), b.end()) for a, b in zip(m, m[1:])]


def brute(text):
    own, found = shingled(text or ""), []
    for name, template in licenses.TEMPLATES.items():
        t = [s for s, _, _ in shingled(template)]
        best = []
        n = min(len(t), len(own))
        for i in range(len(own) - n + 1 if n else 0):
            share = len({s for s, _, _ in own[i : i + n]} & set(t)) / len(set(t))
            if share >= 0.8 - 1e-9:
                row = (i, i + n, name, share)
                if best and i < best[-1][1]:
                    best[-1] = row if share > best[-1][3] else best[-1]
                else:
                    best.append(row)
        found += best
    return ",".join(f"{n}:{own[i][1]}:{own[e - 1][2]}" for i, e, n, _ in sorted(found))


def test_matches_brute_force(spark):
    r = random.Random(8)
    notices = list(licenses.TEMPLATES.values())
    rows = [(0, None), (1, ""), (2, "reserved"), (3, "ALL RIGHTS RESERVED"), (4, "word " * 30000 + notices[1])]
    for d in range(5, 200):
        parts = ["été prose 🙂 " * r.randint(0, 3)]
        for _ in range(r.randint(0, 3)):
            words = r.choice(notices).split()
            if r.random() < 0.4:
                words[r.randrange(len(words))] = "changed"
            parts += [" ".join(words), r.choice([" and more ", "\n", " the license under "])]
        rows.append((d, "".join(parts)))
    got = {x["doc_id"]: x["spans"] for x in licenses.digest(spark.createDataFrame([(d, t, "f") for d, t in rows], "doc_id long, text string, found string")).collect()}
    assert got == {d: brute(t) for d, t in rows}
    assert licenses.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_guarantee_the_probability():
    b = licenses.bands_for(0.8, 1, 0.9995)
    assert 1 - (1 - 2 / 3) ** b >= 0.9995 > 1 - (1 - 2 / 3) ** (b - 1)


def test_repeated_rows_and_notices_cut_short(spark):
    notice = licenses.TEMPLATES["mpl-2.0"]
    rows = [(1, notice), (1, notice), (None, notice), (2, notice.rsplit(" ", 2)[0]), (3, notice.rsplit(" ", 9)[0])]
    got = licenses.digest(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["licenses"]) for r in got if r["doc_id"] != 3) == [(False, 1, "mpl-2.0"), (False, 1, "mpl-2.0"), (False, 2, "mpl-2.0"), (True, None, "mpl-2.0")]
    assert [r["licenses"] for r in got if r["doc_id"] == 3] == [""]


def test_whole_texts_are_found_with_changes_among_hundreds_of_templates(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(6))
    many = {f"t{i}": " ".join(word() for _ in range(r.choice([3, 9, 40, 400, 2500]))) for i in range(300)}
    rows, want = [], {}
    for d, name in enumerate(r.sample(sorted(many), 60)):
        words = many[name].split()
        for i in r.sample(range(len(words)), len(words) // 30):
            words[i] = word()
        rows.append((d, " ".join([word() for _ in range(50)] + words + [word() for _ in range(50)])))
        want[d] = [name]
    got = {x["doc_id"]: [f["license"] for f in x["found"]] for x in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string"), many).collect()}
    assert got == want
