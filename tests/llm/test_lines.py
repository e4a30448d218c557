"""Line dedup against brute force."""

import hashlib
import random

import pytest
from metrelle.llm import common, lines


def near(a: str, b: str) -> bool:
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, least=20):
    flat = [(d, i, x) for d, t in rows if d is not None and t is not None for i, x in enumerate(t.split("\n")) if x.strip()]
    flat.sort()
    first = {}
    for d, i, x in flat:
        first.setdefault(x, (d, i))
    gone = set()
    for x, at in first.items():
        is_near = len(x) >= least and any(y != x and len(y) >= least and first[y] < at and near(x, y) for y in first)
        gone |= {(d, i) for d, i, y in flat if y == x and (is_near or (d, i) != at)}
    return {(d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t in rows}


def corpus(seed, n=60):
    r = random.Random(seed)
    base = ["".join(r.choice("abé 日🙂x") for _ in range(r.randint(18, 30))) for _ in range(8)]
    rows = []
    for d in range(n):
        text = []
        for _ in range(r.randint(0, 4)):
            x = r.choice(base)
            for _ in range(r.randint(0, 2)):
                i = r.randrange(len(x))
                x = r.choice([x[:i] + x[i + 1 :], x[:i] + "q" + x[i:], x[:i] + "z" + x[i + 1 :]])
            text.append(x)
        rows.append((d, "\n".join(text)))
    return rows + [(None, base[0]), (n, None), (n + 1, ""), (n + 2, " \n\n "), (n + 3, "ab\nab\nac")]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    got = lines.cleaned(spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, h1 string"))
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == brute(rows)
    assert "h1" in got.columns


def test_matches_brute_force_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_LINES", -1)
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    rows = corpus(3)
    got = lines.cleaned(spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, version string"))
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == brute(rows) and got.columns[:3] == ["doc_id", "text", "version"]


def test_two_texts_of_one_id_repeated_rows_and_long_lines(spark):
    long = "".join(random.Random(1).choice("abcdef ") for _ in range(30000)) + "."
    rows = [(5, "a\nb"), (5, "c\na"), (6, "d\nd"), (6, "d\nd"), (7, long + "\nx"), (8, "y\n" + long[:9000] + "z" + long[9001:])]
    got = sorted((r["doc_id"], r["text"]) for r in lines.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [t for d, t in got if d == 6] == ["d", "d"] and (7, long + "\nx") in got and (8, "y") in got
    assert sorted("\n".join(t for d, t in got if d == 5).split("\n")) == ["a", "b", "c"]


def test_empty_table_and_digest(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lines.digest(none).count() == 0
    got = lines.digest(spark.createDataFrame([(1, "a\na"), (2, "b")], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 0, hashlib.sha256(b"a").hexdigest()), (2, 0, 0, hashlib.sha256(b"b").hexdigest())]


def test_variants_agree_with_strings():
    texts = ["abc", "ac", "", "日本", "aab"]
    found, row, place = lines.variant_hashes(texts)
    by = {}
    for h, i, p in zip(found, row, place):
        t = texts[i] if p < 0 else texts[i][:p] + texts[i][p + 1 :]
        assert by.setdefault(t, h) == h
    assert len(set(by.values())) == len(by)
