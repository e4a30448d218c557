"""Personal data against Python's own regular expressions."""

import hashlib
import random
import re
import time

from metrelle.llm import pii
from pyspark.sql import functions as F

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def ok(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 10 <= len(digits) <= 15,
    }[kind]()


def brute(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(BASE[kind], text or "") if ok(kind, m[0])]
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def texts():
    r = random.Random(5)
    fixed = [None, "", "a@b.c_d@e.f x@y.com.@z.w a@b.@c.d", "1.2.3.4.5.6.7.8 999.1.1.1 256.1.1.1 01.002.0000003.4", "é🙂 +1 (988) 555-2485 4992739871649927 4111 1111 1111 1111",
             "4111-1111-1111-1111- 41111111111111114111111111111111", "+1+2 3456789012)", "a" * 5000 + "@" + "b." * 20000 + "c", "1" * 3000 + "." + "2" * 3000, "1 " * 30000,
             "mail a@b.c or 1.2.3.4 or +1 (988) 555-2485. " * 1500]
    rows = ["".join(r.choice("ab1234@.+- ()é_") for _ in range(r.randint(0, 80))) for _ in range(400)]
    return fixed + rows + ["".join(r.choice("0123456789 -.") for _ in range(60)) for _ in range(200)]


def test_base_spans_match_brute_force(spark):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame([(d, t, "k", True) for d, t in rows], "doc_id long, text string, kind string, base boolean").repartition(4)
    got = {r["doc_id"]: r for r in pii.digest(frame).collect()}
    for d, t in rows:
        want = brute(t)
        assert got[d]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (t or "")[:80]
        assert set(filter(None, want.split(","))) <= set(got[d]["spans"].split(","))
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [want.count(f"{k}:") for k in pii.KINDS]


def test_wider_forms_are_added_and_redacted(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    rows = [(i, f"please email {word()}@{word()}.example.com now") for i in range(60)]
    rows += [(100 + i, f"please email {word()} (at) {word()}.example.com now") for i in range(20)] + [(200 + i, f"{word()} {word()}") for i in range(50)]
    rows += [(300 + i, f"see x/{r.randint(100, 999)}.{r.randint(100, 999)}.{r.randint(1000, 9999)}/y") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["spans"] for x in pii.digest(frame).collect()}
    assert all(got[100 + i].startswith("email:13:") for i in range(20))
    assert all(got[200 + i] == "" for i in range(50)) and all(got[300 + i] == "" for i in range(40))
    clean = {x["doc_id"]: x["text"] for x in pii.redacted(frame).collect()}
    assert clean[0] == "please email <email> now" == clean[100] and clean[200] == rows[80][1]


def test_long_runs_and_many_matches_stay_linear(spark):
    """Texts on which Python's own expressions take quadratic time; what they must give is known."""
    many = "x@y.zz (555) 010-0100 " * 20000
    rows = [(0, "a" * 60000), (1, "1" * 50000 + "." + "2" * 50000), (2, "a" * 50000 + "@" + "b." * 60000 + "c"), (3, many)]
    began = time.time()
    got = {r["doc_id"]: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 120
    digest = lambda spans: hashlib.sha256(spans.encode()).hexdigest()
    assert [got[d]["base_sha256"] for d in (0, 1)] == [digest("")] * 2 and got[2]["base_sha256"] == digest("email:0:170002")
    assert got[3]["n_email"] == 20000 and got[3]["base_sha256"] == digest(",".join(f"email:{22 * i}:{22 * i + 6}" for i in range(20000)))


def test_spans_beside_the_base_match_brute_force(spark):
    r = random.Random(9)
    spans = [(s, s + r.randint(1, 6)) for s in r.sample(range(0, 400, 8), 30)]
    rows = []
    for d in range(80):
        wide = sorted(r.sample(spans, r.randint(0, 9)))
        base = [(s, s + r.randint(1, 12)) for s in r.sample(range(400), r.randint(0, 9))]
        rows.append((d, wide, base))
    frame = spark.createDataFrame(rows, "d int, wide array<struct<start:int,end:int>>, base array<struct<start:int,end:int>>")
    got = {x["d"]: [tuple(w) for w in x["a"]] for x in frame.select("d", pii.apart(F.col("wide"), F.col("base")).alias("a")).collect()}
    assert got == {d: [(s, e) for s, e in wide if not any(u < e and s < v for u, v in base)] for d, wide, base in rows}


def test_repeated_rows_each_give_a_row(spark):
    rows = [(1, "a@b.cc"), (1, "a@b.cc"), (None, "a@b.cc"), (1, None)]
    got = pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["n_email"]) for r in got) == [(False, 0), (False, 1), (False, 1), (True, 1)]


def test_empty_table(spark):
    assert pii.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
