"""Lexical search against a brute-force version; bounds; defined results."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from metrelle.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def brute(docs, items, k=20):
    held = [(d, c, sum(c.values())) for d, t in docs if (c := terms(t))]
    n, total = len(held), sum(s for _, _, s in held)
    df = Counter(t for _, c, _ in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    asked = {}
    for i, t in dict.fromkeys(items):
        if i is not None:
            asked[i] = asked.get(i, Counter()) + terms(t)
    out = []
    for i, q in asked.items():
        found = []
        for d, c, size in held:
            m = 75 + 25 * size * n // total
            score = sum(times * w[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in q.items() if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k])]
    return Counter(out)


def corpus(r, n):
    common = ["The", "and", "OF", "été", "Über", "x", "9"]
    word = lambda: r.choice(common) if r.random() < 0.4 else "".join(r.choice("abcé") for _ in range(r.randint(1, 4)))
    text = lambda k: "".join(word() + r.choice([" ", ", ", "_", "\n", "[", "@"]) for _ in range(k))
    docs = [(i, text(r.choice([0, 1, 3, 10, 40, 200]))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(n // 3)] + [(5, docs[5][1]), (6, text(9)), (None, text(30)), (None, text(30)), (9 * n, None), (9 * n + 1, ""), (9 * n + 2, text(30_000))]
    items = [(i, text(r.choice([1, 5, 30]))) for i in range(25)]
    return docs, [*items, items[3], (4, "the the the abc"), (None, "the"), (90, None), (91, "--"), (92, "unknownword"), (93, docs[8][1] * 3)]


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, "clash", 2) for d, t in docs], "doc_id long, text string, ids string, score int").repartition(4),
        spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string"),
    )


def rows(df):
    return Counter(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()))


@pytest.mark.parametrize("k", [20, 3])
def test_against_brute_force(spark, k):
    docs, items = corpus(random.Random(k), 200)
    d, b = frames(spark, docs, items)
    assert rows(lexical.search(lexical.index(d), b, k)) == brute(docs, items, k)


def test_blocks_shards_and_parts_of_postings(spark, monkeypatch):
    docs, items = corpus(random.Random(8), 150)
    for name, value in (("ITEMS", 4), ("ENTRIES", 60), ("SHARD_BYTES", 500), ("AT_ONCE", 50)):
        monkeypatch.setattr(lexical, name, value)
    d, b = frames(spark, docs, items)
    assert rows(lexical.search(lexical.index(d), b)) == brute(docs, items)


def test_few_documents_are_scored(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(["the", "of", "and"]) if r.random() < 0.5 else "".join(r.choice("abcdef") for _ in range(3)) for _ in range(50))) for i in range(2000)]
    items = [(i, " ".join(docs[i * 7][1].split()[:30])) for i in range(10)]
    found = lexical.search(lexical.index(frames(spark, docs, items)[0].coalesce(1)), frames(spark, docs, items)[1])
    assert rows(found) == brute(docs, items)
    tried = [x for (x,) in found.select("tried").collect()]
    assert max(tried) < 400


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a b")], []), ([(1, None), (2, " ")], [(1, "a")]), ([(1, "a")], [(1, "a")]), ([(2, "a b"), (1, "b a")], [(1, "b")])])
def test_small_tables(spark, docs, items):
    d, b = frames(spark, docs, items)
    assert rows(lexical.search(lexical.index(d), b)) == brute(docs, items)


def test_bounds_hold():
    r = np.random.default_rng(2)
    tf, m = r.integers(1, 300, 20_000), r.integers(75, 10**7, 20_000)
    exact = lexical.shares(tf, m)
    byte = -(-exact * 255 // lexical.SHARE)
    assert (byte >= 0).all() and (byte < 256).all() and (lexical.LOWER_BOUND[byte] <= exact).all() and (exact <= lexical.UPPER[byte]).all()
