"""Importance resampling against a brute-force version; hashing of spans; defined results."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from metrelle.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score string, rank int, h1 string"


def features(text, runs):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def brute(docs, items, runs=1, buckets=10_000, least=20, percent=10, salt="2024"):
    held = [(d, *features(t, runs)) for d, t in docs]
    s = Counter(c % buckets for _, _, f in held for c in f)
    t = Counter(c % buckets for x in items for c in features(x, runs)[1] for c in [c])
    size_s, size_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * size_s / ((s[b] + 1) * size_t))) for b in range(buckets)}
    rows = []
    for d, n, f in held:
        weight = sum(gain[c % buckets] for c in f) // len(f) if f else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"{salt}:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, n, len(f), weight, score, None])
    able = sorted((r for r in rows if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return Counter(map(tuple, rows))


def corpus(r, n):
    common = ["The", "and", "of", "été", "über", "x", "9"]
    word = lambda: r.choice(common) if r.random() < 0.5 else "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    text = lambda k: "".join(word() + r.choice([" ", ", ", "\n", " -- "]) for _ in range(k))
    docs = [(i, text(r.choice([0, 1, 19, 20, 21, 60, 300]))) for i in range(n)]
    docs += [(n + i, docs[5 + i % 3][1]) for i in range(n // 3)]  # copies, of which three texts have many
    docs += [(3, docs[3][1]), (4, "another text of document four"), (None, text(40)), (n * 9, None), (n * 9 + 1, ""), (n * 9 + 2, "... --")]
    docs += [(n * 9 + 3, "a" * 5000 + " " + "b" * 47 + " " + "c" * 48 + " " + "d" * 49), (n * 9 + 4, text(40_000))]
    return docs, [text(30) for _ in range(5)] + [None, ""]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "clash", 1, "clash") for d, t in docs], SCHEMA).repartition(5)


def rows(df):
    return Counter(map(tuple, df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()))


@pytest.mark.parametrize("settings", [{}, {"runs": 3, "buckets": 700, "percent": 35}])
def test_against_brute_force(spark, settings):
    docs, items = corpus(random.Random(4), 150)
    got = rows(resampling.resampling(frame(spark, docs), spark.createDataFrame([(t,) for t in items], "text string"), **settings))
    assert got == brute(docs, items, **settings)
    assert any(r[5] for r in got)


def test_ties_across_the_end_of_the_draw(spark):
    docs = [(i // 4, " ".join(["same"] * 25)) for i in range(100)]  # each id, and so each score, four times
    got = rows(resampling.resampling(frame(spark, docs), spark.createDataFrame([("same",)], "text string")))
    ranks = sorted(r[5] for r in got.elements() if r[5])
    assert ranks == list(range(1, 11)) and got == brute(docs, ["same"])


@pytest.mark.parametrize(("docs", "items"), [([], ["a b"]), ([(1, "a b c")], []), ([], []), ([(1, None), (2, "")], [None])])
def test_empty(spark, docs, items):
    got = rows(resampling.resampling(frame(spark, docs), spark.createDataFrame([(t,) for t in items], "text string")))
    assert got == brute(docs, items)


def test_drawn_documents_keep_their_columns(spark):
    docs, items = corpus(random.Random(5), 60)
    df = frame(spark, docs)
    got = resampling.resampled(df, spark.createDataFrame([(t,) for t in items], "text string"))
    want = {r[0] for r in brute(docs, items) if r[5]}
    assert got.columns == df.columns and {r[0] for r in got.collect()} == want


def test_crc32_of_spans():
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 4000, dtype=np.uint8)
    starts = r.integers(0, 3000, 500)
    ends = starts + r.choice([0, 1, 2, 7, 47, 48, 49, 50, 900], 500)
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert resampling.crc32_spans(data, starts, ends).tolist() == want
    assert resampling.crc32_spans(data, starts[:0], ends[:0]).tolist() == []
