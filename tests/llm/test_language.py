"""Language identification: held-out accuracy, what has no letter, and what is rejected."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from metrelle.llm import common, language
from pyspark.sql import functions as F


def prose(r, lang, n):
    parts = {"en": ["the", "and", "with", "thing", "other", "ation"], "de": ["der", "und", "schön", "über", "keit", "nicht"], "fr": ["le", "été", "que", "eau", "ç", "ment"]}[lang]
    return [r.choice(parts) + "".join(r.choice(parts) for _ in range(2)) for _ in range(n)]


def test_language_on_held_out_rows_and_odd_ones(spark):
    r = random.Random(3)
    rows = [(i, " ".join(prose(r, lang, 40)), lang) for i in range(300) for lang in [r.choice(["en", "de", "fr"])]]
    odd = [(1000, None, None), (1001, "123 !?", "en"), (1002, "", None), (1003, "Привет, как дела? Сегодня хорошая погода на улице.", None)]
    got = {x["doc_id"]: x for x in language.digest(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect()}
    held = [got[i]["lang_pred"] == lang for i, _, lang in rows if got[i]["held_out"]]
    assert len(held) > 40 and np.mean(held) >= 0.98
    assert [got[d]["lang_pred"] for d in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]["score"] == 0 and got[1003]["rejected"]
    assert language.digest(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    assert language.digest(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")).first()["lang_pred"] == "und"


def test_rejection_passes_clashing_columns(spark):
    rows = [(i, "the thing and other", "en", "p", 0.5, [1]) for i in range(8)] + [(9, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, lang string, lang_pred string, score double, rejected array<int>")
    got = language.drop_rejected(frame)
    assert got.columns == frame.columns and sorted(map(tuple, got.collect())) == rows[:8]


def test_texts_without_a_letter(spark):
    rows = [(i, "the thing and other", "en") for i in range(40)] + [(100 + i, t, None) for i, t in enumerate(["½ ²", "Ⅳ ①", "12 ³", "—", "ß", "日", "ª"])]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[100 + i] for i in range(4)] == [("und", 0.0)] * 4 and [got[104 + i][0] for i in range(3)] == ["en"] * 3


def test_unlearnt_languages_and_no_language_are_rejected(spark):
    r = random.Random(5)
    rows = [(i, " ".join(prose(r, lang, r.choice([1, 2, 4, 8, 20, 60]))), lang) for i in range(1500) for lang in [r.choice(["en", "de", "fr"])]]
    odd = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri.",
        "xkcd qwrtz plmkn bvcxz tgbhn wsxed rfvtg yhnuj mikol pqazw", "dGhpcyBpcyBhIGJhc2U2NCBzdHJpbmcgd2l0aCBsb25nIGNvbnRlbnQgYW5kIG1vcmU=",
    ]
    frame = spark.createDataFrame(rows + [(5000 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["rejected"] for x in language.digest(frame).collect()}
    assert all(got[5000 + i] for i in range(len(odd))) and np.mean([got[i] for i in range(1500)]) <= 0.005


def test_all_training_rows_count(spark):
    """Document frequencies and limits of rows that no sample holds, and centroids that end where all rows' means are."""
    r = random.Random(11)
    rows = [(i, " ".join(prose(r, lang, r.choice([2, 9, 30]))), lang) for i in range(600) for lang in [r.choice(["en", "de"])]]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = language.fit(train, F.lit(True), sample_rows=60, centroids=1)
    df = Counter(g for _, t, _ in rows for g in set(grams(t)))
    assert all(abs(model.idf[g] - (math.log((1 + len(rows)) / (1 + n)) + 1)) < 1e-5 for g, n in df.items())
    idf = {g: math.log((1 + len(rows)) / (1 + n)) + 1 for g, n in df.items()} | {None: 0.0}
    for lang, centre in zip(model.languages, model.centroids):
        want = mean([vector(t, idf) for _, t, x in rows if x == lang])
        assert max(abs(centre[g] - x) for g, x in want.items()) < 1e-5
    scores = {}
    for x in language.predicted(train, model, "text").collect():
        scores.setdefault(int(np.digitize(len(x["text"].encode()), language.LENGTHS)), []).append(x["score"])
    for k, own in scores.items():
        if len(own) >= language.LEAST_ROWS:
            at = sorted(own)[int(language.REJECT_QUANTILE * (len(own) - 1))]
            assert abs(model.limits[k] - language.REJECT_SHARE * at) < 2e-5


def test_repeated_rows_and_very_long_text(spark):
    rows = [(1, "der und schön " * 60000, "de"), (1, "der und schön " * 60000, "de"), (3, "the and with", "en"), (4, "the and with", "en"), (None, "the", "en")]
    got = language.digest(spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, held_out string")).collect()
    assert len(got) == 5 and {r["lang_pred"] for r in got if r["doc_id"] == 1} == {"de"}


def grams(text):
    """The hashed grams of a text, one by one."""
    data, low = text.encode(), []
    for i, b in enumerate(data):
        if 65 <= b <= 90:
            b += 32
        if i and data[i - 1] == 0xC3 and 0x80 <= b <= 0x9E:
            b += 32
        low.append(b if 97 <= b <= 122 or b >= 128 else 32)
    for size in (1, 2, 3):
        for i in range(len(low) - size + 1):
            gram = low[i : i + size]
            if gram == [32] or any(a == b == 32 for a, b in zip(gram, gram[1:])):
                continue
            code = 0
            for b in gram:
                code = (code * 257 + b + 1) % 2**32
            yield (code * 0x9E3779B1 % 2**32) >> 19


def vector(text, idf):
    n = {}
    for g in grams(text):
        n[g] = n.get(g, 0) + 1
    v = {g: math.log(1 + c) * idf.get(g, idf[None]) for g, c in n.items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    return {g: x / size for g, x in v.items()} if size else {}


def dot(a, b):
    return sum(x * b.get(g, 0.0) for g, x in a.items())


def mean(vectors):
    total = {}
    for v in vectors:
        for g, x in v.items():
            total[g] = total.get(g, 0.0) + x
    size = math.sqrt(sum(x * x for x in total.values()))
    return {g: x / size for g, x in total.items()}


def centres_of(vectors, k, rounds):
    centres = [mean(vectors)]
    likeness = [dot(v, centres[0]) for v in vectors]
    usual = [v for v, x in zip(vectors, likeness) if x >= np.quantile(likeness, 0.1)]
    while len(centres) < min(k, len(usual)):
        centres.append(min(usual, key=lambda v: max(dot(v, c) for c in centres)))
    own = lambda: [max(range(len(centres)), key=lambda j: dot(v, centres[j])) for v in vectors]
    for _ in range(rounds):
        near = own()
        centres = [mean([v for v, o in zip(vectors, near) if o == j]) if j in near else c for j, c in enumerate(centres)]
    near = own()
    return [c for j, c in enumerate(centres) if near.count(j) * 100 >= len(vectors)]


def test_against_a_classifier_by_hand(spark):
    """TF-IDF, centroids and cosines over dicts, learnt from the same rows; every prediction and its score."""
    r = random.Random(8)
    rows = [(i, " ".join(prose(r, lang, r.randint(3, 25))) + r.choice(["", " 12 -- ", " É"]), lang) for i in range(110) for lang in [r.choice(["en", "de", "fr"])]]
    docs = [*rows, (None, rows[0][1], "en"), (900, "über die keit 7", None), rows[4], (901, "--", "de"), (902, "x", None)]
    got = language.digest(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    learnt = [(t, lang) for d, t, lang in docs if d is not None and lang is not None and zlib.crc32(str(d).encode()) % 4 != 2]
    df = {}
    for t, _ in learnt:
        for g in set(grams(t)):
            df[g] = df.get(g, 0) + 1
    idf = {g: math.log((1 + len(learnt)) / (1 + n)) + 1 for g, n in df.items()} | {None: math.log(1 + len(learnt)) + 1}
    centres = [(lang, c) for lang in ("de", "en", "fr") for c in centres_of([v for v in (vector(t, idf) for t, x in learnt if x == lang) if v], language.CENTROIDS, 12)]
    want = Counter()
    for d, t, _ in docs:
        likeness = [(dot(vector(t, idf), c), lang) for lang, c in centres]
        score, lang = max(likeness, key=lambda x: x[0]) if any(map(str.isalpha, t)) else (0.0, "und")
        want[d, d is not None and zlib.crc32(str(d).encode()) % 4 == 2, lang, round(score, 3)] += 1
    assert Counter((x["doc_id"], x["held_out"], x["lang_pred"], round(x["score"], 3)) for x in got) == want


def test_vectors_of_many_short_texts_are_made_in_bounded_slices():
    """A thousand short texts are one pass over bytes; their vectors and the copies made of them took 400 MB of a worker."""
    rng = np.random.default_rng(3)
    column = pa.array(["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(0, 40, 1000)])
    centroids = language.unit(rng.random((4, language.DIMENSIONS)))
    model = language.Model(["a", "b", "c", "d"], centroids, np.zeros(len(language.LENGTHS) + 1), np.ones(language.DIMENSIONS))
    spans, tops = [], []
    tracemalloc.start()
    for lo, hi, data, offsets in common.text_slices(column, language.SLICE_ROWS):
        spans.append((lo, hi))
        tops.append(language.unit(np.log1p(language.counts(data, offsets)) * model.idf) @ model.centroids.T)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [lo for lo, _ in spans] == [0, *[hi for _, hi in spans[:-1]]] and spans[-1][1] == 1000
    assert peak < 64 << 20
    data, offsets = common.utf8(column)
    assert np.allclose(np.concatenate(tops), language.unit(np.log1p(language.counts(data, offsets))) @ centroids.T)
