"""Decontamination with a benchmark beyond one broadcast: the same rows, words compared, only hits shuffled."""

import hashlib
import random
from collections import Counter

import pytest
from metrelle.llm import common, decontamination


def brute(docs, items, n=10):
    held = {}
    for i, t in items:
        w = (t or "").split()
        for k in range(max(1, len(w) - n + 1) if w else 0):
            held.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(g) for g in held}
    rows = Counter()
    for d, t in docs:
        w, hit, found = (t or "").split(), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if g := held.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    found |= g
        rows[d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return rows


def tables(spark, r, n_items, words):
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    prose = lambda k: [word() for _ in range(k)]
    items = [(i, " ".join(prose(words))) for i in range(n_items)] + [(n_items, "one two three"), (n_items + 1, None), (n_items + 2, "")]
    docs = []
    for d in range(120):
        text = prose(r.randint(0, 60))
        for _ in range(r.choice([0, 0, 1, 3])):
            source = r.choice(items)[1]
            w = (source or "").split()
            at = r.randrange(max(1, len(w) - 9))
            text += w[at : at + r.choice([9, 10, 25])] + prose(5)
        docs.append((d, " ".join(text)))
    docs += [docs[3], (3, "another one two three"), (500, None), (501, "")] + [(600 + i, items[0][1]) for i in range(60)]
    frames = spark.createDataFrame([(*x, 1, "c") for x in docs], "doc_id long, text string, key int, size string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    return docs, items, *frames


@pytest.mark.parametrize("keys", [50, 100_000])
def test_parts_of_the_set_and_shuffled_grams(spark, monkeypatch, keys):
    docs, items, d, b = tables(spark, random.Random(1), 12, 40)
    monkeypatch.setattr(decontamination, "KEYS", keys)
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert Counter(map(tuple, decontamination.digest(d, b).collect())) == brute(docs, items)


def test_half_a_million_windows_shuffle_hits_only(spark):
    docs, items, d, b = tables(spark, random.Random(2), 2000, 260)
    found = decontamination.hits(d, b)
    assert decontamination.benchmark_windows(b).count() > 500_000
    assert Counter(map(tuple, decontamination.digest(d, b).collect())) == brute(docs, items)
    rows = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == len(docs) and "BroadcastHashJoin" in plan


def test_equal_keys_of_other_words_are_no_hits(spark, monkeypatch):
    """With keys of four values nearly every place is a candidate; the words decide."""
    docs, items, d, b = tables(spark, random.Random(3), 6, 30)
    window, windows = decontamination._window_key, decontamination.benchmark_windows
    monkeypatch.setattr(decontamination, "_window_key", lambda *a: decontamination.F.pmod(window(*a), decontamination.F.lit(4)))
    monkeypatch.setattr(decontamination, "benchmark_windows", lambda *a: windows(*a).withColumn("key", decontamination.F.pmod("key", decontamination.F.lit(4))))
    assert Counter(map(tuple, decontamination.digest(d, b).collect())) == brute(docs, items)
