"""The near-duplicate join against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from metrelle.llm import near
from metrelle.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    rep = {}
    for d in sorted(sets):
        rep.setdefault(sets[d] or d, d)
    parent = {d: d for d in sets}
    n = Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    reps = [d for s, d in rep.items() if isinstance(s, frozenset)]
    for i, a in enumerate(reps):
        for b in reps[i + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                n[a] += 1
                n[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    copies = Counter(rep[sets[d] or d] for d in sets)
    return {(d, root(c := rep[sets[d] or d]), c, copies[c], n[c]) for d in sets}


def corpus(seed, size, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice([3, 6, 60, 120]))] for _ in range(n)]
    rows = []
    for d in range(size):
        words = list(bases[int(r.random() ** 3 * n)])
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((d, r.choice([" ", "  ", "\n"]).join(words).replace("w1", r.choice(["w1", "W1"]))))
    return [*rows, (size, None), (size + 1, ""), (size + 2, " ... "), (size + 3, "one two"), (size + 4, "One, two!")]


@pytest.mark.parametrize("small_bucket, block", [(16, 512), (3, 5)])
def test_matches_brute_force(spark, monkeypatch, small_bucket, block):
    monkeypatch.setattr(near, "SMALL_BUCKET", small_bucket)
    monkeypatch.setattr(near, "BLOCK_CLASSES", block)
    rows = corpus(3, 160, 12)
    frame = spark.createDataFrame([(d, t, "x", b"k") for d, t in rows], "doc_id long, text string, class string, key binary")
    assert {tuple(r) for r in near.joined(frame).collect()} == brute(rows)


def test_null_ids_repeats_and_empty(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(None, text), (5, text), (5, text), (2, text + " b")]
    got = sorted(tuple(r) for r in near.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r[0] is not None)
    assert got == [(2, 2, 2, 1, 1), (5, 2, 5, 2, 1), (5, 2, 5, 2, 1)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near.joined(none).count() == 0 and near.keep_one(none).count() == 0
    kept = near.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r[0] is None, r[0]) for r in kept.collect()) == [(False, 2), (True, None)]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_prefixes_are_shortened_to_what_is_found():
    assert near.shortened(8, {}, 0.8) == 3 and near.met(0.8, 3) > near.RECALL > near.met(0.8, 4)
    assert near.shortened(8, {99: 10_000_000}, 0.8) == 8
    assert near.shortened(8, {82: 1000}, 0.8) == 4 == near.shortened(4, {82: 1000}, 0.8)


def test_recall_on_pairs_near_the_threshold():
    """Pairs of sets at similarities of 0.8 to 0.9: the share that some tree's prefix brings together, against met()."""
    rng = np.random.default_rng(4)
    both, shared = 300, {level: 0 for level in (4, 8)}
    for _ in range(both):
        common = rng.integers(1, 1 << 62, 400).astype(np.uint64)
        a, b = (np.unique(np.append(common, rng.integers(1, 1 << 62, 45).astype(np.uint64))) for _ in range(2))
        (u, v), (x, y) = near.paths(a), near.paths(b)
        shared[4] += bool((u == x).any())
        shared[8] += bool(((u == x) & (v == y)).any())
    s = 400 / 490
    assert shared[4] >= 0.99 * both and abs(shared[8] / both - near.met(s, 8)) < 0.06


def test_very_long_texts_and_two_texts_of_one_id(spark):
    r = random.Random(6)
    words = [f"w{r.randrange(10**6)}" for _ in range(60000)]
    changed = list(words)
    changed[5::200] = ["x"] * len(changed[5::200])
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[:300])), (4, "another text of some words"), (4, " ".join(words[5:300]))]
    got = {(r["doc_id"], r["class_id"], r["n_links"]) for r in near.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 3, 1)}
