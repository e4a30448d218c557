"""Near-duplicate join: five-word shingle sets with a Jaccard similarity of 0.8 or more, found by a MinHash LSH forest.

A document's path in each of TREES trees is DEPTH min-hashes long, of 16 bits a level; a tree's documents that share the
first so many levels are a node of its prefix trie. The search starts with whole paths. Documents that share a node are
candidates and are verified on the exact sets, so no false pair is ever returned; each link found, of similarity s, stands
for 1 / p(s) links that are there, where p(s) is the chance that a pair so alike shares a node at this level in some tree.
From these the recall at every level is estimated, with one more link at the threshold so that it is never taken on trust,
and prefixes are shortened to the longest at which it reaches RECALL; what is found there is measured in the same way, until
no shorter prefix is wanted. Nodes at a shorter prefix hold those at longer ones, so the last search is the whole result.

Documents with the same set form one class and are stood for by their smallest doc_id. A node of up to SMALL_BUCKET
classes gives its pairs, which are made distinct over the trees. A larger one is dealt into blocks, every two blocks meet
in one task, and only counts and one edge per member leave it; a pair is counted in its first shared tree there, and not
at all if some small node gives it. So no link is lost, none is counted twice, and no group gathers in one task.

Defined results: words as in `common`; a text of fewer than five words, but not none, is one shingle; texts of any length
are read whole; a text without words, or null, is a class of its own without links; rows that share a doc_id are one
document, whose text is their different texts in order, a line each, and each gives a row; rows with a null doc_id have nulls for class_id and n_links 0; repeated
rows each give a row; ties don't arise, as every link at or above the threshold counts; an empty table gives none; other
columns are ignored, and `keep_one` passes them on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrelle.llm.common import COPIES, cut, discard, grams, mix, seeds, small, small_batches, stored, text_slices, united, word_hashes
from metrelle.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 8
#: Share of the links that a prefix must find, by estimate, or it is shortened.
RECALL = 0.9999
#: Classes of a node that still gives pairs; classes and shingles of a block.
SMALL_BUCKET, BLOCK_CLASSES, BLOCK_SHINGLES = 16, 256, 250_000
#: Similarities are counted in steps of a hundredth.
STEPS = 100


def met(similarity: float, level: int) -> float:
    """The chance that a pair so alike shares the first `level` min-hashes in some tree."""
    return 1 - (1 - similarity**level) ** TREES


def shortened(level: int, found: dict[int, int], threshold: float) -> int:
    """The longest prefix, from `level` down, at which the recall reaches RECALL; found: links by similarity in STEPS."""
    there = [(threshold, 1.0), *((s / STEPS, n / met(s / STEPS, level)) for s, n in found.items())]
    total = sum(n for _, n in there)
    for shorter in range(level, 1, -1):
        if sum(n * met(s, shorter) for s, n in there) >= RECALL * total:
            return shorter
    return 1


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of a string column."""
    for lo, _, data, offsets in text_slices(column):
        words, _, _, first = word_hashes(data, offsets)
        found, _, runs = grams(words, first, n)
        for i in range(len(offsets) - 1):
            yield lo + i, np.unique(found[runs[i] : runs[i + 1]])


def paths(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The path in each tree: the first four levels and the last four, 16 bits each, the first level highest."""
    k = seeds(TREES * DEPTH, 6)
    lowest = np.full(TREES * DEPTH, np.iinfo(np.uint64).max)
    for lo in range(0, len(shingles), 8_000):
        hashed = (shingles[lo : lo + 8_000] ^ (k >> np.uint64(7))[:, None]) * k[:, None]
        lowest = np.minimum(lowest, hashed.min(1))
    level = (mix(lowest) & np.uint64(0xFFFF)).reshape(TREES, 2, 4) << np.array([48, 32, 16, 0], np.uint64)
    both = np.bitwise_or.reduce(level, axis=2).view(np.int64)
    return both[:, 0], both[:, 1]


def signatures(documents: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, class, size, upper, lower): a 128-bit key of the shingle set, its size and its paths; null without words."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, upper, lower = [None] * batch.num_rows, [0] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
            for i, s in _sets(batch.column(1), n):
                if len(s):
                    keys[i], sizes[i] = hashlib.md5(s.tobytes(), usedforsecurity=False).digest(), len(s)
                    upper[i], lower[i] = paths(s)
            columns = [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), *[pa.array(x, pa.list_(pa.int64())) for x in (upper, lower)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "class", "size", "upper", "lower"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, class binary, size int, upper array<long>, lower array<long>")


def prefixes(level: int) -> Column:
    """The names of a document's nodes at a level, one per tree."""
    name = lambda x, tree: (
        F.xxhash64(tree, x["upper"], F.shiftrightunsigned(x["lower"], 16 * (DEPTH - level))) if level > 4 else F.xxhash64(tree, F.shiftrightunsigned(x["upper"], 16 * (4 - level)))
    )
    return F.transform(F.arrays_zip("upper", "lower"), name)


def shingle_sets(documents: DataFrame, ids: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(rep, set) for the documents named in ids(rep): sorted 64-bit shingles as bytes."""
    wanted = documents.select(F.col("doc_id").alias("rep"), "text").join(small(ids), "rep", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for _, s in _sets(batch.column(1), n)], pa.binary())], ["rep", "set"])

    return wanted.mapInArrow(run, "rep long, set binary").dropDuplicates(["rep"])


def _alike(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, threshold: float) -> np.ndarray | bool:
    return common >= threshold * (a + b - common) - 1e-9


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, alike): the pairs at the threshold or above, and their similarity in STEPS."""
        for batch in batches:
            keep, alike = [], []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if _alike(min(len(a), len(b)), len(a), len(b), threshold):
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    if _alike(common, len(a), len(b), threshold):
                        keep.append(i)
                        alike.append(STEPS * common // (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([*batch.select([0, 1]).take(pa.array(keep, pa.int64())).columns, pa.array(alike, pa.int32())], ["a", "b", "alike"])

    return run


def _blocks(threshold: float, count: bool):
    def run(table: pa.Table) -> pa.Table:
        """(rep, n, root) of the pairs that this meeting of two blocks (or one with itself) answers for; and with a null rep
        the number of links of a similarity in root. Without `count`, pairs that are known to be of one component are left out."""
        tree, lo, hi = (table.column(c)[0].as_py() for c in ("tree", "lo", "hi"))
        rep = table.column("rep").to_numpy()
        block = table.column("block").to_numpy()
        keys = np.array(table.column("keys").to_pylist(), np.int64)
        small_trees = ~table.column("hot").to_numpy().astype(np.int64)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set").combine_chunks()]
        size = np.array([len(s) for s in sets])
        _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.concatenate([[0], np.cumsum(size)])
        flag = np.zeros(len(shingle) + 1, np.int32)
        n, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        seen = np.zeros(STEPS + 1, np.int64)
        bits = np.int64(1) << np.arange(keys.shape[1], dtype=np.int64)
        for i in np.flatnonzero(block == lo):
            other = np.flatnonzero((rep > rep[i]) if lo == hi else (block == hi))
            if not count:
                other = other[root[other] != root[i]]
            if not len(other):
                continue
            shared = ((keys[other] == keys[i]) * bits).sum(1)
            mine = ((shared & -shared) == bits[tree]) & ((shared & small_trees[i]) == 0) & (rep[other] != rep[i])
            other = other[mine & _alike(np.minimum(size[other], size[i]), size[other], size[i], threshold)]
            if not len(other):
                continue
            flag[shingle[at[i] : at[i + 1]]] = 1
            places = np.concatenate([shingle[at[j] : at[j + 1]] for j in other])
            common = np.add.reduceat(flag[places], np.concatenate([[0], np.cumsum(size[other])[:-1]]))
            flag[shingle[at[i] : at[i + 1]]] = 0
            linked = _alike(common, size[other], size[i], threshold)
            seen += np.bincount((STEPS * common // (size[other] + size[i] - common))[linked], minlength=STEPS + 1)
            linked = other[linked]
            n[i] += len(linked)
            n[linked] += 1
            if len(linked):
                joined = np.isin(root, root[np.append(linked, i)])
                root[joined] = np.flatnonzero(joined)[rep[joined].argmin()]
        some, kinds = np.flatnonzero(n), np.flatnonzero(seen)
        return pa.table({"rep": pa.array([*rep[some].tolist(), *[None] * len(kinds)], pa.int64()), "n": pa.array([*n[some].tolist(), *seen[kinds].tolist()], pa.int64()), "root": pa.array([*rep[root[some]].tolist(), *kinds.tolist()], pa.int64())})

    return run


def links(documents: DataFrame, classes: DataFrame, level: int, threshold: float, n: int, count: bool) -> tuple[DataFrame, dict[int, int]]:
    """(rep, n, root): for every class with links at a level, parts of their number and classes of the same component; and
    the numbers of links by similarity in STEPS."""
    keyed = classes.select("rep", "size", prefixes(level).alias("keys"))
    nodes = keyed.select("rep", "size", F.posexplode("keys").alias("tree", "key"))
    buckets = nodes.groupBy("key").agg(F.count("*").alias("m"), F.sum("size").alias("shingles")).filter("m > 1")
    members = stored(nodes.join(buckets, "key"))
    sets = stored(shingle_sets(documents, cut(members.select("rep").distinct()), n))
    few = members.filter(F.col("m") <= SMALL_BUCKET)
    pairs = few.select("key", F.col("rep").alias("a")).join(few.select("key", F.col("rep").alias("b")), "key").filter("a < b").select("a", "b").distinct()
    pairs = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    pairs = cut(pairs.mapInArrow(_verified(threshold), "a long, b long, alike int"))
    found = pairs.select(F.col("a").alias("rep"), F.lit(1).cast("long").alias("n"), F.col("a").alias("root")).union(pairs.selectExpr("b", "1L", "a"))
    alike = {r[0]: r[1] for r in pairs.groupBy("alike").count().collect()}  # STEPS rows at most

    many = members.filter(F.col("m") > SMALL_BUCKET)
    if not many.isEmpty():
        hot = many.groupBy("rep").agg(F.bit_or(F.expr("shiftleft(1L, tree)")).alias("hot"))
        parts = F.ceil(F.greatest(F.col("m") / BLOCK_CLASSES, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
        many = many.select("key", "tree", "rep", parts.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        many = many.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        many = many.select("key", "tree", "rep", "block", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"))
        kept = hot.join(keyed.select("rep", "keys"), "rep").join(sets, "rep")
        each = cut(many.join(kept, "rep").groupBy("key", "lo", "hi").applyInArrow(_blocks(threshold, count), "rep long, n long, root long"))
        found = found.union(each.filter("rep IS NOT NULL"))
        for r in each.filter("rep IS NULL").groupBy("root").agg(F.sum("n").alias("n")).collect():
            alike[r["root"]] = alike.get(r["root"], 0) + r["n"]
    found = cut(found)
    discard(members, sets)
    return found, alike


def joined(documents: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, count: bool = True) -> DataFrame:
    """(doc_id, class_id, copy_id, n_copies, n_links), a row per row of documents.

    class_id is the smallest doc_id of its component of links; copy_id that of the documents with the same shingle set, of
    which there are n_copies; n_links counts the different sets that are linked to this one, where `count` is set."""
    every = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    documents, _ = united(every)
    signed = stored(signatures(documents.unionByName(every.filter("doc_id IS NULL OR text IS NULL")), n))
    classes = signed.filter("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("class")
    classes = stored(classes.agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), *[F.any_value(c).alias(c) for c in ("size", "upper", "lower")]))
    level = DEPTH
    while True:
        found, alike = links(documents, classes, level, threshold, n, count)
        shorter = shortened(level, alike, threshold)
        if shorter == level:
            break
        level = shorter
    root = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    number = found.groupBy("rep").agg(F.sum("n").alias("n_links"))
    named = classes.select("class", "rep", "n_copies").join(number, "rep", "left").join(root.withColumnRenamed("node", "rep"), "rep", "left")
    both = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class")).join(named, "class", "left")
    return both.select(
        "doc_id", F.coalesce("root", "rep", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """documents without those of a class whose smallest doc_id is another's; rows without an id stay."""
    gone = joined(documents, count=False).filter("doc_id <> class_id").select("doc_id").distinct()
    return documents.join(small(cut(gone), COPIES), "doc_id", "left_anti")


def digest(documents: DataFrame) -> DataFrame:
    """The rows of query op6_ngram_jaccard_join."""
    return joined(documents)


#: DuckDB SQL for digest(): exact similarities over shared shingles, components by reachability. Documents of one table are few
#: enough for it where the check runs; it holds what the forest finds against all there is to find.
DIGEST_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
sets AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS s, count(*) AS n FROM g GROUP BY doc_id),
classes AS (SELECT s, min(doc_id) AS rep, count(*) AS n_copies, any_value(n) AS n FROM sets GROUP BY s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id WHERE a.doc_id IN (SELECT rep FROM classes) AND b.doc_id IN (SELECT rep FROM classes) GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT w.doc_id, coalesce(r.root, w.doc_id) AS class_id, coalesce(c.rep, w.doc_id) AS copy_id, CAST(coalesce(c.n_copies, 1) AS BIGINT) AS n_copies, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN sets s ON s.doc_id = w.doc_id LEFT JOIN classes c ON c.s = s.s LEFT JOIN roots r ON r.a = c.rep LEFT JOIN counts k ON k.a = c.rep
"""
