"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing with exact reranking.

Vectors are scaled to length 1. Each of TABLES tables projects them on Gaussian directions and floors the projections to
slots of WIDTH; the slots of a table name a bucket. The number of directions grows with the logarithm of the number of
vectors, so that buckets keep their size. A query visits buckets in falling order of the chance that a neighbour at the
expected cosine lies there against the chance that any row does, down to the bucket at which the visited chances reach
TABLE_SUCCESS; that bound is the same whatever buckets exist, so it needs no list of them. The expected cosine is the lower
quartile of what a bounded sample of queries has as its k-th neighbour, found exactly. Every visited bucket is compared with
the query, and the best of all tables are ranked in double precision. So the index holds every row, and only the order and
number of probes rest on the sample; the plan is the same at every size.

A bucket of more than BLOCK rows is split, with its queries in every part; parts are dealt out to shares by hash, a query goes to
a share once, with all the buckets that it visits there, and only the best of a query leave a task. A share whose queries are
more than QUERIES meets them block by block, so vectors are copied for blocks only where there are that many queries. A query
whose buckets hold fewer than k candidates goes on through all of the rest: such queries, in blocks, are compared with every
entry. Rows with the same vector are one entry that names their k + 1 smallest ids, which is all that any query can need.

Defined results: vectors that are null, all zero or hold null or non-finite parts take no part, nor do null ids; only
vectors of one length are compared; rows with the query's own id are no candidates; repeated rows are one; an id with several
vectors is ranked once, by its nearest, and a query with several takes the best of each; scores are computed in extended
precision and rounded to doubles, so that vectors of one direction tie; ties go to the smaller id; a query with fewer than k
candidates gives all of them, and one without any no row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrelle.llm.common import cut, mix, small, small_batches, stored

TABLES, WIDTH = 5, 1.5
TABLE_SUCCESS = 0.38
#: Rows that a bucket holds about, bits that one direction tells, and directions at least.
BUCKET_ROWS, DIRECTION_BITS, LEAST_DIRECTIONS = 24, 1.9, 2
#: Rows of a bucket's part; entries of all tables in a share; queries that are held against a share together; pairs that are held
#: before the best are kept, in all and for each of the k that a query wants; buckets whose parts are told to all tasks, to which the
#: size of a part is fitted.
BLOCK, SHARE, QUERIES, PAIRS, HELD, SPLIT = 2048, 8192, 65_536, 2_000_000, 16, 1_000_000
SAMPLE_QUERIES, DRAWS = 32, 1000
#: Queries that are compared with every entry at once; what a rough score may be off.
REST, MARGIN = 2048, 1e-9


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors that take part, each once for an id."""
    rows = vectors.select("vec_id", F.col("embedding").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)).distinct()


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): each distinct vector once, with the k + 1 smallest ids that have it."""
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    return first.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))


def n_directions(rows: int) -> int:
    return max(LEAST_DIRECTIONS, int(math.log2(max(1, rows / BUCKET_ROWS)) / DIRECTION_BITS))


def directions(dim: int, functions: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dim, functions, table])
    return rng.normal(size=(dim, functions)), rng.uniform(0, WIDTH, functions)


def _matrix(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, unit matrix) for each vector length of a list column."""
    offsets = column.offsets.to_numpy()
    flat, size = column.values.to_numpy(zero_copy_only=False).astype(np.float64), np.diff(offsets)
    out = []
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        m = flat[offsets[rows][:, None] + np.arange(dim)]
        out.append((int(dim), rows, _unit(m)))
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    """The rows of a matrix scaled to length 1."""
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _bucket(dim: int, table: int, slots: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's slots."""
    name = np.full(len(slots), dim * 1009 + table, np.uint64)
    for j in range(slots.shape[1]):
        name = mix(name + slots[:, j].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return name.view(np.int64)


def _below(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x])


def probes(projected: np.ndarray, shift: np.ndarray, cosine: float, success: float, rng: np.random.Generator) -> np.ndarray:
    """The slots of the buckets to visit, in falling order of the chance of a neighbour at that cosine against any row's.

    The bound is the value above which a share `success` of drawn neighbours lies; all buckets above it are made, slot by
    slot, leaving a branch as soon as the best rest can't reach the bound."""
    mean, spread = cosine * projected, math.sqrt(1 - cosine * cosine)
    drawn = np.zeros(DRAWS)
    told = []
    for mu, b in zip(mean, shift):
        low = math.floor((mu + b - 4.5 * spread) / WIDTH)
        edges = np.arange(low, math.floor((mu + b + 4.5 * spread) / WIDTH) + 2) * WIDTH - b
        near, any_row = np.diff(_below((edges - mu) / spread)), np.diff(_below(edges))
        gain = np.log(np.maximum(near, 1e-12)) - np.log(np.maximum(any_row, 1e-12))
        gain[near < 1e-7] = -np.inf
        slot = np.floor((mu + b + spread * rng.normal(size=DRAWS)) / WIDTH).astype(np.int64) - low
        drawn += np.where((slot >= 0) & (slot < len(gain)), gain[np.clip(slot, 0, len(gain) - 1)], -np.inf)
        told.append((low, gain))
    bound = np.sort(drawn)[int((1 - success) * DRAWS)] - 1e-12
    rest = np.append(np.cumsum([g.max() for _, g in told][::-1])[::-1][1:], 0.0)
    total, slots = np.zeros(1), np.zeros((1, 0), np.int64)
    for (low, gain), after in zip(told, rest):
        both = total[:, None] + gain[None, :]
        i, j = np.nonzero(both + after >= bound)
        total, slots = both[i, j], np.column_stack([slots[i], low + j])
    return slots[np.argsort(-total, kind="stable")]


def expected_cosine(items: DataFrame, queries: DataFrame, k: int) -> float:
    """The lower quartile, over a bounded sample of queries, of the exact cosine to the k-th neighbour."""
    sample = [(r["query_id"], np.array(r["v"])) for r in queries.orderBy(F.xxhash64("query_id")).limit(SAMPLE_QUERIES).collect()]
    if not sample:
        return 0.5
    shared = items.sparkSession.sparkContext.broadcast(sample)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {i: np.zeros(0) for i in range(len(shared.value))}
        for batch in batches:
            for dim, _, unit in _matrix(batch.column(0)):
                for i, (_, q) in enumerate(shared.value):
                    if len(q) == dim:
                        c = unit @ _unit(q[None])[0]
                        found[i] = np.sort(np.concatenate([found[i], c]))[-k - 1 :]
        rows = [(i, float(c)) for i, cs in found.items() for c in cs]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.float64())], ["i", "c"])

    top = items.select("v").mapInArrow(best, "i int, c double")
    ranked = top.withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("c")))).filter(F.col("n") == k + 1)
    got = [r["c"] for r in ranked.select("c").collect()]  # one per sampled query
    return float(np.clip(np.quantile(got, 0.25) if got else 0.5, 0.05, 0.98))


def _best(q: np.ndarray, e: np.ndarray, score: np.ndarray, own: np.ndarray, ids: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, ...]:
    """(q, e, id, score) of the pairs whose score reaches that of the k-th id of their query, or nearly; each id once."""
    offsets, flat = ids
    n = np.diff(offsets)[e]
    at = np.repeat(offsets[e] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(e) else np.zeros(0, np.int64)
    q, e, score, named = np.repeat(q, n), np.repeat(e, n), np.repeat(score, n), flat[at]
    other = named != own[q]
    q, e, score, named = q[other], e[other], score[other], named[other]
    order = np.lexsort((-score, named, q))
    q, e, score, named = q[order], e[order], score[order], named[order]
    new = np.concatenate([np.ones(min(1, len(q)), bool), (q[1:] != q[:-1]) | (named[1:] != named[:-1])])
    q, e, score, named = q[new], e[new], score[new], named[new]
    order = np.lexsort((-score, q))
    q, e, score, named = q[order], e[order], score[order], named[order]
    start = np.searchsorted(q, q, "left")
    last = np.minimum(start + k, np.searchsorted(q, q, "right")) - 1
    keep = score >= score[last] - MARGIN
    return q[keep], e[keep], named[keep], score[keep]


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosines of the rows of a and b, as doubles next to the true values."""
    a, b = a.astype(np.longdouble), b.astype(np.longdouble)
    return ((a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))).astype(np.float64)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of a list column; a null list is empty."""
    array = column.combine_chunks()
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    sizes = array.value_lengths().fill_null(0).to_numpy()
    return np.concatenate([[0], np.cumsum(sizes)]), array.flatten().to_numpy(zero_copy_only=False)


def _compared(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best entries of a share for each query that visits it."""
        at, flat = _lists(left.column("v"))
        ids = _lists(left.column("ids"))
        asked_at, asked_flat = _lists(right.column("v"))
        visit_at, visits = _lists(right.column("cells"))
        size, asked_size = np.diff(at), np.diff(asked_at)
        own = right.column("query_id").to_numpy()
        order = np.argsort(visits, kind="stable")
        who, where = np.repeat(np.arange(len(own)), np.diff(visit_at))[order], visits[order]
        rows_cell = left.column("cell").to_numpy()
        out = []
        for dim in np.unique(size):
            mine = np.flatnonzero(size == dim)
            mine = mine[np.argsort(rows_cell[mine], kind="stable")]
            rows = flat[at[mine][:, None] + np.arange(dim)].astype(np.float64)
            unit = _unit(rows)
            there = asked_size == dim
            asked = np.zeros((len(own), dim))
            asked[there] = asked_flat[asked_at[:-1][there][:, None] + np.arange(dim)]
            asked_unit = np.zeros((len(own), dim))
            asked_unit[there] = _unit(asked[there])
            cells, first = np.unique(rows_cell[mine], return_index=True)
            ends = np.append(first[1:], len(mine))
            lo, hi = np.searchsorted(where, cells, "left"), np.searchsorted(where, cells, "right")
            own_ids = (np.concatenate([[0], np.cumsum(np.diff(ids[0])[mine])]), np.concatenate([ids[1][ids[0][m] : ids[0][m + 1]] for m in mine]))
            found, held = [], 0
            bar = np.full(len(own), -np.inf)  # of each query, the score of its k-th id so far: only what reaches it is held
            for a, b, c, d in zip(first, ends, lo, hi):
                q = who[c:d]
                q = q[there[q]]
                if len(q):
                    score = asked_unit[q] @ unit[a:b].T
                    i, j = np.nonzero(score >= bar[q, None] - MARGIN)
                    found.append((q[i], a + j, score[i, j]))
                    held += len(i)
                if held > min(PAIRS, HELD * k * len(own)):
                    q, e, _, score = _best(*map(np.concatenate, zip(*found)), own, own_ids, k)
                    found, held = [(q, e, score)], 0
                    at_k = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == k - 1)
                    bar[q[at_k]] = score[at_k]
            if found:
                q, e, named, _ = _best(*map(np.concatenate, zip(*found)), own, own_ids, k)
                score = _cosine(rows[e], asked[q])
                out.append(pa.table({"query_id": pa.array(own[q], pa.int64()), "vec_id": pa.array(named, pa.int64()), "score": score}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    return run


def _part(bucket: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The name of a part of a split bucket."""
    return mix(bucket.view(np.uint64) + (part.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, nearest first."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors)
    queries, items = cut(rows.filter(is_query).select(F.col("vec_id").cast("long").alias("query_id"), "v")), cut(entries(rows, k))
    n, asks = items.count(), queries.count()
    functions, cosine = n_directions(n), expected_cosine(items, queries, k)
    shares, block = max(16, -(-n * TABLES // SHARE)), max(BLOCK, -(-n * TABLES // SPLIT))

    def buckets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for dim, at, unit in _matrix(column):
            for table in range(TABLES):
                a, b = directions(dim, functions, table)
                yield at, _bucket(dim, table, np.floor((unit @ a + b) / WIDTH))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, names in buckets(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(names)], ["bucket"])

    large = items.select("v").mapInArrow(named, "bucket long").groupBy("bucket").count().filter(F.col("count") > block)
    large = sorted((r["bucket"], -(-r["count"] // block)) for r in large.collect())  # SPLIT at most
    split = spark.sparkContext.broadcast(np.array(large, np.int64).reshape(-1, 2))

    def parts(names: np.ndarray) -> np.ndarray:
        """The number of parts of each bucket."""
        known = split.value
        if not len(known):
            return np.ones(len(names), np.int64)
        at = np.minimum(np.searchsorted(known[:, 0], names), len(known) - 1)
        return np.where(known[at, 0] == names, known[at, 1], 1)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, names in buckets(batch.column(0)):
                own = [batch.column(i).take(pa.array(at)) for i in (0, 1)]
                first = own[1].flatten().to_numpy()[own[1].offsets.to_numpy()[:-1] - own[1].offsets[0].as_py()]
                dealt = mix(first.view(np.uint64)) % parts(names).astype(np.uint64)
                cell = _part(names, dealt)
                yield pa.RecordBatch.from_arrays([pa.array((cell.view(np.uint64) % np.uint64(shares)).astype(np.int64)), pa.array(cell), *own], ["share", "cell", "v", "ids"])

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query and each share with buckets that it visits: these buckets."""
        for batch in batches:
            for dim, at, unit in _matrix(batch.column(1)):
                tables = [(table, *directions(dim, functions, table)) for table in range(TABLES)]
                for i, vector in zip(at.tolist(), unit):
                    names = np.concatenate([_bucket(dim, table, probes(vector @ a, b, cosine, TABLE_SUCCESS, np.random.default_rng(table))) for table, a, b in tables])
                    number = parts(names)
                    cell = _part(np.repeat(names, number), np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number))
                    share = (cell.view(np.uint64) % np.uint64(shares)).astype(np.int64)
                    order = np.argsort(share, kind="stable")
                    own, first = np.unique(share[order], return_index=True)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(cell[order]))
                    same = pa.array(np.full(len(own), i))
                    yield pa.RecordBatch.from_arrays([pa.array(own), lists, batch.column(0).take(same), batch.column(1).take(same)], ["share", "cells", "query_id", "v"])

    kind = rows.schema["v"].dataType.simpleString()
    left = items.mapInArrow(placed, f"share long, cell long, v {kind}, ids array<long>")
    right = queries.repartition(max(16, shares), "query_id").mapInArrow(visited, f"share long, cells array<long>, query_id long, v {kind}")
    if asks > QUERIES:
        right = stored(right)
        blocks = right.groupBy("share").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
        blocks = small(cut(blocks.filter("blocks > 1")))
        number = F.coalesce("blocks", F.lit(1))
        left = left.join(blocks, "share", "left").withColumn("block", F.explode(F.sequence(F.lit(0), number - 1))).drop("blocks")
        right = right.join(blocks, "share", "left").withColumn("block", F.pmod(F.xxhash64("query_id"), number).cast("int")).drop("blocks")
    else:
        left, right = left.withColumn("block", F.lit(0)), right.withColumn("block", F.lit(0))
    met = left.groupBy("share", "block").cogroup(right.groupBy("share", "block")).applyInArrow(_compared(k), FOUND)
    top = stored(_ranked(met, k))
    short = cut(queries.join(top.filter(F.col("rank") == k).select("query_id"), "query_id", "left_anti"))
    if short.isEmpty():
        return top
    return _ranked(top.select("query_id", "vec_id", "score").unionByName(_exhaustive(items, short, k)), k)


FOUND = "query_id long, vec_id long, score double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exhaustive(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of every entry, of each task, for queries that are few or many blocks of REST."""
    parts = max(1, -(-queries.count() // REST))

    def against(asked: list[tuple[int, np.ndarray]]):
        own = np.array([q for q, _ in asked], np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            for batch in batches:
                offsets, flat = _lists(pa.chunked_array([batch.column(0)]))
                named_at, named = _lists(pa.chunked_array([batch.column(1)]))
                for dim, at, unit in _matrix(batch.column(0)):
                    mine = np.array([i for i, (_, v) in enumerate(asked) if len(v) == dim], np.int64)
                    if not len(mine):
                        continue
                    mat = np.array([asked[i][1] for i in mine])
                    step = max(1, PAIRS // len(mine))
                    for lo in range(0, len(at), step):
                        rows = at[lo : lo + step]
                        rough = _unit(mat) @ unit[lo : lo + step].T
                        ids = (np.concatenate([[0], np.cumsum(np.diff(named_at)[rows])]), np.concatenate([named[named_at[r] : named_at[r + 1]] for r in rows]))
                        q, e, who, _ = _best(np.repeat(mine, len(rows)), np.tile(np.arange(len(rows)), len(mine)), rough.ravel(), own, ids, k)
                        values = flat[offsets[rows][:, None] + np.arange(dim)].astype(np.float64)
                        exact = _cosine(values[e], mat[np.searchsorted(mine, q)])
                        best = [np.concatenate(x) for x in zip(best, (own[q], who, exact))]
                        order = np.lexsort((-best[2], best[1], best[0]))
                        best = [x[order] for x in best]
                        new = np.concatenate([[True], (np.diff(best[0]) != 0) | (np.diff(best[1]) != 0)])[: len(order)]  # an id may come with several vectors
                        best = [x[new] for x in best]
                        order = np.lexsort((best[1], -best[2], best[0]))
                        best = [x[order] for x in best]
                        first = np.arange(len(order)) - np.searchsorted(best[0], best[0]) < k
                        best = [x[first] for x in best]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["query_id", "vec_id", "score"])

        return run

    out = None
    for part in range(parts):
        asked = [(r["query_id"], np.array(r["v"], np.float64)) for r in queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).collect()]
        found = items.select("v", "ids").mapInArrow(against(asked), FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def digest(vectors: DataFrame) -> DataFrame:
    """The rows of query op4_neighbours: queries are the rows whose id is divisible by 50."""
    return nearest(vectors, F.col("vec_id") % 50 == 0, 5)
