"""Importance resampling towards a target distribution, over hashed runs of words.

Documents are collapsed by grouping their full text, with counts taken before the shuffle, so a text is read for its features
once, however often it is repeated. Features are all runs of 1 to `runs` consecutive words, joined by one space; each falls
into the bucket that its crc32 names. A text's buckets and their counts are stored; the corpus totals are those times the
text's multiplicity, summed in each task before anything meets. A bucket's gain is the log ratio of smoothed shares in the
target and in the corpus; a text's weight is the floored mean of its features' gains, made once a text and joined back to
its documents by two 64-bit hashes of the text. Only then comes the noise of each document, Gumbel noise from a hash of its
id, so that the highest scores are a draw without replacement in proportion to exp(weight / 1000).

Ranks need no global sort: scores are integers between bounds that the logarithms set (some 60,000 values), so rows are
counted by score, the running totals give the score at which the draw ends, and only the drawn rows are numbered, score by
score. What goes through the driver is one number a bucket and one a score.

Defined results: a null or wordless text has no features and weight 0; a null doc_id gets no noise, so its score and rank are
null and it isn't among the eligible; texts of any length are read whole; rows that repeat each count, each give a row, and
take ranks next to each other; equal scores go by doc_id; an empty corpus gives no rows, an empty target gains by the corpus
alone; other columns, whatever their names, are ignored, and `resampled` passes them on.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrelle.llm.common import LOWER, cut, small, small_batches, stored, text_slices, word_spans

#: Longest run of words, buckets, least words of a document that may be drawn, share drawn, salt of the noise.
RUNS, BUCKETS, LEAST_WORDS, PERCENT, SALT = 1, 10_000, 20, 10, "2024"
#: Bytes of a feature up to which all features are hashed together, byte by byte.
SHORT = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of data[start:end] for each span."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    order = order[size[order] <= SHORT]
    begin, width = starts[order], size[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(width[0]) if len(width) else 0):
        n = int(np.searchsorted(-width, -k, "left"))  # spans longer than k come first
        state[:n] = _TABLE[(state[:n] ^ data[begin[:n] + k]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    found = np.zeros(len(size), np.uint32)
    found[order] = ~state
    for i in np.flatnonzero(size > SHORT):
        found[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return found


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after another, each with one space behind it, and their starts."""
    size = ends - starts
    begin = np.cumsum(size + 1) - size - 1
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    out[np.repeat(begin, size) + within] = data[np.repeat(starts, size) + within]
    return out, begin


def _features(column: pa.Array, runs: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For bounded parts of a string column: the words of each row, and the row and the bucket of every feature."""
    for _, _, data, offsets in text_slices(column):
        starts, ends, first = word_spans(data, offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        text, size = LOWER[data], ends - starts
        if runs > 1:
            text, starts = _joined(text, starts, ends)
        rows, found = [], []
        for n in range(1, runs + 1):
            at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if n <= len(row) else np.zeros(0, np.int64)
            rows.append(row[at])
            found.append(crc32_spans(text, starts[at], starts[at + n - 1] + size[at + n - 1]) % np.uint32(buckets))
        yield np.diff(first), np.concatenate(rows), np.concatenate(found).astype(np.int64)


def text_features(documents: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(h1, h2, copies, n_words, n_features, buckets, counts): one row for each distinct text, stored."""
    small_batches(documents.sparkSession)
    texts = documents.select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, sizes, held, counts = [], [], [], [], []
            for words, row, bucket in _features(batch.column(3), runs, buckets):
                each, n = np.unique(row * buckets + bucket, return_counts=True)
                n_words.append(words)
                n_features.append(np.bincount(row, minlength=len(words)))
                sizes.append(np.bincount(each // buckets, minlength=len(words)))
                held.append(each % buckets)
                counts.append(n)
            joined = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
            offsets = pa.array(np.concatenate([[0], np.cumsum(joined(sizes))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(joined(x).astype(np.int32))) for x in (held, counts)]
            numbers = [pa.array(joined(x).astype(np.int64)) for x in (n_words, n_features)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *numbers, *lists], ["h1", "h2", "copies", "n_words", "n_features", "buckets", "counts"])

    keyed = texts.select(*_text_key(F.col("text")), "copies", "text")
    return stored(keyed.mapInArrow(run, "h1 long, h2 long, copies long, n_words long, n_features long, buckets array<int>, counts array<int>"))


def _text_key(text: Column) -> list[Column]:
    held = F.coalesce(text, F.lit(""))
    return [F.xxhash64(held).alias("h1"), F.xxhash64(F.lit(7), held).alias("h2")]


def totals(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The features in each bucket, repeated texts counted as often as they stand in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            held = batch.column(1)
            times = np.repeat(batch.column(0).to_numpy(), np.diff(held.offsets.to_numpy()))
            np.add.at(sums, held.flatten().to_numpy(), times * batch.column(2).flatten().to_numpy())
        here = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(sums[here])], ["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    for bucket, n in features.select("copies", "buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        found[bucket] = n  # a row for each of `buckets` at most
    return found


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored, for each bucket."""
    size = len(corpus)
    s, t = float(corpus.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def text_weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(h1, h2, n_words, n_features, weight) of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, held = batch.column(3).to_numpy(), batch.column(4)
            run = np.concatenate([[0], np.cumsum(gain[held.flatten().to_numpy()] * batch.column(5).flatten().to_numpy())])
            ends = held.offsets.to_numpy() - held.offsets[0].as_py()
            weight = (run[ends[1:]] - run[ends[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weight)], ["h1", "h2", "n_words", "n_features", "weight"])

    held = features.select("h1", "h2", "n_words", "n_features", "buckets", "counts")
    return held.mapInArrow(run, "h1 long, h2 long, n_words long, n_features long, weight long")


def noise(doc_id: Column, salt: str = SALT) -> Column:
    """Thousandths of Gumbel noise from a hash of the id, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resampling(documents: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, salt: str = SALT) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): one row per row of documents; rank is null where it isn't drawn."""
    features = text_features(documents, runs, buckets)
    gain = gains(totals(features, buckets), totals(text_features(target, runs, buckets), buckets))
    keyed = documents.select("doc_id", *_text_key(F.col("text")))
    scored = keyed.join(text_weights(features, gain), ["h1", "h2"])
    scored = stored(scored.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), salt)).alias("score")))

    eligible = (F.col("n_words") >= least) & F.col("score").isNotNull()
    by_score = cut(scored.filter(eligible).groupBy("score").agg(F.count("*").alias("n")))  # scores lie within bounds
    size = (by_score.agg(F.sum("n")).first()[0] or 0) * percent // 100
    above = by_score.select("score", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("above"))
    above = cut(above.filter(F.col("above") < size))
    lowest = above.agg(F.min("score")).first()[0]
    inside = eligible & (F.col("score") >= lowest) if lowest is not None else F.lit(False)
    place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    drawn = scored.filter(inside).join(small(above), "score").withColumn("rank", F.col("above") + place).withColumn("rank", F.when(F.col("rank") <= size, F.col("rank")))
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = scored.filter(~F.coalesce(inside, F.lit(False))).select(*columns, F.lit(None).cast("long").alias("rank"))
    return drawn.select(*columns, "rank").unionByName(rest)


def resampled(documents: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The documents that are drawn, with all of their columns."""
    drawn = resampling(documents, target, **settings).filter("rank IS NOT NULL").select("doc_id").distinct()
    return documents.join(drawn, "doc_id", "left_semi")


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of query op11_resampling."""
    return resampling(documents, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB SQL for digest(): crc32 is computed byte by byte for every distinct word.
DIGEST_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 'b', NULL, 0, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark),
tokens AS (SELECT side, r, unnest(w) AS w FROM words),
tab AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v
        FROM (SELECT unnest(range(256)) AS i))),
buckets AS (
  SELECT w, xor(list_reduce(list_transform(range(1, strlen(w) * 2, 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)),
                            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT w, hex(w) AS h, t FROM (SELECT DISTINCT w FROM tokens) CROSS JOIN tab)),
f AS (SELECT side, r, bucket, count(*) AS n FROM tokens JOIN buckets USING (w) GROUP BY ALL),
s AS (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM f GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce(sum(t) OVER (), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s),
per AS (SELECT r, sum(n) AS n, sum(n * gain) AS total FROM f JOIN g USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
         CAST(CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS BIGINT) AS weight, sha256('2024:' || doc_id) AS h
  FROM words LEFT JOIN per USING (r) WHERE words.side = 'd'),
noisy AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(h, 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT *, n_features >= 20 AND score IS NOT NULL AS able, row_number() OVER (PARTITION BY n_features >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id) AS k FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= 10 * (SELECT count(*) FROM ranked WHERE able) // 100 THEN k END AS rank
FROM ranked
"""
