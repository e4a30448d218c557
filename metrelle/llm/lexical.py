"""Ranked lexical search over a two-level quantised index.

The index is partitioned by documents: each row is a shard of whole documents with the inverted lists of its terms, so text is
read where it lies and no posting is ever shuffled. Level one holds, for every posting, an impact in one byte: the term's share
of the document's score, rounded up to 255ths of its limit. Level two holds what exact scoring needs, the term's occurrences
and the document's size. A search reads level one twice. First every document's lower bound follows from its bytes, one step
down; each task keeps the k largest of an item, and the k-th largest of all is what a document must be able to reach. Then
every document whose upper bound reaches that is scored in integers from level two, in the same task that has its bounds, and
each task hands on its k best. Nothing that could be among the k best is ever left out, and what tasks hand on is k rows an
item, however common a term is.

Items are searched in blocks of at most ITEMS of them and some ENTRIES terms, which go to the tasks as arrays; the number of
blocks follows the number of items. Terms are told apart by 64-bit hashes.

Terms are words as in `common`. N counts the documents with a term, L all their terms, n a document's terms, df the documents
that hold a term, tf its occurrences in one, all with repeats except N and df. The formula is that of `weight` and `shares`.

Defined results: a null or wordless text is no document and has no rank; an item whose text is null, wordless or of unknown
terms gives no rows, and so does one without an id; rows of one item_id are one item with the terms of its different texts;
rows of `documents` that repeat, or share a doc_id, are documents of their own; equal scores go by doc_id, null ids last;
texts of any length are read whole; empty tables give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metrelle.llm.common import slices, small_batches, stored, utf8, word_hashes, word_spans

K = 20
#: A posting's share is below SHARE; length counts for LENGTH of 100, in units of 12 / 1000 of an occurrence.
SHARE, LENGTH, UNIT = 1_000_000, 25, 12
#: Bytes of text in a shard (or one document); items and about as many entries (item, term) in a block; postings at once.
SHARD_BYTES, ITEMS, ENTRIES, AT_ONCE = 4 << 20, 500, 50_000, 1_000_000
#: What a byte of impact says at most and at least.
UPPER = np.arange(256, dtype=np.int64) * SHARE // 255
LOWER_BOUND = np.concatenate([[0], UPPER[:-1] + 1])

INDEX = "ids array<bigint>, sizes binary, terms binary, ends binary, docs binary, impacts binary, counts binary"


class Index(NamedTuple):
    """shards: a row for each, of columns INDEX; documents: N; terms: L."""

    shards: DataFrame
    documents: int
    terms: int


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest takes."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def lengths(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a document's size makes of an occurrence, m."""
    return 100 - LENGTH + LENGTH * sizes * n // max(total, 1)


def shares(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A posting's part of the score, to be multiplied by the term's weight."""
    return 1000 * SHARE * tf // (1000 * tf + UNIT * m)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _counted(documents: DataFrame) -> tuple[int, int]:
    """The documents with a term and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = total = 0
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in slices(offsets, SHARD_BYTES):
                n = np.diff(word_spans(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[2])
                held, total = held + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([total])], ["held", "total"])

    found = documents.select("text").mapInArrow(run, "held long, total long").agg(F.sum("held"), F.sum("total")).first()
    return found[0] or 0, found[1] or 0


def _inverted(hashes: np.ndarray, first: np.ndarray, n: int, total: int) -> list:
    """A shard's columns but the ids, for documents of which each has a term."""
    sizes = np.diff(first)
    terms, term = np.unique(hashes.view(np.int64), return_inverse=True)
    posting, tf = np.unique(term * len(sizes) + np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
    docs = posting % len(sizes)
    impact = -(-shares(tf, lengths(sizes, n, total)[docs]) * 255 // SHARE)
    ends = np.searchsorted(posting, (np.arange(len(terms)) + 1) * len(sizes))
    return [_narrow(sizes), terms.tobytes(), _narrow(ends), _narrow(docs), impact.astype(np.uint8).tobytes(), _narrow(tf)]


def index(documents: DataFrame) -> Index:
    """The index of all documents, stored."""
    small_batches(documents.sparkSession)
    n, total = _counted(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (data, offsets), rows = batch.column(0), utf8(batch.column(1)), []
            for lo, hi in slices(offsets, SHARD_BYTES):
                hashes, _, _, first = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                held = np.flatnonzero(np.diff(first))
                if len(held):
                    rows.append([ids.take(pa.array(held + lo)).to_pylist(), *_inverted(hashes, np.append(first[held], first[-1]), n, total)])
            kinds = [pa.list_(pa.int64()), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [c.split()[0] for c in INDEX.split(", ")])

    return Index(stored(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX)), n, total)


class Block(NamedTuple):
    """Some items: their ids, and for each entry the item's place, the term's place in the sorted vocabulary, and the times."""

    ids: list[int]
    vocabulary: np.ndarray
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray


def _items(items: DataFrame) -> DataFrame:
    """(item_id, terms, times): a row for each item with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            hashes, _, _, first = word_hashes(data, offsets)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(hashes.view(np.int64))], ["item_id", "term"])

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    terms = texts.mapInArrow(run, "item_id long, term long").groupBy("item_id", "term").agg(F.count("*").alias("times"))
    return terms.groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("times").alias("times"))


def _blocks(items: DataFrame) -> Iterator[Block]:
    held = stored(_items(items))
    n, entries = held.agg(F.count("*"), F.sum(F.size("terms"))).first()
    parts = max(1, -(-n // ITEMS), -(-(entries or 0) // ENTRIES))
    for k in range(parts):
        rows = sorted(held.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect())
        if rows:
            terms = np.array([t for r in rows for t in r["terms"]], np.int64)
            vocabulary, term = np.unique(terms, return_inverse=True)
            item = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows])
            yield Block([r["item_id"] for r in rows], vocabulary, item, term, np.array([t for r in rows for t in r["times"]], np.int64))


def _frequencies(shards: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """The documents that hold each term of a sorted vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, ends in zip(*batch.columns):
                begin, end = _found(terms.as_py(), ends.as_py(), vocabulary)
                df += end - begin
        here = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(df[here])], ["term", "df"])

    df = np.zeros(len(vocabulary), np.int64)
    for term, n in shards.select("terms", "ends").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n  # a row for each term of a block at most
    return df


def _found(terms: bytes, ends: bytes, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the postings of each term of the vocabulary begin and end in a shard."""
    held = np.frombuffer(terms, np.int64)
    end = np.concatenate([[0], _wide(ends, len(held))])
    at = np.minimum(np.searchsorted(held, vocabulary), len(held) - 1)
    here = held[at] == vocabulary
    return np.where(here, end[at], 0), np.where(here, end[at + 1], 0)


def _postings(block: Block, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entry, posting) for all entries of a block, some at once."""
    size = (end - begin)[block.term]
    runs = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(runs, runs[lo] + AT_ONCE, "right")) - 1)
        entry = np.repeat(np.arange(lo, hi), size[lo:hi])
        yield entry, np.arange(runs[lo], runs[hi]) - runs[entry] + begin[block.term[entry]]
        lo = hi


def _bounds(block: Block, worth: np.ndarray, row: dict, values: np.ndarray) -> np.ndarray:
    """For each item and document of a shard the sum of what its impacts say by `values`."""
    n = len(row["ids"])
    begin, end = _found(row["terms"], row["ends"], block.vocabulary)
    impacts = np.frombuffer(row["impacts"], np.uint8)
    docs, sums = _wide(row["docs"], len(impacts)), np.zeros(len(block.ids) * n, np.int64)
    for entry, posting in _postings(block, begin, end):
        np.add.at(sums, block.item[entry] * n + docs[posting], worth[entry] * values[impacts[posting]])
    return sums.reshape(len(block.ids), n)


def _least(shards: DataFrame, block: Block, worth: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest lower bound of each item, or 1 where fewer documents have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(block.ids), k), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                both = np.concatenate([best, _bounds(block, worth, row, LOWER_BOUND)], 1)
                best = np.partition(both, both.shape[1] - k, 1)[:, -k:]
        item, at = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(best[item, at])], ["item", "least"])

    found = shards.select("ids", "terms", "ends", "docs", "impacts").mapInArrow(run, "item long, least long")
    found = _first(found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))), ["item", "part"], [F.desc("least")], k)
    found = _first(found, ["item"], [F.desc("least")], k).filter(F.col("place") == k)
    least = np.ones(len(block.ids), np.int64)
    for item, value in found.select("item", "least").collect():
        least[item] = value
    return least


def _first(rows: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= k)


def _scored(index: Index, block: Block, worth: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """(item_id, doc_id, score, tried): each task's k best of each item; tried: the documents that this task scored for it."""
    n, total = index.documents, index.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {c: np.zeros(0, np.int64) for c in ("item", "score", "missing", "id")}
        tried = np.zeros(len(block.ids), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                able = _bounds(block, worth, row, UPPER) >= least[:, None]
                tried += able.sum(1)
                if not able.any():
                    continue
                size = len(row["ids"])
                begin, end = _found(row["terms"], row["ends"], block.vocabulary)
                docs = _wide(row["docs"], len(row["impacts"]))
                tf, m = _wide(row["counts"], len(docs)), lengths(_wide(row["sizes"], size), n, total)
                sums = np.zeros(able.size, np.int64)
                for entry, posting in _postings(block, begin, end):
                    keep = able[block.item[entry], docs[posting]]
                    entry, posting = entry[keep], posting[keep]
                    doc = docs[posting]
                    np.add.at(sums, block.item[entry] * size + doc, worth[entry] * shares(tf[posting], m[doc]))
                at = np.flatnonzero(sums)
                ids = row["ids"]
                new = {"item": at // size, "score": sums[at], "missing": np.array([ids[i] is None for i in at % size], np.int64), "id": np.array([ids[i] or 0 for i in at % size], np.int64)}
                best = {c: np.concatenate([best[c], new[c]]) for c in best}
                order = np.lexsort((best["id"], best["missing"], -best["score"], best["item"]))
                item = best["item"][order]
                order = order[np.arange(len(item)) - np.searchsorted(item, item) < k]
                best = {c: best[c][order] for c in best}
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(block.ids, np.int64)[best["item"]]), pa.array(best["id"], mask=best["missing"] > 0), pa.array(best["score"]), pa.array(tried[best["item"]])],
            ["item_id", "doc_id", "score", "tried"],
        )

    columns = index.shards.select("ids", "sizes", "terms", "ends", "docs", "impacts", "counts")
    return columns.mapInArrow(run, "item_id long, doc_id long, score long, tried long")


def search(index: Index, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score, tried): the k best documents of each item whose score is above 0."""
    small_batches(items.sparkSession)
    found = items.sparkSession.createDataFrame([], "item_id long, doc_id long, score long, tried long")
    for block in _blocks(items):
        df = _frequencies(index.shards, block.vocabulary)
        worth = np.array([weight(index.documents, int(n)) for n in df], np.int64)[block.term] * block.times
        found = found.unionByName(_scored(index, block, worth, _least(index.shards, block, worth, k), k))
    ranked = _first(found, ["item_id"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)
    return ranked.select("item_id", F.col("place").alias("rank"), "doc_id", "score", "tried")


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of query op13_lexical_search."""
    return search(index(documents), benchmark).select("item_id", "rank", "doc_id", "score")


#: DuckDB SQL for digest().
DIGEST_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
held AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM held),
postings AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
texts AS (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL),
entries AS (
  SELECT item_id, t, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM texts)
  GROUP BY item_id, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings CROSS JOIN totals GROUP BY t),
scores AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM entries JOIN weights USING (t) JOIN postings USING (t) JOIN held USING (r) CROSS JOIN totals GROUP BY item_id, r)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20
"""
