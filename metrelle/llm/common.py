"""Helpers that the operators of this subpackage share.

Words, wherever an operator speaks of them, are the matches of
`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased: ASCII letters, digits and everything beyond ASCII.
In UTF-8 a byte of 0x80 or more always belongs to such a character, so words can be found on bytes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_REGEX = r"[0-9A-Za-z\u0080-\x{10FFFF}]+"
#: Bytes of text that one numpy pass takes; a longer text is a pass of its own.
SLICE_BYTES = 1 << 20
#: Rows that may be broadcast after they were counted; beyond, the same join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Copies, two numbers each, whose list may be broadcast.
COPIES = 2_000_000

_BYTE = np.arange(256, dtype=np.uint8)
IS_WORD = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit constants, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt * 1_000_003)) | np.uint64(1)


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = mix(LOWER.astype(np.uint64) + np.uint64(77))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 0..n-1 and their inverses modulo 2**64; kept and grown as needed."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, whatever stands around it; values are 64-bit themselves."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes, or of one row; and of at most so many rows, if a number is given."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1), n, lo + (rows or n))
        yield lo, hi
        lo = hi


def text_slices(column: pa.Array, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for bounded parts of a string column."""
    data, offsets = utf8(column)
    for lo, hi in slices(offsets, rows=rows):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word, with the total at the end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = IS_WORD[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    return starts, np.flatnonzero(word & ~after) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_spans() and a 64-bit hash of every word, without regard to the case of A-Z."""
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(_LETTER[data], starts, ends), starts, ends, first


def grams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a row, the index of each one's first word, and each row's first run.

    A row of fewer words, but not none, has one run: all of its words."""
    size = np.diff(first)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    runs = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(runs[-1]) - np.repeat(runs[:-1] - first[:-1], count)
    return span_hashes(words, at, np.minimum(at + n, np.repeat(first[1:], count))), at, runs


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of an Arrow batch, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir or the context names; a new one only where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="metrelle-"))  # one process: its folder is shared
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
        _dropped_at_exit(spark, now.get())  # Spark's own folder below, of this application alone
    return named or now.get()


def _dropped_at_exit(spark: SparkSession, path: str) -> None:
    """Has the store delete path when the driver ends, as what lies there serves this application only."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of df in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: as cut(), packed by columns, for large frames.

    The files go by discard(), or when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _dropped_at_exit(df.sparkSession, path)
    read = df.sparkSession.read.parquet(path)
    read.stored_path = path
    return read


def discard(*frames: DataFrame) -> None:
    """Deletes what stored() wrote for these frames, once nothing that is still to be read rests on them."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_small(df: DataFrame, most: int | None = None) -> bool:
    """Whether df may be broadcast: its rows and their bytes are counted and few; for frames that are cheap to read again."""
    most = BROADCAST_ROWS if most is None else most
    held = [F.octet_length(c) if k == "string" else F.octet_length(F.to_json(F.struct(F.col(c)))) if k.startswith(("array", "struct", "map")) else F.lit(16) for c, k in df.dtypes]
    rows, size = df.agg(F.count("*"), F.sum(sum((F.coalesce(h, F.lit(0)) for h in held), F.lit(0)))).first()  # a limit would gather rows in one task
    return rows <= most and (size or 0) <= BROADCAST_BYTES


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, with a broadcast hint if is_small() finds that it is."""
    return F.broadcast(df) if is_small(df, most) else df


def united(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) with one text for an id: different texts of one are joined by line feeds, in order; and the stored hashes of
    the texts, (doc_id, h1, h2). Rows without an id or a text are left out; rows that repeat stay as many."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    hashed = lambda df: df.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    known = stored(hashed(rows))
    twice = cut(known.groupBy("doc_id").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("doc_id"))
    if not twice.isEmpty():
        joined = rows.join(small(twice), "doc_id", "left_semi").distinct().groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("text"))
        rows = rows.join(small(twice), "doc_id", "left_anti").unionByName(stored(joined))
        known = stored(hashed(rows))
    return rows, known


def one_text(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) of one document of each class of equal texts, its smallest doc_id; and (doc_id, other_id, text) of its copies."""
    rows, known = united(documents)
    first = cut(known.groupBy("h1", "h2").agg(F.min("doc_id").alias("other_id"), F.count("*").alias("n")).filter("n > 1"))
    copies = stored(known.join(small(first), ["h1", "h2"]).filter("doc_id <> other_id").select("doc_id", "other_id"))
    copies = small(copies, COPIES)
    return rows.join(copies, "doc_id", "left_anti"), rows.join(copies, "doc_id").select("doc_id", "other_id", "text")


def ascii_lower(word: Column) -> Column:
    """A-Z lower-cased, and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, upper, upper.lower()))


def words(text: Column) -> Column:
    """The words of a text in order, as an array; none if it is null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_REGEX), F.lit(0))
    return F.transform(found, ascii_lower)
