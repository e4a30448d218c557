"""Language identification by the nearest of several centroids per language.

A text is a normalised TF-IDF vector of hashed byte 1- to 3-grams of its words: ASCII
and Latin-1 letters are lower-cased, and what stands between words counts as one space. Spherical k-means groups each
language's training vectors into a few centroids, none of them of a few odd rows; a text gets the language of the centroid
with the largest cosine. It is rejected where that cosine is below the limit for its length: REJECT_SHARE of a low quantile of
the similarities that training rows of such a length have. Short texts are less like any centroid, so the limit grows with
the length, and texts of languages that weren't learnt, or of no language, fall below it.

Document frequencies, centroids and limits come from all training rows. Only where k-means begins is taken from a bounded sample:
the rows of each language whose hashed id falls below a threshold, set so that SAMPLE_ROWS rows are expected over all languages.
Where they are not all rows, ROUNDS rounds over all of them follow. The limits are quantiles of counts by score, in parts of
SCORES, of all training rows. Prediction reads every text whole.

Defined results: a null text or one without a letter is `und`, score 0, rejected; without any training row every text is
`und`; ties go to the language that sorts first; repeated rows each give a row; an empty table gives none; other columns
are ignored, and `drop_rejected` passes them on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrelle.llm.common import LOWER, small_batches, text_slices

DIMENSIONS = 8192
#: Rows whose vectors are held at once, 64 KB each and some copies of it: of short texts one pass over bytes would hold a thousand.
SLICE_ROWS = 64
SAMPLE_ROWS, ROUNDS = 2000, 2
CENTROIDS = 4
#: Bytes at which a text is of the next class of length; rows of a class that has a limit of its own, at least.
LENGTHS = (16, 32, 64, 128, 256, 1024)
LEAST_ROWS = 20
#: The parts of a cosine by which scores are counted, and what a vector's components are multiplied with, so that sums are exact.
SCORES, PARTS = 100_000, 2.0**32
#: A text is rejected below this share of that quantile of its class.
REJECT_SHARE, REJECT_QUANTILE = 0.7, 0.005
_CODES = np.uint32(0x9E3779B1)
#: Bytes that are part of a letter as they are; the others end a word and count as one space.
_FOLD = np.where(((LOWER >= 97) & (LOWER <= 122)) | (LOWER >= 128), LOWER, 32).astype(np.uint8)


@dataclass(frozen=True)
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # (centroids, DIMENSIONS), of length 1
    limits: np.ndarray  # the cosine below which a text is rejected, by class of length
    idf: np.ndarray


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed 1- to 3-gram counts of each row; a gram doesn't reach into the next row."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n, dtype=np.int64) * DIMENSIONS, np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes to the row's end
    low = _FOLD[data]
    low[1:] += 32 * ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)).astype(np.uint8)  # capital Latin-1 letters
    empty = low == 32
    low = low.astype(np.uint32)
    kept = np.ones(len(low), bool)
    out = np.zeros(n * DIMENSIONS, np.int64)
    code = low + np.uint32(1)
    for size in (1, 2, 3):
        if size > 1:
            code = code[:-1] * np.uint32(257) + low[size - 1 :] + np.uint32(1)
        if not len(code):
            break
        if size > 1:
            kept = kept[: len(code)] & ~(empty[size - 2 : -1] & empty[size - 1 :])  # no two spaces in a gram
        inside = (left[: len(code)] >= size) & (kept if size > 1 else ~empty)
        at = (code * _CODES) >> np.uint32(19)
        out += np.bincount((row[: len(code)] + at)[inside], minlength=n * DIMENSIONS)
    return out.reshape(n, DIMENSIONS)


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(size > 0, size, 1)


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows hold a letter: an ASCII one, or any other when the row is looked at again as text."""
    ascii_letter = np.concatenate([[0], np.cumsum((LOWER[data] >= 97) & (LOWER[data] <= 122))])
    found = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode()))
    return found


def training_rows(documents: DataFrame) -> Column:
    """Rows that may be learnt from: those outside of the held-out class, 2 of 4 by the checksum of the id."""
    return (F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()


def fit(documents: DataFrame, rows: Column, sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS) -> Model:
    """A model of the rows of (doc_id, text, lang) for which `rows` holds."""
    small_batches(documents.sparkSession)
    train = documents.filter(rows).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    none = Model([], np.zeros((0, DIMENSIONS)), np.zeros(len(LENGTHS) + 1), np.ones(DIMENSIONS))
    if not sizes:
        return none
    each = max(1, sample_rows // len(sizes))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, each / n))])
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = train.filter(place < F.element_at(share, F.col("lang")))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1), SLICE_ROWS):
                found = counts(data, offsets)
                at = [np.flatnonzero(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()), pa.array([x[a].astype(np.uint32).tobytes() for x, a in zip(found, at)], pa.binary())],
                    ["lang", "at", "n"],
                )

    got = sorted(tuple(r) for r in sample.select("lang", "text").mapInArrow(vectors, "lang string, at binary, n binary").collect())
    if not got:
        return none
    matrix = np.zeros((len(got), DIMENSIONS), np.float32)
    for i, (_, at, n) in enumerate(got):
        matrix[i, np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.uint32)
    whole = each >= max(sizes.values())
    n, df = (len(got), np.count_nonzero(matrix, axis=0)) if whole else (sum(sizes.values()), totals(train, 1, _present)[0])
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    np.log1p(matrix, out=matrix)
    matrix *= idf
    matrix /= np.maximum(np.sqrt(np.einsum("ij,ij->i", matrix, matrix)), 1e-9)[:, None]
    langs = np.array([lang for lang, _, _ in got])
    names, centres = [], []
    for lang in sorted(set(langs.tolist())):
        for centre in clusters(matrix[langs == lang], centroids):
            names.append(lang)
            centres.append(centre)
    if not names:
        return none
    model = Model(names, np.array(centres), np.zeros(len(LENGTHS) + 1), idf)
    for _ in range(0 if whole else ROUNDS):
        model = moved(train, model)
    return replace(model, limits=limits(train, model))


def totals(train: DataFrame, k: int, add: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """(k, DIMENSIONS): what add(total, languages, counts) adds up over all rows of (lang, text); tasks add, a shuffle adds up tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, DIMENSIONS), np.int64)
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lo, hi, data, offsets in text_slices(batch.column(1), SLICE_ROWS):
                add(total, langs[lo:hi], counts(data, offsets))
        for c in range(k):
            at = np.flatnonzero(total[c])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[c][at])], ["c", "at", "x"])

    found = train.select("lang", "text").mapInArrow(run, "c int, at int, x long").groupBy("c", "at").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros((k, DIMENSIONS), np.int64)
    out[found["c"].to_numpy(), found["at"].to_numpy()] = found["x"].to_numpy()
    return out


def _present(total: np.ndarray, langs: np.ndarray, found: np.ndarray) -> None:
    total[0] += np.count_nonzero(found, axis=0)


def moved(train: DataFrame, model: Model) -> Model:
    """The model after one round of k-means over all rows: each centroid is the mean of the rows of its language that are nearest to
    it; one that no row is nearest to stays."""
    centroids, idf, names = model.centroids, model.idf, np.array(model.languages, object)

    def add(total: np.ndarray, langs: np.ndarray, found: np.ndarray) -> None:
        rows = unit(np.log1p(found) * idf)
        own = np.where(langs[:, None] == names[None, :], rows @ centroids.T, -1.0).argmax(1)
        for j in set(own[np.isin(langs, names)].tolist()):
            total[j] += np.rint(rows[(own == j) & (langs == names[j])].sum(0) * PARTS).astype(np.int64)

    total = totals(train, len(names), add)
    return replace(model, centroids=np.where(total.any(1, keepdims=True), unit(total / PARTS), centroids))


def length_class(size: Column) -> Column:
    """The class of a text of so many bytes."""
    return sum(((size >= n).cast("int") for n in LENGTHS), F.lit(0))


def limits(train: DataFrame, model: Model) -> np.ndarray:
    """The rejection limit of each class of length; one with few rows has that of the class below, or half of the first one's."""
    scored = predicted(train.withColumn("kind", length_class(F.octet_length("text"))), model, "kind").filter("lang_pred <> 'und'")
    counted: dict[int, list[tuple[int, int]]] = {}  # at most SCORES a class
    for r in scored.groupBy("kind", F.floor(F.col("score") * SCORES).alias("part")).agg(F.count("*").alias("n")).collect():
        counted.setdefault(r["kind"], []).append((r["part"], r["n"]))
    known = {}
    for k, parts in counted.items():
        part, n = np.array(sorted(parts)).T
        if n.sum() >= LEAST_ROWS:
            at = np.searchsorted(np.cumsum(n), REJECT_QUANTILE * (n.sum() - 1), "right")
            known[k] = REJECT_SHARE * float(part[at]) / SCORES
    near = lambda k: known[max(x for x in known if x <= k)] if k >= min(known) else known[min(known)] / 2
    return np.array([near(k) if known else 0.0 for k in range(len(LENGTHS) + 1)])


def clusters(rows: np.ndarray, k: int, rounds: int = 12) -> list[np.ndarray]:
    """Centroids by spherical k-means from the mean and then the farthest rows but the oddest tenth; those of under a
    hundredth of the rows are left out."""
    rows = rows[rows.any(1)]
    if not len(rows):
        return []
    centres = unit(rows.mean(0, keepdims=True))
    usual = rows @ centres[0]
    usual = rows[usual >= np.quantile(usual, 0.1)]
    while len(centres) < min(k, len(usual)):
        centres = np.vstack([centres, usual[np.argmin((usual @ centres.T).max(1))]])
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(1)
        centres = unit(np.array([rows[own == j].mean(0) if (own == j).any() else centres[j] for j in range(len(centres))]))
    size = np.bincount((rows @ centres.T).argmax(1), minlength=len(centres))
    return [c for c, n in zip(centres, size) if n * 100 >= len(rows)]


def predicted(documents: DataFrame, model: Model, *keep: str) -> DataFrame:
    """(the columns of keep, lang_pred, score, rejected) of every row of documents."""
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        centroids = (m.centroids * 1.0).T
        names = np.array([*m.languages, "und"])
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(0), SLICE_ROWS):
                known = _letters(data, offsets)
                if not len(m.languages):
                    known[:] = False
                    best, cosine = np.zeros(hi - lo, int), np.zeros(hi - lo)
                else:
                    likeness = unit(np.log1p(counts(data, offsets)) * m.idf) @ centroids
                    best = likeness.argmax(1)
                    cosine = likeness.max(1)
                best = np.where(known, best, len(m.languages))
                score = np.where(known, np.clip(cosine, 0, 1), 0.0)
                limit = np.where(known, m.limits[np.digitize(np.diff(offsets), LENGTHS)], np.inf)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(1 + i).slice(lo, hi - lo) for i in range(len(keep))], pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(score < limit)],
                    [*keep, "lang_pred", "score", "rejected"],
                )

    fields = [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep]
    return documents.select("text", *keep).mapInArrow(run, ", ".join([*fields, "lang_pred string, score double, rejected boolean"]))


def drop_rejected(documents: DataFrame) -> DataFrame:
    """documents without those whose language is rejected; learnt from its own training rows."""
    whole = documents.select("text", F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row"))
    found = predicted(whole, fit(documents, training_rows(documents)), "__row")
    return found.filter(~F.col("rejected")).select("__row.*")


def digest(documents: DataFrame) -> DataFrame:
    """The rows of query op7_language."""
    found = predicted(documents, fit(documents, training_rows(documents)), "doc_id")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))  # a null id has no remainder and is never learnt from
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
