"""Line dedup: a line goes if an earlier one is the same or within an edit bound of one character.

Every line of LEAST_FUZZY characters or more emits, as hashed keys, all its variants within the bound: itself, and itself
without one character. Lines that share a variant are joined through the earliest line of the key, never pairwise: lines
that lack the same character place are one substitution apart, and a line that equals another's variant is one insertion or
deletion apart. The edit distance of each join is then verified on the texts. Before that, a lossless filter keeps the keys
few: one edit leaves the left or the right half of a line as it is, so only lines that share half a line, aligned to its own
end and with a length that differs by one at most, emit variants.

Order is by (doc_id, hash of the text, line number). Defined results: lines are what stands between line feeds; a line of
white space only is never removed; copies of a line go after its first occurrence; shorter lines are held against exact copies
only; a line near to an earlier one goes with all its copies, also if that earlier one goes itself. Lines and texts of any
length are taken whole. Rows with a null doc_id or text take no part and stay as they are; different texts of one doc_id are
rows of their own; rows that repeat in both are one, and stay alike; an empty table gives none; other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrelle.llm.common import cut, discard, is_small, mix, powers, slices, small, small_batches, stored

#: Code points from which a line is held against near lines as well.
LEAST_FUZZY = 20


#: Removed lines that may be broadcast, after they were counted; beyond, documents are shuffled to them.
BROADCAST_LINES = 1_000_000


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, version, line_no, line, h1, h2) of every line that isn't white space only; version is a hash of the text, and
    one 64-bit hash alone would collide."""
    found = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    found = found.filter(F.col("line").rlike(r"\S"))
    return found.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(11), "line")})


def half_keys(line: Column) -> Column:
    """The keys of the halves that a near partner of the line would share, for partners as long and for those one shorter."""
    n = F.length(line)

    def halves(size: Column) -> list[Column]:
        half = F.floor(size / 2).cast("int")
        return [F.xxhash64(F.lit(1), size, F.substring(line, F.lit(1), half)), F.xxhash64(F.lit(2), size, F.substring(line, n - (size - half) + 1, size - half))]

    return F.array(*halves(n), *halves(n - 1))


def variant_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every text without its character at a place, the text's index and the place; place -1 is the text itself."""
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = mix(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(5))
    up, down = powers(len(data) + 2)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up[: len(data)], out=total[1:])
    row = np.repeat(np.arange(len(texts)), np.diff(at) + 1)
    place = np.arange(len(row)) - (at[:-1] + np.arange(len(texts)))[row] - 1
    start, end = at[:-1][row], at[1:][row]
    split = start + np.maximum(place, 0)
    skip = start + place + 1
    back = np.where(place < 0, np.uint64(1), down[1])  # what follows the gap moves one place to the left
    return mix(((total[split] - total[start]) + (total[end] - total[skip]) * back) * down[start]), row, place


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, role, h1, h2) of every variant: s for lines that lack one place, w for a whole line, c for a line cut by one."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for lo, hi in slices(np.concatenate([[0], np.cumsum([len(t) for t in texts])]), 1 << 17):
            found, row, place = variant_hashes(texts[lo:hi])
            cuts = place >= 0
            key = np.concatenate([mix(found[cuts] + (place[cuts].astype(np.uint64) + np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15)), found])
            role = np.concatenate([np.full(cuts.sum(), "s"), np.where(cuts, "c", "w")])
            rows = pa.array(lo + np.concatenate([row[cuts], row]))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(role), batch.column(0).take(rows), batch.column(1).take(rows)], ["key", "role", "h1", "h2"])


def near_lines(documents: DataFrame, hashed: DataFrame, least: int = LEAST_FUZZY) -> DataFrame:
    """(h1, h2) of every distinct line that has an earlier one within one edit; hashed: the rows of hashed_lines()."""
    keyed = hashed.filter("halves IS NOT NULL").select("h1", "h2", F.explode("halves").alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key"))
    some = keyed.join(small(shared), "key", "left_semi").select("h1", "h2").distinct()
    some = cut(hashed.join(small(cut(some)), ["h1", "h2"]).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "version", "line_no")).alias("at")))
    # The text of each such line is read from its first place, so only the documents that hold one are taken apart again.
    asked = cut(some.groupBy("at.doc_id", "at.version").agg(F.collect_list(F.struct("at.line_no", "h1", "h2", "at")).alias("asked")))
    rows = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("version"), "text")
    asked = rows.join(F.broadcast(asked) if is_small(some, BROADCAST_LINES) else asked, ["doc_id", "version"])
    parts = asked.withColumn("every", F.split("text", "\n")).select(F.inline(F.transform("asked", lambda q: F.struct(q["h1"].alias("h1"), q["h2"].alias("h2"), q["at"].alias("at"), F.get("every", q["line_no"]).alias("line")))))
    kept = stored(parts.dropDuplicates(["h1", "h2"]))  # rows may repeat
    variants = kept.select("h1", "h2", "line").mapInArrow(_emit, "key long, role string, h1 long, h2 long")
    meeting = variants.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key")
    met = cut(variants.join(small(cut(meeting)), "key").join(kept.select("h1", "h2", "at"), ["h1", "h2"]))
    line = F.struct("at", "h1", "h2")
    first = met.filter("role = 's'").groupBy("key").agg(F.min(line).alias("early"))
    alike = met.filter("role = 's'").join(first, "key").select(line.alias("late"), "early")
    whole = met.filter("role = 'w'").select("key", line.alias("w"))
    shorter = met.filter("role = 'c'").join(whole, "key").select(F.greatest(line, "w").alias("late"), F.least(line, "w").alias("early"))
    pairs = alike.union(shorter).filter("late.at > early.at").distinct()
    text = kept.select("h1", "h2", "line")
    told = pairs.join(text.toDF("a1", "a2", "a"), F.expr("late.h1 = a1 AND late.h2 = a2")).join(text.toDF("b1", "b2", "b"), F.expr("early.h1 = b1 AND early.h2 = b2"))
    return told.filter(F.levenshtein("a", "b", 1) >= 0).select("late.h1", "late.h2").distinct()


def hashed_lines(documents: DataFrame, least: int = LEAST_FUZZY) -> DataFrame:
    """(doc_id, version, line_no, h1, h2, halves): every line by its hashes, written once; halves are null for short lines."""
    halves = F.when(F.length("line") >= least, half_keys(F.col("line"))).alias("halves")
    return stored(lines(documents).select("doc_id", "version", "line_no", "h1", "h2", halves))


def removals(documents: DataFrame, least: int = LEAST_FUZZY) -> DataFrame:
    """(doc_id, version, gone, n_exact, n_near): for each document that loses lines, their numbers, and how many for which reason."""
    found = hashed_lines(documents, least)
    near = cut(near_lines(documents, found, least))
    place = F.struct("doc_id", "version", "line_no")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("at"), F.count("*").alias("n")).filter("n > 1").drop("n")
    decided = cut(first.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "full"))
    gone = found.join(small(decided), ["h1", "h2"]).filter(F.col("near") | (F.col("at") != place)).select("doc_id", "version", "line_no", "near").distinct()
    gone = stored(gone.groupBy("doc_id", "version").agg(F.collect_list("line_no").alias("gone"), F.count_if(F.col("near").isNull()).alias("n_exact"), F.count("near").alias("n_near")))
    discard(found)
    return gone


def cleaned(documents: DataFrame, least: int = LEAST_FUZZY) -> DataFrame:
    """documents without the lines that go, and the columns __exact and __near: how many went for which reason."""
    gone = removals(documents, least)
    if (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("gone").alias("__gone"), F.col("n_exact").alias("__exact"), F.col("n_near").alias("__near"))
    every = F.split("text", "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), "__gone"), lambda i: F.get(every, i))
    both = documents.join(gone, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__version")), "left")
    return both.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))).select(*documents.columns, "__exact", "__near")


def dedup(documents: DataFrame, least: int = LEAST_FUZZY) -> DataFrame:
    """documents without the lines that go; a document that keeps no line but white space, and lost one, goes too."""
    found = cleaned(documents, least)
    lost = F.coalesce(F.col("__exact") + F.col("__near"), F.lit(0)) > 0
    return found.filter(~lost | F.col("text").rlike(r"\S")).select(*documents.columns)


def digest(documents: DataFrame) -> DataFrame:
    """The rows of query op9_line_dedup: counts of removed lines and a hash of what stays of each text."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    found = cleaned(documents.select("doc_id", "text"))
    return found.select("doc_id", zero("__exact").alias("n_exact"), zero("__near").alias("n_near"), F.sha2("text", 256).alias("text_sha256"))


#: DuckDB SQL for digest(): variants are made of the whole lines and met by their strings' hashes.
DIGEST_SQL = f"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
every AS (SELECT doc_id, i, p[i] AS line FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM parts)),
l AS (SELECT * FROM every WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')),
first AS (SELECT line, min({{'d': doc_id, 'i': i}}) AS pos FROM l GROUP BY line),
cut AS (SELECT line, pos, k, hash(left(line, k - 1) || substr(line, k + 1)) AS v FROM (SELECT *, unnest(range(1, length(line) + 1)) AS k FROM first WHERE length(line) >= {LEAST_FUZZY})),
alike AS (SELECT line FROM (SELECT line, pos, min(pos) OVER (PARTITION BY k, v) AS early FROM cut) WHERE early < pos),
indel AS (SELECT c.line AS long, c.pos AS long_pos, w.line AS short, w.pos AS short_pos FROM cut c JOIN first w ON hash(w.line) = c.v AND length(w.line) >= {LEAST_FUZZY}),
near AS (SELECT line FROM alike UNION SELECT long FROM indel WHERE short_pos < long_pos UNION SELECT short FROM indel WHERE long_pos < short_pos),
gone AS (SELECT l.doc_id, l.i, n.line IS NOT NULL AS near FROM l JOIN first f ON f.line = l.line LEFT JOIN near n ON n.line = l.line WHERE n.line IS NOT NULL OR f.pos <> {{'d': l.doc_id, 'i': l.i}}),
counts AS (SELECT doc_id, count(*) FILTER (NOT near) AS n_exact, count(*) FILTER (near) AS n_near FROM gone GROUP BY doc_id),
stays AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.i) AS text FROM every e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i WHERE g.i IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, CAST(coalesce(n_exact, 0) AS BIGINT) AS n_exact, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(CASE WHEN c.doc_id IS NULL THEN d.text ELSE coalesce(s.text, '') END) AS text_sha256
FROM documents d LEFT JOIN counts c ON c.doc_id = d.doc_id LEFT JOIN stays s ON s.doc_id = d.doc_id
"""
