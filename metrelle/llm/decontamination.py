"""Benchmark decontamination with DataFrame functions only.

The benchmark's word windows become a set of 64-bit keys, which is broadcast without the words. Every document's windows are
keyed in one pass over its words and looked up in that set; only hits and one row per document leave the scan, and the words
of each hit are compared with the window's own in a second join, of hits alone. A set of more than KEYS keys, once counted,
is looked up part by part, each part with a scan of its own, so no broadcast exceeds KEYS rows of 16 bytes and what is
shuffled is hits at every size of the benchmark.

Defined results: a null or wordless text has no windows and no hits; a benchmark text of fewer than `n` words, but not
none, is one window; null benchmark texts have no windows; texts of any length are read whole; ties don't arise, as every
occurrence counts; repeated rows of `documents` each give a row; repeated benchmark
rows count once by item_id; an item without an id is left out; other columns, whatever their names, are ignored, and
`remove_hits` passes them on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrelle.llm.common import small, stored, words

#: Keys, 16 bytes with their length, that are broadcast at once.
KEYS = 2_000_000


def _keys(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def _window_key(keys: Column, at: Column, n: int, salt: int = 0) -> Column:
    """The key of the n words from place `at`, or null where the text ends sooner; another one for another salt."""
    return F.when((at >= 0) & (at + n <= F.size(keys)), F.xxhash64(*[F.lit(salt)] * salt, *[F.get(keys, at + j) for j in range(n)]))


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(key, second, gram, size, item): each distinct window of each item, keyed as the documents' windows are."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    items = items.filter("item IS NOT NULL AND size(w) > 0")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))))
    grams = items.select("item", "w", at.alias("at")).select("item", F.slice("w", F.col("at") + 1, n).alias("gram"))
    grams = grams.select("item", "gram", F.size("gram").alias("size"))
    key = lambda salt: F.coalesce(*[F.when(F.col("size") == m, F.xxhash64(*[F.lit(salt)] * salt, *[F.xxhash64(F.get("gram", F.lit(j))) for j in range(m)])) for m in range(1, n + 1)])
    return grams.select(key(0).alias("key"), key(1).alias("second"), "gram", "size", "item").distinct()


def hits(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(row, doc_id, n_words, spans, items): for every row of documents its word spans that are windows, and their items.

    row numbers the rows of the scan; spans is an array of (at, size) sorted by place."""
    windows = stored(benchmark_windows(benchmark, n))
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # n values at most
    keys = windows.select("key", F.col("size").alias("length")).distinct()
    parts = max(1, -(-keys.count() // KEYS))
    found = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    found = found.withColumn("keys", _keys(F.col("w")))

    def looked_up(part: int) -> DataFrame:
        """(row, doc_id, n_words, at, key, size, gram): the places whose key is in this part of the set; with the first part also
        place -1 of each document, which carries the document itself."""
        # Keys are made after the explode, where they are compiled code.
        looked = found.withColumn("at", F.explode(F.sequence(F.lit(-1), F.size("w") - 1) if not part else F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))))
        looked = looked.withColumns({"doc_id": F.when(F.col("at") < 0, F.col("doc_id")), "n_words": F.when(F.col("at") < 0, F.size("w"))})
        if len(sizes) > 1:
            looked = looked.withColumn("m", F.explode(F.when(F.col("at") < 0, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, sizes)))))
            key = F.coalesce(*[F.when(F.col("m") == m, _window_key(F.col("keys"), F.col("at"), m)) for m in sizes])
        else:
            key = _window_key(F.col("keys"), F.col("at"), sizes[0]) if sizes else F.lit(None).cast("long")
        own = keys if parts == 1 else keys.filter(F.pmod("key", F.lit(parts)) == part)
        joined = looked.withColumn("key", key).join(F.broadcast(own), "key", "left")
        joined = joined.filter((F.col("at") < 0) | F.col("length").isNotNull())
        gram = F.when(F.col("length").isNotNull(), F.slice("w", F.col("at") + 1, F.coalesce("length", F.lit(1))))
        # Documents are dealt out like windows; length 0 is no window's.
        return joined.select("row", "doc_id", "n_words", "at", F.coalesce("key", F.xxhash64("row")).alias("key"), F.coalesce("length", F.lit(0)).alias("size"), gram.alias("words"))

    candidates = reduce(DataFrame.unionByName, map(looked_up, range(parts)))
    grams = windows.select("key", "size", "second", "gram").distinct()
    same = candidates.join(small(grams), ["key", "size"], "left").filter((F.col("at") < 0) | (F.col("words") == F.col("gram")))
    hit = F.col("at") >= 0
    each = same.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").cast("long").alias("n_words"),
        F.sort_array(F.collect_list(F.when(hit, F.struct("at", "size")))).alias("spans"),
        F.collect_set(F.when(hit, F.struct("key", "second", "size"))).alias("found"),
    )
    owners = small(windows.select("key", "second", "size", "item").distinct())
    named = each.select("row", "doc_id", "n_words", "spans", F.explode_outer("found").alias("f")).select("row", "doc_id", "n_words", "spans", "f.*")
    return named.join(owners, ["key", "second", "size"], "left").groupBy("row").agg(
        *[F.any_value(c).alias(c) for c in ("doc_id", "n_words", "spans")], F.sort_array(F.collect_set("item")).alias("items")
    )


def merged(spans: Column) -> Column:
    """The union of sorted (at, size) spans as an array of (start, end) that neither meet nor overlap."""
    kind = "array<struct<start:int,end:int>>"

    def step(done: Column, span: Column) -> Column:
        end = span["at"] + span["size"]
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["at"]), longer).otherwise(
            F.concat(done, F.array(F.struct(span["at"].alias("start"), end.alias("end"))))
        )

    return F.aggregate(spans, F.array().cast(kind), step)


def n_hit(spans: Column) -> Column:
    """The number of words that lie in any of the sorted spans."""

    def step(state: Column, span: Column) -> Column:
        end = F.greatest(span["at"] + span["size"], state["end"])
        return F.struct((state["n"] + end - F.greatest(span["at"], state["end"])).alias("n"), end.alias("end"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda s: s["n"].cast("long"))


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated): one row per row of documents."""
    found = hits(documents, benchmark, n)
    return found.select("doc_id", "n_words", n_hit(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items").withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """documents without those that hold a window; a document without an id stays, as it can't be told from others."""
    bad = contamination(documents, benchmark, n).filter("contaminated AND doc_id IS NOT NULL").select("doc_id").distinct()
    return documents.join(bad, "doc_id", "left_anti")


def remove_hits(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """documents whose text lacks the hit passages: what stands between kept words is kept as it is.

    A passage runs from its first word's start to its last word's end; documents without an id are left as they are."""
    spans = hits(documents, benchmark, n).filter("size(spans) > 0 AND doc_id IS NOT NULL")
    spans = spans.groupBy("doc_id").agg(F.first(merged(F.col("spans"))).alias("__cut"))
    tokens = F.regexp_extract_all("text", F.lit("([0-9A-Za-z\\u0080-\\x{10FFFF}]+|[^0-9A-Za-z\\u0080-\\x{10FFFF}]+)"), F.lit(0))
    leads = F.col("text").rlike("^[0-9A-Za-z\\u0080-\\x{10FFFF}]").cast("int")

    def keep(token: Column, i: Column) -> Column:
        inside = F.exists("__cut", lambda c: (i + leads >= 2 * c["start"] + 1) & (i + leads <= 2 * c["end"] - 1))
        return F.when(inside, F.lit("")).otherwise(token)

    text = F.when(F.col("__cut").isNull(), F.col("text")).otherwise(F.array_join(F.transform(tokens, keep), ""))
    return documents.join(spans, "doc_id", "left").withColumn("text", text).select(*documents.columns)


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of query op10_decontamination."""
    found = contamination(documents, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: DuckDB SQL for digest(); windows of whole texts are compared as strings.
DIGEST_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n)),
h AS (SELECT DISTINCT dw.r, dw.i, bw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
