"""Sampling and planning: reproducible samples by hash, plans, what is left to do, and checks between runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrelle.functions.digest import Sha256
from metrelle.sources.results import kept


def sampling_key(dataset: Column, row: Column) -> Column:
    """P5: the hash that orders a dataset's rows; a larger sample extends a smaller one."""
    return F.sha2(F.concat_ws(":", dataset, row.cast("string")), 256)


def take_within(rows: DataFrame, n: int, most: float = 30.0) -> DataFrame:
    """Per dataset the first n rows in hash order whose duration is within the bound, with their `place`.

    The order prunes to n rows per task before rows meet; no running count over the whole table is needed."""
    keyed = rows.withColumn("key", sampling_key(F.col("dataset"), F.col("row"))).filter(F.col("duration_s") <= most)
    order = Window.partitionBy("dataset").orderBy("key")
    return keyed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def excluded_before(rows: DataFrame, n: int, most: float = 30.0) -> DataFrame:
    """Per dataset how many over-long rows come before the n-th taken one; all of them if fewer are taken."""
    last = take_within(rows, n, most).groupBy("dataset").agg(F.max("key").alias("last"), F.count("*").alias("taken"))
    keyed = rows.withColumn("key", sampling_key(F.col("dataset"), F.col("row")))
    both = keyed.join(last, "dataset", "left")  # a row per dataset, which AQE broadcasts after it has seen its size
    met = (F.col("duration_s") > most) & ((F.coalesce(F.col("taken"), F.lit(0)) < n) | (F.col("key") < F.col("last")))
    return both.groupBy("dataset").agg(F.coalesce(F.any_value("taken"), F.lit(0)).alias("taken"), F.count_if(met).alias("excluded"))


def interleaved(taken: DataFrame, datasets: DataFrame) -> DataFrame:
    """The first of each dataset, then the second, and so on, in column `ordinal` from 0."""
    ordered = taken.join(datasets.select("dataset", F.col("ordinal").alias("__d")), "dataset", "left")
    order = Window.orderBy("place", F.asc_nulls_last("__d"), "dataset")
    return ordered.withColumn("ordinal", F.row_number().over(order) - 1).drop("__d")


def plan_slice(items: DataFrame, offset: int, limit: int | None = None) -> DataFrame:
    """`limit` items from `offset` on, in order; all the rest without a limit."""
    rest = items.orderBy("ordinal").offset(offset)
    return rest if limit is None else rest.limit(limit)


def planned_totals(items: DataFrame) -> DataFrame:
    """Per dataset the number of items and their seconds; durations have three digits, so decimals add them exactly."""
    return items.groupBy("dataset").agg(F.count("*").alias("n"), F.sum(F.col("duration_s").cast("decimal(18,3)")).cast("double").alias("audio_s"))


#: Ids of a plan that one task hashes before it hands the hash on.
DIGEST_ROWS = 4_000_000


def ids_digest(items: DataFrame, rows: int = DIGEST_ROWS) -> DataFrame:
    """One row, the hash of all ids in order, joined by line feeds; null ids are passed over.

    A hash takes its bytes in order, so ranges of ordinals are hashed one after the other: a task sorts and hashes one range and
    hands the state of the hash, some hundred bytes, to the next. No row and no task holds all ids."""
    plan = items.filter("id IS NOT NULL").select("ordinal", "id")
    parts = -(-plan.count() // rows)
    if not parts:
        return items.sparkSession.createDataFrame([(Sha256().hexdigest(),)], "digest string")
    if parts > 1:
        plan = kept(plan.repartitionByRange(parts, "ordinal").withColumn("part", F.spark_partition_id()), "part")
    state, found = None, None
    for part in range(parts):
        own = plan if parts == 1 else plan.filter(F.col("part") == part)
        found = own.repartition(1).sortWithinPartitions("ordinal", "id").select("id").mapInArrow(_hashed(state), "state binary, digest string")
        if part < parts - 1:
            state = found.first()["state"]
    return found.select("digest")


def _hashed(state: bytes | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, first = Sha256(state), state is None
        for batch in batches:
            if batch.num_rows:
                text = "\n".join(batch.column(0).to_pylist())
                sha.update((text if first else "\n" + text).encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([sha.state()]), pa.array([sha.hexdigest()])], ["state", "digest"])

    return run


def same_plan(one: DataFrame, other: DataFrame) -> DataFrame:
    """Whether two plans have the same ids in the same order, by their places; no list of ids is made."""
    both = one.select("ordinal", F.col("id").alias("a")).join(other.select("ordinal", F.col("id").alias("b")), "ordinal", "full")
    return both.agg((F.count_if(~F.col("a").eqNullSafe(F.col("b"))) == 0).alias("same"))


def pending(items: DataFrame, recorded: DataFrame) -> DataFrame:
    """Planned items that aren't recorded."""
    return items.join(recorded.select("id").distinct(), "id", "left_anti")


def stale(existing: DataFrame, keep: DataFrame, key: str = "path") -> DataFrame:
    """What exists and isn't to be kept."""
    return existing.join(keep.select(key).distinct(), key, "left_anti")


def unknown_values(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Values of a column that the dimension lacks; callers raise if there is one."""
    return rows.select(key).distinct().join(known.select(key), key, "left_anti")


def require_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows, which fail when they are read if a value is unknown."""
    flagged = rows.join(known.select(key).distinct().withColumn("__k", F.lit(True)), key, "left")
    checked = F.when(F.col("__k").isNull(), F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.col(key).cast("string"))).cast(rows.schema[key].dataType)).otherwise(F.col(key))
    return flagged.withColumn(key, checked).drop("__k")


def or_default(rows: DataFrame, known: DataFrame, key: str, default: str) -> DataFrame:
    """An unknown value becomes the default."""
    flagged = rows.join(known.select(key).distinct().withColumn("__k", F.lit(True)), key, "left")
    return flagged.withColumn(key, F.when(F.col("__k"), F.col(key)).otherwise(F.lit(default))).drop("__k")


def source_fields(planned: DataFrame, sources: DataFrame, specs: DataFrame) -> DataFrame:
    """Repo and revision of each dataset from its source, where empty from the static description; label or key."""
    both = planned.join(sources, "dataset", "left").join(specs.select("dataset", F.col("repo").alias("__r"), F.col("revision").alias("__v"), F.col("label").alias("__l")), "dataset", "left")
    first = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    return both.select(*planned.columns, first("repo", "__r").alias("repo"), first("revision", "__v").alias("revision"), F.coalesce("__l", "dataset").alias("label"))


def dimension(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """Rows of a small dimension, counted and then broadcast; more than `most` are an error, as what they multiply would be."""
    n = rows.count()
    if n > most:
        raise ValueError(f"{n} rows where a dimension has {most} at most")
    return F.broadcast(rows)
