"""Comparison of models: who may be compared, who is best at display precision, what they are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrelle.functions.text import label_forms


def expected_count(datasets: DataFrame, models: DataFrame) -> DataFrame:
    """The clips of a complete model: all datasets' n if every one is known, else the largest measured n."""
    all_n = datasets.agg(F.when((F.count("*") == F.count("n")) & (F.count("*") > 0), F.sum("n")).alias("a"))
    most = models.agg(F.max("n").alias("b"))
    return all_n.crossJoin(most).select(F.coalesce("a", "b").cast("long").alias("expected"))  # one row each


def comparable(n: Column, missing: Column, expected: Column) -> Column:
    """Measured, nothing missing, and as many clips as expected where both are known."""
    return n.isNotNull() & (F.coalesce(missing, F.lit(0)) <= 0) & (F.coalesce(n == expected, F.lit(True)))


def best(key: Column, *group: str) -> Column:
    """Whether a display key is the smallest of its group; never where fewer than two have one. Nulls don't compete."""
    w = Window.partitionBy(*[F.col(g) for g in group]) if group else Window.partitionBy(F.lit(0))
    return F.coalesce((key == F.min(key).over(w)) & (F.count(key).over(w) >= 2), F.lit(False))


def short_labels(models: DataFrame, family: str) -> DataFrame:
    """For each label the shortest of its forms that no other label has in that place; labels whose choices meet keep their own.

    Forms are counted as rows, so a run may have any number of labels."""
    labels = models.select("label").distinct().withColumn("forms", label_forms(F.col("label"), family))
    rows = labels.select("label", F.posexplode("forms").alias("at", "form"))
    free = rows.withColumn("owners", F.count("*").over(Window.partitionBy("at", "form"))).filter((F.col("owners") == 1) | (F.col("at") == 0))
    chosen = free.groupBy("label").agg(F.max_by("form", "at").alias("short"))
    meets = F.count("*").over(Window.partitionBy("short")) > 1
    return models.join(chosen.select("label", F.when(meets, F.col("label")).otherwise(F.col("short")).alias("short")), "label")


def series_slot(models: DataFrame, known: DataFrame, slots: int = 4) -> DataFrame:
    """The colour slot of a model by its place among the known ones, from 1; null beyond the slots."""
    place = known.select("model", F.when(F.col("ordinal") < slots, F.col("ordinal") + 1).alias("slot"))
    return models.join(place, "model", "left")


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """A15."""
    return rows.groupBy(*keys).count().filter("count > 1").select(*keys)
