"""Scores: per-clip edit counts, then sums. Rates are divided last and never averaged.

`clip_facts` is the only expensive step: each metric's distance is computed once per row; everything after it adds numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrelle.functions.text import NORMALIZERS, edits_of, normal_forms, reading

#: A clip whose normalised rate is above this in any model is a run-wide outlier.
OUTLIER_RATE = 1.0
WORST = 3


def failed() -> Column:
    """An error that isn't null; an empty one counts."""
    return F.col("error").isNotNull()


def rate(edits: Column, chars: Column) -> Column:
    """A2: null where the reference has no characters."""
    return F.try_divide(edits.cast("double"), chars.cast("double"))


def clip_facts(results: DataFrame) -> DataFrame:
    """F8: results without texts, with <metric>_edits and <metric>_chars; null for failed rows, which aren't scored.

    Rows with the tokens of both texts, array<struct<surface, reading>> in reference_tokens and hypothesis_tokens, also get
    cer_reading. The distance is much work for few bytes, so rows are dealt out before it, each model's apart; what marked() needs by id
    afterwards is numbers without texts."""
    texts = ("reference", "hypothesis")
    forms = {c: normal_forms(F.col(c)) for c in texts}
    made = {f"__{c}_{name}": form for c in texts for name, form in forms[c].items()}  # Python, before rows are dealt out
    at_hand = {c: {name: F.col(f"__{c}_{name}") for name in forms[c]} for c in texts}
    plain = {m: tuple(normal(F.col(c), at_hand[c]) for c in texts) for m, normal in NORMALIZERS.items()}
    tokens = ("reference_tokens", "hypothesis_tokens")
    if set(tokens) <= set(results.columns):
        plain["cer_reading"] = tuple(reading(F.col(c)) for c in tokens)
    # Texts are normalised in a projection of their own, as a distance looks at them more than once.
    sides = {f"__{m}_{side}": F.when(~failed(), text) for m, both in plain.items() for side, text in zip("ab", both)}
    counts = {m: edits_of(F.col(f"__{m}_a"), F.col(f"__{m}_b")) for m in plain}
    flat = {f"{m}_{part}": F.col(m)[part] for m in plain for part in ("edits", "chars")}
    dealt = results.withColumns(made).repartition("model", "id")
    return dealt.withColumns(sides).withColumns(counts).withColumns(flat).drop(*texts, *tokens, *made, *sides, *counts)


def metrics_of(facts: DataFrame) -> list[str]:
    """The metrics that facts hold, in output order."""
    return [m for m in (*NORMALIZERS, "cer_reading") if f"{m}_edits" in facts.columns]


def outlier_ids(facts: DataFrame) -> DataFrame:
    """Ids that exceed OUTLIER_RATE in any model."""
    # A filter on the distance itself would be pushed below the deal-out of clip_facts; one on an aggregate isn't.
    above = (F.col("cer_norm_chars") > 0) & (F.col("cer_norm_edits") > OUTLIER_RATE * F.col("cer_norm_chars"))
    return facts.groupBy("id").agg(F.max(above).alias("above")).filter("above").select("id")


def marked(facts: DataFrame) -> DataFrame:
    """Facts with the flags `outlier` and `first_model`, the least model of an id. A window over the id reads the facts once, where a join would score all texts twice."""
    above = (F.col("cer_norm_chars") > 0) & (F.col("cer_norm_edits") > OUTLIER_RATE * F.col("cer_norm_chars"))
    by_id = Window.partitionBy("id")
    return facts.withColumns({"outlier": F.coalesce(F.max(above).over(by_id), F.lit(False)), "first_model": F.col("model") == F.min("model").over(by_id)})


def speed(ok: Column) -> list[Column]:
    """A3: ratios of processing to audio time over rows that are ok."""
    of = lambda c: F.sum(F.when(ok, F.col(c)))
    return _ratios(of("infer_ms"), of("decode_ms"), of("duration_s"))


def _ratios(infer: Column, decode: Column, audio: Column) -> list[Column]:
    of = lambda ms: F.when(audio > 0, ms / 1000 / audio)
    return [of(infer).alias("rtf"), of(infer + decode).alias("rtf_with_decode"), F.coalesce(audio, F.lit(0.0)).alias("audio_s")]


class Extra(NamedTuple):
    """A further column of a group: an aggregate of marked facts, and how those of its parts make that of the whole."""

    name: str
    part: Callable[[], Column]
    whole: Callable[[Column], Column]


#: Ids of outliers, each told by its first model alone and once, in whatever group; A9's load time in seconds.
OUTLIER_IDS = Extra("outlier_ids", lambda: F.collect_set(F.when(F.col("outlier") & F.col("first_model"), F.col("id"))), lambda c: F.flatten(F.collect_list(c)))
LOAD_S = Extra("load_s", lambda: F.min(F.when(F.col("load_ms").isNotNull(), F.struct("line_no", "load_ms"))), lambda c: F.min(c)["load_ms"] / 1000)


def _parts(metrics: list[str]) -> dict[str, Column]:
    """The sums of marked facts that groups are added up from."""
    ok, kept = ~failed(), ~F.col("outlier")
    total = lambda c, when: F.sum(F.when(ok & when, F.col(c)))
    every = F.lit(True)
    out = {"clips": F.count("*"), "succeeded": F.count_if(ok), "failed": F.count_if(~ok), "outliers": F.count_if(ok & F.col("outlier"))}
    out |= {f"{m}_{p}": total(f"{m}_{p}", every) for m in metrics for p in ("edits", "chars")}
    out |= {f"kept_{p}": total(f"cer_norm_{p}", kept) for p in ("edits", "chars")}
    return out | {c: total(c, every) for c in ("infer_ms", "decode_ms", "duration_s")}


def middles(counted: DataFrame, *group: str) -> DataFrame:
    """Counted rows (group, rate, rated: how many have it) with `middle`, half of each rate that stands in the middle of its
    group, so that their sum is the exact median; null elsewhere. Running counts from both ends meet: no task holds a group's rates."""
    up = Window.partitionBy(*group).orderBy(F.asc_nulls_first("rate")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*group).orderBy(F.desc_nulls_last("rate")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ran = counted.withColumn("__up", F.sum("rated").over(up)).withColumn("__down", F.sum("rated").over(down))
    total = F.col("__up") + F.col("__down") - F.col("rated")
    holds = lambda rank: ((F.col("__up") >= rank) & (F.col("__up") - F.col("rated") < rank)).cast("int")
    shares = holds(F.floor((total + 1) / 2)) + holds(F.floor((total + 2) / 2))
    return ran.withColumn("middle", F.when((F.col("rated") > 0) & (shares > 0), shares * 0.5 * F.col("rate"))).drop("__up", "__down")


def medians(facts: DataFrame, *group: str) -> DataFrame:
    """The exact median of the clips' normalised rates of each group, null where none has a rate."""
    rated = facts.withColumn("rate", rate(F.col("cer_norm_edits"), F.col("cer_norm_chars")))
    counted = rated.groupBy(*group, "rate").agg(F.count("rate").alias("rated"))
    return middles(counted, *group).groupBy(*group).agg(F.sum("middle").alias("median"))


def group_summary(facts: DataFrame, *extras: Extra) -> DataFrame:
    """A row per (model, dataset) and per model (dataset null, overall true).

    Facts are first added up by rate, of which a clip's length bounds how many there are; the median is found by running counts
    over those, and groups are the sums of their rates' rows."""
    metrics = metrics_of(facts)
    rows = marked(facts).withColumn("rate", rate(F.col("cer_norm_edits"), F.col("cer_norm_chars")))
    sets = rows.groupingSets([["model", "dataset", "rate"], ["model", "rate"]], "model", "dataset", "rate")
    parts = _parts(metrics)
    by_rate = sets.agg((F.grouping("dataset") == 1).alias("overall"), F.count("rate").alias("rated"), *[c.alias(name) for name, c in parts.items()], *[x.part().alias(x.name) for x in extras])
    whole = {name: F.sum(name) for name in parts}
    shown = lambda name: (F.coalesce(whole[name], F.lit(0)) if name.startswith(("cer_", "kept_")) else whole[name]).alias(name)
    sums = [shown(name) for name in parts if name not in ("infer_ms", "decode_ms", "duration_s")]
    ratios = _ratios(whole["infer_ms"], whole["decode_ms"], whole["duration_s"])
    return middles(by_rate, "model", "overall", "dataset").groupBy("model", "dataset", "overall").agg(*sums, F.sum("middle").alias("median"), *ratios, *[x.whole(F.col(x.name)).alias(x.name) for x in extras])


def worst(facts: DataFrame, k: int = WORST) -> DataFrame:
    """The k worst clips of each model and dataset; outliers stay, failures and undefined rates don't."""
    scored = facts.withColumn("rate", rate(F.col("cer_norm_edits"), F.col("cer_norm_chars"))).filter("cer_norm_chars > 0")
    order = Window.partitionBy("model", "dataset").orderBy(F.desc("rate"), F.desc("cer_norm_edits"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("model", "dataset", "rank", "id", "rate", F.col("cer_norm_edits").alias("edits"), F.col("cer_norm_chars").alias("chars"))


def first_values(results: DataFrame, *columns: str) -> DataFrame:
    """Per model the first non-null value of each column in line order."""
    return results.groupBy("model").agg(*[F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c) for c in columns])


def first_wins(rows: DataFrame) -> DataFrame:
    """The first row of each (model, id) in line order."""
    order = Window.partitionBy("model", "id").orderBy("line_no")
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def failed_list(results: DataFrame) -> DataFrame:
    """Per model the ids of failed rows in line order, those of one line by id; a row of them is what the job asks for."""
    bad = results.filter(failed()).groupBy("model").agg(F.array_sort(F.collect_list(F.struct("line_no", "id"))).alias("l"))
    return bad.select("model", F.col("l.id").alias("failed_ids"))


def missing(planned: Column, n: Column) -> Column:
    """A10: planned rows that aren't there; null if the plan is unknown."""
    return F.when(planned.isNotNull(), F.greatest(planned - n, F.lit(0)))


def all_models(declared: DataFrame, counted: DataFrame) -> DataFrame:
    """Declared models and models with rows, declared order first and the rest by name, in column `place`."""
    both = declared.join(counted, "model", "full")
    order = Window.orderBy(F.asc_nulls_last("ordinal"), "model")
    return both.withColumn("place", F.row_number().over(order))
