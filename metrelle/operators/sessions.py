"""Sessions of a run as event rows: retries, crashes, stalls, downloads, token streams and phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metrelle.functions.nested import download_flag

#: Crashes on one clip that make it a failure; sessions without progress that are allowed.
CRASHES, RESTARTS = 2, 2


def crash_failures(sessions: DataFrame) -> DataFrame:
    """(model, id, crashes) of clips on which sessions crashed so often."""
    return sessions.filter("status = 'crashed' AND id IS NOT NULL").groupBy("model", "id").agg(F.count("*").alias("crashes")).filter(F.col("crashes") >= CRASHES)


def stuck_rows(stalls: DataFrame, items: DataFrame, recorded: DataFrame) -> DataFrame:
    """The failed result rows of planned clips that stalled and aren't recorded."""
    open_ = stalls.join(recorded.select("model", "id").distinct(), ["model", "id"], "left_anti").join(items, "id")
    text = F.format_string("timeout: %d s", F.round(F.col("stalled_ms") / 1000).cast("long"))
    return open_.select("model", "id", "dataset", "reference", F.lit("").alias("hypothesis"), "duration_s", F.lit(0.0).alias("decode_ms"), F.col("stalled_ms").alias("infer_ms"), F.lit(0).alias("segments"), text.alias("error"))


def gave_up(sessions: DataFrame, span: int = 100_000) -> DataFrame:
    """(model, attempt) of the session after which a model is given up: more than RESTARTS in a row without progress.

    A session ends such a row if it and the RESTARTS before it made none, so ranges of `span` attempts are looked at apart, each
    with the last sessions of the ranges before it: a model's sessions go to as many tasks as it has ranges."""
    by = ["model", "__range"]
    rows = sessions.select("model", "attempt", (F.coalesce("new_results", F.lit(0)) <= 0).cast("int").alias("idle"), F.expr(f"attempt DIV {span}").alias("__range"))
    latest = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("attempt")))).filter(F.col("__n") <= RESTARTS).drop("__n")
    ranges = latest.select(*by).distinct()
    next_ = F.array(*[F.lead("__range", k).over(Window.partitionBy("model").orderBy("__range")) for k in range(1, RESTARTS + 1)])
    later = ranges.withColumn("__later", next_).select(*by, F.explode("__later").alias("__next")).filter("__next IS NOT NULL")
    carried = latest.join(later, by).select("model", "attempt", "idle", F.col("__next").alias("__range"), F.lit(True).alias("carried"))
    near = Window.partitionBy(*by).orderBy("attempt").rowsBetween(-RESTARTS, Window.currentRow)
    both = rows.withColumn("carried", F.lit(False)).unionByName(carried)
    ended = both.withColumn("__idle", F.sum("idle").over(near)).filter((F.col("__idle") > RESTARTS) & ~F.col("carried"))
    return ended.groupBy("model").agg(F.min("attempt").alias("attempt"))


def prefetch_download(attempts: DataFrame) -> DataFrame:
    """Per model whether files were added between the first attempt's start and the last one's end."""
    ends = attempts.groupBy("model").agg(F.min_by("cached_before", "attempt").alias("b"), F.max_by("cached_after", "attempt").alias("a"))
    return ends.select("model", download_flag(F.col("b"), F.col("a")).alias("downloaded"))


def first_load(attempts: DataFrame) -> DataFrame:
    """Per model the first measured load time together with its download flag, never of two attempts."""
    pair = F.min_by(F.struct("load_ms", "downloaded"), "attempt")
    got = attempts.filter("load_ms IS NOT NULL").groupBy("model").agg(pair.alias("p"))
    return got.select("model", F.col("p.load_ms").alias("first_load_ms"), F.col("p.downloaded").alias("first_load_downloaded"))


def token_text(tokens: DataFrame, *keys: str) -> DataFrame:
    """The tokens of each key joined in order, without a separator."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return tokens.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def phases(events: DataFrame) -> DataFrame:
    """Per model its phase after its last event: an error stays, whatever follows it."""
    failed = F.max(F.when(F.col("type") == "error", 1).otherwise(0)) == 1
    last = F.max_by("type", "seq")
    phase = F.when(failed, "error").when(last == "model-ready", "warming").when(last == "warmed", "running").when(last == "result", "running").when(last == "finished", "done").otherwise("loading")
    return events.groupBy("model").agg(phase.alias("phase"), F.min_by(F.when(F.col("type") == "error", F.col("text")), F.when(F.col("type") == "error", F.col("seq"))).alias("reason"))


def fail_all(events: DataFrame, items: DataFrame) -> DataFrame:
    """(model, id, reason) of the ids that are still open when a model's worker is lost, each with the first reason.

    items are the (model, id) asked for; events are phases()' rows with `id` on results, and a result after the loss doesn't count."""
    lost = events.filter("type = 'error'").groupBy("model").agg(F.min("seq").alias("lost"), F.min_by("text", "seq").alias("reason"))
    done = events.filter("type = 'result'").select("model", "id", "seq")
    done = done.join(lost.select("model", "lost"), "model").filter(F.col("seq") < F.col("lost")).select("model", "id").distinct()
    return items.join(lost.select("model", "reason"), "model").join(done, ["model", "id"], "left_anti").select("model", "id", "reason")


def browsers(attempts: DataFrame) -> DataFrame:
    """Per run the first attempt's browser, and those of its resumes stacked in order; nulls are passed over."""
    seen = F.array_sort(F.collect_list(F.when(F.col("browser").isNotNull(), F.struct("attempt", "browser"))))
    each = attempts.groupBy("run_id").agg(F.transform(seen, lambda x: x["browser"]).alias("b"))
    return each.select("run_id", F.get("b", F.lit(0)).alias("browser"), F.slice("b", F.lit(2), F.greatest(F.size("b") - 1, F.lit(0))).alias("resumed"))
