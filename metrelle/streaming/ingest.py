"""Structured Streaming for results as they arrive: once-only ingestion that can be interrupted and goes on.

There is no event time; state is bounded by the number of planned clips, as the plan bounds the ids."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from metrelle.sources.results import RESULT_FILES, model_of, parsed


def read_lines(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Results from JSON-lines files as they appear, so many a batch, the model from the file's name or folder; broken lines are
    dropped."""
    reader = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", RESULT_FILES)
    text = (reader if files is None else reader.option("maxFilesPerTrigger", files)).text(path)
    lines = text.select(model_of(F.col("_metadata.file_path")).alias("model"), F.lit(None).alias("line_no"), "value")
    return parsed(lines.filter(F.trim("value") != "")).drop("line_no")


def once(rows: DataFrame) -> DataFrame:
    """The first arrival of each (model, id); it holds across restarts from the checkpoint."""
    return rows.dropDuplicates(["model", "id"])


def record(rows: DataFrame, plan: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends planned rows once to `out`; an id that isn't planned stops the query."""
    from metrelle.operators.planning import require_known

    def write(batch: DataFrame, number: int) -> None:
        # One folder per batch: a batch that is run again after a failure replaces what it wrote before.
        require_known(batch, plan.select("id"), "id").write.mode("overwrite").partitionBy("model").json(f"{out}/batch={number}")

    return once(rows).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def interrupt(query: StreamingQuery, patience: float = 600.0) -> None:
    """Ends a stream at the next batch boundary, whatever data still waits; the same checkpoint goes on from there.

    The batch at work is let finish, for so many seconds at most. Should the one after it have begun, it is run again by the next
    start, which replaces what it wrote."""
    batch = lambda: (query.lastProgress or {}).get("batchId", -1)
    until, at = time.monotonic() + patience, batch()
    while query.isActive and query.status["isTriggerActive"] and batch() == at and time.monotonic() < until:
        time.sleep(0.02)
    query.stop()
