"""Result files: tolerant JSON-lines scans, documents, and sinks that never leave half a file."""

from __future__ import annotations

import json
import logging
import os
import re
import tempfile
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from metrelle.functions.text import is_run_id
from metrelle.operators.contract import schema_faults
from metrelle.operators.scoring import first_wins

RESULT = "id string, dataset string, reference string, hypothesis string, duration_s double, decode_ms double, infer_ms double, segments int, error string, run_id string, load_ms double, warmup_ms double"


RESULT_FILES = "{*.jsonl,part-*.json}"


def _percent_decoded(text: Column) -> Column:
    """%XX as the character it stands for; a plus sign stays."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def model_of(path: Column) -> Column:
    """The model of a file's path: its folder model=..., as the sinks write it, or else its stem. The folder's name is escaped
    by the writer, and the whole path once more."""
    plain = _percent_decoded(path)
    folder = F.regexp_extract(plain, "/model=([^/]+)/", 1)
    stem = F.regexp_extract(plain, r"([^/]+)\.jsonl$", 1)
    return F.when(folder != "", _percent_decoded(folder)).otherwise(F.nullif(stem, F.lit("")))


def _placed(text: DataFrame) -> DataFrame:
    """(model, line_no, value) of lines: line_no orders a model's lines by file, then block of the file, then place within it, so
    that a large file can be read in blocks."""
    place = F.struct(F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = text.select(model_of(F.col("_metadata.file_path")).alias("model"), place.alias("line_no"), "value")
    return lines.filter((F.trim("value") != "") & F.col("model").isNotNull())


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all result files below a folder."""
    return _placed(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", RESULT_FILES).text(path))


def parsed(lines: DataFrame) -> DataFrame:
    """S3: results of lines; blank and broken lines dropped."""
    rows = lines.withColumn("r", F.from_json("value", RESULT + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return rows.filter("r._bad IS NULL AND r.id IS NOT NULL").select("model", "line_no", "r.*").drop("_bad")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all files, model from the file's name or folder; the first row of an id kept."""
    return first_wins(parsed(_lines(spark, path)))


def recorded_ids(spark: SparkSession, path: str) -> DataFrame:
    """(model, id) of every line that is an object with an id, whatever else is wrong with it."""
    ids = _lines(spark, path).select("model", F.get_json_object("value", "$.id").alias("id"))
    return ids.filter("id IS NOT NULL").distinct()


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """One nested JSON document; None where there is none."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return None
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


class Loaded(NamedTuple):
    """What came of loading a document: `read`; `missing`, which is no error; or `unreachable`, `broken`, `invalid`, with errors."""

    state: str
    rows: DataFrame | None
    errors: list[str]


def load_document(spark: SparkSession, path: str, schema: StructType) -> Loaded:
    """A JSON document on any store, told apart by what is wrong with it; it is one document, so one row comes here."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
            return Loaded("missing", None, [])
        text = spark.read.text(path, wholetext=True)
        found = text.select(schema_faults(F.col("value"), schema).alias("faults")).first()
    except (Py4JJavaError, PySparkException) as e:
        return Loaded("unreachable", None, [str(e).splitlines()[0]])
    faults = found["faults"] if found else ["not JSON"]
    if faults == ["not JSON"]:
        return Loaded("broken", None, faults)
    if faults:
        return Loaded("invalid", None, faults)
    return Loaded("read", text.select(F.from_json("value", schema).alias("d")).select("d.*"), [])


def raw_rows(arrived: DataFrame, model: str, run_id: str, load_ms: float | None, warmup_ms: float | None) -> DataFrame:
    """Results as they arrive, with names in snake case and the session's columns added."""
    names = [re.sub("(?<!^)(?=[A-Z])", "_", c).lower() for c in arrived.columns]
    added = {"model": F.lit(model), "run_id": F.lit(run_id), "load_ms": F.lit(load_ms).cast("double"), "warmup_ms": F.lit(warmup_ms).cast("double")}
    return arrived.toDF(*names).withColumns(added)


def without_warmup(arrived: DataFrame) -> DataFrame:
    """X11: results without those of the warm-up, marked in column `warmup`."""
    return arrived.filter(~F.coalesce("warmup", F.lit(False))).drop("warmup")


class _Json(logging.Formatter):
    """A record as one JSON object: time, event and the fields given as `extra={"fields": ...}`."""

    def format(self, record: logging.LogRecord) -> str:
        made = {"ts": self.formatTime(record, "%Y-%m-%dT%H:%M:%S") + f".{int(record.msecs):03d}", "event": record.getMessage()}
        return json.dumps(made | getattr(record, "fields", {}), ensure_ascii=False)


def logger(name: str = "metrelle") -> logging.Logger:
    """A logger of one JSON object per event on stderr."""
    found = logging.getLogger(name)
    if not found.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(_Json())
        found.addHandler(handler)
        found.setLevel(logging.INFO)
        found.propagate = False
    return found


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share, which goes when the driver ends: below spark.checkpoint.dir, and only
    in a local session, where none is named, below the machine's own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"{named or tempfile.mkdtemp(prefix='metrelle-')}/results-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def kept(rows: DataFrame, *by: str) -> DataFrame:
    """rows written as Parquet to a new shared folder, one below it for each value of `by`, and read again; a lost executor reads
    files instead of making them anew."""
    folder = shared_folder(rows.sparkSession)
    rows.write.partitionBy(*by).parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def append_results(rows: DataFrame, path: str) -> None:
    """Rows appended as JSON lines under one folder per model, which S3 and S4 read; the committer publishes whole files only."""
    rows.drop("line_no").write.mode("append").partitionBy("model").json(path)


def write_atomic(path: str, text: str) -> None:
    """A small local document, replaced at once by renaming."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def latest_run(runs: DataFrame) -> DataFrame:
    """One row, the greatest valid run id or null."""
    return runs.filter(is_run_id(F.col("run_id"))).agg(F.max("run_id").alias("run_id"))


def is_newest(runs: DataFrame, run_id: str) -> DataFrame:
    """One row, whether the run is at least as new as every scored run with a valid id."""
    return latest_run(runs).select(F.coalesce(F.lit(run_id) >= F.col("run_id"), F.lit(True)).alias("newest"))


def write_latest(path: str, runs: DataFrame, run_id: str, document: str) -> bool:
    """Writes the document of the latest run unless a newer one has been scored; whether it was written."""
    if not is_newest(runs, run_id).first()["newest"]:
        return False
    write_atomic(path, document)
    return True


def _hadoop(spark: SparkSession, path: str):
    """The path in its store, qualified, with the store's file system and context."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    target = fs.Path(path)
    store = target.getFileSystem(conf)
    target = store.makeQualified(target)
    return target, store, fs.FileContext.getFileContext(target.toUri(), conf)


def publish(spark: SparkSession, path: str, text: str, replace: bool = True) -> bool:
    """A document on any store Spark reaches, whole or not there at all: written beside its place and renamed. Without `replace`
    a document that is there stays; whether this one was published."""
    target, store, context = _hadoop(spark, path)
    store.mkdirs(target.getParent())
    temporary = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = store.create(temporary, False)
    out.write(bytearray(text.encode()))
    out.close()
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if replace else kind.NONE
    try:
        context.rename(temporary, target, how)
    except Exception as e:
        store.delete(temporary, False)
        if not replace and "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def publish_run(spark: SparkSession, folder: str, run_id: str, document: str) -> bool:
    """A run's document as a version of its own, created if it is absent; whether it is the latest now.

    The latest is the greatest valid run id that is there, so writers need no lock: whichever comes last, an older run never wins."""
    publish(spark, f"{folder}/{run_id}.json", document, replace=False)
    return latest_published(spark, folder) == run_id


def latest_published(spark: SparkSession, folder: str) -> str | None:
    """The greatest valid run id among the versions in a folder, or None."""
    target, store, _ = _hadoop(spark, folder)
    if not store.exists(target):
        return None
    names = [status.getPath().getName() for status in store.listStatus(target)]
    valid = [n.removesuffix(".json") for n in names if re.fullmatch(r"[0-9]{8}T[0-9]{6}Z\.json", n)]
    return max(valid, default=None)


def read_published(spark: SparkSession, folder: str) -> DataFrame:
    """One row (run_id, document) of the latest version; none where there is no version."""
    run_id = latest_published(spark, folder)
    if run_id is None:
        return spark.createDataFrame([], "run_id string, document string")
    return spark.read.text(f"{folder}/{run_id}.json", wholetext=True).select(F.lit(run_id).alias("run_id"), F.col("value").alias("document"))
