"""Table loaders: one parquet table per name below a folder or a store path."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name`; a file or a folder of part files, on any file system Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards(spark: SparkSession, folder: str, split: str) -> list[str]:
    """The paths data/<split>-*.parquet below a folder, in the order of their names; none is an error."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/data/{split}-*.parquet")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    paths = sorted(status.getPath().toString() for status in found or [])
    if not paths:
        raise FileNotFoundError(f"no data/{split}-*.parquet in {folder}")
    return paths


def sharded(spark: SparkSession, folder: str, split: str, *columns: str) -> DataFrame:
    """The columns of all shards and `row`, their number over the shards in the order of their names, from 0.

    A row's number is its place in its file, which the reader knows, and the rows of the files before it. Those are told by the
    files' footers, as a count of no columns reads nothing else, and stand in the plan as a list of one number a file: rows are
    read once, and neither joined nor shuffled. A shard may be a file or a folder of files."""
    rows = spark.read.parquet(*shards(spark, folder, split))
    file = F.col("_metadata.file_path")
    sizes = sorted(map(tuple, rows.groupBy(file.alias("file")).count().collect()))  # a row a file
    before, total = [], 0
    for name, n in sizes:
        before.append((name, total))
        total += n
    known = F.from_json(F.lit(json.dumps(dict(before))), "map<string,long>") if before else F.lit(None).cast("map<string,long>")
    return rows.select((F.element_at(known, file) + F.col("_metadata.row_index")).alias("row"), *columns)
