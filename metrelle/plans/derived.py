"""Evaluation relations derived from the tables, the same in Spark and in DuckDB.

Clips are all turns of `conversations` with their whole texts; the role is the dataset. Three models answer with known
errors; m1 and m0 are declared in that order, m3 is declared and has no rows, m2 has rows and isn't declared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrelle.functions.text import item_id
from metrelle.sources.tables import table


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, id, dataset, reference, duration_s, ordinal)."""
    turns = table(spark, sf_dir, "conversations")
    row = (F.col("conv_id") * 100 + F.col("turn")).alias("row")
    made = turns.select(row, F.col("role").alias("dataset"), F.col("text").alias("reference"), F.round(F.length("text") / 15.0, 3).alias("duration_s"))
    return made.withColumns({"id": item_id(F.col("dataset"), F.col("row")), "ordinal": F.col("row")})


def results(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Result rows of three models; line_no is their order.

    dealt: clips are dealt out by id before the models answer. A table may be one file of one row group, which one task reads;
    that task then hands on each text once and makes no answers. The number is given, as few bytes would else be put into few tasks."""
    models = spark.createDataFrame([("m0",), ("m1",), ("m2",)], "model string")
    text = F.col("reference")
    said = F.when(F.col("model") == "m0", F.lower(text)).when(F.col("model") == "m1", F.replace(text, F.lit("e"), F.lit("")))
    said = said.when(F.col("row") % 7 == 0, F.concat(text, text, text)).otherwise(F.replace(text, F.lit(" "), F.lit("")))
    asked = clips(spark, sf_dir)
    if dealt:
        asked = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    rows = asked.crossJoin(F.broadcast(models))  # three fixed rows
    return rows.withColumns(
        {
            "hypothesis": said,
            "error": F.when(F.col("row") % 23 == 0, "timeout").when(F.col("row") % 29 == 0, ""),
            "infer_ms": F.col("duration_s") * 100 + (F.col("row") % 5) * 10,
            "decode_ms": F.col("duration_s") * 2,
            "line_no": F.col("row"),
            "load_ms": F.when(F.col("row") % 3 == 1, F.col("row") + 0.5),
            "warmup_ms": F.when(F.col("row") % 4 == 3, F.col("row") + 0.25),
        }
    ).drop("ordinal")


def declared(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("m1", 0, "Ostinato Grande（fp16）", 400), ("m0", 1, "Ostinato Grande（int8）", 600), ("m3", 2, "Ostinato Presto", None)], "model string, ordinal int, label string, planned int")


def datasets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("user", 0, "User turns", "r/u", "1"), ("assistant", 1, "Answers", "r/a", "2")], "dataset string, ordinal int, label string, repo string, revision string")


#: The non-ASCII letters of the tables' texts, and one-byte stand-ins that no text holds: DuckDB's levenshtein counts bytes.
LETTERS = "éèêçóñüäößíÉÈÊÇÓÑÜÄÖÍ"
_STAND_INS = "||".join(f"chr({i})" for i in [*range(1, 9), *range(14, 14 + len(LETTERS) - 8)])
_WS = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

SQL = f"""
clips AS (
  SELECT conv_id * 100 + turn AS row, printf('%s-%06d', role, conv_id * 100 + turn) AS id, role AS dataset, text AS reference,
         round(length(text) / CAST(15 AS DOUBLE), 3) AS duration_s, conv_id * 100 + turn AS ordinal FROM conversations),
results AS (
  SELECT c.*, model,
         CASE WHEN model = 'm0' THEN lower(reference) WHEN model = 'm1' THEN replace(reference, 'e', '')
              WHEN row % 7 = 0 THEN reference || reference || reference ELSE replace(reference, ' ', '') END AS hypothesis,
         CASE WHEN row % 23 = 0 THEN 'timeout' WHEN row % 29 = 0 THEN '' END AS error,
         duration_s * 100 + (row % 5) * 10 AS infer_ms, duration_s * 2 AS decode_ms, row AS line_no,
         CASE WHEN row % 3 = 1 THEN row + 0.5 END AS load_ms, CASE WHEN row % 4 = 3 THEN row + 0.25 END AS warmup_ms
  FROM clips c CROSS JOIN (VALUES ('m0'), ('m1'), ('m2')) m(model)),
declared(model, ordinal, label, planned) AS (VALUES ('m1', 0, 'Ostinato Grande（fp16）', 400), ('m0', 1, 'Ostinato Grande（int8）', 600), ('m3', 2, 'Ostinato Presto', NULL)),
datasets(dataset, ordinal, label, repo, revision) AS (VALUES ('user', 0, 'User turns', 'r/u', '1'), ('assistant', 1, 'Answers', 'r/a', '2'))
"""
FACTS_SQL = f"""{SQL},
plain AS (
  SELECT *, regexp_replace(reference, '{_WS}', '', 'g') AS sr, regexp_replace(hypothesis, '{_WS}', '', 'g') AS sh FROM results),
normal AS (
  SELECT *, regexp_replace(lower(sr), '[\\p{{P}}\\p{{S}}]', '', 'g') AS nr, regexp_replace(lower(sh), '[\\p{{P}}\\p{{S}}]', '', 'g') AS nh FROM plain),
facts AS (
  SELECT row, id, dataset, model, duration_s, infer_ms, decode_ms, error, line_no, load_ms, warmup_ms,
    CASE WHEN error IS NULL THEN CAST(levenshtein(translate(sr, '{LETTERS}', {_STAND_INS}), translate(sh, '{LETTERS}', {_STAND_INS})) AS BIGINT) END AS cer_strict_edits,
    CASE WHEN error IS NULL THEN CAST(length(sr) AS BIGINT) END AS cer_strict_chars,
    CASE WHEN error IS NULL THEN CAST(levenshtein(translate(nr, '{LETTERS}', {_STAND_INS}), translate(nh, '{LETTERS}', {_STAND_INS})) AS BIGINT) END AS cer_norm_edits,
    CASE WHEN error IS NULL THEN CAST(length(nr) AS BIGINT) END AS cer_norm_chars FROM normal),
outliers AS (SELECT DISTINCT id FROM facts WHERE cer_norm_chars > 0 AND cer_norm_edits > cer_norm_chars)
"""
