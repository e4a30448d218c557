"""Result sets for presentation, over one row per model and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrelle.functions import numbers as n
from metrelle.functions.text import escape_cell, join_parts, listed, said_of, short_commit, short_text
from metrelle.operators import compare, scoring
from metrelle.operators.planning import dimension

#: Sentences and words of the published page; fixed values.
NONE_MEASURED = "まだ計測済みのモデルがありません。"
NONE_COMPLETE = "全クリップの計測を終えたモデルはまだありません。"
NO_RIVAL = "比較対象のモデルはまだ計測されていません。"
EXCLUDED = "未完了のため比較から除外"
CER = "日本語の総合 CER（正規化）は "


def board(facts: DataFrame, declared: DataFrame, *extras: scoring.Extra) -> DataFrame:
    """A row per model and group (each dataset, and overall with dataset null), metrics null where there is none."""
    groups = scoring.group_summary(facts, *extras)
    added = [x.name for x in extras]
    models = scoring.all_models(declared, facts.select("model").distinct()).select("model", "place", F.coalesce("label", "model").alias("label"), "planned")
    names = facts.select("dataset").distinct().union(facts.sparkSession.createDataFrame([(None,)], "dataset string"))
    frame = models.crossJoin(dimension(names))
    joined = frame.alias("f").join(groups.alias("g"), F.expr("f.model = g.model AND f.dataset <=> g.dataset"), "left")
    rate = lambda m: scoring.rate(F.col(f"{m}_edits"), F.col(f"{m}_chars"))
    made = joined.select(
        "f.model", "f.place", "f.label", "f.planned", "f.dataset", F.col("g.clips").alias("n"), "g.failed", "g.outliers",
        *[n.rounded(rate(m)).alias(m) for m in scoring.metrics_of(facts)], n.rounded(F.col("median")).alias("median"),
        n.rounded(scoring.rate(F.col("kept_edits"), F.col("kept_chars"))).alias("kept"), n.rounded(F.col("rtf")).alias("rtf"), n.rounded(F.col("rtf_with_decode")).alias("rtf_with_decode"), n.rounded(F.col("audio_s"), 3).alias("audio_s"),
        *[f"g.{c}" for c in added],
    )
    return made.withColumn("missing", scoring.missing(F.col("planned"), F.coalesce("n", F.lit(0))))


def overall(rows: DataFrame, expected: Column) -> DataFrame:
    """The overall rows of board() with `comparable` and the display keys of those that may compete; expected may be a column of rows."""
    own = rows.filter("dataset IS NULL").withColumn("comparable", compare.comparable(F.col("n"), F.col("missing"), expected))
    compete = lambda c: F.when(F.col("comparable"), c)
    return own.withColumns({"cer_key": compete(n.as_shown(F.col("cer_norm") * 100, 1)), "strict_key": compete(n.as_shown(F.col("cer_strict") * 100, 1)), "rtf_key": compete(n.as_shown(F.col("rtf"), 3))})


def status_text(measured: Column, missing: Column, count: Column, expected: Column) -> Column:
    """V5: what keeps a model from being compared, or null."""
    few = F.when(F.coalesce(missing, F.lit(0)) > 0, F.concat(F.lit("未実行 "), n.count_text(missing), F.lit(" 件")))
    few = few.when(count != expected, F.concat(n.count_text(expected), F.lit(" クリップ中 "), n.count_text(count), F.lit(" クリップ")))
    return F.when(~measured, F.lit("未計測")).otherwise(F.concat(few, F.lit(f"（{EXCLUDED}）")))


def summary_table(rows: DataFrame, names: list[str], expected: Column) -> DataFrame:
    """V1: a row per model: its normalised rate per dataset, all rates overall, speed, load time and failures as text, the best ones flagged."""
    own = overall(rows, expected)
    reading = "cer_reading" in rows.columns
    if reading:
        own = own.withColumn("reading_key", F.when(F.col("comparable"), n.as_shown(F.col("cer_reading") * 100, 1)))
    keys = ["cer", "strict", "rtf", *["reading"] * reading]
    for key in keys:
        own = own.withColumn(f"best_{key}", compare.best(F.col(f"{key}_key")))
    load = [n.page_fixed(F.col("load_s"), 1).alias("load_text")] * ("load_s" in rows.columns)
    own = own.select(
        "model", "place", "label", status_text(F.col("n").isNotNull(), F.col("missing"), F.col("n"), expected).alias("status"),
        n.page_percent(F.col("cer_strict")).alias("strict_text"), n.page_percent(F.col("cer_norm")).alias("cer_text"), n.page_fixed(F.col("rtf"), 3).alias("rtf_text"),
        *[n.page_percent(F.col("cer_reading")).alias("reading_text")] * reading, *load, n.count_text(F.col("failed")).alias("failed_text"), *[f"best_{k}" for k in keys],
    )
    each = rows.filter("dataset IS NOT NULL").groupBy("model").pivot("dataset", names).agg(n.page_percent(F.max("cer_norm")))
    return own.join(each, "model").orderBy("place")


#: What the headline says of a model.
_SAID = ("label", "failed", "n", "cer_norm", "rtf")


def headline(rows: DataFrame, expected: Column) -> DataFrame:
    """V3: one row, the sentence on the most accurate and the fastest among the comparable models, ties named together."""
    return _sentence(_named(rows, expected))


def headlines(rows: DataFrame, expected: Column) -> DataFrame:
    """V3 as rows: headline() for each most accurate model, each pair of the first of the fastest models with another of them (or the
    only one), and each model left out; no row where no model is comparable."""
    one = _named(rows, expected)
    places = lambda who: F.filter(F.sequence(F.lit(0), F.size(f"{who}_label")), lambda i: i < F.size(f"{who}_label"))
    each = lambda who: F.transform(places(who), lambda i: F.array(i))
    taken = lambda c: F.transform("__at", lambda i: F.get(F.col(c), i))
    only = F.size("fast_label") == 1
    pairs = F.transform(F.filter(places("fast"), lambda i: only | (i > 0)), lambda i: F.when(only, F.array(i)).otherwise(F.array(F.lit(0), i)))
    for who, choices in (("win", each("win")), ("fast", pairs), ("out", F.when(F.size("out_label") > 0, each("out")).otherwise(F.array(F.array().cast("array<int>"))))):
        one = one.withColumn("__at", F.explode(choices)).withColumns({c: taken(c) for c in (f"{who}_{w}" for w in _SAID)})
    return _sentence(one)


def _named(rows: DataFrame, expected: Column) -> DataFrame:
    """One row: arrays of what is said of all measured models, those that are comparable and that aren't, the most accurate and the fastest."""
    own = overall(rows, expected).filter("cer_norm IS NOT NULL")
    own = own.withColumns({"win": compare.best(F.col("cer_key")), "fast": compare.best(F.col("rtf_key"))})

    def in_order(when: Column, what: str) -> Column:
        taken = F.array_sort(F.collect_list(F.when(when, F.struct("place", what))))
        return F.transform(taken, lambda x: x[what])

    ok = F.col("comparable")
    columns = {}
    for name, when in (("all", F.lit(True)), ("ok", ok), ("out", ~ok), ("win", F.col("win")), ("fast", F.col("fast"))):
        columns |= {f"{name}_{w}": in_order(when, w) for w in _SAID}
    return own.agg(*[c.alias(k) for k, c in columns.items()])  # a handful of models


def _sentence(one: DataFrame) -> DataFrame:
    """The sentence of each row of _named()'s arrays."""

    def without_failures(who: str) -> Column:
        """What the sentence says of failed clips of these models: their number for one model, none where there are none."""
        total = F.aggregate(f"{who}_failed", F.lit(0).cast("long"), lambda t, x: t + F.coalesce(x, F.lit(0)))
        number = F.when(F.size(f"{who}_failed") == 1, F.concat(F.lit(" "), n.count_text(total), F.lit(" 件"))).otherwise("したクリップ")
        return F.when(total > 0, F.concat(F.lit("、失敗"), number, F.lit("を除く"))).otherwise("")

    first = lambda c: F.get(F.col(c), F.lit(0))
    left_out = F.when(F.size("out_label") == 0, "").otherwise(F.concat(said_of(listed(F.col("out_label")), "は"), F.lit(f"{EXCLUDED}しています。")))
    clips = F.concat(F.lit("（"), n.count_text(first("ok_n")), F.lit(" クリップ"), without_failures("ok"), F.lit("）"))
    single = F.concat(F.lit(CER), said_of(first("ok_label"), "で"), F.lit(" "), n.page_percent(first("ok_cer_norm")), clips, F.lit("。"), F.when(left_out == "", NO_RIVAL).otherwise(left_out))
    tie = F.size("win_label") > 1
    accuracy = F.concat(F.lit(CER), said_of(listed(F.col("win_label")), "が"), F.when(tie, "同率で最良（").otherwise("最良（"), n.page_percent(first("win_cer_norm")), without_failures("win"), F.lit("）"))
    rtf = n.page_fixed(first("fast_rtf"), 3)
    same = ~tie & (F.size("fast_label") == 1) & (first("fast_label") == first("win_label"))
    both = F.concat(accuracy, F.lit("で、速度も最速（RTF "), rtf, F.lit("）。"), left_out)
    apart = F.concat(accuracy, F.lit("、速度は "), said_of(listed(F.col("fast_label")), "が"), F.lit("最速（RTF "), rtf, without_failures("fast"), F.lit("）。"), left_out)
    text = (
        F.when(F.size("all_label") == 0, NONE_MEASURED).when(F.size("ok_label") == 0, F.concat(F.lit(NONE_COMPLETE), left_out)).when(F.size("ok_label") == 1, single)
        .when(F.size("fast_label") == 0, F.concat(accuracy, F.lit("。"), left_out)).when(same, both).otherwise(apart)
    )
    return one.select(text.alias("headline"))


def chart_series(rows: DataFrame) -> DataFrame:
    """Long-format bars in percent with value labels, failure notes and one axis for all groups."""
    value = F.col("cer_norm") * 100
    most = F.greatest(F.lit(0.0), F.max(value).over(Window.partitionBy(F.lit(0))))  # rows are models by groups
    fails = F.col("failed") > 0
    label = F.when(value.isNotNull(), F.concat(n.fixed(value, 1), F.lit("%"))).when(fails, "計測不可").otherwise("未計測")
    note = F.when(fails, F.concat(F.lit("失敗 "), n.count_text(F.col("failed")), F.lit(" 件"))).otherwise("")
    axis = n.nice_axis(most)
    return rows.select("model", "dataset", value.alias("value"), label.alias("label"), note.alias("note"), axis["max"].alias("axis_max"), F.size(axis["ticks"]).alias("ticks"))


def run_outlier_sentence(number: Column) -> Column:
    """V8: one sentence on the number of run-wide outliers; empty if it isn't known."""
    return F.when(number.isNull(), "").otherwise(F.concat(F.lit("この実行で外れ値として記録されたクリップは計 "), n.count_text(number), F.lit(" 件です（ID は集計 JSON の outlier_ids）。")))


def incomplete(models: DataFrame) -> DataFrame:
    """V7: models with rows missing or a status other than done; an unknown status is fine."""
    return models.filter((F.col("missing") != 0) | (F.col("status") != "done"))


def scalar_text(values: Column) -> Column:
    """The text of one setting from a VARIANT: an object's values joined in the order of its keys, a scalar as text, else null."""
    kind = F.schema_of_variant(values)
    parts = F.map_values(F.try_variant_get(values, "$", "map<string,string>"))
    return F.when(kind.startswith("OBJECT"), join_parts(parts)).when(~kind.rlike("^(ARRAY|VOID)"), F.try_variant_get(values, "$", "string"))


def environment(run: Column) -> Column:
    """Where a run was made, from its struct of chrome and host; the host's name of the platform goes first."""
    chrome, host = run["chrome"], run["host"]
    told = F.nullif(F.concat_ws(" ", F.nullif(chrome["platform"], F.lit("")), F.nullif(chrome["platform_version"], F.lit(""))), F.lit(""))
    gpu = chrome["gpu"]
    return F.struct(
        chrome["version"].alias("chrome"), F.coalesce(F.nullif(host["platform"], F.lit("")), told).alias("platform"),
        join_parts(F.array(*[gpu[k] for k in ("vendor", "architecture", "device", "description")])).alias("gpu"), host["machine"].alias("machine"),
    )


#: Headings, column heads and words of the report; fixed values.
SECTIONS = ("実行条件", "精度と速度", "件数と速度の内訳", "外れ値の影響（感度分析）", "誤りの大きい例", "失敗したクリップ")
BREAKDOWN_HEAD = ("model", "dataset", "件数", "成功", "失敗", "音声 秒", "RTF", "RTF（デコード込み）")
OUTLIER_HEAD = ("model", "dataset", "norm（全件）", "クリップ別 norm の中央値", "外れ値の件数", "norm（外れ値を除く・参考）")
WORST_HEAD = ("model", "dataset", "id", "cer_norm", "編集数", "参照文字数")
FAILED_HEAD = ("model", "id", "エラー")
OVERALL, UNKNOWN = "全体", "不明"


def table_line(*cells: Column) -> Column:
    """A row of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit(n.NO_VALUE_REPORT)) for c in cells]), F.lit(" |"))


def conditions(run: Column) -> Column:
    """The lines of the report's first section, from a run's struct."""
    told = environment(run)
    text = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(UNKNOWN))
    again = F.when(run["resumes"] > 0, F.format_string("（途中から %d 回再開）", run["resumes"])).otherwise("")
    scope = F.concat(F.lit("offset "), F.coalesce(run["offset"], F.lit(0)).cast("string"), F.coalesce(F.concat(F.lit(", limit "), run["limit"].cast("string")), F.lit("")))
    return F.array(
        F.concat(F.lit("- 実行日時（UTC）: "), text(run["started_at"]), F.lit(" 〜 "), text(run["finished_at"]), again),
        F.concat(F.lit("- git commit: `"), text(run["commit"]), F.lit("`"), F.when(run["dirty"], "（未コミットの変更あり）").otherwise("")),
        F.concat(F.lit("- Chrome: "), text(told["chrome"])), F.concat(F.lit("- GPU（WebGPU アダプタ）: "), text(told["gpu"])),
        F.concat(F.lit("- OS / 機種: "), text(told["platform"]), F.lit(" / "), text(told["machine"])), F.concat(F.lit("- 評価範囲: "), scope), F.concat(F.lit("- 言語: "), text(run["language"])),
    )


def dataset_lines(datasets: DataFrame) -> DataFrame:
    """V6: (ordinal, label, text) of the datasets in declared order: what each is, its clips, minutes, what was left out, its source.

    datasets: (dataset, ordinal, label, description, repo, revision, n, audio_s, excluded), of which all after dataset may be null."""
    said = F.when(F.nullif(F.col("description"), F.lit("")).isNotNull(), F.concat("description", F.lit("。")))
    facts = F.array(
        F.concat(n.count_text(F.col("n")), F.lit(" クリップ")), F.concat(F.lit("音声 "), n.page_fixed(F.col("audio_s") / 60, 1), F.lit(" 分")), F.concat(F.lit("30 秒超で除外 "), n.count_text(F.col("excluded")), F.lit(" 件")),
    )
    known = F.filter(F.arrays_zip(facts.alias("text"), F.array(F.col("n").isNotNull(), F.col("audio_s").isNotNull(), F.col("excluded").isNotNull()).alias("there")), lambda x: x["there"])
    told = F.when(F.size(known) > 0, F.concat(F.array_join(F.transform(known, lambda x: x["text"]), "、"), F.lit("。")))
    source = F.concat("repo", F.coalesce(F.concat(F.lit(" @ "), short_commit(F.col("revision"))), F.lit("")))
    text = F.concat_ws(" ", F.nullif(F.concat_ws("", said, told), F.lit("")), source)
    return datasets.select("ordinal", F.coalesce("label", "dataset").alias("label"), text.alias("text"))


def shown_time(text: Column) -> Column:
    """The page's form of an ISO time, in UTC; other text as it is, a dash for null."""
    at = F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), text))
    local = F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))
    return F.when(text.isNull(), n.NO_VALUE).otherwise(F.coalesce(F.concat(F.date_format(local, "yyyy/MM/dd H:mm"), F.lit(" UTC")), text))


def report_notes(models: DataFrame, outliers: DataFrame) -> DataFrame:
    """(section, place, line) of what stands beside the tables: in section 2 the models that aren't complete, with what is
    missing and how they ended, in order; in section 3 the number of outliers, one row of `n`."""
    short = incomplete(models)
    status = F.coalesce("status", F.lit(UNKNOWN))
    line = F.concat(F.lit("- "), "model", F.lit(": 未実行 "), F.coalesce(n.count_text(F.col("missing")), F.lit(UNKNOWN)), F.lit(" 件、終了状態 `"), status, F.lit("`"))
    listed_ = short.select(F.lit(2).alias("section"), F.col("place").cast("long").alias("place"), line.alias("line"))
    head = short.agg(F.count("*").alias("k")).filter("k > 0").select(F.lit(2), F.lit(-1).cast("long"), F.lit("未完了のモデル（予定件数に届いていない）:"))
    return listed_.union(head).union(outliers.select(F.lit(3), F.lit(0).cast("long"), F.concat(F.lit("外れ値: "), n.count_text(F.col("n")), F.lit(" 件"))))


def report(rows: DataFrame, worst: DataFrame, failures: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """(section, place, line) of the report's five tables, from board(), the worst clips with their chars, and failed rows.

    place orders the lines of a section: heads, then models in order, groups in the order that datasets (dataset, ordinal) declares,
    others by name, with the overall one last. No text of a clip is in it."""
    spark = rows.sparkSession
    last = 1 << 30
    if datasets is None:
        datasets = spark.createDataFrame([], "dataset string, ordinal int")
    declared = F.broadcast(dimension(datasets.select("dataset", F.col("ordinal").cast("long").alias("__at"))))
    put = lambda df: df.join(declared, "dataset", "left").withColumn("__at", F.coalesce("__at", F.lit(last).cast("long")))
    rows, worst = put(rows), put(worst)
    failures = failures.withColumn("__at", F.lit(0).cast("long"))
    group = F.coalesce("dataset", F.lit(OVERALL))
    fixed = lambda c, digits: F.coalesce(F.call_function("format_number", F.col(c), F.lit("0." + "0" * digits)), F.lit(n.NO_VALUE_REPORT))
    percent = lambda c: n.report_percent(F.col(c))
    order = lambda *more: F.struct(F.lit(1).alias("kind"), F.col("place").cast("long").alias("model"), F.col("dataset").isNull().alias("last"), F.col("__at").alias("at"), F.coalesce("dataset", F.lit("")).alias("dataset"), *more)
    line = lambda section, place, *cells: [F.lit(section).alias("section"), place.alias("place"), table_line(*cells).alias("line")]
    rank = lambda c: F.col(c).cast("long").alias("rank")
    name = lambda c: F.col(c).cast("string").alias("id")
    none = (F.lit(0).cast("long").alias("rank"), F.lit("").alias("id"))
    metrics, load = [m for m in ("cer_strict", "cer_norm", "cer_reading") if m in rows.columns], "load_s" in rows.columns
    each = F.array_sort(F.collect_list(F.struct(F.col("dataset").isNull().alias("last"), F.col("__at"), group.alias("g"), F.array(*[percent(m) for m in metrics]).alias("c"))))
    whole = lambda c: F.max(F.when(F.col("dataset").isNull(), F.col(c))).alias(c)
    wide = rows.groupBy("model", "place").agg(F.flatten(F.transform(each, lambda x: x["c"])).alias("cells"), whole("rtf"), whole("failed"), *[whole("load_s")] * load).withColumn("dataset", F.lit("").cast("string")).withColumn("__at", F.lit(0).cast("long"))
    cells = F.concat(F.array("model"), "cells", F.array(fixed("rtf", 3), *[fixed("load_s", 1)] * load, F.coalesce(F.col("failed").cast("string"), F.lit(n.NO_VALUE_REPORT))))
    measured = rows.filter("n IS NOT NULL")
    places = rows.select("model", "place").distinct()
    lines = [
        wide.select(F.lit(1).alias("section"), order(*none).alias("place"), F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")).alias("line")),
        measured.select(*line(2, order(*none), F.col("model"), group, F.col("n"), F.col("n") - F.col("failed"), F.col("failed"), fixed("audio_s", 1), fixed("rtf", 3), fixed("rtf_with_decode", 3))),
        measured.select(*line(3, order(*none), F.col("model"), group, percent("cer_norm"), percent("median"), F.col("outliers"), percent("kept"))),
        worst.join(places, "model").select(*line(4, order(rank("rank"), name("id")), F.col("model"), F.col("dataset"), F.col("id"), percent("rate"), F.col("edits"), F.col("chars"))),
        failures.join(places, "model").withColumn("dataset", F.lit("")).select(*line(5, order(F.lit(0).cast("long").alias("rank"), name("id")), F.col("model"), F.col("id"), escape_cell(short_text(F.col("error"))))),
    ]
    head_place = F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("model"), F.lit(False).alias("last"), F.lit(0).cast("long").alias("at"), F.lit("").alias("dataset"), *none)
    named = rows.select(F.col("dataset").isNull().alias("last"), F.col("__at").alias("at"), group.alias("g")).distinct().agg(F.array_sort(F.collect_list(F.struct("last", "at", "g"))).alias("g"))
    short = [m.removeprefix("cer_") for m in metrics]
    first = F.concat(F.array(F.lit("model")), F.flatten(F.transform("g", lambda x: F.array(*[F.concat(x["g"], F.lit(f" {m}")) for m in short]))), F.array(F.lit("RTF"), *[F.lit("load 秒")] * load, F.lit("失敗")))
    lines.append(named.select(F.lit(1).alias("section"), head_place.alias("place"), F.concat(F.lit("| "), F.array_join(first, " | "), F.lit(" |")).alias("line")))
    fixed_heads = [(i, "| " + " | ".join(head) + " |") for i, head in ((2, BREAKDOWN_HEAD), (3, OUTLIER_HEAD), (4, WORST_HEAD), (5, FAILED_HEAD))]
    lines.append(spark.createDataFrame(fixed_heads, "section int, line string").select("section", head_place.alias("place"), "line"))
    out = lines[0]
    for more in lines[1:]:
        out = out.union(more)
    return out


def markdown(title: str, lines: DataFrame, first: list[str], most: int = 100_000) -> str:
    """The text of a report, from report() and the lines of its first section; a section without rows is left out. More
    lines than `most` are an error, not a cut."""
    found = lines.orderBy("section", "place").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has {most} lines at most")
    out = [f"# {title}", "", f"## {SECTIONS[0]}", "", *first]
    for section in range(1, len(SECTIONS)):
        own = [r["line"] for r in found if r["section"] == section]
        if len(own) > 1:
            out += ["", f"## {SECTIONS[section]}", "", own[0], "|" + "---|" * (own[0].count(" | ") + 1), *own[1:]]
    return "\n".join([*out, ""])


def page_document(facts: DataFrame, declared: DataFrame) -> DataFrame:
    """The published document as JSON text: ids and numbers only, models in order. The facts are read once: the ids of
    outliers are an aggregate of the overall groups, each told once, by its first model."""
    rows = board(facts, declared, scoring.OUTLIER_IDS)
    group = F.struct("n", "failed", "cer_strict", "cer_norm", "rtf", "audio_s", F.col("median").alias("cer_norm_median"), F.col("outliers").alias("cer_norm_outliers"), F.col("kept").alias("cer_norm_excluding_outliers"))
    each = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("dataset").isNotNull() & F.col("n").isNotNull(), F.struct("dataset", group.alias("g"))))))
    whole = F.col("dataset").isNull()
    models = rows.groupBy("model", "place", "label", "planned").agg(each.alias("per_dataset"), F.max(F.when(whole & F.col("n").isNotNull(), group)).alias("overall"), F.flatten(F.collect_list(F.when(whole, F.col("outlier_ids")))).alias("ids"))
    text = F.to_json(F.struct(F.col("model").alias("key"), "label", "planned", "per_dataset", "overall"))
    one = models.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("t")))), lambda x: x["t"]).alias("models"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("outlier_ids"))
    return one.select(F.concat(F.lit('{"schema":1,"outlier_cer_norm_threshold":1.0,"outlier_ids":'), F.to_json("outlier_ids"), F.lit(',"models":['), F.array_join("models", ","), F.lit("]}")).alias("document"))
