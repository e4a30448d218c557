"""Operators on small literal tables."""

import hashlib
import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from metrelle.functions import nested, text
from metrelle.operators import compare, contract, planning, scoring, sessions
from metrelle.plans import views
from metrelle.plans.registry import QUERIES
from metrelle.sources import results as sources
from metrelle.sources import tables
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = "model string, id string, dataset string, reference string, hypothesis string, duration_s double, decode_ms double, infer_ms double, error string, line_no long"


def results(spark, rows):
    return spark.createDataFrame([(m, i, d, a, b, 2.0, 100.0, 500.0, e, n) for n, (m, i, d, a, b, e) in enumerate(rows)], RESULT)


def test_summary_edge_rows(spark):
    rows = [
        ("m", "1", "a", "abcd", "abcd", None), ("m", "2", "a", "ab", "xy", None), ("m", "3", "a", "", "zz", None), ("m", "4", "a", "ab", "abcdefgh", None),
        ("m", "5", "a", "abcd", "", ""), ("n", "4", "a", "ab", "ab", None), ("n", "2", "a", "ab", "ab", None), ("k", "1", "b", "a", "a", "timeout"),
    ]
    facts = scoring.clip_facts(results(spark, rows)).cache()
    assert [r[0] for r in scoring.outlier_ids(facts).collect()] == ["4"]  # exactly 1.0 and an empty reference are none
    got = {(r["model"], r["dataset"]): r for r in scoring.group_summary(facts).collect()}
    m = got["m", "a"]
    assert (m["clips"], m["succeeded"], m["failed"], m["cer_norm_edits"], m["cer_norm_chars"], m["outliers"], m["kept_edits"], m["kept_chars"]) == (5, 4, 1, 10, 8, 1, 4, 6)
    assert m["median"] == 1.0 and m["rtf"] == 0.25 and m["audio_s"] == 8.0 and not m["overall"]
    assert got["n", None]["outliers"] == 1 and got["n", None]["overall"] and got["n", "a"]["kept_chars"] == 2
    k = got["k", "b"]
    assert k["median"] is None and k["rtf"] is None and k["cer_norm_chars"] == 0
    worst = [(r["model"], r["rank"], r["id"]) for r in scoring.worst(facts).orderBy("model", "rank").collect()]
    assert worst == [("m", 1, "4"), ("m", 2, "2"), ("m", 3, "1"), ("n", 1, "2"), ("n", 2, "4")]


def test_failed_ids_are_a_models_list_in_line_order(spark):
    rows = [("m", "b", "d", "x", "y", "e"), ("m", "a", "d", "x", "y", ""), ("n", "c", "d", "x", "y", None), ("m", "c", "d", "x", "y", "e")]
    same_line = results(spark, rows).withColumn("line_no", F.when(F.col("id") == "c", 1).otherwise(F.col("line_no")))
    assert [tuple(r) for r in scoring.failed_list(results(spark, rows)).collect()] == [("m", ["b", "a", "c"])]
    assert [tuple(r) for r in scoring.failed_list(same_line).collect()] == [("m", ["b", "a", "c"])]


def test_medians_equal_a_sort(spark):
    r = random.Random(9)
    rows = [(f"m{i % 5}", "d", str(i), r.choice([0, 1, 2, 3, 5, 8]), r.choice([0, 1, 2, 4, 7, None])) for i in range(300)] + [("none", "d", "x", 1, 0), ("one", "d", "x", 1, 3)]
    facts = spark.createDataFrame(rows, "model string, dataset string, id string, cer_norm_edits long, cer_norm_chars long").repartition(7)
    got = {x["model"]: x["median"] for x in scoring.medians(facts, "model").collect()}
    for m in {x[0] for x in rows}:
        rates = sorted(e / c for model, _, _, e, c in rows if model == m and c)
        assert got[m] == (0.5 * rates[(len(rates) - 1) // 2] + 0.5 * rates[len(rates) // 2] if rates else None)
    plan = scoring.medians(facts, "model")._jdf.queryExecution().executedPlan().toString().lower()
    assert "median" not in plan.replace("median#", "").replace("as median", "") and "percentile" not in plan and "collect" not in plan


def test_one_distance_per_metric_in_the_plan(spark):
    facts = scoring.clip_facts(results(spark, [("m", "1", "a", "x", "y", None)]))
    plan = scoring.group_summary(facts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("contains(") == 2 * len(scoring.NORMALIZERS)


def test_clips_are_dealt_out_before_models_answer(spark):
    """A table of one row group is read by one task, which made the answers of all models and looked at their texts."""
    plan = QUERIES["group_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    answers, clips = plan.index("REPARTITION_BY_COL"), plan.index("REPARTITION_BY_NUM")
    assert answers < plan.index("BroadcastNestedLoopJoin") < clips


def test_texts_are_normalised_once_below_a_filter_on_scores(spark):
    """F16: the filter on characters was pushed below the deal-out, where all texts were normalised a second time."""
    facts = scoring.clip_facts(results(spark, [("m", "1", "a", "x", "y", None)]))
    for found in (facts.filter("cer_norm_chars > 0").select("id", "cer_norm_edits"), scoring.worst(facts)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 2


def walk(rows, n, most):
    taken, excluded = [], 0
    for key, row, d in sorted((hashlib.sha256(f"x:{i}".encode()).hexdigest(), i, d) for i, d in rows):
        if len(taken) == n:
            break
        if d <= most:
            taken.append(row)
        else:
            excluded += 1
    return taken, excluded


@pytest.mark.parametrize("n", [1, 5, 30, 100])
def test_sampling_equals_a_walk(spark, n):
    r = random.Random(3)
    rows = [(i, r.choice([10.0, 30.0, 30.1, 50.0])) for i in range(60)]
    frame = spark.createDataFrame([("x", i, d) for i, d in rows], "dataset string, row long, duration_s double")
    taken, excluded = walk(rows, n, 30.0)
    assert [x["row"] for x in planning.take_within(frame, n).orderBy("place").collect()] == taken
    assert [tuple(x) for x in planning.excluded_before(frame, n).collect()] == [("x", len(taken), excluded)]


def test_planning(spark):
    items = spark.createDataFrame([("a", 1, "a1", 0, 1.1), ("a", 2, "a2", 1, 0.001), ("b", 1, "b1", 2, 2.0), ("z", 1, "z1", 3, 1.0)], "dataset string, place int, id string, ordinal int, duration_s double")
    sets = spark.createDataFrame([("b", 0), ("a", 1)], "dataset string, ordinal int")
    assert [x["id"] for x in planning.interleaved(items.drop("ordinal"), sets).orderBy("ordinal").collect()] == ["b1", "a1", "z1", "a2"]
    assert [x["id"] for x in planning.plan_slice(items, 3, 5).collect()] == ["z1"] and planning.plan_slice(items, 9).count() == 0 and planning.plan_slice(items, 0, 0).count() == 0
    assert {x["dataset"]: (x["n"], x["audio_s"]) for x in planning.planned_totals(items).collect()} == {"a": (2, 1.101), "b": (1, 2.0), "z": (1, 1.0)}
    assert planning.ids_digest(items).first()[0] == hashlib.sha256(b"a1\na2\nb1\nz1").hexdigest()
    many = spark.range(1000).selectExpr("999 - id AS ordinal", "concat('i', id) AS id").repartition(5)
    want = hashlib.sha256("\n".join(f"i{i}" for i in range(999, -1, -1)).encode()).hexdigest()
    assert planning.ids_digest(many).first()[0] == want == planning.ids_digest(many, rows=90).first()[0]
    assert planning.ids_digest(many.filter("id = 'x'")).first()[0] == hashlib.sha256(b"").hexdigest()
    plan = planning.ids_digest(many, rows=90)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    with pytest.raises(ValueError, match="dimension"):
        planning.dimension(many, 999)
    assert planning.pending(items, items.filter("place = 1")).select("id").collect()[0][0] == "a2"
    with pytest.raises(Exception, match="unknown dataset: z"):
        planning.require_known(items, sets, "dataset").collect()
    assert planning.or_default(items, sets, "dataset", "a").filter("dataset = 'a'").count() == 3


def test_sessions(spark):
    s = spark.createDataFrame(
        [("m", 1, "ok", "c", 1, 0, 2, 5.0, False), ("m", 2, "crashed", "c", 0, 2, 2, 6.0, True), ("m", 3, "crashed", "c", 0, 2, 3, None, None), ("m", 4, "ok", "d", 0, 3, 3, None, None)],
        "model string, attempt int, status string, id string, new_results int, cached_before int, cached_after int, load_ms double, downloaded boolean",
    )
    assert [tuple(r) for r in sessions.crash_failures(s).collect()] == [("m", "c", 2)]
    assert [tuple(r) for r in sessions.gave_up(s).collect()] == [("m", 4)]
    assert [tuple(r) for r in sessions.prefetch_download(s).collect()] == [("m", True)]
    assert [tuple(r) for r in sessions.first_load(s).collect()] == [("m", 5.0, False)]


def test_best_needs_a_rival_and_display_precision(spark):
    frame = spark.createDataFrame([("g", 0.10, 1), ("g", 0.10, 2), ("g", None, 3), ("h", 0.1, 4)], "g string, key double, i int")
    got = {r["i"]: r["b"] for r in frame.select("i", compare.best(F.col("key"), "g").alias("b")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


def board(spark, rows):
    return spark.createDataFrame([(m, i, label, None, None, n, 0 if failed is None else failed, None, cer, cer, None, None, rtf, None, missing) for i, (m, label, n, failed, cer, rtf, missing) in enumerate(rows)],
        "model string, place int, label string, planned int, dataset string, n long, failed long, outliers long, cer_strict double, cer_norm double, median double, kept double, rtf double, audio_s double, missing int")


@pytest.mark.parametrize(
    "rows, told",
    [
        ([("a", "A", None, None, None, None, None)], "まだ計測済みのモデルがありません。"),
        ([("a", "A", 10, 0, 0.2, 0.1, 3)], "全クリップの計測を終えたモデルはまだありません。A は未完了のため比較から除外しています。"),
        ([("a", "A", 10, 2, 0.2, 0.1, None)], "日本語の総合 CER（正規化）は A で 20.0%（10 クリップ、失敗 2 件を除く）。比較対象のモデルはまだ計測されていません。"),
        ([("a", "A", 10, 0, 0.2, 0.1, None), ("b", "B（x）", 10, 0, 0.3, 0.2, None)], "日本語の総合 CER（正規化）は A が最良（20.0%）で、速度も最速（RTF 0.100）。"),
        ([("a", "A", 10, 0, 0.2, 0.3, None), ("b", "B（x）", 10, 1, 0.2001, 0.2, None)], "日本語の総合 CER（正規化）は A と B（x）が同率で最良（20.0%、失敗したクリップを除く）、速度は B（x）が最速（RTF 0.200、失敗 1 件を除く）。"),
    ],
)
def test_headlines(spark, rows, told):
    assert views.headline(board(spark, rows), F.lit(10)).first()[0] == told


def test_headlines_of_three_fastest_are_pairs(spark):
    rows = [("a", "A", 10, 0, 0.2, 0.1, None), ("b", "B（x）", 10, 1, 0.3, 0.1, None), ("c", "C", 10, 0, 0.4, 0.1, None), ("d", "D", 5, 0, 0.1, 0.1, 5), ("e", "E", 5, 0, 0.1, 0.1, 5)]
    got = sorted(r[0] for r in views.headlines(board(spark, rows), F.lit(10)).collect())
    first, out = "日本語の総合 CER（正規化）は A が最良（20.0%）、速度は ", "は未完了のため比較から除外しています。"
    rest = ("A と B（x）が最速（RTF 0.100、失敗したクリップを除く）。", "A と C が最速（RTF 0.100）。")
    assert got == sorted(f"{first}{r}{m} {out}" for r in rest for m in "DE")
    for part in (rows[:2], [rows[0], ("b", "B", 10, 0, 0.3, 0.2, None)], [*rows[:2], rows[3]]):
        assert [r[0] for r in views.headlines(board(spark, part), F.lit(10)).collect()] == [views.headline(board(spark, part), F.lit(10)).first()[0]]
    assert views.headlines(board(spark, rows[3:]), F.lit(10)).count() == 0


def test_result_files(spark, tmp_path):
    row = {"id": "1", "dataset": "d", "reference": "r", "hypothesis": "h", "duration_s": 1.0, "segments": 1, "error": None}
    (tmp_path / "m%201.jsonl").write_text("\n".join([json.dumps(row), "", json.dumps(row | {"hypothesis": "late"}), json.dumps(row | {"id": "2", "error": ""}), '[1]', '{"dataset": "x"}', '{"id": "3", "hyp']))
    got = sorted((r["model"], r["id"], r["hypothesis"], r["error"]) for r in sources.read_results(spark, str(tmp_path)).collect())
    assert [g[1:] for g in got] == [("1", "h", None), ("2", "h", "")]
    assert sorted(r["id"] for r in sources.recorded_ids(spark, str(tmp_path)).collect()) == ["1", "2"]
    sources.write_atomic(str(tmp_path / "out" / "x.json"), "{}")
    assert (tmp_path / "out" / "x.json").read_text() == "{}" and sources.read_document(spark, str(tmp_path / "none.json")) is None
    runs = spark.createDataFrame([("20260101T000000Z",), ("latest",), ("20270101T000000",)], "run_id string")
    assert sources.latest_run(runs).first()[0] == "20260101T000000Z"
    assert [sources.is_newest(runs, x).first()[0] for x in ("20251231T000000Z", "20260101T000000Z")] == [False, True]


def test_arriving_rows_and_environment(spark, capsys):
    arrived = spark.createDataFrame([("1", 2.0, True), ("2", 3.0, None)], "id string, durationS double, warmup boolean")
    got = sources.raw_rows(sources.without_warmup(arrived), "m", "r", 5.0, None).collect()
    assert [r.asDict() for r in got] == [{"id": "2", "duration_s": 3.0, "model": "m", "run_id": "r", "load_ms": 5.0, "warmup_ms": None}]
    sources.logger("test").info("done", extra={"fields": {"n": 1}})
    told = json.loads(capsys.readouterr().err.splitlines()[-1])
    assert told["event"] == "done" and told["n"] == 1 and "ts" in told
    kind = "struct<chrome:struct<version:string,platform:string,platform_version:string,gpu:struct<vendor:string,architecture:string,device:string,description:string>>,host:struct<platform:string,machine:string>>"
    rows = [((("1", "mac", "2", ("v", "", None, "d")), ("", "arm")),), ((("1", "mac", None, None), None),)]
    told = spark.createDataFrame(rows, f"run {kind}").select(views.environment(F.col("run")).alias("e")).collect()
    assert [tuple(r["e"]) for r in told] == [("1", "mac 2", "v / d", "arm"), ("1", "mac", None, None)]


def test_contract(spark):
    docs = ['{"schema":1,"run_id":"r","n":3}', '{"schema":1,"run_id":"","n":-1,"ok":"x"}', '{"schema":2}', "no json", '{"schema":1,"run_id":"r","n":null}']
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").orderBy("i")
    got = [r[0] for r in frame.select(contract.faults(F.col("d"), {"run_id": "string"}, {"n": "number", "ok": "boolean"})).collect()]
    assert got == [[], ["run_id: string required", "n: number or null", "ok: boolean or null"], ["schema: 1 expected"], ["not JSON"], []]
    item = {"id": "a", "dataset": "d", "path": "p", "duration_s": 1.5, "reference": "r", "extra": 1}
    good = spark.createDataFrame([(json.dumps({"items": [item, item]}),)], "document string")
    assert [tuple(r) for r in contract.manifest_items(good).collect()] == [(i, "a", "d", "p", 1.5, "r") for i in range(2)]
    bad = spark.createDataFrame([(json.dumps({"items": [item, item | {"path": 3}]}),)], "document string")
    with pytest.raises(Exception, match=r"items\[1\]\.path"):
        contract.manifest_items(bad).collect()
    assert contract.key_paths(good.schema) == {"document"}


def test_resume_reads_what_the_sinks_write(spark, tmp_path):
    kept = {"dataset": "d", "reference": "r", "hypothesis": "h", "duration_s": 1.0, "error": None}
    names = ["a b", "a+b", "50%", "é:x", "m%201"]
    rows = [(m, f"{i}", "d", "r", "h", None) for m in names for i in (1, 2)]
    folder = str(tmp_path / "out")
    sources.append_results(results(spark, rows[:5]), folder)
    sources.append_results(results(spark, rows[5:]), folder)
    (tmp_path / "out" / "by hand+1.jsonl").write_text(json.dumps(kept | {"id": "9"}) + "\n")
    got = sorted((r["model"], r["id"], r["hypothesis"]) for r in sources.read_results(spark, folder).collect())
    assert got == sorted([(m, i, "h") for m, i, *_ in rows] + [("by hand+1", "9", "h")])
    assert {tuple(r) for r in sources.recorded_ids(spark, folder).collect()} == {(m, i) for m, i, _ in got}
    items = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    done = sources.recorded_ids(spark, folder).filter("model = 'a+b'")
    assert [r["id"] for r in planning.pending(items, done).collect()] == ["3"]


def test_lines_of_a_file_in_blocks_keep_their_order(spark, tmp_path):
    row = {"dataset": "d", "reference": "r", "duration_s": 1.0, "error": None}
    (tmp_path / "m.jsonl").write_text("".join(json.dumps(row | {"id": str(i % 500), "hypothesis": str(i)}) + "\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = sources.read_results(spark, str(tmp_path))
        assert sources._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 3
        got = {r["id"]: r["hypothesis"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {str(i): str(i) for i in range(500)}


def test_shards_have_one_row_number_in_the_order_of_their_names(spark, tmp_path):
    for name, lo, hi in (("train-00002", 70, 100), ("train-00000", 0, 40), ("train-00001", 40, 70), ("test-00000", 900, 910)):
        spark.range(lo, hi).selectExpr("id AS v", "id AS w").coalesce(1).write.parquet(str(tmp_path / "made" / name))
        (tmp_path / "data").mkdir(exist_ok=True)
        next((tmp_path / "made" / name).glob("*.parquet")).rename(tmp_path / "data" / f"{name}.parquet")
    found = tables.sharded(spark, str(tmp_path), "train", "v")
    assert sorted(map(tuple, found.collect())) == [(i, i) for i in range(100)] and found.columns == ["row", "v"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    with pytest.raises(FileNotFoundError):
        tables.shards(spark, str(tmp_path), "dev")


def test_latest_is_written_unless_a_newer_run_is_there(spark, tmp_path):
    runs = spark.createDataFrame([("20260101T000000Z",), ("latest",)], "run_id string")
    path = str(tmp_path / "latest.json")
    assert not sources.write_latest(path, runs, "20251231T000000Z", "{}") and not (tmp_path / "latest.json").exists()
    assert sources.write_latest(path, runs, "20260102T000000Z", "{}") and (tmp_path / "latest.json").read_text() == "{}"


def test_of_two_writers_the_older_never_wins(spark, tmp_path):
    folder = str(tmp_path / "published")
    ids = [f"202601{d:02d}T000000Z" for d in range(1, 13)]
    assert sources.latest_published(spark, folder) is None and sources.read_published(spark, folder).count() == 0
    order = random.Random(2).sample(ids, len(ids))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: sources.publish_run(spark, folder, i, f"document of {i}"), order))
    (tmp_path / "published" / "latest.json").write_text("no run")
    assert tuple(sources.read_published(spark, folder).first()) == (ids[-1], f"document of {ids[-1]}")
    assert not sources.publish_run(spark, folder, ids[0], "again") and (tmp_path / "published" / f"{ids[0]}.json").read_text() == f"document of {ids[0]}"
    assert not sources.publish(spark, f"{folder}/{ids[0]}.json", "kept", replace=False) and sources.publish(spark, f"{folder}/{ids[0]}.json", "replaced")
    assert (tmp_path / "published" / f"{ids[0]}.json").read_text() == "replaced" and not [p for p in (tmp_path / "published").iterdir() if p.name.startswith(".2") and p.suffix != ".crc"]


def test_faults_have_paths_into_arrays_and_maps(spark):
    declared = T.StructType.fromDDL("n bigint NOT NULL, items array<struct<id:string NOT NULL,at:array<double>>> NOT NULL, by map<string,struct<ok:boolean NOT NULL>>, note string")
    cases = {
        '{"n": 1, "items": []}': [], "no json": ["not JSON"], "[]": ["document: object required"], "null": ["document: object required"],
        '{"n": 1.5, "items": null, "note": 3}': ["n: whole number required", "items: array required", "note: string or null"],
        '{"n": 0, "items": [{"id": "a", "at": [1, -1, "x", 2.5]}, {"id": ""}, 4], "by": {"x y": {"ok": true}, "z": {}}, "more": 1}': ["items[0].at[1]: number or null", "items[0].at[2]: number or null", "items[1].id: string required", "items[2]: object or null", "by.z.ok: boolean required"],
    }
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(cases)], "i int, d string")
    got = {x["i"]: x["f"] for x in frame.select("i", contract.schema_faults(F.col("d"), declared).alias("f")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_reading_rate_from_supplied_tokens(spark):
    tokens = "array<struct<surface:string,reading:string>>"
    rows = [("m", "1", "a", "東京へ", "とうきょうえ", 1.0, 1.0, 1.0, None, 0, [("東京", "トウキョウ"), ("へ", "エ")], [("とうきょう", None), ("え", "エ")]), ("m", "2", "a", "x", "x", 1.0, 1.0, 1.0, None, 1, None, None)]
    facts = scoring.clip_facts(spark.createDataFrame(rows, RESULT + f", reference_tokens {tokens}, hypothesis_tokens {tokens}")).cache()
    got = {r["id"]: (r["cer_reading_edits"], r["cer_reading_chars"], r["cer_norm_edits"]) for r in facts.collect()}
    assert got == {"1": (0, 6, 6), "2": (None, None, 0)}
    declared = spark.createDataFrame([("m", 0, "M", None)], "model string, ordinal int, label string, planned int")
    shown = views.summary_table(views.board(facts, declared), ["a"], F.lit(2)).first()
    assert shown["reading_text"] == "0.0%" and "best_reading" in shown.asDict()


def test_distance_equals_the_whole_table(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abé") for _ in range(n))
    pairs = [("", ""), ("", "abc"), ("abc", "xabcx"), ("a" * 300, "a" * 150 + "b" * 150)]
    for _ in range(300):
        a = word(r.randint(0, 60))
        b = "".join(r.choice([c, c, c, c, c, c, "x", "", c + "y"]) for c in a) if r.random() < 0.7 else word(r.randint(0, 60))
        pairs.append((a, b))
    frame = spark.createDataFrame(pairs, "a string, b string").select(text.distance(F.col("a"), F.col("b")).alias("d"), F.levenshtein("a", "b").alias("whole"))
    assert all(x["d"] == x["whole"] for x in frame.collect())


def test_distance_of_long_texts_takes_no_table(spark):
    r = random.Random(6)
    long = "".join(r.choice("abcdé😀 ") for _ in range(6000))
    pairs = [(long, "".join(r.choice([c, c, c, "x", "", c + "y"]) for c in long)), (long, long.replace("a", "")), (long.replace("b", ""), long), ("", long), (None, "a"), ("a", None)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    made = frame.select("i", text.distance(F.col("a"), F.col("b")).alias("d"), F.levenshtein("a", "b").alias("whole"))
    assert all(x["d"] == x["whole"] for x in made.collect())
    plan = made.select("d")._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan.lower()  # whose cells grow with the square of a text's length


def test_plans_of_scores_shuffle_once_by_id(spark):
    facts = scoring.clip_facts(results(spark, [("m", "1", "a", "x", "y", None)]))
    declared = spark.createDataFrame([("m", 0, "M", 3)], "model string, ordinal int, label string, planned int")
    for made in (scoring.group_summary(facts), views.page_document(facts, declared), views.board(facts, declared)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("contains(") == 2 * len(scoring.NORMALIZERS)  # each metric's distance stands there once
        assert "REPARTITION_BY_NUM" not in plan
    physical = scoring.group_summary(facts)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("hashpartitioning(id") == 1


def test_report_and_conditions(spark):
    rows = [("m", "1", "a", "abcd", "abxd", None), ("m", "2", "b", "abcd", "abcd", None), ("m", "3", "b", "x", "", "bad | worse\nthan that")]
    facts = scoring.clip_facts(results(spark, rows)).cache()
    declared = spark.createDataFrame([("m", 0, "M", 3), ("k", 1, "K", 3)], "model string, ordinal int, label string, planned int")
    lines = views.report(views.board(facts, declared), scoring.worst(facts), results(spark, rows).filter("error IS NOT NULL").select("model", "id", "error"))
    kind = "struct<started_at:string,finished_at:string,commit:string,dirty:boolean,resumes:int,offset:int,limit:int,language:string,chrome:struct<version:string,platform:string,platform_version:string,gpu:struct<vendor:string,architecture:string,device:string,description:string>>,host:struct<platform:string,machine:string>>"
    run = ("t0", None, "abc", True, 2, 0, 5, "ja", ("1", None, None, None), None)
    first = spark.createDataFrame([(run,)], f"run {kind}").select(views.conditions(F.col("run"))).first()[0]
    out = views.markdown("R", lines, first).split("\n")
    assert "- 実行日時（UTC）: t0 〜 不明（途中から 2 回再開）" in out and "- git commit: `abc`（未コミットの変更あり）" in out and "- 評価範囲: offset 0, limit 5" in out
    assert "| model | a strict | a norm | b strict | b norm | 全体 strict | 全体 norm | RTF | 失敗 |" in out
    assert "| m | 25.0 | 25.0 | 0.0 | 0.0 | 12.5 | 12.5 | 0.250 | 1 |" in out and "| k | – | – | – | – | – | – | – | – |" in out
    assert "| m | b | 2 | 1 | 1 | 2.0 | 0.250 | 0.300 |" in out and "| m | 3 | bad \\| worse than that |" in out and "| m | a | 1 | 25.0 | 1 | 4 |" in out
    with pytest.raises(ValueError):
        views.markdown("R", lines, [], most=3)


def test_settings_arguments_and_flattened_values(spark):
    frame = spark.createDataFrame([(1, "de", "de", True), (2, "de", "fr", True), (3, None, "fr", False), (4, None, "fr", True)], "i int, old string, new string, exists boolean")
    made = nested.required({"language": nested.resolved(F.col("old"), F.col("new"), F.lit("ja"), F.col("exists")), "offset": nested.resolved(F.lit(0), F.when(F.col("i") == 2, 5), F.lit(0), F.col("exists"))})
    assert [r[0] for r in frame.filter("i IN (1, 3)").orderBy("i").select(made["language"]).collect()] == ["de", "fr"]
    with pytest.raises(Exception, match=r"language \(recorded: de\), offset \(recorded: 0\)"):
        frame.filter("i = 2").select(made["language"]).collect()
    with pytest.raises(Exception, match=r"language \(recorded: ja\)"):
        frame.filter("i = 4").select(made["language"]).collect()
    given = lambda values: spark.createDataFrame([(values,)], "v array<string>").select(nested.reassigned(F.col("v"), ["run", "model"])).first()[0]
    assert given(["r1", "m=x"]) == {"run": "r1", "model": "m=x"} and given(["model=m1"]) == {"run": "", "model": "m1"} and given(["model=a=b", "run=r"]) == {"run": "r", "model": "a=b"}
    for wrong in (["model=a", "model=b"], ["r1", "run=r2"]):
        with pytest.raises(Exception, match="is given"):
            given(wrong)
    json_text = spark.createDataFrame([('{"b":"x","a":"y"}',), ("3",), ("null",), ("[1]",), ('"t"',)], "j string")
    assert [r[0] for r in json_text.select(views.scalar_text(F.parse_json("j"))).collect()] == ["y / x", "3", None, None, "t"]


def test_lost_workers_browsers_and_phases(spark):
    events = spark.createDataFrame(
        [("m", 1, "model-ready", None, None), ("m", 2, "result", None, "a"), ("m", 3, "error", "lost", None), ("m", 4, "error", "later", None), ("m", 5, "result", None, "b"), ("k", 1, "model-ready", None, None),
         ("l", 1, "warmed", None, None), ("d", 1, "finished", None, None), ("n", 1, "other", None, None)],
        "model string, seq int, type string, text string, id string",
    )
    assert {r["model"]: (r["phase"], r["reason"]) for r in sessions.phases(events).collect()} == {"m": ("error", "lost"), "k": ("warming", None), "l": ("running", None), "d": ("done", None), "n": ("loading", None)}
    items = spark.createDataFrame([("m", "a"), ("m", "b"), ("m", "c"), ("k", "a")], "model string, id string")
    assert sorted(map(tuple, sessions.fail_all(events, items).collect())) == [("m", "b", "lost"), ("m", "c", "lost")]
    seen = spark.createDataFrame([("r", 2, "y"), ("r", 1, None), ("r", 3, "z"), ("s", 1, None)], "run_id string, attempt int, browser string")
    assert sorted(map(tuple, sessions.browsers(seen).collect())) == [("r", "y", ["z"]), ("s", None, [])]


def test_giving_up_in_ranges_of_attempts(spark):
    r = random.Random(6)
    rows = [(f"m{m}", a, r.choice([0, 0, None, 1])) for m in range(12) for a in sorted(r.sample(range(200), 40))]
    frame = spark.createDataFrame(rows, "model string, attempt long, new_results int")
    want = {}
    for m in {x[0] for x in rows}:
        streak = 0
        for _, a, n in sorted((x for x in rows if x[0] == m), key=lambda x: x[1]):
            streak = 0 if (n or 0) > 0 else streak + 1
            if streak > sessions.RESTARTS:
                want.setdefault(m, a)
    for span in (1, 7, 1000):
        assert {x["model"]: x["attempt"] for x in sessions.gave_up(frame, span).collect()} == want


def test_a_document_is_missing_broken_invalid_or_read(spark, tmp_path):
    schema = T.StructType.fromDDL("run_id string NOT NULL, n bigint")
    for name, body in (("broken", "{"), ("empty", ""), ("invalid", '{"n": "x"}'), ("read", '{"run_id": "a", "n": 3}')):
        (tmp_path / name).write_text(body)
    load = lambda name: sources.load_document(spark, str(tmp_path / name), schema)
    assert load("none")[0] == "missing" and load("broken")[0] == "broken" and load("empty")[0] == "broken"
    assert load("invalid") == ("invalid", None, ["run_id: string required", "n: whole number or null"])
    assert tuple(load("read").rows.first()) == ("a", 3)
    assert sources.load_document(spark, "nostore://x/y", schema).state == "unreachable"


def test_shown_times(spark):
    texts = ["2026-10-04T03:30:04Z", "2026-10-04T13:30:04+09:00", "soon", None, "2026-13-40T00:00:00Z"]
    got = [x[0] for x in spark.createDataFrame([(t,) for t in texts], "t string").select(views.shown_time(F.col("t"))).collect()]
    assert got == ["2026/10/04 3:30 UTC", "2026/10/04 4:30 UTC", "soon", "—", "2026-13-40T00:00:00Z"]
