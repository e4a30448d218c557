"""Streams over files: once-only ingestion across restarts, interrupts, the run loop, token text."""

import json
import os
import random
import time

import pytest
from metrelle.operators import sessions
from metrelle.sources import results as sources
from metrelle.streaming import ingest
from metrelle.streaming import runs as stream_runs
from pyspark.sql import functions as F


@pytest.fixture(autouse=True)
def few_partitions(spark):
    own = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a store each
    yield
    spark.conf.set("spark.sql.shuffle.partitions", own)


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps({"id": i, "dataset": "d", "reference": "r", "hypothesis": h}) for i, h in rows) + '\n{"id": "broken')


def test_once_across_a_restart_and_read_back(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    plan = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    run = lambda: ingest.record(ingest.read_lines(spark, str(source)), plan, out, checkpoint).awaitTermination()
    lines(source / "m 1.jsonl", [("1", "x"), ("1", "y"), ("2", "x")])
    run()
    assert sources.read_results(spark, out).count() == 2
    lines(source / "model=m 1" / "part-0.json", [("2", "z"), ("3", "x")])
    lines(source / "n+.jsonl", [("1", "x")])
    run()
    want = [("m 1", "1"), ("m 1", "2"), ("m 1", "3"), ("n+", "1")]
    assert sorted((r["model"], r["id"]) for r in sources.read_results(spark, out).collect()) == want
    assert sorted(map(tuple, sources.recorded_ids(spark, out).collect())) == want
    lines(source / "o.jsonl", [("9", "x")])
    with pytest.raises(Exception, match="unknown id"):
        run()


def test_interrupt_ends_at_a_batch_boundary_and_goes_on(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    n = 8
    plan = spark.createDataFrame([(str(i),) for i in range(n)], "id string")
    for i in range(n):
        lines(source / f"m{i}.jsonl", [(str(i), "x"), (str(i), "again")])
    start = lambda files, **trigger: ingest.record(ingest.read_lines(spark, str(source), files), plan, out, checkpoint, **trigger)
    query = start(1, processingTime="0 seconds")
    while not (query.lastProgress or {}).get("numInputRows"):
        time.sleep(0.05)
    ingest.interrupt(query)
    first = sources.read_results(spark, out).count()
    assert not query.isActive and query.exception() is None and 0 < first < n
    start(None).awaitTermination()
    assert sorted(r["id"] for r in sources.read_results(spark, out).collect()) == sorted(str(i) for i in range(n))


SPLITS = [1, 4]
SESSION = ["asked", "asked", "clip", "model-ready", "warmed", "result", "finished", "session", "error"]


def runs(r, models=6, n=60):
    """Random events of some models, in order of seq."""
    rows = []
    for m in range(models):
        kinds = [k for k in SESSION if k != "error"] if m % 3 == 0 else SESSION + ["session"] * 4
        for seq in range(n):
            kind = r.choice(kinds) if kind_late(kinds, seq, n) else r.choice([k for k in kinds if k != "error"])
            status = r.choice(["crashed", "crashed", "clip-timeout"])
            rows.append((f"m{m}", seq, kind, f"c{r.randrange(12)}" if kind in ("asked", "clip", "result") or kind == "session" and r.random() < 0.8 else None, status if kind == "session" else f"reason {seq}", r.choice([0, 0, 0, 2]) if kind == "session" else None))
    return rows


def kind_late(kinds, seq, n):
    return "error" not in kinds or seq > n // 2


def write_events(folder, rows, name):
    folder.mkdir(exist_ok=True)
    names = ["model", "seq", "type", "id", "text", "new_results"]
    (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(names, x))) for x in rows))


@pytest.mark.parametrize("parts", SPLITS)
def test_the_run_loop_equals_the_batch_queries_in_any_split_across_restarts(spark, tmp_path, parts):
    """Every part is a run of its own from the checkpoint, so streaks, crash counts and open clips cross restarts."""
    rows = runs(random.Random(7))
    order = sorted(rows, key=lambda x: x[1])
    source, out = tmp_path / "in", str(tmp_path / "out")
    for p in range(parts):
        write_events(source, order[p * len(order) // parts : (p + 1) * len(order) // parts], f"part{p}")
        stream = spark.readStream.schema(stream_runs.EVENTS).json(str(source))
        stream_runs.started(stream_runs.run_loop(stream), out, str(tmp_path / "cp")).awaitTermination()
    got = [tuple(x) for x in spark.read.schema(stream_runs.OUT).json(out).select("model", "seq", "kind", "id", "text").collect()]
    events = spark.createDataFrame(rows, stream_runs.EVENTS)
    asked = events.filter("type = 'asked'").select("model", "id").distinct()
    ends = events.filter("type = 'session'").select("model", F.col("seq").alias("attempt"), F.col("text").alias("status"), "id", "new_results")
    steps = events.filter("type NOT IN ('asked', 'clip', 'session')")

    by = lambda kind: [x for x in got if x[2] == kind]
    last = {}
    for x in sorted(by("phase"), key=lambda x: x[1]):
        last[x[0]] = x[4]
    assert last == {x["model"]: x["phase"] for x in sessions.phases(steps).collect()}
    assert {(x[0], x[1]) for x in by("gave-up")} == {tuple(x) for x in sessions.gave_up(ends).collect()}
    failed = {(x[0], x[3]): x[4] for x in by("failed")}
    assert len(failed) == len(by("failed"))  # a clip fails once
    lost = {(x["model"], x["id"]): x["reason"] for x in sessions.fail_all(steps, asked).collect()}
    crashed = {(x["model"], x["id"]) for x in sessions.crash_failures(ends).collect()}
    assert {k for k, text in failed.items() if text.startswith("reason")} <= set(lost) <= set(failed)
    assert all(lost[k] == text for k, text in failed.items() if text.startswith("reason"))
    open_ = {(m, i) for m, i in crashed if not any(x[0] == m and x[3] == i and x[2] == "result" for x in rows)}
    assert {k for k, text in failed.items() if text.startswith("crashed")} <= crashed and open_ <= set(failed)


def test_a_streak_is_cut_by_a_restart_in_its_middle(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    ends = [("m", i, "session", "c1", "crashed", n) for i, n in enumerate([0, 0, 1, 0, 0])] + [("m", 5, "session", "c2", "load", 0)]
    for part, rows in enumerate([ends[:4], ends[4:5], ends[5:]]):
        write_events(source, rows, f"p{part}")
        stream = spark.readStream.schema(stream_runs.EVENTS).json(str(source))
        stream_runs.started(stream_runs.run_loop(stream), out, str(tmp_path / "cp")).awaitTermination()
    got = sorted((x["seq"], x["kind"], x["id"]) for x in spark.read.schema(stream_runs.OUT).json(out).collect())
    assert got == [(1, "failed", "c1"), (5, "gave-up", None)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_timers_fail_the_clip_at_work_and_tell_of_a_load_that_hangs(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    write_events(source, [("m", 0, "asked", "c1", None, None), ("m", 1, "warmed", None, None, None), ("m", 2, "clip", "c1", None, None), ("n", 0, "asked", "c1", None, None), ("o", 0, "finished", None, None, None)], "a")
    stream = spark.readStream.schema(stream_runs.EVENTS).json(str(source))
    query = stream_runs.started(stream_runs.run_loop(stream, stall_ms=300, load_ms=600), out, str(tmp_path / "cp"), processingTime="100 milliseconds")
    found = []
    try:
        for _ in range(120):
            found = sorted(tuple(x) for x in spark.read.schema(stream_runs.OUT).json(out).filter("kind <> 'phase'").select("model", "kind", "id").collect()) if os.path.isdir(out) else []
            if len(found) > 1 or not query.isActive:
                break
            time.sleep(0.25)
    finally:
        query.stop()
    assert found == [("m", "failed", "c1"), ("n", "stalled", None)]


def test_token_text_is_told_once_and_forgotten(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    schema = "id string, seq long, type string, text string, tokens long"
    parts = [
        [("s", 2, "token", "b", None), ("s", 9, "end", None, 3), ("t", 0, "token", "x", None), ("u", 0, "token", "lost", None)],
        [("s", 1, "token", "a ", None), ("t", 5, "end", None, None)],
        [("s", 4, "token", "c", None), ("u", 1, "failed", "worker", None), ("v", 0, "end", None, 0)],
    ]
    for p, rows in enumerate(parts):
        (source / f"{p}.json").write_text("\n".join(json.dumps(dict(zip(["id", "seq", "type", "text", "tokens"], x))) for x in rows))
        found = stream_runs.token_text(spark.readStream.schema(schema).json(str(source)))
        query = stream_runs.started(found, out, str(tmp_path / "cp"))
        query.awaitTermination()
    got = sorted((x["id"], x["text"], x["error"]) for x in spark.read.schema("id string, text string, error string").json(out).collect())
    assert got == [("s", "a bc", None), ("t", "x", None), ("u", None, "worker"), ("v", "", None)]
    left = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "parts").load()
    assert left.count() == 0
