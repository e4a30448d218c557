"""The run loop as a stream: one state machine a model, with timers, crash counts and open clips that outlive a restart.

Events are rows (model, seq, type, id, text, new_results), in order of seq for a model from one batch to the next:

- `asked` (id): a clip that the model is to answer; `clip` (id): the clip now at work; `result` (id): its result;
- `model-ready`, `warmed`, `finished`: steps of a session;
- `session` (text: its status, id: the clip at work, new_results: rows that it recorded, those made here included): a session ended;
- `error` (text: the reason): the worker was lost.

What comes out are rows (model, seq, kind, id, text): kind `phase` whenever a model's phase changes, `failed` for the failure
row of a clip, `gave-up` once a model is given up. State is a row a model and one for each of its clips, as the plan bounds."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from metrelle.operators.sessions import CRASHES, RESTARTS

EVENTS = "model string, seq long, type string, id string, text string, new_results int"
OUT = "model string, seq long, kind string, id string, text string"
STALL_MS, LOAD_MS = 5 * 60 * 1000, 40 * 60 * 1000
_PHASES = {"model-ready": "warming", "warmed": "running", "result": "running", "finished": "done"}
_START = {"phase": None, "reason": None, "current": None, "streak": 0, "gave_up": False, "seq": 0, "since": 0}
_STORE = "spark.sql.streaming.stateStore.providerClass"


class RunLoop(StatefulProcessor):
    """X4-X7, X9, X10 for one model."""

    def __init__(self, stall_ms: int = STALL_MS, load_ms: int = LOAD_MS):
        self.stall_ms, self.load_ms = stall_ms, load_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "phase string, reason string, current string, streak int, gave_up boolean, seq long, since long")
        self.clips = handle.getMapState("clips", "id string", "asked boolean, closed boolean, crashes int")

    def _clip(self, id_: str) -> list:
        return list(self.clips.getValue((id_,))) if self.clips.containsKey((id_,)) else [False, False, 0]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        model = key[0]
        s = dict(zip(_START, self.run.get() if self.run.exists() else _START.values()))
        for e in sorted(rows, key=lambda e: e["seq"]):
            yield from self._event(model, s, e)
        s["since"] = timerValues.getCurrentProcessingTimeInMs()
        self.run.update(tuple(s.values()))
        self._watch(s)

    def _event(self, model: str, s: dict, e: Row) -> Iterator[Row]:
        out = lambda kind, id_=None, text=None: Row(model=model, seq=e["seq"], kind=kind, id=id_, text=text)
        kind, id_ = e["type"], e["id"]
        s["seq"] = e["seq"]
        lost = s["phase"] == "error"
        if kind == "asked":
            _, closed, crashes = self._clip(id_)
            if lost and not closed:
                yield out("failed", id_, s["reason"])
            self.clips.updateValue((id_,), (True, closed or lost, crashes))
        elif kind == "clip":
            s["current"] = id_
        elif kind == "result" and not lost:
            asked, _, crashes = self._clip(id_)
            self.clips.updateValue((id_,), (asked, True, crashes))
            s["current"] = None
        elif kind == "session":
            if e["text"] == "crashed" and id_ is not None:
                asked, closed, crashes = self._clip(id_)
                if crashes + 1 == CRASHES and not closed:
                    yield out("failed", id_, f"crashed: {crashes + 1} times")
                self.clips.updateValue((id_,), (asked, closed or crashes + 1 >= CRASHES, crashes + 1))
            s["current"] = None
            s["streak"] = 0 if (e["new_results"] or 0) > 0 else s["streak"] + 1
            if s["streak"] > RESTARTS and not s["gave_up"]:
                s["gave_up"] = True
                yield out("gave-up", None, e["text"])
        elif kind == "error" and not lost:
            s["reason"] = e["text"]
            for (open_,), (asked, closed, crashes) in list(self.clips.iterator()):
                if asked and not closed:
                    self.clips.updateValue((open_,), (asked, True, crashes))
                    yield out("failed", open_, e["text"])
        if kind in ("asked", "clip", "session"):
            return
        phase = "error" if lost or kind == "error" else _PHASES.get(kind, "loading")
        if phase != s["phase"]:
            s["phase"] = phase
            yield out("phase", None, phase)

    def _watch(self, s: dict) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not s["gave_up"] and s["phase"] not in ("done", "error"):
            self.handle.registerTimer(s["since"] + (self.load_ms if s["phase"] in (None, "loading") else self.stall_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.run.exists():
            return
        s = dict(zip(_START, self.run.get()))
        now, id_ = timerValues.getCurrentProcessingTimeInMs(), s["current"]
        if id_ is not None:
            asked, closed, crashes = self._clip(id_)
            if not closed:
                self.clips.updateValue((id_,), (asked, True, crashes))
                yield Row(model=key[0], seq=s["seq"], kind="failed", id=id_, text=f"timeout: {round((now - s['since']) / 1000)} s")
        else:
            yield Row(model=key[0], seq=s["seq"], kind="stalled", id=None, text=f"{s['phase'] or 'loading'}: {round((now - s['since']) / 1000)} s")
        s["current"], s["since"] = None, now
        self.run.update(tuple(s.values()))

    def close(self) -> None:
        pass


class TokenText(StatefulProcessor):
    """The text of one id, told once at its end; nothing of the id is kept afterwards."""

    def init(self, handle) -> None:
        self.parts = handle.getMapState("parts", "seq long", "text string")
        self.end = handle.getValueState("end", "type string, text string, tokens long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for e in rows:
            if e["type"] == "token":
                self.parts.updateValue((e["seq"],), (e["text"],))
            else:
                self.end.update((e["type"], e["text"], e["tokens"]))
        if not self.end.exists():
            return
        kind, reason, tokens = self.end.get()
        if kind == "end":
            held = sorted((seq, part) for (seq,), (part,) in self.parts.iterator())
            if tokens is not None and len(held) < tokens:
                return  # some come in a later batch
            yield Row(id=key[0], text="".join(p or "" for _, p in held), error=None)
        else:
            yield Row(id=key[0], text=None, error=reason)
        self.parts.clear()
        self.end.clear()

    def close(self) -> None:
        pass


def run_loop(events: DataFrame, stall_ms: int = STALL_MS, load_ms: int = LOAD_MS) -> DataFrame:
    """Rows of OUT for a stream of EVENTS; start it with started(), which names the store of its state."""
    return events.groupBy("model").transformWithState(RunLoop(stall_ms, load_ms), OUT, "append", "processingTime")


def token_text(tokens: DataFrame) -> DataFrame:
    """(id, text, error) for a stream of (id, seq, type, text, tokens): types `token`, `end` with the number of tokens if it is
    known, and `failed` with its reason in text."""
    return tokens.groupBy("id").transformWithState(TokenText(), "id string, text string, error string", "append", "none")


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """A query takes its settings when it starts; the session's own come back afterwards."""
    own = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if own is None else spark.conf.set(_STORE, own)


def started(found: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends the rows of run_loop() or token_text() to JSON files, each row once across restarts.

    Without a trigger it takes what is there as one batch and ends; timers need a query that goes on, with processingTime."""
    writer = found.writeStream.outputMode("append").format("json").option("path", path).option("checkpointLocation", checkpoint)
    with _state_store(found.sparkSession):
        return writer.trigger(**(trigger or {"once": True})).start()  # availableNow never ends while timers may fire
