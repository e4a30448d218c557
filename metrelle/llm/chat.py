"""Chat formatting by prefix-target expansion: every assistant turn is an example whose context is all turns before it.

A conversation is formatted once, turn after turn, in the template

    <|im_start|>role\\n text <|im_end|>\\n        (without the spaces)

and an example is a prefix of it: the characters [0, chars), of which [loss_start, loss_end), its last turn's text, is
trainable. So the expansion, whose texts grow with the square of a conversation's turns, is kept in space that grows with the
turns: `pieces` holds each formatted turn with its place, `examples` one row an assistant turn, and `texts` writes examples
out where a trainer wants whole texts. A conversation that doesn't end in an assistant turn has one more example of all of
its turns with nothing to train, so that what is written holds every conversation whole.

Turns are dealt out by range of (conv_id, turn), so a conversation of any length is formatted by as many tasks as it takes;
places within a conversation follow from the totals of its parts, and only conversations that lie in several parts need them.
The digest reads formatted text back and hashes it in order: a task hands a hash state on after STEP characters of one
conversation, so a step of a long one is bounded too.

Control strings inside texts: wherever `<`, any number of backslashes and `|` follow each other, one more backslash is put
behind the `<`, so that no text holds `<|`; reading takes one away. Roles are escaped so that they hold neither line feeds nor
`|`.

Defined results: a null text or role is empty; rows of one conversation go by turn, nulls first, then by role and text;
repeated rows are turns of their own; rows without conv_id are one conversation, null; a role other than `assistant`, in
whatever case, isn't trained; texts of any length are formatted whole; an empty table gives no rows but those of the
conversation that `digest` adds; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metrelle.functions.digest import Sha256
from metrelle.llm.common import cut, small, small_batches, stored

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
#: Characters of one conversation after which a task hands its hash on.
STEP = 256 << 20

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)
_ROLE = {"\\": "\\\\", "\n": "\\n", "|": "\\p"}
_ROLE_BACK = {v: k for k, v in _ROLE.items()}


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\\n|]", lambda m: _ROLE[m[0]], role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\[\\np]", lambda m: _ROLE_BACK[m[0]], role)


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PIECES of sorted turns; places and characters are counted from where the part begins in a conversation."""
    part, conv, place, start = TaskContext.get().partitionId(), (), 0, 0
    for batch in batches:
        ids, rows = batch.column(0).to_pylist(), []
        for id_, role, text in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if conv != (id_,):
                conv, place, start = (id_,), 0, 0
            head, body = f"{START}{escape_role(role)}\n", escape(text)
            piece = f"{head}{body}{END}\n"
            trained = role == TRAINED
            rows.append((id_, part, place, piece, start, start + len(piece), *((start + len(head), start + len(head) + len(body)) if trained else (None, None))))
            place, start = place + 1, start + len(piece)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 8, kinds)], [c.split()[0] for c in PIECES.split(", ")])


PIECES = "conv_id long, part int, place long, piece string, start long, end long, loss_start long, loss_end long"


def pieces(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, place, piece, start, end, loss_start, loss_end): every turn formatted, in the order of (part, place).

    place and the offsets, in characters, count within the whole conversation; loss is null where nothing is trained."""
    small_batches(conversations.sparkSession)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    order = ["conv_id", "turn", "role", "text"]
    ranged = turns.repartitionByRange("conv_id", "turn", "role", F.xxhash64("text")).sortWithinPartitions(*order)
    held = stored(ranged.select("conv_id", "role", "text").mapInArrow(_formatted, PIECES))
    parts = held.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.max("end").alias("chars"))
    several = parts.groupBy("conv_id").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("conv_id").alias("c"))
    spread = cut(parts.join(small(several), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi"))  # two parts share one conversation at most
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = spread.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.sum("n").over(before).alias("n"), F.sum("chars").over(before).alias("chars"))
    moved = held.join(small(cut(base)), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    on = lambda c, by: (F.col(c) + F.coalesce(F.col(by), F.lit(0))).alias(c)
    return moved.select("conv_id", "part", on("place", "n"), "piece", *[on(c, "chars") for c in ("start", "end", "loss_start", "loss_end")])


def examples(formatted: DataFrame) -> DataFrame:
    """(conv_id, target, chars, loss_start, loss_end, place, start): one example an assistant turn, and one of a conversation's end that
    has no target after the last of them; place and start are those of its last turn. formatted is what pieces() gave."""
    last = formatted.groupBy("conv_id").agg(F.max(F.struct("place", "start", "end", "loss_start")).alias("l")).filter("l.loss_start IS NULL")
    none = F.lit(None).cast("long")
    ends = last.select("conv_id", none.alias("target"), F.col("l.end").alias("chars"), none.alias("loss_start"), none.alias("loss_end"), "l.place", "l.start")
    return formatted.filter("loss_start IS NOT NULL").select("conv_id", F.col("place").alias("target"), F.col("end").alias("chars"), "loss_start", "loss_end", "place", "start").unionByName(ends)


def texts(formatted: DataFrame) -> DataFrame:
    """examples() with the text of each written out: a group an example, of as many turns as it has."""
    wanted = examples(formatted).drop("place", "start").withColumnRenamed("conv_id", "c")
    both = wanted.join(formatted.select("conv_id", "place", "piece", "end"), F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("end") <= F.col("chars")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"]), "")
    return both.groupBy("conv_id", "target", "chars", "loss_start", "loss_end").agg(text.alias("text"))


class _Reader:
    """Reads formatted text and examples back: turns by the template's marks, what is trained by the characters under an example's mask."""

    def __init__(self, state: tuple | None = None):
        turns, loss, self.n_turns, self.loss_chars, self.formatted, self.end = state or (None, None, 0, 0, 0, 0)
        self.turns, self.loss, self.rest, self.mask, self.ended = Sha256(turns), Sha256(loss), "", (None, None), False

    def expand(self, chars: int, loss_start: int | None, loss_end: int | None) -> None:
        """An example, before the piece of its last turn."""
        self.formatted += chars
        self.mask, self.ended = (loss_start, loss_end), loss_start is None

    def take(self, piece: str, start: int, loss_start: int | None, loss_end: int | None) -> None:
        self.rest += piece
        while found := _TURN.match(self.rest):
            self.n_turns += 1
            self.turns.update(f"{unescape_role(found[1])}\n{unescape(found[2])}\n".encode())
            self.rest = self.rest[found.end() :]
        self.end = start + len(piece)
        self.mask = (None, None)
        if loss_start is not None:
            trained = unescape(piece[loss_start - start : loss_end - start])
            self.loss_chars += len(trained)
            self.loss.update(trained.encode())

    def state(self) -> tuple:
        return self.turns.state(), self.loss.state(), self.n_turns, self.loss_chars, self.formatted, self.end

    def row(self) -> tuple:
        if self.rest:
            raise ValueError(f"formatted text ends within a turn: {self.rest[:80]!r}")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted


_READ = "conv_id long, turns binary, loss binary, n_turns long, loss_chars long, formatted long, end long, open boolean, turns_sha256 string, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of _READ for each conversation, whose pieces come one after another; the state is that after all of them."""
    conv, reader, rows = (), None, []
    kinds = (pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.bool_(), pa.string(), pa.string(), pa.int64())
    names = [c.split()[0] for c in _READ.split(", ")]
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * len(kinds), kinds)], names)

    def close() -> None:
        if reader is not None:
            n, turns, chars, loss, formatted = reader.row()
            rows.append((conv[0], *reader.state(), reader.ended, turns, loss, formatted))

    for batch in batches:
        for r in batch.to_pylist():
            if conv != (r["conv_id"],):
                close()
                conv, reader = (r["conv_id"],), _Reader(tuple(r["state"].values()) if r["state"] else None)
            if r["piece"] is None:
                reader.expand(r["chars"], r["loss_start"], r["loss_end"])
            else:
                reader.take(r["piece"], r["start"], *reader.mask)
        yield pack()
        rows = []
    close()
    yield pack()


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) as read from the formatted turns and their examples,
    each of which comes before the piece of its last turn: an example is that and all pieces before it.

    formatted_chars are those of all examples' texts. Steps of a conversation follow one another; most have only one."""
    none = F.lit(None).cast("long")
    turns = formatted.select("conv_id", "place", "piece", "start", none.alias("chars"), none.alias("loss_start"), none.alias("loss_end"))
    expanded = examples(formatted).withColumn("piece", F.lit(None).cast("string")).select(*turns.columns)
    stepped = turns.union(expanded).withColumn("step", F.floor(F.col("start") / STEP).cast("int"))
    steps = 1 + (formatted.agg(F.floor(F.max("start") / STEP).cast("int").alias("step")).first()[0] or 0)
    last = formatted.groupBy("conv_id").agg(F.floor(F.max("start") / STEP).cast("int").alias("last")) if steps > 1 else None
    out, state = [], None
    for k in range(steps):
        now = stepped.filter(F.col("step") == k) if steps > 1 else stepped
        if state is None:
            now = now.withColumn("state", F.lit(None).cast("struct<turns:binary,loss:binary,n_turns:bigint,loss_chars:bigint,formatted:bigint,end:bigint>"))
        else:
            now = now.join(small(state), F.col("conv_id").eqNullSafe(F.col("c")))
        sorted_ = now.repartition("conv_id").sortWithinPartitions("conv_id", "place", F.col("piece").isNotNull())
        read = sorted_.select("conv_id", "piece", "start", "chars", "loss_start", "loss_end", "state").mapInArrow(_read, _READ)
        if steps > 1:
            ends = last.select(F.col("conv_id").alias("e"), "last")
            read = stored(read.join(ends, F.col("conv_id").eqNullSafe(F.col("e"))).withColumn("final", F.col("last") == k))
            state = read.filter("NOT final").select(F.col("conv_id").alias("c"), F.struct("turns", "loss", "n_turns", "loss_chars", "formatted", "end").alias("state"))
            read = read.filter("final")
        out.append(read.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def digest(conversations: DataFrame) -> DataFrame:
    """The rows of query op12_chat: all conversations, and one whose texts hold the template's own strings."""
    said = f"{END}{START}assistant ok"
    odd = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, TRAINED, said)], "conv_id long, turn long, role string, text string")
    kept = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(pieces(kept.unionByName(odd)))


#: DuckDB SQL for digest(): what must be read back, and the lengths of all prefixes of the template's text.
DIGEST_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
s AS (
  SELECT *, row_number() OVER w AS place, role = 'assistant' AS trained,
         sum(length(regexp_replace(role, '[\\|\n]', '__', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24) OVER w AS ends,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (trained), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (trained), '')) AS loss_sha256,
       CAST(sum(CASE WHEN trained OR place = n THEN ends ELSE 0 END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
