"""Secret scan: base patterns, and a character convolutional network over every wider candidate and its context.

Base findings always stay. Wider candidates are unbroken tokens of 16 characters or more that mix letters and digits and
touch no base finding. A small network - embedded characters, one convolution with ReLU, maximum over places, one logistic
unit, all in numpy - reads each candidate with the text around it, in windows of WITHIN of its characters that overlap by
half; its chance is that of the window that is most like a secret. It is trained on labelled findings of all texts, each read
whole: the base findings, the matches of base patterns that fail their check, and a made secret and a made harmless token that
every text is the context of. It begins with made findings alone, in the words of this text; then ROUNDS rounds over all distinct
labelled windows follow, which are dealt out by hash into parts of PART on average: each part trains the network of the round
before, and the parts' networks are averaged by their rows, in whole numbers, so that the result doesn't depend on how rows are
read. A fifth of the windows, by hash, is held out, and the counts of its logits (in steps of 1 / LOGITS) calibrate them (Platt
scaling) and set the threshold: the highest one that keeps LEAST_RECALL of the held-out secrets. Nothing is sampled.

Defined results: a null text is empty; spans count code points, end exclusive, and are whole matches; spans of one start go
by kind; a text or candidate of any length is read whole; repeated rows each give a row; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable, Iterator
from copy import deepcopy
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrelle.llm.common import discard, small_batches, stored

#: Kinds in their order; fixed values.
KINDS = ("assign", "access", "hex")
_EITHER = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_KEYS = "|".join(map(_EITHER, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = re.compile(rf"(?:{_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
WIDE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}")
_HINTS = ("passw", "secret", "token", "api")

BEFORE, WITHIN, AFTER = 24, 40, 8
WINDOW = BEFORE + WITHIN + AFTER
EMBEDDING, FILTERS, WIDTH = 8, 24, 5
EXAMPLES, EPOCHS = 3000, 12
#: Rounds over all labelled windows, windows of a part on average, steps of a logit, and what parameters are multiplied with, so that sums are exact.
ROUNDS, PART, LOGITS, WHOLE = 2, 20_000, 1000, 2.0**24
LEAST_RECALL = 0.97


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, by start and then kind."""
    low = text.lower()
    found = []
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def near_misses(text: str) -> list[tuple[int, int]]:
    """(start, end) of matches of the base patterns that fail their check."""
    low, found = text.lower(), []
    if any(h in low for h in _HINTS):
        found += [(m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) < 8]
    if "AKIA" in text:
        found += [(m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() < 16]
    return found + [(m.start(), m.end()) for m in re.finditer("(?<![0-9a-z])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{8,31}(?![0-9a-z])", text)]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of wider candidates that touch no base finding; base is in order, and both lists are gone through once."""
    out, at, reach = [], 0, 0
    for m in WIDE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach, at = max(reach, base[at][2]), at + 1
        if reach <= m.start():
            out.append((m.start(), m.end()))
    return out


def window(text: str, start: int, end: int) -> np.ndarray:
    """Character codes of a candidate of WITHIN characters at most in its context, 0 where there is none; its own count from 128."""
    out = np.zeros(WINDOW, np.int64)
    code = lambda s: [min(ord(c), 127) for c in s]
    left, own, right = text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER]
    out[BEFORE - len(left) : BEFORE] = code(left)
    out[BEFORE : BEFORE + len(own)] = [128 + c for c in code(own)]
    out[BEFORE + len(own) : BEFORE + len(own) + len(right)] = code(right)
    return out


def windows(text: str, start: int, end: int) -> Iterator[np.ndarray]:
    """The windows of a candidate: one, or of a longer one as many as hold all of it; what stands beside a window there is its context."""
    at = start
    while True:
        yield window(text, at, min(end, at + WITHIN))
        if at + WITHIN >= end:
            return
        at = min(at + WITHIN // 2, end - WITHIN)


@dataclass
class Network:
    embedding: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    output: np.ndarray
    offset: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        e = self.embedding[x]
        patches = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).reshape(len(x), WINDOW - WIDTH + 1, -1)
        hidden = patches @ self.kernel + self.bias
        at = hidden.argmax(1)
        pooled = np.maximum(np.take_along_axis(hidden, at[:, None], 1)[:, 0], 0)
        return pooled @ self.output + self.offset[0], pooled, at, patches

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.kernel, self.bias, self.output, self.offset]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """A bounded number of windows at a time."""
        return np.concatenate([np.zeros(0), *[self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]])

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated chance of a secret for each window."""
        return self.chance(self.logits(x))

    def chance(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """A network fitted by Adam on four fifths of the rows, calibrated on the rest."""
    rng = np.random.default_rng(seed)
    held = np.arange(len(x)) % 5 == 0
    net = Network(rng.normal(0, 0.3, (256, EMBEDDING)), rng.normal(0, 0.2, (WIDTH * EMBEDDING, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, FILTERS), np.zeros(1))
    fit(net, x[~held], y[~held], EPOCHS, rng)
    calibrate(net, net.logits(x[held]), y[held], np.ones(held.sum()))
    return net


def fit(net: Network, x: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Trains net by Adam on rows, 64 at a time in random order."""
    parts = net.parts
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    rows = np.arange(len(x))
    for _ in range(epochs):
        rng.shuffle(rows)
        for lo in range(0, len(rows), 64):
            b = rows[lo : lo + 64]
            z, pooled, at, patches = net.forward(x[b])
            dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[b]) / len(b)
            dp = dz[:, None] * net.output * (pooled > 0)
            chosen = np.take_along_axis(patches, at[:, :, None], 1)  # (rows, filters, patch)
            dk = np.einsum("bf,bfp->pf", dp, chosen)
            de = np.zeros_like(net.embedding)
            back = np.einsum("bf,pf->bfp", dp, net.kernel).reshape(len(b), FILTERS, EMBEDDING, WIDTH)
            places = x[b][np.arange(len(b))[:, None, None], at[:, :, None] + np.arange(WIDTH)]
            np.add.at(de, places, back.transpose(0, 1, 3, 2))
            step += 1
            for p, g, m, v in zip(parts, (de, dk, dp.sum(0), pooled.T @ dz, np.array([dz.sum()])), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def calibrate(net: Network, z: np.ndarray, t: np.ndarray, n: np.ndarray) -> None:
    """Sets scale and threshold by held-out logits z of labels t, each n times."""
    if not len(z):
        return
    a, c, share = 1.0, 0.0, n / n.sum()
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        a, c = a - 0.1 * ((p - t) * z * share).sum() / (1 + (z * z * share).sum()), c - 0.1 * ((p - t) * share).sum()
    net.scale = (float(a), float(c))
    chance, n = net.chance(z[t == 1]), n[t == 1]
    order = np.argsort(chance, kind="stable")
    reached = np.cumsum(n[order])
    net.threshold = float(chance[order][np.searchsorted(reached, int((1 - LEAST_RECALL) * reached[-1]), "right")]) if len(order) else 0.5


def made(draw: Callable[[int, int], int], text: str, words: list[str], good: int) -> list[np.ndarray]:
    """The windows of a made finding at some place of a text, a secret or a harmless token of words; draw(lo, hi) is a random number."""
    pick = lambda items: items[draw(0, len(items))]
    chars = lambda alphabet, lo, hi: "".join(pick(alphabet) for _ in range(draw(lo, hi)))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed, hexes = lower + lower.upper() + digits, digits + "abcdef"
    plain = lambda: re.sub("[^A-Za-z]", "", pick(words)) or "word"
    secret = [
        lambda: chars(mixed, 20, 44), lambda: chars(mixed + "+/", 24, 44) + "==", lambda: chars(hexes, 20, 32), lambda: "ghp_" + chars(mixed, 30, 37),
        lambda: "sk_live_" + chars(mixed, 20, 30), lambda: "xoxb-" + chars(digits, 10, 13) + "-" + chars(mixed, 20, 26), lambda: "ASIA" + chars(lower.upper() + digits, 14, 17),
    ]
    harmless = [
        lambda: "-".join(plain().lower() for _ in range(4)) + "-" + chars(digits, 1, 4), lambda: "/".join(plain().lower() for _ in range(3)) + "/" + chars(digits, 1, 3),
        lambda: "_".join(plain() for _ in range(3)) + chars(digits, 1, 3), lambda: f"20{chars(digits, 2, 3)}-0{chars(digits, 1, 2)}-1{chars(digits, 1, 2)}T{chars(digits, 2, 3)}-{chars(digits, 2, 3)}-00",
        lambda: plain() + plain() + plain() + chars(digits, 1, 2), lambda: chars("=-", 16, 30) + pick(lower) + chars(digits, 1, 2), lambda: "page-" + chars(digits, 1, 3) + "-of-" + plain().lower(),
    ]
    token = pick(secret if good else harmless)()
    at = draw(0, len(text) + 1)
    lead = pick(["", "key: ", "auth=", "credential ", "secret key is "] if good and draw(0, 10) < 6 else ["", "see ", "file ", "id "])
    left = text[max(0, at - BEFORE) : at] + pick([" ", "\n", '"']) + lead
    whole = left + token + pick([" ", ".", '"', "\n"]) + text[at : at + AFTER]
    return list(windows(whole, len(left), len(left) + len(token)))


def real(text: str) -> list[tuple[np.ndarray, int]]:
    """The windows of a text's own findings, and their labels."""
    own = [(s, e, 1) for s, _, e in base_spans(text)] + [(s, e, 0) for s, e in near_misses(text)]
    return [(w, good) for s, e, good in own for w in windows(text, s, e)]


def labelled(contexts: list[str], n: int = EXAMPLES, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows of made findings, half of them secrets, in given contexts, of the contexts' own findings, and their labels."""
    rng = np.random.default_rng(seed)
    draw = lambda lo, hi: int(rng.integers(lo, hi))
    words = [w for t in contexts for w in t.split()] or ["text"]
    found = [(w, i % 2) for i in range(n) for w in made(draw, contexts[draw(0, len(contexts))] if contexts else "", words, i % 2)]
    found += [f for text in contexts for f in real(text)]
    return np.array([w for w, _ in found]), np.array([good for _, good in found], float)


def examples(documents: DataFrame) -> DataFrame:
    """(x, y, n, h): the distinct labelled windows of all texts, a byte a character, how often each occurs, and a hash of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for lo in range(0, len(texts), 64):
                found = []
                for text in texts[lo : lo + 64]:
                    draw, words = random.Random(zlib.crc32(text.encode())).randrange, text.split() or ["text"]
                    found += [(w, good) for good in (0, 1) for w in made(draw, text, words, good)] + real(text)
                yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.uint8).tobytes() for w, _ in found], pa.binary()), pa.array([y for _, y in found], pa.int32())], ["x", "y"])

    found = documents.select("text").mapInArrow(run, "x binary, y int").groupBy("x", "y").agg(F.count("*").alias("n"))
    return found.withColumn("h", F.xxhash64("x", "y"))


def _codes(x: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.uint8).reshape(-1, WINDOW).astype(np.int64)


def round_of(net: Network, rows: DataFrame, parts: int, seed: int) -> Network:
    """The mean, by rows, of the networks that net becomes in each of so many parts of the training rows."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(part: pa.Table) -> pa.Table:
        own, found = deepcopy(shared.value), sorted(zip(part["x"].to_pylist(), part["y"].to_pylist()))
        fit(own, _codes([x for x, _ in found]), np.array([y for _, y in found], float), 1, np.random.default_rng(seed))
        values = np.rint(np.concatenate([p.ravel() for p in own.parts]) * WHOLE).astype(np.int64) * len(found)
        return pa.table({"at": pa.array(np.arange(len(values)), pa.int32()), "value": values, "n": np.full(len(values), len(found))})

    dealt = rows.select("x", "y", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(parts)).alias("part"))
    sums = dealt.groupBy("part").applyInArrow(run, "at int, value long, n long").groupBy("at").agg(F.sum("value").alias("v"), F.sum("n").alias("n"))
    mean = {r["at"]: r["v"] / r["n"] / WHOLE for r in sums.collect()}  # a row a parameter
    out, at = deepcopy(net), 0
    for p in out.parts:
        p[...] = np.array([mean[at + i] for i in range(p.size)]).reshape(p.shape)
        at += p.size
    return out


def fitted(documents: DataFrame) -> Network:
    """A network trained, calibrated and limited by the labelled windows of all texts."""
    small_batches(documents.sparkSession)
    x, y = labelled([__doc__])
    net, rows = train(x, y), stored(examples(documents))
    training = rows.filter("pmod(h, 5) <> 0")
    n = training.count()
    for k in range(ROUNDS if n else 0):
        net = round_of(net, training, -(-n // PART), k)
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.rint(np.clip(shared.value.logits(_codes(batch.column(0).to_pylist())), -50, 50) * LOGITS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(z), batch.column(1), batch.column(2)], ["z", "y", "n"])

    counted = rows.filter("pmod(h, 5) = 0").select("x", "y", "n").mapInArrow(run, "z int, y int, n long").groupBy("z", "y").agg(F.sum("n").alias("n"))
    held = np.array(sorted(map(tuple, counted.collect())), float).reshape(-1, 3)  # a row a step of the logits
    discard(rows)
    own = np.arange(len(x)) % 5 == 0  # made findings that train() held out
    calibrate(net, np.concatenate([held[:, 0] / LOGITS, net.logits(x[own])]), np.concatenate([held[:, 1], y[own]]), np.concatenate([held[:, 2], np.ones(own.sum())]))
    return net


def kind_of(token: str) -> int:
    return 2 if re.fullmatch("[0-9a-fA-F]+", token) else 1 if re.match("A[A-Z]IA", token) else 0


def scanned(documents: DataFrame, net: Network) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans): base findings and all spans as kind:start:end, comma-joined."""
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            wide = [(i, s, e) for i, t in enumerate(texts) for s, e in candidates(t, base[i])]
            every = [list(b) for b in base]
            for lo in range(0, len(wide), 4096):
                part = wide[lo : lo + 4096]
                each = ((k, w) for k, (i, s, e) in enumerate(part) for w in windows(texts[i], s, e))
                chance = np.zeros(len(part))
                while held := list(islice(each, 4096)):
                    np.maximum.at(chance, [k for k, _ in held], shared.value.probability(np.array([w for _, w in held])))
                for (i, s, e), p in zip(part, chance):
                    if p >= shared.value.threshold:
                        every[i].append((s, kind_of(texts[i][s:e]), e))
            counts = [pa.array([sum(k == kind for _, k, _ in b) for b in base], pa.int64()) for kind in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(map(listed, base), pa.string()), pa.array(map(listed, every), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base string, spans string")


def redact(text: str, spans: str) -> str:
    """text with each span, as scanned() lists them, replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in (s.split(":") for s in filter(None, spans.split(","))):
        if int(start) >= at:
            out += [text[at : int(start)], f"<{kind}>"]
        at = max(at, int(end))
    return "".join([*out, text[at:]])


def digest(documents: DataFrame) -> DataFrame:
    """The rows of query op8_secrets."""
    found = scanned(documents, fitted(documents))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
