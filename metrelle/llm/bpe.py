"""Byte-level BPE by merge replay over a corpus's distinct words.

A partition's texts are split into pieces by the tokenizer's pattern. The distinct pieces that no earlier batch has met are
merged together: an inverted index from token pair to the places where it stands is worked off in rank order, each merge
touches only the places of its pair and their neighbours, and pairs that a merge creates join the index. Texts are then
encoded by looking their pieces up. A piece is merged on its own, so where a partition ends never changes an id, and a lost
task can be run again anywhere.

Defined results: a null text is empty and has no tokens; special tokens are ordinary text; repeated rows each give a row;
a text of any length is encoded whole; of places where the same pair stands the first is merged first, so ties have one
result; an empty table gives no rows; other columns are ignored. `decode` turns unknown ids into an error.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from metrelle.llm.common import small_batches

#: Distinct units that a worker keeps between batches and tasks.
KEPT_UNITS = 120_000
#: Characters of a unit that is kept; longer ones, as whole texts without spaces are, live for one batch.
KEPT_LENGTH = 64
#: Characters of text whose new units are merged together.
GROUP_CHARS = 4 << 20
_replays: dict = {}


def ranks_of(content: bytes) -> dict[bytes, int]:
    """The ranks in a rank file: lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


class MergeReplay:
    """Merges by rank over many pieces at once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.merged: dict[tuple[int, int], int] = {}
        self.known: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def rank(self, left: int, right: int) -> int:
        """The rank of what two neighbours make, or -1."""
        pair = (left, right)
        found = self.merged.get(pair)
        if found is None:
            found = self.merged[pair] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return found

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        token = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(token)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[lengths > 0] - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1
        # The index is keyed by the rank that a pair makes and the pair itself, for two pairs can make one token.
        index: dict[tuple[int, int, int], list[np.ndarray]] = defaultdict(list)
        heap: list[tuple[int, int, int]] = []

        def add(places: np.ndarray) -> None:
            if not len(places):
                return
            pairs = token[places] << 32 | token[after[places]]
            order = np.argsort(pairs, kind="stable")
            pairs, places = pairs[order], places[order]
            firsts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            for lo, hi in zip(firsts, np.concatenate([firsts[1:], [len(pairs)]])):
                left, right = int(pairs[lo]) >> 32, int(pairs[lo]) & 0xFFFFFFFF
                if (rank := self.rank(left, right)) >= 0:
                    key = (rank, left, right)
                    if key not in index:
                        heapq.heappush(heap, key)
                    index[key].append(places[lo:hi])

        add(np.flatnonzero(after >= 0))
        while heap:
            key = heapq.heappop(heap)
            made, left, right = key
            places = index.pop(key)
            if len(places) == 1:
                places = places[0]
            else:
                places = np.sort(np.concatenate(places))
                places = places[np.concatenate([[True], places[1:] != places[:-1]])]
            then = after[places]
            live = (token[places] == left) & (then >= 0) & (token[then] == right)
            places = places[live]
            if left == right and len(places) > 1:
                places = self.apart(places, after)
            if not len(places):
                continue
            gone = after[places]
            token[places], token[gone] = made, -1
            after[places] = follow = after[gone]
            before[follow[follow >= 0]] = places[follow >= 0]
            prior = before[places]
            touched = np.sort(np.concatenate([prior[prior >= 0], places[follow >= 0]]))
            if len(touched):
                add(touched[np.concatenate([[True], touched[1:] != touched[:-1]])])
        keep = np.flatnonzero(token >= 0)
        bounds = (4 * np.searchsorted(keep, np.concatenate([[0], ends]))).tolist()
        ids = token[keep].astype("<u4").tobytes()
        return [ids[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:])]

    @staticmethod
    def apart(places: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of places whose pairs overlap, as in aaa, every other one from the left of each run."""
        follows = np.concatenate([[False], after[places[:-1]] == places[1:]])
        run = np.cumsum(~follows)
        first = np.flatnonzero(~follows)
        return places[(np.arange(len(places)) - first[run - 1]) % 2 == 0]

    def ids_of(self, units: list[str]) -> list[bytes]:
        """The ids of each unit: it is split by the pattern, and all distinct pieces are merged together."""
        split = [self.pattern.findall(unit) for unit in units]
        ids: dict[str, bytes] = {}
        rest = []
        for text in {piece for pieces in split for piece in pieces}:
            rank = self.ranks.get(text.encode())
            if rank is None:
                rest.append(text)
            else:  # a whole token needs no merge
                ids[text] = rank.to_bytes(4, "little")
        ids.update(zip(rest, self.replay([p.encode() for p in rest]) if rest else []))
        return [ids[pieces[0]] if len(pieces) == 1 else b"".join([ids[p] for p in pieces]) for pieces in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers.

        A text is cut before each space that stands between other characters than white space: no piece of the pattern
        crosses such a place. A text with other white space beside a space is known by a unit that begins or ends with
        it; no ids are kept for that unit, and such a text is one unit."""
        cut = [text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text, ""] for text in texts]
        known, older = self.known, self.older
        new, long = [], []
        for unit in {unit for units in cut for unit in units}.difference(known):
            if unit in older:
                known[unit] = older[unit]
            elif (word := unit[1:] if unit[:1] == " " else unit) and not word[0].isspace() and not word[-1].isspace():
                new.append(unit)
            else:
                known[unit] = None
                if len(unit) > KEPT_LENGTH:
                    long.append(unit)
        known.update(zip(new, self.ids_of(new)))
        out: list = [None if None in (ids := [known[unit] for unit in units]) else b"".join(ids) for units in cut]
        for unit in [*[u for u in new if len(u) > KEPT_LENGTH], *long]:
            del known[unit]
        whole = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(whole, self.ids_of([texts[i] for i in whole])):
            out[i] = ids
        if len(self.merged) > KEPT_UNITS:
            self.merged.clear()
        if len(known) > KEPT_UNITS:  # what isn't met again is forgotten at the next turn
            self.known, self.older = {}, known
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _columns(documents: DataFrame, rank_path: str, pattern: str, column: str, kinds: str, make) -> DataFrame:
    """doc_id, n_tokens and what make(ids, decoded bytes) gives of each text."""
    spark = documents.sparkSession
    small_batches(spark)
    with open(rank_path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    name = hashlib.sha256(content.value).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (name, pattern) not in _replays:  # a worker keeps what it has merged for its next task
            _replays[name, pattern] = MergeReplay(ranks_of(content.value), pattern)
        replay = _replays[name, pattern]
        for group in grouped(batches):
            ids = replay.encode([t or "" for _, texts in group for t in texts])
            rows = pa.concat_arrays([i for i, _ in group])
            both = list(zip(*[make(i, replay.decode(i)) for i in ids])) or [[], []]
            yield pa.RecordBatch.from_arrays([rows, pa.array([len(i) // 4 for i in ids], pa.int64()), *map(pa.array, both)], ["doc_id", "n_tokens", *[k.split()[0] for k in kinds.split(", ")]])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", column).mapInArrow(run, f"doc_id {kind}, n_tokens long, {kinds}")


def grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[pa.Array, list[str]]]]:
    """Batches gathered until they hold GROUP_CHARS of text, as (ids, texts)."""
    group, held = [], 0
    for batch in batches:
        if batch.num_rows:
            group.append((batch.column(0), batch.column(1).to_pylist()))
            held += sum(len(t or "") for t in group[-1][1])
        if held >= GROUP_CHARS:
            yield group
            group, held = [], 0
    if group:
        yield group


def encoded(documents: DataFrame, rank_path: str, pattern: str, column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian 32-bit bytes, decoded the bytes that they stand for.

    rank_path is read by the driver and its content, which has a fixed size, goes out as a broadcast variable."""
    return _columns(documents, rank_path, pattern, column, "ids binary, decoded binary", lambda ids, decoded: (ids, decoded))


def digest(documents: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """The rows of query op3_byte_bpe; hashing stays beside the encoder, so that ids and bytes don't cross to the JVM."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return _columns(documents, rank_path, pattern, "text", "ids_sha256 string, decoded_sha256 string", lambda ids, decoded: (sha(ids), sha(decoded)))
