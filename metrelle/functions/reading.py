"""tokens of a text by a lexicon that the caller brings: a prefix trie over surfaces and the cheapest path through the words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrelle.functions.text import fullwidth_upper, normalize_norm

TOKENS = "array<struct<surface:string,reading:string>>"
#: What a character costs that no word covers; entries of a lexicon, and characters in them, that may be broadcast.
UNKNOWN, MOST, MOST_CHARS = 10_000, 1_000_000, 16 << 20


def trie(entries: list[tuple[str, str | None, int]]) -> dict:
    """Nested dicts by character; key "" holds a word's (cost, reading), the cheapest and then the least where a surface repeats."""
    root: dict = {}
    for surface, reading, cost in entries:
        node = root
        for c in surface:
            node = node.setdefault(c, {})
        if node is not root:
            node[""] = min(node.get("", (cost, reading or surface)), (cost, reading or surface))
    return root


def tokens(text: str, root: dict) -> list[tuple[str, str | None]]:
    """(surface, reading) along the path of the least cost, then of the fewest words, then of the longest last word; a character
    that no word on it covers is a token without a reading."""
    best: list[tuple] = [(0, 0, 0, None)] + [None] * len(text)
    for i in range(len(text)):
        cost, n = best[i][:2]
        ways = [(cost + UNKNOWN, n + 1, -1, None)]
        node = root
        for j in range(i, len(text)):
            node = node.get(text[j])
            if node is None:
                break
            if word := node.get(""):
                ways.append((cost + word[0], n + 1, i - j - 1, word[1]))
        for way in ways:
            end = i - way[2]
            if best[end] is None or way[:3] < best[end][:3]:
                best[end] = way
    out, end = [], len(text)
    while end:
        _, _, back, reading = best[end]
        out.append((text[end + back : end], reading))
        end += back
    return out[::-1]


def tokenizer(lexicon: DataFrame) -> Callable[[Column], Column]:
    """A function from a text column to TOKENS, from a lexicon (surface, reading, cost) that is counted, and then broadcast.

    Surfaces are of the form that folded() gives; costs are whole and not negative; entries without a surface or a cost are none."""
    known = lexicon.filter("surface <> '' AND cost >= 0").select("surface", "reading", F.col("cost").cast("long"))
    n, chars = known.agg(F.count("*"), F.sum(F.length("surface") + F.coalesce(F.length("reading"), F.lit(0)))).first()
    if n > MOST or (chars or 0) > MOST_CHARS:
        raise ValueError(f"a lexicon of {n} entries, {chars} characters, where {MOST} and {MOST_CHARS} are the bounds")
    shared = lexicon.sparkSession.sparkContext.broadcast(sorted(map(tuple, known.collect()), key=str))

    @F.pandas_udf(TOKENS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        root = trie(shared.value)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else [{"surface": s, "reading": r} for s, r in tokens(t, root)])

    return run


def folded(text: Column) -> Column:
    """What is tokenised: the normalised text with ASCII in full width."""
    return fullwidth_upper(normalize_norm(text))


def with_tokens(results: DataFrame, lexicon: DataFrame) -> DataFrame:
    """results with the tokens that scoring.clip_facts takes for cer_reading; failed rows, which aren't scored, have none."""
    cut = tokenizer(lexicon)
    of = lambda c: cut(folded(F.when(F.col("error").isNull(), F.col(c))))
    return results.withColumns({"reference_tokens": of("reference"), "hypothesis_tokens": of("hypothesis")})
