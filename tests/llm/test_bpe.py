"""Byte-level BPE against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from metrelle.llm import bpe

def encoding():
    ranks = bpe.ranks_of(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_row(enc, d, text):
    ids = enc.encode_ordinary(text or "")
    return d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_tokens_match_the_library(spark):
    r, enc = random.Random(5), encoding()
    fixed = [None, "", " ", "a\n \nb", "  x ", "aaaaaaaaa", "日本語🙂🙂", "é" * 4000, "it's <|endoftext|> 12345", "\0 a\0 b", "x " * 20000]
    rows = list(enumerate(fixed + ["".join(r.choice("ab né's 1\n日.\t") for _ in range(r.randint(0, 80))) for _ in range(500)]))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    frame = spark.createDataFrame([(d, t, b"") for d, t in rows], "doc_id long, text string, ids binary")
    assert {tuple(x) for x in bpe.digest(frame, path, public_tokenizers.PATTERN).collect()} == {token_row(enc, d, t) for d, t in rows}
    got = {x["doc_id"]: bytes(x["decoded"]).decode() for x in bpe.encoded(frame, path, public_tokenizers.PATTERN).collect()}
    assert got == {d: t or "" for d, t in rows}
    assert bpe.digest(frame.filter("false"), path, public_tokenizers.PATTERN).count() == 0


def test_repeated_rows_and_long_units_are_not_kept(spark):
    path, enc = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), encoding()
    text = "日本語の文章" * 5000
    rows = [(1, text), (1, text), (None, "a b"), (2, "x" * 20000)]
    got = bpe.digest(spark.createDataFrame(rows, "doc_id long, text string"), path, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, got), key=str) == sorted((token_row(enc, d, t) for d, t in rows), key=str)
    replay = bpe.MergeReplay(bpe.ranks_of(open(path, "rb").read()), public_tokenizers.PATTERN)
    replay.encode([text, " \n" + text, "some words"])
    assert all(len(unit) <= bpe.KEPT_LENGTH for unit in replay.known)
