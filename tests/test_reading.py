"""Tokens by a lexicon against every path; readings in results."""

import random

import pytest
from metrelle.functions import reading
from metrelle.operators import scoring


def paths(text, words):
    if not text:
        yield 0, 0, []
        return
    for n in range(1, len(text) + 1):
        for cost, read in ([(words[text[:n]])] if text[:n] in words else []) + ([(reading.UNKNOWN, None)] if n == 1 else []):
            for c, k, rest in paths(text[n:], words):
                yield c + cost, k + 1, [(text[:n], read), *rest]


def test_the_cheapest_path_of_all():
    r = random.Random(1)
    for _ in range(200):
        words = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))): (r.randint(0, 30), f"R{i}") for i in range(8)}
        text = "".join(r.choice("abcd") for _ in range(r.randint(0, 8)))
        got = reading.tokens(text, reading.trie([(s, x, c) for s, (c, x) in words.items()]))
        cost = sum(reading.UNKNOWN if x is None else words[s][0] for s, x in got)
        assert "".join(s for s, _ in got) == text
        assert (cost, len(got)) == min((c, k) for c, k, _ in paths(text, words))


def test_readings_of_results(spark):
    lexicon = spark.createDataFrame([("東京", "トウキョウ", 10), ("東", "ヒガシ", 10), ("京", "キョウ", 10), ("へ", "エ", 5), ("東京", "ひがしきょう", 99), (None, "x", 1), ("", "x", 1)], "surface string, reading string, cost int")
    rows = [("m", "1", "a", "東京へ", "とうきょう、え", None), ("m", "2", "a", "東 x", "", None), ("m", "3", "a", None, "x", "failed")]
    frame = spark.createDataFrame(rows, "model string, id string, dataset string, reference string, hypothesis string, error string")
    made = reading.with_tokens(frame, lexicon)
    got = {x["id"]: x for x in made.collect()}
    assert [tuple(t) for t in got["1"]["reference_tokens"]] == [("東京", "トウキョウ"), ("へ", "エ")]
    assert [tuple(t) for t in got["2"]["reference_tokens"]] == [("東", "ヒガシ"), ("Ｘ", None)] and got["2"]["hypothesis_tokens"] == [] and got["3"]["hypothesis_tokens"] is None
    facts = {x["id"]: (x["cer_reading_edits"], x["cer_reading_chars"]) for x in scoring.clip_facts(made).collect()}
    assert facts == {"1": (0, 6), "2": (4, 4), "3": (None, None)}


def test_a_lexicon_beyond_its_bound_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(reading, "MOST", 3)
    with pytest.raises(ValueError, match="4 entries"):
        reading.tokenizer(spark.range(4).selectExpr("concat('w', id) AS surface", "'x' AS reading", "1 AS cost"))
