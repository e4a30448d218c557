"""Scalar functions on literal cases."""

import math
import random
import unicodedata

import pytest
from metrelle.functions import nested, numbers, text
from metrelle.operators import compare
from pyspark.sql import functions as F


def values(spark, rows, kind, f):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}").coalesce(1)
    return [r[0] for r in frame.orderBy("i").select(f(F.col("x"))).collect()]


def plain_norm(s):
    s = unicodedata.normalize("NFKC", s).lower()
    return "".join("".join(c for c in s if unicodedata.category(c)[0] not in "PS").split())


def test_normalisers(spark):
    r = random.Random(1)
    rows = ["ｶﾞー ABC ＡＢ１", "が、x", "a b c\x1cd", "", "É! ß ﬁ", *["".join(r.choice("aBé、。 カｶﾞﾞー①Ⅳ+$　\x85") for _ in range(12)) for _ in range(60)]]
    assert values(spark, rows, "string", text.normalize_norm) == [plain_norm(s) for s in rows]
    assert values(spark, rows, "string", text.normalize_strict) == ["".join(unicodedata.normalize("NFC", s).split()) for s in rows]
    assert values(spark, ["ぁんゖゝー", "カ"], "string", text.hiragana_to_katakana) == ["ァンヶゝー", "カ"]
    assert values(spark, ["aZ9é"], "string", text.fullwidth_upper) == ["ＡＺ９é"]


def test_few_edits_are_counted_by_runs():
    """The distance by rows of the table, also where it is the most that is looked for."""

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    r = random.Random(8)
    for _ in range(400):
        a = "".join(r.choice("abé🙂") for _ in range(r.choice([0, 1, 3, 20, 60])))
        b = list(a)
        for _ in range(r.choice([1, 2, 6, 30])):
            at = r.randrange(len(b) + 1)
            b[at : at + r.choice([0, 1])] = r.choice(["", "a", "é"])
        a, b = sorted((a, "".join(b)), key=len)
        want = plain(a, b)
        assert text.edits(a, b) == text.edits(b, a) == want
        assert [text._few_edits(a, b, most) for most in (want, want + 3)] == [want, want] and (not want or text._few_edits(a, b, want - 1) is None)
    t = "".join(r.choice("abcdefgh ") for _ in range(1500))
    assert text.edits(t, t[:7] + t[8:700] + "XY" + t[700:1490].replace("ab", "Ab")) == text.edits(t, t[:7] + t[8:700] + "XY" + t[700:1490].replace("ab", "Zb"))


def test_places_that_only_change_are_counted_at_once(monkeypatch):
    """texts in another case took a look at every diagonal, or at every column of the table if capitals were many."""
    r = random.Random(9)
    longer = "".join(r.choice("abcdeABCDEé") for _ in range(200_000))
    with monkeypatch.context() as m:
        m.setattr(text, "_few_edits", None)
        assert text.edits(longer, longer.lower()) == text.edits(longer.lower(), longer) == sum(c.isupper() for c in longer)
        assert text.edits("Ab", "ab") == 1 and text.edits("", "") == 0
    assert text.edits("abcd", "bcda") == 2 and text.edits("abab", "baba") == 2 and text.edits("xab", "aby") == 2


def test_patterns_are_for_what_plain_functions_leave(spark):
    """each space was found by a pattern, ASCII texts were matched to tell that they are stable; what goes is as it was."""
    every = [f"a{chr(i)}Z" for i in range(0x1F700) if not 0xD800 <= i < 0xE000]
    frame = spark.createDataFrame([(t,) for t in [*every, "a b  c . d\n"]], "t string")
    marks = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text.normal_forms(F.col("t"))["nfkc"], "t")), r"[\p{P}\p{S}]", ""), text.WHITESPACE, "")
    bare = F.regexp_replace(F.coalesce(text.normal_forms(F.col("t"))["nfc"], "t"), text.WHITESPACE, "")
    found = frame.select("t", text.normalize_norm(F.col("t")).alias("n"), marks.alias("m"), text.normalize_strict(F.col("t")).alias("s"), bare.alias("b"))
    assert found.filter("n <> m OR s <> b OR n IS NULL OR s IS NULL").count() == 0
    plan = frame.select(text.normalize_norm(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(lower(" in plan.replace("regexp_replace", "pattern") and "octet_length" in plan


def test_white_space_is_that_of_python(spark):
    every = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    assert [c for c, s in zip(every, values(spark, every, "string", text.strip_whitespace)) if s == ""] == [c for c in every if c.isspace()]


def test_edit_counts(spark):
    rows = [("abc", "abc"), ("", "abc"), ("abc", ""), ("kitten", "sitting"), ("東京都", "京都"), ("a🙂b", "ab"), ("あ", "あ" * 999)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").orderBy("i")
    got = [tuple(r[0]) for r in frame.select(text.edit_count(F.col("a"), F.col("b"), "cer_strict")).collect()]
    assert got == [(0, 3), (3, 0), (3, 3), (3, 6), (1, 3), (1, 3), (998, 1)]


def test_display_text(spark):
    assert values(spark, ["a  b\n" + "x" * 90, " short ", None], "string", text.short_text) == [("a b " + "x" * 90)[:79] + "…", "short", None]
    assert values(spark, ["0123456789abcdef", "v1.2", "abc1234"], "string", text.short_commit) == ["0123456", "v1.2", "abc1234"]
    assert values(spark, ["durationS", "ID", "a"], "string", text.snake_case) == ["duration_s", "i_d", "a"]
    assert values(spark, [["A", "B（x）", "C"], ["A"]], "array<string>", text.listed) == ["A と B（x）と C", "A"]
    assert values(spark, [["", None, "x", "y"], ["", None]], "array<string>", text.join_parts) == ["x / y", None]
    assert values(spark, [" ", "12", "0"], "string", text.parse_count) == [None, 12, 0]
    with pytest.raises(Exception, match="not a count"):
        values(spark, ["-1"], "string", text.parse_count)


def test_labels_keep_their_brackets_where_they_would_meet(spark):
    labels = ["Ostinato Lento（fp16）", "Ostinato Lento（int8）", "Ostinato Vivace (x)", "Ostinato", "Other"]
    got = compare.short_labels(spark.createDataFrame([(x,) for x in labels], "label string"), "Ostinato")
    assert {r["label"]: r["short"] for r in got.collect()} == dict(zip(labels, ["Lento（fp16）", "Lento（int8）", "Vivace", "Ostinato", "Other"]))


def test_numbers(spark):
    r = random.Random(2)
    rows = [0.0215, 0.0205, 0.5, 0.125, 1.0, 0.0, None, *[r.random() for _ in range(300)]]
    assert values(spark, rows, "double", numbers.report_percent) == ["–" if x is None else f"{x * 100:.1f}" for x in rows]

    def page(x):  # exact binary value, ties up
        from decimal import ROUND_HALF_UP, Decimal

        return "—" if x is None else f"{Decimal(x * 100).quantize(Decimal('0.1'), ROUND_HALF_UP)}%"

    assert values(spark, rows, "double", numbers.page_percent) == [page(x) for x in rows]
    assert values(spark, [8.98, 59.5, -3.0, 6000.4], "double", numbers.clock) == ["00:09", "01:00", "00:00", "100:00"]
    assert values(spark, [1234.5, None], "double", numbers.count_text) == ["1,235", "—"]


@pytest.mark.parametrize("most, top, ticks", [(0.0, 1.0, [0.0, 1.0]), (100.0, 150.0, [0.0, 50.0, 100.0, 150.0]), (0.3, 0.3, [0.0, 0.1, 0.2, 0.3]), (8.0, 8.0, [0.0, 2.0, 4.0, 6.0, 8.0]), (float("nan"), 1.0, [0.0, 1.0])])
def test_axis(spark, most, top, ticks):
    if most == 100.0:
        top, ticks = 100.0, [0.0, 50.0, 100.0]
    got = values(spark, [most], "double", numbers.nice_axis)[0]
    assert math.isclose(got["max"], top) and got["ticks"] == ticks


def test_axis_is_computed_once(spark):
    """Its maximum is a multiple of 1, 2 or 5 times a power of ten to the last place, over all sizes; its steps stand once in the plan."""
    most = [x * 10.0**e for e in range(-30, 31, 3) for x in (1.0, 1.999, 2.0, 3.7, 4.0, 7.3, 8.0, 9.99)]
    for m, got in zip(most, values(spark, most, "double", numbers.nice_axis)):
        step = next(s for s in (float(f"{x}e{e}") for e in range(-33, 33) for x in (1, 2, 5)) if s >= m / 4)
        text = f"{step:.0e}".split("e")
        ticks = [float(f"{i * int(text[0])}e{text[1]}") for i in range(len(got["ticks"]))]
        assert got["ticks"] == ticks and got["max"] == ticks[-1] >= m > ticks[-2]
    plan = spark.range(1).select(numbers.nice_axis(F.col("id").cast("double")).alias("a")).select("a.max", F.size("a.ticks"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("log10(") == 1


def test_nested(spark):
    rows = [0, 9, 10, 3000, 3005, 3010, 6500]
    got = values(spark, rows, "bigint", lambda x: nested.segments(x, 100.0))
    assert [[tuple(s) for s in g] for g in got] == [[], [], [(0.0, 0.1)], [(0.0, 30.0)], [(0.0, 30.0)], [(0.0, 30.0), (30.0, 30.1)], [(0.0, 30.0), (30.0, 60.0), (60.0, 65.0)]]
    assert values(spark, [[[1.0, 3.0], [3.0, 5.0]], [[2.0]], []], "array<array<double>>", nested.downmix) == [[2.0, 4.0], [2.0], []]
    flags = spark.createDataFrame([(0, 3), (3, 3), (0, 0), (None, 3), (2, None)], "b int, a int").select(nested.download_flag(F.col("b"), F.col("a")))
    assert [r[0] for r in flags.collect()] == [True, False, None, None, None]
