"""Text functions of the evaluation: normalisers, edit counts and display text. All are Column to Column."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str.split() knows it: 29 code points. Fixed value; most characters are told by the first class alone.
WHITESPACE = r"[[^!-~]&&[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
#: Texts of these characters only are in every Unicode normal form already.
_STABLE = r"^[\x00-\x7FÀ-ÖØ-öø-ÿ]*$"
#: Punctuation, symbols and white space; letters a-z are told by the first class alone.
_UNSPOKEN = rf"[[^a-z]&&[\p{{P}}\p{{S}}{WHITESPACE}]]"
_HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
_ASCII_NAMES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_WIDE_NAMES = "".join(chr(ord(c.upper()) + 0xFEE0) for c in _ASCII_NAMES)


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def normal_forms(text: Column) -> dict[str, Column]:
    """NFC and NFKC of texts that can change by them, else null: only those go through Python, as the JVM functions have none."""
    needs = (F.octet_length(text) > F.length(text)) & ~text.rlike(_STABLE)  # ASCII is told by its bytes
    return {"nfc": F.when(needs, _nfc(F.when(needs, text))), "nfkc": F.when(needs, _nfkc(F.when(needs, text)))}


def strip_whitespace(text: Column) -> Column:
    """text without any white space."""
    return F.regexp_replace(_unspaced(text), WHITESPACE, "")


def _unspaced(text: Column) -> Column:
    """text without plain spaces, which are most of what a pattern would find one by one."""
    return F.replace(text, F.lit(" "), F.lit(""))


def normalize_strict(text: Column, forms: dict[str, Column] | None = None) -> Column:
    """NFC, then no white space; width, case and punctuation stay. forms: normal_forms() of the text, where they are at hand."""
    return strip_whitespace(F.coalesce((forms or normal_forms(text))["nfc"], text))


def normalize_norm(text: Column, forms: dict[str, Column] | None = None) -> Column:
    """NFKC, lower case, without punctuation, symbols and white space; the long vowel mark stays."""
    return F.regexp_replace(_unspaced(F.lower(F.coalesce((forms or normal_forms(text))["nfkc"], text))), _UNSPOKEN, "")


def hiragana_to_katakana(text: Column) -> Column:
    """F5."""
    return F.translate(text, _HIRAGANA, "".join(chr(ord(c) + 0x60) for c in _HIRAGANA))


def fullwidth_upper(text: Column) -> Column:
    """ASCII letters and digits as full-width capitals and digits."""
    return F.translate(text, _ASCII_NAMES, _WIDE_NAMES)


def reading(tokens: Column) -> Column:
    """F7, from tokens array<struct<surface, reading>> of a morphological dictionary: readings, or surfaces, in katakana.

    No dictionary is bundled; a caller brings the tokens of fullwidth_upper(normalize_norm(text))."""
    return hiragana_to_katakana(F.array_join(F.transform(tokens, lambda t: F.coalesce(t["reading"], t["surface"])), ""))


#: The registry of normalisers, by metric and in output order.
NORMALIZERS: dict[str, Callable[..., Column]] = {"cer_strict": normalize_strict, "cer_norm": normalize_norm}


#: Texts of so many characters an edit, or more, are compared run by run; others a column of the table at a time.
_APART = 32


def _alike(a: str, b: str, i: int, j: int) -> int:
    """How many characters a from i and b from j have alike: in steps that double, and then halve."""
    begin, step = i, 8
    while (part := a[i : i + step]) and part == b[j : j + len(part)]:
        i, j, step = i + len(part), j + len(part), 2 * step
    while step > 1:
        step //= 2
        if (part := a[i : i + step]) and part == b[j : j + len(part)]:
            i, j = i + len(part), j + len(part)
    return i - begin


def _few_edits(a: str, b: str, most: int) -> int | None:
    """The edit distance if it is `most` or less: how far each diagonal of the table gets with 0, 1, 2... edits."""
    n, m = len(a), len(b)
    last, goal = {0: _alike(a, b, 0, 0)}, m - n
    for e in range(most + 1):
        if last.get(goal, -1) >= n:
            return e
        left, now = most - e - 1, {}
        for d in range(max(-e - 1, -n, goal - left), min(e + 1, m, goal + left) + 1):
            i = min(max(last.get(d, -2) + 1, last.get(d - 1, -2), last.get(d + 1, -2) + 1), n, m - d)
            if i >= 0 and i + d >= 0:
                now[d] = i + _alike(a, b, i, i + d) if i < n and i + d < m and a[i] == b[i + d] else i
        last = now
    return None


def edits(a: str, b: str) -> int:
    """The edit distance of two strings by code points: the difference of their lengths where one is the other with characters left
    out; the places that differ where lengths are equal and none of the characters that go there is one that comes; else, if the
    edits are few, by the runs between them; else by Myers' bit vectors, a column of the table at a time as the bits of two whole
    numbers."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        apart = [(c, d) for c, d in zip(a, b) if c != d]
        # An edit takes away or brings one character at most, so that there are as many edits as characters that only go.
        if {c for c, _ in apart}.isdisjoint([d for _, d in apart]):
            return len(apart)
    rest = iter(b)
    if all(c in rest for c in a):
        return len(b) - len(a)
    most = 8 + len(b) // _APART
    if len(b) - len(a) <= most and (few := _few_edits(a, b, most)) is not None:
        return few
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    up, down = every, 0  # where the column's distances rise and fall
    for c in b:
        same = places.get(c, 0)
        diagonal = ((same & up) + up ^ up) | same
        right = down | every & ~(diagonal | up)
        left = (up & diagonal) << 1
        right = right << 1 | 1
        same |= down
        up, down = (left | ~(same | right)) & every, right & same & every
    return len(b) + up.bit_count() - down.bit_count()


@F.pandas_udf(T.IntegerType())
def _edits(pairs: pd.DataFrame) -> pd.Series:
    return pd.Series([None if a is None or b is None else edits(a, b) for a, b in zip(pairs["a"], pairs["b"])], dtype="Int32")


# Else a filter on what is counted would be told again of the texts, below the shuffle that deals them out.
_edits = _edits.asNondeterministic()


def distance(a: Column, b: Column) -> Column:
    """the edit distance. Where one text holds the other it is the difference of their lengths; only the rest goes through
    Python, whose whole numbers take a column of the table in a few steps, where the built-in function takes each cell."""
    near = F.abs(F.length(a) - F.length(b))
    return F.coalesce(_edits(F.when(~(F.contains(b, a) | F.contains(a, b)), F.struct(a.alias("a"), b.alias("b")))), near)


def edit_count(reference: Column, hypothesis: Column, metric: str) -> Column:
    """F8 with F1: struct(edits, chars) of two texts under a metric; chars are those of the normalised reference."""
    a, b = NORMALIZERS[metric](reference), NORMALIZERS[metric](hypothesis)
    return edits_of(a, b)


def edits_of(a: Column, b: Column) -> Column:
    """struct(edits, chars) of a normalised reference and hypothesis, both null where either is."""
    both = a.isNotNull() & b.isNotNull()
    return F.struct(distance(a, b).cast("long").alias("edits"), F.when(both, F.length(a).cast("long")).alias("chars"))


def short_text(text: Column, most: int = 80) -> Column:
    """white space collapsed, cut to `most` characters with an ellipsis as the last."""
    one = F.trim(F.regexp_replace(text, WHITESPACE + "+", " "))
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.substring(one, 1, most - 1), F.lit("…")))


def join_parts(parts: Column, by: str = " / ") -> Column:
    """the non-empty parts of an array joined, or null if there is none."""
    return F.nullif(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), by), F.lit(""))


def escape_cell(text: Column) -> Column:
    """vertical bars escaped for a Markdown cell."""
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def short_commit(commit: Column) -> Column:
    """the first seven digits of a commit hash; any other text unchanged."""
    return F.when(commit.rlike("^[0-9a-fA-F]{8,40}$"), F.substring(commit, 1, 7)).otherwise(commit)


def label_forms(label: Column, family: str) -> Column:
    """an array of the names that a label may go by, longest first: the label, the label less a leading family name, and that
    less a closing note in brackets. A step that would leave nothing is left out."""
    led = F.startswith(F.lower(label), F.lit(family.lower())) & F.substring(label, len(family) + 1, 1).rlike(WHITESPACE)
    plain = F.when(led, F.trim(F.substr(label, F.lit(len(family) + 1)))).otherwise(label)
    plain = F.when(plain == "", label).otherwise(plain)
    noted = F.rtrim(plain)
    marks = F.translate(noted, "（）", "()")  # one place each, so that places in it are places in the label
    inner = F.substring_index(F.left(marks, F.length(marks) - 1), ")", -1)
    opened = F.length(F.substring_index(inner, "(", 1))
    rest = F.trim(F.left(noted, F.length(noted) - 1 - F.length(inner) + opened))
    short = F.when(F.endswith(marks, F.lit(")")) & F.contains(inner, F.lit("(")) & (rest != ""), rest).otherwise(plain)
    return F.array(label, plain, short)


#: A private character that stands where a space may have to go, while a sentence is put together.
_JOINT = "\ue000"


def _spaced(text: Column) -> Column:
    """Each joint as a space if ASCII letters, digits or brackets are on its Latin side, else as nothing."""
    return F.replace(F.regexp_replace(text, rf"(?<=[A-Za-z0-9)\]]){_JOINT}|{_JOINT}(?=[A-Za-z0-9(\[])", " "), F.lit(_JOINT), F.lit(""))


def said_of(name: Column, word: str) -> Column:
    """a name and the word behind it, apart only where the name ends in ASCII."""
    return _spaced(F.concat(name, F.lit(_JOINT + word)))


def listed(names: Column, word: str = "と") -> Column:
    """an array of names with the word between them, apart only from ASCII."""
    return _spaced(F.array_join(names, f"{_JOINT}{word}{_JOINT}"))


def snake_case(name: Column) -> Column:
    """An underscore before every capital but the first character, then lower case."""
    return F.lower(F.regexp_replace(name, "(?<!^)(?=[A-Z])", "_"))


def item_id(dataset: Column, row: Column) -> Column:
    """Dataset, a hyphen and the row number with six digits at least."""
    return F.format_string("%s-%06d", dataset, row)


def prompt(language: Column) -> Column:
    """the transcription prompt; its lines are fixed values."""
    lines = [
        F.concat(F.lit("Transcribe the following speech segment in "), language, F.lit(" into "), language, F.lit(" text.")),
        F.lit(""),
        F.lit("Follow these specific instructions for formatting the answer:"),
        F.lit("* Only output the transcription, with no newlines."),
        F.lit("* When transcribing numbers, write the digits, i.e. write 1.7 and not one point seven, and write 3 instead of three."),
    ]
    return F.concat_ws("\n", *lines)


def eval_url(base: str, **parameters: Column) -> Column:
    """F16: a URL with its query string encoded; a null parameter is left out, 0 stays."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string")))) for k, v in parameters.items()]
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *parts))


def url_parameter(url: Column, name: str, default: str | None = None) -> Column:
    """a decoded query parameter, or the default."""
    return F.coalesce(F.url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(name))), F.lit(default))


def model_key_part(model_id: Column, revision: Column) -> Column:
    """what the address of a model's file holds."""
    return F.concat(F.lit("/"), model_id, F.lit("/resolve/"), F.url_encode(revision), F.lit("/"))


def parse_count(text: Column) -> Column:
    """Null for blank; otherwise digits as a number. Anything else raises."""
    value = F.trim(text)
    return F.when(value == "", F.lit(None)).when(value.rlike("^[0-9]+$"), value.cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a count: "), text)).cast("long"))


def is_run_id(text: Column) -> Column:
    """P10."""
    return F.coalesce(text.rlike("^[0-9]{8}T[0-9]{6}Z$"), F.lit(False))
