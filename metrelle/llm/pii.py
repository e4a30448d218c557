"""Personal data by weak supervision, with DataFrame functions only.

Candidates are the matches of one base pattern per kind, and of one wider pattern per kind for what is written otherwise:
`name (at) host dot tld`, bare national phone numbers, IPs and cards with odd separators. Labelers vote on every candidate:
the base pattern with its check, a check of the candidate's form, a gazetteer of words that announce the kind, and the
context next to it. Votes are counted over all candidates of all documents; expectation-maximisation on those counts - their
number depends on the labelers alone - estimates each labeler's reliability and a posterior for every vote pattern. A naive
Bayes span classifier is then trained on the posteriors of all candidates, over hashed context words, shape and length, and
decides on the candidates that aren't base spans. Base spans always stay.

Defined results: a null text is empty; spans count code points, end exclusive; a text of any length is searched whole, and
no pattern backtracks or recurses over long runs; spans of one start go by kind; repeated rows each give a row; an empty table gives none; other columns
are ignored, and `redacted` passes them on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrelle.llm.common import cut

#: Kinds in their order; fixed values.
KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that no start is tried twice in a run, no group recurses and what is too
#: short for a card is no match; what they find and passes its check is the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=(?:[\x20-]?[0-9]){14})[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth running: cheap tests that no match can fail.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[{](?:at|AT)[)\]}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[{](?:dot|DOT)[)\]}])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[\.\]|\x20?\.\x20?)[0-9]{1,3}(?:\[\.\]|\x20?\.\x20?)[0-9]{1,3}(?:\[\.\]|\x20?\.\x20?)[0-9]{1,3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}([._/]|\x20{2})[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: Words that announce a kind.
GAZETTEER = {
    "email": ("email", "mail", "e-mail", "contact", "write", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "addr", "from", "client"),
    "card": ("card", "visa", "credit", "payment", "mastercard", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telephone", "telefono"),
}
CONTEXT = 40
BUCKETS = 512
#: The posterior from which a candidate beside the base becomes a span.
ACCEPT = 0.9


#: Matches whose places are summed one by one; sums of such parts are added then, so that long texts with many matches stay cheap.
PART = 256
_SPAN = "struct<start:int,end:int,match:string,left:string,right:string>"


def with_spans(rows: DataFrame, text: str, patterns: dict[str, tuple[Column, str]]) -> DataFrame:
    """rows and, for each name of patterns (when to look, pattern), array<struct<start, end, match, left, right>> of the leftmost
    non-overlapping matches, in code points; empty where it isn't to be looked.

    The parts between matches and the matches alternate, so places are running sums of their lengths; left and right are what
    stands around, CONTEXT at most, and reach one match far. Every array that a lambda looks into is a column of a projection
    below, as it would be made anew for each element otherwise."""
    kept = rows.columns
    string = F.array().cast("array<string>")
    made = {}
    for name, (may, pattern) in patterns.items():
        made |= {f"__m_{name}": F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(string), f"__b_{name}": F.when(may, F.split(text, pattern)).otherwise(string)}
    rows = rows.withColumns(made)
    near = {}
    for name in patterns:
        m, b, n = F.col(f"__m_{name}"), F.col(f"__b_{name}"), F.size(f"__m_{name}")
        none, rest = F.array(F.lit("")), F.greatest(n - 1, F.lit(0))
        before, after = F.concat(none, F.slice(m, F.lit(1), rest)), F.concat(F.slice(m, F.lit(2), rest), none)
        zipped = F.arrays_zip(F.slice(b, F.lit(1), n).alias("b"), m.alias("m"), before.alias("before"), F.slice(b, F.lit(2), n).alias("after"), after.alias("next"))
        near[f"__n_{name}"] = F.when(n > 0, zipped)
    rows = rows.withColumns(near).select(*kept, *near)
    kind = f"array<{_SPAN}>"

    def place(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        left, right = F.right(F.concat(x["before"], x["b"]), F.lit(CONTEXT)), F.left(F.concat(x["after"], x["next"]), F.lit(CONTEXT))
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match"), left.alias("left"), right.alias("right"))
        return F.struct(F.concat(state["out"], F.array(span)).alias("out"), end.alias("at"))

    parts = {}
    for name in patterns:
        n = F.col(f"__n_{name}")
        last = F.floor((F.size(n) - 1) / PART).cast("int")
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.aggregate(F.slice(n, i * PART + 1, F.lit(PART)), F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("at")), place))  # noqa: B023
        parts[f"__p_{name}"] = F.when(n.isNotNull(), each)
    rows = rows.withColumns(parts).select(*kept, *parts)
    move = lambda x, by: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["match"].alias("match"), x["left"].alias("left"), x["right"].alias("right"))

    def joined(s: Column, p: Column) -> Column:
        return F.struct(F.concat(s["out"], F.array(F.transform(p["out"], lambda x: move(x, s["at"])))).alias("out"), (s["at"] + p["at"]).alias("at"))

    whole = {}
    for name in patterns:
        p = F.col(f"__p_{name}")
        found = F.aggregate(p, F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.lit(0).alias("at")), joined, lambda s: F.flatten(s["out"]))
        whole[name] = F.when(p.isNull(), F.array().cast(kind)).when(F.size(p) == 1, F.get(p, F.lit(0))["out"]).otherwise(found)
    return rows.select(*kept, *[c.alias(name) for name, c in whole.items()])


def apart(wide: Column, base: Column) -> Column:
    """The spans of `wide`, which don't meet each other, that meet none of `base`.

    A span meets one of them unless as many of them begin before its end as end by its start. Both numbers are places in a sorted
    list of ends and starts, less the spans before."""

    def rank(mine: str, theirs: str, first: int) -> Column:
        events = F.array_sort(F.concat(F.transform(wide, lambda x: F.struct(x[mine].alias("p"), F.lit(1 - first).alias("t"), F.lit(0).alias("o"))), F.transform(base, lambda x: F.struct(x[theirs].alias("p"), F.lit(first).alias("t"), F.lit(1).alias("o")))))
        return F.transform(F.filter(F.transform(events, lambda x, i: F.struct(x["o"].alias("o"), i.alias("i"))), lambda x: x["o"] == 0), lambda x, j: x["i"] - j)

    zipped = F.arrays_zip(wide.alias("w"), rank("end", "start", 1).alias("a"), rank("start", "end", 0).alias("b"))
    return F.when(F.size(wide) == 0, wide).otherwise(F.transform(F.filter(zipped, lambda x: x["a"] == x["b"]), lambda x: x["w"]))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: (d.cast("int") * (1 + i % 2)))
    return F.aggregate(each, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """Whether a match of the base pattern, or the like, passes its kind's check."""
    digits = _digits(match)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0))
        value = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(parts, lambda p: (F.length(value(p)) <= 3) & (F.substring(value(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(F.substring(digits, 1, 19))).otherwise(False)
    return F.length(digits).between(10, 15)


def candidates(documents: DataFrame) -> DataFrame:
    """(row, doc_id, found): for each row its candidate spans of all kinds, struct(kind, start, end, match, base, left, right)."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("t"))
    # A digit is needed by all kinds but email; most texts have neither a digit nor an at sign in reach.
    has_digit = F.col("t").rlike("[0-9]")
    patterns = {}
    for kind in KINDS:
        may = F.col("t").contains(NEEDS[kind]) if NEEDS[kind] else F.lit(True)
        may = may if kind == "email" else may & has_digit
        if kind == "card":
            may = may & F.col("t").rlike("[0-9][0-9\\x20-]{13}")
        patterns[f"found_{kind}"] = (may, BASE[kind])
        wide_may = F.col("t").rlike("[(\\[{](?:at|AT)[)\\]}]") if kind == "email" else has_digit & F.col("t").rlike(WIDE[kind])
        patterns[f"wide_{kind}"] = (wide_may, WIDE[kind])
    rows = with_spans(rows, "t", patterns)
    every = rows.withColumns({f"base_{k}": F.filter(f"found_{k}", lambda x: valid(k, x["match"])) for k in KINDS})  # noqa: B023
    every = every.select("row", "doc_id", *[f"{part}_{k}" for part in ("base", "wide") for k in KINDS])
    told = lambda array, order, base: F.transform(array, lambda x: F.struct(F.lit(order).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), F.lit(base).alias("base"), x["left"].alias("left"), x["right"].alias("right")))
    every = every.withColumn("own", F.concat(*[F.col(f"base_{k}") for k in KINDS]))
    # A candidate beside the base that meets a base span says nothing new.
    both = [told(F.col(f"base_{k}"), o, True) for o, k in enumerate(KINDS)] + [told(apart(F.col(f"wide_{k}"), F.col("own")), o, False) for o, k in enumerate(KINDS)]
    return every.select("row", "doc_id", F.concat(*both).alias("found"))


LABELERS = ("regex", "form", "gazetteer", "context")


def votes(kind: Column, match: Column, base: Column, left: Column, right: Column) -> list[Column]:
    """A vote per labeler: 1 for, -1 against, 0 abstains."""
    by_kind = lambda cases: F.coalesce(*[F.when(kind == o, c) for o, c in enumerate(cases)])
    digits = _digits(match)
    form = by_kind(
        [
            match.rlike("^[^A-Za-z0-9]*[A-Za-z0-9]") & F.substring_index(F.regexp_replace(match, r"[^A-Za-z0-9-]+", "."), ".", -1).rlike("^[A-Za-z]{2,24}$"),
            valid("ip", match) & ~match.rlike("^0"),
            valid("card", match) & digits.rlike("^[2-6]"),
            F.length(digits).between(10, 15) & ~digits.rlike("^(.)\\1*$"),
        ]
    )
    heard = [F.lower(left).rlike("(?<![a-z])(?:" + "|".join(GAZETTEER[k]) + ")(?![a-z])") for k in KINDS]
    own = by_kind(heard)
    other = by_kind([F.greatest(*[h.cast("int") for j, h in enumerate(heard) if j != i]) > 0 for i in range(len(KINDS))])
    apart = ~left.rlike(r"[0-9A-Za-z/=\\]$") & ~right.rlike(r"^[0-9A-Za-z/=\\]")
    sign = lambda c: F.when(c, 1).otherwise(-1)
    return [base.cast("int").alias("regex"), sign(form).alias("form"), F.when(own, 1).when(other, -1).otherwise(0).alias("gazetteer"), sign(apart).alias("context")]


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[int, tuple[int, ...]], float]:
    """The posterior of every (kind, votes) from their counts, by expectation-maximisation.

    Each labeler has a vote distribution for true and for false candidates, over all kinds; each kind has its own share of
    true ones. It starts from the share of votes that are for."""
    post = {}
    for kind, vote, _ in patterns:
        cast = [v for v in vote if v]
        post[kind, vote] = min(0.95, max(0.05, sum(v > 0 for v in cast) / len(cast))) if cast else 0.5
    for _ in range(rounds):
        share, table = {}, {}
        for kind in {k for k, _, _ in patterns}:
            n = sum(c for k, _, c in patterns if k == kind)
            share[kind] = (1 + sum(c * post[k, v] for k, v, c in patterns if k == kind)) / (2 + n)
        for j in range(len(LABELERS)):
            for truth in (True, False):
                mass = {value: 0.5 for value in (-1, 0, 1)}
                for kind, vote, c in patterns:
                    mass[vote[j]] += c * (post[kind, vote] if truth else 1 - post[kind, vote])
                total = sum(mass.values())
                table[j, truth] = {value: m / total for value, m in mass.items()}
        for kind, vote, _ in patterns:
            odds = math.log(share[kind] / (1 - share[kind])) + sum(math.log(table[j, True][v] / table[j, False][v]) for j, v in enumerate(vote))
            post[kind, vote] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def features(match: Column, left: Column, right: Column) -> Column:
    """Hashed features of a span: the two words before it, the one after it, its shape and its length."""
    before = F.regexp_extract_all(F.lower(left), F.lit(r"[^\s0-9]+"), F.lit(0))
    shape = F.regexp_replace(F.regexp_replace(match, "[0-9]+", "9"), "[A-Za-z]+", "a")
    named = [
        F.concat(F.lit("1 "), F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit(""))),
        F.concat(F.lit("2 "), F.coalesce(F.try_element_at(before, F.lit(-2)), F.lit(""))),
        F.concat(F.lit("3 "), F.regexp_extract(F.lower(right), r"[^\s0-9]+", 0)),
        F.concat(F.lit("4 "), shape),
        F.concat(F.lit("5 "), F.least(F.length(match), F.lit(40)).cast("string")),
    ]
    return F.transform(F.array(*named), lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))


def accepted(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, probability) of the candidates beside the base that the trained span classifier accepts."""
    spark = found.sparkSession
    each = found.filter("size(found) > 0").select("row", F.explode("found").alias("x")).select("row", "x.*")
    each = each.select("row", "kind", "start", "end", "base", *votes(*[F.col(c) for c in ("kind", "match", "base", "left", "right")]), features(F.col("match"), F.col("left"), F.col("right")).alias("f"))
    counted = each.groupBy("kind", *LABELERS).count().collect()  # at most as many rows as there are vote patterns
    if all(r["regex"] for r in counted):
        return spark.createDataFrame([], "row long, kind int, start int, end int, probability double")
    post = reliabilities([(r["kind"], tuple(r[n] for n in LABELERS), r["count"]) for r in counted])
    table = spark.createDataFrame([(k, *v, p) for (k, v), p in post.items()], ", ".join(["kind int", *[f"{n} int" for n in LABELERS], "p double"]))
    judged = each.join(F.broadcast(table), ["kind", *LABELERS])
    sums = judged.select("kind", "p", F.explode("f").alias("f")).groupBy("kind", "f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()  # BUCKETS a kind
    weights, prior = [], []
    for kind in sorted({r["kind"] for r in sums}):
        own = [r for r in sums if r["kind"] == kind]
        yes, no = sum(r["yes"] for r in own), sum(r["no"] for r in own)
        prior.append((kind, math.log((yes + 1) / (no + 1))))
        weights += [(kind, r["f"], math.log((r["yes"] + 0.5) / (yes + 0.5 * BUCKETS)) - math.log((r["no"] + 0.5) / (no + 0.5 * BUCKETS))) for r in own]
    weight = spark.createDataFrame(weights, "kind int, f int, w double")
    first = spark.createDataFrame(prior, "kind int, prior double")
    open_ = each.filter("NOT base").select("row", "kind", "start", "end", F.explode("f").alias("f")).join(F.broadcast(weight), ["kind", "f"])
    score = open_.groupBy("row", "kind", "start", "end").agg(F.sum("w").alias("w")).join(F.broadcast(first), "kind")
    return score.select("row", "kind", "start", "end", (1 / (1 + F.exp(-F.col("w") - F.col("prior")))).alias("probability")).filter(F.col("probability") >= ACCEPT)


def _listed(array: Column) -> Column:
    """kind:start:end of spans, by start and then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(array, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def detected(documents: DataFrame) -> DataFrame:
    """(row, doc_id, base, all): for every row of documents its base spans and all spans, struct(kind, start, end)."""
    found = cut(candidates(documents))
    more = accepted(found).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    base = F.transform(F.filter("found", lambda x: x["base"]), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    both = found.select("row", "doc_id", base.alias("base")).join(more, "row", "left")
    return both.select("row", "doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")).alias("all"))


def redacted(documents: DataFrame) -> DataFrame:
    """documents with every span of the text replaced by its kind in angle brackets; rows without an id are left as they are."""
    spans_of = detected(documents).filter("size(all) > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.any_value(F.array_sort(F.transform("all", lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("k"))))).alias("__spans"))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    text = F.col("text")

    def step(state: Column, x: Column) -> Column:
        piece = F.concat(state["out"], F.substring(text, state["at"] + 1, F.greatest(x["s"] - state["at"], F.lit(0))), F.get(names, x["k"]))
        return F.struct(F.when(x["s"] >= state["at"], piece).otherwise(state["out"]).alias("out"), F.greatest(state["at"], x["e"]).alias("at"))

    clean = F.aggregate("__spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return documents.join(spans_of, "doc_id", "left").withColumn("text", F.when(F.col("__spans").isNull(), text).otherwise(clean)).select(*documents.columns)


def digest(documents: DataFrame) -> DataFrame:
    """The rows of query op2_pii."""
    found = detected(documents)
    number = lambda o, name: F.size(F.filter("base", lambda x: x["kind"] == o)).cast("long").alias(f"n_{name}")
    return found.select("doc_id", *[number(o, k) for o, k in enumerate(KINDS)], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"))
