"""Arrays, structs and tri-state values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a segment at most, and of the last one at least.
SEGMENT_SECONDS, LEAST_SECONDS = 30.0, 0.1


def downmix(channels: Column) -> Column:
    """The mean over channels, array<array<double>>; none gives an empty array."""
    n = F.size(channels)
    total = F.aggregate(F.slice(channels, F.lit(2), F.greatest(n - 1, F.lit(0))), F.get(channels, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return F.when(n == 0, F.array().cast("array<double>")).otherwise(F.transform(total, lambda x: x / n))


def segments(samples: Column, rate: float, most: float = SEGMENT_SECONDS, least: float = LEAST_SECONDS) -> Column:
    """array<struct<start_sec, end_sec>> of a signal of so many samples; a last part that is too short is dropped."""
    length, short = int(rate * most), -int(-rate * least // 1)
    starts = F.when(samples > 0, F.sequence(F.lit(0), samples.cast("int") - 1, F.lit(length))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(starts, lambda s: F.struct((s / rate).alias("start_sec"), (F.least(s + length, samples) / rate).alias("end_sec"), (F.least(s + length, samples) - s).alias("n")))
    return F.transform(F.filter(parts, lambda p: p["n"] >= short), lambda p: F.struct(p["start_sec"].alias("start_sec"), p["end_sec"].alias("end_sec")))


def cached_files(urls: Column, part: Column) -> Column:
    """How many addresses over all caches, array<array<string>>, hold the part."""
    return F.size(F.filter(F.flatten(urls), lambda u: F.contains(u, part)))


def first_version(brands: Column, names: tuple[str, ...]) -> Column:
    """The version of the first brand with one of the names, from array<struct<brand, version>>."""
    return F.get(F.filter(brands, lambda b: b["brand"].isin(*names)), F.lit(0))["version"]


def download_flag(before: Column, after: Column) -> Column:
    """Whether files were added; null if unknown or if none is there after loading."""
    return F.when(before.isNull() | after.isNull() | (after == 0), F.lit(None)).otherwise(after > before)


def tri_state(flag: Column, yes: str, no: str, unknown: str) -> Column:
    """C7."""
    return F.when(flag.isNull(), unknown).when(flag, yes).otherwise(no)


def resolved(recorded: Column, requested: Column, default: Column, exists: Column) -> Column:
    """struct(value, mismatch): on a resume the recorded value wins and another explicit one is a mismatch."""
    value = F.when(exists, F.coalesce(recorded, default)).otherwise(F.coalesce(requested, default))
    clash = exists & requested.isNotNull() & ~requested.eqNullSafe(F.coalesce(recorded, default))
    return F.struct(value.alias("value"), clash.alias("mismatch"))


def required(settings: dict[str, Column]) -> dict[str, Column]:
    """The values of several resolved() settings; a row with mismatches raises, and all of them are named."""
    wrong = F.concat_ws(", ", *[F.when(s["mismatch"], F.concat(F.lit(f"{name} (recorded: "), F.coalesce(s["value"].cast("string"), F.lit("none")), F.lit(")"))) for name, s in settings.items()])
    return {name: F.when(wrong == "", s["value"]).otherwise(F.raise_error(F.concat(F.lit("settings differ from the run's: "), wrong))) for name, s in settings.items()}


def reassigned(values: Column, names: list[str]) -> Column:
    """arguments by name, array<string> in the order of `names` to map<string,string>: `name=value` goes to that name, what
    it leaves is empty; a name given twice, or also by its place, raises."""
    order = F.array(*map(F.lit, names))
    pairs = F.transform(F.arrays_zip(order.alias("slot"), values.alias("value")), lambda x: F.struct(x["slot"].alias("slot"), F.coalesce(x["value"], F.lit("")).alias("value"), F.regexp_extract(F.coalesce(x["value"], F.lit("")), "^([^=]*)=", 1).alias("name")))
    named = F.filter(pairs, lambda x: x["value"].contains("=") & F.array_contains(order, x["name"]))
    placed = F.filter(pairs, lambda x: ~(x["value"].contains("=") & F.array_contains(order, x["name"])))
    own = lambda slot: F.filter(named, lambda x: x["name"] == slot)
    here = lambda slot: F.coalesce(F.get(F.filter(placed, lambda x: x["slot"] == slot), F.lit(0))["value"], F.lit(""))

    def value(slot: Column) -> Column:
        given = F.get(own(slot), F.lit(0))
        text = F.substr(given["value"], F.length(slot) + 2)
        fault = F.when(F.size(own(slot)) > 1, F.concat(slot, F.lit(" is given twice"))).when(given.isNotNull() & (F.trim(here(slot)) != ""), F.concat(slot, F.lit(" is given by name and by place")))
        return F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).when(given.isNotNull(), text).otherwise(here(slot))

    return F.map_from_entries(F.transform(order, lambda slot: F.struct(slot.alias("key"), value(slot).alias("value"))))
