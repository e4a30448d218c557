"""Numbers: rounding as the published document has it, display text, axis, clock."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_VALUE = "—"
NO_VALUE_REPORT = "–"


def _formatted(value: Column, pattern: str) -> Column:
    return F.call_function("format_number", value, F.lit(pattern))


def rounded(value: Column, digits: int = 6) -> Column:
    """M1."""
    return F.round(value, digits)


def seconds(milliseconds: Column) -> Column:
    """M2: seconds with three digits."""
    return F.round(milliseconds / 1000, 3)


def report_percent(fraction: Column) -> Column:
    """M3: percent with one digit from the exact binary value, ties to even; a dash for null."""
    return F.coalesce(_formatted(fraction * 100, "0.0"), F.lit(NO_VALUE_REPORT))


def fixed(value: Column, digits: int) -> Column:
    """A non-negative number with so many digits from its exact binary value, ties up."""
    scaled = value * float(2 ** (digits + 1))
    tie = (scaled == F.floor(scaled)) & (F.floor(scaled) % 2 == 1)
    pattern = "0" + ("." + "0" * digits if digits else "")
    return _formatted(F.when(tie, value + 10.0**-digits / 4).otherwise(value), pattern)


def page_percent(fraction: Column, digits: int = 1) -> Column:
    """M4."""
    return F.coalesce(F.concat(fixed(fraction * 100, digits), F.lit("%")), F.lit(NO_VALUE))


def page_fixed(value: Column, digits: int) -> Column:
    """M4."""
    return F.coalesce(fixed(value, digits), F.lit(NO_VALUE))


def as_shown(value: Column, digits: int) -> Column:
    """M5: the number that a reader sees; what is best is decided by it."""
    return fixed(value, digits).cast("double")


def count_text(value: Column) -> Column:
    """M6: rounded, with thousands separators."""
    return F.coalesce(F.format_number(F.floor(value + 0.5), 0), F.lit(NO_VALUE))


#: The powers of ten that a double holds exactly.
_POWERS = [10.0**e for e in range(23)]


def _decimal(mantissa: Column, exponent: Column) -> Column:
    """The double next to mantissa x 10^exponent, both whole: one product or quotient of exact numbers, or else from text."""
    power = lambda e: F.get(F.array(*map(F.lit, _POWERS)), e)
    exact, most = F.abs(mantissa) <= 2**53, len(_POWERS) - 1
    text = F.concat(mantissa.cast("string"), F.lit("e"), exponent.cast("string")).cast("double")
    whole = mantissa.cast("double")
    return F.when(exact & exponent.between(0, most), whole * power(exponent)).when(exact & exponent.between(-most, -1), whole / power(-exponent)).otherwise(text)


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def nice_axis(most: Column, ticks: int = 4) -> Column:
    """M7: struct(max, ticks) of an axis from 0, for about so many ticks; 0 and 1 where there is nothing to show.

    The step is the least of 1, 2 and 5 times a power of ten that takes no more steps than ticks; its multiples are made as whole
    numbers with an exponent, so none carries noise."""

    def shown(most: Column, step: Column) -> Column:
        at = lambda i: _decimal(i * step["m"], step["e"])
        near = F.greatest(F.floor(most / at(F.lit(1))).cast("long"), F.lit(0).cast("long"))
        last = _once(near, lambda n: F.when(at(n) >= most, n).otherwise(n + 1))
        return _once(last, lambda n: F.struct(at(n).alias("max"), F.transform(F.sequence(F.lit(0).cast("long"), n), at).alias("ticks")))

    def step(share: Column, around: Column) -> Column:
        steps = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), (around + up).alias("e")) for up in (-1, 0, 1) for m in (1, 2, 5)])
        return F.get(F.filter(steps, lambda s: _decimal(s["m"], s["e"]) >= share), F.lit(0))

    made = _once(most / ticks, lambda share: _once(F.floor(F.log10(share)).cast("int"), lambda around: _once(step(share, around), lambda s: shown(most, s))))
    nothing = F.struct(F.lit(1.0).alias("max"), F.array(F.lit(0.0), F.lit(1.0)).alias("ticks"))
    return F.when(most.isNull() | F.isnan(most) | (most <= 0) | (most == float("inf")), nothing).otherwise(made)


def clock(total: Column) -> Column:
    """M8: minutes and seconds, rounded half up, never negative; minutes may pass 59."""
    whole = F.greatest(F.lit(0), F.floor(total + 0.5)).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def clamp(samples: Column) -> Column:
    """M9: samples held within -1 and 1."""
    return F.transform(samples, lambda x: F.greatest(F.lit(-1.0).cast("float"), F.least(F.lit(1.0).cast("float"), x)))
