"""Scalar column expressions shared by the statistics operators; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def harmonic(n: Column | str) -> Column:
    """Watterson's constant: the sum of 1/i for i below ``n``; null for n < 2."""
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(c(n) - 1, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i)
    return F.when(c(n) >= 2, total)


def divide(x: Column | str, y: Column | str) -> Column:
    """x / y, null where y is 0 or either is null."""
    return F.when(c(y) != 0, c(x) / c(y))


def finite(x: Column | str) -> Column:
    """The value, or null for NaN and infinities, so that one of them does not spoil an aggregate."""
    return F.when(~F.isnan(c(x)) & (F.abs(c(x)) < float("inf")), c(x))


def number(x: Column | str) -> Column:
    """Text to double; empty and unreadable text is null."""
    return finite(F.expr(f"try_cast({x} AS DOUBLE)") if isinstance(x, str) else x.try_cast("double"))


def clamp_low(x: Column | str, low: float) -> Column:
    """max(x, low) that keeps nulls, unlike ``greatest``."""
    return F.when(c(x) < low, F.lit(low)).otherwise(c(x))


def folded(p: Column | str) -> Column:
    """Minor-allele frequency."""
    return F.least(c(p), F.lit(1) - c(p))


def right_closed_bin(x: Column | str, width: float) -> Column:
    """Upper edge of the right-closed bin of an integer distance: 1..w -> w, w + 1 -> 2w."""
    return (F.floor((c(x).cast("long") - 1) / F.lit(width)) + 1).cast("long") * F.lit(int(width))


def histogram_index(x: Column | str, low: Column | float, width: float) -> Column:
    """1-based right-closed bin that includes the lowest edge; edges are met within 1e-7 of a width."""
    low = low if isinstance(low, Column) else F.lit(low)
    return F.greatest(F.ceil((c(x) - low) / F.lit(width) - F.lit(1e-7)), F.lit(1)).cast("int")


def ne_from_diversity(x: Column | str, mutation_rate: float) -> Column:
    return c(x) / (4 * mutation_rate)


def ne_from_sexes(f: Column | str, m: Column | str) -> Column:
    return divide(F.lit(4.0) * c(f) * c(m), c(f) + c(m))


def level(x: Column | str, levels: Sequence[str]) -> Column:
    """1-based place of a label in an ordered list; null if absent."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), c(x))
    return F.when(place > 0, place.cast("int"))


def labelled(x: Column | str, names: dict[int, str]) -> Column:
    """A code's name, or pop_<code>."""
    known = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return F.coalesce(known[c(x)], F.concat(F.lit("pop_"), c(x).cast("string")))


def float_list(x: Column | str) -> Column:
    """Comma list to doubles, skipping empty entries."""
    return F.transform(F.filter(F.split(c(x), ","), lambda v: F.trim(v) != ""), lambda v: v.try_cast("double"))


def pseudo_log10(x: Column | str) -> Column:
    """asinh(x / 2) / ln 10: logarithmic in the tails, linear at 0."""
    return F.asinh(c(x) / 2) / F.lit(2.302585092994046)


def variant_id(chrom: Column | str, position: Column | str, ref: Column | str, alt: Column | str) -> Column:
    return F.concat_ws(":", c(chrom), c(position).cast("string"), c(ref), c(alt))
