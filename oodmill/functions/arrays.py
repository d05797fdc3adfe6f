"""Array and numeric functions on columns: bins, fingerprints, residue arrays, hyperplane hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def right_closed_bin(c: Column, lo: float, hi: float, width: float) -> Column:
    """0-based bin of (lo, lo + width], ...; NULL outside (lo, hi] and for NULL."""
    return F.when((c > lo) & (c <= hi), F.ceil(F.round((c - lo) / width, 9)).cast("int") - 1)


def clipped_bin(c: Column, lo: float, hi: float, width: float) -> Column:
    """Right-closed bins as text, the two clip values as bins of their own."""
    inner = right_closed_bin(c, lo, hi, width)
    return F.when(c <= lo, "clip_lo").when(c >= hi, "clip_hi").otherwise(F.concat(F.lit("bin_"), inner.cast("string")))


def discretise(c: Column, boundaries: list[float]) -> Column:
    """How many boundaries lie below the value."""
    return F.aggregate(F.array(*[F.lit(float(b)) for b in boundaries]), F.lit(0), lambda n, b: n + F.when(c > b, 1).otherwise(0))


def on_bits(c: Column) -> Column:
    """Indices (0-based) of the positive entries of a numeric array."""
    return F.filter(F.transform(c, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())


def dense_bits(bits: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(bits, i).cast("int"))


def parse_ints(c: Column) -> Column:
    """Array of a bracketed list, blanks or commas between; nan becomes -1."""
    parts = F.filter(F.split(F.regexp_replace(c, r"[\[\]]", " "), r"[\s,]+"), lambda t: t != "")
    return F.transform(parts, lambda t: F.when(F.lower(t) == "nan", -1).otherwise(t.try_cast("int")))


def masked_ratio(labels: Column) -> Column:
    """Share of ones among entries that are not masked (-1); NULL where all are."""
    valid = F.filter(labels, lambda v: v >= 0)
    return F.try_divide(F.size(F.filter(valid, lambda v: v == 1)).cast("double"), F.size(valid).cast("double"))


def length_ratio(labels: Column) -> Column:
    """Share of ones over the whole length, masked entries included; NULL for an empty array."""
    return F.try_divide(F.size(F.filter(labels, lambda v: v == 1)).cast("double"), F.size(labels).cast("double"))


def padded(c: Column, n: int, fill: int = 0) -> Column:
    return F.slice(F.concat(c, F.array_repeat(F.lit(fill), n)), 1, n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hyperplane_token(c: Column, planes: list[list[float]]) -> Column:
    """Bits of the sides of random hyperplanes, first plane lowest."""
    bits = [F.when(dot(c, F.array(*[F.lit(float(x)) for x in p])) > 0, 1 << i).otherwise(0) for i, p in enumerate(planes)]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out


def rbf(c: Column, centers: list[float], width: float) -> Column:
    return F.transform(F.array(*[F.lit(float(x)) for x in centers]), lambda m: F.exp(-F.pow((c - m) / width, F.lit(2.0))))
