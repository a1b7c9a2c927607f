"""Column functions: hash families, string hashes, trailing zeros, set similarity, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed table of (a, b, p): a and b below 65535, p a prime above the range.
HASHES = tuple(((7919 * (i + 3) * (i + 11)) % 65521 + 1, (104729 * (i + 5) * (i + 7)) % 65521 + 1, 65537) for i in range(12))


def linear_hash(x: Column, a: int, b: int, p: int, m: int) -> Column:
    """((a x + b) mod p) mod m, with x taken mod p first so that products stay small."""
    return ((F.lit(a) * F.pmod(x, F.lit(p)) + F.lit(b)) % p) % m


def string_mod(text: Column, p: int) -> Column:
    """The UTF-8 bytes of a text as one big number, modulo ``p``; the empty text is 0."""
    digits = F.hex(F.encode(text, "UTF-8"))
    nibble = lambda i: F.conv(F.substring(digits, i, F.lit(1)), 16, 10).cast("long")
    at = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(at, F.lit(0).cast("long"), lambda acc, i: (acc * 16 + nibble(i)) % p)


def trailing_zeros(h: Column) -> Column:
    """Trailing zero bits; 0 for 0."""
    return F.when(h == 0, 0).otherwise(F.bit_count(h.bitwiseAND(-h) - 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; null if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double"))


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def mahalanobis(x: Column, centroid: list[float], std: list[float]) -> Column:
    """Diagonal Mahalanobis distance; dimensions without spread are left out."""
    parts = [F.pow((x[i] - F.lit(float(c))) / F.lit(float(s)), 2) for i, (c, s) in enumerate(zip(centroid, std, strict=True)) if s > 0]
    total = parts[0] if parts else F.lit(0.0)
    for p in parts[1:]:
        total = total + p
    return F.sqrt(total)
