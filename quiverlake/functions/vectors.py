"""Column functions over vectors (array<double>).  Smaller distances are nearer; L2 is squared, IP is negated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    """Elements as doubles: all arithmetic is in double precision."""
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def ip(a: Column, b: Column) -> Column:
    return -dot(a, b)


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


METRICS = {"l2": l2, "ip": ip, "cosine": cosine, "l1": l1}


def distance(metric: str, a: Column | str, b: Column | str) -> Column:
    """Distance of two vector columns under a named metric."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return METRICS[metric](column(a), column(b))


def normalized(a: Column) -> Column:
    """The vector at unit length; a zero vector has null elements."""
    length = norm(a)
    return F.transform(a, lambda x: F.try_divide(x, length))


def silhouette(own: Column, other: Column) -> Column:
    """(other - own) / max, where a negative maximum (of negated products) counts by size; 0 where it is 0."""
    top = F.greatest(own, other)
    scale = F.when(top < 0, F.greatest(-own, -other)).otherwise(top)
    return F.when(scale != 0, (other - own) / scale).otherwise(F.lit(0.0))


def boundary_ratio(first: Column, second: Column) -> Column:
    """How far apart the two nearest are, relative to the larger."""
    return F.abs(second - first) / F.greatest(F.abs(first), F.abs(second))


def sq8_encode(v: Column, low: Column, width: Column) -> Column:
    """8-bit codes: clamped, scaled to 256 steps, truncated."""
    def one(p: Column) -> Column:
        inside = F.least(F.greatest(p["v"] - p["low"], F.lit(0.0)), p["width"])
        return F.when(p["width"] > 0, F.least(F.floor(inside / p["width"] * 256), F.lit(255))).otherwise(F.lit(0)).cast("int")

    return F.transform(F.arrays_zip(v.alias("v"), low.alias("low"), width.alias("width")), one)


def sq8_decode(codes: Column, low: Column, width: Column) -> Column:
    """Middle of each code's step: alpha * code + beta, alpha = width / 256, beta = alpha / 2 + low."""
    zipped = F.arrays_zip(codes.alias("c"), low.alias("low"), width.alias("width"))
    return F.transform(zipped, lambda p: p["c"] * (p["width"] / 256) + (p["width"] / 512 + p["low"]))


def pairwise_mask(v: Column, low: Column, width: Column, group: int = 4) -> Column:
    """For each group of dimensions, whether all its values lie in their range."""
    inside = F.transform(F.arrays_zip(v.alias("v"), low.alias("low"), width.alias("width")), lambda p: (p["v"] >= p["low"]) & (p["v"] <= p["low"] + p["width"]))
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / group).cast("int") - 1), lambda g: F.forall(F.slice(inside, g * group + 1, group), lambda x: x))


def _ranged(first: Column, mask: Column, low: Column, width: Column, tight_low: Column, tight_width: Column, one, group: int) -> Column:
    zipped = F.arrays_zip(first.alias("v"), low.alias("low"), width.alias("width"), tight_low.alias("tl"), tight_width.alias("tw"))

    def of(p: Column, i: Column) -> Column:
        tight = F.get(mask, F.floor(i / group).cast("int"))
        return one(p["v"], F.when(tight, p["tl"]).otherwise(p["low"]), F.when(tight, p["tw"]).otherwise(p["width"]))

    return F.transform(zipped, of)


def pairwise_encode(v: Column, mask: Column, low: Column, width: Column, tight_low: Column, tight_width: Column, group: int = 4) -> Column:
    """2-bit codes: clamped to the group's range, scaled to four steps, truncated."""
    def one(x: Column, a: Column, w: Column) -> Column:
        inside = F.least(F.greatest(x - a, F.lit(0.0)), w)
        return F.when(w > 0, F.least(F.floor(F.try_divide(inside, w) * 4), F.lit(3))).otherwise(F.lit(0)).cast("int")

    return _ranged(v, mask, low, width, tight_low, tight_width, one, group)


def pairwise_decode(codes: Column, mask: Column, low: Column, width: Column, tight_low: Column, tight_width: Column, group: int = 4) -> Column:
    """Middle of each code's step in its group's range."""
    return _ranged(codes, mask, low, width, tight_low, tight_width, lambda c, a, w: c * (w / 4) + (w / 8 + a), group)


#: Fixed odd factors of the draws' mixer, all below 2**32 so that no product leaves 63 bits.
SPREAD, STIR = (2654435761, 2246822519, 3266489917), ((15, 739982445), (13, 695872825))


def uniform(number: Column) -> Column:
    """A number in (0, 1), a multiple of 2**-33, that depends on all 64 bits of a whole number, for draws that every run repeats.

    Parts of the number are spread over 32 bits, which are then stirred by shifts and
    products; plain arithmetic, so that any SQL can say it.
    """
    number, word = number.cast("long"), F.lit(1 << 32)
    parts = (F.pmod(number, F.lit(1 << 30)), F.pmod(F.shiftright(number, 30), F.lit(1 << 30)), F.pmod(F.shiftright(number, 60), F.lit(16)))
    x = F.pmod(parts[0] * SPREAD[0] + parts[1] * SPREAD[1] + parts[2] * SPREAD[2] + 12345, word)
    for shift, factor in STIR:
        x = F.pmod(x.bitwiseXOR(F.shiftright(x, shift)) * factor, word)
    return (x.bitwiseXOR(F.shiftright(x, 16)) + 0.5) / float(1 << 32)


def _bit(i: Column) -> Column:
    return F.get(F.array(*(F.lit(1 << k) for k in range(8))), (i % 8).cast("int"))


def packed_mask(mask: Column) -> Column:
    """Flags as bytes, eight each, the first in the lowest bit."""
    bits = F.transform(mask, lambda on, i: F.when(on, _bit(i)).otherwise(0))
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(mask) / 8).cast("int") - 1), lambda g: F.aggregate(F.slice(bits, g * 8 + 1, F.lit(8)), F.lit(0), lambda s, x: s + x))


def unpacked_mask(packed: Column, size: int) -> Column:
    """The first `size` flags of packed bytes."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(packed, F.floor(i / 8).cast("int")).bitwiseAND(_bit(i)) != 0)
