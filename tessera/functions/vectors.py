"""Vector arithmetic and distances as Column expressions over arrays.

Sums run in double, in index order. A zero denominator gives null where the ratio has no meaning
(cosine of a zero vector) and 0 where it counts as no difference (Canberra terms).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("double")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _paired(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(_d(x), _d(y)))


def squared_l2(a: Column, b: Column) -> Column:
    return total(_paired(a, b, lambda x, y: (x - y) * (x - y)))


def whole_l2(a: Column, b: Column) -> Column:
    """Squared L2 of vectors of whole numbers (bytes, say), in whole numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)


def inner_product(a: Column, b: Column) -> Column:
    return total(_paired(a, b, lambda x, y: x * y))


def squared_norm(a: Column) -> Column:
    return total(F.transform(a, lambda x: _d(x) * _d(x)))


def norm(a: Column) -> Column:
    return F.sqrt(squared_norm(a))


def cosine(a: Column, b: Column) -> Column:
    return inner_product(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l1(a: Column, b: Column) -> Column:
    return total(_paired(a, b, lambda x, y: F.abs(x - y)))


def linf(a: Column, b: Column) -> Column:
    return F.array_max(_paired(a, b, lambda x, y: F.abs(x - y)))


def lp(a: Column, b: Column, p: float) -> Column:
    """Sum of p-th powers; no root is taken."""
    return total(_paired(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))))


def canberra(a: Column, b: Column) -> Column:
    return total(_paired(a, b, lambda x, y: F.coalesce(F.abs(x - y) / F.nullif(F.abs(x) + F.abs(y), F.lit(0.0)), F.lit(0.0))))


def bray_curtis(a: Column, b: Column) -> Column:
    return l1(a, b) / F.nullif(total(_paired(a, b, lambda x, y: F.abs(x + y))), F.lit(0.0))


def jensen_shannon(a: Column, b: Column) -> Column:
    """Of positive vectors."""

    def term(x: Column, y: Column) -> Column:
        middle = (x + y) / 2
        return -x * F.ln(middle / x) - y * F.ln(middle / y)

    return total(_paired(a, b, term)) / 2


def jaccard(a: Column, b: Column) -> Column:
    """Of non-negative vectors: sum of minima by sum of maxima."""
    return total(_paired(a, b, F.least)) / F.nullif(total(_paired(a, b, F.greatest)), F.lit(0.0))


def normalised(a: Column) -> Column:
    """a / |a|; a zero vector stays."""
    n = norm(a)
    return F.transform(F.arrays_zip(a.alias("x"), F.array_repeat(F.when(n == 0, 1.0).otherwise(n), F.size(a)).alias("n")), lambda z: _d(z["x"]) / z["n"])


def add(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x - y)


def add_scalar(a: Column, s: float) -> Column:
    return F.transform(a, lambda x: _d(x) + F.lit(float(s)))


def multiply_add(a: Column, factor: float, b: Column) -> Column:
    """a + factor * b."""
    return _paired(a, b, lambda x, y: x + F.lit(float(factor)) * y)


def multiply_add_argmin(a: Column, factor: float, b: Column) -> Column:
    """struct(at, least): the least entry of a + factor * b and its first position, from 0."""
    made = multiply_add(a, factor, b)
    least = F.array_min(made)
    return F.struct((F.array_position(made, least) - 1).cast("int").alias("at"), least.alias("least"))


def l2_from_inner_product(ip: Column, a: Column, b: Column) -> Column:
    return squared_norm(a) + squared_norm(b) - 2 * ip


def relative_error(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.nullif(F.abs(b), F.lit(0.0))


def sign_bits(a: Column) -> Column:
    return F.transform(a, lambda x: F.when(_d(x) >= 0, 1).otherwise(0))


def bits_to_floats(a: Column) -> Column:
    return F.transform(a, lambda x: 2.0 * x - 1.0)


def packed_bits(bits: Column, width: int) -> Column:
    """Words of 32 bits, least first, as an array of longs."""
    return F.array(*[
        sum((F.get(bits, F.lit(i)).cast("long") * F.lit(1 << (i - low)) for i in range(low, min(low + 32, width))), F.lit(0).cast("long"))
        for low in range(0, width, 32)
    ])


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of packed words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def generalised_hamming(a: Column, b: Column) -> Column:
    """Positions that differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def shuffled(a: Column, order: list[int]) -> Column:
    """The entries of a at these positions, from 0; -1 gives 0."""
    return F.array(*[F.lit(0.0) if i < 0 else _d(F.get(a, F.lit(i))) for i in order])


def k_least(a: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.transform(a, _d)), 1, k)


def k_greatest(a: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.transform(a, _d), asc=False), 1, k)


def checksum(a: Column) -> Column:
    return F.xxhash64(a)


#: name -> (distance of two arrays, True if greater is nearer)
METRICS = {
    "l2": (squared_l2, False),
    "ip": (inner_product, True),
    "cosine": (cosine, True),
    "ip_distance": (lambda a, b: 1 - inner_product(a, b), False),
    "cosine_distance": (lambda a, b: 1 - cosine(a, b), False),
    "l2_whole": (lambda a, b: whole_l2(a, b).cast("double"), False),
    "l1": (l1, False),
    "linf": (linf, False),
    "lp": (lambda a, b: lp(a, b, 3.0), False),
    "canberra": (canberra, False),
    "bray_curtis": (bray_curtis, False),
    "jensen_shannon": (jensen_shannon, False),
    "jaccard": (jaccard, True),
}
