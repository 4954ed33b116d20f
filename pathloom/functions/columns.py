"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_NORM_SIMILARITY = 0.95  # fixed value: similarity reported for a zero vector


def finite(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def null_if_not_finite(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(finite(c), c)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def hash_hex(*parts) -> Column:
    """Hex SHA-256 of the parts joined by '|'."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256)


def hash_int(*parts) -> Column:
    """First 52 bits of the hash as a non-negative BIGINT."""
    return F.conv(F.substring(hash_hex(*parts), 1, 13), 16, 10).cast("bigint")


def hash_mod(n, *parts) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(hash_int(*parts), n.cast("bigint"))


def quantise(v: Column, width: float) -> Column:
    """Nearest multiple of ``width``, halves upward."""
    return F.floor(v / width + 0.5) * F.lit(float(width))


def level_key(t: Column) -> Column:
    """Half-even rounding to a whole level."""
    return F.bround(t, 0)


# ---- arrays ---------------------------------------------------------------


def arr_sum(a) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def arr_mean(a) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return arr_sum(a) / F.size(a)


def arr_var_pop(a) -> Column:
    """Population variance, two passes over the array."""
    a = F.col(a) if isinstance(a, str) else a
    m = arr_mean(a)
    return F.aggregate(
        a, F.struct(F.lit(0.0).alias("s"), m.alias("m")),
        lambda t, x: F.struct(
            (t["s"] + (x - t["m"]) * (x - t["m"])).alias("s"), t["m"].alias("m")),
        lambda t: t["s"] / F.size(a),
    )


def arr_median(a) -> Column:
    """Median of a non-empty array, mean of the middle two for even sizes."""
    a = F.array_sort(F.col(a) if isinstance(a, str) else a)
    n = F.size(a)
    lo = F.element_at(a, F.floor((n + 1) / 2).cast("int"))
    hi = F.element_at(a, (F.floor(n / 2) + 1).cast("int"))
    return (lo + hi) / 2.0


def steps(a) -> Column:
    """Differences between neighbours."""
    a = F.col(a) if isinstance(a, str) else a
    n = F.size(a)
    return F.zip_with(F.slice(a, 2, n - 1), F.slice(a, 1, n - 1), lambda y, x: y - x)


def slope(a) -> Column:
    """Least-squares slope over positions spread evenly on [0, 1]; 0 for one value."""
    a = F.col(a) if isinstance(a, str) else a
    n = F.size(a)
    mid = (n - 1) / 2.0
    num = F.aggregate(
        F.transform(a, lambda x, i: (i - mid) * x), F.lit(0.0), lambda s, x: s + x)
    # sum of squared centred positions is n(n^2-1)/12 in steps, each 1/(n-1) wide
    den = n * (n * n - 1) / 12.0
    return F.when(n < 2, F.lit(0.0)).otherwise(num / den * (n - 1))


def dot(a, b) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na == 0) | (nb == 0), F.lit(ZERO_NORM_SIMILARITY)).otherwise(
        dot(a, b) / (na * nb))


def anomaly_index(a, ref) -> Column:
    """Summed absolute displacement over four features, clipped to [0, 1]."""
    a = F.col(a) if isinstance(a, str) else a
    ref = F.col(ref) if isinstance(ref, str) else ref
    return clip(arr_sum(F.zip_with(a, ref, lambda x, y: F.abs(x - y))) / 4.0, 0.0, 1.0)


# ---- geometry -------------------------------------------------------------


def distance(p, q) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(p, q)), F.lit(0.0)))


def triangle_area(p, q, r) -> Column:
    e = [b - a for a, b in zip(p, q)]
    f = [b - a for a, b in zip(p, r)]
    cx = e[1] * f[2] - e[2] * f[1]
    cy = e[2] * f[0] - e[0] * f[2]
    cz = e[0] * f[1] - e[1] * f[0]
    return F.sqrt(cx * cx + cy * cy + cz * cz) / 2.0


def affine(matrix, x: Column, y: Column, z: Column) -> list[Column]:
    """Apply a 3x4 affine matrix given as nested lists."""
    return [F.lit(float(m[0])) * x + F.lit(float(m[1])) * y + F.lit(float(m[2])) * z
            + F.lit(float(m[3])) for m in matrix]


# ---- bins -----------------------------------------------------------------


def length_bin(L: Column) -> Column:
    return (F.when(L <= 1, "1").when(L <= 3, "2-3").when(L <= 6, "4-6")
            .when(L <= 10, "7-10").otherwise(">10"))


def count_bin(n: Column) -> Column:
    return (F.when(n <= 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").otherwise(">20"))
