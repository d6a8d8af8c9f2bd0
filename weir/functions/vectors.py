"""Column functions over vectors (arrays of doubles)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Distance = Callable[[Column, Column], Column]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def squared_l2(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def l1(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def last_features(vec: Column, n: int = 10) -> Column:
    """The last n values; a shorter vector is kept whole."""
    return F.slice(vec, F.greatest(F.size(vec) - n + 1, F.lit(1)), F.lit(n))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def project_2d(vec: Column) -> Column:
    """Weighted sums of the two halves: x over (i+1)*a_i of the first, y over i*a_i of the second."""
    half = F.floor(F.size(vec) / 2)
    x = _total(F.transform(vec, lambda a, i: F.when(i < half, (i + 1) * a).otherwise(0.0)))
    y = _total(F.transform(vec, lambda a, i: F.when(i >= half, i * a).otherwise(0.0)))
    return F.struct(x.alias("x"), y.alias("y"))


def polar_points(vec: Column, polar: bool = False) -> Column:
    """Packed feature values as points, each in its own sector of a circle.

    The low three bits shift the angle back, the value without its low three bits and the value without its
    low five bits set the radius; both ranges overlap as the packed form does.
    """
    section = F.lit(2 * math.pi) / F.size(vec)

    def point(value: Column, i: Column) -> Column:
        n = value.cast("long")
        code = F.shiftright(n, 5)
        radius = ((1 + F.shiftright(n, 3)) * (1 + code) * 10).cast("double")
        angle = section * i + (code + 1) * (section / 4) - (n.bitwiseAND(F.lit(7)) + 1) * (section / 10)
        if polar:
            return F.struct(angle.alias("x"), radius.alias("y"))
        return F.struct((radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))

    return F.transform(vec, point)


def flatten_points(points: Column) -> Column:
    """[(x0, y0), (x1, y1), ...] -> [x0, y0, x1, y1, ...]"""
    return F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))


def stretch_by_max(flat: Column, max_abs: Column) -> Column:
    return F.zip_with(flat, max_abs, lambda p, m: F.greatest(p, 5 * (p / (0.01 + m))))


def map_norm(flat: Column, means: Column) -> Column:
    """Norms of the x and y parts (y moved up by 100) after taking means away and rounding half to even."""
    off = F.zip_with(flat, means, lambda p, m: F.rint(p - m))

    def norm(parity: int) -> Column:
        return F.sqrt(_total(F.transform(off, lambda v, i: F.when(i % 2 == parity, v * v).otherwise(0.0))))

    return F.struct(norm(0).alias("x"), (100 + norm(1)).alias("y"))


def check_dimension(vec: Column, dim: int) -> Column:
    """The vector itself; the query fails on a vector of another width."""
    failed = F.assert_true(F.size(vec) == dim, F.concat(F.lit(f"expected {dim} values, got "), F.size(vec)))
    return F.when(failed.isNull(), vec)


def assemble(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    """Columns to one vector, nulls as 0."""
    return df.withColumn(name, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]))


def split_vector(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return df.withColumns({c: F.element_at(name, i + 1) for i, c in enumerate(columns)})
