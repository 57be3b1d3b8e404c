"""Quaternions (x, y, z, w) as array columns, in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return sum((F.get(a, F.lit(i)) * F.get(b, F.lit(i)) for i in range(1, 4)), F.get(a, F.lit(0)) * F.get(b, F.lit(0)))


def normalize(q: Column) -> Column:
    """Unit quaternion; null for norm 0."""
    norm = F.sqrt(dot(q, q))
    return F.when(norm > 0, F.transform(q, lambda x: x / norm))


def slerp(p: Column, q: Column, ratio: Column) -> Column:
    """Spherical interpolation of unit quaternions on the shorter arc; nearly equal ones are interpolated linearly and normalised."""
    raw = dot(p, q)
    sign = F.when(raw < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    c = F.least(F.abs(raw), F.lit(1.0))
    angle = F.acos(c)
    curved = F.zip_with(p, q, lambda a, b: (a * F.sin((1 - ratio) * angle) + b * sign * F.sin(ratio * angle)) / F.sin(angle))
    flat = F.zip_with(p, q, lambda a, b: a + (b * sign - a) * ratio)
    return F.when(c > 0.9995, normalize(flat)).otherwise(curved)


def euler_zyx(q: Column) -> Column:
    """struct(roll, pitch, yaw) of a unit quaternion; pitch is held to a right angle where its sine reaches 1."""
    x, y, z, w = (F.get(q, F.lit(i)) for i in range(4))
    s = 2 * (w * y - z * x)
    pitch = F.when(F.abs(s) >= 1, F.signum(s) * F.pi() / 2).otherwise(F.asin(s))
    return F.struct(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)).alias("roll"), pitch.alias("pitch"), F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)).alias("yaw"))
