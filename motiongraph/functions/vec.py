"""Column expressions for points, vectors, angles and small conversions.

A vector is a tuple of columns, one per axis.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]


def xyz(prefix: str = "", names: str = "xyz") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{n}") for n in names)


def sub(a: Vec, b: Vec) -> tuple[Column, ...]:
    return tuple(p - q for p, q in zip(a, b))


def add(a: Vec, b: Vec) -> tuple[Column, ...]:
    return tuple(p + q for p, q in zip(a, b))


def dot(a: Vec, b: Vec) -> Column:
    """Sum over all axes."""
    total = a[0] * b[0]
    for p, q in zip(a[1:], b[1:]):
        total = total + p * q
    return total


def norm(v: Vec) -> Column:
    return F.sqrt(dot(v, v))


def distance(a: Vec, b: Vec) -> Column:
    return norm(sub(a, b))


def normalize(v: Vec) -> tuple[Column, ...]:
    """Unit vector; null where the length is 0."""
    n = F.nullif(norm(v), F.lit(0.0))
    return tuple(p / n for p in v)


def normal2(v: Vec) -> tuple[Column, Column]:
    """Unit vector at a right angle to a 2-D vector."""
    x, y = normalize(v)
    return y, -x


def cross(a: Vec, b: Vec) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Null stays null, which least and greatest would skip."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def wrap(angle: Column) -> Column:
    """Angle in [-pi, pi)."""
    return F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi


def angle(a: Vec, b: Vec) -> Column:
    """2-D: signed, from b to a; 3-D: unsigned. Radians."""
    if len(a) == 2:
        return wrap(F.atan2(a[1], a[0]) - F.atan2(b[1], b[0]))
    return F.acos(clamp(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), -1.0, 1.0))


def angle_between(p: Vec, q: Vec) -> Column:
    """2-D angle of the difference q - p."""
    d = sub(q, p)
    return F.atan2(d[1], d[0])


def add_angles(a: Column, b: Column) -> Column:
    return wrap(a + b)


def sub_angles(a: Column, b: Column) -> Column:
    return wrap(a - b)


def plane_distance(p: Vec, plane: Vec) -> Column:
    """Signed distance to the plane a x + b y + c z = d."""
    a, b, c, d = plane
    return (dot(p, (a, b, c)) - d) / norm((a, b, c))


def tetra_volume(p: Vec, q: Vec, r: Vec) -> Column:
    """Signed volume of the tetrahedron with the origin."""
    return dot(p, cross(q, r)) / 6.0


def tri_area(p: Vec, q: Vec, r: Vec) -> Column:
    """Area from the three side lengths."""
    a, b, c = distance(p, q), distance(q, r), distance(r, p)
    s = (a + b + c) / 2
    return F.sqrt(F.greatest(s * (s - a) * (s - b) * (s - c), F.lit(0.0)))


def tilt(d1: Column, d2: Column, d: Column) -> Column:
    """Degrees; null when a value is missing."""
    return F.degrees(F.asin(F.abs(d1 - d2) / d))


def to_plane(p: Vec, plane: Vec) -> tuple[Column, Column]:
    """2-D coordinates of a point in the plane (shear form); null where c is 0."""
    a, b, c, _ = plane
    c = F.nullif(c, F.lit(0.0))
    return p[0] / F.cos(F.atan(a / c)), p[1] / F.cos(F.atan(b / c))


def from_plane(q: Vec, plane: Vec) -> tuple[Column, Column, Column]:
    """Point on the plane with the 2-D coordinates of to_plane."""
    a, b, c, d = plane
    c = F.nullif(c, F.lit(0.0))
    x, y = q[0] * F.cos(F.atan(a / c)), q[1] * F.cos(F.atan(b / c))
    return x, y, (d - a * x - b * y) / c


def orientation(a: Vec, b: Vec) -> Column:
    """Angle, in degrees, of the axis from a to b with z."""
    return F.degrees(angle(sub(b, a), (F.lit(0.0), F.lit(0.0), F.lit(1.0))))


def mm_to_rad(c: Column, f: float = 35.0) -> Column:
    return c / f


def column_number(c: Column) -> Column:
    """Number of a spreadsheet column: A is 1, AA is 27."""
    return F.aggregate(F.split(F.upper(c), ""), F.lit(0), lambda acc, s: acc * 26 + F.ascii(s) - 64)


#: Follow-up codes and their names.
TIMEPOINTS = (("discharge", "D"), ("1month", "1M"), ("6months", "6M"), ("12months", "12M"), ("24months", "24M"))


def timepoint_name(c: Column) -> Column:
    out = c
    for code, name in TIMEPOINTS:
        out = F.when(c == code, F.lit(name)).otherwise(out)
    return out


def scan_name(patient: Column, timepoint: Column, crop: Column, kind: Column) -> Column:
    return F.format_string("%s_%s_%s_%s", patient, timepoint, crop, kind)


def angle_straight0(c: Column) -> Column:
    """Angle at which 0 is straight."""
    return 180.0 - c


def soft_limit(c: Column, limit: float) -> Column:
    return 1.0 - F.exp(-c) if limit == 1 else -limit * (F.exp(-c / limit) - 1.0)


def cutoff(c: Column, limit: float) -> Column:
    return F.least(c, F.lit(float(limit)))


def to_cost(c: Column, f: float) -> Column:
    return 1.0 / F.pow(F.lit(2.0), c / f)


def from_cost(c: Column, f: float) -> Column:
    return F.log2(1.0 / c) * f


def slice_to_world(p: Vec, centre: Vec, v1: Vec, v2: Vec, middle: float = 127.5) -> tuple[Column, ...]:
    return tuple(c + (p[1] - middle) * a + (p[0] - middle) * b for c, a, b in zip(centre, v1, v2))


def span_vectors(n: Vec, prev1: Vec, prev2: Vec) -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    """Two unit vectors that span the plane of a normal, with signs nearest to given vectors."""
    first = normalize(cross(n, tuple(F.when(F.abs(n[0]) < 0.9, F.lit(w)).otherwise(F.lit(v)) for w, v in zip((1.0, 0.0, 0.0), (0.0, 1.0, 0.0)))))
    second = normalize(cross(n, first))
    turn = lambda v, p: tuple(F.when(dot(v, p) < 0, -c).otherwise(c) for c in v)
    return turn(first, prev1), turn(second, prev2)
