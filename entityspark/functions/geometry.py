"""Boxes, spheres, rays and frustums as Column expressions.

A box is a pair of lists of Columns, its least and greatest corner, of two or three axes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = float | int
_MAX = 1.7976931348623157e308


def _l(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _all(xs) -> Column:
    return reduce(lambda a, b: a & b, xs)


def _sum(xs) -> Column:
    return reduce(lambda a, b: a + b, xs)


@dataclass(frozen=True)
class Box:
    low: tuple
    high: tuple

    @classmethod
    def of(cls, *bounds) -> Box:
        """Least corner, then greatest: numbers, Columns or column names."""
        xs = [F.col(b) if isinstance(b, str) else _l(b) for b in bounds]
        n = len(xs) // 2
        return cls(tuple(xs[:n]), tuple(xs[n:]))

    @classmethod
    def point(cls, *at) -> Box:
        return cls.of(*at, *at)

    @property
    def axes(self):
        return list(zip(self.low, self.high))

    def overlaps(self, other: Box) -> Column:
        """Bounds are closed: touching counts."""
        return _all((a <= d) & (c <= b) for (a, b), (c, d) in zip(self.axes, other.axes))

    def contains(self, other: Box) -> Column:
        return _all((a <= c) & (d <= b) for (a, b), (c, d) in zip(self.axes, other.axes))

    def enlarged(self, margin) -> Box:
        m = _l(margin)
        return Box(tuple(x - m for x in self.low), tuple(x + m for x in self.high))

    def union(self, other: Box) -> Box:
        return Box(tuple(F.least(a, b) for a, b in zip(self.low, other.low)), tuple(F.greatest(a, b) for a, b in zip(self.high, other.high)))

    def measure(self) -> Column:
        """Area or volume."""
        return reduce(lambda a, b: a * b, [b - a for a, b in self.axes])

    def is_degenerate(self) -> Column:
        return ~_all(a <= b for a, b in self.axes)

    def center(self) -> list[Column]:
        return [(a + b) * 0.5 for a, b in self.axes]

    def sphere(self) -> tuple[list[Column], Column]:
        """Centre and radius of the sphere through the corners."""
        return self.center(), F.sqrt(_sum((b - a) * (b - a) for a, b in self.axes)) * 0.5

    def center_distance2(self, at) -> Column:
        return _sum((p - c) * (p - c) for p, c in zip(map(_l, at), self.center()))

    def distance2(self, at) -> Column:
        """Squared distance to the closest point of the box."""

        def part(p: Column, a: Column, b: Column) -> Column:
            d = F.greatest(a - p, p - b, F.lit(0.0))
            return d * d

        return _sum(part(_l(p), a, b) for p, (a, b) in zip(at, self.axes))

    def within(self, at, radius: Number) -> Column:
        """Whether the sphere meets the box; the box test comes first, which file statistics can prune by."""
        around = Box.point(*at).enlarged(radius)
        return self.overlaps(around) & (self.distance2(at) <= _l(radius) * _l(radius))

    def ray_entry(self, origin, direction) -> Column:
        """Distance at which a ray enters, 0 from inside, null for a miss; in units of the direction's length."""
        near, far = [F.lit(-_MAX)], [F.lit(_MAX)]
        for o, d, (a, b) in zip(map(_l, origin), map(_l, direction), self.axes):
            inv = F.when(d == 0, F.lit(_MAX)).otherwise(F.lit(1.0) / F.when(d != 0, d))
            t1, t2 = (a - o) * inv, (b - o) * inv
            near.append(F.least(t1, t2))
            far.append(F.greatest(t1, t2))
        tn, tf = F.greatest(*near), F.least(*far)
        odd = reduce(lambda x, y: x | y, [F.isnan(_l(x)) for x in (*origin, *direction)])
        return F.when(~odd & (tn <= tf) & (tf >= 0), F.greatest(tn, F.lit(0.0)))

    def side(self, planes) -> Column:
        """'inside', 'intersecting' or 'outside' of planes (normal..., distance), kept where normal . p + distance >= 0."""
        outside, inside = [], []
        for *normal, dist in planes:
            far = _sum(_l(n) * (b if n >= 0 else a) for n, (a, b) in zip(normal, self.axes)) + _l(dist)
            near = _sum(_l(n) * (a if n >= 0 else b) for n, (a, b) in zip(normal, self.axes)) + _l(dist)
            outside.append(far < 0)
            inside.append(near >= 0)
        return F.when(reduce(lambda a, b: a | b, outside), "outside").when(_all(inside), "inside").otherwise("intersecting")
