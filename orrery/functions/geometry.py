"""Volumes as Catalyst predicates: a bounding box, a center and a mask over three position columns."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[float, float, float]
Pos = tuple[Column, Column, Column]


def position(df, names=("x", "y", "z")) -> Pos:
    """Three double columns of ``df``: ``names`` if present, else the elements of the array column POS."""
    if all(n in df.columns for n in names):
        return tuple(F.col(n).cast("double") for n in names)
    return tuple(F.col("POS")[i].cast("double") for i in range(3))


def between(pos: Pos, lo: Vec, hi: Vec) -> Column:
    """Inclusive on both ends; NaN is outside (it sorts above every number)."""
    return reduce(lambda a, b: a & b, ((p >= float(a)) & (p <= float(b)) for p, a, b in zip(pos, lo, hi, strict=True)))


def half_open(pos: Pos, lo: Vec, hi: Vec) -> Column:
    return reduce(lambda a, b: a & b, ((p >= float(a)) & (p < float(b)) for p, a, b in zip(pos, lo, hi, strict=True)))


def shift_periodic(x: Column, center: float, box: float) -> Column:
    """The image of ``x`` nearest to ``center`` in a periodic box; exactly half a box apart stays."""
    half = box / 2
    return F.when(x - center > half, x - box).when(center - x > half, x + box).otherwise(x)


def between_periodic(pos: Pos, lo: Vec, hi: Vec, box: float) -> Column:
    """Inside the box or one of its images, axis by axis: three intervals of literals each, so scans prune."""
    axes = []
    for p, a, b in zip(pos, lo, hi, strict=True):
        axes.append(reduce(lambda u, v: u | v, ((p >= float(a + s)) & (p <= float(b + s)) for s in (0.0, box, -box))))
    return reduce(lambda a, b: a & b, axes)


class Geometry(ABC):
    """Extension point: a volume gives its bounding box, its center and a mask."""

    @abstractmethod
    def bbox(self) -> tuple[Vec, Vec]: ...

    @abstractmethod
    def center(self) -> Vec: ...

    @abstractmethod
    def mask(self, pos: Pos) -> Column: ...


def _around(center: Vec, r: float) -> tuple[Vec, Vec]:
    return tuple(c - r for c in center), tuple(c + r for c in center)


def _dist2(pos: Pos, center: Vec) -> Column:
    dx, dy, dz = (p - float(c) for p, c in zip(pos, center, strict=True))
    return dx * dx + dy * dy + dz * dz


@dataclass(frozen=True)
class Cube(Geometry):
    lo: Vec
    hi: Vec

    @classmethod
    def around(cls, center: Vec, side: float) -> Cube:
        return cls(*_around(center, side / 2))

    def bbox(self):
        return self.lo, self.hi

    def center(self):
        return tuple((a + b) / 2 for a, b in zip(self.lo, self.hi, strict=True))

    def mask(self, pos):
        return between(pos, self.lo, self.hi)


@dataclass(frozen=True)
class Sphere(Geometry):
    at: Vec
    radius: float

    def bbox(self):
        return _around(self.at, self.radius)

    def center(self):
        return self.at

    def mask(self, pos):
        return _dist2(pos, self.at) <= self.radius * self.radius


@dataclass(frozen=True)
class Shell(Geometry):
    """Between radius - width / 2 and radius + width / 2; an inner radius below 0 counts as 0."""

    at: Vec
    radius: float
    width: float

    def bbox(self):
        return _around(self.at, self.radius + self.width / 2)

    def center(self):
        return self.at

    def mask(self, pos):
        inner, outer = max(self.radius - self.width / 2, 0.0), self.radius + self.width / 2
        d2 = _dist2(pos, self.at)
        return (d2 >= inner * inner) & (d2 <= outer * outer)


@dataclass(frozen=True)
class Cylinder(Geometry):
    start: Vec
    end: Vec
    radius: float

    def bbox(self):
        pairs = list(zip(self.start, self.end, strict=True))
        return tuple(min(p) - self.radius for p in pairs), tuple(max(p) + self.radius for p in pairs)

    def center(self):
        return tuple((a + b) / 2 for a, b in zip(self.start, self.end, strict=True))

    def mask(self, pos):
        d = [float(b - a) for a, b in zip(self.start, self.end, strict=True)]
        u = [p - float(a) for p, a in zip(pos, self.start, strict=True)]
        v = [p - float(b) for p, b in zip(pos, self.end, strict=True)]
        dot = lambda w: w[0] * d[0] + w[1] * d[1] + w[2] * d[2]
        c = [u[1] * d[2] - u[2] * d[1], u[2] * d[0] - u[0] * d[2], u[0] * d[1] - u[1] * d[0]]
        length = (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) ** 0.5
        return (dot(u) >= 0) & (dot(v) <= 0) & (F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2]) / length <= self.radius)
