"""Lattices that quantize float32 points under an L2 error bound.

Each lattice gives `quantize(df)`, which adds int qx, qy, qz to a table with x, y, z, and
`point(qx, qy, qz)`, a struct of float x, y, z. Steps whose results are used several times
are columns of their own, so that no expression is written out twice. LATTICES is the registry; an
unknown name raises ValueError.

cube: cells of side 2 b / sqrt(3). to: truncated octahedra, that is the nearest of two
interleaved cubic lattices of step 2 b / sqrt(5); z keeps the parity that tells which.
adaptive: steps in proportion to the box's sides, taken from the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .floats import divide, f32, free_prefix, named, nearest, times


AXES = ("x", "y", "z")


def _cells(df: DataFrame, own: list[str], *q: Column) -> DataFrame:
    """The columns of `own` and the cells; steps on the way are dropped."""
    cells = [f"q{c}" for c in AXES]
    return df.withColumns({n: v.cast("int") for n, v in zip(cells, q)}).select(*[named(c) for c in own if c not in cells], *cells)


def _point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("float").alias("x"), y.cast("float").alias("y"), z.cast("float").alias("z"))


#: A lattice's step is twice the bound over this.
SIDE = {"cube": math.sqrt(3), "to": math.sqrt(5)}


def step(name: str, bound: float) -> float:
    return 2 * f32(bound) / SIDE[name]


def _cube_cells(df: DataFrame, step: float | Column) -> DataFrame:
    return _cells(df, df.columns, *[F.floor(divide(F.col(c), step)) for c in AXES])


def _octahedron_cells(df: DataFrame, step: float | Column) -> DataFrame:
    own, p = df.columns, free_prefix(df, "_q_")
    name = lambda kind: [F.col(f"{p}{kind}{c}") for c in AXES]
    df = df.withColumns({f"{p}u{c}": divide(F.col(c), step) for c in AXES})
    df = df.withColumns({f"{p}h{c}": u.cast("double") * 0.5 for c, u in zip(AXES, name("u"))} | {f"{p}g{c}": (u - F.lit(1.0).cast("float")).cast("double") * 0.5 for c, u in zip(AXES, name("u"))})
    df = df.withColumns({f"{p}e{c}": nearest(h) * 2 for c, h in zip(AXES, name("h"))} | {f"{p}o{c}": nearest(g) * 2 + 1 for c, g in zip(AXES, name("g"))})
    away = {f"{p}{k}{k}{c}": u.cast("double") - t.cast("double") for k in "eo" for c, u, t in zip(AXES, name("u"), name(k))}
    df = df.withColumns(away)
    far = lambda k: sum((d * d for d in name(k + k)), F.lit(0.0))
    df = df.withColumn(f"{p}even", far("e") <= far("o"))
    even = F.col(f"{p}even")
    pick = lambda e, o: F.when(even, F.shiftright(e.cast("bigint"), 1)).otherwise(F.shiftright(o.cast("bigint") + 1, 1))
    (ex, ey, ez), (ox, oy, oz) = name("e"), name("o")
    return _cells(df, own, pick(ex, ox), pick(ey, oy), F.when(even, ez).otherwise(oz))


def _cube_point(bound: float | Column, qx: Column, qy: Column, qz: Column) -> Column:
    return _point(*[divide(times((q.cast("double") + 0.5) * 2, bound), math.sqrt(3)) for q in (qx, qy, qz)])


def _octahedron_point(bound: float | Column, qx: Column, qy: Column, qz: Column) -> Column:
    parity = qz.bitwiseAND(F.lit(1))
    return _point(*[divide(times(n.cast("double") * 2, bound), math.sqrt(5)) for n in (qx * 2 - parity, qy * 2 - parity, qz)])


def point_by_row(lattice: Column, bound: Column, steps: Column, qx: Column, qy: Column, qz: Column) -> Column:
    """The point of a cell where each row says its lattice, its bound and (adaptive) its array of steps."""
    q = (qx, qy, qz)
    adaptive = _point(*[times(c, F.element_at(steps, i + 1)) for i, c in enumerate(q)])
    known = F.when(lattice == "cube", _cube_point(bound, *q)).when(lattice == "to", _octahedron_point(bound, *q)).when(lattice == "adaptive", adaptive)
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown lattice "), lattice)).cast("struct<x:float,y:float,z:float>"))


def check_bound(bound: float) -> float:
    if not (bound > 0 and math.isfinite(bound)):
        raise ValueError(f"the error bound must be a positive number, not {bound!r}")
    return float(bound)


@dataclass(frozen=True)
class Cube:
    bound: float

    def __post_init__(self):
        check_bound(self.bound)

    def quantize(self, df: DataFrame) -> DataFrame:
        return _cube_cells(df, step("cube", self.bound))

    def point(self, qx: Column, qy: Column, qz: Column) -> Column:
        return _cube_point(self.bound, qx, qy, qz)


@dataclass(frozen=True)
class TruncatedOctahedron:
    bound: float

    def __post_init__(self):
        check_bound(self.bound)

    def quantize(self, df: DataFrame) -> DataFrame:
        return _octahedron_cells(df, step("to", self.bound))

    def point(self, qx: Column, qy: Column, qz: Column) -> Column:
        return _octahedron_point(self.bound, qx, qy, qz)


@dataclass(frozen=True)
class Adaptive:
    """Steps by axis; `fit` takes them from a table's box. A flat axis has step 0 and cell 0."""

    steps: tuple[float, float, float]

    @classmethod
    def fit(cls, points: DataFrame, bound: float) -> Adaptive:
        check_bound(bound)
        sides = points.agg(*[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).first()
        sides = [float(s or 0) for s in sides]
        norm = math.sqrt(sum(f32(s * s) for s in sides))
        even = f32(f32(bound) / math.sqrt(3))
        return cls(tuple(f32(f32(f32(bound) * s) / f32(norm)) if norm > 0 else even for s in sides))

    def quantize(self, df: DataFrame) -> DataFrame:
        own, p = df.columns, free_prefix(df, "_q_")
        df = df.withColumns({f"{p}u{c}": divide(F.col(c), s).cast("double") for c, s in zip(AXES, self.steps) if s})
        return _cells(df, own, *[nearest(F.col(f"{p}u{c}")) if s else F.lit(0) for c, s in zip(AXES, self.steps)])

    def point(self, qx: Column, qy: Column, qz: Column) -> Column:
        return _point(*[times(q, s) for q, s in zip((qx, qy, qz), self.steps)])


def adaptive_steps(bound: float, sides: list[Column]) -> Column:
    """Adaptive.fit's steps as an array, from columns of the box's (float) sides, so that each group has its own."""
    double = lambda c: c.cast("float").cast("double")
    b, s = f32(check_bound(bound)), [double(c) for c in sides]
    norm = double(F.sqrt(double(s[0] * s[0]) + double(s[1] * s[1]) + double(s[2] * s[2])))
    return F.array(*[F.when(norm > 0, double(double(F.lit(b) * c) / F.nullif(norm, F.lit(0.0)))).otherwise(F.lit(f32(b / math.sqrt(3)))) for c in s])


def adaptive_cells(df: DataFrame, steps: Column) -> DataFrame:
    """df with cells by an array of steps; a step of 0 gives cell 0."""
    step = lambda i: F.element_at(steps, i + 1)
    own, p = df.columns, free_prefix(df, "_q_")
    df = df.withColumns({f"{p}u{c}": (F.col(c).cast("double") / F.nullif(step(i), F.lit(0.0))).cast("float").cast("double") for i, c in enumerate(AXES)})
    return _cells(df, own, *[F.when(step(i) != 0, nearest(F.col(f"{p}u{c}"))).otherwise(F.lit(0)) for i, c in enumerate(AXES)])


LATTICES = {"cube": Cube, "to": TruncatedOctahedron}


def quantize_over(df: DataFrame, name: str, bounds: list[float]) -> DataFrame:
    """df once for each bound, which column `bound` says, with its cells: one pass over the points for all bounds."""
    each = df.withColumn("bound", F.explode(F.array(*[F.lit(check_bound(b)) for b in bounds])))
    found = F.lit(None).cast("double")
    for b in bounds:
        found = F.when(F.col("bound") == F.lit(float(b)), F.lit(f32(step(name, b)))).otherwise(found)
    # a column of its own, as the cells use it several times
    own, at = each.columns, f"{free_prefix(each, '_q_')}step"
    cells = {"cube": _cube_cells, "to": _octahedron_cells}[name](each.withColumn(at, found), F.col(at))
    return cells.select(*[named(c) for c in own if c not in ("qx", "qy", "qz")], "qx", "qy", "qz")


def lattice(name: str, bound: float):
    """The lattice of that name; ValueError for any other."""
    if name not in LATTICES:
        raise ValueError(f"unknown lattice {name!r}; known: {', '.join(LATTICES)} (adaptive needs data: Adaptive.fit)")
    return LATTICES[name](bound)
