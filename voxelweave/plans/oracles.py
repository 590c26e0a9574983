"""DuckDB SQL for the registered queries, built from common table expressions.

Float32 steps are cast one by one; bits are spread by lists, as shifts there fail on overflow.
"""

from __future__ import annotations

import math

import numpy as np

from ..functions.curves import NEXT, OUT, Z_BIAS
from .clouds import SQL


def f32(v: float) -> float:
    return float(np.float32(v))


def d(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def fixed(x: str, places: int = 6) -> str:
    s = d(float(10**places))
    return f"floor(CAST({x} AS DOUBLE) * {s} + {d(0.5)}) / {s}"


def divide(x: str, by: float) -> str:
    return f"CAST(CAST({x} AS DOUBLE) / {d(f32(by))} AS FLOAT)"


def nearest(x: str) -> str:
    return f"(CASE WHEN {x} >= 0 THEN floor({x} + {d(0.5)}) ELSE -floor({d(0.5)} - {x}) END)"


def shifted(cloud: str, by: str = "") -> str:
    if by:
        return f"p AS ({SQL[cloud]}), s AS (SELECT id, chunk, x - min(x) OVER w AS x, y - min(y) OVER w AS y, z - min(z) OVER w AS z, x AS x0, y AS y0, z AS z0, min(x) OVER w AS ox, min(y) OVER w AS oy, min(z) OVER w AS oz FROM p WINDOW w AS (PARTITION BY {by}))"
    return f"p AS ({SQL[cloud]}), o AS (SELECT min(x) AS ox, min(y) AS oy, min(z) AS oz FROM p), s AS (SELECT id, chunk, x - ox AS x, y - oy AS y, z - oz AS z, x AS x0, y AS y0, z AS z0, ox, oy, oz FROM p, o)"


def cube_cells(bound: float, src: str = "s", name: str = "q") -> str:
    step = 2 * f32(bound) / math.sqrt(3)
    axes = ", ".join(f"CAST(floor({divide(c, step)}) AS INT) AS q{c}" for c in "xyz")
    return f"{name} AS (SELECT *, {axes} FROM {src})"


def to_cells(bound: float, src: str = "s", name: str = "q") -> str:
    b = f32(bound)
    step = 2 * b / math.sqrt(5)
    u = ", ".join(f"{divide(c, step)} AS u{c}" for c in "xyz")
    even = ", ".join(nearest(f"(CAST(u{c} AS DOUBLE) * {d(0.5)})") + f" * 2 AS e{c}" for c in "xyz")
    odd = ", ".join(nearest(f"(CAST(u{c} - CAST(1 AS FLOAT) AS DOUBLE) * {d(0.5)})") + f" * 2 + 1 AS w{c}" for c in "xyz")
    far = lambda t: " + ".join(f"(CAST(u{c} AS DOUBLE) - {t}{c}) * (CAST(u{c} AS DOUBLE) - {t}{c})" for c in "xyz")
    half = lambda c: f"CAST(CASE WHEN de <= dw THEN CAST(e{c} AS BIGINT) >> 1 ELSE (CAST(w{c} AS BIGINT) + 1) >> 1 END AS INT) AS q{c}"
    return (
        f"{name}_u AS (SELECT *, {u} FROM {src}), {name}_c AS (SELECT *, {even}, {odd} FROM {name}_u), {name}_d AS (SELECT *, {far('e')} AS de, {far('w')} AS dw FROM {name}_c), "
        f"{name} AS (SELECT id, chunk, x, y, z, x0, y0, z0, ox, oy, oz, {half('x')}, {half('y')}, CAST(CASE WHEN de <= dw THEN ez ELSE wz END AS INT) AS qz FROM {name}_d)"
    )


def quantized(cloud: str, lattice: str, bound: float, by: str = "") -> str:
    return f"{shifted(cloud, by)}, {to_cells(bound) if lattice == 'to' else cube_cells(bound)}"


def recovered(lattice: str, bound: float, src: str = "q", name: str = "r") -> str:
    b = d(f32(bound))
    if lattice == "cube":
        back = lambda c: f"CAST(CAST(CAST((CAST(q{c} AS DOUBLE) + {d(0.5)}) * 2 * {b} AS FLOAT) AS DOUBLE) / {d(f32(math.sqrt(3)))} AS FLOAT) AS r{c}"
        return f"{name} AS (SELECT *, {', '.join(map(back, 'xyz'))} FROM {src})"
    node = {"x": "(qx * 2 - (qz & 1))", "y": "(qy * 2 - (qz & 1))", "z": "qz"}
    back = lambda c: f"CAST(CAST(CAST(CAST({node[c]} AS DOUBLE) * 2 * {b} AS FLOAT) AS DOUBLE) / {d(f32(math.sqrt(5)))} AS FLOAT) AS r{c}"
    return f"{name} AS (SELECT *, {', '.join(map(back, 'xyz'))} FROM {src})"


def square_error() -> str:
    return " + ".join(f"(CAST({c} AS DOUBLE) - CAST(r{c} AS DOUBLE)) * (CAST({c} AS DOUBLE) - CAST(r{c} AS DOUBLE))" for c in "xyz")


def morton(x: str = "qx", y: str = "qy", z: str = f"(qz + {Z_BIAS})") -> str:
    part = lambda v, k: f"list_sum(list_transform(range(21), lambda i: ((CAST({v} AS BIGINT) >> i) & 1) << (3 * i + {k})))"
    return f"CAST({part(x, 0)} + {part(y, 1)} + {part(z, 2)} AS BIGINT)"


def hilbert(key: str, iteration: str) -> str:
    table = lambda t: "[" + ",".join(map(str, t)) + "]"
    digits = f"list_transform(range({iteration}, -1, -1), lambda i: CAST(({key} >> CAST(3 * i AS BIGINT)) & 7 AS BIGINT))"
    # the accumulator's low 4 bits are the state
    return f"(list_reduce(list_prepend(CAST(0 AS BIGINT), {digits}), lambda a, g: ((a >> 4) * 8 + {table(OUT)}[(a & 15) * 8 + g + 1]) * 16 + {table(NEXT)}[(a & 15) * 8 + g + 1]) >> 4)"


def bit_length(v: str) -> str:
    return f"length(bin(CAST({v} AS BIGINT)))"


def superblocks(src: str = "q", name: str = "b", hilbert_keys: bool = False, bias: int = Z_BIAS) -> str:
    rng = f"{name}_r AS (SELECT greatest(max(qx), 0) AS rx, greatest(max(qy), 0) AS ry FROM {src})"
    key = hilbert("k", "20") if hilbert_keys else "k"
    pre = f"{name}_k AS (SELECT *, {morton('(qx % 64)', '(qy % 64)', f'((qz + {bias}) % 64)')} AS k FROM {src})"
    z = f"(qz + {bias})"
    return (
        f"{rng}, {pre}, {name} AS (SELECT t.* EXCLUDE (id), id AS row_id, CAST((qx // 64) // 2 + (qy // 64) // 2 * (rx // 128 + 1) + ({z} // 64) // 2 * (rx // 128 + 1) * (ry // 128 + 1) AS BIGINT) AS id, "
        f"CAST(((qx // 64) & 1) | (((qy // 64) & 1) << 1) | ((({z} // 64) & 1) << 2) AS INT) AS quad, {key} AS sfc FROM {name}_k t, {name}_r)"
    )
