"""Space-filling curve keys as column expressions over BIGINT."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from .floats import free_prefix

BITS = 21
#: Added to a truncated-octahedron cell's z (-1 at least) before a key is made; even, so parity stays.
Z_BIAS = 2
BLOCK = 64
#: Digits of a key inside a block, and the digit count from which block keys walk the curve.
BLOCK_ITERATION = 20

# Each step spreads (or gathers) a 21-bit number's bits two apart.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
GATHER = ((2, 0x10C30C30C30C30C3), (4, 0x100F00F00F00F00F), (8, 0x1F0000FF0000FF), (16, 0x1F00000000FFFF), (32, 0x1FFFFF))


def _mask(c: Column, m: int) -> Column:
    return c.bitwiseAND(F.lit(m).cast("bigint"))


def with_morton(df: DataFrame, x: Column, y: Column, z: Column, name: str = "sfc") -> DataFrame:
    """df with a 63-bit key of int cells, x lowest. Cells must lie in 0 .. 2**21 - 1 (see checked).

    Each spreading step uses its input twice, so each is a column: one nested expression would hold 2**5 copies of a cell.
    """
    m = [f"{free_prefix(df, '_m')}{i}" for i in range(3)]
    df = df.withColumns({n: _mask(c.cast("bigint"), (1 << BITS) - 1) for n, c in zip(m, (x, y, z))})
    for shift, mask in SPREAD:
        df = df.withColumns({n: _mask(F.col(n).bitwiseOR(F.shiftleft(n, shift)), mask) for n in m})
    key = F.col(m[0]).bitwiseOR(F.shiftleft(m[1], 1)).bitwiseOR(F.shiftleft(m[2], 2))
    return df.withColumn(name, key).drop(*m)


def with_morton_cell(df: DataFrame, key: Column, names=("qx", "qy", "qz")) -> DataFrame:
    """df with the int cell of a Morton key."""
    m = [f"{free_prefix(df, '_m')}{i}" for i in range(3)]
    df = df.withColumns({n: _mask(F.shiftrightunsigned(key, i), SPREAD[-1][1]) for i, n in enumerate(m)})
    for shift, mask in GATHER:
        df = df.withColumns({n: _mask(F.col(n).bitwiseOR(F.shiftrightunsigned(n, shift)), mask) for n in m})
    return df.withColumns({name: F.col(n).cast("int") for name, n in zip(names, m)}).drop(*m)


def checked(key: Column, qx: Column, qy: Column, qz: Column) -> Column:
    """The key, or an error where it would alias another cell's.

    It is part of the key, not a filter: a filter would be pushed below the columns that make the cell, with a copy of each.
    """
    fits = (F.least(qx, qy, qz) >= 0) & (F.greatest(qx, qy, qz) < 1 << BITS)
    return F.when(fits, key).otherwise(F.raise_error(F.lit("cell outside 0 .. 2^21 - 1")).cast("bigint"))


def _automaton() -> tuple[list[int], list[int], list[int], list[int]]:
    """States of the curve: (digit out, next state) by 8 * state + digit in, and the inverse.

    The curve visits a cube's octants in the order of the base pattern. Each octant's part is the
    base curve under one of the 24 rotations, chosen so that the parts join: the first part
    starts where the whole does, the last ends where it ends, and neighbours meet.
    """
    # Octants of the base pattern in order, and for each the rotation (images of the octants 0 to 7).
    pattern = [0, 1, 3, 2, 6, 7, 5, 4]
    turns = [[0, 2, 4, 6, 1, 3, 5, 7], [0, 4, 1, 5, 2, 6, 3, 7], [5, 1, 4, 0, 7, 3, 6, 2], [0, 1, 2, 3, 4, 5, 6, 7], [5, 7, 1, 3, 4, 6, 0, 2], [6, 2, 7, 3, 4, 0, 5, 1], [3, 2, 1, 0, 7, 6, 5, 4], [6, 2, 7, 3, 4, 0, 5, 1]]
    place = [pattern.index(d) for d in range(8)]
    undo = [[t.index(d) for d in range(8)] for t in turns]
    start = tuple(range(8))  # a state maps an octant as seen to the base's octant
    states, out, following = {start: 0}, [], []
    queue = [start]
    for state in queue:
        for digit in range(8):
            base = state[digit]
            out.append(place[base])
            nxt = tuple(undo[base][state[d]] for d in range(8))
            if nxt not in states:
                states[nxt] = len(states)
                queue.append(nxt)
            following.append(states[nxt])
    back, back_next = [0] * len(out), [0] * len(out)
    for k, (o, s) in enumerate(zip(out, following)):
        back[k // 8 * 8 + o], back_next[k // 8 * 8 + o] = k % 8, s
    return out, following, back, back_next


OUT, NEXT, BACK, BACK_NEXT = _automaton()


def _walk(key: Column, iteration: Column | int, out: list[int], following: list[int]) -> Column:
    """Digits of base 8 from the highest (index `iteration`) to 0 through the automaton; one table lookup a digit."""
    packed = F.array(*[F.lit(s << 3 | o).cast("bigint") for o, s in zip(out, following)])
    top = F.lit(iteration) if isinstance(iteration, int) else iteration
    # the accumulator's low 4 bits are the state; a key has at most 20 digits besides it
    first = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("s"))

    def step(acc: Column, i: Column) -> Column:
        digit = F.call_function("shiftrightunsigned", key, (i * 3).cast("int")).bitwiseAND(F.lit(7).cast("bigint"))
        got = F.get(packed, (acc["s"] * 8 + digit).cast("int"))
        return F.struct((acc["h"] * 8 + got.bitwiseAND(F.lit(7).cast("bigint"))).alias("h"), F.shiftright(got, 3).alias("s"))

    return F.aggregate(F.sequence(top.cast("int"), F.lit(0), F.lit(-1)), first, step, lambda acc: acc["h"])


def hilbert(key: Column, iteration: Column | int) -> Column:
    """Hilbert key of a Morton key; iteration is the index of the highest digit, on which the key depends."""
    return _walk(key, iteration, OUT, NEXT)


def hilbert_morton(key: Column, iteration: Column | int) -> Column:
    return _walk(key, iteration, BACK, BACK_NEXT)


def bit_length(v: Column) -> Column:
    """Bits of a value of 0 or more; 1 for 0."""
    return F.length(F.bin(v.cast("bigint")))


def superblock(qx: Column, qy: Column, qz: Column, range_x: Column, range_y: Column, block: int = BLOCK) -> Column:
    """Struct of id (of a cube of 2 blocks a side), quad (octant, 0 to 7) and the local lx, ly, lz."""
    nx = F.floor(range_x / (2 * block)).cast("bigint") + 1
    ny = F.floor(range_y / (2 * block)).cast("bigint") + 1
    part = lambda q: F.floor(q / block).cast("bigint")
    cx, cy, cz = part(qx), part(qy), part(qz)
    low = lambda c: c.bitwiseAND(F.lit(1).cast("bigint"))
    halves = lambda c: F.shiftright(c, 1)
    return F.struct(
        (halves(cx) + halves(cy) * nx + halves(cz) * nx * ny).alias("id"),
        low(cx).bitwiseOR(F.shiftleft(low(cy), 1)).bitwiseOR(F.shiftleft(low(cz), 2)).cast("int").alias("quad"),
        (qx % block).cast("int").alias("lx"), (qy % block).cast("int").alias("ly"), (qz % block).cast("int").alias("lz"),
    )


def superblock_cell(id: Column, quad: Column, lx: Column, ly: Column, lz: Column, range_x: Column, range_y: Column, block: int = BLOCK) -> Column:
    """The cell back from superblock()'s fields."""
    nx = F.floor(range_x / (2 * block)).cast("bigint") + 1
    ny = F.floor(range_y / (2 * block)).cast("bigint") + 1
    whole = lambda a, b: F.floor(a / b).cast("bigint")
    bit = lambda i: F.shiftright(quad, i).bitwiseAND(F.lit(1))
    axis = lambda major, i, local: (major * (2 * block) + bit(i) * block + local).cast("int")
    return F.struct(axis(id % nx, 0, lx).alias("qx"), axis(whole(id, nx) % ny, 1, ly).alias("qy"), axis(whole(whole(id, nx), ny), 2, lz).alias("qz"))
