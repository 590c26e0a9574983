"""Ranks, deltas and running sums along a global order, without moving all rows to one task.

One pass over the key gives its count and quantiles; rows are bucketed by as many of those as the count asks for, windows run inside
buckets, and a table of one row a bucket carries what comes before each bucket. A key that fills several
buckets alone is cut further by its first tie column, if that is a number, so that no frequent key is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

#: Rows that a bucket aims at, and the most buckets: the most quantiles that the driver reads.
BUCKET_ROWS, MOST_BUCKETS = 1 << 18, 4096
#: Error of a quantile's rank, as a part of all rows.
ACCURACY = 20_000


def quantiles(df: DataFrame, key: str, n: int, accuracy: int = ACCURACY) -> tuple[int, list]:
    """(count of rows whose key isn't null, n - 1 values that cut the key's distribution into n parts of about equal size)."""
    got = df.agg(F.count(key), F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], accuracy)).first()
    return got[0], list(got[1] or []) if n > 1 else []


def splitters(df: DataFrame, key: str, n: int) -> list[int]:
    """n - 1 values at most that cut the key's distribution into n parts of about equal size; n is MOST_BUCKETS at most."""
    return sorted(set(quantiles(df, key, min(n, MOST_BUCKETS))[1]))


def exact_splitters(df: DataFrame, key: str, n: int) -> DataFrame:
    """(i, splitter): the key of rank ceil(i * rows / n) for i of 1 to n - 1, by global ranks instead of a sketch."""
    rank = ranked(df.select(key), key)
    rows = df.agg(F.count("*").alias("_rows"))
    at = df.sparkSession.range(1, n).crossJoin(F.broadcast(rows)).select(F.col("id").cast("int").alias("i"), F.ceil(F.col("id") * F.col("_rows") / F.lit(n)).alias("rank")).filter("rank > 0")
    return rank.join(F.broadcast(at), "rank").select("i", F.col(key).alias("splitter"))


def owner(key: Column, cuts: list) -> Column:
    """The part that a key belongs to: how many cuts are not above it. First among every step-th cut, then among the step that follow."""
    if not cuts:
        return F.lit(0)
    array = lambda values: F.array(*[F.lit(c).cast("bigint") for c in values])
    step = max(1, int(len(cuts) ** 0.5))
    if step < 8:
        return F.size(F.filter(array(cuts), lambda c: c <= key))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    whole = F.size(F.filter(array([g[-1] for g in groups]), lambda c: c <= key))
    own = F.element_at(F.array(*[array(g) for g in groups]), F.least(whole + 1, F.lit(len(groups))))
    return F.when(whole == len(groups), F.lit(len(cuts))).otherwise(whole * step + F.size(F.filter(own, lambda c: c <= key)))


def _temporary(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucketed(df: DataFrame, key: str, ties: list[str] = (), name: str = "_b", rows: int | None = None) -> DataFrame:
    """df with the bucket of each row, in order of (key, ties) across buckets."""
    count, found = quantiles(df, key, MOST_BUCKETS)
    least = df.sparkSession.sparkContext.defaultParallelism
    n = max(1, min(MOST_BUCKETS, max(-(-count // (rows or BUCKET_ROWS)), min(least, count >> 10))))
    cuts = [found[i * len(found) // n] for i in range(1, n)] if found else []
    again = sorted({c for c in cuts if cuts.count(c) > 1}) if len(set(cuts)) < len(cuts) else []
    cuts = sorted(set(cuts))
    bucket = owner(F.col(key), cuts).cast("bigint")
    if not again or not ties or not isinstance(df.schema[ties[0]].dataType, NumericType):
        return df.withColumn(name, bucket)
    # frequent keys: their own quantiles of the first tie, MOST_BUCKETS in all
    parts = max(2, min(64, MOST_BUCKETS // len(again)))
    tie = F.col(ties[0]).cast("double")
    inner = df.filter(F.col(key).isin(again)).groupBy(key).agg(F.percentile_approx(tie, [i / parts for i in range(1, parts)], 1000).alias("q")).collect()
    inner = {r[0]: sorted(set(r["q"] or [])) for r in inner}
    step = F.create_map(*[x for k, q in inner.items() for x in (F.lit(k).cast("bigint"), F.array(*[F.lit(v) for v in q]))])
    below = F.coalesce(F.size(F.filter(F.element_at(step, F.col(key).cast("bigint")), lambda c: c <= tie)), F.lit(0))
    # a frequent key is the least of its bucket; the others there come after all of its parts
    first = [cuts.index(k) + 1 for k in again]
    later = F.when(F.col(key).isin(again), below).when(bucket.isin(first), F.lit(parts)).otherwise(F.lit(0))
    return df.withColumn(name, bucket * (parts + 1) + later.cast("bigint"))


def _before(rows: DataFrame, b: str, carried: dict[str, Column], values: dict[str, Column]) -> DataFrame:
    """rows with what the buckets before have; one row a bucket is broadcast. carried: aggregates of a bucket; values: windows over them in order of bucket."""
    table = rows.groupBy(b).agg(*[v.alias(k) for k, v in carried.items()]).withColumns(values).drop(*[k for k in carried if k not in values])
    return rows.join(F.broadcast(table), b)


def ranked(df: DataFrame, key: str, ties: list[str] = (), name: str = "rank") -> DataFrame:
    """Position from 1 in the order of (key, ties)."""
    b, n, before = (_temporary(df, c) for c in ("_b", "_n", "_before"))
    ahead = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    rows = _before(bucketed(df, key, ties, b), b, {n: F.count("*")}, {before: F.coalesce(F.sum(n).over(ahead), F.lit(0))})
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(b).orderBy(key, *ties)) + F.col(before)).drop(b, before)


def deltas(df: DataFrame, key: str, ties: list[str] = (), name: str = "delta") -> DataFrame:
    """The key less the one before it in the order of (key, ties); the first row keeps its key."""
    b, most, last = (_temporary(df, c) for c in ("_b", "_m", "_last"))
    rows = _before(bucketed(df, key, ties, b), b, {most: F.max(key)}, {last: F.lag(most).over(Window.orderBy(b))})
    before = F.lag(key).over(Window.partitionBy(b).orderBy(key, *ties))
    return rows.withColumn(name, F.col(key) - F.coalesce(before, F.col(last), F.lit(0))).drop(b, last)


def running_sums(df: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """Sums (name: column) over all rows up to this one in the order of a unique key, all of them in one pass."""
    b = _temporary(df, "_b")
    parts, befores = [_temporary(df, f"_s{i}") for i in range(len(sums))], [_temporary(df, f"_before{i}") for i in range(len(sums))]
    ahead = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    rows = _before(bucketed(df, order, name=b), b, {p: F.sum(c) for p, c in zip(parts, sums.values())}, {n: F.coalesce(F.sum(p).over(ahead), F.lit(0)) for n, p in zip(befores, parts)})
    inside = Window.partitionBy(b).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({name: F.sum(c).over(inside) + F.col(n) for (name, c), n in zip(sums.items(), befores)}).drop(b, *befores)


def running_sum(df: DataFrame, order: str, value: str, name: str = "running") -> DataFrame:
    """Sum of value over all rows up to this one in the order of a unique key."""
    return running_sums(df, order, {name: value})


def vector_deltas(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Each column less the row before it (d_<column>), the first row whole; `order` is a unique key."""
    b, tail, last = (_temporary(df, c) for c in ("_b", "_m", "_last"))
    rows = _before(bucketed(df, order, name=b), b, {tail: F.max_by(F.struct(*columns), F.col(order))}, {last: F.lag(tail).over(Window.orderBy(b))})
    within = Window.partitionBy(b).orderBy(order)
    return rows.withColumns({f"d_{c}": F.col(c) - F.coalesce(F.lag(c).over(within), F.col(last).getField(c), F.lit(0)) for c in columns}).drop(b, last)


def vector_sums(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """The inverse of vector_deltas on columns d_<column>."""
    return running_sums(df, order, {c: f"d_{c}" for c in columns})
