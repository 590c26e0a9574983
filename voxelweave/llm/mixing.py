"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a weight by its rank and a share of the token budget; a source is
never repeated more often than `cap` times, and what it cannot take is shared again
by weight (water-filling, in closed form over the sources sorted by cap / weight).
A source's weight over training time is a piecewise linear schedule. Its integral,
scaled to the source's target, is the source's cumulative token demand; a document at
cumulative size c of its source is trained on at the time when that demand reaches c.

Prefix sums of a source's sizes are taken in two levels (hash buckets, then rows of a
bucket), so no task holds a whole source. The table is read and its words are counted once: rows of sizes and ids (for
copies, with the documents' columns too) are written to the scratch folder, and all further steps read those.

Defined cases: null text has size 0; sources are ranked by code point with null last;
documents of size 0 take 0 words; equal rows are interchangeable; an empty table gives
an empty result; reruns agree, as the order in a source is by md5 of the doc_id, then doc_id, size and a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch, named

WEIGHTS = (5, 2, 1)
#: Weight over training time (equal steps from start to end) by rank of the source modulo 3.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, rank, weight, source_size, target of (source, size) rows. One row a source: windows run over sources, not documents."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by.select("source", "source_size", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("rank"))
    rated = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * F.lit(float(cap))
    order = Window.orderBy("ratio", "rank")
    everything = Window.partitionBy()
    steps = rated.withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("weight"))
    steps = steps.withColumn("capped", F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    steps = steps.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce("capped", F.lit(0.0))) / F.col("left"))
    # the level at which no source left in is above its limit
    steps = steps.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    return steps.select("source", "rank", "weight", "source_size", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight"))).alias("target"))


def training_time(share: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """When the integral of the source's schedule, scaled to end at 1, reaches share (0 to 1)."""
    out = None
    for k, knots in enumerate(schedules):
        n, at, area = len(knots) - 1, 0.0, sum((a + b) / 2 for a, b in zip(knots, knots[1:]))
        when = None
        for i, (a, b) in enumerate(zip(knots, knots[1:])):
            part = (a + b) / 2 / area
            rest = (share - F.lit(at)) * F.lit(area)
            step = rest / F.lit(a) if a == b else (F.sqrt(F.greatest(F.lit(a * a) + F.lit(2.0 * (b - a)) * rest, F.lit(0.0))) - F.lit(a)) / F.lit(b - a)
            t = (F.lit(float(i)) + step) / F.lit(float(n))
            at += part
            when = F.when(share <= F.lit(at), t) if when is None else when.otherwise(t) if i == n - 1 else when.when(share <= F.lit(at), t)
        when = t if n == 1 else when
        case = F.pmod(rank, F.lit(len(schedules))) == k
        out = F.when(case, when) if out is None else out.when(case, when)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def _placed(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, keep: list[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, before (words of the source ahead of it in a pass), rank and the columns of keep in a struct `kept`, as c0, c1 and so on.

    taken: each pass over the source takes every document once, in order of md5; the
    last pass ends after the target's words, within a document if need be, so a source's
    taken words are its target rounded down.
    """
    # a source is two columns, so that null is one too and all steps share one partitioning
    source = F.col("source").cast("string")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source_key"), word_count(F.col("text")).alias("size"), F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("none")).alias("kept"), F.xxhash64(F.col("text").cast("string")).alias("tie"))
    sized = sized.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("bucket", F.substring("key", 1, 3))
    sized = Scratch(docs.sparkSession).save(sized, "sized")
    plan = targets(sized.select("source", "size"), weights, share, cap)
    plan = plan.select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"), "rank", "source_size", "target")
    place = ["no_source", "source_key"]
    sums = sized.groupBy(*place, "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = sums.withColumn("ahead", F.sum("bucket_size").over(Window.partitionBy(*place).orderBy("bucket")) - F.col("bucket_size")).drop("bucket_size")
    ahead = ahead.join(plan, place)
    place.append("bucket")
    inside = Window.partitionBy(*place).orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = sized.withColumn("inside", F.sum("size").over(inside) - F.col("size")).join(ahead, place)
    before = F.col("ahead") + F.col("inside")
    words = F.floor("target").cast("long")
    passes = F.expr("cast(floor(target) as bigint) div greatest(source_size, 1)")
    rest = words - passes * F.col("source_size")
    taken = F.col("size") * passes + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return rows.select("doc_id", "source", "size", "source_size", F.col("target"), taken.cast("long").alias("taken"), before.alias("before"), "rank", "kept")


def _position(before: Column) -> Column:
    """Training time at which the source's cumulative demand reaches so many words."""
    share_before = before.cast("double") / F.greatest(F.col("target"), F.lit(1.0))
    return training_time(F.least(share_before, F.lit(1.0)), F.col("rank"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and position (training time, 0 to 1, of its first copy) of every document."""
    placed = _placed(docs, weights, share, cap)
    return placed.select("doc_id", "source", "size", "source_size", "target", "taken", _position(F.col("before")).alias("position"))


def placed_copies(docs: DataFrame) -> DataFrame:
    """Each document as often as it is taken: doc_id, source, size, source_size, target, taken, before, rank, kept (its columns), copy (from 0), words, position.

    A copy's place is where the source's demand reaches its own cumulative size, that of a pass more than the copy before it.
    """
    n = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    each = _placed(docs, keep=docs.columns).filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1)))
    each = each.withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")))
    return each.withColumn("position", _position(F.col("before") + F.col("copy") * F.col("source_size")))


def copies(docs: DataFrame) -> DataFrame:
    """The mix itself, in training order: each document's columns as often as it is taken, the last copy cut after the words that are left."""
    names = docs.columns
    each = placed_copies(docs).select("doc_id", "size", "words", "copy", "position", *[F.col("kept").getField(f"c{i}").alias(f"c{i}") for i in range(len(names))])
    text = f"c{names.index('text')}"
    short = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("words").cast("int")), " ")
    each = each.withColumn(text, F.when(F.col("words") < F.col("size"), short).otherwise(F.col(text)))
    ordered = each.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "copy")
    return ordered.select(*[F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def by_position(mixed: DataFrame) -> DataFrame:
    """Rows in training order, range-partitioned by position."""
    return mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
