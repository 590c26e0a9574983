"""Connected components of links between ids, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, root) of every id in links (a, b): root is the least id that it reaches, itself included.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each turns the links into ones
    towards least neighbours, until they are stars. Sums before shuffles keep hubs cheap. The result
    reads a table in the scratch folder `name`, which the caller drops when it has saved the result.
    """
    size = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, before, i = scratch.save(edges, f"{name}/0"), None, 0
    now = size(edges)
    while now != before and now["n"]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        # a's neighbours are all below it: each, and a, links to the least
        star = large.join(small, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = star.unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        i += 1
        edges = scratch.save(star, f"{name}/{i}")
        scratch.drop(f"{name}/{i - 1}")
        before, now = now, size(edges)
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
