"""Connected components of an undirected graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseline.llm.common import cut


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(a, b) long -> (node, root): every node that has an edge, with the smallest node it can reach.

    Each round replaces the edges by stars that lean towards smaller nodes; the rounds end when nothing changes, after
    a number of rounds that grows with the logarithm of the longest path. Minima are pre-aggregated before each shuffle
    and joined back, so that a node with very many edges is never gathered in one place. Loops, repeated and reversed
    edges and nulls are harmless; no edges give no rows. rows, if given, is about how many edges there are: it sets how
    many files the first round's become.
    """
    star = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        rows,
    )
    before = None
    while True:
        now = star.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == before or now.n == 0:
            break
        before = now
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a round never has more edges than the one before
        star = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), now.n)
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
