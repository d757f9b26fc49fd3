"""Connected components of links between ids, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.session import forget, settle


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component``, the smallest id it reaches, for all ids of ``links`` (``a``, ``b``).

    Large-star and small-star steps in turn until the links stay as they are; every link
    then points from an id to its component.  Each round is written as a table, which goes when the
    next one is there; hubs are never gathered, as only minima are taken.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    held, mark = settle(links), None
    while True:
        found = held.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("sum")).first()
        if mark == found:
            return held.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                held.select(F.col("b").alias("id"), F.col("b").alias("component"))
            ).distinct()
        mark = found
        both = held.union(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        # Large star: the larger neighbours of an id point to the least of its neighbourhood.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = settle(large)
        # Small star: an id and its smaller neighbours point to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        before, held = held, settle(small.union(least.select("a", F.col("low").alias("b"))).distinct())
        forget(before, large)
