"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Sources share a total by weight; a target stops at ``cap`` times its source's size and the
excess is shared again until none is above.  Within a source every document is expected
``target / source_size`` times.  These expected copies are prefix-summed over the documents from
the longest to the shortest, one random offset of the source is added, and a document is taken
once for each integer boundary that its stretch crosses.  Neighbours in this order have nearly
equal sizes, so the words taken differ from the target by less than the longest document's, and
no document is taken more often than its expected copies rounded up.

Prefix sums are exact (whole parts and 10^-12 parts in decimals).  They come from a table sorted by
range: slices number their own rows, and one row per slice gives where each begins, so a source
that holds most rows is many slices.  Offsets depend on seed and source alone: reruns agree.

A null source is a source of its own, the last one; its offset is that of an empty name.  Sizes
that are null count as 0; a source without words has target 0 and none of its documents is taken.
Repeated rows are documents of their own; ties are ordered by ``doc_id`` (nulls first), then by the
hash of the whole row, and rows equal in all columns are interchangeable.  An empty table gives an empty
mix.  Rows keep their columns; those named like a column of the result are replaced.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.session import settle

#: Prefix sums are counted in parts of a copy.
PARTS = 10**12
RESULT = ("size", "source_size", "target", "copies")


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source in parts of a copy: 14 times 36 bits of a digest, below ``PARTS``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))))
    return F.conv(F.substring(digest, 1, 9), 16, 10).cast("bigint") * F.lit(14)


def numbered(rows: DataFrame, keys: list[Column | str]) -> DataFrame:
    """The rows as a table with ``place``, their position by ``keys`` from 0.

    The slices' row counts, one row per slice, give where each begins.
    """
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    sliced = settle(placed.withColumns({"slice": F.spark_partition_id(), "at": at}))
    before = F.sum("rows").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    counts = sliced.groupBy("slice").agg(F.count("*").alias("rows"))
    starts = counts.select("slice", F.coalesce(before, F.lit(0)).alias("start"))
    # One row per slice, so its size is bounded by the number of partitions.
    return sliced.join(F.broadcast(starts), "slice").withColumn("place", F.col("start") + F.col("at")).drop("slice", "at", "start")


def targets(sources: DataFrame, share: Fraction, cap: int) -> DataFrame:
    """Adds ``target`` to a table of sources with ``source_size`` and a whole ``weight``.

    A source is full when its part of what is left reaches the cap.  Each round shares the total less
    what full sources take, by one row of sums; parts only grow, so the rounds end.
    """
    big = "decimal(38,0)"
    total = sources.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    level, full = None, F.lit(False)
    while True:
        sums = sources.agg(
            F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("taken"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if not sums["weight"]:
            break
        found = (share * total - cap * sums["taken"]) / sums["weight"]
        if found == level:
            break
        level = found
        # weight * level >= cap * size, in whole numbers
        full = F.col("weight").cast(big) * F.lit(level.numerator).cast(big) >= F.col("source_size").cast(big) * F.lit(cap * level.denominator).cast(big)
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    part = (F.col("weight") * F.lit(level.numerator)).cast("double") / F.lit(level.denominator).cast("double")
    return sources.withColumn("target", F.when(full, (F.col("source_size") * cap).cast("double")).otherwise(part))


def mix(rows: DataFrame, size: Column, source: Column, weights: list[int], share: Fraction, cap: int = 2, seed: int = 0) -> DataFrame:
    """The rows with ``size``, ``source_size``, ``target`` and ``copies``, how often each is taken.

    Sources in order of their names have ``weights`` in turn; ``share`` is the mix's total as a part of all sizes.
    """
    kept = [F.col(f"row.`{c}`") for c in rows.columns if c not in RESULT]
    doc = F.col("`doc_id`") if "doc_id" in rows.columns else F.lit(None).cast("bigint")
    held = settle(
        rows.select(
            F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
            F.coalesce(size, F.lit(0)).cast("bigint").alias("size"),
            source.cast("string").alias("source"),
            doc.alias("doc"),
            F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in rows.columns]).alias("hash"),
            F.monotonically_increasing_id().alias("tie"),
        )
    )
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc").asc_nulls_first(), F.col("hash"), F.col("tie")]
    placed = numbered(held, order)
    sums = settle(placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("place").alias("first")))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = settle(numbered(sums, [F.col("source").asc_nulls_last()]).withColumn("weight", turn.cast("bigint")).drop("place"))
    rate = F.col("target") / F.col("source_size")
    rates = settle(
        targets(weighed, share, cap)
        .withColumn("rate", F.when(F.col("source_size") > 0, rate).otherwise(0.0))
        .select(
            F.col("source").alias("name"), "source_size", "first", "target", F.floor("rate").alias("whole"),
            F.floor((F.col("rate") - F.floor("rate")) * PARTS).cast("decimal(13,0)").alias("parts"),
            offset(F.col("source"), seed).cast("decimal(13,0)").alias("offset"),
        )
    )
    found = placed.join(rates, F.col("source").eqNullSafe(F.col("name")))
    place = (F.col("place") - F.col("first")).cast("decimal(20,0)")
    crossed = found.withColumn("place", place).withColumn(
        "copies", F.col("whole") + F.expr(f"((place + 1) * parts + offset) div {PARTS} - (place * parts + offset) div {PARTS}")
    )
    return crossed.select(*kept, *RESULT)


def emitted(mixed: DataFrame) -> DataFrame:
    """One row for each copy that is taken, with ``copy`` from 1; documents not taken have none."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
