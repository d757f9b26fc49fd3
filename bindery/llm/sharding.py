"""Sharding by Hilbert-curve order.

Several metadata dimensions are quantised to equal steps between their smallest and
largest values (strings by rank: each distinct value its own step where they are few, else
steps of about equal row counts), the cell of a row gets its index on the
Hilbert curve, rows are sorted by it, and the order is cut into runs of equal row counts.
Rows that are close in all dimensions land in the same shard, so the value ranges of
a shard's files are narrow in every dimension.

Nulls take the lowest step; an empty table has no rows.  Ties on the curve are ordered
by the remaining columns, so equal rows may swap places without a visible change.  All columns
are kept, of any name and type, but for those named like the results, which give way to these (and
may still be dimensions).  Lengths of texts do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from bindery.session import settle

BITS = 5
#: Columns of the results; those of the rows with these names give way to them.
RESULTS = ("hilbert", "rank", "shard", "slot")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Indexes on the curve of cells, an array of (rows, dimensions)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of the sub-cubes, the largest first
        low = q - 1
        for i in range(n):
            there = (x[i] & q) != 0
            swap = np.where(there, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(there, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    index = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def string_steps(rows: DataFrame, column: str, steps: int) -> list[tuple[str, int]]:
    """The smallest string of each step with the step's number, in order.

    Distinct values are sorted by range; slices add up their own rows, and one row per slice gives where each begins.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    sliced = settle(counts.repartitionByRange("value").withColumn("slice", F.spark_partition_id()))
    sums = settle(sliced.groupBy("slice").agg(F.sum("n").alias("rows"), F.count("*").alias("values")))
    total = sums.agg(F.sum("rows").alias("rows"), F.sum("values").alias("values")).first()
    if not total["rows"]:
        return []
    # A step a value where that is possible, else by the rows before the value.
    weight, whole = (F.lit(1), total["values"]) if total["values"] <= steps else (F.col("n"), total["rows"])
    earlier = F.sum("values" if total["values"] <= steps else "rows").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("slice", F.coalesce(earlier, F.lit(0)).alias("start"))
    before = F.sum(weight).over(Window.partitionBy("slice").orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    placed = sliced.join(F.broadcast(starts), "slice").withColumn("before", F.col("start") + F.coalesce(before, F.lit(0)))
    found = placed.groupBy(F.expr(f"int(before * {steps} div {whole})").alias("step")).agg(F.min("value").alias("value"))
    return sorted((r["value"], r["step"]) for r in found.collect())


def sortable(value: Column, kind: DataType) -> Column:
    """The value as a sort key; kinds without an order, such as maps, sort by their JSON form."""
    if any(word in kind.simpleString() for word in ("map<", "variant")):
        return F.to_json(F.struct(value.alias("value")))
    return value


def ordered(rows: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """The rows with ``hilbert`` and ``rank``, their position in curve order from 0.

    Ranks come from a table sorted by range: every slice numbers its own rows, and the
    slices' row counts (one row per slice) give where each begins.
    """
    steps = 1 << bits
    kept = [c for c in rows.columns if c.lower() not in RESULTS]
    # The row and its dimensions lie in structs, so their names meet no others.
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    held = settle(rows.select(row, *[F.col(f"`{d}`").alias(f"d{i}") for i, d in enumerate(dimensions)]))
    kinds = dict(held.dtypes)
    strings = {i: string_steps(held, f"d{i}", steps) for i in range(len(dimensions)) if kinds[f"d{i}"] == "string"}
    numbers = [i for i in range(len(dimensions)) if i not in strings]
    held = held.withColumns({f"n{i}": F.col(f"d{i}").cast("double") for i in numbers})
    ends = [f(f"n{i}").alias(f"{k}{i}") for i in numbers for k, f in (("lo", F.min), ("hi", F.max))]
    lows = held.agg(*ends).first().asDict() if ends else {}

    def cell(i: int) -> Column:
        if i in strings:
            found = F
            for least, step in reversed(strings[i]):
                found = found.when(F.col(f"d{i}") >= least, step)
            return F.lit(0) if found is F else found.otherwise(0)
        low, high = lows[f"lo{i}"], lows[f"hi{i}"]
        if low is None or low == high:
            return F.lit(0)
        scaled = F.floor((F.col(f"n{i}") - F.lit(low)) / F.lit(high - low) * F.lit(steps))
        return F.when(scaled.isNull(), 0).otherwise(F.least(scaled, F.lit(steps - 1))).cast("int")

    @F.pandas_udf("bigint")
    def curve(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cells.to_numpy(), bits))

    names = [f"c{i}" for i in range(len(dimensions))]
    placed = held.withColumns({n: cell(i) for i, n in enumerate(names)})
    placed = placed.select("row", curve(F.struct(*names)).alias("hilbert"))
    fields = placed.schema["row"].dataType.fields
    keys = [F.col("hilbert"), *[sortable(F.col(f"row.`{f.name}`"), f.dataType) for f in fields]]
    sorted_rows = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    sliced = settle(
        sorted_rows.withColumn("slice", F.spark_partition_id()).withColumn(
            "at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        )
    )
    counts = sliced.groupBy("slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("slice", F.coalesce(before, F.lit(0)).alias("start"))
    # One row per slice, so its size is bounded by the number of partitions.
    return sliced.join(F.broadcast(starts), "slice").select("row.*", "hilbert", (F.col("start") + F.col("at")).alias("rank"))


def shard(rows: DataFrame, dimensions: list[str], shards: int, bits: int = BITS) -> DataFrame:
    """``ordered`` with ``shard`` and ``slot``: runs whose row counts differ by one at most."""
    found = ordered(rows, dimensions, bits)
    total = settle(found)
    count = total.count()
    if not count:
        return total.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("bigint")})
    number = F.expr(f"int((rank * {shards}) div {count})")
    first = F.expr(f"(shard * bigint({count}) + {shards - 1}) div {shards}")
    return total.withColumn("shard", number).withColumn("slot", F.col("rank") - first)


def shard_ranges(sharded: DataFrame, dimensions: list[str]) -> DataFrame:
    """Per shard its row count and the value range of each dimension, for file pruning."""
    ends = [f(d).alias(f"{k}_{d}") for d in dimensions for k, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *ends)


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder per shard, rows in curve order; a reader skips shards and files by their ranges."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
