"""Next-fit packing of chunks into bundles of at most ``max_lines`` lines.

Chunks of a repository are taken in order; a chunk that no longer fits closes
the bundle and opens the next.  The rule looks sequential, yet a run of chunks
acts on its start state in a simple way: the fill on entry only decides *where*
the first bundle closes, and after that the fill no longer matters.  So a slice
is described by one entry per possible first closing point, at most
``max_lines / overhead`` of them, and slices of one huge repository are packed
in parallel (see :mod:`bindery.operators.ordered`).
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindery.functions import fixed
from bindery.operators import ordered

# State of the fold: bundles closed so far, lines in the open bundle.
EMPTY = (0, 0)


def describe(needs: np.ndarray, max_lines: int, whole: bool) -> np.ndarray:
    """Rows ``(room, closed, fill)`` that describe a run of chunks.

    With ``room`` lines left in the open bundle, the row with the largest
    ``room`` not above that applies.  ``closed`` bundles get closed and ``fill``
    lines are in the open one afterwards; ``closed = -1`` means that the whole
    run fits, adding ``fill`` lines.  If nothing precedes the run (``whole`` is
    false) only the row for an empty bundle is needed.
    """
    total, after = next_openings(needs, max_lines)
    n = len(needs)
    # last[i]: the last bundle opened by a run of jumps from chunk i; closed[i]: how many jumps lead there.
    last = np.where(after < n, after, np.arange(n)).astype(np.int32)
    closed = (after < n).astype(np.int32)
    while (last[last] != last).any():
        closed, last = closed + closed[last], last[last]
    if not whole:
        return np.array([[max_lines, closed[0], total[n] - total[last[0]]]], dtype=np.int32)
    first = int(np.searchsorted(total, max_lines, side="right"))
    at = np.arange(min(first, n))
    rows = np.stack([total[at], closed[at] + 1, total[n] - total[last[at]]], axis=1)
    if first > n:
        rows = np.concatenate([rows, [[total[n], -1, total[n]]]])
    changes = np.ones(len(rows), bool)
    changes[1:] = (rows[1:, 1:] != rows[:-1, 1:]).any(axis=1)
    return rows[changes].astype(np.int32)


def next_openings(needs: np.ndarray, max_lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums, and for each chunk the first that does not fit into a bundle opened at it."""
    total = np.concatenate(([0], np.cumsum(needs, dtype=np.int64)))
    return total, np.searchsorted(total, total[:-1] + max_lines, side="right") - 1


def apply_description(state: tuple[int, int], table: np.ndarray, max_lines: int):
    """State after a run, from the state before it and the run's description."""
    bundles, used = state
    room = max_lines - used
    row = max(int(np.searchsorted(table[:, 0], room, side="right")) - 1, 0)
    _, closed, fill = (int(x) for x in table[row])
    return (bundles, used + fill) if closed < 0 else (bundles + closed, fill)


def next_fit(state: tuple[int, int], needs: np.ndarray, max_lines: int):
    """Bundle number (from 1) of each chunk, and the state afterwards."""
    bundles, used = state
    n = len(needs)
    if not n:
        return np.empty(0, dtype=np.int64), state
    total, after = next_openings(needs, max_lines)
    start = int(np.searchsorted(total, max_lines - used, side="right")) - 1
    if start >= n:
        return np.full(n, bundles + 1), (bundles, used + int(total[n]))
    # All places that jumps from the first opening reach: each round doubles the jumps and the places.
    jump, found = np.append(after, n), np.array([start])
    while jump[start] < n:
        found = np.concatenate([found, jump[found]])
        jump = jump[jump]
    found = np.unique(found[found < n])
    opened = np.zeros(n, dtype=np.int64)
    opened[found] = 1
    return bundles + 1 + np.cumsum(opened), (bundles + len(found), int(total[n] - total[found[-1]]))


def pack(
    chunks: DataFrame,
    max_lines: int = fixed.MAX_LINES,
    overhead: int = fixed.EXACT_OVERHEAD,
    slices: int | None = None,
) -> DataFrame:
    """Chunk rows (without their text) with ``need`` and ``bundle_id``.

    Chunks that can never fit are left out; :func:`oversized` lists them.
    Order within a repository is path, then chunk.  The slice a chunk was packed
    in stays as a column; regions start from it.
    """
    sized = chunks.withColumn("need", (F.col("line_count") + overhead).cast("int"))
    sized = sized.where(F.col("need") <= max_lines)
    laid = ordered.lay_out(sized, ["rel_path", "chunk_index"], slices)

    def advance(state, payload):
        table = np.frombuffer(payload, dtype=np.int32).reshape(-1, 3)
        return apply_description(state, table, max_lines)

    starts = ordered.slice_starts(
        laid,
        "need",
        lambda needs, whole: describe(needs, max_lines, whole).tobytes(),
        advance,
        EMPTY,
    )
    return ordered.replay(
        laid,
        "need",
        starts,
        EMPTY,
        lambda state, needs: next_fit(state, needs, max_lines),
        "bundle_id",
        [*sized.columns, ordered.SLICE],
    ).withColumn("bundle_id", F.col("bundle_id").cast("int"))


def region_starts(packed: DataFrame) -> list[tuple[str, str, int]]:
    """Keys ``(repo, rel_path, chunk_index)`` that cut the chunks into regions.

    A region is a slice whose start is moved to the next start of a bundle, so
    no bundle spans two regions.  There is at most one key per slice.
    ``packed`` should be settled.
    """
    bundle = F.struct("repo", "bundle_id")
    slices = packed.groupBy(ordered.SLICE).agg(F.min(bundle).alias("open"))
    # One row per slice: bounded by the number of slices, whatever the data.
    rows = (
        packed.join(F.broadcast(slices), ordered.SLICE)
        .where(bundle > F.col("open"))
        .groupBy(ordered.SLICE)
        .agg(F.min(F.struct("repo", "rel_path", "chunk_index")).alias("key"))
        .collect()
    )
    return sorted(tuple(row["key"]) for row in rows)


def region_of(starts: list[tuple[str, str, int]], index: str = "chunk_index") -> Column:
    """Number of the region a chunk belongs to, from its key alone: the starts not above it.

    A binary search over the sorted starts for each key of an Arrow batch; there is one start per slice at
    most, and they are no part of the plan.
    """
    if not starts:
        return F.lit(0)

    @F.pandas_udf("int")
    def place(repo: pd.Series, path: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(starts, key) for key in zip(repo, path, number)], dtype="int32")

    return place("repo", "rel_path", F.col(index).cast("int"))


def by_region(df: DataFrame, starts: list[tuple[str, str, int]], index: str = "chunk_index") -> DataFrame:
    """Rows partitioned by region, one partition each, with the number in ``region``."""
    numbered = df.withColumn("region", region_of(starts, index))
    return numbered.repartitionById(len(starts) + 1, F.col("region"))


def oversized(
    chunks: DataFrame,
    max_lines: int = fixed.MAX_LINES,
    overhead: int = fixed.EXACT_OVERHEAD,
) -> DataFrame:
    """Report rows of chunks that exceed a bundle on their own."""
    return chunks.where(F.col("line_count") + overhead > max_lines).select(
        "repo",
        F.col("rel_path").alias("path"),
        F.lit(fixed.REASON_OVERSIZED).alias("reason"),
        "line_count",
        F.lit(None).cast("int").alias("threshold"),
        F.lit(max_lines).cast("int").alias("max_lines"),
        F.col("chunk_index").cast("int").alias("chunk_index"),
    )
