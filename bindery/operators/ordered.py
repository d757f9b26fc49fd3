"""Order-dependent folds over rows of any number of groups, without hot groups.

A window over one group runs in one task.  Here rows are range-partitioned on
``(repo, order...)`` instead, so a large group spreads over many *slices*, and a
fold over the group becomes a scan in two passes:

1. every slice reports how it changes the fold's state;
2. the reports, one small row per slice, are chained on the driver into the
   state each slice starts from;
3. every slice replays its rows from that state.

Only the first group of a slice can start in the middle, so one start state per
slice is enough.  Slices are checkpointed: their boundaries are data, and both
passes see the same ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindery.session import pin

SLICE = "_slice"
GROUP = "repo"
REPORT = f"{SLICE} int, first string, last string, payload binary"


def lay_out(
    df: DataFrame, order: list[str], slices: int | None = None
) -> DataFrame:
    """Rows sorted by repository and ``order``, cut into slices of similar size.

    Adds the slice number.  Give it rows that are cheap to read twice (a settled
    or stored table): range partitioning samples its input first.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = (
        df.repartitionByRange(n, GROUP, *order)
        .sortWithinPartitions(GROUP, *order)
        .withColumn(SLICE, F.spark_partition_id())
    )
    return pin(laid)


def group_runs(groups: pa.Array) -> list[tuple[str, int, int]]:
    """(group, start, end) of the runs of equal values in a sorted array."""
    if len(groups) == 0:
        return []
    codes = groups.dictionary_encode()
    idx = codes.indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(idx)) + 1
    starts = np.concatenate(([0], cuts))
    ends = np.concatenate((cuts, [len(idx)]))
    names = codes.dictionary
    return [(names[int(idx[s])].as_py(), int(s), int(e)) for s, e in zip(starts, ends)]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slice_starts(
    laid: DataFrame,
    column: str,
    summarise: Callable[[np.ndarray, bool], bytes],
    advance: Callable[[object, bytes], object],
    zero: object,
) -> dict[int, object]:
    """Start state of each slice for the first group in it.

    ``summarise(values, whole)`` describes the last group of a slice; ``whole``
    says that the group fills the slice, so the state before it still matters.
    ``advance(state, payload)`` applies such a description.
    """

    def report(batches):
        number, first, last, values, whole = None, None, None, [], True
        for batch in batches:
            if batch.num_rows == 0:
                continue
            number = _column(batch, SLICE)[0].as_py()
            data = _column(batch, column).to_numpy(zero_copy_only=False)
            for name, s, e in group_runs(_column(batch, GROUP)):
                if first is None:
                    first = name
                elif name != last:
                    values, whole = [], False
                last = name
                values.append(data[s:e])
        if number is not None:
            payload = summarise(np.concatenate(values), whole)
            yield pa.RecordBatch.from_pydict(
                {SLICE: [number], "first": [first], "last": [last], "payload": [payload]},
                schema=pa.schema(
                    [(SLICE, pa.int32()), ("first", pa.string()), ("last", pa.string()), ("payload", pa.binary())]
                ),
            )

    # One row per slice reaches the driver, a few kilobytes each at most.
    rows = laid.select(SLICE, GROUP, column).mapInArrow(report, REPORT).collect()
    starts, state, open_group = {}, zero, None
    for row in sorted(rows, key=lambda r: r[SLICE]):
        starts[row[SLICE]] = state if row["first"] == open_group else zero
        state = advance(starts[row[SLICE]] if row["first"] == row["last"] else zero, row["payload"])
        open_group = row["last"]
    return starts


def replay(
    laid: DataFrame,
    column: str,
    starts: dict[int, object],
    zero: object,
    step: Callable[[object, np.ndarray], tuple[np.ndarray, object]],
    out: str,
    keep: list[str],
) -> DataFrame:
    """Run the fold forward in every slice and add its value as ``out``.

    ``step(state, values)`` returns one bigint per row and the next state.  Rows
    pass through as Arrow batches, so memory holds one batch at a time.
    """
    schema = T.StructType(
        [laid.schema[k] for k in keep] + [T.StructField(out, T.LongType(), False)]
    )

    def run(batches):
        state, group = zero, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            data = _column(batch, column).to_numpy(zero_copy_only=False)
            result = np.empty(batch.num_rows, dtype=np.int64)
            number = _column(batch, SLICE)[0].as_py()
            for name, s, e in group_runs(_column(batch, GROUP)):
                if name != group:
                    state = starts[number] if group is None else zero
                    group = name
                result[s:e], state = step(state, data[s:e])
            yield pa.RecordBatch.from_arrays(
                [_column(batch, k) for k in keep] + [pa.array(result)], names=keep + [out]
            )

    columns = list(dict.fromkeys(keep + [SLICE, GROUP, column]))
    return laid.select(*columns).mapInArrow(run, schema)


def number_rows(
    df: DataFrame,
    order: list[str],
    out: str,
    keep: list[str],
    slices: int | None = None,
) -> DataFrame:
    """``row_number()`` per repository, for repositories of any size."""
    laid = lay_out(df.withColumn("_one", F.lit(1)), order, slices)
    starts = slice_starts(
        laid,
        "_one",
        lambda values, whole: len(values).to_bytes(8, "little"),
        lambda state, payload: state + int.from_bytes(payload, "little"),
        0,
    )
    return replay(
        laid,
        "_one",
        starts,
        0,
        lambda state, values: (state + 1 + np.arange(len(values)), state + len(values)),
        out,
        keep,
    )
