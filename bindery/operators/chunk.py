"""Splitting files into line chunks, and the report of what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions import fixed, text


def band(
    line_count: Column, warn: int = fixed.WARN_LINES, skip: int = fixed.SKIP_LINES
) -> Column:
    """``empty``, ``ok``, ``warn`` or ``skip``; both limits are inclusive."""
    return (
        F.when(line_count == 0, "empty")
        .when(line_count >= skip, "skip")
        .when(line_count >= warn, "warn")
        .otherwise("ok")
    )


def large_files(
    files: DataFrame, warn: int = fixed.WARN_LINES, skip: int = fixed.SKIP_LINES
) -> DataFrame:
    """Report rows of files that were dropped for their size or nearly were."""
    found = band(F.col("line_count"), warn, skip)
    return files.where(found.isin("warn", "skip")).select(
        "repo",
        F.col("rel_path").alias("path"),
        F.when(found == "skip", fixed.REASON_LARGE_SKIP)
        .otherwise(fixed.REASON_LARGE_WARN)
        .alias("reason"),
        "line_count",
        F.when(found == "skip", skip).otherwise(warn).cast("int").alias("threshold"),
        F.lit(None).cast("int").alias("max_lines"),
        F.lit(None).cast("int").alias("chunk_index"),
    )


def too_long(files: DataFrame, row_bytes: int, skip: int | None = fixed.SKIP_LINES) -> DataFrame:
    """Report rows of files that are not left out for their lines, but have no text, as it would not fit a row."""
    return _fitting(files.where(F.col("size_bytes") > row_bytes), skip).select(
        "repo",
        F.col("rel_path").alias("path"),
        F.lit(fixed.REASON_TOO_LONG).alias("reason"),
        "line_count",
        F.lit(None).cast("int").alias("threshold"),
        F.lit(None).cast("int").alias("max_lines"),
        F.lit(None).cast("int").alias("chunk_index"),
    )


def room(max_lines: int, overhead: int = fixed.EXACT_OVERHEAD) -> int:
    """Lines of content in a full chunk; a budget below the overhead leaves the budget."""
    return max_lines - overhead if max_lines > overhead else max_lines


def _fitting(files: DataFrame, skip: int | None) -> DataFrame:
    """The files to cut; ``skip=None`` leaves none out for its length."""
    some = files.where(F.col("line_count") > 0)
    return some if skip is None else some.where(F.col("line_count") < skip)


def chunk_ranges(
    files: DataFrame,
    max_lines: int = fixed.MAX_LINES,
    skip: int | None = fixed.SKIP_LINES,
    overhead: int = fixed.EXACT_OVERHEAD,
) -> DataFrame:
    """Line ranges of the chunks of each file; needs counts only, no text."""
    return _cut(_fitting(files, skip), room(max_lines, overhead), with_text=False)


def split_chunks(
    files: DataFrame,
    max_lines: int = fixed.MAX_LINES,
    skip: int | None = fixed.SKIP_LINES,
    overhead: int = fixed.EXACT_OVERHEAD,
) -> DataFrame:
    """Chunks with their lines joined by line feeds in ``text``."""
    return _cut(_fitting(files, skip), room(max_lines, overhead), with_text=True)


def _cut(files: DataFrame, size: int, with_text: bool) -> DataFrame:
    n = F.col("line_count")
    count = F.ceil(n / size).cast("int")
    numbers = F.sequence(F.lit(1), count)
    if with_text:
        # A file that fits stays as it is; only longer ones, which the size
        # band bounds, are taken apart into lines.
        whole = text.line_body(F.col("content"))
        parts = F.transform(
            numbers,
            lambda i: F.struct(
                i.alias("chunk_index"),
                F.array_join(
                    F.slice(F.col("_lines"), (i - 1) * size + 1, F.lit(size)), "\n"
                ).alias("text"),
            ),
        )
        one = F.array(F.struct(F.lit(1).alias("chunk_index"), whole.alias("text")))
        files = files.withColumn("_lines", F.when(n > size, F.split(whole, "\n")))
        rows = F.inline(F.when(n <= size, one).otherwise(parts))
        out = files.select("repo", "rel_path", "category", "line_count", count.alias("chunk_count"), rows)
    else:
        out = files.select(
            "repo",
            "rel_path",
            "category",
            "line_count",
            count.alias("chunk_count"),
            F.explode(numbers).alias("chunk_index"),
        )
    start = ((F.col("chunk_index") - 1) * size + 1).cast("int")
    end = F.least(F.col("chunk_index") * size, n).cast("int")
    columns = [
        "repo",
        "rel_path",
        "category",
        "chunk_index",
        "chunk_count",
        start.alias("start_line"),
        end.alias("end_line"),
        n.alias("total_file_lines"),
        (end - start + 1).alias("line_count"),
    ]
    return out.select(*columns, *(["text"] if with_text else []))


def processing_skips(large: DataFrame, oversized: DataFrame) -> DataFrame:
    """Both reports, those of splitting before those of packing."""
    return large.withColumn("stage", F.lit(1)).unionByName(
        oversized.withColumn("stage", F.lit(2))
    )
