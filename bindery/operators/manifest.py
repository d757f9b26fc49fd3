"""The manifest: a flat table first, and a JSON document written line by line."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions import naming
from bindery.operators import render

FILE_ROW = [
    "path",
    "category",
    "size_bytes",
    "sha256",
    "total_file_lines",
    "chunk_index",
    "chunk_count",
    "file_start_line",
    "file_end_line",
    "file_line_count",
    "bundle_start_line",
    "bundle_end_line",
    "bundle_line_count",
]


def manifest_files(placed: DataFrame, meta: DataFrame, root: Column, stamp: Column) -> DataFrame:
    """The manifest as a flat table: one row per chunk in a bundle."""
    sizes = meta.select("repo", "rel_path", "size_bytes", "sha256")
    return placed.join(sizes, ["repo", "rel_path"]).select(
        "repo",
        "bundle_id",
        naming.bundle_name(root, F.col("bundle_id"), stamp).alias("bundle"),
        F.col("rel_path").alias("path"),
        "category",
        "size_bytes",
        "sha256",
        "total_file_lines",
        "chunk_index",
        "chunk_count",
        F.col("start_line").alias("file_start_line"),
        F.col("end_line").alias("file_end_line"),
        F.col("line_count").alias("file_line_count"),
        "bundle_start_line",
        "bundle_end_line",
        F.col("block_lines").alias("bundle_line_count"),
        "physical_start_line",
        "physical_end_line",
    )


def bundle_documents(manifest: DataFrame) -> DataFrame:
    """One JSON object per bundle: its name and its files in order."""
    row = F.struct(*FILE_ROW)
    return (
        manifest.groupBy("repo", "bundle_id", "bundle")
        .agg(F.sort_array(F.collect_list(F.struct("bundle_start_line", row.alias("row")))).alias("rows"))
        .select(
            "repo",
            "bundle_id",
            F.to_json(
                F.struct("bundle", F.transform("rows", lambda r: r["row"]).alias("files"))
            ).alias("json"),
        )
    )


def summary(meta: DataFrame, pack_skips: DataFrame) -> DataFrame:
    """Totals per repository of the chosen files and of the chunks left out."""
    totals = meta.groupBy("repo").agg(
        F.count("*").alias("selected_file_count"),
        F.sum("line_count").alias("selected_total_lines"),
        F.sum("size_bytes").alias("selected_total_bytes"),
    )
    left_out = pack_skips.groupBy("repo").agg(F.count("*").alias("skipped_during_pack_count"))
    return totals.join(left_out, "repo", "left").fillna(0, ["skipped_during_pack_count"])


def run_result(meta: DataFrame, packed: DataFrame) -> DataFrame:
    """Files chosen, chunks packed and bundles made, per repository."""
    chosen = meta.groupBy("repo").agg(F.count("*").alias("files_exported"))
    # Bundles count up from 1 without gaps, so their number is the last one.
    made = packed.groupBy("repo").agg(
        F.max("bundle_id").alias("bundles_created"), F.count("*").alias("chunks")
    )
    return chosen.join(made, "repo", "left").fillna(0, ["bundles_created", "chunks"])


def tree_file_rows(sizes: DataFrame, root: Column, stamp: Column) -> DataFrame:
    """Manifest rows of the tree block that opens the first bundle of each repository."""
    n = (F.col("lines") + render.TREE_EXTRA_LINES).cast("int")
    one = F.lit(1)
    return sizes.select(
        "repo",
        one.alias("bundle_id"),
        naming.bundle_name(root, one, stamp).alias("bundle"),
        naming.tree_name(root, stamp).alias("path"),
        F.lit("filetree").alias("category"),
        F.col("chars").cast("bigint").alias("size_bytes"),
        F.lit("").alias("sha256"),
        n.alias("total_file_lines"),
        one.alias("chunk_index"),
        one.alias("chunk_count"),
        one.alias("file_start_line"),
        n.alias("file_end_line"),
        n.alias("file_line_count"),
        one.alias("bundle_start_line"),
        n.alias("bundle_end_line"),
        n.alias("bundle_line_count"),
        one.alias("physical_start_line"),
        n.alias("physical_end_line"),
    )


def quoted(text: Column) -> Column:
    """A string as a JSON literal."""
    wrapped = F.to_json(F.array(text))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


# Order of the lines of a manifest document.
ORDER = ["sec", "rank", "key"]


def document_rows(
    facts: DataFrame,
    selected_paths: DataFrame,
    files: DataFrame,
    pack_skips: DataFrame,
    bundles: DataFrame,
    run: dict[str, object],
) -> DataFrame:
    """Lines of each repository's manifest: ``(repo, sec, rank, key, text)``.

    Lists without a bound (paths, files, skips, bundles) are one row per element,
    so no task ever holds a whole manifest.  ``facts`` has one row per repository
    with the totals, the selection, ``root``, ``manifest`` and ``filetree``.
    """
    # Elements are told apart by value, so each stands once.
    selected_paths = selected_paths.select("repo", "path").distinct()
    firsts = (
        facts.select("repo")
        .join(selected_paths.groupBy("repo").agg(F.min("path").alias("first_path")), "repo", "left")
        .join(files.groupBy("repo").agg(F.min("rel_path").alias("first_file")), "repo", "left")
        .join(
            pack_skips.groupBy("repo").agg(F.min(_skip_key()).alias("first_skip")), "repo", "left"
        )
    )

    def field(name: str, value: Column, end: str = ",") -> Column:
        return F.concat(F.lit(f'"{name}": '), value, F.lit(end))

    def constant(name: str) -> Column:
        return field(name, F.lit(json.dumps(run[name], ensure_ascii=False)))

    def array(name: str) -> Column:
        return field(name, F.to_json(name))

    def number(name: str, end: str = ",") -> Column:
        return field(name, F.col(name).cast("string"), end)

    frame = [
        (0, F.lit("{")),
        (0, constant("tool")),
        (0, constant("created_at_utc")),
        (0, field("project_root", quoted(F.col("root")))),
        (0, constant("max_lines_per_bundle")),
        (0, number("bundle_count")),
        (0, constant("skip_secret_like_files")),
        (0, F.lit('"selection": {')),
        (0, field("selection_mode", quoted(F.col("selection_mode")))),
        (0, array("selected_categories")),
        (0, array("name_filters")),
        (0, array("missing_paths")),
        (0, F.lit('"selected_paths": [')),
        (2, F.lit("]},")),
        (2, F.lit('"selected_files": [')),
        (4, F.lit("],")),
        (4, field("filetree", quoted(F.col("filetree")))),
        (4, F.lit('"summary": {')),
        (4, number("selected_file_count")),
        (4, number("selected_total_lines")),
        (4, number("selected_total_bytes")),
        (4, field("skipped_counts", F.to_json("skipped_counts"))),
        (4, number("skipped_during_pack_count", "},")),
        (4, F.lit('"skipped_during_pack": [')),
        (6, F.lit("],")),
        (6, F.lit('"bundles": [')),
        (8, F.lit("]")),
        (8, F.lit("}")),
    ]
    lines = F.array(
        *[
            F.struct(F.lit(sec).alias("sec"), F.lit(i).cast("bigint").alias("rank"), F.lit("").alias("key"), text.alias("text"))
            for i, (sec, text) in enumerate(frame)
        ]
    )

    def element(first: Column, json_text: Column) -> Column:
        return F.concat(F.when(first, "  ").otherwise(" ,"), json_text)

    def rows(df: DataFrame, sec: int, rank: Column, key: Column, text: Column) -> DataFrame:
        return df.select(
            "repo",
            F.lit(sec).alias("sec"),
            rank.cast("bigint").alias("rank"),
            key.alias("key"),
            text.alias("text"),
        )

    zero = F.lit(0)
    skip = F.struct("path", "reason", "line_count", "threshold", "max_lines")
    parts = [
        facts.select("repo", F.inline(lines)),
        rows(
            selected_paths.join(firsts, "repo"),
            1,
            zero,
            F.col("path"),
            element(F.col("path") == F.col("first_path"), quoted(F.col("path"))),
        ),
        rows(
            files.join(firsts, "repo"),
            3,
            zero,
            F.col("rel_path"),
            element(F.col("rel_path") == F.col("first_file"), quoted(F.col("rel_path"))),
        ),
        rows(
            pack_skips.join(firsts, "repo"),
            5,
            F.col("stage"),
            _skip_key()["key"],
            element(_skip_key() == F.col("first_skip"), F.to_json(skip)),
        ),
        rows(
            bundles.join(facts.select("repo"), "repo"),
            7,
            F.col("bundle_id"),
            F.lit(""),
            element(F.col("bundle_id") == 1, F.col("json")),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _skip_key() -> Column:
    chunk = F.lpad(F.coalesce("chunk_index", F.lit(0)).cast("string"), 10, "0")
    return F.struct("stage", F.concat("path", F.lit("\x00"), chunk).alias("key"))
