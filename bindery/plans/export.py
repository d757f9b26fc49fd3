"""The whole run: from a files table to bundles, manifest, trees and overview."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery import __version__
from bindery.functions import fixed, naming
from bindery.operators import chunk, manifest, pack, render, report, scan, select, tree
from bindery.session import settle
from bindery.sources.documents import write_documents, write_sorted
from bindery.sources.trees import Scanned, scan_listing, scan_tree


@dataclass
class ExportResult:
    """Where the run wrote, and its tables."""

    output: str
    stamp: str
    tables: dict[str, str] = field(default_factory=dict)
    result: DataFrame | None = None
    skipped_items: DataFrame | None = None
    metadata: DataFrame | None = None


def check_places(source: str, output: str) -> None:
    """Output below the source would be scanned by the next run."""
    inside = output.rstrip("/") + "/"
    if inside.startswith(source.rstrip("/") + "/"):
        raise ValueError(f"output {output} lies inside the source {source}")


def _tree_documents(rows: DataFrame, root: Column, stamp: str) -> DataFrame:
    """Tree lines as document rows; the last line has no line feed."""
    end = F.when(F.col("sec") == 8, "").otherwise("\n")
    return rows.withColumn("doc", naming.tree_name(root, F.lit(stamp))).withColumn(
        "text", F.concat("text", end)
    )


def export(
    spark: SparkSession,
    scanned: Scanned,
    output: str,
    *,
    wanted: select.Wanted | None = None,
    max_lines: int = fixed.MAX_LINES,
    warn: int = fixed.WARN_LINES,
    skip: int = fixed.SKIP_LINES,
    layout: str = "exact",
    redacted: bool = False,
    overview: bool = False,
    include_tree: bool = True,
    bundles: str = "files",
    skip_secrets: bool = True,
    base: str = "",
    stamp: str | None = None,
    created: str | None = None,
) -> ExportResult:
    """Select, split, pack, render and write; one folder per repository.

    Everything up to the bundles works on tables without texts; the texts of the
    chosen files are read once, to write them.  ``bundles="table"`` writes them as
    rows of one parquet table instead of one file each.
    """
    if bundles not in ("files", "table"):
        raise ValueError(f"unknown form of bundles: {bundles}")
    if max_lines <= 0:
        raise ValueError("max_lines must be greater than zero")
    wanted = wanted or select.Wanted()
    moment = datetime.now(timezone.utc)
    stamp = stamp or moment.strftime("%Y%m%dT%H%M%SZ")
    created = created or moment.isoformat()
    root, overhead = F.col("repo"), render.overhead(layout)
    output = output.rstrip("/")

    result = ExportResult(output, stamp)

    def store(name: str, df: DataFrame) -> DataFrame:
        path = f"{output}/_tables_{stamp}/{name}"
        df.write.mode("overwrite").parquet(path)
        result.tables[name] = path
        return spark.read.schema(df.schema).parquet(path)

    meta = store("files", scanned.meta)
    if wanted.mode == "keyword":
        chosen = select.select_files(scanned.files, wanted, base)
        chosen_meta = settle(scan.meta(chosen.files))
    else:
        chosen = select.select_files(meta, wanted, base)
        chosen_meta = meta if wanted.mode == "all" else settle(scan.meta(chosen.files))

    large = chunk.large_files(chosen_meta, warn, skip)
    readable = chosen_meta
    if scanned.row_bytes is not None:
        large = large.unionByName(chunk.too_long(chosen_meta, scanned.row_bytes, skip))
        readable = chosen_meta.where(F.col("size_bytes") <= scanned.row_bytes)
    ranges = chunk.chunk_ranges(readable, max_lines, skip, overhead)
    packed = settle(pack.pack(settle(ranges), max_lines, overhead))
    skipped = chunk.processing_skips(large, pack.oversized(ranges, max_lines, overhead))
    result.metadata = chosen.metadata
    result.result = manifest.run_result(chosen_meta, packed)
    result.skipped_items = store("processing_skips", skipped)
    skip_counts = store("skip_counts", scanned.skips)

    # Tree: of all files, not only the chosen ones.
    tree_rows = settle(tree.tree_rows(meta, root))
    sizes = tree.tree_sizes(tree_rows)
    firsts = packed.where(F.col("bundle_id") == 1).select("repo").distinct()
    shown = sizes.join(firsts, "repo", "left_semi")
    inline = shown if include_tree else shown.where(F.lit(False))
    write_documents(_tree_documents(tree_rows, root, stamp), output, tree.ORDER)

    # Manifest table, in which the tree block shifts the first bundle.
    extra = inline.select("repo", (F.col("lines") + render.TREE_EXTRA_LINES).alias("tree_line_count"))
    texts = scanned.files.where(select.may_match(wanted, base)).drop("sha256", "size_bytes")
    grown = None
    if redacted:
        few = texts.join(scanned.grown, ["repo", "rel_path"], "left_semi")
        grown = render.grown_chunks(chunk.split_chunks(few, max_lines, skip, overhead))
    placed = render.positions(packed, layout, extra, grown)
    rows = manifest.manifest_files(placed, chosen_meta, root, F.lit(stamp))
    rows = rows.unionByName(manifest.tree_file_rows(inline, root, F.lit(stamp)))
    rows = store("manifest_files", rows)

    # Bundles: only here do texts move, once, to meet their bundle numbers.
    chunks = chunk.split_chunks(texts, max_lines, skip, overhead)
    heads = render.tree_heads(tree.tree_lines(tree_rows), inline.select("repo")) if include_tree else None
    blocks = render.bundle_blocks(chunks, packed, layout, redacted, heads)
    name = naming.bundle_name(root, F.col("bundle_id"), F.lit(stamp))
    if bundles == "table":
        store("bundle_texts", render.bundle_texts(blocks).withColumn("bundle", name))
    else:
        ordered = blocks.sortWithinPartitions("region", "repo", "rel_path", "chunk_index")
        named = ordered.select("repo", name.alias("doc"), F.col("block").alias("text"))
        write_sorted(named, output)

    # Manifest document.
    reasons = F.sort_array(F.collect_list(F.struct("reason", "files")))
    counts = skip_counts.groupBy("repo").agg(F.map_from_entries(reasons).alias("skipped_counts"))
    made = packed.groupBy("repo").agg(F.max("bundle_id").alias("bundle_count"))
    facts = settle(
        manifest.summary(chosen_meta, result.skipped_items)
        .join(chosen.metadata, "repo")
        .join(made, "repo", "left")
        .join(counts, "repo", "left")
        .fillna(0, ["bundle_count"])
        .withColumn("skipped_counts", F.coalesce("skipped_counts", F.expr("map()").cast("map<string,bigint>")))
        .withColumn("root", F.concat(F.lit(base.rstrip("/") + "/" if base else ""), root))
        .withColumn("filetree", naming.tree_name(root, F.lit(stamp)))
    )
    run = {
        "tool": f"bindery {__version__}",
        "created_at_utc": created,
        "max_lines_per_bundle": max_lines,
        "skip_secret_like_files": skip_secrets,
    }
    lines = manifest.document_rows(
        facts,
        store("selected_paths", chosen.paths.join(facts, "repo", "left_semi")),
        chosen_meta.select("repo", "rel_path"),
        result.skipped_items.join(facts, "repo", "left_semi"),
        manifest.bundle_documents(rows),
        run,
    )
    lines = lines.withColumn("doc", naming.manifest_name(root, F.lit(stamp))).withColumn(
        "text", F.concat("text", F.lit("\n"))
    )
    write_documents(lines, output, manifest.ORDER)

    if overview:
        name = naming.manifest_name(root, F.lit(stamp))
        text = report.overview(meta, chosen_meta, wanted.mode, name, created, root)
        end = (F.col("section") == 7) & (F.col("ord") == 3)
        text = text.withColumn("doc", F.lit("PROJECT_OVERVIEW.txt")).withColumn(
            "text", F.concat("text", F.when(end, "").otherwise("\n"))
        )
        write_documents(text, output, ["section", "ord"])
    return result


def export_tree(
    spark: SparkSession,
    source: str,
    output: str,
    *,
    many: bool = False,
    skip_secrets: bool = True,
    scanned: Scanned | None = None,
    **run,
) -> ExportResult:
    """Scan trees on disk, or take an earlier scan of them, and export."""
    check_places(source, output)
    base = source.rstrip("/") if many else source.rstrip("/").rsplit("/", 1)[0]
    scanned = scanned or scan_tree(spark, source, many, skip_secrets)
    return export(spark, scanned, output, skip_secrets=skip_secrets, base=base, **run)


def export_listing(
    spark: SparkSession,
    listing: DataFrame,
    output: str,
    *,
    skip_secrets: bool = True,
    rules: DataFrame | None = None,
    **run,
) -> ExportResult:
    """Export a table of files: ``repo, rel_path, content``."""
    scanned = scan_listing(listing, skip_secrets, rules)
    return export(spark, scanned, output, skip_secrets=skip_secrets, **run)


def tree_only(
    spark: SparkSession,
    source: str,
    output: str,
    *,
    many: bool = False,
    stamp: str | None = None,
) -> str:
    """Write nothing but the file trees.  Secrets are always left out."""
    check_places(source, output)
    stamp = stamp or naming.stamp_now()
    rows = settle(tree.tree_rows(scan_tree(spark, source, many).meta))
    write_documents(_tree_documents(rows, F.col("repo"), stamp), output, tree.ORDER)
    return stamp
