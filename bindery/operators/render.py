"""Rendered chunk blocks, their places in bundles, and bundle texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions import fixed
from bindery.functions.redact import added_lines, redact
from bindery.operators import pack

# The rules around blocks.
RULE = "=" * 60
TREE_HEAD = f"{RULE}\n===== FILETREE: Project Structure =====\n{RULE}\n"
TREE_FOOT = f"\n{RULE}\n===== END FILETREE =====\n{RULE}\n"
TREE_EXTRA_LINES = 6


def header() -> Column:
    """Seven lines above a chunk, without a final line feed."""
    return F.concat(
        F.lit(f"{RULE}\n===== BEGIN FILE: "),
        F.col("rel_path"),
        F.lit(" =====\n# category : "),
        F.col("category"),
        F.lit("\n# chunk : "),
        F.col("chunk_index"),
        F.lit("/"),
        F.col("chunk_count"),
        F.lit("\n# line_range : "),
        F.col("start_line"),
        F.lit("-"),
        F.col("end_line"),
        F.lit("\n# total_lines : "),
        F.col("total_file_lines"),
        F.lit(f"\n{RULE}"),
    )


def footer() -> Column:
    """Three lines below a chunk, without a final line feed."""
    return F.concat(
        F.lit(f"{RULE}\n===== END FILE: "),
        F.col("rel_path"),
        F.lit(" (chunk "),
        F.col("chunk_index"),
        F.lit("/"),
        F.col("chunk_count"),
        F.lit(f") =====\n{RULE}"),
    )


def overhead(layout: str = "exact") -> int:
    """Lines a block adds to its chunk: glued rules save one line."""
    return fixed.EXACT_OVERHEAD if layout == "exact" else fixed.CLEAN_OVERHEAD


def block(layout: str = "exact", redacted: bool = False, mode: str = "line") -> Column:
    """A chunk with header and footer.

    ``exact`` glues the first line to the header and the next block to the
    footer; ``clean`` ends both with a line feed.
    """
    body = redact(F.col("text"), mode) if redacted else F.col("text")
    gap = F.lit("" if layout == "exact" else "\n")
    return F.concat(header(), gap, body, F.lit("\n"), footer(), gap)


def render_blocks(chunks: DataFrame, layout: str = "exact", redacted: bool = False) -> DataFrame:
    return chunks.select(
        "repo", "rel_path", "chunk_index", block(layout, redacted).alias("block")
    )


def _in_bundle() -> Window:
    # A bundle holds at most max_lines / overhead chunks, so the window is small.
    return Window.partitionBy("repo", "bundle_id").orderBy("rel_path", "chunk_index")


def grown_chunks(chunks: DataFrame) -> DataFrame:
    """``(repo, rel_path, chunk_index, added_lines)`` of chunks that redaction lengthens."""
    added = added_lines(F.col("text")).cast("int").alias("added_lines")
    return chunks.select("repo", "rel_path", "chunk_index", added).where(F.col("added_lines") > 0)


def positions(
    packed: DataFrame,
    layout: str = "exact",
    tree_lines: DataFrame | None = None,
    grown: DataFrame | None = None,
) -> DataFrame:
    """Line range of each block in its bundle.

    The recorded range counts a block as ``lines + overhead``.  Glued blocks
    share a line, so the physical range drifts by one line per earlier block.
    ``tree_lines`` (``repo, tree_line_count``) shifts the first bundle; ``grown``
    (see :func:`grown_chunks`) lengthens redacted blocks, which packing ignores.
    """
    before = _in_bundle().rowsBetween(Window.unboundedPreceding, -1)
    lead = F.lit(0)
    if tree_lines is not None:
        packed = packed.join(tree_lines, "repo", "left")
        lead = F.when(F.col("bundle_id") == 1, F.coalesce("tree_line_count", F.lit(0))).otherwise(0)
    size = F.col("need")
    if grown is not None:
        packed = packed.join(grown, ["repo", "rel_path", "chunk_index"], "left")
        size = size + F.coalesce("added_lines", F.lit(0))
    packed = packed.withColumn("block_lines", size)
    used = F.coalesce(F.sum("block_lines").over(before), F.lit(0))
    glued = F.row_number().over(_in_bundle()) - 1 if layout == "exact" else F.lit(0)
    start = F.col("bundle_start_line")
    out = (
        packed.withColumn("bundle_start_line", (lead + used + 1).cast("int"))
        .withColumn("bundle_end_line", (start + F.col("block_lines") - 1).cast("int"))
        .withColumn("physical_start_line", (start - glued).cast("int"))
        .withColumn("physical_end_line", (F.col("bundle_end_line") - glued).cast("int"))
    )
    return out.drop("tree_line_count", "added_lines")


def bundle_blocks(
    chunks: DataFrame,
    packed: DataFrame,
    layout: str = "exact",
    redacted: bool = False,
    heads: DataFrame | None = None,
) -> DataFrame:
    """``(region, repo, bundle_id, rel_path, chunk_index, block)``.

    Texts move once: chunks and their bundle numbers are partitioned by the same
    regions, so the join needs no further exchange, and since a bundle lies in
    one region, neither does grouping or writing by bundle.  ``packed`` should
    be settled.  ``heads`` (``repo, place, head``) are lines that open the first
    bundle: rows in front of its first chunk, with negative places for a chunk index.
    """
    starts = pack.region_starts(packed)
    where = packed.select("repo", "rel_path", "chunk_index", "bundle_id")
    numbered = chunks.withColumn("anchor", F.col("chunk_index"))
    if heads is not None:
        first = (
            where.where(F.col("bundle_id") == 1)
            .groupBy("repo")
            .agg(F.min(F.struct("rel_path", F.col("chunk_index").alias("anchor"))).alias("first"))
            .select("repo", "first.*")
        )
        lines = heads.join(first, "repo").select(
            "repo", "rel_path", "anchor", F.col("place").cast(chunks.schema["chunk_index"].dataType).alias("chunk_index"), "head"
        )
        numbered = numbered.unionByName(lines, allowMissingColumns=True)
    else:
        numbered = numbered.withColumn("head", F.lit(None).cast("string"))
    keys = ["region", "repo", "rel_path", "chunk_index"]
    # Headers and redaction follow the join: only chosen chunks need them, and
    # the shuffle carries plain texts.
    joined = pack.by_region(numbered, starts, "anchor").join(pack.by_region(where, starts), keys, "left")
    bundle = F.when(F.col("head").isNotNull(), 1).otherwise(F.col("bundle_id")).cast(where.schema["bundle_id"].dataType)
    text = F.coalesce("head", block(layout, redacted))
    rendered = joined.withColumn("block", text).withColumn("bundle_id", bundle)
    return rendered.where("bundle_id is not null").select("region", "repo", "bundle_id", "rel_path", "chunk_index", "block")


def tree_heads(lines: DataFrame, inline: DataFrame) -> DataFrame:
    """``(repo, place, head)``: the tree block in front of a first bundle, one row per line.

    ``lines`` are numbered (``repo, line_no, text``); places rise with them and are all negative.
    """
    chosen = lines.join(inline, "repo", "left_semi")
    place = F.col("line_no") - F.lit(1 << 30)
    first = F.when(F.col("line_no") == 1, F.lit(TREE_HEAD)).otherwise("\n")
    body = chosen.select("repo", place.cast("int").alias("place"), F.concat(first, "text").alias("head"))
    return body.unionByName(inline.select("repo", F.lit(-1).alias("place"), F.lit(TREE_FOOT).alias("head")))


def bundle_texts(blocks: DataFrame) -> DataFrame:
    """One row per bundle with its whole text; ``max_lines`` bounds each row."""
    ordered = "listagg(block, '') within group (order by rel_path, chunk_index)"
    return (
        blocks.groupBy("region", "repo", "bundle_id")
        .agg(F.count_if(F.col("chunk_index") > 0).alias("chunks"), F.expr(ordered).alias("text"))
        .drop("region")
    )
