"""File trees as rows of text, in an order that the rows carry themselves.

Facts about directories (last file, last sub-directory, compact or not) are
aggregated with map-side combine and joined back to the files, so a directory or
tree of any size stays spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions import fixed, paths
from bindery.operators import ordered

# The drawing.
LAST, MORE = "└── ", "├── "
BLANK, BAR = "    ", "│   "
RULE = "─" * 40
TITLE = "📊 File Summary:"
SHORT_RULE = "  ───"

ORDER = ["sec", "rank", "top", "parent", "kind", "name"]
LINE = ["repo", *ORDER, "text"]


def _line(
    df: DataFrame,
    sec: int | Column,
    text: Column,
    rank: Column | None = None,
    top: Column | None = None,
    parent: Column | None = None,
    kind: int = 0,
    name: Column | None = None,
) -> DataFrame:
    blank = F.lit("")

    def or_blank(c: Column | None) -> Column:
        return blank if c is None else c

    return df.select(
        "repo",
        (F.lit(sec) if isinstance(sec, int) else sec).cast("int").alias("sec"),
        (F.lit(0) if rank is None else rank).cast("bigint").alias("rank"),
        or_blank(top).alias("top"),
        or_blank(parent).alias("parent"),
        F.lit(kind).alias("kind"),
        or_blank(name).alias("name"),
        text.alias("text"),
    )


def placed_files(files: DataFrame) -> DataFrame:
    path = F.col("rel_path")
    return files.select(
        "repo",
        paths.parent(path).alias("parent"),
        paths.file_name(path).alias("name"),
        paths.icon(path, F.col("category")).alias("icon"),
    )


def directories(placed: DataFrame) -> DataFrame:
    """One row per directory with files: how it and its files are drawn."""
    here = placed.groupBy("repo", "parent").agg(
        F.count("*").alias("n"), F.max("name").alias("last_name")
    )
    here = here.withColumn("top", F.substring_index("parent", "/", 1))
    at_root = F.col("parent") == ""
    trees = here.groupBy("repo").agg(
        F.max(F.when(at_root, F.col("n"))).alias("root_files"),
        F.max(F.when(~at_root, F.col("top"))).alias("last_top"),
    )
    tops = here.groupBy("repo", "top").agg(
        F.count("*").alias("n_dirs"), F.max("parent").alias("last_parent")
    )
    here = here.join(tops, ["repo", "top"]).join(trees, "repo")

    direct = F.col("parent") == F.col("top")
    alone = (F.col("n_dirs") == 1) & direct & ~at_root
    end_top = (F.col("top") == F.col("last_top")) & F.col("root_files").isNull()
    indent = F.when(end_top, BLANK).otherwise(BAR)
    end_dir = F.col("parent") == F.col("last_parent")
    return here.select(
        "repo",
        "top",
        "parent",
        "last_name",
        (alone & (F.col("n") <= fixed.COMPACT_DIR_FILES)).alias("compact"),
        direct.alias("direct"),
        F.when(end_top, LAST).otherwise(MORE).alias("top_mark"),
        F.concat(indent, F.when(end_dir, LAST).otherwise(MORE)).alias("dir_mark"),
        F.when(at_root, "")
        .when(direct, indent)
        .otherwise(F.concat(indent, F.when(end_dir, BLANK).otherwise(BAR)))
        .alias("file_indent"),
        # Direct files of a nested directory are always followed by more.
        F.when(at_root, F.col("last_top").isNull())
        .otherwise(alone | ~direct)
        .alias("closes"),
    )


def type_counts(files: DataFrame) -> DataFrame:
    """Files per icon: ``(repo, icon, type_name, files)``."""
    icon = paths.icon(F.col("rel_path"), F.col("category")).alias("icon")
    return (
        files.groupBy("repo", icon)
        .agg(F.count("*").alias("files"))
        .select("repo", "icon", paths.icon_name(F.col("icon")).alias("type_name"), "files")
    )


def tree_rows(files: DataFrame, root_name: Column | None = None) -> DataFrame:
    """Lines of each tree with the columns that order them.

    Reads its input several times: give it a settled or stored files table.
    """
    root_name = F.col("repo") if root_name is None else root_name
    placed = placed_files(files)
    dirs = directories(placed)
    drawn = placed.join(dirs, ["repo", "parent"])
    top, parent, name = F.col("top"), F.col("parent"), F.col("name")
    entry = F.concat(F.col("icon"), F.lit(" "), name)
    end_file = F.col("closes") & (name == F.col("last_name"))
    in_root = parent == ""

    file_lines = _line(
        drawn.where(~F.col("compact")),
        F.when(in_root, 1).otherwise(2),
        F.concat("file_indent", F.when(end_file, LAST).otherwise(MORE), entry),
        top=top,
        parent=parent,
        kind=1,
        name=name,
    )
    dir_lines = _line(
        dirs.where(~F.col("direct")),
        2,
        F.concat("dir_mark", F.expr("substring(parent, length(top) + 2)"), F.lit("/")),
        top=top,
        parent=parent,
    )
    top_lines = _line(
        dirs.where((parent != "") & ~F.col("compact"))
        .groupBy("repo", "top")
        .agg(F.max("top_mark").alias("top_mark")),
        2,
        F.concat("top_mark", top, F.lit("/")),
        top=top,
    )
    # A compact directory holds three files at most.
    compact = (
        drawn.where("compact")
        .groupBy("repo", "top", "top_mark")
        .agg(F.sort_array(F.collect_list(F.struct("name", entry.alias("entry")))).alias("e"))
    )
    compact_lines = _line(
        compact,
        2,
        F.concat(
            "top_mark", top, F.lit("/ ["), F.array_join(F.transform("e", lambda x: x["entry"]), ", "), F.lit("]")
        ),
        top=top,
    )
    types = type_counts(files)
    width = F.greatest(F.lit(fixed.TYPE_NAME_WIDTH), F.length("type_name"))
    type_lines = _line(
        types,
        6,
        F.concat(
            F.lit("  "),
            "icon",
            F.lit(" "),
            F.rpad(F.col("type_name"), width, F.lit(" ")),
            F.lit(" × "),
            F.col("files"),
        ),
        rank=-F.col("files"),
        name=F.col("icon"),
    )
    totals = types.groupBy("repo").agg(F.sum("files").alias("files"))
    frame = F.array(
        *[
            F.struct(F.lit(sec).alias("sec"), text.alias("text"))
            for sec, text in [
                (0, F.concat(root_name, F.lit("/"))),
                (3, F.lit("")),
                (4, F.lit(RULE)),
                (5, F.lit(TITLE)),
                (7, F.lit(SHORT_RULE)),
                (8, F.concat(F.lit("  📁  Total: "), F.col("files"), F.lit(" files"))),
            ]
        ]
    )
    frame_lines = totals.select("repo", F.inline(frame))
    frame_lines = _line(frame_lines, F.col("sec"), F.col("text"))
    parts = [file_lines, dir_lines, top_lines, compact_lines, type_lines, frame_lines]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def tree_lines(rows: DataFrame, slices: int | None = None) -> DataFrame:
    """Numbered lines ``(repo, line_no, text)`` of settled tree rows."""
    return ordered.number_rows(rows, ORDER, "line_no", ["repo", "text"], slices).select(
        "repo", F.col("line_no").cast("int").alias("line_no"), "text"
    )


def tree_sizes(rows: DataFrame) -> DataFrame:
    """Lines and characters of each tree's text."""
    return rows.groupBy("repo").agg(
        F.count("*").alias("lines"),
        (F.sum(F.length("text")) + F.count("*") - 1).alias("chars"),
    )
