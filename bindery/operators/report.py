"""Summaries of files and the project overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions import fixed, paths


def by_category(files: DataFrame) -> DataFrame:
    return files.groupBy("repo", "category").agg(
        F.count("*").alias("files"),
        F.sum("line_count").alias("lines"),
        F.sum("size_bytes").alias("bytes"),
    )


def by_folder(files: DataFrame, max_depth: int = 2) -> DataFrame:
    return files.groupBy(
        "repo", paths.folder(F.col("rel_path"), max_depth).alias("folder")
    ).agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"))


def first_rows(df: DataFrame, order, limit: int, out: str = "place") -> DataFrame:
    """The first rows of each repository, numbered.

    The limit is applied in every partition before the shuffle, so a large
    repository sends ``limit`` rows per partition and no more.
    """
    place = F.row_number().over(Window.partitionBy("repo").orderBy(*order))
    return df.withColumn(out, place).where(F.col(out) <= limit)


def top_folders(files: DataFrame, limit: int, max_depth: int = 2) -> DataFrame:
    order = [F.desc("files"), F.asc("folder")]
    return first_rows(by_folder(files, max_depth), order, limit)


def category_table(files: DataFrame) -> DataFrame:
    """Categories by size; equal ones in the order of their first path."""
    counted = files.groupBy("repo", "category").agg(
        F.count("*").alias("files"),
        F.sum("line_count").alias("lines"),
        F.sum("size_bytes").alias("bytes"),
        F.min("rel_path").alias("first_path"),
    )
    described = counted.withColumn("description", paths.category_description(F.col("category")))
    order = [F.desc("files"), F.asc("first_path")]
    return first_rows(described, order, len(fixed.CATEGORY_DESCRIPTIONS)).drop("first_path")


def dependency_files(files: DataFrame) -> DataFrame:
    name = paths.file_name(F.col("rel_path"))
    return files.where(name.isin(fixed.DEPENDENCY_NAMES)).select("repo", "rel_path")


def frameworks(files: DataFrame) -> DataFrame:
    """``(repo, place, framework)`` for frameworks whose marker files exist."""
    name = paths.file_name(F.col("rel_path"))
    seen = [
        F.bool_or(paths.any_of(name.endswith(e) for e in endings.split())).alias(f"_f{i}")
        for i, endings in enumerate(fixed.FRAMEWORK_ENDINGS.values())
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("place"),
                F.lit(framework).alias("framework"),
                F.col(f"_f{i}").alias("seen"),
            )
            for i, framework in enumerate(fixed.FRAMEWORK_ENDINGS)
        ]
    )
    return (
        files.groupBy("repo")
        .agg(*seen)
        .select("repo", F.inline(F.filter(rows, lambda r: r["seen"])))
        .drop("seen")
    )


def reading_tier(path: Column) -> Column:
    """1 entry points, 2 configuration, 3 key directories, else null."""
    name = paths.file_name(path)
    return (
        F.when(name.isin(fixed.ENTRY_NAMES), 1)
        .when(name.isin(fixed.CONFIG_NAMES), 2)
        .when(paths.top_part(path).isin(fixed.KEY_DIRS), 3)
    )


def reading_order(files: DataFrame, limit: int = fixed.READING_ORDER_LENGTH) -> DataFrame:
    """``(repo, place, tier, rel_path)`` of the first files to read."""
    tiered = files.select("repo", "rel_path", reading_tier(F.col("rel_path")).alias("tier"))
    order = [F.asc("tier"), F.asc("rel_path")]
    return first_rows(tiered.where(F.col("tier").isNotNull()), order, limit).select(
        "repo", "place", "tier", "rel_path"
    )


def _right(number: Column, width: int) -> Column:
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))


def _left(text: Column, width: int) -> Column:
    return F.rpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))


# Headings of the overview.
HEAVY, LIGHT = "=" * 60, "-" * 40
STATISTICS = "📊 PROJECT STATISTICS"
FRAMEWORKS = "🚀 DETECTED FRAMEWORKS"
DEPENDENCIES = "📦 DEPENDENCY FILES"
CATEGORIES = "📁 FILES BY CATEGORY"
FOLDERS = "📂 TOP FOLDERS"
READING = "📖 SUGGESTED READING ORDER"


def overview(
    files: DataFrame,
    selected: DataFrame,
    mode: str,
    manifest: Column,
    generated: str,
    root_name: Column | None = None,
) -> DataFrame:
    """The overview text as rows ``(repo, section, ord, text)``.

    Every section is bounded: its rows are limited per repository.  Repositories
    without a chosen file get no overview.  Both tables are read once: each file is a few rows (see
    :func:`_facts`), one aggregate serves all sections, one window limits them, and the row of a
    repository's totals becomes the frame.
    """
    root_name = F.col("repo") if root_name is None else root_name
    facts = _facts(files, selected)
    limits = {
        DEPENDENCY: fixed.DEPENDENCIES_IN_OVERVIEW,
        CATEGORY: len(fixed.CATEGORY_DESCRIPTIONS),
        FOLDER: fixed.FOLDERS_IN_OVERVIEW,
        READ: fixed.READING_ORDER_LENGTH,
    }
    most = F.lit(1)
    for kind, limit in limits.items():
        most = F.when(F.col("kind") == kind, limit).otherwise(most)
    size = F.when(F.col("kind").isin(CATEGORY, FOLDER), -F.col("files")).otherwise(F.col("tier"))
    name = F.when(F.col("kind") == CATEGORY, F.col("first_path")).otherwise(F.col("key"))
    ranked = facts.withColumns({"_size": size, "_name": name})
    place = F.row_number().over(Window.partitionBy("repo", "kind").orderBy("_size", "_name"))
    # Spark applies the fixed limit in every partition before the shuffle.
    few = ranked.withColumn("place", place).where(F.col("place") <= max(limits.values())).where(F.col("place") <= most)
    # A repository has a few dozen rows by now.
    chosen = F.max("chosen_files").over(Window.partitionBy("repo"))
    few = few.withColumn("_chosen", chosen).where(F.col("_chosen") > 0)

    def row(section: int, at: int, text, only=None):
        text = F.lit(text) if isinstance(text, str) else text
        when = F.lit(True) if only is None else only
        return F.struct(
            F.lit(section).alias("section"), F.lit(at).alias("ord"), text.alias("text"), when.alias("only")
        )

    some_frameworks = F.col("marks") > 0
    some_deps = F.col("deps") > 0
    some_reading = F.col("to_read") > 0
    more = F.col("to_read") - fixed.READING_ORDER_LENGTH
    end = 1_000_000
    frame = F.array(
        row(0, 1, HEAVY),
        row(0, 2, F.concat(F.lit("PROJECT OVERVIEW: "), root_name)),
        row(0, 3, HEAVY),
        row(0, 4, f"Generated: {generated}"),
        row(0, 5, F.concat(F.lit("Manifest: "), manifest)),
        row(0, 6, ""),
        row(1, -2, STATISTICS),
        row(1, -1, LIGHT),
        row(1, 1, F.concat(F.lit("  Total files in project: "), F.col("all_files"))),
        row(1, 2, F.concat(F.lit("  Files exported: "), F.col("chosen_files"))),
        row(1, 3, f"  Selection mode: {mode}"),
        row(1, end, ""),
        row(2, -2, FRAMEWORKS, some_frameworks),
        row(2, -1, LIGHT, some_frameworks),
        *[
            row(2, i + 1, f"  • {framework}", F.col("marks").bitwiseAND(1 << i) > 0)
            for i, framework in enumerate(fixed.FRAMEWORK_ENDINGS)
        ],
        row(2, end, "", some_frameworks),
        row(3, -2, DEPENDENCIES, some_deps),
        row(3, -1, LIGHT, some_deps),
        row(3, end, "", some_deps),
        row(4, -2, CATEGORIES),
        row(4, -1, LIGHT),
        row(4, end, ""),
        row(5, -2, FOLDERS),
        row(5, -1, LIGHT),
        row(5, end, ""),
        row(6, -2, READING, some_reading),
        row(6, -1, LIGHT, some_reading),
        row(6, end - 1, F.concat(F.lit("  ... and "), more, F.lit(" more")), more > 0),
        row(6, end, "", some_reading),
        row(7, 1, HEAVY),
        row(7, 2, "END OF PROJECT OVERVIEW"),
        row(7, 3, HEAVY),
    )

    def bullet(column: str) -> Column:
        return F.concat(F.lit("  • "), F.col(column))

    def counted(width: int) -> Column:
        return F.concat(
            F.lit("  "),
            _left(F.col("key"), width),
            F.lit(" "),
            _right(F.col("files"), 4),
            F.lit(" files  "),
            _right(F.col("lines"), 7),
            F.lit(" lines"),
        )

    kind = F.col("kind")
    described = F.concat(counted(15), F.lit("  | "), paths.category_description(F.col("key")))
    text = (
        F.when(kind == DEPENDENCY, bullet("key"))
        .when(kind == CATEGORY, described)
        .when(kind == FOLDER, counted(20))
        .otherwise(F.concat(F.lit("  "), _right(F.col("place"), 3), F.lit(". "), F.col("key")))
    )
    own = F.array(F.struct(kind.alias("section"), F.col("place").alias("ord"), text.alias("text"), F.lit(True).alias("only")))
    rows = F.when(kind == TOTAL, F.filter(frame, lambda r: r["only"])).otherwise(own)
    return few.select("repo", F.inline(rows)).drop("only")


# Kinds of facts; those of files and folders are the numbers of their sections.
TOTAL, DEPENDENCY, CATEGORY, FOLDER, READ = 0, 3, 4, 5, 6


def _facts(files: DataFrame, selected: DataFrame) -> DataFrame:
    """One row per repository, category, folder, dependency file and file to read, in one aggregate.

    Row counts are ``files``; the total of a repository also has its chosen files, its dependency files, its files to
    read, and a bit in ``marks`` for each framework that shows.
    """
    name = paths.file_name(F.col("rel_path"))
    tier = reading_tier(F.col("rel_path"))
    depends = name.isin(fixed.DEPENDENCY_NAMES)
    marks = F.lit(0).cast("bigint")
    for i, endings in enumerate(fixed.FRAMEWORK_ENDINGS.values()):
        found = paths.any_of(name.endswith(e) for e in endings.split())
        marks = marks + F.when(found, F.lit(1 << i)).otherwise(0)

    def fact(kind: int, key, only: Column, **values: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        named = {n: values.get(n, zero).cast("bigint").alias(n) for n in ("tier", "marks", "chosen_files", "to_read", "deps")}
        return F.struct(F.lit(kind).alias("kind"), (F.lit("") if key is None else key).alias("key"), *named.values(), only.alias("only"))

    def rows(df: DataFrame, *facts: Column) -> DataFrame:
        items = F.inline(F.filter(F.array(*facts), lambda f: f["only"]))
        return df.select("repo", "rel_path", "line_count", items).drop("only")

    one, always = F.lit(1), F.lit(True)
    everything = rows(
        files,
        fact(TOTAL, None, always, marks=marks, to_read=tier.isNotNull().cast("int"), deps=depends.cast("int")),
        fact(DEPENDENCY, F.col("rel_path"), depends),
        fact(READ, F.col("rel_path"), tier.isNotNull(), tier=F.coalesce(tier, F.lit(0))),
    )
    chosen = rows(
        selected,
        fact(TOTAL, None, always, chosen_files=one),
        fact(CATEGORY, F.col("category"), always),
        fact(FOLDER, paths.folder(F.col("rel_path"), 2), always),
    )
    sums = [F.sum(n).alias(n) for n in ("chosen_files", "to_read", "deps")]
    counted = everything.unionByName(chosen).groupBy("repo", "kind", "key").agg(
        F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.min("rel_path").alias("first_path"),
        F.min("tier").alias("tier"), F.bit_or("marks").alias("marks"), *sums,
    )
    return counted.withColumn("all_files", F.col("files") - F.col("chosen_files"))
