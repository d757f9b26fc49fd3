"""From listed files to the files table: reasons, categories, lines, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions import fixed, ignore, paths, redact, text

META = ["repo", "rel_path", "category", "line_count", "size_bytes", "sha256"]


def path_reason(
    path: Column, skip_secrets: bool = True, ignore_regex: Column | None = None
) -> Column:
    """First reason to leave a path out, or null.  Reads no content."""
    none = F.lit(None).cast("string")
    return F.coalesce(
        F.when(paths.has_excluded_part(path), fixed.REASON_DIR),
        F.when(paths.has_excluded_prefix(path), fixed.REASON_PREFIX),
        none
        if ignore_regex is None
        else F.when(ignore.is_ignored(path, ignore_regex), fixed.REASON_IGNORE_FILE),
        F.when(paths.matches_any_glob(path, fixed.EXTRA_PATTERNS), fixed.REASON_EXTRA),
        F.when(paths.matches_any_glob(path, fixed.SECRET_PATTERNS), fixed.REASON_SECRET)
        if skip_secrets
        else none,
    )


def ignore_rules(listing: DataFrame) -> DataFrame:
    """``(repo, ignore_regex)`` from the root ignore file of each tree.

    ``listing`` has ``repo, rel_path`` and text or bytes in ``content``.
    """
    return listing.where(F.col("rel_path") == ".gitignore").select(
        "repo", ignore.ignore_regex("content").alias("ignore_regex")
    )


def ignore_lines(listing: DataFrame) -> DataFrame:
    """The lines of every root ignore file: ``(repo, ordinal, pattern)``."""
    return listing.where(F.col("rel_path") == ".gitignore").select(
        "repo",
        F.posexplode(text.lines(text.unify_line_ends(F.col("content")))).alias(
            "ordinal", "pattern"
        ),
    )


def with_reason(
    listing: DataFrame, skip_secrets: bool = True, rules: DataFrame | None = None
) -> DataFrame:
    """Adds ``category`` and ``reason`` (null for paths worth reading).

    ``rules`` holds one row per tree.  No hint is given for the join: Spark
    broadcasts the rules if they are small and splits a large tree otherwise.
    The pattern of a tree is compiled whenever the tree changes from row to row, so
    rows without contents are sorted by tree inside their partitions; a task then
    compiles each pattern once however trees alternate.  Rows with contents are not
    moved for it.
    """
    path = F.col("rel_path")
    light = rules is not None and "content" not in listing.columns
    if rules is None:
        found = path_reason(path, skip_secrets)
    else:
        listing = listing.join(rules, "repo", "left")
        found = path_reason(path, skip_secrets, F.col("ignore_regex"))
    if light:
        listing = listing.sortWithinPartitions("repo")
    listing = listing.withColumn("category", paths.category(path))
    reason = F.coalesce(found, F.when(F.col("category").isNull(), fixed.REASON_TYPE))
    if light:
        # The generator of one row keeps filters on the reason from being pushed below the sort.
        once = F.inline(F.array(F.struct(reason.alias("reason"))))
        out = listing.select("*", once)
    else:
        out = listing.withColumn("reason", reason)
    return out.drop("ignore_regex")


def _binary_content(kind: str) -> Column:
    return F.col("content") if kind == "binary" else F.col("content").cast("binary")


def judge(listing: DataFrame) -> DataFrame:
    """Adds the reasons that need content: binary files and read errors.

    Content is looked at only where the path gave no reason.  Trees that were
    read from disk carry ``read_ok``; tables have nothing to fail.
    """
    kind = listing.schema["content"].dataType.simpleString()
    sniff = F.when(text.looks_binary(_binary_content(kind)), fixed.REASON_BINARY)
    failed = (
        F.when(~F.col("read_ok"), fixed.REASON_READ)
        if "read_ok" in listing.columns
        else F.lit(None).cast("string")
    )
    return listing.withColumn(
        "reason", F.coalesce("reason", failed, sniff)
    )


def _with_texts(judged: DataFrame, keep: list[str]) -> DataFrame:
    """Rows with ``_text`` (unified line ends, null where left out) and ``_size``."""
    kind = judged.schema["content"].dataType.simpleString()
    decoded = text.decode(F.col("content")) if kind == "binary" else F.col("content")
    size = F.col("size_bytes") if "size_bytes" in judged.columns else F.octet_length("content")
    wanted = F.when(F.col("reason").isNull(), text.unify_line_ends(decoded))
    # The generator of one row keeps filters on the counts from being pushed to
    # the scan, where they would repeat the work on the text.
    once = F.inline(F.array(F.struct(wanted.alias("_text"))))
    return judged.select(*keep, size.cast("bigint").alias("_size"), once)


def _counted() -> list[Column]:
    body = F.col("_text")
    return [
        text.line_count(body).alias("line_count"),
        F.col("_size").alias("size_bytes"),
        text.content_hash(body).alias("sha256"),
    ]


def finish(judged: DataFrame) -> DataFrame:
    """Kept rows of a judged listing with counts, hash and unified text."""
    kept = judged.where(F.col("reason").isNull())
    rows = _with_texts(kept, ["repo", "rel_path", "category", "reason"])
    return rows.select(
        "repo", "rel_path", "category", *_counted(), F.col("_text").alias("content")
    )


def ledger(judged: DataFrame) -> DataFrame:
    """Every row of a judged listing with its reason or its counts, without texts.

    One pass over the contents that serves the files table, the skip counts, and
    the question which files would gain lines by redaction (hardly any).
    """
    rows = _with_texts(judged, ["repo", "rel_path", "category", "reason"])
    grown = redact.added_lines(F.col("_text")).alias("added_lines")
    return rows.select("repo", "rel_path", "category", "reason", *_counted(), grown)


def files(
    listing: DataFrame, skip_secrets: bool = True, rules: DataFrame | None = None
) -> DataFrame:
    """The files table of a listing that carries its contents."""
    return finish(judge(with_reason(listing, skip_secrets, rules)))


def kept_paths(
    listing: DataFrame, skip_secrets: bool = True, rules: DataFrame | None = None
) -> DataFrame:
    """``(repo, rel_path, category)`` of the kept files, without work on their texts."""
    judged = judge(with_reason(listing, skip_secrets, rules))
    return judged.where(F.col("reason").isNull()).select("repo", "rel_path", "category")


def count_reasons(judged: DataFrame) -> DataFrame:
    return (
        judged.where(F.col("reason").isNotNull())
        .groupBy("repo", "reason")
        .agg(F.count("*").alias("files"))
    )


def skips(
    listing: DataFrame, skip_secrets: bool = True, rules: DataFrame | None = None
) -> DataFrame:
    """Left-out files per repository and reason."""
    return count_reasons(judge(with_reason(listing, skip_secrets, rules)))


def meta(files: DataFrame) -> DataFrame:
    """The files table without its texts."""
    return files.select(*META)


def file_lines(files: DataFrame) -> DataFrame:
    """One row per line: ``(repo, rel_path, line_no, line)``."""
    return files.select(
        "repo", "rel_path", F.posexplode(text.lines(F.col("content"))).alias("pos", "line")
    ).select("repo", "rel_path", (F.col("pos") + 1).alias("line_no"), "line")
