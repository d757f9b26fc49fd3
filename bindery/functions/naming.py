"""Names, time stamps and typed lists."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.functions import fixed, paths

# Shape of a run's time stamp.
STAMP_FORMAT = "yyyyMMdd'T'HHmmss'Z'"
STAMP_REGEX = r"^\d{8}T\d{6}Z$"


def stamp_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")


def stamp(moment: Column) -> Column:
    """Time stamp of a UTC timestamp column (the session time zone is UTC)."""
    return F.date_format(moment, STAMP_FORMAT)


def is_stamp(text: Column) -> Column:
    return text.rlike(STAMP_REGEX)


def stamp_of_dir(name: Column, otherwise: Column) -> Column:
    """The stamp that ends a directory name, else the given one."""
    tail = F.substring_index(name, "_", -1)
    return F.when(is_stamp(tail), tail).otherwise(otherwise)


def project_name(root_name: Column) -> Column:
    return F.replace(root_name, F.lit(" "), F.lit("_"))


def output_dir_name(root_name: Column, run_stamp: Column) -> Column:
    project = project_name(root_name)
    return F.concat_ws(
        "_",
        F.lit(fixed.OUTPUT_DIR),
        F.when(project == "", "project").otherwise(project),
        run_stamp,
    )


def bundle_name(root_name: Column, bundle_id: Column, run_stamp: Column) -> Column:
    return F.format_string("%s_bundle_%03d_%s.txt", project_name(root_name), bundle_id, run_stamp)


def manifest_name(root_name: Column, run_stamp: Column) -> Column:
    return F.format_string("%s_manifest_%s.json", project_name(root_name), run_stamp)


def tree_name(root_name: Column, run_stamp: Column) -> Column:
    return F.format_string("%s_file_tree_%s.txt", project_name(root_name), run_stamp)


def split_commas(raw: Column) -> Column:
    """Comma-separated words, trimmed, blanks dropped."""
    words = F.transform(F.split(raw, ","), lambda w: F.regexp_replace(w, r"(?U)^\s+|\s+$", ""))
    return F.filter(words, lambda w: w != "")


def split_words(raw: Column) -> Column:
    """Words separated by commas, semicolons or white space."""
    return F.filter(F.split(raw, r"(?U)[,;\s]+"), lambda w: w != "")


def canonical_category(word: Column) -> Column:
    """Category a word stands for, or null."""
    key = F.lower(F.trim(word))
    known = {c: c for c in fixed.CATEGORY_DESCRIPTIONS}
    return paths.literal_map({**known, **fixed.CATEGORY_ALIASES})[key]


def categories_of(raw: Column) -> Column:
    """Known categories of an array of words, each once, in typed order."""
    return F.array_distinct(
        F.filter(F.transform(raw, canonical_category), lambda c: c.isNotNull())
    )


def unknown_categories(raw: Column) -> Column:
    """The words that stand for no category; blanks count as unknown."""
    return F.filter(raw, lambda w: canonical_category(w).isNull())


def known_categories(words) -> list[str]:
    """Driver-side twin of :func:`categories_of` for a user's word list."""
    lookup = {c: c for c in fixed.CATEGORY_DESCRIPTIONS}
    lookup.update(fixed.CATEGORY_ALIASES)
    keys = [w.strip().lower() for w in words]
    return list(dict.fromkeys(lookup[k] for k in keys if k in lookup))


def require_categories(words) -> list[str]:
    """Categories of the words; raises with every word that names none."""
    unknown = [w for w in words if not known_categories([w])]
    if unknown:
        raise ValueError("Unsupported categories requested: " + ", ".join(unknown))
    return known_categories(words)


def path_input(raw: Column, root: Column) -> Column:
    """A typed path: trimmed, without ending slashes, relative to its root."""
    value = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    below = F.regexp_replace(value, r"/+$", "")
    return (
        F.when(F.startswith(below, F.concat(root, F.lit("/"))), F.substring(below, F.length(root) + 2, F.length(below)))
        .when(below == root, ".")
        .otherwise(below)
    )
