"""Column expressions over relative paths: parts, globs, category, icon."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.functions import fixed


def literal_words(words) -> Column:
    """A constant array of words; split from one literal, which folds."""
    return F.split(F.lit("|".join(words)), "[|]")


def literal_map(pairs: dict[str, str]) -> Column:
    """A constant map column; looking up a missing key gives null.

    Built from two arrays because that folds to one literal.  A lookup in
    ``create_map`` would be rewritten to a CASE with a branch per key, which
    overgrows generated code once filters repeat it.
    """
    return F.map_from_arrays(literal_words(pairs), literal_words(pairs.values()))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def top_part(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def parent(path: Column) -> Column:
    """Directory of the file, ``""`` at the root."""
    size = F.length(path) - F.length(file_name(path)) - 1
    return F.substring(path, F.lit(1), F.greatest(size, F.lit(0)))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def suffix(path: Column) -> Column:
    """Lower-cased last suffix; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def folder(path: Column, max_depth: int = 2) -> Column:
    """Folder of a summary row: the first ``max_depth`` parts without the last."""
    parts = F.split(path, "/")
    keep = F.least(F.size(parts), F.lit(max_depth)) - 1
    return F.when(keep < 1, ".").otherwise(F.array_join(F.slice(parts, F.lit(1), keep), "/"))


def has_excluded_part(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), literal_words(fixed.EXCLUDED_PARTS))


def has_excluded_prefix(path: Column) -> Column:
    return any_of(path.startswith(p) for p in fixed.EXCLUDED_PREFIXES)


def glob_regex(pattern: str, star: str = ".*", one: str = ".") -> str:
    """Regular expression of a shell glob, not anchored.

    ``star`` and ``one`` say what ``*`` and ``?`` stand for; by default both also
    match ``/``.
    """
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append(star)
        elif ch == "?":
            out.append(one)
        elif ch == "[":
            # A "]" straight after the bracket (or its "!") belongs to the set.
            first = i + 1 if pattern[i : i + 1] == "!" else i
            close = pattern.find("]", first + 1)
            if close < 0:
                out.append(r"\[")
            else:
                members = re.sub(r"([\\\[\]^&])", r"\\\1", pattern[first:close])
                out.append(("[^" if first > i else "[") + members + "]")
                i = close + 1
        else:
            out.append("\\" + ch if ch in r"\.^$|(){}+-~#&" else ch)
    return "".join(out)


def matches_any_glob(path: Column, patterns) -> Column:
    """Whether the whole path or the file name matches one of the globs.

    One regular expression for all patterns: the path may be a long expression,
    and a filter would repeat it for every test.
    """
    names = "|".join(glob_regex(p, "[^/]*", "[^/]") for p in patterns if "/" not in p)
    whole = "|".join(glob_regex(p) for p in patterns if re.search(r"[*?\[/]", p))
    sides = ([f"(?:.*/)?(?:{names})"] if names else []) + ([whole] if whole else [])
    return path.rlike(f"(?s)^(?:{'|'.join(sides)})$") if sides else F.lit(False)


def category(path: Column) -> Column:
    """Category of a file, or null when its type is not supported."""
    by_name = literal_map(fixed.spread(fixed.SPECIAL_NAMES))
    by_suffix = literal_map(fixed.spread(fixed.CATEGORY_SUFFIXES))
    return F.coalesce(by_name[file_name(path)], by_suffix[suffix(path)])


def icon(path: Column, category: Column | None = None) -> Column:
    """Icon by exact name, else by suffix, else by category, else the default.

    The icon table is keyed by names and suffixes alike, so a file whose whole
    name is a listed suffix (``.py``) also finds its icon by name.
    """
    suffixes = fixed.SUFFIX_ICONS
    levels = [
        literal_map({**suffixes, **fixed.NAME_ICONS})[file_name(path)],
        literal_map(suffixes)[suffix(path)],
    ]
    if category is not None:
        levels.append(literal_map(fixed.CATEGORY_ICONS)[category])
    return F.coalesce(*levels, F.lit(fixed.DEFAULT_ICON))


def icon_name(icon: Column) -> Column:
    return F.coalesce(literal_map(fixed.ICON_NAMES)[icon], F.lit(fixed.DEFAULT_ICON_NAME))


def category_description(category: Column) -> Column:
    return F.coalesce(literal_map(fixed.CATEGORY_DESCRIPTIONS)[category], category)
