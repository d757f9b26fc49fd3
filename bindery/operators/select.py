"""Selecting files by category, path, name and keyword.

A user types a handful of inputs, so they are literals of the plan.  Each file
rates the inputs that fit it with a tier; one aggregate finds the best tier per
repository and input; a file stays if it fits some input at that input's best
tier.  Only fitting pairs ever become rows, and only to be aggregated; no set
union is needed because each file is judged once.  Long lists of inputs or keywords are no literals:
an automaton finds those that a path or a text holds (:mod:`bindery.functions.finder`), and only
these are rated.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions import finder, naming, paths, text

# Names of the selection modes.
MODES = ["all", "category", "path", "mixed", "keyword", "non_interactive"]


@dataclass
class Selection:
    """Chosen files, one describing row per repository, and the selected paths.

    Selected paths may be as many as files, so they are rows, not an array.
    """

    files: DataFrame
    metadata: DataFrame
    paths: DataFrame


@dataclass
class Wanted:
    """What a user asked for; ``None`` means that no such condition was given."""

    categories: list[str] | None = None
    paths: list[str] | None = None
    names: list[str] | None = None
    keywords: list[str] | None = None
    mode: str = "all"
    loose: bool = False


def in_categories(files: DataFrame, categories) -> DataFrame:
    return files.where(F.col("category").isin(list(categories)))


def by_name(files: DataFrame, needles) -> DataFrame:
    """Files whose name contains one of the needles, in any case."""
    name = F.lower(paths.file_name(F.col("rel_path")))
    return files.where(paths.any_of(F.contains(name, F.lower(F.lit(n))) for n in needles))


def _has_keyword(keyword: str, lowered: Column) -> Column:
    return F.contains(lowered, F.lower(F.lit(keyword)))


def _lowered() -> Column:
    return F.lower(text.line_body(F.col("content")))


def by_keyword(files: DataFrame, keywords) -> DataFrame:
    """Files whose text contains one of the keywords, in any case."""
    if len(keywords) > finder.MANY:
        lowered = list(dict.fromkeys(k.lower() for k in keywords))
        return files.where(F.size(finder.found_texts(_lowered(), lowered)) > 0)
    hit = text.let(_lowered(), lambda low: paths.any_of(_has_keyword(k, low) for k in keywords))
    return files.where(hit)


def matched_keywords(files: DataFrame, keywords) -> DataFrame:
    """``(repo, keyword, files)`` for the keywords that occur, one pass over the texts."""
    lowered = list(dict.fromkeys(k.lower() for k in keywords))
    if len(lowered) > finder.MANY:
        found = files.select("repo", F.explode(finder.found_texts(_lowered(), lowered)).alias("keyword"))
        return found.groupBy("repo", "keyword").agg(F.count("*").alias("files"))
    counts = [F.count_if(F.col(f"_h{i}")).alias(f"_k{i}") for i, k in enumerate(lowered)]
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("keyword"), F.col(f"_k{i}").alias("files"))
            for i, k in enumerate(lowered)
        ]
    )
    flags = text.let(
        _lowered(),
        lambda low: F.struct(*[_has_keyword(k, low).alias(f"_h{i}") for i, k in enumerate(lowered)]),
    )
    return (
        files.select("repo", flags.alias("_flags"))
        .select("repo", "_flags.*")
        .groupBy("repo")
        .agg(*counts)
        .select("repo", F.inline(F.filter(rows, lambda r: r["files"] > 0)))
    )


# Inputs and tiers -----------------------------------------------------------


def clean_inputs(raw) -> list[str]:
    """Typed paths without blanks and repetitions, order kept."""
    return list(dict.fromkeys(r for r in raw if r.strip()))


def _plain_input(raw: str) -> str:
    value = raw.strip()
    return posixpath.normpath(value) if value.startswith("/") else value.rstrip("/")


def _path_tier(raw: Column, root: Column) -> Column:
    """0: the file or folder itself; 1: same file name, for inputs without a slash."""
    path = F.col("rel_path")
    typed = naming.path_input(raw["plain"], root)
    # "./src/a.py" names a file through its resolved location.
    exact = (
        (path == typed)
        | F.startswith(path, F.concat(typed, F.lit("/")))
        | (path == raw["resolved"])
    )
    return F.when(exact, 0).when(paths.file_name(path) == raw["name"], 1)


def _path_input(raw: str) -> dict[str, str | None]:
    value = raw.strip()
    bare = "/" not in raw and "\\" not in raw
    return {
        "input": raw,
        "plain": _plain_input(raw),
        "resolved": posixpath.normpath(value),
        "name": value if bare else None,
    }


def _word_tier(word: Column, root: Column) -> Column:
    """1: path; 2: name or path tail; 4: folder; 5: part of the path; 6: start
    of the path when slashes are ignored."""
    path = F.col("rel_path")
    below = naming.path_input(word["input"], root)
    typed = F.when(F.startswith(word["input"], F.lit("/")), below).otherwise(word["input"])
    slash = F.lit("/")

    return (
        F.when(path == typed, 1)
        .when(F.endswith(path, F.concat(slash, typed)), 2)
        .when(
            F.startswith(path, F.concat(typed, slash))
            | F.contains(path, F.concat(slash, typed, slash)),
            4,
        )
        .when(F.contains(path, typed), 5)
        .when(F.startswith(_flat(path), _flat(typed)), 6)
    )


def _flat(c: Column) -> Column:
    return F.translate(c, "/\\", "")


def _word_input(word: str) -> dict[str, str | None]:
    return {"input": word}


@dataclass(frozen=True)
class _Typed:
    """Typed inputs and the way to rate a path against one of them."""

    inputs: tuple[str, ...]
    fields: Callable[[str], dict[str, str | None]]
    tier: Callable[[Column, Column], Column]
    base: str

    def fits(self) -> Column:
        """Array of ``(input, tier)`` for the inputs that fit the row's path."""
        root = F.concat(F.lit(self.base.rstrip("/") + "/"), F.col("repo"))
        rated = F.transform(
            self._rows(root),
            lambda i: F.struct(i["input"].alias("input"), self.tier(i, root).alias("tier")),
        )
        return F.filter(rated, lambda f: f["tier"].isNotNull())

    def _rows(self, root: Column) -> Column:
        """Array of the inputs that may fit the row's path: all of a handful, else those the path holds."""
        rows = [self.fields(i) for i in self.inputs]
        if len(rows) <= finder.MANY:
            return F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in row.items()]) for row in rows])
        # Whatever the tier, the path or its absolute form holds the input or what is left of it below a
        # root; or the path without slashes starts with the input without slashes.
        texts = [(t, i) for i, row in enumerate(rows) for v in row.values() if v is not None for t in finder.tails(v.strip().rstrip("/"))]
        flat = [(t.replace("/", "").replace("\\", ""), i) for t, i in texts]
        kind = "struct<" + ", ".join(f"{n}: string" for n in rows[0]) + ">"
        path = F.concat(root, F.lit("/"), F.col("rel_path"))
        return finder.candidates(path, _flat(F.col("rel_path")), finder.labelled(texts), finder.labelled(flat), rows, kind)


def _as_paths(raw, base: str) -> _Typed:
    return _Typed(tuple(clean_inputs(raw)), _path_input, _path_tier, base)


def _as_words(raw: str, base: str) -> _Typed:
    return _Typed(tuple(words_of(raw)), _word_input, _word_tier, base)


def best_tiers(files: DataFrame, typed: _Typed) -> DataFrame:
    """``(repo, input, tier)``: the best tier of every input that fits something."""
    return (
        files.select("repo", F.inline(typed.fits()))
        .groupBy("repo", "input")
        .agg(F.min("tier").alias("tier"))
    )


def _best_map(files: DataFrame, typed: _Typed, out: str = "_best") -> DataFrame:
    """One row per repository with a map of at most one entry per input."""
    entries = F.collect_list(F.struct("input", "tier"))
    return best_tiers(files, typed).groupBy("repo").agg(F.map_from_entries(entries).alias(out))


def _first_tier(files: DataFrame, chosen: DataFrame, typed: _Typed) -> DataFrame:
    """Rows of ``chosen`` that fit an input at the best tier it has in ``files``.

    The map is small per repository; Spark broadcasts it when all of it is, and
    splits a large repository's side of the join otherwise.
    """
    if not typed.inputs:
        return chosen.where(F.lit(False))
    # A generator of one row, so that no Python call is copied into the join.
    once = F.inline(F.array(F.struct(typed.fits().alias("_fits"))))
    rated = chosen.select("*", once).where(F.size("_fits") > 0)
    return (
        rated.join(_best_map(files, typed), "repo")
        .where(F.exists("_fits", lambda f: f["tier"] == F.col("_best")[f["input"]]))
        .select(*chosen.columns)
    )


def _missing(files: DataFrame, typed: _Typed) -> DataFrame:
    """``(repo, input)`` for inputs that fit no file of a repository."""
    asked = F.explode(F.array(*map(F.lit, typed.inputs))).alias("input")
    wanted = files.select("repo").distinct().select("repo", asked)
    return wanted.join(best_tiers(files, typed), ["repo", "input"], "left_anti")


def by_path(files: DataFrame, raw, base: str = "") -> DataFrame:
    """Files at the typed paths; every file if nothing but blanks was typed."""
    typed = _as_paths(raw, base)
    return _first_tier(files, files, typed) if typed.inputs else files


def missing_paths(files: DataFrame, raw, base: str = "") -> DataFrame:
    return _missing(files, _as_paths(raw, base))


def words_of(raw: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.split(r"[,;\s]+", raw) if w))


def smart_paths(files: DataFrame, raw: str, base: str = "") -> DataFrame:
    """Paths a loosely typed text means: ``(repo, word, tier, rel_path)``."""
    typed = _as_words(raw, base)
    fits = files.select("repo", "rel_path", F.inline(typed.fits()))
    return fits.join(best_tiers(files, typed), ["repo", "input", "tier"]).select(
        "repo", F.col("input").alias("word"), "tier", "rel_path"
    )


def by_smart_path(files: DataFrame, raw: str, base: str = "") -> DataFrame:
    """Files a loosely typed text means; none if it means nothing."""
    return _first_tier(files, files, _as_words(raw, base))


def unmatched_words(files: DataFrame, raw: str, base: str = "") -> DataFrame:
    return _missing(files, _as_words(raw, base))


def top_parts_missing(files: DataFrame, raw: str, base: str = "") -> DataFrame:
    """Requested paths that are not the first part of a chosen path.

    The requested paths are the full paths the text means, so nearly all of them
    are reported; :func:`unmatched_words` is the useful report.
    """
    chosen = by_smart_path(files.select("repo", "rel_path"), raw, base)
    tops = chosen.select("repo", paths.top_part(F.col("rel_path")).alias("rel_path"))
    return chosen.join(tops.distinct(), ["repo", "rel_path"], "left_anti")


# Modes ----------------------------------------------------------------------


def by_loose_path(files: DataFrame, chosen: DataFrame, raw: str, base: str = "") -> DataFrame:
    """One typed value read loosely against ``files``, narrowed to ``chosen``.

    Where its words mean nothing in a repository, it counts as a plain path there.
    """
    words, plain = _as_words(raw, base), _as_paths([raw], base)
    rated = chosen.withColumn("_words", words.fits()).withColumn("_paths", plain.fits())
    rated = rated.where((F.size("_words") > 0) | (F.size("_paths") > 0))

    def fits(side: str) -> Column:
        return F.exists(side, lambda f: f["tier"] == F.col("_best" + side)[f["input"]])

    return (
        rated.join(_best_map(files, words, "_best_words"), "repo", "left")
        .join(_best_map(chosen, plain, "_best_paths"), "repo", "left")
        .where(F.when(F.col("_best_words").isNull(), fits("_paths")).otherwise(fits("_words")))
        .select(*chosen.columns)
    )


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _listed(rows: DataFrame | None, column: str, out: str, repos: DataFrame) -> DataFrame:
    """Adds the rows of each repository as a sorted array.

    Only used for rows that number at most one per typed input.
    """
    if rows is None:
        return repos.withColumn(out, _strings([]))
    gathered = rows.groupBy("repo").agg(F.sort_array(F.collect_list(column)).alias(out))
    return repos.join(gathered, "repo", "left").withColumn(out, F.coalesce(out, _strings([])))


def may_match(wanted: Wanted, base: str = "") -> Column:
    """A condition every chosen row meets, from the row alone.

    It keeps texts of other files out of shuffles before the exact choice joins.
    """
    keep = F.lit(True)
    mode = wanted.mode
    if wanted.categories is not None and mode in ("category", "mixed", "non_interactive"):
        categories = naming.known_categories(wanted.categories)
        if categories or mode == "category":
            keep = keep & F.col("category").isin(categories)
    words = words_of(" ".join(wanted.paths or []))
    if words and mode in ("path", "mixed"):
        keep = keep & (F.size(_as_words(" ".join(words), base).fits()) > 0)
    if wanted.names and mode == "mixed":
        name = F.lower(paths.file_name(F.col("rel_path")))
        keep = keep & paths.any_of(F.contains(name, F.lower(F.lit(n))) for n in wanted.names)
    return keep


def select_files(files: DataFrame, wanted: Wanted, base: str = "") -> Selection:
    """The files a mode chooses.

    ``all`` takes everything; ``category`` takes the named categories; ``path``
    reads one loosely typed text; ``mixed`` combines categories, such a text and
    name needles; ``keyword`` searches texts and looks at nothing else;
    ``non_interactive`` combines categories with typed paths (``loose`` reads a
    single one like a text).  A text that means no path selects nothing and is
    reported as missing.
    """
    mode = wanted.mode
    if mode not in MODES:
        raise ValueError(f"unknown selection mode: {mode}")
    chosen, missing, found, found_words = files, None, None, None
    categories, names, typed = [], [], []
    listing = files.select("repo", "rel_path")
    if mode == "category":
        categories = naming.known_categories(wanted.categories or [])
        chosen = in_categories(files, categories)
    elif mode in ("path", "mixed"):
        if mode == "mixed":
            categories = naming.known_categories(wanted.categories or [])
            if categories:
                chosen = in_categories(chosen, categories)
        raw = " ".join(wanted.paths or [])
        words = words_of(raw)
        if words:
            # The text is read against all files; categories narrow the outcome.
            chosen = _first_tier(listing, chosen, _as_words(raw, base))
            missing = unmatched_words(files, raw, base)
            found = by_smart_path(listing, raw, base)
        elif mode == "path":
            chosen = files.where(F.lit(False))
        names = list(wanted.names or []) if mode == "mixed" else []
        if names:
            chosen = by_name(chosen, names)
    elif mode == "keyword":
        keywords = list(wanted.keywords or [])
        chosen = by_keyword(files, keywords)
        found = chosen
        found_words = matched_keywords(files, keywords)
    elif mode == "non_interactive":
        if wanted.categories:
            categories = naming.require_categories(wanted.categories)
            chosen = in_categories(chosen, categories)
        inputs = clean_inputs(wanted.paths or [])
        if wanted.loose and len(inputs) == 1:
            found = by_smart_path(listing, inputs[0], base)
            chosen = by_loose_path(files, chosen, inputs[0], base)
        elif inputs:
            typed = [_plain_input(i) for i in inputs]
            missing = missing_paths(chosen, inputs, base)
            chosen = by_path(chosen, inputs, base)

    repos = files.select("repo").distinct()
    metadata = _listed(missing, "input", "missing_paths", repos)
    if found_words is None:
        metadata = metadata.withColumn("name_filters", _strings(names))
    else:
        metadata = _listed(found_words, "keyword", "name_filters", metadata)
    metadata = metadata.select(
        "repo",
        F.lit(mode).alias("selection_mode"),
        _strings(categories).alias("selected_categories"),
        "name_filters",
        "missing_paths",
    )
    if found is None:
        root = F.concat(F.lit(base.rstrip("/") + "/" if base else ""), "repo")
        inside = F.array_distinct(F.array(*[naming.path_input(F.lit(t), root) for t in typed]).cast("array<string>"))
        selected = repos.select("repo", F.explode(inside).alias("path"))
    else:
        selected = found.select("repo", F.col("rel_path").alias("path"))
    return Selection(chosen, metadata, selected)
