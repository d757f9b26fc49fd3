import time

import pytest
from pyspark.sql import functions as F

from bindery.functions import ignore
from bindery.operators import scan

# Ignore file, then paths it drops, then paths it keeps.
GOLDENS = [
    ("# comment\n\n   \n/\n!\n", "", "a # /"),
    ("*.log", "a.log x/b.log x.log/y", "a.logs log"),
    ("/root.txt", "root.txt root.txt/x", "a/root.txt"),
    ("temp/", "temp/output.txt a/temp/b", "temp a/temp"),
    ("temp", "temp temp/x a/temp a/temp/x", "temps atemp"),
    ("a/b", "a/b a/b/c", "x/a/b a/bc"),
    ("a/**/b", "a/b a/x/b a/x/y/b a/b/c", "a/xb b x/a/b"),
    ("**/foo", "foo a/foo a/b/foo foo/x", "afoo"),
    ("foo/**", "foo/a foo/a/b", "foo x/foo/a"),
    ("**", "a a/b", ""),
    ("**/", "a/b", "a"),
    ("*", "a a/b .x", ""),
    ("*.log\n!keep.log", "a.log", "keep.log x/keep.log"),
    ("!keep.log\n*.log", "keep.log", "b"),
    ("*.log\n!keep.log\n/keep.log", "keep.log", "x/keep.log"),
    ("\\#x", "#x d/#x", "x"),
    ("\\!x", "!x", "x"),
    ("f?o", "foo f-o a/fxo", "fo fooo f/o"),
    ("f[ab]o", "fao fbo", "fco f[ab]o"),
    ("f[!ab]o", "fco", "fao fbo f/o"),
    ("f[^ab]o", "fco", "fao"),
    ("[", "[", "a"),
    ("a.b+c(d)", "a.b+c(d)", "aXb+c(d)"),
    ("  spaced  ", "spaced", "a"),
    ("src/*/x", "src/a/x", "src/x src/a/b/x"),
    ("src/*.py", "src/a.py", "src/b/a.py a/src/a.py"),
    ("ünï", "ünï a/ünï", "uni"),
]


@pytest.mark.parametrize("text, dropped, kept", GOLDENS)
def test_goldens(evaluate, text, dropped, kept):
    subjects = dropped.split() + kept.split()
    regex = F.lit(ignore.file_regex(text))
    got = evaluate(subjects, ignore.is_ignored(F.col("v"), regex))
    assert got == [True] * len(dropped.split()) + [False] * len(kept.split())


def test_rules_of_several_trees_come_from_their_own_root_file(spark):
    listing = spark.createDataFrame(
        [
            ("one", ".gitignore", "*.py\n!b.py"),
            ("one", "a.py", ""),
            ("one", "b.py", ""),
            ("one", "sub/.gitignore", "*.md"),
            ("one", "sub/x.md", ""),
            ("two", "a.py", ""),
            ("three", ".gitignore", ""),
            ("three", "a.py", ""),
        ],
        "repo string, rel_path string, content string",
    )
    judged = scan.with_reason(listing, rules=scan.ignore_rules(listing))
    rows = {(r["repo"], r["rel_path"]): r["reason"] for r in judged.collect()}
    assert rows[("one", "a.py")] == ".gitignore"
    assert rows[("one", "b.py")] is None
    assert rows[("one", "sub/x.md")] is None
    assert rows[("two", "a.py")] is None and rows[("three", "a.py")] is None
    assert rows[("one", ".gitignore")] == "unsupported_type"
    lines = scan.ignore_lines(listing).orderBy("ordinal").collect()
    assert [(r["repo"], r["pattern"]) for r in lines] == [("one", "*.py"), ("one", "!b.py")]


def test_trees_that_alternate_cost_about_what_clustered_ones_do(spark):
    """Each tree has its own long ignore file; rows of all trees alternate or stand together."""
    trees, files = 40, 500
    rules = spark.createDataFrame(
        [(f"t{t:02}", ignore.file_regex("\n".join(f"x{t}_{i}/**/[ab]*.log" for i in range(400)) + f"\n*7.t{t:02}")) for t in range(trees)],
        "repo string, ignore_regex string",
    )
    number = F.col("id")
    cycled, together = F.pmod(number, F.lit(trees)), F.floor(number / files)

    def run(tree):
        repo = F.format_string("t%02d", tree)
        listing = spark.range(trees * files).repartition(2, F.floor(number / (trees * files / 2)))
        listing = listing.select(repo.alias("repo"), F.concat(number.cast("string"), F.lit("."), repo).alias("rel_path"))
        start = time.perf_counter()
        kept = scan.with_reason(listing, rules=rules).where(F.col("reason") == ".gitignore").collect()
        return time.perf_counter() - start, sorted((r["repo"], r["rel_path"]) for r in kept)

    run(together)
    clustered, first = run(together)
    alternating, second = run(cycled)
    assert len(first) == len(second) == trees * files // 10
    assert alternating < 3 * clustered + 1


def test_light_rows_are_sorted_by_tree_without_a_shuffle(spark):
    listing = spark.range(10).select(F.concat(F.lit("r"), F.col("id") % 2).alias("repo"), F.col("id").cast("string").alias("rel_path"))
    rules = spark.createDataFrame([("r1", ignore.file_regex("3"))], "repo string, ignore_regex string")
    light = scan.with_reason(listing, rules=F.broadcast(rules))
    full = scan.with_reason(listing.withColumn("content", F.lit("")), rules=F.broadcast(rules))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (light, full)]
    assert "Sort [repo" in plans[0] and "Sort [repo" not in plans[1]
    assert all("Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan for plan in plans)
    assert {(r["rel_path"], r["reason"]) for r in light.collect()} == {(r["rel_path"], r["reason"]) for r in full.collect()}
