import pytest
from pyspark.sql import functions as F

from bindery.functions import paths
from bindery.operators import report, tree
from bindery.session import settle


def drawn(spark, names, root="proj"):
    rows = [(root, n) for n in names]
    files = spark.createDataFrame(rows, "repo string, rel_path string")
    files = files.withColumn("category", paths.category(F.col("rel_path")))
    lines = tree.tree_lines(tree.tree_rows(settle(files)), slices=3).collect()
    lines = sorted(lines, key=lambda r: r["line_no"])
    assert [r["line_no"] for r in lines] == list(range(1, len(lines) + 1))
    text = [r["text"] for r in lines]
    end = text.index("")
    return text[:end], text[end:]


@pytest.mark.parametrize(
    "names, want",
    [
        (["b.py", "a.md"], ["proj/", "├── 📕 a.md", "└── 🐍 b.py"]),
        (
            ["src/c.py", "src/a.py", "src/b.py"],
            ["proj/", "└── src/ [🐍 a.py, 🐍 b.py, 🐍 c.py]"],
        ),
        (
            ["src/d.py", "src/c.py", "src/a.py", "src/b.py"],
            ["proj/", "└── src/", "    ├── 🐍 a.py", "    ├── 🐍 b.py", "    ├── 🐍 c.py", "    └── 🐍 d.py"],
        ),
        (
            # Only nested files: the directory above appears as the group.
            ["src/a/b/x.ts"],
            ["proj/", "└── src/", "    └── a/b/", "        └── 🔷 x.ts"],
        ),
        (
            # With files at the root no directory counts as the last.
            ["x.py", "a/1.py", "b/c/2.py", "b/0.py", "b/c/1.py", "b/d-e/3.py"],
            [
                "proj/",
                "├── 🐍 x.py",
                "├── a/ [🐍 1.py]",
                "├── b/",
                "│   ├── 🐍 0.py",
                "│   ├── c/",
                "│   │   ├── 🐍 1.py",
                "│   │   └── 🐍 2.py",
                "│   └── d-e/",
                "│       └── 🐍 3.py",
            ],
        ),
        (
            ["a/1.py", "b/x/1.py"],
            ["proj/", "├── a/ [🐍 1.py]", "└── b/", "    └── x/", "        └── 🐍 1.py"],
        ),
    ],
)
def test_drawing(spark, names, want):
    assert drawn(spark, names)[0] == want


def test_summary_of_types(spark):
    names = ["a.py", "b.py", "c.properties", "Podfile", "d.h", "e.json", "run.sh"]
    # Equal counts are in the order of the icons' code points.
    assert drawn(spark, names)[1] == [
        "",
        "─" * 40,
        "📊 File Summary:",
        "  🐍 Python       × 2",
        "  📋 JSON         × 2",
        "  ⚙️ Properties   × 1",
        "  📱 CocoaPods    × 1",
        "  🖥️ Shell        × 1",
        "  ───",
        "  📁  Total: 7 files",
    ]


def meta(spark, rows):
    schema = "repo string, rel_path string, category string, line_count int, size_bytes bigint"
    return spark.createDataFrame(rows, schema)


def test_frameworks_and_dependencies(spark):
    names = ["tsconfig.json", "x/App.tsx", "domain.py", "a/build.gradle", "setup.cfg", "a/mypackage.json"]
    files = meta(spark, [("r", n, "python", 1, 1) for n in names])
    got = [(r["place"], r["framework"]) for r in report.frameworks(files).orderBy("place").collect()]
    assert got == [(1, "typescript"), (2, "react"), (7, "fastapi"), (8, "spring")]
    deps = sorted(r["rel_path"] for r in report.dependency_files(files).collect())
    assert deps == ["a/build.gradle", "setup.cfg"]


def test_reading_order(spark):
    names = ["z/main.py", "app.py", "settings.py", "src/main.py", "src/b.py", "lib", "other/x.py", "core/package.json"]
    files = meta(spark, [("r", n, "python", 1, 1) for n in names])
    got = [r["rel_path"] for r in report.reading_order(files).orderBy("place").collect()]
    assert got == ["app.py", "src/main.py", "z/main.py", "core/package.json", "settings.py", "lib", "src/b.py"]


def test_overview(spark):
    rows = [("r", f"src/f{i:02d}.py", "python", 10, 100) for i in range(22)]
    rows += [("r", "README.md", "config_docs", 3, 30), ("r", "a_very_long_folder_name_indeed/x.md", "config_docs", 1, 1)]
    files = meta(spark, rows + [("s", "x.py", "python", 1, 1)])
    chosen = files.where("repo = 'r'")
    got = report.overview(files, chosen, "all", F.lit("m.json"), "now")
    lines = [r["text"] for r in sorted(got.collect(), key=lambda r: (r["section"], r["ord"]))]
    assert got.where("repo = 's'").count() == 0
    heavy, light = "=" * 60, "-" * 40
    assert lines == [
        heavy, "PROJECT OVERVIEW: r", heavy, "Generated: now", "Manifest: m.json", "",
        "📊 PROJECT STATISTICS", light, "  Total files in project: 24", "  Files exported: 24",
        "  Selection mode: all", "",
        "📁 FILES BY CATEGORY", light,
        "  python            22 files      220 lines  | Python backend / scripts",
        "  config_docs        2 files        4 lines  | Config / metadata / docs", "",
        "📂 TOP FOLDERS", light,
        "  src                    22 files      220 lines",
        "  .                       1 files        3 lines",
        "  a_very_long_folder_name_indeed    1 files        1 lines", "",
        "📖 SUGGESTED READING ORDER", light,
        *[f"  {i + 1:>3}. src/f{i:02d}.py" for i in range(20)],
        "  ... and 2 more", "",
        heavy, "END OF PROJECT OVERVIEW", heavy,
    ]


def test_categories_of_equal_size_keep_path_order(spark):
    rows = [("r", "b.md", "config_docs", 1, 1), ("r", "a.sh", "shell", 1, 1), ("r", "c.py", "python", 1, 1), ("r", "d.py", "python", 1, 1)]
    got = [r["category"] for r in report.category_table(meta(spark, rows)).orderBy("place").collect()]
    assert got == ["python", "shell", "config_docs"]
