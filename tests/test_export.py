import json
import os

import pytest

from bindery.operators import render
from bindery.operators.select import Wanted
from bindery.plans import export as plans
from bindery.sources import documents, trees

STAMP = "20260101T000000Z"
TREE = {
    "main.py": b"print(1)\n",
    "README.md": b"# hi\n\nx -----BEGIN PRIVATE KEY-----k-----END PRIVATE KEY----- x",
    "src/a.ts": b"a\nb\n",
    "src/b/c.py": b'SECRET_KEY="abc"\n' * 50,
    "src/__init__.py": b"",
    "src/_private.py": b"x = 1\n",
    "lat.py": b"caf\xe9\nx",
    "bom.py": b"\xef\xbb\xbfz = 1\r\ny = 2\r\n",
    "keep.html": b"<p>keep",
    ".eslintrc.json": b"{}\n",
    # left out
    ".gitignore": b"*.html\n!keep.html\nlogs/\n\xff\n",
    "x.html": b"<p>",
    "logs/l.py": b"1",
    ".env": b"A=1",
    "bin.py": b"a\x00b",
    "node_modules/z.js": b"z",
    "a/build": b"z",
    "weird.xyz": b"q",
    "yarn.lock": b"q",
}
SKIPPED = {
    ".gitignore": 2,
    "secret_like_file": 1,
    "binary": 1,
    "default_excluded_dir": 2,
    "unsupported_type": 2,
    "extra_excluded_pattern": 1,
}


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    base = tmp_path_factory.mktemp("trees")
    for name, content in TREE.items():
        path = base / "my proj" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    (base / "my proj" / "void").mkdir()
    os.symlink(base / "my proj" / "src", base / "my proj" / "linked")
    other = base / "other"
    other.mkdir()
    (other / "app.py").write_text("1\n")
    return base


def test_listing_keeps_hidden_and_empty_files(spark, source):
    for splits in (1, 3, 64):
        rows = trees.list_tree(spark, str(source / "my proj"), splits=splits).collect()
        assert {r["rel_path"]: r["size_bytes"] for r in rows} == {k: len(v) for k, v in TREE.items()}
        assert len(rows) == len(TREE)
    many = trees.list_tree(spark, str(source), many=True, splits=5).collect()
    assert {r["repo"] for r in many} == {"my proj", "other"}
    assert len(many) == len(TREE) + 1


def test_scan(spark, source):
    scanned = trees.scan_tree(spark, str(source / "my proj"))
    files = {r["rel_path"]: r for r in scanned.files.collect()}
    assert len(files) == 10
    assert files["lat.py"]["content"] == "café\nx" and files["lat.py"]["size_bytes"] == 6
    assert files["bom.py"]["content"] == "\ufeffz = 1\ny = 2\n" and files["bom.py"]["line_count"] == 2
    assert files["src/__init__.py"]["line_count"] == 0
    assert {r["reason"]: r["files"] for r in scanned.skips.collect()} == SKIPPED


def test_unreadable_files_are_counted(spark):
    listing = spark.createDataFrame(
        [("r", "gone.py", "/nowhere/gone.py", 1)], "repo string, rel_path string, uri string, size_bytes bigint"
    )
    row = trees.read_contents(listing).first()
    assert row["content"] is None and row["read_ok"] is False


def read_text(path):
    """A document, whether one file or a folder of parts."""
    if path.is_dir():
        return "".join(p.read_text() for p in sorted(path.iterdir()))
    return path.read_text()


def test_export_writes_consistent_documents(spark, source, tmp_path):
    out = tmp_path / "out"
    result = plans.export_tree(
        spark, str(source / "my proj"), str(out), max_lines=40, warn=30, skip=60, redacted=True,
        overview=True, stamp=STAMP, created="then",
    )
    folder = out / "my proj"
    names = sorted(p.name for p in folder.iterdir())
    bundles = [n for n in names if "_bundle_" in n]
    assert names == sorted(
        bundles + [f"my_proj_manifest_{STAMP}.json", f"my_proj_file_tree_{STAMP}.txt", "PROJECT_OVERVIEW.txt"]
    )
    run = result.result.first()
    assert (run["files_exported"], run["bundles_created"]) == (10, len(bundles))

    tree = (folder / f"my_proj_file_tree_{STAMP}.txt").read_text()
    assert tree.startswith("my proj/\n├── 📋 .eslintrc.json\n") and tree.endswith("📁  Total: 10 files")
    manifest = json.loads((folder / f"my_proj_manifest_{STAMP}.json").read_text())
    assert manifest["bundle_count"] == len(bundles)
    assert manifest["max_lines_per_bundle"] == 40
    assert manifest["selection"]["selection_mode"] == "all"
    assert manifest["selected_files"] == sorted(f["path"] for f in trees_files(spark, source))
    assert manifest["summary"]["skipped_counts"] == SKIPPED
    assert manifest["summary"]["selected_file_count"] == 10
    # 50 lines warn, and nothing is too long for a bundle.
    assert manifest["skipped_during_pack"] == [
        {"path": "src/b/c.py", "reason": "large_file_warning", "line_count": 50, "threshold": 30}
    ]
    assert manifest["summary"]["skipped_during_pack_count"] == 1

    seen = 0
    places = {
        (r["bundle"], r["path"], r["chunk_index"]): (r["physical_start_line"], r["physical_end_line"])
        for r in spark.read.parquet(result.tables["manifest_files"]).collect()
    }
    for i, bundle in enumerate(manifest["bundles"], 1):
        assert bundle["bundle"] == f"my_proj_bundle_{i:03d}_{STAMP}.txt"
        text = (folder / bundle["bundle"]).read_text()
        lines = text.split("\n")
        assert "<REDACTED>" in text or "SECRET_KEY" not in text
        if i == 1:
            head = bundle["files"][0]
            assert head["category"] == "filetree" and head["size_bytes"] == len(tree)
            assert text.startswith(render.TREE_HEAD + tree + render.TREE_FOOT)
            assert head["bundle_end_line"] == (render.TREE_HEAD + tree + render.TREE_FOOT).count("\n")
        used = 0
        for row in bundle["files"]:
            assert row["bundle_end_line"] - row["bundle_start_line"] + 1 == row["bundle_line_count"]
            start, end = places[(bundle["bundle"], row["path"], row["chunk_index"])]
            if row["category"] == "filetree":
                continue
            seen += 1
            # Redaction turned the key block in the README into three lines.
            used += row["bundle_line_count"] - 2 * (row["path"] == "README.md")
            assert row["bundle_line_count"] - row["file_line_count"] == 9 + 2 * (row["path"] == "README.md")
            assert lines[start] == f"===== BEGIN FILE: {row['path']} ====="
            assert lines[end - 2].startswith(f"===== END FILE: {row['path']} (chunk {row['chunk_index']}/")
        assert used <= 40
    assert seen == run["chunks"]
    overview = (folder / "PROJECT_OVERVIEW.txt").read_text()
    assert overview.startswith("=" * 60 + "\nPROJECT OVERVIEW: my proj\n") and overview.endswith("=" * 60)


def trees_files(spark, source):
    return [{"path": r["rel_path"]} for r in trees.scan_tree(spark, str(source / "my proj")).files.collect()]


def test_export_of_a_selection_from_many_trees(spark, source, tmp_path):
    out = tmp_path / "out"
    wanted = Wanted(mode="keyword", keywords=["SECRET", "1"])
    result = plans.export_tree(spark, str(source), str(out), many=True, wanted=wanted, stamp=STAMP)
    assert {r["repo"]: r["files_exported"] for r in result.result.collect()} == {"my proj": 4, "other": 1}
    manifest = json.loads((out / "other" / f"other_manifest_{STAMP}.json").read_text())
    assert manifest["selected_files"] == ["app.py"] and manifest["selection"]["name_filters"] == ["1"]
    assert manifest["selection"]["selected_paths"] == ["app.py"]
    assert manifest["summary"]["skipped_counts"] == {}
    assert manifest["project_root"] == str(source / "other")
    text = (out / "my proj" / f"my_proj_bundle_001_{STAMP}.txt").read_text()
    assert text.count("BEGIN FILE") == 4


def test_documents_of_any_length_are_single_files(spark, tmp_path):
    rows = [("big", "a.txt", i, f"line {i}\n") for i in range(2000)]
    rows += [(f"r{i}", "a.txt", 0, "x") for i in range(30)] + [("big", "b.txt", 0, "é")]
    df = spark.createDataFrame(rows, "repo string, doc string, n int, text string").repartition(7)
    documents.write_documents(df, str(tmp_path), ["n"], parts=6)
    assert (tmp_path / "big" / "a.txt").read_text() == "".join(r[3] for r in rows[:2000])
    assert (tmp_path / "big" / "b.txt").read_text() == "é"
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(["big"] + [f"r{i}" for i in range(30)])
    assert all([p.name for p in (tmp_path / f"r{i}").iterdir()] == ["a.txt"] for i in range(30))


def test_range_partitioned_documents_that_fit_one_task_are_one_file(spark, tmp_path):
    rows = [(f"r{i:03d}", "a.txt", j, f"{j}\n") for i in range(50) for j in range(7)]
    df = spark.createDataFrame(rows, "repo string, doc string, n int, text string")
    placed = df.repartitionByRange(5, "repo", "doc", "n").sortWithinPartitions("repo", "doc", "n")
    documents.write_sorted(placed, str(tmp_path))
    assert {p.name: read_text(p / "a.txt") for p in tmp_path.iterdir()} == {
        f"r{i:03d}": "".join(f"{j}\n" for j in range(7)) for i in range(50)
    }


def test_long_trees_open_the_first_bundle(spark, tmp_path):
    rows = [("big", f"d{i % 90:02d}/e{i % 7}/f{i:05d}.py", b"x = 1\n") for i in range(1500)] + [("few", "a.py", b"1\n")]
    listing = spark.createDataFrame(rows, "repo string, rel_path string, content binary")
    plans.export_listing(spark, listing, str(tmp_path), stamp=STAMP)
    for repo in ("big", "few"):
        tree = (tmp_path / repo / f"{repo}_file_tree_{STAMP}.txt").read_text()
        text = (tmp_path / repo / f"{repo}_bundle_001_{STAMP}.txt").read_text()
        assert text.startswith(render.TREE_HEAD + tree + render.TREE_FOOT + render.RULE)
        json.loads((tmp_path / repo / f"{repo}_manifest_{STAMP}.json").read_text())
    assert tree.count("\n") >= 1


def test_repeated_inputs_make_a_valid_manifest(spark, tmp_path):
    listing = spark.createDataFrame([("r", "src/a.py", b"1\n"), ("r", "b.py", b"2\n")], "repo string, rel_path string, content binary")
    wanted = Wanted(mode="non_interactive", paths=["src/", "src", "/base/r/src", " "])
    plans.export_listing(spark, listing, str(tmp_path), stamp=STAMP, wanted=wanted, base="/base")
    manifest = json.loads((tmp_path / "r" / f"r_manifest_{STAMP}.json").read_text())
    assert manifest["selection"]["selected_paths"] == ["src"] and manifest["selected_files"] == ["src/a.py"]


def test_listings_follow_their_root_ignore_files(spark, tmp_path):
    rows = [("r", ".gitignore", b"*.md\n"), ("r", "a.md", b"1\n"), ("r", "b.py", b"2\n"), ("s", "a.md", b"3\n")]
    listing = spark.createDataFrame(rows, "repo string, rel_path string, content binary")
    result = plans.export_listing(spark, listing, str(tmp_path), stamp=STAMP)
    kept = {(r["repo"], r["rel_path"]) for r in spark.read.parquet(result.tables["files"]).collect()}
    assert ("r", "a.md") not in kept and {("r", "b.py"), ("s", "a.md")} <= kept


def test_tree_only(spark, source, tmp_path):
    plans.tree_only(spark, str(source / "other"), str(tmp_path / "out"), stamp=STAMP)
    folder = tmp_path / "out" / "other"
    assert [p.name for p in folder.iterdir()] == [f"other_file_tree_{STAMP}.txt"]


def test_bad_calls(spark, source, tmp_path):
    with pytest.raises(ValueError, match="inside"):
        plans.export_tree(spark, str(source), str(source / "out"))
    scanned = trees.Scanned(None, None, None, None)
    with pytest.raises(ValueError, match="max_lines"):
        plans.export(spark, scanned, str(tmp_path), max_lines=0)
    with pytest.raises(ValueError, match="bundles"):
        plans.export(spark, scanned, str(tmp_path), bundles="heap")


def test_one_scan_serves_several_exports_and_bundles_can_be_rows(spark, source, tmp_path):
    path = str(source / "other")
    scanned = trees.scan_tree(spark, path)
    plans.export_tree(spark, path, str(tmp_path / "one"), scanned=scanned, stamp=STAMP)
    run = plans.export_tree(spark, path, str(tmp_path / "two"), scanned=scanned, stamp=STAMP, bundles="table")
    row = spark.read.parquet(run.tables["bundle_texts"]).first()
    assert row["text"] == (tmp_path / "one" / "other" / row["bundle"]).read_text()
    assert not (tmp_path / "two" / "other" / row["bundle"]).exists()


def test_export_of_a_table(spark, tmp_path):
    listing = spark.createDataFrame(
        [("a", "x.py", "1\n2"), ("a", "y.md", ""), ("b", "z.bin", "q"), ("a", "n.py", "\x00")],
        "repo string, rel_path string, content string",
    )
    result = plans.export_listing(spark, listing, str(tmp_path), stamp=STAMP, include_tree=False)
    assert [(r["repo"], r["files_exported"], r["bundles_created"]) for r in result.result.collect()] == [("a", 2, 1)]
    skips = spark.read.parquet(result.tables["skip_counts"]).orderBy("repo").collect()
    assert [(r["repo"], r["reason"]) for r in skips] == [("a", "binary"), ("b", "unsupported_type")]
    manifest = json.loads((tmp_path / "a" / f"a_manifest_{STAMP}.json").read_text())
    assert [f["path"] for f in manifest["bundles"][0]["files"]] == ["x.py"]
