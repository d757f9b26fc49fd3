"""Listing by rounds, URIs, and files read by byte ranges."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from bindery.functions import fixed
from bindery.plans import export as plans
from bindery.sources import trees
from bindery.sources.storage import Storages, open_storage, root_of

STAMP = "20260101T000000Z"


@pytest.fixture(scope="module")
def forest(tmp_path_factory):
    """Three trees; one has a third of all directories and is deep."""
    base = tmp_path_factory.mktemp("forest")
    for i in range(60):
        folder = base / "hot" / f"d{i % 6}" / f"e{i // 6}" / "f"
        folder.mkdir(parents=True)
        (folder / "a.py").write_text(f"{i}\n")
    for tree in ("one two", "100%#?x"):
        for i in range(50):
            (base / tree / f"d{i}").mkdir(parents=True)
            (base / tree / f"d{i}" / "b.py").write_text(f"{i}\n")
    (base / "loose.py").write_text("not in a tree")
    return base


def want(base):
    return {(p.relative_to(base).parts[0], "/".join(p.relative_to(base).parts[1:])) for p in base.rglob("*.py") if p.parent != base}


def test_large_trees_are_listed_by_many_tasks(spark, forest):
    levels = trees.list_levels(spark, str(forest), many=True, splits=8, share=12)
    rows = [r for level in levels for r in level.collect()]
    files = [(r["repo"], r["rel_path"]) for r in rows if r["kind"] == "file"]
    assert set(files) == want(forest) and len(files) == len(set(files))
    hot = {(i, r["task"]) for i, level in enumerate(levels) for r in level.where("repo = 'hot' and kind = 'file'").collect()}
    assert len({task for _, task in hot}) >= 4 and len(levels) > 2
    wide = trees.list_tree(spark, str(forest), many=True)
    assert {(r["repo"], r["rel_path"]) for r in wide.collect()} == want(forest)


def test_directories_that_cannot_be_listed_are_counted(spark, forest, tmp_path, monkeypatch):
    frontier = spark.createDataFrame([(str(forest / "hot"), str(forest / "hot" / "gone")), (str(forest), str(forest / "hot" / "d0"))], "root string, path string")
    rows = trees.open_level(frontier, str(forest)).collect()
    assert [(r["repo"], r["rel_path"], r["kind"]) for r in rows if r["kind"] != "file"] == [("hot", "gone", fixed.REASON_UNLISTED)]
    missing = trees.scan_tree(spark, str(tmp_path / "void"))
    assert [tuple(r) for r in missing.skips.collect()] == [("void", fixed.REASON_UNLISTED, 1)]
    assert missing.files.count() == 0


def test_uris_keep_scheme_host_and_options():
    for path, plain, uri in [
        ("/data/x", "/data/x/a b", "/data/x/a b"),
        ("file:///data/x", "/data/x/a b#", "file:///data/x/a%20b%23"),
        ("hdfs://host:8020/x?user=me", "/x/a", "hdfs://host:8020/x/a?user=me"),
        ("s3://bucket/k?region=eu-west-1", "bucket/k/a", "s3://bucket/k/a?region=eu-west-1"),
        ("s3://id:key@bucket/k", "bucket/k/a", "s3://id:key@bucket/k/a"),
    ]:
        assert root_of(path, "bucket/k" if "bucket" in path else "/x").uri(plain) == uri
    assert Storages().find("file:///data/a%20b%23")[1] == "/data/a b#"
    assert open_storage("file:///data/a%20b%23")[1] == "/data/a b#"


def test_trees_behind_uris_equal_those_behind_paths(spark, forest):
    def found(path):
        return sorted(tuple(r) for r in trees.scan_tree(spark, path, many=True).files.collect())

    assert found("file://" + str(forest)) == found(str(forest))


@pytest.fixture(scope="module")
def mixed(tmp_path_factory):
    """Files of all kinds of line ends, encodings and lengths."""
    base = tmp_path_factory.mktemp("mixed") / "tree"
    base.mkdir()
    rng = random.Random(1)
    ends = ["\n", "\r\n", "\r", "\x0b", "\x1e", "\x85", " ", "\n\n", ""]
    for i in range(40):
        text = "".join(rng.choice(["x", "é", "字", "\U0001f600", " " * 30]) * rng.randrange(9) + rng.choice(ends) for _ in range(rng.randrange(120)))
        data = text.encode() if i % 3 else text.encode("latin-1", "ignore")
        (base / f"f{i:02d}.py").write_bytes(data)
    (base / "late.py").write_bytes(b"ok\n" * 500 + b"\xff\n")
    (base / "ends.py").write_bytes(b"a\r\n" * 400)
    (base / "one.py").write_bytes(b"y" * 3000)
    (base / "zero.py").write_bytes(b"a\x00" + b"z\n" * 500)
    (base / "feeds.py").write_bytes(b"\n" * 700)
    return base


@pytest.fixture(scope="module")
def whole(spark, mixed):
    scanned = trees.scan_tree(spark, str(mixed))
    return sorted(tuple(r) for r in scanned.files.collect()), sorted(tuple(r) for r in scanned.meta.collect()), scanned.skips.collect()


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_ranges_give_what_whole_files_give(spark, mixed, whole, size):
    scanned = trees.scan_tree(spark, str(mixed), range_bytes=size)
    assert sorted(tuple(r) for r in scanned.files.collect()) == whole[0]
    assert sorted(tuple(r) for r in scanned.meta.collect()) == whole[1] and scanned.skips.collect() == whole[2]


def test_files_beyond_a_row_keep_their_facts(spark, mixed, whole, tmp_path):
    scanned = trees.scan_tree(spark, str(mixed), range_bytes=100, row_bytes=1000)
    assert sorted(tuple(r) for r in scanned.meta.collect()) == whole[1] and scanned.skips.collect() == whole[2]
    kept = {r["rel_path"] for r in scanned.files.collect()}
    assert kept == {row[1] for row in whole[0] if row[4] <= 1000} and "one.py" not in kept
    run = plans.export_tree(spark, str(mixed), str(tmp_path / "out"), scanned=scanned, stamp=STAMP, warn=300, skip=600)
    reasons = {(r["path"], r["reason"]) for r in run.skipped_items.collect()}
    assert ("one.py", fixed.REASON_TOO_LONG) in reasons and ("late.py", fixed.REASON_TOO_LONG) in reasons
    assert ("ends.py", fixed.REASON_LARGE_WARN) in reasons and ("feeds.py", fixed.REASON_LARGE_SKIP) in reasons


def test_lines_beyond_a_row_are_reported(spark, mixed, monkeypatch):
    listing = spark.createDataFrame([("t", "one.py", str(mixed / "one.py"), 3000), ("t", "gone.py", "/nowhere/x", 10)], "repo string, rel_path string, uri string, size_bytes bigint")
    rows = trees.read_ranges(trees.range_rows(listing, 1000)).orderBy("rel_path", "part").collect()
    assert [(r["rel_path"], r["read_ok"]) for r in rows] == [("gone.py", False)] + [("one.py", True)] * 3
    assert [len(r["content"]) for r in rows[1:]] == [3000, 0, 0]


def test_hashes_of_pieces_equal_those_of_texts():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "é", "\r", "\n", "\r\n", "\x85", " "]) for _ in range(rng.randrange(12)))
        data, state = text.encode(), trees.LineHash("utf-8")
        while data:
            n = rng.randrange(1, 4)
            state.add(data[:n])
            data = data[n:]
        assert state.hex() == hashlib.sha256("\n".join(text.splitlines()).encode()).hexdigest()
