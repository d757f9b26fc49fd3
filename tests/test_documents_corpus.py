"""Known totals of the documents corpus, counted beforehand with other tools."""

import pytest
from pyspark.sql import functions as F

from bindery.operators import chunk, pack, report, scan, select
from bindery.session import settle
from bindery.sources import tables

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def files(spark):
    return scan.files(tables.documents(spark, FOLDER))


@pytest.fixture(scope="module")
def meta(files):
    return settle(scan.meta(files))


def test_reasons(spark):
    rows = scan.skips(tables.documents(spark, FOLDER)).groupBy("reason").agg(F.sum("files")).collect()
    assert dict(map(tuple, rows)) == {
        "default_excluded_dir": 182,
        "default_excluded_prefix": 91,
        "extra_excluded_pattern": 56,
        "secret_like_file": 10,
        "unsupported_type": 52,
    }


def test_categories(meta):
    rows = report.by_category(meta).groupBy("category").agg(F.sum("files"), F.sum("lines"), F.sum("bytes"))
    assert {r[0]: tuple(r)[1:] for r in rows.collect()} == {
        "config_docs": (128, 1032, 282940),
        "flutter": (51, 562, 157946),
        "ios_apple": (53, 537, 144428),
        "java_kotlin": (58, 558, 157258),
        "javascript": (52, 467, 121674),
        "python": (105, 1050, 271924),
        "shell": (55, 511, 136356),
        "typescript": (55, 443, 114951),
        "web_ui": (52, 428, 139077),
    }


def test_folders_and_keywords(meta, files):
    one = meta.withColumn("repo", F.lit("all"))
    rows = report.top_folders(one, 9).orderBy("place").collect()
    assert [(r["folder"], r["files"], r["lines"]) for r in rows] == [
        ("src", 230, 2058), ("tests", 77, 803), ("app", 76, 609), ("docs", 75, 631), ("lib", 75, 682),
        (".", 73, 783), ("d119", 1, 5), ("d680", 1, 4), ("d867", 1, 13),
    ]
    found = select.matched_keywords(files, ["the", "license", "token"])
    counts = found.groupBy("keyword").agg(F.sum("files")).collect()
    assert dict(map(tuple, counts)) == {"the": 431, "license": 24, "token": 6}


@pytest.mark.parametrize(
    "limit, warn, skip, bands, chunks, bundles, most, fill",
    [
        (40, 30, 60, {"ok": 583, "warn": 22, "skip": 4}, 624, 352, 21, 40),
        (40, 50, 90, {"ok": 603, "warn": 6}, 636, 365, 22, 40),
        (120, 10**6, 10**6, {"ok": 609}, 609, 108, 7, 120),
    ],
)
def test_packing(meta, limit, warn, skip, bands, chunks, bundles, most, fill):
    rows = meta.groupBy(chunk.band(F.col("line_count"), warn, skip)).count().collect()
    assert dict(map(tuple, rows)) == bands
    packed = settle(pack.pack(chunk.chunk_ranges(meta, limit, skip), limit))
    assert packed.count() == chunks
    filled = packed.groupBy("repo", "bundle_id").agg(F.sum("need").alias("fill"))
    row = filled.agg(F.count("*"), F.max("bundle_id"), F.max("fill")).first()
    assert tuple(row) == (bundles, most, fill)
