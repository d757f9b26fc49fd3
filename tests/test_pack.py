import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindery.operators import chunk, ordered, pack, render
from bindery.session import settle


def brute(needs, limit):
    """Next-fit, one chunk at a time."""
    ids, bundle, fill = [], 1, 0
    for need in needs:
        if fill and fill + need > limit:
            bundle, fill = bundle + 1, 0
        ids.append(bundle)
        fill += need
    return ids


@pytest.mark.parametrize("seed", range(40))
def test_described_runs_chain_like_the_sequential_rule(seed):
    rng = random.Random(seed)
    limit = rng.choice([10, 23, 100, 1000])
    needs = np.array([rng.randint(1, limit) for _ in range(rng.randint(1, 300))])
    if seed % 3 == 0:
        needs = np.minimum(needs, rng.randint(1, 12))
    cuts = sorted(rng.sample(range(1, len(needs)), min(len(needs) - 1, rng.randint(0, 9)))) if len(needs) > 1 else []
    parts = np.split(needs, cuts)
    state, ids = pack.EMPTY, []
    for part in parts:
        table = pack.describe(part, limit, whole=True)
        got, after = pack.next_fit(state, part, limit)
        ids += list(got)
        described = pack.apply_description(state, table, limit)
        # An exactly closed bundle and a fresh one hold the next chunk alike.
        assert described == after
        state = after
    assert ids == brute(needs, limit)
    alone = pack.apply_description(pack.EMPTY, pack.describe(needs, limit, whole=False), limit)
    assert alone == pack.next_fit(pack.EMPTY, needs, limit)[1]


def test_descriptions_stay_small():
    needs = np.random.default_rng(1).integers(10, 400, 200_000)
    assert len(pack.describe(needs, 8000, whole=True)) <= 801


@pytest.mark.parametrize("low, high", [(10, 400), (8000, 8001), (1, 2)])
def test_long_slices_take_seconds(low, high):
    """No step of Python for each chunk, whether a bundle holds one of them or all that fit."""
    needs = np.random.default_rng(2).integers(low, high, 5_000_000)
    start = time.time()
    table = pack.describe(needs, 8000, whole=True)
    ids, after = pack.next_fit((3, 1000), needs, 8000)
    assert time.time() - start < 30
    assert pack.apply_description((3, 1000), table, 8000) == after and (np.diff(ids) >= 0).all()
    assert ids[-1] == after[0] + 1


def test_regions_are_looked_up_among_many_starts(spark):
    starts = [(f"r{i:04d}", "p", i % 7) for i in range(5000)]
    df = spark.createDataFrame([("r", "p", 0), ("r0000", "p", 0), ("r4321", "p", 1), ("r4321", "p", 2), ("z", "é", 3)], "repo string, rel_path string, chunk_index int")
    placed = df.withColumn("region", pack.region_of(starts))
    assert len(placed._jdf.queryExecution().toString()) < 20_000
    for row in placed.collect():
        assert row["region"] == sum(s <= (row["repo"], row["rel_path"], row["chunk_index"]) for s in starts)


def rows(n, seed=3):
    """One repository with most rows, and many small ones."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        repo = "hot" if rng.random() < 0.6 else f"r{rng.randint(0, 40):02d}"
        out.append((repo, f"f{i:06d}", "python", 1, 1, 1, 1, 1, rng.randint(1, 31)))
    return out


SCHEMA = (
    "repo string, rel_path string, category string, chunk_index int, chunk_count int, "
    "start_line int, end_line int, total_file_lines int, line_count int"
)


@pytest.mark.parametrize("slices", [1, 4, 64])
def test_packing_does_not_depend_on_slices(spark, slices):
    data = rows(4000)
    packed = pack.pack(spark.createDataFrame(data, SCHEMA).repartition(7), 40, slices=slices)
    got = {(r["repo"], r["rel_path"]): r["bundle_id"] for r in packed.collect()}
    want = {}
    for repo in {r[0] for r in data}:
        mine = sorted(r for r in data if r[0] == repo)
        for row, bundle in zip(mine, brute([r[8] + 9 for r in mine], 40)):
            want[(repo, row[1])] = bundle
    assert got == want


def test_regions_never_split_a_bundle(spark):
    packed = settle(pack.pack(spark.createDataFrame(rows(3000), SCHEMA), 40, slices=16))
    starts = pack.region_starts(packed)
    assert 8 <= len(starts) <= 16
    placed = pack.by_region(packed, starts).withColumn("task", F.spark_partition_id())
    spread = placed.groupBy("repo", "bundle_id").agg(F.countDistinct("region").alias("n"))
    assert spread.where("n > 1").count() == 0
    assert placed.where("task <> region").count() == 0
    # The hot repository is packed and placed by many tasks.
    assert placed.where("repo = 'hot'").select("region").distinct().count() >= 8


def test_numbering_does_not_depend_on_slices(spark):
    data = rows(2000)
    for slices in (1, 5, 32):
        numbered = ordered.number_rows(
            spark.createDataFrame(data, SCHEMA), ["rel_path"], "n", ["repo", "rel_path"], slices
        )
        got = {(r["repo"], r["rel_path"]): r["n"] for r in numbered.collect()}
        for repo in {r[0] for r in data}:
            mine = sorted(r[1] for r in data if r[0] == repo)
            assert [got[(repo, path)] for path in mine] == list(range(1, len(mine) + 1))


def test_no_rows_at_all(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pack.pack(empty, 40, slices=4).count() == 0


def test_exact_fill_one_more_and_oversized(spark):
    sizes = [11, 11, 12, 11, 32, 31, 1]
    data = [("r", f"f{i}", "python", 1, 1, 1, n, n, n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {r["rel_path"]: r["bundle_id"] for r in pack.pack(df, 40, slices=2).collect()}
    # 20 + 20 fills the first; 32 + 9 never fits; the rest opens bundles of its own.
    assert got == {"f0": 1, "f1": 1, "f2": 2, "f3": 3, "f5": 4, "f6": 5}
    over = pack.oversized(df, 40).collect()
    assert [(r["path"], r["reason"], r["line_count"], r["max_lines"]) for r in over] == [
        ("f4", "chunk_exceeds_max_lines", 32, 40)
    ]


def files_of(spark, counts):
    data = [("r", f"f{n:05d}", "python", n, "\n".join(f"l{i}" for i in range(n)) + "\n" * (n > 0)) for n in counts]
    return spark.createDataFrame(data, "repo string, rel_path string, category string, line_count int, content string")


def test_bands_are_inclusive(spark):
    files = files_of(spark, [0, 1, 1499, 1500, 2999, 3000])
    bands = {r[0]: r[1] for r in files.select("line_count", chunk.band(F.col("line_count"))).collect()}
    assert bands == {0: "empty", 1: "ok", 1499: "ok", 1500: "warn", 2999: "warn", 3000: "skip"}
    large = {(r["line_count"], r["reason"], r["threshold"]) for r in chunk.large_files(files).collect()}
    assert large == {
        (1500, "large_file_warning", 1500),
        (2999, "large_file_warning", 1500),
        (3000, "large_file_exceeds_skip_threshold", 3000),
    }
    kept = {r["total_file_lines"] for r in chunk.split_chunks(files).collect()}
    assert kept == {1, 1499, 1500, 2999}


@pytest.mark.parametrize("limit", [9, 10, 40, 3007, 3008])
def test_chunks_join_back_to_the_file(spark, limit):
    files = files_of(spark, [1, 2, 30, 31, 32, 62, 63, 2999])
    got = chunk.split_chunks(files, limit).collect()
    size = chunk.room(limit)
    for row in files.collect():
        mine = sorted((c for c in got if c["rel_path"] == row["rel_path"]), key=lambda c: c["chunk_index"])
        assert "\n".join(c["text"] for c in mine) == row["content"].rstrip("\n")
        assert [c["start_line"] for c in mine] == list(range(1, row["line_count"] + 1, size))
        assert all(c["line_count"] == c["text"].count("\n") + 1 <= size for c in mine)
        assert all(c["end_line"] - c["start_line"] + 1 == c["line_count"] for c in mine)
        assert {c["chunk_count"] for c in mine} == {len(mine)}
    ranges = chunk.chunk_ranges(files, limit).collect()
    assert sorted((r["rel_path"], r["chunk_index"], r["end_line"]) for r in ranges) == sorted(
        (c["rel_path"], c["chunk_index"], c["end_line"]) for c in got
    )


def test_a_rendered_block(spark):
    one = spark.createDataFrame(
        [("r", "test.py", "python", 1, 1, 1, 2, 2, 2, 'SECRET_KEY="mysecret123"\nx')], SCHEMA + ", text string"
    )
    rule = "=" * 60
    head = f"{rule}\n===== BEGIN FILE: test.py =====\n# category : python\n# chunk : 1/1\n# line_range : 1-2\n# total_lines : 2\n{rule}"
    foot = f"{rule}\n===== END FILE: test.py (chunk 1/1) =====\n{rule}"
    body = 'SECRET_KEY="mysecret123"\nx\n'
    hidden = 'SECRET_KEY="<REDACTED>"\nx\n'
    for layout, redacted, want in [
        ("exact", False, head + body + foot),
        ("exact", True, head + hidden + foot),
        ("clean", False, f"{head}\n{body}{foot}\n"),
    ]:
        got = one.select(render.block(layout, redacted)).first()[0]
        assert got == want
        extra = 1 if layout == "exact" else 0
        assert got.count("\n") + extra == 2 + render.overhead(layout)
