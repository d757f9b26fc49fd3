"""Long lists of inputs and keywords give what single comparisons give."""

import random

import pytest
from pyspark.sql import functions as F

from bindery.functions import finder
from bindery.operators import scan, select
from bindery.plans import catalog
from bindery.session import settle
from bindery.sources import tables

SMALL = "/root/testdata/sf0.001"


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["select_paths", "missing_paths", "smart_paths", "mode_path_missing", "select_keywords", "matched_keywords"])
def test_queries_give_the_same_both_ways(spark, monkeypatch, name):
    want = found(catalog.QUERIES[name](spark, SMALL))
    monkeypatch.setattr(finder, "MANY", 0)
    assert found(catalog.QUERIES[name](spark, SMALL)) == want and want


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(5)
    parts = ["a", "b", "src", "lib", "é", "x.py", "main.py", "long name", "a\\b", "r1"]
    rows = {(rng.choice(["r1", "r2"]), "/".join(rng.choices(parts, k=rng.randrange(1, 5)))) for _ in range(120)}
    return spark.createDataFrame(sorted(rows), "repo string, rel_path string"), parts


def test_many_typed_inputs_are_rated_like_few(spark, forest, monkeypatch):
    files, parts = forest
    rng = random.Random(6)
    pieces = parts + ["/base/r1", "/base/r2/src", "./a", "", "..", "ib", "rc", "srclib", "."]
    typed = [rng.choice(["", " ", "/"]) + "/".join(rng.choices(pieces, k=rng.randrange(1, 4))) + rng.choice(["", "/", " "]) for _ in range(150)]
    words = ",".join(t.replace(" ", "") for t in typed)
    many = [found(select.by_path(files, typed, "/base")), found(select.missing_paths(files, typed, "/base")), found(select.smart_paths(files, words, "/base"))]
    monkeypatch.setattr(finder, "MANY", 10**6)
    few = [found(select.by_path(files, typed, "/base")), found(select.missing_paths(files, typed, "/base")), found(select.smart_paths(files, words, "/base"))]
    assert many == few and all(few)


def test_ten_thousand_inputs(spark):
    kept = settle(scan.kept_paths(tables.documents(spark, SMALL)))
    paths = sorted(r["rel_path"] for r in kept.collect())
    typed = [f"gone/{i}.py" for i in range(10_000)] + paths[::7]
    got = select.by_path(kept, typed)
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 50_000
    assert sorted(r["rel_path"] for r in got.collect()) == [p for p in paths if p in set(paths[::7])]


def test_five_thousand_keywords(spark, monkeypatch):
    files = settle(scan.files(tables.documents(spark, SMALL)))
    texts = [r["content"].lower() for r in files.select("content").collect()]
    rng = random.Random(7)
    keywords = ["The", "he", "e t", "zzzz"] + [f"none{i}" for i in range(4000)]
    for _ in range(1000):
        text = rng.choice([t for t in texts if len(t) > 40])
        at = rng.randrange(len(text) - 8)
        keywords.append(text[at : at + rng.randrange(1, 8)])
    keywords = [k for k in keywords if "\r" not in k]
    got = {(r["keyword"]): r["n"] for r in select.matched_keywords(files, keywords).groupBy("keyword").agg(F.sum("files").alias("n")).collect()}
    bodies = [t.removesuffix("\n") for t in texts]
    want = {k: n for k in {k.lower() for k in keywords} if (n := sum(k in b for b in bodies))}
    assert got == want
    assert select.by_keyword(files, [f"none{i}" for i in range(100)]).count() == 0
