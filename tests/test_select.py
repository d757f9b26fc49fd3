import pytest

from bindery.functions import naming
from bindery.operators import select
from bindery.operators.select import Wanted
from pyspark.sql import functions as F

FILES = [
    ("p", "deck/start.py", "python", "limit = 3\nTODO: raise it"),
    ("p", "deck/tools.py", "python", "pi = 3.14"),
    ("p", "README.md", "config_docs", "Notes on sailing\nfixme"),
    ("p", "docs/charts.md/index.md", "config_docs", "How to reef"),
    ("q", "start.py", "python", "todo\nnext"),
    ("q", "lib/README.md", "config_docs", "HACK"),
]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(*f, len(f[3].split("\n")), len(f[3])) for f in FILES]
    schema = "repo string, rel_path string, category string, content string, line_count int, size_bytes int"
    return spark.createDataFrame(rows, schema).withColumn("sha256", F.sha2("content", 256))


def chosen(df, repo="p"):
    return sorted(r["rel_path"] for r in df.where(F.col("repo") == repo).collect())


def all_paths(repo="p"):
    return sorted(f[1] for f in FILES if f[0] == repo)


@pytest.mark.parametrize(
    "typed, want, missing",
    [
        (["deck/start.py"], ["deck/start.py"], []),
        (["deck"], ["deck/start.py", "deck/tools.py"], []),
        (["deck/", "deck", " "], ["deck/start.py", "deck/tools.py"], []),
        (["start.py"], ["deck/start.py"], []),
        (["nonexistent"], [], ["nonexistent"]),
        (["deck", "gone.py"], ["deck/start.py", "deck/tools.py"], ["gone.py"]),
        (["/base/p/README.md"], ["README.md"], []),
        (["/base/p/./deck/../README.md"], ["README.md"], []),
        (["/base/q/start.py"], [], ["/base/q/start.py"]),
        (["./deck/start.py"], ["deck/start.py"], []),
        (["./deck"], [], ["./deck"]),
        (["."], [], ["."]),
        (["docs/charts.md"], ["docs/charts.md/index.md"], []),
        (["charts.md"], [], ["charts.md"]),
        (["x/start.py"], [], ["x/start.py"]),
    ],
)
def test_typed_paths(files, typed, want, missing):
    assert chosen(select.by_path(files, typed, "/base")) == want
    rows = select.missing_paths(files, typed, "/base").where("repo = 'p'").collect()
    assert sorted(r["input"] for r in rows) == missing


def test_only_blanks_select_everything(files):
    assert chosen(select.by_path(files, ["", "  "])) == all_paths()
    assert chosen(select.by_path(files, [])) == all_paths()


@pytest.mark.parametrize(
    "typed, want",
    [
        ("start.py", ["deck/start.py"]),
        ("start.py, tools.py", ["deck/start.py", "deck/tools.py"]),
        ("start.py;tools.py  README.md", ["README.md", "deck/start.py", "deck/tools.py"]),
        ("deck", ["deck/start.py", "deck/tools.py"]),
        ("docs/charts.md", ["docs/charts.md/index.md"]),
        ("charts.md/index.md", ["docs/charts.md/index.md"]),
        ("start", ["deck/start.py"]),
        (".md", ["README.md", "docs/charts.md/index.md"]),
        ("deckstart", ["deck/start.py"]),
        ("deck\\to", ["deck/tools.py"]),
        ("/base/p/README.md", ["README.md"]),
        ("zzz", []),
    ],
)
def test_loosely_typed_paths(files, typed, want):
    rows = select.smart_paths(files, typed, "/base").where("repo = 'p'").collect()
    assert sorted({r["rel_path"] for r in rows}) == want
    assert chosen(select.by_smart_path(files, typed, "/base")) == want


def test_each_repository_has_its_own_best_tier(files):
    rows = {(r["repo"], r["rel_path"], r["tier"]) for r in select.smart_paths(files, "start.py").collect()}
    assert rows == {("p", "deck/start.py", 2), ("q", "start.py", 1)}


def test_keywords(files):
    assert chosen(select.by_keyword(files, ["TODO"])) == ["deck/start.py"]
    assert chosen(select.by_keyword(files, ["3\ntodo"])) == ["deck/start.py"]
    assert chosen(select.by_keyword(files, [""])) == all_paths()
    assert chosen(select.by_keyword(files, ["nothing"])) == []
    found = {(r["repo"], r["keyword"], r["files"]) for r in select.matched_keywords(files, ["Todo", "HACK", "x9"]).collect()}
    assert found == {("p", "todo", 1), ("q", "todo", 1), ("q", "hack", 1)}


def test_names_ignore_case(files):
    assert chosen(select.by_name(files, ["readme", "TOOL"])) == ["README.md", "deck/tools.py"]


def run(files, wanted, repo="p"):
    made = select.select_files(files, wanted, "/base")
    meta = made.metadata.where(F.col("repo") == repo).collect()
    assert len(meta) == 1
    paths = sorted(r["path"] for r in made.paths.where(F.col("repo") == repo).collect())
    return chosen(made.files, repo), meta[0].asDict(), paths


def test_modes(files):
    got, meta, paths = run(files, Wanted())
    assert got == all_paths() and meta["selection_mode"] == "all" and paths == []

    got, meta, _ = run(files, Wanted(mode="category", categories=["py", "nonsense"]))
    assert got == ["deck/start.py", "deck/tools.py"] and meta["selected_categories"] == ["python"]
    assert run(files, Wanted(mode="category"))[0] == []

    got, meta, paths = run(files, Wanted(mode="path", paths=["deck, gone"]))
    assert got == paths == ["deck/start.py", "deck/tools.py"] and meta["missing_paths"] == ["gone"]
    assert run(files, Wanted(mode="path", paths=["gone"]))[0] == []

    wanted = Wanted(mode="mixed", categories=["docs"], paths=["md"], names=["READ"])
    got, meta, paths = run(files, wanted)
    assert got == ["README.md"] and meta["name_filters"] == ["READ"]
    assert paths == ["README.md", "docs/charts.md/index.md"]

    got, meta, paths = run(files, Wanted(mode="keyword", keywords=["todo", "FIXME", "zz"]))
    assert got == paths == ["README.md", "deck/start.py"]
    assert meta["name_filters"] == ["fixme", "todo"]

    wanted = Wanted(mode="non_interactive", categories=["py"], paths=["deck/", "README.md"])
    got, meta, paths = run(files, wanted)
    assert got == ["deck/start.py", "deck/tools.py"]
    assert meta["missing_paths"] == ["README.md"] and paths == ["README.md", "deck"]


def test_a_single_loose_path(files):
    loose = Wanted(mode="non_interactive", paths=["tools, READ"], loose=True)
    assert run(files, loose)[0] == ["README.md", "deck/tools.py"]
    # Means nothing as words, but something as a path.
    loose = Wanted(mode="non_interactive", paths=["./deck/start.py"], loose=True)
    assert run(files, loose)[0] == ["deck/start.py"]


def test_may_match_keeps_all_chosen_rows(files):
    for wanted in (
        Wanted(mode="category", categories=["py"]),
        Wanted(mode="path", paths=["deck"]),
        Wanted(mode="mixed", categories=["docs"], paths=["md"], names=["READ"]),
        Wanted(mode="non_interactive", categories=["py"], paths=["deck/"]),
    ):
        kept = chosen(files.where(select.may_match(wanted, "/base")))
        assert set(run(files, wanted)[0]) <= set(kept) < set(all_paths())


def test_unknown_categories_raise(files):
    with pytest.raises(ValueError, match="Unsupported categories requested: rust,  "):
        select.select_files(files, Wanted(mode="non_interactive", categories=["py", "rust", " "]))
    with pytest.raises(ValueError):
        select.select_files(files, Wanted(mode="other"))


def test_typed_words(evaluate):
    v = F.col("v")
    assert evaluate(["a, b, c,", "", " , ", "x"], naming.split_commas(v)) == [["a", "b", "c"], [], [], ["x"]]
    assert evaluate(["a,b; c\td\ne", " "], naming.split_words(v)) == [["a", "b", "c", "d", "e"], []]
    words = F.split(v, "[|]")
    assert evaluate([" PY |ts|tsx|nope||Python"], naming.categories_of(words)) == [["python", "typescript"]]
    assert evaluate(["py|nope| |docs"], naming.unknown_categories(words)) == [["nope", " "]]
    assert naming.known_categories(["Docs", "config", "config_docs", "x"]) == ["config_docs"]


def test_names_and_stamps(evaluate):
    v, stamp = F.col("v"), F.lit("20260102T030405Z")
    assert evaluate(["my app"], naming.bundle_name(v, F.lit(7), stamp)) == ["my_app_bundle_007_20260102T030405Z.txt"]
    assert evaluate(["a"], naming.bundle_name(v, F.lit(1234), stamp)) == ["a_bundle_1234_20260102T030405Z.txt"]
    assert evaluate(["", "a b"], naming.output_dir_name(v, stamp)) == [
        "exported_sources_project_20260102T030405Z", "exported_sources_a_b_20260102T030405Z"]
    names = ["x_20260328T120000Z", "x_20260328T12000Z", "20260328T120000Z", "x", "a_20260328T120000Z_b"]
    assert evaluate(names, naming.stamp_of_dir(v, F.lit("now"))) == [
        "20260328T120000Z", "now", "20260328T120000Z", "now", "now"]
    assert len(naming.stamp_now()) == 16
