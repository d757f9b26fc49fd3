"""License bodies: templates of any length, edited and shifted quotations."""

import random

import pytest

from bindery.llm import licenses

COLUMNS = "doc_id long, text string"


def labels(spark, rows, **templates):
    found = licenses.scan(spark.createDataFrame(rows, COLUMNS), **templates).collect()
    return {r["doc_id"]: (r["labels"], r["score"]) for r in found}


def prose(count, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice("the of software and use in code for any to notice with copy this is by value runs".split()) for _ in range(count))


def test_every_body_is_found_inside_long_texts(spark):
    bodies = list(licenses.BODIES.items())
    rows = [(i, f"{prose(3000, i)} {body.upper()}, {prose(500, -i)}") for i, (_, body) in enumerate(bodies)]
    rows += [(100 + i, prose(4000, 100 + i)) for i in range(5)]
    found = labels(spark, rows)
    for i, (label, _) in enumerate(bodies):
        assert label in found[i][0] and found[i][1] == 1.0
        assert [other for other in found[i][0] if other.endswith("-body")] == [label]
    assert all(found[100 + i][0] == [] and found[100 + i][1] <= 0.5 for i in range(5))


def test_edited_shifted_and_partial_bodies(spark):
    words = licenses.BODIES["mit-body"].split()
    edited = [w if i % 20 else "changed" for i, w in enumerate(words)]
    grown = [*words[:80], *"or parts of it made by others here".split(), *words[80:]]
    far = [*words[:80], *prose(400, 1).split(), *words[80:]]
    third = words[: len(words) // 3]
    found = labels(spark, [(1, " ".join(edited)), (2, " ".join(grown)), (3, " ".join(far)), (4, " ".join(third))])
    assert "mit-body" in found[1][0] and 0.6 <= found[1][1] <= 1
    assert "mit-body" in found[2][0]
    assert "mit-body" not in found[3][0] and "mit-body" not in found[4][0]


def test_phrases_and_notices_of_over_64_runs_count_each_position_once(spark):
    phrase = " ".join(f"w{i}" for i in range(150))
    notice = " ".join(f"n{i}" for i in range(200))
    half = " ".join(f"n{i}" for i in range(100))
    rows = [(1, f"a {phrase} b {phrase}"), (2, phrase.replace("w70 ", "x ")), (3, notice), (4, f"{half} {half} {half}")]
    df = spark.createDataFrame(rows, COLUMNS)
    found = licenses.scan(df, {phrase: "long"}, {notice: "notice"}, {})
    got = {r["doc_id"]: (r["n_places"], r["first_word"], r["last_word"], r["labels"]) for r in found.collect()}
    assert got == {1: (2, 1, 152, ["long"]), 2: (0, None, None, []), 3: (0, None, None, ["notice"]), 4: (0, None, None, [])}


def test_overlapping_places_are_all_counted(spark):
    df = spark.createDataFrame([(1, "a b a b a b a")], COLUMNS)
    row = licenses.scan(df, {"a b a": "aba"}, {}, {}).first()
    assert (row["n_places"], row["first_word"], row["last_word"], row["score"]) == (3, 0, 4, 1.0)


def test_clashing_columns_null_ids_and_short_templates(spark):
    df = spark.createDataFrame(
        [(None, "MIT License", 1, 2, "x"), (None, None, 1, 2, "x"), (5, "", 1, 2, None), (5, "mit", None, None, None)],
        "doc_id long, text string, template int, diagonal long, hash string",
    )
    rows = licenses.scan(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_places"]) for r in rows) == [(0, 0, 0), (0, 2, 1), (5, 0, 0), (5, 1, 0)]
    with pytest.raises(ValueError):
        licenses.Templates({"one": "x"}, {}, {})
    with pytest.raises(ValueError):
        licenses.Templates({}, {}, {"x": "only three words"})
