"""Spelling variants, the systematic mix and collocations against brute force, on small and awkward tables."""

import collections
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bindery.llm import collocations, mixing, queries, spelling
from bindery.llm.common import BATCH_BYTES, BATCH_ROWS, DEFAULTS, table
from check import rows_of

SMALL = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"spelling variant{chr(97 + i % 7)} of a long text, again;" for i in range(20_000))
AWKWARD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n\r\x0b .,;:!? ", "en", "a"),
    (4, LONG, "en", "a"),
    (5, "Naïve naïve NAÏVE naive naive naive naive naive naive", "fr", "b"),
    (5, "Naïve naïve NAÏVE naive naive naive naive naive naive", "fr", "b"),
    (6, "aaaaa aaaaaa aaaaa aaaaaa aaaaa aaaaaa aaaab baaaa baaaa baaaa aaaab aaaab", "xx", "b"),
    (7, "one two\tone  two. one two one", "und", None),
    (None, "no id here, no id here, no id here", None, "c"),
    (None, "no id here, no id here, no id here", None, "c"),
    (8, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + "y" + " " + ("x" * 4999 + "y ") * 2 + "x" * 5000, "en", "z"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(*r, 1, "q", 3, ["y"], {"a": 1}, 2.0) for r in AWKWARD]
    kind = (
        "doc_id long, text string, lang string, source string, n int, key string, size int, words array<string>, "
        "word map<string, int>, target double"
    )
    return spark.createDataFrame(rows, kind).repartition(3)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "conversations"):
        connection.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_its_twin(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    answer = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, answer.fetchall())


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    counts = collections.Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 5
    words = {w: n for w, n in counts.items() if n >= 3}
    found, forms = {}, {}
    for w, n in words.items():
        close = sorted((x for x in words if near(w, x)), key=lambda x: (-words[x], x))
        if close and words[close[0]] >= 2 * n:
            forms[w] = close[0]
        found[w] = len(close)
    rooted = {}
    for w in words:
        end = w
        while end in forms:
            end = forms[end]
        rooted[w] = end
    return {(w, forms.get(w), rooted[w], n, found[w], words.get(forms.get(w))) for w, n in words.items()}


def test_variants_of_awkward_rows(awkward):
    got = [tuple(r) for r in spelling.variants(awkward).collect()]
    assert set(got) == plain_variants(AWKWARD) and len(got) == len(set(got))
    assert spelling.variants(awkward.where("false")).count() == 0


def test_variants_of_random_words(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abÀ") for _ in range(rng.choice((5, 6, 7)))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=40)), "", "") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {tuple(r) for r in spelling.variants(docs).collect()} == plain_variants(rows)


def test_chains_end_at_their_root(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(20)]
    ends = spelling.roots(spark.createDataFrame(forms, "word string, form string"))
    assert {r["root"] for r in ends.collect()} == {"w20"}


def mixed(rows, **options):
    found = mixing.mix(rows, F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.col("source"), [3, 1, 2], Fraction(3, 2), **options)
    return found


def test_targets_are_reshared(spark):
    rng = random.Random(4)
    for sizes in ([1], [0, 0], [5, 0, 7], [100, 1, 1, 1, 1, 90, 3, 3], [rng.randrange(1000) for _ in range(40)]):
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        left, full = Fraction(3, 2) * sum(sizes), set()
        while len(full) < len(sizes):
            level = (left - sum(2 * sizes[i] for i in full)) / sum(w for i, w in enumerate(weights) if i not in full)
            above = {i for i, w in enumerate(weights) if i not in full and w * level > 2 * sizes[i]}
            if not above:
                break
            full |= above
        want = [2 * s if i in full else weights[i] * level for i, s in enumerate(sizes)]
        table = spark.createDataFrame(list(zip(range(len(sizes)), sizes, weights)), "i int, source_size long, weight long")
        got = {r["i"]: r["target"] for r in mixing.targets(table, Fraction(3, 2), 2).collect()}
        assert all(math.isclose(got[i], want[i], abs_tol=1e-9) for i in got) and len(got) == len(sizes)


def test_mix_takes_what_it_should(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    first, again = mixed(docs.select("doc_id", "source", "text")), mixed(docs.select("doc_id", "source", "text").repartition(7, "doc_id"))
    rows = {tuple(r) for r in first.select("doc_id", "copies").collect()}
    assert rows == {tuple(r) for r in again.select("doc_id", "copies").collect()} and len(rows) == 1000
    sums = first.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("longest"))
    for r in sums.collect():
        assert abs(r["taken"] - r["target"]) <= r["longest"]
    assert first.where("copies > 2 or copies < 0").count() == 0
    assert mixing.emitted(first).count() == first.agg(F.sum("copies")).first()[0]
    assert {tuple(r) for r in mixed(docs.select("doc_id", "source", "text"), seed=1).select("doc_id", "copies").collect()} != rows


def test_mix_of_awkward_rows(awkward):
    found = mixed(awkward)
    assert found.columns == [c for c in awkward.columns if c not in mixing.RESULT] + list(mixing.RESULT)
    rows = found.collect()
    assert len(rows) == len(AWKWARD)
    assert sorted(r["size"] for r in rows) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in AWKWARD)
    assert {r["copies"] for r in rows if r["source"] is None and r["doc_id"] == 1} <= {0, 1, 2}
    assert mixed(awkward.where("false")).count() == 0
    assert {r["copies"] for r in mixed(awkward.where("doc_id = 2")).collect()} == {0}


def plain_collocations(rows, least, longest=5):
    counts, totals, order = collections.Counter(), collections.Counter(), []
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    known = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    parts = {}
    for (lang, words), a in known.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                part = (lang, words[i : i + size])
                parts[part] = max(parts.get(part, 0), a)
    for (lang, words), a in known.items():
        if parts.get((lang, words), 0) < a:
            cuts = []
            for k in range(1, len(words)):
                l, r = counts[lang, words[:k]], counts[lang, words[k:]]
                cuts.append((1000 * a * totals[lang] // (l * r), k, l, r))
            score, _, l, r = min(cuts)
            order.append((lang, " ".join(words), a, l, r, totals[lang], score))
    return sorted(order, key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))


def test_collocations_of_awkward_rows(awkward):
    want = plain_collocations(AWKWARD, 2)
    got = collocations.top(awkward, 10**9, least=2).select("lang", "phrase", "a", "l", "r", "n", "score", "rank").collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(want)
    places = {x: i for i, x in enumerate(want)}
    starts = {lang: min(i for x, i in places.items() if x[0] == lang) for lang in {x[0] for x in want}}
    assert all(r["rank"] == places[tuple(r)[:7]] - starts[r["lang"]] + 1 for r in got)
    assert collocations.top(awkward.where("false"), 10).count() == 0


def test_a_sieve_that_lets_all_pass_changes_nothing(awkward, monkeypatch):
    want = plain_collocations(AWKWARD, 3)
    full = np.full(1 << (collocations.SIEVE_BITS - 6), np.uint64(2**64 - 1))
    monkeypatch.setattr(collocations, "sieve_of", lambda found: full)
    got = collocations.collocations(awkward, least=3).select("lang", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_colliding_fingerprints_are_told_apart(monkeypatch):
    words = "ab cd ab cd ab ef cd ab ef".encode()
    block = collocations.Block(np.frombuffer(words, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.uint64))
    block.symbols = np.zeros(len(block), np.uint64)
    number, texts = block.identities()
    assert [texts[int(k)].as_py() for k in number] == words.split()


def test_collocations_bound_the_batches_of_workers(spark):
    for key, size in DEFAULTS.items():
        spark.conf.set(key, size)
    docs = spark.createDataFrame([(1, "a b. a b", "en")], "doc_id long, text string, lang string")
    assert [r["phrase"] for r in collocations.top(docs, 5, least=2).collect()] == ["a b"]
    assert [spark.conf.get(key) for key in DEFAULTS] == [str(BATCH_ROWS), str(BATCH_BYTES)]
    assert collocations.Polynomial(np.zeros(9, np.uint64)).bits <= 21


@pytest.mark.parametrize("size", [16, 64, 1 << 21])
def test_blocks_cut_texts_between_pieces(monkeypatch, size):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", size)
    rng = random.Random(size)
    texts = ["".join(rng.choice("ab é.\n") for _ in range(rng.choice((0, 3, 40, 300)))) for _ in range(50)] + [None, "a" * 500]
    batch = pa.RecordBatch.from_arrays([pa.array(range(52)), pa.array(["en"] * 52), pa.array(texts, pa.string())], ["doc_id", "lang", "text"])
    got = collections.Counter()
    for block, _, ids in collocations.blocks(iter([batch.slice(0, 20), batch.slice(20)])):
        number, words = block.identities()
        for i in np.flatnonzero(block.whole(2)):
            got[ids[int(block.text[i])].as_py(), words[int(number[i])].as_py(), words[int(number[i + 1])].as_py()] += 1
    want = collections.Counter()
    for i, text in enumerate(texts):
        for piece in re.split(r"[.\n]", text or ""):
            run = re.findall(r"[^\x20\x09]+", piece)
            want.update((i, a.encode(), b.encode()) for a, b in zip(run, run[1:]))
    assert got == want


def test_scores_past_64_bits(spark):
    big = spark.range(1).select(*[F.lit(v).cast("decimal(38,0)").alias(n) for n, v in (("a", 10**12), ("n", 10**13), ("l", 10**12), ("r", 10**12))])
    assert big.select(F.expr("cast(1000 as decimal(38,0)) * a * n div (l * r)")).first()[0] == 10000


def test_signatures_of_linked_sets_differ_in_few_bins(spark):
    from bindery.llm import minhash

    rng = np.random.default_rng(5)
    rows = []
    for size in (1, 3, 20, 100, 400, 5000):
        for _ in range(300):
            both = rng.integers(0, 2**64, size, np.uint64)
            own = rng.integers(0, 2**64, int(size * 15 / 85), np.uint64)
            cut = rng.integers(0, len(own) + 1)
            x, y = (np.sort(np.concatenate([both, part])) for part in (own[:cut], own[cut:]))
            rows.append((size, *minhash.signature(x), *minhash.signature(y)))
    df = spark.createDataFrame(rows, "size int, a long, b long, c long, d long")
    fits = minhash.alike((F.col("a"), F.col("b")), (F.col("c"), F.col("d")), 85)
    assert df.where(~fits).count() == 0
    # Unrelated sets do not pass.
    shuffled = [(a[1], a[2], b[3], b[4]) for a, b in zip(rows[900:], rows[901:])]
    assert spark.createDataFrame(shuffled, "a long, b long, c long, d long").where(fits).count() < 5


def test_copies_with_small_ids_and_nulls_go(spark):
    from bindery.llm import minhash

    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (None, "h i j k l m"), (None, "h i j k l m")]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id int, text string"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "h i j k l m"), (1, "a b c d e f g")]


def test_search_takes_the_smallest_ids_of_equal_scores(spark):
    from bindery.llm import ann

    rng = np.random.default_rng(6)
    rows = [(0, [1.0] + [0.0] * 7)]
    rows += [(i, [1.0, *map(float, rng.normal(size=7))]) for i in range(1, 301)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found.collect())
    assert got == [(i, i, 1.0) for i in range(1, 21)]


def test_secret_columns_stand_in_their_order(spark):
    df = queries.QUERIES["op1_secret_scan"](spark, SMALL)
    assert df.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def test_fingerprints_are_added_up_over_blocks():
    texts = ["one two three. four five six", "one two three. seven eight"] * 50
    batch = pa.record_batch({"doc_id": list(range(100)), "lang": ["en"] * 100, "text": pa.array(texts, pa.string())})
    found = pa.Table.from_batches(list(collocations.pooled(iter([batch.slice(0, 30), batch.slice(30)]), range(2, 4), None)))
    runs = found["fingerprint"].to_pylist()
    assert len(runs) == len(set(runs)) == 7  # five pairs and two runs of three
    assert sorted(found["n"].to_pylist()) == [50] * 4 + [100] * 3
