"""Benchmark decontamination by greedy string tiling.

Runs of ``LEAST`` words (the shortest tile) that a document shares with a test item are
seeds; Spark joins them by hash.  A pair whose seeds could cover enough of the item is
tiled: the longest matches of unmarked words are found with rolling Karp-Rabin hashes,
marked, and the search goes on with shorter ones, so passages in another order count too.
A document leaks an item if tiles cover at least ``COVERED`` of the item's words.

Words are runs of letters and digits, case folded.  Items shorter than ``LEAST`` words
are one seed as a whole.  Null and empty texts and items share nothing.  Rows that repeat a
doc_id or item_id are each compared; a pair is reported once, with its best coverage.  Of
equally long matches the first in the item, then in the text, is marked.  Texts of any length are read
whole; only their parts around seeds move on.  An empty table has no pairs.  ``doc_id`` and ``text``, ``item_id`` and
``text`` are read; ``without_leaks`` keeps all columns of the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import chunks, in_sieve, long_lists, mixed, rolling, sieve_of
from bindery.llm.minhash import hashed_text, hashed_words
from bindery.session import settle

LEAST, COVERED = 5, 0.5
#: Bits of a hash that the sieve keeps: it has 2 ** SIEVE_BITS places (4 MB) for any number of seeds, and drops most other runs before the join.
SIEVE_BITS = 25
WORD = re.compile(r"[^\W_]+")


#: What ``WORD`` and lower case make of ASCII texts: other bytes than those of words are spaces.
PLAIN = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 0x20 for b in range(256))


def hashed_texts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The word hashes of runs of texts that stand one after the other, and how many each text has."""
    for run in chunks(texts):
        parts = [t.encode().translate(PLAIN) if t.isascii() else " ".join(WORD.findall(t.lower())).encode() for t in run]
        data = np.frombuffer(b" ".join(parts), np.uint8)
        if len(parts) == 1:
            hashes = hashed_text(data)
            yield hashes, np.array([len(hashes)])
        else:
            yield hashed_words(data, np.cumsum([0, *(len(p) + 1 for p in parts[:-1])]))


def hashed(words: np.ndarray, least: int) -> np.ndarray:
    return rolling(words, least).view(np.int64)


def items_of(benchmark: DataFrame, least: int) -> DataFrame:
    """``item`` (one per row), ``item_id`` and ``words``, the word hashes of each item that has words."""

    @F.arrow_udf("array<bigint>")
    def words(texts: pa.Array) -> pa.Array:
        return long_lists([part for hashes, counts in hashed_texts(texts) for part in np.split(hashes, np.cumsum(counts)[:-1])])

    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", words(benchmark["text"]).alias("words"))
    return settle(rows.where(F.size("words") > 0))


def seeds_of(items: DataFrame, least: int) -> DataFrame:
    """``seed``, ``size`` (its words) and the ``item`` and position ``at`` it stands at."""

    @F.arrow_udf("array<bigint>")
    def seeds(lists: pa.Array) -> pa.Array:
        parts = [np.asarray(w.as_py(), np.int64).view(np.uint64) for w in lists]
        return long_lists([rolling(w, min(least, len(w))) for w in parts])

    return items.select("item", F.least(F.size("words"), F.lit(least)).alias("size"), F.posexplode(seeds("words")).alias("at", "seed"))


def regions(docs: DataFrame, sieve: np.ndarray, bits: int, sizes: list[int]) -> DataFrame:
    """The parts of documents that hold seeds: ``row``, ``doc_id``, ``words``, distinct ``seeds``.

    Runs of words that the sieve of the benchmark lets pass count as seeds; the join drops the false ones.
    Parts that are not neighbours are kept apart by a word that occurs nowhere.
    """

    @F.arrow_udf("struct<words:array<bigint>,seeds:array<bigint>>")
    def cut(texts: pa.Array) -> pa.Array:
        kept, found = [], []
        for hashes, counts in hashed_texts(texts):
            owner, hits = np.repeat(np.arange(len(counts)), counts), []
            for size in sizes:
                runs = hashed(hashes, size)
                at = np.flatnonzero(in_sieve(sieve, runs, bits))
                at = at[owner[at] == owner[at + size - 1]]  # runs inside one text
                hits.append((size, at, runs[at]))
            some = np.zeros(len(counts), bool)
            some[owner[np.concatenate([at for _, at, _ in hits])] if hits else []] = True
            ends = np.cumsum(counts)
            for with_seeds, start, stop in zip(some.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                if not with_seeds:
                    kept.append(np.empty(0, np.int64))
                    found.append(np.empty(0, np.int64))
                    continue
                inside, seeds = np.zeros(stop - start + 1, bool), []
                for size, at, runs in hits:
                    own = slice(*np.searchsorted(at, (start, stop)))
                    change = np.zeros(len(inside), np.int64)
                    np.add.at(change, at[own] - start, 1)
                    np.add.at(change, at[own] - start + size, -1)
                    inside |= np.cumsum(change) > 0
                    seeds.append(runs[own])
                at = np.flatnonzero(inside)
                part = hashes[start:stop][at].view(np.int64)
                gaps = np.flatnonzero(np.diff(at) > 1) + 1
                apart = mixed(np.arange(1, len(gaps) + 1, dtype=np.uint64)).view(np.int64)
                kept.append(np.insert(part, gaps, apart))
                found.append(np.unique(np.concatenate(seeds)))
        return pa.StructArray.from_arrays([long_lists(kept), long_lists(found)], ["words", "seeds"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", cut(docs["text"]).alias("_"))
    return settle(rows.where(F.size("_.seeds") > 0).select("row", "doc_id", "_.words", "_.seeds"))


def tiles(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiles (text start, item start, length), longest first, ties to the first item and text place.

    Matches of a length are found by the rolling hash of all unmarked runs of that length;
    lengths fall from the longest possible by bisection: a common run of n words implies one of n - 1.
    """
    free_text, free_item = np.ones(len(text), bool), np.ones(len(item), bool)
    found: list[tuple[int, int, int]] = []

    def common(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Unmarked runs of ``size`` words in the item that the text has unmarked too, with hashes."""
        a, b = karp_rabin(text, size), karp_rabin(item, size)
        pa_, pb = np.flatnonzero(whole(free_text, size)), np.flatnonzero(whole(free_item, size))
        hit = np.isin(b[pb], a[pa_])
        return a, pa_, b, pb[hit]

    top = min(len(text), len(item))
    while top >= least:
        low, high = least, top
        if not len(common(least)[3]):
            break
        while low < high:
            middle = (low + high + 1) // 2
            if len(common(middle)[3]):
                low = middle
            else:
                high = middle - 1
        a, in_text, b, in_item = common(low)
        order = np.argsort(a[in_text], kind="stable")
        in_text, keys = in_text[order], a[in_text[order]]
        for q in in_item.tolist():
            if not free_item[q : q + low].all():
                continue
            i = np.searchsorted(keys, b[q])
            while i < len(keys) and keys[i] == b[q]:
                p = int(in_text[i])
                if free_text[p : p + low].all() and (text[p : p + low] == item[q : q + low]).all():
                    free_text[p : p + low] = False
                    free_item[q : q + low] = False
                    found.append((p, q, low))
                    break
                i += 1
        top = low - 1
    return found


BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def karp_rabin(words: np.ndarray, size: int) -> np.ndarray:
    """Rolling hashes of all runs of ``size`` words, from prefix sums of powers (mod 2 ** 64; the base is odd)."""
    words = words.view(np.uint64)
    if len(words) < size:
        return np.empty(0, np.uint64)
    powers = np.cumprod(np.full(len(words), BASE))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers)))
    runs = sums[size:] - sums[:-size]
    return runs * np.cumprod(np.full(len(runs), INVERSE))


def whole(free: np.ndarray, size: int) -> np.ndarray:
    """Where runs of ``size`` free words start."""
    sums = np.concatenate(([0], np.cumsum(free)))
    return sums[size:] - sums[:-size] == size if len(free) >= size else np.empty(0, bool)


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, covered: float = COVERED) -> DataFrame:
    """Pairs of a document and a test item it holds: ``doc_id``, ``item_id``, ``item_words``, ``covered_words``, ``coverage``, ``n_tiles``, ``longest``."""
    items = items_of(benchmark, least)
    seeds = settle(seeds_of(items, least))
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())
    parts = regions(docs, sieve_of(seeds, SIEVE_BITS), SIEVE_BITS, sizes)
    # Words of the item that shared seeds can cover, as places 0 to n - 1: no tile lies outside.
    shared = parts.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed")
    places = shared.select("row", "item", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("place"))
    reach = places.groupBy("row", "item").agg(F.count_distinct("place").alias("reach"))
    pairs = reach.join(items, "item").where(F.col("reach") >= F.lit(covered) * F.size("words"))
    pairs = pairs.select("row", "item", "item_id", F.col("words").alias("item_words"))

    @F.arrow_udf("struct<covered_words:bigint,n_tiles:bigint,longest:bigint>")
    def tiled(texts: pa.Array, tests: pa.Array) -> pa.Array:
        out = []
        for text, test in zip(texts, tests, strict=True):
            item = np.asarray(test.as_py(), np.int64)
            sizes = [n for _, _, n in tiles(np.asarray(text.as_py(), np.int64), item, min(least, len(item)))]
            out.append({"covered_words": sum(sizes), "n_tiles": len(sizes), "longest": max(sizes, default=0)})
        return pa.array(out, pa.struct([("covered_words", pa.int64()), ("n_tiles", pa.int64()), ("longest", pa.int64())]))

    both = pairs.join(parts.select("row", "doc_id", "words"), "row")
    found = both.select("doc_id", "item_id", F.size("item_words").cast("bigint").alias("item_words"), tiled("words", "item_words").alias("_"))
    found = found.select("doc_id", "item_id", "item_words", "_.*").withColumn("coverage", F.col("covered_words") / F.col("item_words"))
    best = found.where(F.col("coverage") >= covered).groupBy("doc_id", "item_id").agg(
        F.max(F.struct("coverage", "item_words", "covered_words", "n_tiles", "longest")).alias("_")
    )
    return best.select("doc_id", "item_id", "_.item_words", "_.covered_words", "_.coverage", "_.n_tiles", "_.longest")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The documents that hold no test item."""
    found = leaks(docs, benchmark, **parameters).select(F.col("doc_id").alias("_leaks")).distinct()
    return docs.join(settle(found), docs["doc_id"].eqNullSafe(F.col("_leaks")), "left_anti")
