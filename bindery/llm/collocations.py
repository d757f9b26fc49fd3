r"""Phrase collocations by Rabin-Karp fingerprints.

Texts are lower-cased in A-Z, split into pieces at ``[.,;:!?\x0A-\x0D]`` and these into words at
spaces and tabs.  Prefix polynomials (numpy, modulo 2^64) give every word and every run of up to ``LONGEST``
words its fingerprint in a few array steps; Spark adds up fingerprints, first within a task.
A run can be frequent only if its words and its pairs are: frequent fingerprints set bits in a
sieve of fixed size, and the next scan emits only runs whose parts pass it.  A sieve lets some rare
runs through, never stops a frequent one, and does not grow with the data.

The last scan groups the occurrences that pass by fingerprint and points at the first of each
group.  The others are compared with its text word by word, those that differ are rows
of their own, the pointers are read, and phrases are added up by their text: fingerprints
that collide never mix counts.  Only frequent phrases become text.

The words of a language are those of its documents; a null language is ``und``, a null text is empty
and has no phrases, repeated rows count again, and an empty table has no phrases.  Ties go to the smaller cut
and to the smaller phrase by UTF-8 bytes.  Texts of any length are read in blocks that end with a piece.
Only ``doc_id``, ``lang`` and ``text`` are read, so further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.common import mixed, small_batches
from bindery.session import settle

LONGEST = 5
#: Text bytes hashed at once, and bits of a sieve.
BLOCK_BYTES, SIEVE_BITS = 1 << 20, 26
#: Fingerprints of a task that are counted at once, over blocks, before they leave it.
POOL = 1 << 20
#: 0: part of a word, 1: between words, 2: between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2F
INVERSE = pow(BASE, -1, 1 << 64)


@cache
def powers(base: int, bits: int) -> np.ndarray:
    """``base`` to the powers from 0, 2^bits of them, modulo 2^64."""
    found = np.full(1 << bits, base, np.uint64)
    found[0] = 1
    return np.cumprod(found)


class Polynomial:
    """Prefix polynomial of a row of values; any stretch's hash is one subtraction and one product."""

    def __init__(self, values: np.ndarray):
        self.bits = max(BLOCK_BYTES.bit_length(), len(values).bit_length())
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(BASE, self.bits)[: len(values)], out=self.sums[1:])

    def of(self, starts: np.ndarray | slice, stops: np.ndarray | slice) -> np.ndarray:
        return (self.sums[stops] - self.sums[starts]) * powers(INVERSE, self.bits)[starts]


class Block:
    """The words of some texts that stand one after the other in ``data``; ``heads`` are their starts."""

    def __init__(self, data: np.ndarray, heads: np.ndarray, seeds: np.ndarray):
        self.data = LOWER[data]
        kind = KIND[self.data]
        solid = kind == 0
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        inside = heads[heads < len(data)]
        begins[inside] = solid[inside]
        last = inside[inside > 0] - 1
        ends[last] = solid[last]
        self.starts, self.stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.text = np.searchsorted(heads, self.starts, "right") - 1
        self.piece = np.cumsum(kind == 2)[self.starts] + self.text
        self.seed = seeds[self.text]
        self.passed: tuple[int, np.ndarray, np.ndarray] | None = None
        self.symbols = mixed(Polynomial(VALUES[self.data]).of(self.starts, self.stops) + np.uint64(1))
        self.sums = Polynomial(self.symbols)

    def __len__(self) -> int:
        return len(self.starts)

    def whole(self, size: int) -> np.ndarray:
        """Which runs of ``size`` words lie in one piece."""
        count = max(len(self) - size + 1, 0)
        return self.piece[:count] == self.piece[size - 1 :]

    def fingerprints(self, size: int, at: np.ndarray | slice | None = None) -> np.ndarray:
        """The fingerprints of all runs of ``size`` words, or of those that start ``at`` some words."""
        if at is None:
            count = max(len(self) - size + 1, 0)
            return mixed(self.sums.of(slice(count), slice(size, size + count)) + self.seed[:count] + np.uint64(size))
        return mixed(self.sums.of(at, at + size) + self.seed[at] + np.uint64(size))

    def passing(self, size: int, part: int, sieve: np.ndarray | None) -> np.ndarray:
        """Which runs of ``size`` words lie in one piece and have only parts, of ``part`` words, that pass the sieve."""
        found = self.whole(size)
        if sieve is not None and len(found):
            if self.passed is None or self.passed[0] != part or self.passed[1] is not sieve:
                self.passed = part, sieve, held(sieve, self.fingerprints(part))
            parts = self.passed[2]
            for k in range(size - part + 1):
                found = found & parts[k : k + len(found)]
        return found

    def identities(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, equal only for equal words, and the words by number."""
        _, first, number = np.unique(self.symbols, return_index=True, return_inverse=True)
        texts = [bytes(self.data[a:b]) for a, b in zip(self.starts[first].tolist(), self.stops[first].tolist())]
        lengths = self.stops - self.starts
        model = first[number]
        differs = lengths != lengths[model]
        size = np.where(differs, 0, lengths)
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        same = self.data[np.repeat(self.starts, size) + offset] == self.data[np.repeat(self.starts[model], size) + offset]
        differs[np.repeat(np.arange(len(size)), size)[~same]] = True
        known: dict[bytes, int] = {}
        for k in np.flatnonzero(differs):  # words whose hashes collide
            text = bytes(self.data[self.starts[k] : self.stops[k]])
            if text not in known:
                known[text] = len(texts)
                texts.append(text)
            number[k] = known[text]
        return number, pa.array(texts, pa.binary())


def held(sieve: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    """Which fingerprints have both of their bits in the sieve."""

    def bit(place: np.ndarray) -> np.ndarray:
        return (sieve[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1

    found = bit(fingerprints >> np.uint64(64 - SIEVE_BITS))
    some = np.flatnonzero(found)
    found[some] = bit(fingerprints[some] & np.uint64((1 << SIEVE_BITS) - 1))
    return found


def language_of(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "und")


def seed_of(language: str) -> int:
    data = np.frombuffer(language.encode(), np.uint8)
    return int(mixed(Polynomial(VALUES[data]).sums[-1:] + np.uint64(len(data) + 1))[0])


def cuts(data: np.ndarray) -> list[tuple[int, int]]:
    """A long text as stretches of about a block, each ending behind a piece."""
    found, start = [], 0
    while start < len(data):
        stop = min(len(data), start + BLOCK_BYTES)
        while stop < len(data) and KIND[data[stop - 1]] != 2:
            ahead = np.flatnonzero(KIND[data[stop : stop + BLOCK_BYTES]] == 2)
            stop = stop + int(ahead[0]) + 1 if len(ahead) else min(len(data), stop + BLOCK_BYTES)
        found.append((start, stop))
        start = stop
    return found


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, pa.Array, pa.Array]]:
    """Blocks of texts with the languages and ids of these, in runs of bounded size."""
    for batch in batches:
        languages, ids = language_of(batch.column("lang")), batch.column("doc_id")
        seeds = np.array([seed_of(x) for x in languages.to_pylist()], np.uint64)
        texts = batch.column("text").cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        lengths = np.where(np.array(texts.is_valid()), np.diff(bounds), 0)
        row = 0
        while row < len(texts):
            total = np.cumsum(lengths[row:])
            stop = row + max(1, int(np.searchsorted(total, BLOCK_BYTES, "right")))
            low, high = int(bounds[row]), int(bounds[row] + lengths[row]) if stop == row + 1 else int(bounds[stop])
            for a, b in cuts(data[low:high]) if stop == row + 1 else [(0, high - low)]:
                heads = np.zeros(1, np.int64) if stop == row + 1 else (bounds[row:stop] - low).astype(np.int64)
                block = Block(data[low + a : low + b], heads, seeds[row:stop])
                if len(block):
                    yield block, languages.slice(row, stop - row), ids.slice(row, stop - row)
            row = stop


def as_long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int64) if values.dtype != np.uint64 else values.view(np.int64), pa.int64())


def pooled(batches: Iterator[pa.RecordBatch], sizes: range, sieve: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """``fingerprint`` and ``n`` of the runs of a task, added up over its blocks while there are fewer than ``POOL``."""

    def sums() -> list[pa.RecordBatch]:
        values, counts = np.unique(np.concatenate(pool), return_counts=True)
        return pa.table({"fingerprint": as_long(values), "n": as_long(counts)}).to_batches(POOL // 8)

    pool, held_now = [], 0
    for block, _, _ in blocks(batches):
        for size in sizes:
            at = np.flatnonzero(block.passing(size, sizes[0] - 1, sieve))
            pool.append(block.fingerprints(size, at))
            held_now += len(at)
            if held_now >= POOL:
                yield from sums()
                pool, held_now = [], 0
    if held_now:
        yield from sums()


def counted(docs: DataFrame, sizes: range, sieve: np.ndarray | None = None) -> DataFrame:
    """``lang``, ``fingerprint`` and ``n`` of all runs of ``sizes`` words whose parts pass the sieve of the size before."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve)  # of fixed size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, languages, _ in blocks(batches):
            names, number = np.unique(np.array(languages.to_pylist(), object), return_inverse=True)
            for size in sizes:
                at = np.flatnonzero(block.passing(size, sizes[0] - 1, shared.value))
                values, first, counts = np.unique(block.fingerprints(size, at), return_index=True, return_counts=True)
                langs = pa.array(names, pa.string()).take(pa.array(number[block.text[at[first]]]))
                yield pa.RecordBatch.from_arrays([langs, as_long(values), as_long(counts)], ["lang", "fingerprint", "n"])

    docs = docs.select("doc_id", "lang", "text")
    if sizes[0] > 1:  # the language is part of a fingerprint
        found = docs.mapInArrow(lambda batches: pooled(batches, sizes, shared.value), "fingerprint bigint, n bigint")
        return found.groupBy("fingerprint").agg(F.sum("n").alias("n"))
    return docs.mapInArrow(scan, "lang string, fingerprint bigint, n bigint").groupBy("lang", "fingerprint").agg(F.sum("n").alias("n"))


def sieve_of(found: DataFrame) -> np.ndarray:
    """The bits of all fingerprints of a table, as words of 64; at most 2^(SIEVE_BITS - 6) rows come to the driver."""
    value = F.col("fingerprint")
    places = F.explode(F.array(F.shiftrightunsigned(value, 64 - SIEVE_BITS), value.bitwiseAND((1 << SIEVE_BITS) - 1)))
    words = found.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("bits"))
    rows = words.toArrow()
    bits = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    bits[rows["w"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return bits


def phrases(docs: DataFrame, sieves: list[np.ndarray]) -> DataFrame:
    """``lang``, ``phrase``, ``words``, ``n`` and the smallest ``doc_id`` of runs that pass the sieve of their own size."""
    shared = docs.sparkSession.sparkContext.broadcast(sieves)  # of fixed size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, languages, ids in blocks(batches):
            number, words = block.identities()
            for size in range(1, LONGEST + 1):
                at = np.flatnonzero(block.passing(size, size, shared.value[min(size, len(shared.value)) - 1]))
                _, first, group, counts = np.unique(block.fingerprints(size, at), return_index=True, return_inverse=True, return_counts=True)
                pointers = at[first]
                model = pointers[group]
                other = np.zeros(len(at), bool)
                for k in range(size):
                    other |= number[at + k] != number[model + k]
                if other.any():  # runs that only share a fingerprint
                    counts = counts - np.bincount(group[other], minlength=len(counts))
                    pointers, counts = np.append(pointers, at[other]), np.append(counts, np.ones(other.sum(), np.int64))
                parts = [words.take(pa.array(number[pointers + k])) for k in range(size)]
                text = pc.binary_join_element_wise(*parts, b" ").cast(pa.string())
                rows = pa.array(block.text[pointers])
                yield pa.RecordBatch.from_arrays(
                    [languages.take(rows), text, pa.array(np.full(len(pointers), size, np.int32)), as_long(counts), ids.take(rows).cast(pa.int64())],
                    ["lang", "phrase", "words", "n", "doc_id"],
                )

    found = docs.select("doc_id", "lang", "text").mapInArrow(scan, "lang string, phrase string, words int, n bigint, doc_id bigint")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id"))


def frequent(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """All runs of up to ``LONGEST`` words with ``least`` occurrences in their language, and the languages' word counts."""
    small_batches(docs.sparkSession)
    words = settle(counted(docs, range(1, 2)))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    sieves = [sieve_of(words.where(F.col("n") >= least))]
    pairs = counted(docs, range(2, 3), sieves[0]).where(F.col("n") >= least)
    sieves.append(sieve_of(pairs))
    longer = counted(docs, range(3, LONGEST + 1), sieves[1]).where(F.col("n") >= least)
    sieves.append(sieve_of(longer))
    return settle(phrases(docs, sieves).where(F.col("n") >= least)), totals


def head(phrase: Column | str, words: Column) -> Column:
    return F.call_function("substring_index", phrase, F.lit(" "), words)


def collocations(docs: DataFrame, least: int = 100, percent: int = 100) -> DataFrame:
    """``lang``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` and ``doc_id`` of all phrases that no longer one holds.

    A phrase is dropped if a longer one that holds it has ``percent`` of its occurrences.  A phrase one word
    longer has at least those of any longer one, so the two parts one word shorter are all that need to be marked.
    """
    big = "decimal(38,0)"
    known, totals = frequent(docs, least)
    found = known.where("words > 1").withColumnRenamed("n", "a")
    phrase, words = F.col("phrase"), F.col("words")
    held_by = found.where("words > 2").select("lang", F.explode(F.array(head(phrase, words - 1), head(phrase, 1 - words))).alias("phrase"), F.col("a").alias("longer"))
    most = held_by.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = found.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent))
    cut = kept.select("lang", "phrase", "a", "doc_id", "words", F.explode(F.sequence(F.lit(1), words - 1)).alias("k"))
    sides = cut.select("lang", "phrase", "a", "doc_id", "k", head(phrase, F.col("k")).alias("left"), head(phrase, F.col("k") - words).alias("right"))
    lefts = known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    rights = known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    rated = sides.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(totals, "lang")
    thousand = F.lit(1000).cast(big)
    scored = rated.withColumns({"top": thousand * F.col("a").cast(big) * F.col("total").cast(big), "bottom": F.col("l").cast(big) * F.col("r").cast(big)})
    cuts_of = scored.select("lang", "phrase", "a", "doc_id", F.col("total").alias("n"), F.struct(F.expr("top div bottom").alias("score"), "k", "l", "r").alias("cut"))
    best = cuts_of.groupBy("lang", "phrase", "a", "n", "doc_id").agg(F.min("cut").alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", "doc_id")


def top(docs: DataFrame, count: int, least: int = 100, percent: int = 100) -> DataFrame:
    """The first ``count`` collocations of each language with their ``rank``."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return collocations(docs, least, percent).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= count)
