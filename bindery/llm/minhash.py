"""Near-duplicates by bottom-k sketches of one hash function.

A document is the set of its word shingles, hashed; its sketch holds the ``KEPT``
smallest values.  Documents with equal sets are one class, named by the smallest doc_id.
Sketches of linked documents share all but few values (``least_shared``), so the rarest
values of each, few enough, must meet in an inverted list; signatures of 128 bits travel with their
members and tell most others apart before sketches are compared; frequent passages are never in
these unless a document has little else.  Lists generate pairs in three steps: first each member
with the list's smallest class; when those links have joined components, members outside
a list's largest component with a few others of it; then all remaining pairs of different
components, counted in cells of bounded size (lists with the same members are one, and lists of one
largest component are one block where that makes fewer pairs).  A pair goes on if it shares enough sketch values
and the sketch of the union estimates enough similarity (``SIGMAS`` standard deviations of leeway);
the exact similarity of the full sets confirms it.  Links give components.  Tables between the
steps go when their last reader is done.  Sketches stay in the table they were written to: members of lists
carry only their size and signature, and sketches move for those that stand in a pair, by a sieve of fixed size.

Texts are lower-cased in A-Z and split at ASCII white space.  With fewer words than a shingle
the whole sequence is one shingle; null and empty texts have the empty set and are linked
with nothing, nor are rows without a doc_id.  Rows that repeat a doc_id are one document whose
sets all link it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from bindery.llm.common import fresh, in_sieve, long_lists, mixed, rolling, sieve_of
from bindery.llm.components import components
from bindery.session import forget, settle

KEPT, SIGMAS = 256, 4.5
#: A signature has this many values of four bits: the smallest hash of each bin among so many smallest.
BINS, SIGNED = 32, 1024
#: The chance that the signatures of a pair at the limit differ in too many bins.
SIGN_RISK = 1e-6
#: Values of most lists that are known by their frequency; the order of the others is their own.
FREQUENT, OFTEN = 65_536, 4
#: Members of one side of a cell, rows that one group of cells should have, and columns counted at once.
CELL, GROUP_ROWS, COLUMNS = 256, 2048, 8192
#: Members of a list's largest component that the others meet before all of it.
DELEGATES = 8
#: Parts of the inverted lists, and of the pairs to confirm, that are made one after the other, so that the disk holds the shuffle of one.
PASSES = 2
#: Bits of a hash that the sieve of rows keeps: it has 2 ** ROW_BITS places (4 MB) for any number of rows.
ROW_BITS = 25
#: Text bytes that are hashed at once, up to the end of a word.
BLOCK_BYTES = 1 << 20
SOLID = ~np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)


def hashed_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of texts that stand one after the other in ``data``, and how many each text has.

    A word is the sum of one pseudo-random number for each of its bytes at its place.
    """
    solid = SOLID[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    starts = np.asarray(starts, np.int64)
    heads = starts[starts < len(data)]
    begins[heads] = solid[heads]
    at = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(at, np.append(starts, len(data))))
    if not len(at):
        return np.empty(0, np.uint64), counts
    inside = np.flatnonzero(solid)
    first = np.flatnonzero(begins[inside])
    place = inside - np.repeat(at, np.diff(np.append(first, len(inside))))
    values = mixed(((place.astype(np.uint64) << np.uint64(8)) + LOWER[data[inside]] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return mixed(np.add.reduceat(values, first)), counts


def hashed_text(data: np.ndarray) -> np.ndarray:
    """The word hashes of one text of any length, a block at a time."""
    parts, start = [], 0
    while start < len(data):
        stop = min(len(data), start + BLOCK_BYTES)
        while stop < len(data) and SOLID[data[stop]]:
            ahead = np.flatnonzero(~SOLID[data[stop : stop + BLOCK_BYTES]])
            stop = stop + int(ahead[0]) if len(ahead) else min(len(data), stop + BLOCK_BYTES)
        parts.append(hashed_words(data[start:stop], np.zeros(1, np.int64))[0])
        start = stop
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    return values[fresh]


def shingles(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    texts = texts.fill_null("").cast(pa.large_binary())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + BLOCK_BYTES, side="right")) - 1)
        stop = min(stop, len(texts))
        part = data[ends[row] : ends[stop]]
        if stop == row + 1:
            hashes = hashed_text(part)
            counts = np.array([len(hashes)])
        else:
            hashes, counts = hashed_words(part, ends[row:stop] - ends[row])
        rolled, start = rolling(hashes, words), 0
        for count in counts.tolist():
            if count >= words:
                yield distinct(rolled[start : start + count - words + 1])
            else:
                yield rolling(hashes[start : start + count], max(1, count))
            start += count
        row = stop


def least_shared(size: Column, percent: int) -> Column:
    """Sketch values that linked documents share at least, for a sketch of ``size`` values.

    Whole sets share their part exactly (two values of leeway for 32-bit values that
    collide); cut ones a binomial count, of which ``SIGMAS`` deviations are given away.
    """
    part = percent / 100
    cut = math.floor(KEPT * part - SIGMAS * math.sqrt(KEPT * part * (1 - part)))
    return F.greatest(F.least(F.lit(cut), F.ceil(size * part) - 2), F.lit(1))


def signature(found: np.ndarray) -> tuple[int, int]:
    """Four bits of the smallest hash of each bin, 128 in all; empty bins have 0.

    A pair of sets differs in a bin with the chance that it differs in a value, and in no more bins than values.
    """
    some = found[:SIGNED]
    bins, first = np.unique(some & np.uint64(BINS - 1), return_index=True)
    bits = (some[first] >> np.uint64(5)) & np.uint64(15)
    place = (bins % np.uint64(16)) * np.uint64(4)
    halves = [np.bitwise_or.reduce((bits << place)[bins // np.uint64(16) == k], initial=np.uint64(0)) for k in (0, 1)]
    return tuple(int(h.astype(np.int64)) for h in halves)


def most_different(percent: int) -> int:
    """In how many bins the signatures of linked sets differ at most."""
    part = percent / 100
    tail, bins = 0.0, BINS
    while bins >= 0:
        tail += math.comb(BINS, bins) * (1 - part) ** bins * part ** (BINS - bins)
        if tail > SIGN_RISK:
            break
        bins -= 1
    return bins


def alike(x: tuple[Column, Column], y: tuple[Column, Column], percent: int) -> Column:
    """Whether two signatures differ in few enough bins."""

    def differing(a: Column, b: Column) -> Column:
        bits = a.bitwiseXOR(b)
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2))
        return F.bit_count(bits.bitwiseAND(0x1111111111111111))

    return differing(x[0], y[0]) + differing(x[1], y[1]) <= most_different(percent)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``row`` (a number), ``id``, ``n`` (set size), ``mark`` (128 bits of the set), ``sketch`` and the signature (``s``, ``t``) of each row.

    Sketch values are the upper 32 bits of the smallest hashes, so they have the same order.
    """
    kind = "struct<n:bigint,mark:struct<a:bigint,b:bigint>,sketch:array<int>,s:bigint,t:bigint>"

    @F.arrow_udf(kind)
    def sketch(texts: pa.Array) -> pa.Array:
        import xxhash

        sizes, marks, parts, signs = [], [], [], []
        for found in shingles(texts, words):
            sizes.append(len(found))
            digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
            marks.append({"a": int(digest[0]), "b": int(digest[1])})
            signs.append(signature(found))
            # Only as many distinct upper halves as are kept.
            halves = distinct((found[: 2 * KEPT] >> np.uint64(32)).astype(np.uint32))[:KEPT]
            parts.append((halves ^ np.uint32(1 << 31)).view(np.int32))
        mark = pa.array(marks, pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        s, t = (pa.array([sign[k] for sign in signs], pa.int64()) for k in (0, 1))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), mark, long_lists(parts, pa.int32()), s, t], ["n", "mark", "sketch", "s", "t"])

    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), sketch(docs["text"]).alias("_"))
    return found.select("row", "id", "_.*")


def frequent_values(rows: DataFrame) -> np.ndarray:
    """Rows (value, count) of the most frequent sketch values, by value; at most ``FREQUENT``.

    Counts are summed from those of Arrow batches with several occurrences.  They only order
    the lists: pairs are found whatever is counted here.
    """

    def count(batches):
        for batch in batches:
            values, counts = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            often = counts >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(values[often], pa.int32()), pa.array(counts[often], pa.int64())], ["value", "seen"])

    found = rows.select("sketch").mapInArrow(count, "value int, seen bigint").groupBy("value").agg(F.sum("seen").alias("seen"))
    top = found.orderBy(F.desc("seen"), "value").limit(FREQUENT).collect()
    return np.array(sorted((r["value"], r["seen"]) for r in top), np.int64).reshape(-1, 2)


def lists_of(rows: DataFrame, known: np.ndarray, percent: int) -> DataFrame:
    """Inverted lists with two members or more: ``value``, ``mark``, the smallest mark, ``center``, and whether the two may be linked (``near``).

    Values are sorted within tasks and streamed, so a list of any length is never held; the
    center has no row of its own.  Repeated marks of a batch are skipped, as copies need no lists.
    Values go in ``PASSES`` parts, the later ones when the shuffle of those before is gone.
    """

    @F.arrow_udf("array<int>")
    def prefix(sketches: pa.Array, sizes: pa.Array, marks: pa.Array) -> pa.Array:
        seen, parts = set(), []
        ends, values = sketches.offsets.to_numpy(), sketches.values.to_numpy()
        often = frequencies(values, known)
        for start, stop, size, mark in zip(ends[:-1], ends[1:], sizes.to_pylist(), marks.to_pylist(), strict=True):
            row = slice(start, start if mark in seen else stop)
            parts.append(values[row][np.lexsort((values[row], often[row]))[:size]])
            seen.add(mark)
        return long_lists(parts, pa.int32())

    def runs(batches):
        last = (None, *[0] * 7)  # value, center with its size and signature, and mark of the row before
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            value, x, y = columns[:3]
            if not len(value):
                continue
            place = np.arange(len(value))
            fresh = np.concatenate(([value[0] != last[0]], value[1:] != value[:-1]))
            start = np.maximum.accumulate(np.where(fresh, place, -1))
            center = [np.where(start < 0, last[k], c[start]) for k, c in enumerate(columns) if k]
            again = np.concatenate(([(x[0], y[0]) == last[6:]], (x[1:] == x[:-1]) & (y[1:] == y[:-1]))) & ~fresh
            out = ((x != center[0]) | (y != center[1])) & ~again
            last = (value[-1], *[c[-1] for c in center], x[-1], y[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in columns + center], names + firsts)

    chosen = prefix("sketch", prefix_size(F.size("sketch"), percent), F.col("mark")["a"])
    names, firsts = ["value", "x", "y", "n", "s", "t"], ["first_x", "first_y", "first_n", "first_s", "first_t"]
    values = rows.select(F.explode(chosen).alias("value"), F.col("mark")["a"].alias("x"), F.col("mark")["b"].alias("y"), "n", "s", "t")
    mark, center = F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("first_x").alias("a"), F.col("first_y").alias("b"))
    fits = sizes_allow(F.col("n"), F.col("first_n"), percent) & alike((F.col("s"), F.col("t")), (F.col("first_s"), F.col("first_t")), percent)
    parts = []
    for k in range(PASSES):
        ordered = values.where(F.pmod("value", F.lit(PASSES)) == k).repartition("value").sortWithinPartitions("value", "x", "y")
        found = ordered.mapInArrow(runs, "value int, " + ", ".join(f"{c} bigint" for c in names[1:] + firsts))
        parts.append(settle(found.select("value", mark.alias("mark"), center.alias("center"), fits.alias("near"))))
    lists = settle(reduce(DataFrame.union, parts))
    forget(*parts)
    return lists


def frequencies(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """How often each value was seen, 0 where that is unknown."""
    if not len(known):
        return np.zeros(len(values), np.int64)
    at = np.searchsorted(known[:, 0], values).clip(max=len(known) - 1)
    return np.where(known[at, 0] == values, known[at, 1], 0)


def prefix_size(size: Column, percent: int) -> Column:
    """How many of the rarest values of a sketch hold one of any linked sketch's."""
    return (size - least_shared(size, percent) + 1).cast("int")


def members_of(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """For each mark in a list, ``cls`` (its smallest doc_id), ``n``, signature and a ``row`` that has its sketch."""
    marks = lists.select("mark").union(lists.select(F.col("center").alias("mark"))).distinct()
    return settle(rows.join(marks, "mark").groupBy("mark").agg(F.min("id").alias("cls"), *[F.min(c).alias(c) for c in ("row", "n", "s", "t")]))


def sketches_of(marks: DataFrame, members: DataFrame, sketched: DataFrame) -> DataFrame:
    """``mark``, ``cls``, ``n`` and ``sketch`` of some members; the sieve keeps most other sketches from being shuffled."""
    asked = settle(members.join(marks.distinct(), "mark").select("row", "mark", "cls", "n"))
    sieve = sieve_of(asked.select(F.xxhash64("row").alias("seed")), ROW_BITS)

    @F.arrow_udf("boolean")
    def passing(seeds: pa.Array) -> pa.Array:
        return pa.array(in_sieve(sieve, seeds.to_numpy(), ROW_BITS))

    found = settle(sketched.select("row", "sketch").where(passing(F.xxhash64("row"))).join(asked, "row").select("mark", "cls", "n", "sketch"))
    forget(asked)
    return found


def sizes_allow(x: Column, y: Column, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def shared_enough(x: Column, y: Column, percent: int) -> Column:
    need = F.greatest(least_shared(F.size(x["sketch"]), percent), least_shared(F.size(y["sketch"]), percent))
    return F.size(F.array_intersect(x["sketch"], y["sketch"])) >= need


def placed_of(lists: DataFrame, members: DataFrame, joined: DataFrame) -> DataFrame:
    """``value``, ``mark``, ``n``, signature and ``component`` of all members of lists."""
    parts = members.select("mark", "n", "s", "t", "cls").join(joined.withColumnRenamed("id", "cls"), "cls", "left")
    parts = parts.select("mark", "n", "s", "t", F.coalesce("component", "cls").alias("component"))
    # A list has one row a member, and its center in each of them.
    everyone = lists.select("value", "mark").union(lists.select("value", "center").distinct())
    return settle(everyone.join(parts, "mark"))


def open_of(placed: DataFrame) -> DataFrame:
    """The lists that hold several components: ``value``, ``total``, and the largest component, ``main``, with its size."""
    sizes = placed.groupBy("value", "component").agg(
        F.count("*").alias("size"), F.bit_xor("mark.a").alias("a"), F.bit_xor("mark.b").alias("b")
    )
    mixed_lists = sizes.groupBy("value").agg(
        F.max_by("component", F.struct("size", "component")).alias("main"), F.max("size").alias("largest"), F.count("*").alias("parts"),
        F.sum("size").alias("total"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"),
    )
    # Lists of two are done: their pair was a star.  Lists with the same members are one.
    found = mixed_lists.where("parts > 1 and total > 2").groupBy("a", "b", "total").agg(F.min_by(F.struct("value", "main", "largest"), "value").alias("_"))
    return settle(found.select("_.*", "total"))


def delegates_of(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (``mark``, ``center``) of the members outside each list's largest component with ``DELEGATES`` of it, if their sizes and signatures allow a link."""
    open_lists = open_of(placed)
    found = settle(placed.join(open_lists.select("value", "main"), "value"))
    some = [F.min_by(F.struct("mark", "n", "s", "t"), F.xxhash64("mark", F.lit(k))) for k in range(DELEGATES)]
    centers = found.where("component = main").groupBy("value").agg(F.array_distinct(F.array(*some)).alias("centers"))
    pairs = found.where("component <> main").select("value", "mark", "n", "s", "t").join(centers, "value").select("mark", "n", "s", "t", F.explode("centers").alias("_"))
    pairs = pairs.where(alike((F.col("s"), F.col("t")), (F.col("_.s"), F.col("_.t")), percent))
    asked = settle(pairs.where(sizes_allow(F.col("n"), F.col("_.n"), percent)).select("mark", F.col("_.mark").alias("center")).distinct())
    forget(open_lists, found)
    return asked


def blocks_of(placed: DataFrame) -> DataFrame:
    """Members of lists that hold several components, by ``block``, with the ``main`` component and how many parts each side has.

    Lists of one main component mostly hold the same members.  Where that is so, they are one block, in which a
    pair meets once instead of in every list; where all their members together would make more pairs than
    the lists do, each list is a block.
    """
    cut = lambda n: F.ceil(n / CELL).cast("int")
    open_lists = open_of(placed)
    found = settle(placed.join(open_lists.select("value", "main"), "value").select("value", "main", "mark", "component", "n", "s", "t"))
    together = settle(found.select("main", "mark", "component", "n", "s", "t").distinct())
    outside, size = F.col("total") - F.col("largest"), F.col("total")
    apart = open_lists.groupBy("main").agg(F.sum(outside * size).alias("apart"))
    sides = together.groupBy("main").agg(F.count_if(F.col("component") != F.col("main")).alias("outside"), F.count("*").alias("size"))
    mains = settle(sides.join(apart, "main").select("main", (F.col("outside") * F.col("size") <= F.col("apart")).alias("one"), cut(F.col("outside")).alias("is"), cut(F.col("size")).alias("js")))
    whole = together.join(mains.where("one").drop("one"), "main").withColumn("block", F.xxhash64("main", F.lit(1)))
    lists = open_lists.join(mains.where("not one").select("main"), "main", "left_semi").select("value", cut(outside).alias("is"), cut(size).alias("js"))
    single = found.join(lists, "value").withColumn("block", F.xxhash64("value", F.lit(2)))
    columns = ["block", "main", "mark", "component", "n", "s", "t", "is", "js"]
    return whole.select(*columns).union(single.select(*columns))


def cells_of(placed: DataFrame, percent: int) -> DataFrame:
    """Members of blocks, dealt to cells (``block``, ``i``, ``j``).

    The members outside a block's main component (``left``) meet all of it (``right``); both
    sides are cut into parts of about ``CELL`` members, and each pair of parts is a cell.  Members
    whose size and signature allow no link in a cell are not in it.
    """
    most, mask = most_different(percent), np.uint64(0x1111111111111111)

    def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        bits = x.view(np.uint64)[:, None] ^ y.view(np.uint64)
        bits |= bits >> np.uint64(1)
        bits |= bits >> np.uint64(2)
        return np.bitwise_count(bits & mask)

    def linkable(data: pa.Table) -> pa.Table:
        data = data.combine_chunks()
        cell, n, s, t, component = (data.column(c).to_numpy() for c in ("key", "n", "s", "t", "component"))
        sides = {c: data.column(c).to_numpy(zero_copy_only=False).copy() for c in ("left", "right")}
        order = np.argsort(cell, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            x, y = rows[sides["left"][rows]], rows[sides["right"][rows]]
            fits = differing(s[x], s[y]) + differing(t[x], t[y]) <= most
            fits &= (component[x][:, None] != component[y]) & (np.minimum(n[x][:, None], n[y]) * 100 >= np.maximum(n[x][:, None], n[y]) * percent)
            sides["left"][x], sides["right"][y] = fits.any(axis=1), fits.any(axis=0)
        for c in ("left", "right"):
            data = data.set_column(data.schema.get_field_index(c), c, pa.array(sides[c]))
        return data.select(["block", "i", "j", "a", "b", "component", "left", "right"]).filter(pa.array(sides["left"] | sides["right"]))

    own_i, own_j = (F.pmod(F.xxhash64("mark", F.lit(k)), F.col(k)).cast("int") for k in ("is", "js"))
    found = blocks_of(placed).select(
        "block", "mark", "component", "n", "s", "t", (F.col("component") == F.col("main")).alias("in_main"), "is", "js", own_i.alias("own_i"), own_j.alias("own_j")
    )
    across = F.transform(F.sequence(F.lit(0), F.col("js") - 1), lambda j: F.struct(F.col("own_i").alias("i"), j.alias("j")))
    down = F.transform(F.sequence(F.lit(0), F.col("is") - 1), lambda i: F.struct(i.alias("i"), F.col("own_j").alias("j")))
    found = found.withColumn("cell", F.explode(F.when(F.col("in_main"), down).otherwise(F.array_union(across, down))))
    left, right = ~F.col("in_main") & (F.col("cell.i") == F.col("own_i")), F.col("cell.j") == F.col("own_j")
    cells = settle(
        found.select("block", "cell.i", "cell.j", "mark.a", "mark.b", F.col("component").cast("bigint").alias("component"), "n", "s", "t", left.alias("left"), right.alias("right"), F.xxhash64("block", "cell").alias("key"))
    )
    groups = max(1, -(-cells.count() // GROUP_ROWS))
    dealt = cells.withColumn("group", F.pmod("key", F.lit(groups))).groupBy("group")
    kind = "block bigint, i int, j int, a bigint, b bigint, component bigint, left boolean, right boolean"
    kept = dealt.applyInArrow(lambda data: linkable(data), kind)
    linkable_cells = settle(kept.select("block", F.struct("i", "j").alias("cell"), F.struct("a", "b").alias("mark"), "component", "left", "right"))
    forget(cells)
    return linkable_cells


def overlaps(sketches: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each sketch of ``left`` shares with each other one of ``right`` (places in ``sketches``)."""
    owner = np.repeat(np.arange(len(sketches)), [len(s) for s in sketches])
    _, column, seen = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    # Values of one member only are shared with nobody.
    place = np.cumsum(seen > 1) - 1
    kept = seen[column] > 1
    owner, column = owner[kept], place[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    found = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        run = slice(*np.searchsorted(column, (start, start + COLUMNS)))
        held = np.zeros((len(sketches), int(column[run][-1]) - start + 1), np.float32)
        held[owner[run], column[run] - start] = 1
        found += held[left] @ held[right].T
    return found


def union_sketches(sketches: np.ndarray, ends: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of sketches (places): how many values the sketch of their union has, and how many of these both hold."""
    kept, inside = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    none = np.int64(1) << 40
    for start in range(0, len(x), 2048):
        rows = slice(start, start + 2048)
        table = np.full((len(x[rows]), 2 * KEPT), none)
        for at, side in ((0, x[rows]), (KEPT, y[rows])):
            sizes = ends[side + 1] - ends[side]
            place = np.arange(KEPT)
            held = place < sizes[:, None]
            table[:, at : at + KEPT][held] = sketches[(ends[side][:, None] + place)[held]]
        table.sort(axis=1)
        known = table < none
        both = np.zeros_like(known)
        both[:, 1:] = (table[:, 1:] == table[:, :-1]) & known[:, 1:]
        rank = np.cumsum(known & ~both, axis=1)
        kept[rows] = np.minimum(rank[:, -1], KEPT)
        inside[rows] = (both & (rank <= kept[rows][:, None])).sum(axis=1)
    return kept, inside


def pairs_of_cells(cells: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes (``a``, ``b``) of different components whose sketches share enough and whose union sketch allows the similarity; ``members`` have sketches."""
    part = percent / 100

    def pairs(data: pa.Table) -> pa.Table:
        data = data.combine_chunks()
        cell, a, b, n, component, need = (data.column(c).to_numpy() for c in ("cell", "a", "b", "n", "component", "need"))
        is_left, is_right = (data.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
        lists = data.column("sketch").combine_chunks()
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        whole = np.diff(ends) == n
        # Rows of one mark go by the first of them, so that a pair of several lists leaves once.
        seen: dict[tuple[int, int], int] = {}
        first = np.array([seen.setdefault(m, i) for i, m in enumerate(zip(a.tolist(), b.tolist(), strict=True))], np.int64)
        order = np.argsort(cell, kind="stable")
        xs, ys = [], []
        for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            left, right = np.flatnonzero(is_left[rows]), np.flatnonzero(is_right[rows])
            x, y = rows[left][:, None], rows[right][None, :]
            # Two members that are both on both sides meet once.
            twice = is_right[x] & is_left[y] & ((a[x] > a[y]) | ((a[x] == a[y]) & (b[x] > b[y])))
            fits = (component[x] != component[y]) & ~twice
            fits &= np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent
            if fits.any():
                both = overlaps([values[ends[r] : ends[r + 1]] for r in rows], left, right)
                # Uncut sketches tell the similarity itself.
                fits &= (both >= np.maximum(need[x], need[y])) & (~(whole[x] & whole[y]) | (both * (100 + percent) >= percent * (n[x] + n[y])))
                i, j = np.nonzero(fits)
                i, j = rows[left[i]], rows[right[j]]
                kept, inside = union_sketches(values, ends, i, j)
                share = (n[i] + n[j]) / (1 + part)
                spread = np.sqrt(part * (1 - part) / kept * np.maximum(0.0, 1 - kept / share))
                fits = inside / kept >= part - SIGMAS * spread - 3 / kept
                xs.append(first[i[fits]])
                ys.append(first[j[fits]])
        x, y = (np.concatenate(p) if p else np.empty(0, np.int64) for p in (xs, ys))
        x, y = np.divmod(np.unique(x * len(a) + y), max(1, len(a)))
        return pa.table({"x": a[x], "x2": b[x], "y": a[y], "y2": b[y]})

    groups = max(1, -(-cells.count() // GROUP_ROWS))
    key = F.xxhash64("block", "cell")
    least = least_shared(F.size("sketch"), percent).cast("bigint")
    rows = cells.join(members.select("mark", "n", "sketch"), "mark").select(
        F.pmod(key, F.lit(groups)).alias("group"), key.alias("cell"), "mark.a", "mark.b", "n", "component", "left", "right", "sketch", least.alias("need")
    )
    found = rows.groupBy("group").applyInArrow(pairs, "x bigint, x2 bigint, y bigint, y2 bigint")
    mark = [F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("x", "x2"), ("y", "y2"))]
    distinct_pairs = found.select(mark[0].alias("mark"), mark[1].alias("center")).distinct()
    classes = members.select("mark", "cls")
    named = distinct_pairs.join(classes.withColumnRenamed("cls", "b"), "mark").join(classes.select(F.col("mark").alias("center"), F.col("cls").alias("a")), "center")
    return settle(named.select("a", "b"))


def estimated(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose union sketch allows the similarity."""
    part = percent / 100
    union = F.slice(F.array_sort(F.array_union("x.sketch", "y.sketch")), 1, KEPT)
    both = F.array_intersect("x.sketch", "y.sketch")
    kept = F.size(F.col("union"))
    inside = F.size(F.array_intersect("union", "both"))
    # Drawn without replacement from the union, of (x.n + y.n) / (1 + part) values at the limit.
    whole = (F.col("x.n") + F.col("y.n")) / (1 + part)
    spread = F.sqrt(F.lit(part * (1 - part)) / kept * F.greatest(F.lit(0.0), 1 - kept / whole))
    found = pairs.withColumns({"union": union, "both": both})
    found = found.where(inside / kept >= part - SIGMAS * spread - 3 / kept)
    return found.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets have the similarity.

    Only the texts of classes that stand in a pair are read into sets.
    """

    @F.arrow_udf("array<bigint>")
    def full(texts: pa.Array) -> pa.Array:
        return long_lists(list(shingles(texts, words)))

    asked = settle(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct())
    texts = docs.select(F.col("doc_id").alias("cls"), F.col("text").alias("_text")).join(asked, "cls")
    sets = settle(texts.select("cls", full("_text").alias("set")))
    shared, parts = F.size(F.array_intersect("x", "y")), []
    for k in range(PASSES):
        inside = F.pmod(F.xxhash64("a"), F.lit(PASSES)) == k
        left = pairs.where(inside).join(sets.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b")
        both = left.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("x")).where(inside), "a")
        parts.append(settle(both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct()))
    forget(asked, sets)
    return reduce(DataFrame.union, parts)


def links(lists: DataFrame, members: DataFrame, sketched: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The links from settled lists, members and sketches, all of which are forgotten."""
    member = F.struct("cls", "n", "sketch")
    x, y = F.col("x"), F.col("y")

    def linked(pairs: DataFrame) -> DataFrame:
        asked = sketches_of(pairs.select("mark").union(pairs.select("center")), members, sketched)
        half = pairs.join(asked.select("mark", member.alias("y")), "mark").select("center", "y")
        both = half.join(asked.select(F.col("mark").alias("center"), member.alias("x")), "center")
        both = both.where(sizes_allow(x["n"], y["n"], percent)).where(shared_enough(x, y, percent))
        near = settle(estimated(both, percent))
        forget(asked)
        found = confirmed(near, docs, words, percent)
        forget(near)
        return found

    def stars(joined: DataFrame) -> DataFrame:
        return joined.select(F.col("id").alias("a"), F.col("component").alias("b"))

    # Step one: every member with its list's center, each pair once.
    joined = components(linked(lists.where("near").select("mark", "center").distinct()))
    # Step two: members outside a list's largest component with some of it.
    placed = placed_of(lists, members, joined)
    pairs = delegates_of(placed, percent)
    forget(placed)
    joined = components(stars(joined).union(linked(pairs)))
    forget(pairs)
    # Step three: members of different components, each against all of its list but the largest component.
    placed = placed_of(lists, members, joined)
    forget(lists)
    cells = cells_of(placed, percent)
    forget(placed)
    asked = sketches_of(cells.select("mark"), members, sketched)
    forget(members, sketched)
    pairs = pairs_of_cells(cells, asked, percent)
    forget(asked, cells)
    return stars(joined).union(confirmed(pairs, docs, words, percent))


def components_of(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest doc_id reachable."""
    sketched = settle(sketches(docs, words))
    rows, has_set = settle(sketched.select("id", "n", "mark")), "id is not null and n > 0"
    lists = lists_of(sketched.where(has_set), frequent_values(sketched.where(has_set)), percent)
    members = members_of(sketched.where(has_set), lists)
    named = rows.where(has_set)
    found = links(lists, members, sketched, docs, words, percent)
    # Rows of equal sets are one class, named by the smallest doc_id.
    least = named.groupBy("mark").agg(F.min("id").alias("cls"), F.max("id").alias("last")).where("cls <> last").select("mark", "cls")
    own = named.select("id", "mark").join(least, "mark").where("id <> cls").select(F.col("id").alias("a"), F.col("cls").alias("b"))
    joined = components(found.union(own))
    out = rows.select("id", "n").join(joined, "id", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group: that with the group's smallest doc_id.

    Rows without a doc_id, or whose doc_id stands in several rows, go by a number from their text, above the
    usual ids; of those with equal texts one row stays, the smallest by its other columns.
    """
    kind = docs.schema["doc_id"].dataType
    kind = "bigint" if isinstance(kind, IntegralType) else kind
    number = (F.lit((1 << 63) - 1) - F.xxhash64("text").bitwiseAND((1 << 62) - 1)).cast(kind)
    again, own, gone = (fresh(name, docs) for name in ("again", "own", "gone"))
    repeated = settle(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(again)))
    has_own = F.col("doc_id").isNotNull() & F.col(again).isNull()
    marked = docs.join(repeated, F.col("doc_id") == F.col(again), "left").withColumn(own, F.when(has_own, F.col("doc_id").cast(kind)).otherwise(number))
    found = components_of(marked.select(F.col(own).alias("doc_id"), "text"), words, percent)
    dropped = settle(found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct())
    kept = marked.join(dropped, F.col(own) == F.col(gone), "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named, nameless = kept.where(has_own).select(*columns), kept.where(~has_own).select(*columns)
    filled = F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    rest = F.to_json(F.struct(*[c for c, n in zip(columns, docs.columns, strict=True) if n != "text"]))
    least = nameless.where(filled).groupBy("text").agg(F.min_by(F.struct(*columns), rest).alias("_")).select("_.*")
    return named.unionByName(nameless.where(~filled)).unionByName(least)
