"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are hashed by direction, each scaled by its own norm (one norm for all would crowd
short vectors into few buckets).  Long vectors have large inner products from far directions
too, so those with the largest norms are candidates of every query.  Each table cuts several
Gaussian projections into intervals of one width; the intervals of a vector name its bucket.  A
query visits its own bucket and perturbed ones (each projection one interval down or up),
those first that are most likely to hold neighbours: by the summed squared distance to
the visited intervals.  Candidates of all tables are ranked by exact inner products.

Buckets are dealt to blocks of bounded size (large buckets are split), and queries travel
to the blocks they probe; a block keeps the best few of each of its queries, so candidate
pairs never become rows.  Equal vectors are one class, searched once.  Queries that found
fewer than they ask for, though there are more vectors, are compared with all.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id or with another length than most vectors have (of equally frequent lengths the
larger counts).  An empty table has no result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.session import settle

TABLES, PROJECTIONS, WIDTH, PROBES = 8, 6, 1.5, 100
#: Vectors of a block, and queries that meet one copy of a block.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 16_384
SALTS = 256
#: Vectors with the largest norms that every query meets, give or take the error of a quantile.
HEAD = 1024
#: Table numbers of the largest vectors and of the comparison with all.
LARGEST, ALL = -1, -2


class Hashing:
    """The hash tables for vectors of one length; the seed alone fixes them."""

    def __init__(self, dimensions: int, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, probes: int = PROBES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tables, self.projections, self.width = tables, projections, width
        self.lines = rng.standard_normal((dimensions + 1, tables * projections))[:dimensions]
        self.offsets = rng.uniform(0, 1, tables * projections)
        self.steps = np.array(list(itertools.product((-1, 0, 1), repeat=projections)), np.int64)
        self.probes = min(probes, len(self.steps))

    def intervals(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.lines / self.width + self.offsets).reshape(len(vectors), self.tables, self.projections)

    @staticmethod
    def codes(cells: np.ndarray) -> np.ndarray:
        """One number for each row of interval numbers."""
        code = np.zeros(cells.shape[:-1], np.int64)
        for i in range(cells.shape[-1]):
            code = code * np.int64(1_000_003) + cells[..., i].astype(np.int64)
        return code & np.int64((1 << 40) - 1)

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        return self.codes(np.floor(self.intervals(vectors)))

    def probed(self, vectors: np.ndarray) -> np.ndarray:
        """The buckets each vector visits in each table, the likeliest first."""
        places = self.intervals(vectors)
        cells = np.floor(places)
        inside = places - cells
        cost = np.zeros((*inside.shape[:2], len(self.steps)))
        for i in range(self.projections):
            step = self.steps[:, i]
            cost += np.where(step < 0, inside[..., i : i + 1] ** 2, np.where(step > 0, (1 - inside[..., i : i + 1]) ** 2, 0.0))
        order = np.argsort(cost, axis=-1, kind="stable")[..., : self.probes]
        return self.codes(cells[:, :, None, :] + self.steps[order])


def matrix(lists: pa.Array) -> np.ndarray:
    """Arrow lists of equal length as rows."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def directions(vectors: np.ndarray) -> np.ndarray:
    """The vectors scaled to norm 1; the first division keeps squares in range."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def clean(vectors: DataFrame, query: Column) -> DataFrame:
    """``id``, ``vec``, ``is_query`` and the class key of all rows that take part."""
    vec = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("id"), vec.alias("vec"), F.coalesce(query, F.lit(False)).alias("is_query"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("id is not null and vec is not null").where(finite & F.exists("vec", lambda x: x != 0))
    return rows.withColumn("key", F.struct(F.xxhash64("vec").alias("a"), F.xxhash64("vec", F.lit(1)).alias("b")))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: its smallest id, its ``k + 1`` smallest ids (no more can be among a query's nearest), and whether it is a query.

    Ids are gathered in two steps, so copies of one vector are spread over tasks.
    """
    salted = rows.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(
        F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids"), F.first("vec").alias("vec"), F.max("is_query").alias("is_query")
    )
    found = salted.groupBy("key").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"), F.first("vec").alias("vec"), F.max("is_query").alias("is_query")
    )
    return found.select("key", F.col("ids")[0].alias("cls"), "ids", "vec", "is_query")


def best_in_block(k: int):
    """For a block and the queries that probe it: each query's ``k + 1`` best classes."""
    schema = pa.schema([("cls", pa.int64()), ("found", pa.list_(pa.struct([("score", pa.float64()), ("cls", pa.int64())])))])

    def search(data: pa.Table, queries: pa.Table) -> pa.Table:
        ids, scores, near = [], [], []
        if data.num_rows and queries.num_rows:
            points, owners = matrix(data.column("vec")), data.column("cls").to_numpy()
            buckets, place = np.unique(data.column("code").to_numpy(), return_inverse=True)
            probes = queries.column("codes").combine_chunks()
            asked = np.repeat(np.arange(len(probes)), np.diff(probes.offsets.to_numpy()))
            codes = probes.flatten().to_numpy()
            at = np.searchsorted(buckets, codes).clip(max=len(buckets) - 1)
            hit = buckets[at] == codes
            allowed = np.zeros((len(probes), len(buckets)), bool)
            allowed[asked[hit], at[hit]] = True
            wanted, asking = matrix(queries.column("vec")), queries.column("cls").to_numpy()
            slack = 1e-12 * np.linalg.norm(wanted, axis=1) * np.linalg.norm(points, axis=1).max()
            for start in range(0, len(wanted), 256):
                rows = slice(start, start + 256)
                values = wanted[rows] @ points.T
                values[~allowed[rows][:, place]] = -np.inf
                # The value of place 2 k + 2, less what another order of sums may change; all at or above it are rated.
                last = min(2 * k + 2, values.shape[1]) - 1
                least = -np.partition(-values, last, axis=1)[:, last] - slack[rows]
                for i in range(len(values)):
                    best = np.flatnonzero((values[i] >= least[i]) & (values[i] > -np.inf))
                    if len(best):
                        # One way to sum, so that a pair has the same score in every block.
                        exact = (points[best] * wanted[start + i]).sum(axis=1)
                        order = np.lexsort((owners[best], -exact))[: k + 1]
                        ids.append(int(asking[start + i]))
                        scores.append(exact[order])
                        near.append(owners[best][order])
        ends = pa.array(np.cumsum([0, *map(len, near)]).astype(np.int32))
        flat = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(np.concatenate(near) if near else [], pa.int64())], ["score", "cls"]
        )
        return pa.table([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(ends, flat)], schema=schema)

    return search


def lists_of(data: DataFrame, asked: DataFrame, classes: DataFrame, k: int, times: int) -> DataFrame:
    """For each query class ``best``, the ids of its best classes in order; a class meets a query ``times`` times at most."""
    keys = ["tab", "block", "part", "copy"]
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        best_in_block(k), "cls bigint, found array<struct<score:double,cls:bigint>>"
    )
    # The best of all blocks; a block gives at most k + 1.
    every = F.transform(F.flatten(F.collect_list("found")), lambda f: F.struct((-f["score"]).alias("less"), f["cls"].alias("near")))
    best = F.slice(F.array_distinct(F.slice(F.sort_array(every), 1, (k + 1) * times)), 1, k + 1)
    best = found.groupBy("cls").agg(best.alias("best")).select("cls", F.explode("best").alias("_")).select("cls", "_.less", "_.near")
    members = best.join(classes.select(F.col("cls").alias("near"), "ids"), "near").select("cls", "less", F.explode("ids").alias("id"))
    return members.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("less", "id"))).alias("best"))


def search(vectors: DataFrame, query: Column, k: int = 20, **parameters) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the nearest found of each query row of ``vectors``.

    Columns ``vec_id`` and ``embedding`` are read; ``query`` marks the rows that ask.
    """
    rows = clean(vectors, query)
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vec") == length["n"])
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    # Equal norms differ a little, so that a quantile can part them.
    weight = norm * (1 + 1e-9 * F.pmod(F.xxhash64("cls"), F.lit(1_000_003)) / 1_000_003)
    classes = settle(classes_of(rows, k).withColumn("weight", weight))
    facts = classes.agg(F.count("*").alias("n"), F.count_if("is_query").alias("queries"), F.sum(F.size("ids")).alias("ids")).first()
    hashing = Hashing(length["n"], **parameters)
    above = -1.0
    if facts["n"] > HEAD:
        accuracy = min(1_000_000, max(10_000, 4 * facts["n"] // HEAD))
        above = classes.agg(F.percentile_approx("weight", 1 - HEAD / facts["n"], accuracy)).first()[0]

    @F.arrow_udf("array<bigint>")
    def buckets(batch: pa.Array) -> pa.Array:
        found = hashing.buckets(directions(matrix(batch)))
        return pa.array(list(found), pa.list_(pa.int64()))

    @F.arrow_udf("array<array<bigint>>")
    def probed(batch: pa.Array) -> pa.Array:
        out = []
        for start in range(0, len(batch), 256):
            out += [list(p) for p in hashing.probed(directions(matrix(batch.slice(start, 256))))]
        return pa.array(out, pa.list_(pa.list_(pa.int64())))

    blocks = max(1, -(-facts["n"] // BLOCK_ROWS))
    copies = 1 + facts["queries"] // BLOCK_QUERIES
    block = F.pmod(F.xxhash64("code"), F.lit(blocks)).alias("block")
    every_query = [F.lit(LARGEST).alias("tab"), F.lit(0).cast("bigint").alias("code")]
    data = classes.select("cls", F.posexplode(buckets("vec")).alias("tab", "code"))
    data = settle(data.union(classes.where(F.col("weight") > above).select("cls", *every_query)))
    # Buckets over the size of a block are split; there are few, as each holds many rows.
    large = data.groupBy("tab", "code").count().where(F.col("count") > BLOCK_ROWS)
    large = settle(large.select("tab", "code", F.ceil(F.col("count") / BLOCK_ROWS).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    data = data.join(large, ["tab", "code"], "left").withColumn("part", F.pmod(F.xxhash64("cls"), parts)).drop("parts")
    data = data.join(classes.select("cls", F.col("vec").cast("array<double>").alias("vec")), "cls")
    data = data.select("tab", block, "part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "code", "cls", "vec")
    asking = classes.where("is_query")
    asked = asking.select("cls", F.posexplode(probed("vec")).alias("tab", "codes")).select("cls", "tab", F.explode("codes").alias("code"))
    asked = asked.union(asking.select("cls", *every_query))
    asked = asked.join(large, ["tab", "code"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    asked = asked.groupBy("cls", "tab", block, "part").agg(F.collect_set("code").alias("codes"))
    asked = asked.withColumn("copy", F.pmod(F.xxhash64("cls"), F.lit(copies)).cast("int")).join(asking.select("cls", "vec"), "cls")
    lists = settle(lists_of(data, asked, classes, k, hashing.tables + 1))
    # Those with fewer than their own and k others, compared with all.
    short = asking.select("cls", "vec").join(lists.select("cls", F.size("best").alias("n")), "cls", "left")
    short = settle(short.where(F.coalesce("n", F.lit(0)) < min(k + 1, facts["ids"])).select("cls", "vec"))
    missing = short.count()
    if missing:
        copies = 1 + missing // BLOCK_QUERIES
        place = [F.lit(ALL).alias("tab"), F.lit(0).cast("bigint").alias("part")]
        data = classes.select(
            *place, F.pmod(F.xxhash64("cls"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"),
            F.lit(0).cast("bigint").alias("code"), "cls", "vec",
        )
        asked = short.select(
            *place, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"),
            F.pmod(F.xxhash64("cls"), F.lit(copies)).cast("int").alias("copy"), F.array(F.lit(0).cast("bigint")).alias("codes"), "cls", "vec",
        )
        lists = lists.join(short, "cls", "left_anti").union(lists_of(data, asked, classes, k, 1))
    owners = rows.where("is_query").select("id", "key").distinct().join(classes.select("key", "cls"), "key").select(F.col("id").alias("query_id"), "cls")
    own = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    out = owners.join(lists, "cls").select("query_id", F.posexplode(own).alias("_at", "_"))
    return out.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_.id").alias("vec_id"), (-F.col("_.less")).alias("score"))
