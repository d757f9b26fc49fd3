"""Small helpers the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_CHARS = 1 << 20
#: What goes to a Python worker at once, where the session has Spark's own defaults.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
DEFAULTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": "67108864b"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of the session, whose texts lie twice in a JVM and twice in each of its workers; sizes the user chose stay."""
    for (key, default), size in zip(DEFAULTS.items(), (BATCH_ROWS, BATCH_BYTES), strict=True):
        if spark.conf.get(key) == default:
            spark.conf.set(key, str(size))


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(df[column], F.lit(""))


def fresh(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name += "_"
    return name


def crc_of_id(column: str = "doc_id") -> Column:
    """The crc32 of the id as text; that of a null id is 0 below mod 5 and 1 below mod 3, so such rows are held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(10).cast("bigint"))


def chunks(texts: pa.Array, rows: int = 256) -> Iterator[list[str]]:
    """The texts of an Arrow column in runs of bounded size; null becomes empty."""
    run, held = [], 0
    for text in texts:
        text = text.as_py() or ""
        if run and (held + len(text) > CHUNK_CHARS or len(run) >= rows):
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values with all bits well spread (a bijection)."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, each computed once while the store is small."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words; ``words`` are hashes."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    found = np.zeros(count, np.uint64)
    for i in range(size):
        found = mixed(found + words[i : i + count] + np.uint64(i + 1))
    return found


def long_lists(parts: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.ListArray:
    """One Arrow list a row."""
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))


def sieve_of(seeds: DataFrame, bits: int) -> np.ndarray:
    """The places of all seeds, 64 a number; the driver gets at most one row a number."""
    place = F.shiftrightunsigned("seed", 64 - bits)
    masks = seeds.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(seed, {64 - bits}) & 63))")).alias("mask"))
    found = masks.toArrow()
    sieve = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
    sieve[found.column("at").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return sieve


def in_sieve(sieve: np.ndarray, seeds: np.ndarray, bits: int) -> np.ndarray:
    """Which seeds have their place in the sieve."""
    places = seeds.view(np.uint64) >> np.uint64(64 - bits)
    return (sieve[places >> np.uint64(6)] >> (places & np.uint64(63)) & np.uint64(1)).astype(bool)
