"""Source trees on a file system.

Spark's file formats drop hidden and underscore names and empty files, which a
source tree is full of, so trees are listed here.  Directories are rows: each round, tasks open the
directories dealt to them and what lies below, and hand on what exceeds their share, which is dealt
anew.  A tree that holds most directories is so listed by all tasks, and the driver learns only
whether any are left.  Listing finds paths; contents are read later, for the paths that survive the filters.

Files up to ``RANGE_BYTES`` are read whole.  Longer ones are rows of byte ranges that are read by
different tasks: a range holds the lines that begin in it, so ranges end at line ends and are
decoded and counted on their own.  Their bytes are put together again where they fit a row
(``ROW_BYTES``).  Files that do not are counted from their ranges and hashed as a stream, so they are reported
with their facts like all others; only their texts are missing.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import re
import stat
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindery.functions import fixed, text
from bindery.operators import scan
from bindery.session import settle
from bindery.sources.storage import Storages, is_local, open_storage, root_of

#: ``kind`` is file or dir, or why something could not be listed; dirs are still to be opened.
LISTED = "repo string, root string, path string, rel_path string, uri string, size_bytes bigint, kind string, task int"
BATCH_ROWS = 10_000
BATCH_BYTES = 32 << 20
#: Entries that a task lists before it hands on the directories that are left.
SHARE = 20_000
RANGE_BYTES = 64 << 20
ROW_BYTES = 512 << 20
BLOCK_BYTES = 8 << 20


def list_dir(storage: pafs.FileSystem, folder: str) -> tuple[list[str], list[tuple[str, int]], list[tuple[str, str]]]:
    """Sub-directories, (file, size), and (path, reason) of what cannot be read; linked directories are left out."""
    if not is_local(storage):
        try:
            infos = storage.get_file_info(pafs.FileSelector(folder, recursive=False))
        except OSError:
            return [], [], [(folder, fixed.REASON_UNLISTED)]
        dirs = [i.path for i in infos if i.type == pafs.FileType.Directory]
        return dirs, [(i.path, i.size or 0) for i in infos if i.type == pafs.FileType.File], []
    dirs, found, failed = [], [], []
    try:
        entries = list(os.scandir(folder))
    except OSError:
        return [], [], [(folder, fixed.REASON_UNLISTED)]
    for entry in entries:
        try:
            if entry.is_dir(follow_symlinks=False):
                dirs.append(entry.path)
                continue
            info = entry.stat()
        except FileNotFoundError:  # a link to nothing is no file
            continue
        except OSError:
            failed.append((entry.path, fixed.REASON_READ))
            continue
        if stat.S_ISREG(info.st_mode):
            found.append((entry.path, info.st_size))
    return dirs, found, failed


def open_level(frontier: DataFrame, source: str, share: int = SHARE) -> DataFrame:
    """Rows of what lies in the directories of ``frontier`` (repo, root, path) and below them.

    A null root is a folder of trees: its sub-directories are the roots.  A task that has listed
    ``share`` entries hands its other directories on as rows of kind ``dir``.
    """
    schema = pa.schema(
        [(n, pa.string()) for n in ("repo", "root", "path", "rel_path", "uri")]
        + [("size_bytes", pa.int64()), ("kind", pa.string()), ("task", pa.int32())]
    )

    def name_of(root: str) -> str:
        return root.rstrip("/").rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        storage, plain = open_storage(source)
        uris, task = root_of(source, plain), TaskContext.get().partitionId()
        queue = deque((r["root"], r["path"]) for batch in batches for r in batch.to_pylist())
        rows: list[tuple] = []
        seen = 0

        def take() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        def row(root: str | None, path: str, kind: str, size: int | None = None) -> tuple:
            root = root or path
            inner = path[len(root.rstrip("/")) + 1 :] or "."
            return (name_of(root), root, path, inner, uris.uri(path), size, kind, task)

        while queue:
            root, folder = queue.popleft()
            if seen >= share:
                rows.append(row(root, folder, "dir"))
            else:
                dirs, found, failed = list_dir(storage, folder)
                seen += 1 + len(dirs) + len(found)
                queue.extend((root or d, d) for d in dirs)
                if root or failed:
                    rows.extend(row(root, path, reason) for path, reason in failed)
                if root:
                    rows.extend(row(root, path, "file", size) for path, size in found)
            if len(rows) >= BATCH_ROWS:
                yield take()
        if rows:
            yield take()

    return frontier.select("root", "path").mapInArrow(run, LISTED)


def list_levels(
    spark: SparkSession, path: str, many: bool = False, splits: int | None = None, share: int = SHARE
) -> list[DataFrame]:
    """The rounds of a listing, each a table of the shared folder."""
    n = splits or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = open_storage(path)[1].rstrip("/") or "/"
    frontier = spark.createDataFrame([(None if many else base, base)], "root string, path string")
    levels = []
    while True:
        level = settle(open_level(frontier, path, share))
        levels.append(level)
        frontier = level.where("kind = 'dir'").select("root", "path")
        if frontier.isEmpty():
            return levels
        frontier = frontier.repartition(n, "path")


def list_tree(
    spark: SparkSession, path: str, many: bool = False, splits: int | None = None, share: int = SHARE
) -> DataFrame:
    """Files below ``path`` as one tree, or one tree per sub-directory of it.

    ``failed`` is null, or the reason why a directory or an entry could not be read.
    """
    listed = reduce(DataFrame.unionByName, list_levels(spark, path, many, splits, share)).where("kind <> 'dir'")
    failed = F.when(F.col("kind") != "file", F.col("kind")).alias("failed")
    return listed.select("repo", "rel_path", "uri", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), failed)


def read_contents(listing: DataFrame) -> DataFrame:
    """Adds ``content`` bytes and ``read_ok`` by reading each ``uri``.

    A file whose first bytes show that it is binary is not read further.  One
    that cannot be read becomes a row with ``read_ok`` false; the job goes on.
    """
    schema = T.StructType(
        listing.schema.fields
        + [T.StructField("content", T.BinaryType()), T.StructField("read_ok", T.BooleanType())]
    )

    def read(batches):
        storages = Storages()
        for batch in batches:
            uris = batch.column(batch.schema.get_field_index("uri")).to_pylist()
            start, held, contents, oks = 0, 0, [], []
            for i, uri in enumerate(uris):
                try:
                    storage, path = storages.find(uri)
                    with storage.open_input_stream(path) as stream:
                        content = stream.read(fixed.SNIFF_BYTES)
                        if b"\x00" not in content:
                            content += stream.read(ROW_BYTES)
                            if len(content) > ROW_BYTES:
                                raise OSError(f"{uri} has grown beyond a row")
                    contents.append(content)
                    oks.append(True)
                    held += len(content)
                except OSError:
                    contents.append(None)
                    oks.append(False)
                if held >= BATCH_BYTES or i == len(uris) - 1:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays(
                        list(part.columns) + [pa.array(contents, pa.binary()), pa.array(oks, pa.bool_())],
                        names=part.schema.names + ["content", "read_ok"],
                    )
                    start, held, contents, oks = i + 1, 0, [], []

    return listing.mapInArrow(read, schema)


def range_rows(listing: DataFrame, size: int) -> DataFrame:
    """One row (part, offset, length) for each stretch of ``size`` bytes of every file."""
    offsets = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size_bytes") - 1, F.lit(0)), F.lit(size).cast("bigint"))
    parts = listing.select("*", F.posexplode(offsets).alias("part", "offset"))
    return parts.withColumn("length", F.least(F.lit(size), F.col("size_bytes") - F.col("offset")))


def line_end(stream: pa.NativeFile, at: int, size: int) -> int:
    """Where the line that holds byte ``at`` ends, behind its line feed."""
    while at < size:
        data = stream.read_at(min(BLOCK_BYTES, size - at), at)
        if not data:
            break
        found = data.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(data)
    return size


def read_ranges(ranges: DataFrame) -> DataFrame:
    """Adds ``content``, the lines that begin in each range, and ``read_ok``.

    The ranges of a file hold all its bytes, in order.  Lines that exceed a row make the range unreadable.
    """
    schema = T.StructType(ranges.schema.fields + [T.StructField("content", T.BinaryType()), T.StructField("read_ok", T.BooleanType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        storages = Storages()
        for batch in batches:
            for i, row in enumerate(batch.select(["uri", "offset", "length"]).to_pylist()):
                content, ok = None, True
                try:
                    storage, path = storages.find(row["uri"])
                    with storage.open_input_file(path) as stream:
                        size, start = stream.size(), row["offset"]
                        stop = start + row["length"]
                        start = line_end(stream, start - 1, size) if start else 0
                        stop = line_end(stream, stop - 1, size) if start < stop else start
                        if stop - start > ROW_BYTES:
                            raise OSError(f"{row['uri']} has a line beyond a row")
                        content = stream.read_at(stop - start, start) if stop > start else b""
                except OSError:
                    ok = False
                columns = batch.slice(i, 1).columns + [pa.array([content], pa.binary()), pa.array([ok])]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names + ["content", "read_ok"])

    return ranges.mapInArrow(read, schema)


class LineHash:
    """The hash of a text's lines joined by line feeds, fed with its bytes in pieces of any length."""

    ENDS = re.compile(r"\r\n|[" + "".join(text.OTHER_LINE_ENDS) + "]")

    def __init__(self, encoding: str):
        self.decoder = codecs.getincrementaldecoder(encoding)()
        self.digest, self.rest = hashlib.sha256(), ""

    def add(self, data: bytes, last: bool = False) -> None:
        known = self.rest + self.decoder.decode(data, last)
        # The end may be half of a line end, or the last line end, which does not count.
        keep = 0 if last else 2
        cut = max(len(known) - keep, 0)
        if known[cut - 1 : cut + 1] == "\r\n":
            cut -= 1
        done, self.rest = known[:cut], known[cut:]
        if last:
            done = self.ENDS.sub("\n", done).removesuffix("\n")
            self.digest.update(done.encode())
        else:
            self.digest.update(self.ENDS.sub("\n", done).encode())

    def hex(self) -> str:
        self.add(b"", last=True)
        return self.digest.hexdigest()


def hashed(files: DataFrame) -> DataFrame:
    """Adds ``sha256`` to rows with ``uri`` and ``valid`` (UTF-8), null where a file cannot be read; memory holds one block."""
    schema = T.StructType(files.schema.fields + [T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        storages = Storages()
        for batch in batches:
            found = []
            for row in batch.select(["uri", "valid"]).to_pylist():
                try:
                    state = LineHash("utf-8" if row["valid"] else "latin-1")
                    storage, path = storages.find(row["uri"])
                    with storage.open_input_stream(path) as stream:
                        while data := stream.read(BLOCK_BYTES):
                            state.add(data)
                    found.append(state.hex())
                except (OSError, UnicodeDecodeError):
                    found.append(None)
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(found, pa.string())], names=batch.schema.names + ["sha256"])

    return files.mapInArrow(run, schema)


def read_long(listing: DataFrame, range_bytes: int, row_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Files read by ranges: those that fit a row with ``content`` and ``read_ok``, and the facts of those that do not."""
    keys = ["repo", "rel_path", "category", "size_bytes", "uri"]
    ranges = range_rows(listing.select(*keys), range_bytes).repartition("uri", "part")
    content = F.col("content")
    fits = F.col("size_bytes") <= row_bytes
    known = F.try_validate_utf8(content.cast("string"))
    parts = settle(
        read_ranges(ranges).select(
            *keys, "part", "read_ok",
            F.when(fits, content).alias("content"),
            ((F.col("part") == 0) & text.looks_binary(content)).alias("binary"),
            known.isNotNull().alias("valid"),
            F.when(~fits, text.line_count(text.unify_line_ends(known))).alias("lines"),
            F.when(~fits, text.line_count(text.unify_line_ends(F.decode(content, "ISO-8859-1")))).alias("other_lines"),
        )
    )
    whole = (
        parts.where(fits)
        .groupBy(*keys)
        .agg(F.expr("listagg(content) within group (order by part)").alias("content"), F.min("read_ok").alias("read_ok"))
        .withColumn("content", F.when(F.col("read_ok"), F.coalesce("content", F.lit(b"").cast("binary"))))
        .withColumn("reason", F.lit(None).cast("string"))
    )
    facts = parts.where(~fits).groupBy(*keys).agg(
        F.min("read_ok").alias("read_ok"), F.max("binary").alias("binary"), F.min("valid").alias("valid"),
        F.sum("lines").alias("lines"), F.sum("other_lines").alias("other_lines"),
    )
    reason = F.when(~F.col("read_ok") | F.col("sha256").isNull(), fixed.REASON_READ).when(F.col("binary"), fixed.REASON_BINARY)
    counted = hashed(facts.repartition("uri")).withColumn("reason", reason)
    lines = F.when(F.col("valid"), F.col("lines")).otherwise(F.col("other_lines")).cast("int")

    def kept(value: Column) -> Column:
        return F.when(F.col("reason").isNull(), value)

    return whole, counted.select(
        "repo", "rel_path", "category", "reason", kept(lines).alias("line_count"), "size_bytes", kept(F.col("sha256")).alias("sha256"),
        kept(F.lit(0)).alias("added_lines"),
    )


@dataclass
class Scanned:
    """The outcome of a scan; one scan can serve several exports.

    ``files`` carries the texts, ``meta`` the same rows without them.  ``grown``
    names the files that redaction makes longer.  Files above ``row_bytes`` have facts but no text.
    """

    files: DataFrame
    meta: DataFrame
    skips: DataFrame
    grown: DataFrame
    row_bytes: int | None = None


def from_judged(judged: DataFrame, facts: DataFrame | None = None, row_bytes: int | None = None) -> Scanned:
    """``facts`` are ledger rows of files whose texts do not fit a row."""
    ledger = scan.ledger(judged)
    if facts is not None:
        ledger = ledger.unionByName(facts.select([F.col(f.name).cast(f.dataType) for f in ledger.schema]))
    rows = settle(ledger)
    kept = rows.where(F.col("reason").isNull())
    grown = kept.where(F.col("added_lines") > 0).select("repo", "rel_path")
    return Scanned(scan.finish(judged), scan.meta(kept), scan.count_reasons(rows), grown, row_bytes)


def scan_listing(
    listing: DataFrame, skip_secrets: bool = True, rules: DataFrame | None = None
) -> Scanned:
    """Scan a table of files; its contents stay where they are.

    Without ``rules`` the root ignore files among the rows count, as they do for trees.
    """
    rules = scan.ignore_rules(listing) if rules is None else rules
    return from_judged(scan.judge(scan.with_reason(listing, skip_secrets, rules)))


def scan_tree(
    spark: SparkSession,
    path: str,
    many: bool = False,
    skip_secrets: bool = True,
    splits: int | None = None,
    range_bytes: int = RANGE_BYTES,
    row_bytes: int = ROW_BYTES,
) -> Scanned:
    """Scan trees on disk.  Only paths that pass the filters are opened, once each.

    Trees are made of many small files, so what was read is stored as a table.
    """
    listing = list_tree(spark, path, many, splits)
    found = listing.where(F.col("failed").isNull() & (F.col("rel_path") == ".gitignore"))
    rules = scan.ignore_rules(read_contents(found))
    reasoned = scan.with_reason(listing, skip_secrets, rules)
    reasoned = settle(reasoned.withColumn("reason", F.coalesce("failed", "reason")).drop("failed"))
    # Survivors are spread by name, so readers share the work whatever the layout.
    survivors = reasoned.where(F.col("reason").isNull())
    long = F.col("size_bytes") > range_bytes
    read = scan.judge(read_contents(survivors.where(~long).repartition("uri")))
    content = F.when(F.col("reason").isNull(), F.col("content")).alias("content")
    left_out = reasoned.where(F.col("reason").isNotNull())
    columns = ["repo", "rel_path", "category", "reason", "size_bytes"]
    judged = read.select(*columns, content).unionByName(
        left_out.select(*columns, F.lit(None).cast("binary").alias("content"))
    )
    facts = None
    if not survivors.where(long).isEmpty():
        whole, facts = read_long(survivors.where(long), range_bytes, row_bytes)
        judged = judged.unionByName(scan.judge(whole).select(*columns, content))
    return from_judged(settle(judged), facts, row_bytes)
