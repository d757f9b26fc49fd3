"""Named text documents: rows of text concatenated into files, in two phases.

Writing: rows arrive sorted and cut into slices by range, so any number of tasks may write
one document.  A task streams its rows to numbered segments in an attempt folder of its own, with an
index of the documents they belong to, and reports one small message.  Nothing has its
final name yet: attempts that fail, are lost or run twice leave folders that no one reads.

Commit: the driver writes one record that names the attempts that count and the documents that
span tasks, with the offset of each of their segments, a prefix sum of byte lengths.  The
record gets its name by one rename; from then on the job has happened.

Publishing: a job of its own follows the record.  Segments of one document are copied to
their offsets, or streamed one after the other where the storage cannot write at an offset, and
every document gets its final name by one rename.  Each step can be repeated, so a lost executor
costs a retry, and :func:`publish` finishes what a lost driver left.  The working folder is then
deleted, as it is when the job is given up before its record.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from bindery.sources.storage import is_local, open_storage

COPY_BYTES = 8 << 20


def work_folder(base: str, job: str) -> str:
    return f"{base.rstrip('/')}/_writing-{job}"


def repo_folder(base: str, repo: str) -> str:
    name = quote(repo, safe=" ")
    return base.rstrip("/") + "/" + (name if name.strip(".") else name.replace(".", "%2E"))


@dataclass
class Written(WriterCommitMessage):
    """One attempt: how many segments it wrote, and (document, bytes) of the first and the last."""

    task: int
    attempt: str
    segments: int = 0
    first: tuple[tuple[str, str], int] | None = None
    last: tuple[tuple[str, str], int] | None = None


class Attempt:
    """The segments and the index of one attempt; at most one segment is open."""

    def __init__(self, storage: pafs.FileSystem, home: str, done: Written):
        self.storage, self.home, self.done = storage, home, done
        self.key, self.stream, self.index = None, None, None

    def add(self, key: tuple[str, str], text: pa.Buffer) -> None:
        if key != self.key:
            self.close_segment()
            if self.index is None:
                self.storage.create_dir(self.home, recursive=True)
                self.index = self.storage.open_output_stream(f"{self.home}/index")
            self.key = key
            self.stream = self.storage.open_output_stream(f"{self.home}/{self.done.segments:08d}")
        self.stream.write(text)

    def close_segment(self) -> None:
        if self.stream is None:
            return
        size = self.stream.tell()
        self.stream.close()
        self.stream = None
        self.index.write(json.dumps(self.key).encode() + b"\n")
        self.done.first = self.done.first or (self.key, size)
        self.done.last = (self.key, size)
        self.done.segments += 1

    def close(self) -> None:
        self.close_segment()
        if self.index is not None:
            self.index.close()

    def drop(self) -> None:
        for stream in (self.stream, self.index):
            if stream is not None:
                stream.close()
        if self.index is not None:
            self.storage.delete_dir(self.home)


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.job = options["job"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        storage, base = open_storage(self.path)
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        done = Written(task, f"{task:06d}-{uuid.uuid4().hex}")
        attempt = Attempt(storage, f"{work_folder(base, self.job)}/{done.attempt}", done)
        try:
            for batch in iterator:
                repos, docs, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("repo", "doc", "text"))
                for repo, doc, text in zip(repos.to_pylist(), docs.to_pylist(), texts):
                    attempt.add((repo, doc), text.as_buffer())
            attempt.close()
        except BaseException:
            attempt.drop()
            raise
        return done

    def commit(self, messages: list[Written | None]) -> None:
        storage, base = open_storage(self.path)
        work = work_folder(base, self.job)
        runs = sorted((m for m in messages if m and m.segments), key=lambda m: m.task)
        if not runs:
            return
        record = {"attempts": [m.attempt for m in runs], "joints": joints(runs)}
        with storage.open_output_stream(f"{work}/record.part") as stream:
            stream.write(json.dumps(record).encode())
        storage.move(f"{work}/record.part", f"{work}/record")

    def abort(self, messages: list[Written | None]) -> None:
        storage, base = open_storage(self.path)
        drop_folder(storage, work_folder(base, self.job))


def joints(runs: list[Written]) -> list[dict]:
    """Documents that span tasks with their segments (attempt, number, offset), in order.

    Tasks hold slices of one order, so only the last document of a task can go on in the next.
    """
    found: list[dict] = []
    key, parts, size = None, [], 0

    def keep() -> None:
        if len(parts) > 1:
            found.append({"key": key, "parts": parts, "size": size})

    for run in runs:
        (first, first_size), (last, last_size) = run.first, run.last
        if first == key:
            parts, size = parts + [(run.attempt, 0, size)], size + first_size
            if run.segments == 1:
                continue
        keep()
        key, parts, size = last, [(run.attempt, run.segments - 1, 0)], last_size
    keep()
    return found


class DocumentSink(DataSource):
    """``df.write.format("named_documents").mode("append").option("job", job).save(path)``, then :func:`publish`."""

    @classmethod
    def name(cls) -> str:
        return "named_documents"

    def schema(self) -> str:
        return "repo string, doc string, text string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options)


def drop_folder(storage: pafs.FileSystem, folder: str) -> None:
    if storage.get_file_info(folder).type == pafs.FileType.Directory:
        storage.delete_dir(folder)


def exists(storage: pafs.FileSystem, path: str) -> bool:
    return storage.get_file_info(path).type == pafs.FileType.File


def name_document(storage: pafs.FileSystem, source: str, target: str) -> None:
    """Rename; done already where the source is gone and the target is there."""
    try:
        storage.move(source, target)
    except OSError:
        if exists(storage, source) or not exists(storage, target):
            raise


def copy_at(storage: pafs.FileSystem, source: str, target: str, offset: int) -> None:
    """Copy a segment to its offset of a local file; doing it twice writes the same bytes."""
    place = os.open(target, os.O_WRONLY | os.O_CREAT, 0o666)
    try:
        with storage.open_input_stream(source) as stream:
            while data := stream.read(COPY_BYTES):
                view = memoryview(data)
                while view:
                    done = os.pwrite(place, view, offset)
                    view, offset = view[done:], offset + done
    finally:
        os.close(place)


def chain(storage: pafs.FileSystem, sources: list[str], target: str) -> None:
    """Stream segments one after the other into a file, which appears when it is whole."""
    with storage.open_output_stream(f"{target}.part") as out:
        for source in sources:
            with storage.open_input_stream(source) as stream:
                while data := stream.read(COPY_BYTES):
                    out.write(data)
    storage.move(f"{target}.part", target)


def publish(spark: SparkSession, path: str, job: str) -> None:
    """Give the documents of a committed job their names; may be called again after a failure."""
    storage, base = open_storage(path)
    work = work_folder(base, job)
    if not exists(storage, f"{work}/record"):
        drop_folder(storage, work)
        return
    with storage.open_input_stream(f"{work}/record") as stream:
        record = json.loads(stream.read())  # a few entries a task
    parts = [(k, i, a, n, at) for k, joint in enumerate(record["joints"]) for i, (a, n, at) in enumerate(joint["parts"])]
    if parts and is_local(storage):

        def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, _ = open_storage(path)
            for batch in batches:
                for row in batch.to_pylist():
                    target = f"{work}/joint-{row['joint']:06d}"
                    copy_at(store, f"{work}/{row['attempt']}/{row['segment']:08d}", target, row["at"])
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

        rows = spark.createDataFrame(parts, "joint int, part int, attempt string, segment int, at bigint")
        rows.repartition(len(parts), "joint", "part").mapInArrow(assemble, "n bigint").count()

    inside: dict[str, list[int]] = {}
    for _, _, attempt, segment, _ in parts:
        inside.setdefault(attempt, []).append(segment)
    tasks = [(a, None, inside.get(a, [])) for a in record["attempts"]]
    tasks += [(None, k, []) for k in range(len(record["joints"]))]
    joined = spark.sparkContext.broadcast([(j["key"], j["parts"]) for j in record["joints"]])  # an entry a task at most

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_storage(path)
        folders: set[str] = set()

        def give(key: list[str], source: str) -> None:
            folder = repo_folder(base, key[0])
            if folder not in folders:
                store.create_dir(folder, recursive=True)
                folders.add(folder)
            name_document(store, source, f"{folder}/{key[1]}")

        for batch in batches:
            for row in batch.to_pylist():
                if row["attempt"] is None:
                    key, segments = joined.value[row["joint"]]
                    source = f"{work}/joint-{row['joint']:06d}"
                    if not is_local(store) and not exists(store, source):
                        chain(store, [f"{work}/{a}/{n:08d}" for a, n, _ in segments], source)
                    give(key, source)
                    continue
                home, skipped = f"{work}/{row['attempt']}", set(row["inside"])
                with store.open_input_stream(f"{home}/index") as index:
                    for number, line in enumerate(lines_of(index)):
                        if number not in skipped:
                            give(json.loads(line), f"{home}/{number:08d}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = spark.createDataFrame(tasks, "attempt string, joint int, inside array<int>")
    rows.repartition(len(tasks), "attempt", "joint").mapInArrow(name, "n bigint").count()
    storage.delete_file(f"{work}/record")  # first: a folder without it is only ever deleted
    drop_folder(storage, work)


def lines_of(stream: pa.NativeFile) -> Iterator[bytes]:
    rest = b""
    while data := stream.read(COPY_BYTES):
        *lines, rest = (rest + data).split(b"\n")
        yield from lines


def write_sorted(rows: DataFrame, path: str) -> None:
    """Write rows as they are partitioned and sorted: a document's rows in order, in one partition or in neighbouring ones."""
    spark, job = rows.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(DocumentSink)
    columns = rows.select("repo", "doc", "text")
    columns.write.format("named_documents").option("job", job).mode("append").save(path)
    publish(spark, path, job)


def write_documents(rows: DataFrame, path: str, order: list[str], parts: int | None = None) -> None:
    """Each document as one file, whatever its length, written by as many tasks as its rows fill.

    Rows are cut by range over (repo, doc, order) and sorted (on disk where they are many); range
    partitioning samples its input first, so give it rows that are cheap to read twice.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["repo", "doc", *order]
    write_sorted(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys), path)
