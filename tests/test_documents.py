"""The two phases of the document sink: what fails, is lost or is repeated leaves no trace."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from bindery.sources import documents
from bindery.sources.documents import DocumentSink, DocumentWriter, Written

ROOT = Path(__file__).resolve().parent.parent
SCHEMA = "repo string, doc string, n int, text string"


def batch(*rows):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["repo", "doc", "text"])


def contents(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in sorted(folder.rglob("*")) if p.is_file()}


def staged(spark, rows, path, n, job):
    """The first phase alone."""
    spark.dataSource.register(DocumentSink)
    placed = rows.repartitionByRange(n, "repo", "doc", "n").sortWithinPartitions("repo", "doc", "n")
    placed.select("repo", "doc", "text").write.format("named_documents").option("job", job).mode("append").save(str(path))


def test_one_document_of_a_million_lines_is_written_by_many_tasks(spark, tmp_path):
    tree = spark.range(1_000_000).select(
        F.lit("big").alias("repo"), F.lit("tree.txt").alias("doc"), F.col("id").cast("int").alias("n"),
        F.format_string("├── f%07d é\n", "id").alias("text"),
    )
    small = spark.createDataFrame([("a", "x", 0, "first"), ("z", "y", 0, "last")], SCHEMA)
    staged(spark, tree.union(small), tmp_path, 6, "j1")
    record = documents.json.loads((tmp_path / "_writing-j1" / "record").read_text())
    (joint,) = record["joints"]
    assert joint["key"] == ["big", "tree.txt"] and len({a for a, _, _ in joint["parts"]}) >= 4
    assert [p.name for p in tmp_path.iterdir()] == ["_writing-j1"]
    documents.publish(spark, str(tmp_path), "j1")
    want = "".join(f"├── f{i:07d} é\n" for i in range(1_000_000)).encode()
    assert (tmp_path / "big" / "tree.txt").read_bytes() == want and joint["size"] == len(want)
    documents.write_documents(tree, str(tmp_path / "one"), ["n"], parts=1)
    assert (tmp_path / "one" / "big" / "tree.txt").read_bytes() == want
    assert (tmp_path / "a" / "x").read_text() == "first" and not (tmp_path / "_writing-j1").exists()


def test_publishing_can_stop_anywhere_and_be_repeated(spark, tmp_path):
    rows = [("r", f"d{i:02d}", j, f"{i}.{j}\n") for i in range(9) for j in range(40)]
    want = {f"r/d{i:02d}": "".join(f"{i}.{j}\n" for j in range(40)) for i in range(9)}
    staged(spark, spark.createDataFrame(rows, SCHEMA), tmp_path, 5, "j")
    work = tmp_path / "_writing-j"
    record = documents.json.loads((work / "record").read_text())
    assert record["joints"]
    # An earlier call got as far as one copy, one whole document and one joint document.
    attempt, number, at = record["joints"][0]["parts"][1]
    documents.copy_at(pafs.LocalFileSystem(), f"{work}/{attempt}/{number:08d}", f"{work}/joint-000000", at)
    inside = {(a, n) for j in record["joints"] for a, n, _ in j["parts"]}
    index = (work / record["attempts"][0] / "index").read_text().splitlines()
    number = next(n for n in range(len(index)) if (record["attempts"][0], n) not in inside)
    (tmp_path / "r").mkdir()
    (work / record["attempts"][0] / f"{number:08d}").rename(tmp_path / "r" / documents.json.loads(index[number])[1])
    documents.publish(spark, str(tmp_path), "j")
    assert contents(tmp_path) == want
    documents.publish(spark, str(tmp_path), "j")
    assert contents(tmp_path) == want


def test_segments_are_chained_where_storage_cannot_write_at_an_offset(tmp_path):
    storage = pafs.LocalFileSystem()
    for i in range(3):
        (tmp_path / f"s{i}").write_text(f"part {i};")
    documents.chain(storage, [f"{tmp_path}/s{i}" for i in range(3)], f"{tmp_path}/all")
    assert (tmp_path / "all").read_text() == "part 0;part 1;part 2;"


def test_a_failed_attempt_leaves_nothing_and_its_retry_counts_once(spark, tmp_path):
    writer = DocumentWriter({"path": str(tmp_path), "job": "j"})

    def breaking():
        yield batch(("r", "a", "1"), ("r", "b", "2"))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(breaking())
    assert contents(tmp_path) == {}
    unread = writer.write(iter([batch(("r", "a", "1"), ("r", "b", "2"))]))  # finished, but its message was lost
    retried = writer.write(iter([batch(("r", "a", "1")), batch(("r", "b", "2"), ("r", "b", "3"))]))
    assert unread.attempt != retried.attempt
    writer.commit([None, retried])
    documents.publish(spark, str(tmp_path), "j")
    assert contents(tmp_path) == {"r/a": "1", "r/b": "23"}


def test_a_job_given_up_leaves_nothing(spark, tmp_path):
    writer = DocumentWriter({"path": str(tmp_path), "job": "j"})
    done = writer.write(iter([batch(("r", "a", "1"), ("s", "b", "2"))]))
    writer.abort([done, None])
    assert list(tmp_path.iterdir()) == []

    rows = spark.createDataFrame([("r", f"d{i}", 0, "x") for i in range(20)], SCHEMA).coalesce(1)

    def failing(batches):
        for part in batches:
            yield part.slice(0, 5)
            raise RuntimeError("after the first documents")

    with pytest.raises(Exception, match="after the first documents"):
        documents.write_sorted(rows.mapInArrow(failing, SCHEMA), str(tmp_path))
    assert contents(tmp_path) == {}


def test_an_empty_job_writes_nothing(spark, tmp_path):
    documents.write_documents(spark.createDataFrame([], SCHEMA), str(tmp_path), ["n"])
    assert list(tmp_path.iterdir()) == []


def test_joints_are_prefix_sums_over_neighbouring_tasks():
    a, b, c = ("r", "a"), ("r", "b"), ("r", "c")
    runs = [Written(0, "t0", 2, (a, 3), (b, 5)), Written(1, "t1", 1, (b, 7), (b, 7)), Written(3, "t3", 2, (b, 1), (c, 4)), Written(4, "t4", 1, (c, 2), (c, 2))]
    assert documents.joints(runs) == [
        {"key": b, "parts": [("t0", 1, 0), ("t1", 0, 5), ("t3", 0, 12)], "size": 13},
        {"key": c, "parts": [("t3", 1, 0), ("t4", 0, 4)], "size": 6},
    ]


KILLED = """
import os, sys
from pathlib import Path
from pyspark import TaskContext
from bindery.session import local_session
from bindery.sources import documents
out = sys.argv[1]
spark = local_session("2,3", **{"spark.sql.shuffle.partitions": "2"})
rows = spark.createDataFrame([("r", f"d{i}", 0, f"text {i}") for i in range(6)], "repo string, doc string, n int, text string")

def dying(batches):
    for part in batches:
        for i in range(part.num_rows):
            yield part.slice(i, 1)
            if TaskContext.get().attemptNumber() == 0 and i == 2:
                os._exit(1)

documents.write_sorted(rows.coalesce(1).mapInArrow(dying, rows.schema), out)
print(sorted((p.name, p.read_text()) for p in Path(out).rglob("*") if p.is_file()))
"""


def test_a_killed_task_is_retried_without_partial_or_doubled_files(tmp_path):
    run = subprocess.run(
        [sys.executable, "-c", KILLED, str(tmp_path / "out")], cwd=tmp_path, env={**documents.os.environ, "PYTHONPATH": str(ROOT)},
        capture_output=True, text=True, timeout=180,
    )
    assert run.returncode == 0, run.stderr[-2000:]
    assert run.stdout.strip().splitlines()[-1] == str([(f"d{i}", f"text {i}") for i in range(6)])
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["r"]
