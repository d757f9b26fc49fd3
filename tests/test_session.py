import time
from pathlib import Path

from bindery.session import CLEANUP_KEY, forget, settle


def shuffle_files(spark) -> set[str]:
    names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {n for n in names.split("\n") if "/shuffle_" in n}


def test_settled_tables_leave_no_shuffle_files(spark):
    before, usual = shuffle_files(spark), spark.conf.get(CLEANUP_KEY)
    found = settle(spark.range(1000).repartition(5, "id"))
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert spark.conf.get(CLEANUP_KEY) == usual
    assert found.count() == 1000


def test_forgotten_tables_are_deleted(spark):
    kept, gone = settle(spark.range(3)), settle(spark.range(4))
    forget(gone)
    places = [Path(t.settled_at.removeprefix("file:")) for t in (kept, gone)]
    assert [p.exists() for p in places] == [True, False]
    assert kept.count() == 3
