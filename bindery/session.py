"""Session helpers: a local session for tests, and reliable materialisation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Whether a query's shuffle files go when it ends, not when the driver next collects garbage.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", app: str = "bindery", **conf) -> SparkSession:
    """A single-machine session for tests and benches; clusters bring their own."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.memory": "12g",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.pythonUDF.arrow.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a folder of this application in the session's warehouse, which
    Spark itself requires to be shared, is set; it goes when the application ends.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if folder:
        return folder
    known = context.getCheckpointDir()
    if known:
        return known
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    folder = f"{warehouse}/_staging/{context.applicationId}"
    drop_at_end(spark, folder)
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def drop_at_end(spark: SparkSession, folder: str) -> None:
    """Have the folder's own file system delete it when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)


def settle(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, free of their lineage.

    Used where rows feed several jobs: later jobs read only the columns they
    need, a lost executor costs a re-read instead of a recomputation, and Spark
    knows the true size when it chooses joins.  The write's shuffle files go with the write, the
    table with the application or by :func:`forget`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/bindery-{uuid.uuid4().hex}"
    drop_at_end(spark, path)
    usual = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if usual is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, usual)
    found = spark.read.schema(df.schema).parquet(path)
    found.settled_at = path
    return found


def forget(*tables: DataFrame) -> None:
    """Delete settled tables that no one reads any more."""
    for found in tables:
        spark = found.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(found.settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pin(df: DataFrame) -> DataFrame:
    """The rows checkpointed as they are partitioned and sorted.

    Used where the partition of a row is part of the result; tables would cut and
    merge partitions when read.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
