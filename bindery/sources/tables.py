"""Corpus tables: parquet tables read as listed files.

A listing has ``repo, rel_path, content`` with ``content`` a string or binary
column; ``size_bytes`` and ``read_ok`` are optional.  Column pruning and filters
reach the parquet scan because the adapters are plain projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import paths

# How a document number becomes a path.
DIRS = (
    "src|src/core|lib|docs|app/models|node_modules/pkg|build|exported_sources_old|tests||src/core/io"
).split("|")
SUFFIXES = ".py .ts .js .kt .swift .html .sh .dart .md .json .xyz .PY .swp".split()
SPECIALS = (
    "Dockerfile package.json package-lock.json tsconfig.json .env .env.json build.gradle.kts Makefile"
).split()
SPECIAL_EVERY = 17


def _pick(words, number: Column) -> Column:
    return F.get(paths.literal_words(words), (number % len(words)).cast("int"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of one tree per source."""
    number = F.col("doc_id")
    home = _pick(DIRS, number)
    home = F.when(home != "", home)
    special = _pick(SPECIALS, F.floor(number / SPECIAL_EVERY))
    name = F.concat(F.lit("f"), number, _pick(SUFFIXES, number))
    path = F.when(
        number % SPECIAL_EVERY == 0,
        F.concat_ws("/", home, F.concat(F.lit("d"), number), special),
    ).otherwise(F.concat_ws("/", home, name))
    return spark.read.parquet(f"{folder}/documents.parquet").select(
        F.col("source").alias("repo"), path.alias("rel_path"), F.col("text").alias("content")
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Web pages as files of one tree per host."""
    host = F.parse_url(F.col("url"), F.lit("HOST"))
    return spark.read.parquet(f"{folder}/pages.parquet").select(
        host.alias("repo"),
        F.concat(F.lit("pages/p"), F.col("page_id"), F.lit(".html")).alias("rel_path"),
        F.col("html").alias("content"),
    )


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as files of one single tree."""
    path = F.concat(
        F.lit("chat/c"), F.col("conv_id"), F.lit("/t"), F.col("turn"), F.lit("_"), F.col("role"), F.lit(".md")
    )
    return spark.read.parquet(f"{folder}/conversations.parquet").select(
        F.lit("chat").alias("repo"), path.alias("rel_path"), F.col("text").alias("content")
    )


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items as files of one single tree."""
    return spark.read.parquet(f"{folder}/benchmark.parquet").select(
        F.lit("bench").alias("repo"),
        F.concat(F.lit("docs/b"), F.col("item_id"), F.lit(".txt")).alias("rel_path"),
        F.col("text").alias("content"),
    )


def everything(spark: SparkSession, folder: str) -> DataFrame:
    """All text tables as one corpus of many trees."""
    return (
        documents(spark, folder)
        .unionByName(pages(spark, folder))
        .unionByName(conversations(spark, folder))
        .unionByName(benchmark(spark, folder))
    )


def with_ignore_files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents plus one root ignore file per tree, derived from the tree."""
    listing = documents(spark, folder)
    numbers = spark.read.parquet(f"{folder}/documents.parquet").groupBy("source").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high")
    )
    text = F.concat_ws(
        "\n",
        F.lit("# written for this tree"),
        F.lit("*.html"),
        F.lit("/docs/"),
        F.concat(F.lit("f"), F.col("low"), F.lit(".*")),
        F.lit("src/**/io"),
        F.lit("!*.dart"),
        F.lit(""),
        F.concat(F.lit("**/f"), F.col("high"), F.lit(".[a-z]*")),
        F.lit("tests/f?[13579]*"),
        F.lit("\\#odd"),
    )
    ignore = numbers.select(
        F.col("source").alias("repo"), F.lit(".gitignore").alias("rel_path"), text.alias("content")
    )
    return listing.unionByName(ignore)
