"""The registered queries of this folder; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm import ann, chat, collocations, decontaminate, langid, licenses, minhash, mixing, pieces, secret_scan, sharding, spelling, toxicity
from bindery.llm.common import crc_of_id, table, text_of
from bindery.llm.oracle import ORACLE_SQL  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


@query
def op1_secret_scan(spark, folder):
    found = secret_scan.scan(table(spark, folder, "documents"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*secret_scan.BASE))
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = {k: (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in secret_scan.KINDS}
    return found.select(
        "doc_id", *[counts.pop(k) for k in secret_scan.BASE], digest(span_list(base)).alias("base_sha256"), span_list(spans).alias("spans"),
        *counts.values(), F.array_max(F.transform(spans, lambda s: s["novelty"])).alias("max_novelty"),
    )


@query
def op2_hilbert_shards(spark, folder):
    docs = table(spark, folder, "documents")
    text = F.encode(text_of(docs), "UTF-8")
    rows = docs.select(
        "doc_id", "lang", "source", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    ).withColumn("magnitude", F.log2("size"))
    found = sharding.shard(rows, ["lang", "source", "magnitude", "doc_id"], 8)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )


@query
def op3_multiprobe_search(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return ann.search(vectors, F.col("vec_id") % 20 == 0)


@query
def op4_string_tiling(spark, folder):
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op5_piece_encoding(spark, folder):
    found = pieces.encode_documents(table(spark, folder, "documents"))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest(ids).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256")
    )


@query
def op6_bottom_k_duplicates(spark, folder):
    found = minhash.components_of(table(spark, folder, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@query
def op7_language_centroids(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = crc_of_id() % 5 == 0
    model = langid.fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.predicted(docs["text"], model).alias("_"))
    return found.select("doc_id", "held_out", F.col("_.lang").alias("lang_pred"), "_.score", "_.rejected")


@query
def op8_toxicity_lexicon(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = crc_of_id() % 3 == 1
    lexicon = toxicity.fit(docs, labels.where(~held_out))
    found = toxicity.score(docs, lexicon)
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.col("total").alias("weight")
    )


@query
def op9_chat_format(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.range(1).select(
        F.explode(F.array(*[F.struct(F.lit(-7).alias("conv_id"), F.lit(i).alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("_")
    )
    found = chat.format_chats(rows.unionByName(own.select("_.*")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("turns"))
    return found.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), digest(lines).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), digest(loss).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "exact",
    )


@query
def op10_license_diagonals(spark, folder):
    found = licenses.scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", F.col("n_places").alias("n_base"), "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


@query
def op11_spelling_variants(spark, folder):
    return spelling.variants(table(spark, folder, "documents"))


@query
def op12_systematic_mix(spark, folder):
    docs = table(spark, folder, "documents")
    size = F.regexp_count(text_of(docs), F.lit(r"[^\x20\x09-\x0D]+"))
    rows = docs.select("doc_id", "source", size.alias("words"))
    found = mixing.mix(rows, F.col("words"), F.col("source"), weights=[3, 1, 2], share=Fraction(3, 2), cap=2)
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


@query
def op13_phrase_collocations(spark, folder):
    found = collocations.top(table(spark, folder, "documents"), 2000)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "doc_id")
