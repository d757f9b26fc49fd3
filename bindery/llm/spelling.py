r"""Spelling variants by permuterm rotations.

Words are marked with a final ``$``.  Two words that differ by one replaced letter, A x B and
A y B, have rotations ``B$Ax`` and ``B$Ay``: the prefix ``B$A`` with the edited letter skipped.
A word without the letter, AB, has ``B$A`` as a whole rotation.  All rotations, whole and with
one letter skipped, are sorted by range; each prefix is a run of neighbouring rows which holds the
words that differ in its one letter, so a run is no longer than the alphabet plus one.  Runs are
scanned once: every row learns how many others stand in its run and the best of them.  Pairs
are never made.

A rotation is kept as its first ``LEADING`` letters and the digest of the others, so rows of very
long words stay small.  A letter can be left out of equal neighbours at several places; only the
first of them counts as near, so that neighbours count once.

Null texts have no words; a null ``doc_id`` is the empty string in the hash that deletes letters.  Repeated
rows count again; of near words with equal counts the smallest by code point is the form.  An
empty table has no words.  Only ``doc_id`` and ``text`` are read, so further columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.common import text_of
from bindery.session import settle

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEADING = 48


def vocabulary(docs: DataFrame, letters: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """``word`` and ``n``: runs of letters, a letter left out of one in ``every`` by hash, counted over all texts."""
    runs = docs.select(
        F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text_of(docs), F.lit(RUN), F.lit(0))).alias("run"),
    ).where(F.length("run") >= letters)
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = low.withColumn("h", F.crc32(F.encode(F.concat_ws(":", "id", "run"), "UTF-8")))
    at = (F.col("h") % F.length("run")).cast("int")
    left = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, left).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """Rows (key, skipped, less, word, first): whole rotations and those with one letter skipped.

    ``less`` is the count, negative, so that frequent words come first; ``first`` is 1 where the
    skipped letter differs from the one before it.
    """
    length = F.length("word")
    places = words.select("word", "n", F.explode(F.sequence(F.lit(0), length * 2)).alias("j"))
    skipped = (F.col("j") > length).cast("int")
    rows = places.select("word", (-F.col("n")).alias("less"), skipped.alias("skipped"), F.when(skipped == 1, F.col("j") - length - 1).otherwise(F.col("j")).alias("i"))
    behind = F.substring("word", F.col("i") + 1 + F.col("skipped"), length)
    turned = rows.withColumn("key", F.concat(behind, F.lit("$"), F.substring("word", F.lit(1), F.col("i"))))
    key = F.when(F.length("key") > LEADING, F.concat(F.substring("key", 1, LEADING), F.md5(F.substring("key", LEADING + 1, 1 << 30)))).otherwise(F.col("key"))
    one = F.lit(1)
    first = (F.col("skipped") == 1) & ((F.col("i") == 0) | (F.substring("word", F.col("i"), one) != F.substring("word", F.col("i") + 1, one)))
    return turned.select(key.alias("key"), "skipped", "less", "word", first.cast("int").alias("first"))


def neighbours(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``n_near`` and ``best`` (less, word): its near words' number and the most frequent one.

    The scan of a run keeps its first three rows: the whole rotation, if any, and the two best others.
    """
    order = ["key", "skipped", "less", "word"]
    table = rotations(words).repartitionByRange("key").sortWithinPartitions(*order)
    run = Window.partitionBy("key").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct("less", "word")
    scanned = table.select(
        "word", "skipped", "first", F.count("*").over(run).alias("rows"), F.sum("first").over(run).alias("firsts"),
        F.first("skipped").over(run).alias("kind"), *[F.nth_value(row, k).over(run).alias(f"row{k}") for k in (1, 2, 3)],
    ).where("rows > 1")
    whole = F.col("kind") == 0
    best = F.when(whole, F.col("row2")).otherwise(F.col("row1"))
    second = F.when(whole, F.col("row3")).otherwise(F.col("row2"))
    other = F.least(F.when(best["word"] == F.col("word"), second).otherwise(best), F.when(whole, F.col("row1")))
    own = F.col("skipped") == 0
    near = F.when(own, F.col("firsts")).otherwise(F.col("rows") - 1 - F.when(whole & (F.col("first") == 0), 1).otherwise(0))
    found = scanned.select("word", F.lit(0).cast("bigint").alias("n"), near.alias("near"), F.when(own, best).otherwise(other).alias("best"))
    none = F.lit(None).cast("struct<less: bigint, word: string>")
    everything = words.select("word", "n", F.lit(0).cast("bigint").alias("near"), none.alias("best")).union(found)
    return everything.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of its chain, for a table of (word, form).

    Each round every word jumps to where its form has got; counts double along a chain, so
    chains, and rounds even more, are short.
    """
    held = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = settle(held.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        held = jumped.select("word", "root")
        if not jumped.where("moved").take(1):
            return held


def variants(docs: DataFrame, letters: int = 5, least: int = 3, every: int = 97, times: int = 2) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of all words of the texts."""
    words = settle(vocabulary(docs, letters, least, every))
    found = neighbours(words)
    close = -F.col("best.less") >= F.col("n") * times
    rated = settle(
        found.select("word", "n", "n_near", F.when(close, F.col("best.word")).alias("form"), F.when(close, -F.col("best.less")).alias("form_n"))
    )
    ends = roots(rated.where("form is not null"))
    return rated.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
