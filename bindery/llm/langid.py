"""Language identification by nearest centroids.

Texts become hashed counts of letter n-grams (1 to 3 letters, case folded), damped,
weighted by inverse document frequency and normalised.  The vectors of each language
in a bounded sample of labelled rows are clustered; centroids whose nearest sample rows
are mostly of another language are dropped.  A text gets the language of the centroid with the largest
cosine, and is rejected where that cosine is far below what the centroid's own rows had.

Texts without a letter (null and empty ones too) are ``und`` with score 0 and rejected,
and so is everything if no labelled row is given.  Ties go to the smaller language name.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import chunks

#: Rows that the model is fitted on, over all languages, and at least for each.
SAMPLE_ROWS, LEAST_ROWS, LANGUAGES = 2400, 40, 200
DIMENSIONS = 4096
CLUSTERS, ROUNDS = 4, 8
#: A text is rejected below this share of the lowest percentile of a centroid's own cosines.
REJECT = 0.5
UNKNOWN = "und"
ROWS_AT_ONCE = 64


@functools.lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower-case form."""
    points = np.arange(0x110000, dtype=np.uint32)
    lower, letter = points.copy(), np.zeros(len(points), bool)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            letter[point] = True
            folded = char.lower()
            if len(folded) == 1:
                lower[point] = ord(folded)
    return letter, lower


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram counts of each text, and how many letters it has."""
    letter, lower = letters()
    codes = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(codes)]
    is_letter = letter[codes]
    codes = np.where(is_letter, lower[codes], np.uint32(32))
    found = np.zeros(len(texts) * DIMENSIONS, np.float32)
    grams, alive = np.zeros(len(codes), np.uint32), np.zeros(len(codes), bool)
    for size in (1, 2, 3):
        stop = len(codes) - size + 1
        if stop <= 0:
            break
        grams = (grams[:stop] + codes[size - 1 :] + np.uint32(size)) * np.uint32(2654435761)
        grams ^= grams >> np.uint32(15)
        alive = alive[:stop] | is_letter[size - 1 :]
        inside = alive & (row[:stop] == row[size - 1 :])
        at = row[:stop][inside] * DIMENSIONS + (grams[inside] % DIMENSIONS).astype(np.int64)
        found += np.bincount(at, minlength=len(found)).astype(np.float32)
    return found.reshape(len(texts), DIMENSIONS), np.bincount(row[is_letter], minlength=len(texts))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray  # cosines below which a centroid rejects

    def vectors(self, found: np.ndarray) -> np.ndarray:
        return unit(np.log1p(found) * self.idf)

    def predict(self, texts: list[str]) -> list[dict]:
        found, n_letters = counts(texts)
        if not self.languages:
            return [{"lang": UNKNOWN, "score": 0.0, "rejected": True}] * len(texts)
        cosines = self.vectors(found) @ self.centroids.T
        best = cosines.argmax(axis=1)
        value = cosines[np.arange(len(texts)), best]
        return [
            {"lang": self.languages[b], "score": float(min(1.0, max(0.0, v))), "rejected": bool(v < self.floors[b])}
            if n
            else {"lang": UNKNOWN, "score": 0.0, "rejected": True}
            for b, v, n in zip(best.tolist(), value.tolist(), n_letters.tolist(), strict=True)
        ]


def clustered(vectors: np.ndarray) -> np.ndarray:
    """Centroids of one language's vectors: spherical k-means from the farthest points."""
    centers = unit(vectors.mean(axis=0, keepdims=True))
    while len(centers) < min(CLUSTERS, len(vectors)):
        far = (vectors @ centers.T).max(axis=1).argmin()
        centers = np.vstack([centers, vectors[far]])
    for _ in range(ROUNDS):
        nearest = (vectors @ centers.T).argmax(axis=1)
        centers = unit(np.vstack([vectors[nearest == k].mean(axis=0) if (nearest == k).any() else centers[k] for k in range(len(centers))]))
    return centers


def fitted(languages: np.ndarray, found: np.ndarray) -> Model:
    """The model of sample rows: their languages and n-gram counts."""
    if not len(found):
        return Model([], np.empty((0, DIMENSIONS)), np.ones(DIMENSIONS), np.empty(0))
    idf = (np.log((1 + len(found)) / (1 + (found > 0).sum(axis=0))) + 1).astype(np.float32)
    vectors = unit(np.log1p(found) * idf)
    names, centers = [], []
    for language in sorted(set(languages.tolist())):
        own = clustered(vectors[languages == language])
        names += [language] * len(own)
        centers.append(own)
    names, centers = np.array(names), np.vstack(centers)
    cosines = vectors @ centers.T
    # Mislabelled rows make centroids among another language's rows.
    keep = np.ones(len(names), bool)
    nearest = cosines.argmax(axis=1)
    for k, language in enumerate(names):
        near = languages[nearest == k]
        keep[k] = len(near) and 2 * (near == language).sum() > len(near) and len(near) >= 0.02 * (languages == language).sum()
    for language in set(names.tolist()):
        if not keep[names == language].any():
            keep |= names == language
    names, centers = names[keep], centers[keep].astype(np.float32)
    cosines = vectors @ centers.T
    nearest = cosines.argmax(axis=1)
    floors = np.array([REJECT * np.percentile(cosines[nearest == k, k], 1) if (nearest == k).any() else 0.0 for k in range(len(names))])
    return Model(names.tolist(), centers, idf, floors)


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, languages: int = LANGUAGES) -> Model:
    """The model from rows with ``doc_id``, ``text`` and a ``lang``, of which a bounded sample is used.

    The ``languages`` most frequent values of ``lang`` are learned (ties by name), others are mistakes or too rare.
    The sample is spread evenly over languages and drawn by a hash of the id; its
    vectors alone come to the driver.
    """
    rows = labelled.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("lang").alias("_lang")).where("_lang is not null")
    common = rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(languages)
    sizes = {r["_lang"]: r["count"] for r in common.collect()}
    if not sizes:
        return fitted(np.empty(0), np.empty((0, DIMENSIONS)))
    quota = max(LEAST_ROWS, sample_rows // len(sizes))
    draw = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("language")), F.lit(1_000_000))
    share = rows.sparkSession.createDataFrame(
        [(lang, int(min(1.0, quota / size) * 1_000_000)) for lang, size in sizes.items()], "_lang string, _share long"
    )
    chosen = rows.join(F.broadcast(share), "_lang").where(draw < F.col("_share")).select("_lang", "_text")

    def count(batches):
        for batch in batches:
            at = 0
            langs = batch.column("_lang").to_pylist()
            for run in chunks(batch.column("_text"), ROWS_AT_ONCE):
                found, n_letters = counts(run)
                out = []
                for i in np.flatnonzero(n_letters).tolist():
                    nonzero = np.flatnonzero(found[i])
                    out.append((langs[at + i], nonzero.astype(np.int32).tolist(), found[i, nonzero].tolist()))
                at += len(run)
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["lang", "at", "n"]), schema=schema, preserve_index=False)

    schema = pa.schema([("lang", pa.string()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.float32()))])
    sample = chosen.mapInArrow(count, "lang string, at array<int>, n array<float>").toPandas()
    # One order of the sample, whatever the partitions.
    sizes_of = sample["n"].map(lambda v: (len(v), float(np.sum(v))))
    sample = sample.assign(size=sizes_of, places=sample["at"].map(tuple), times=sample["n"].map(tuple))
    sample = sample.sort_values(["lang", "size", "places", "times"]).reset_index(drop=True)
    found = np.zeros((len(sample), DIMENSIONS), np.float32)
    for i, (at, n) in enumerate(zip(sample["at"], sample["n"], strict=True)):
        found[i, np.asarray(at, np.int64)] = n
    return fitted(sample["lang"].to_numpy(), found)


PREDICTED = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def predicted(text: Column, model: Model) -> Column:
    """A struct of ``lang``, ``score`` and ``rejected``."""

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        return pa.array((p for run in chunks(texts, ROWS_AT_ONCE) for p in model.predict(run)), PREDICTED)

    return predict(text)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is found and not rejected."""
    found = docs.select("*", predicted(docs["text"], model).alias("_language"))
    return found.where("not _language.rejected").select(*[F.col(f"`{c}`") for c in docs.columns])
