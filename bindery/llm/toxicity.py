"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, zero-width characters dropped, look-alike letters
and digits read as the letters they stand for.  The lexicon holds whole words and word beginnings,
each with the log odds of its documents being toxic, learned from labelled rows; an
entry must be far from chance (likelihood ratio).  Matches inside exception phrases do
not count.  The summed weights, also by text length, give the score through a logistic curve
that is fitted on the same rows.

Null and empty texts get the score of a text without matches.  Without labelled rows of
both kinds the lexicon is empty and every score is the smoothed share of toxic rows.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.session import settle

#: Labelled rows the lexicon is learned from, and its largest size.
SAMPLE_ROWS, LEXICON_SIZE = 16_384, 20_000
#: Lengths of word beginnings that may be entries, and the least likelihood ratio and share of toxic rows of any entry.
BEGINNINGS = (4, 5, 6)
LEAST_RATIO, LEAST_SHARE = 8.0, 0.8
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "circus clown", "class clown")

# Look-alikes of the Latin letters (Cyrillic, Greek, full width follow the same order as the letters below them).
LATIN = "aceopxyijshkbmtvdnu"
CYRILLIC = "асеорхуіјѕһкьмтѵԁпц"
GREEK = str.maketrans("αεικνορτυχω", "aeiknoptuxw")
DIGITS = str.maketrans("0134578@l", "oieastbai")  # 1, i and l are one letter
FOLD = (
    dict(zip(map(ord, CYRILLIC), LATIN, strict=True))
    | GREEK
    | DIGITS
    | {0xFF41 + i: "i" if i == 11 else chr(97 + i) for i in range(26)}
    | {0xFF10 + i: "oi2eas6tb9"[i] for i in range(10)}
    | dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD])
)
WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> list[str]:
    """The words of a text after folding."""
    text = text.lower().translate(FOLD)
    if "$" in text:
        text = re.sub(r"(?<=[^\W_])\$(?=[^\W_])", "s", text)
    return WORD.findall(text)


def patterns(words: list[str]) -> list[str]:
    """The lexicon patterns a text supports: whole words end with a space, beginnings don't."""
    found = set()
    for word in set(words):
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in BEGINNINGS if len(word) > n)
    return sorted(found)


@dataclass
class Lexicon:
    weights: dict[str, float]
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    exceptions: tuple[str, ...] = field(default=EXCEPTIONS)

    @functools.cached_property
    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            machine.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            phrase = f" {' '.join(folded(phrase))} "
            machine.add_word(phrase, (len(phrase), None))
        machine.make_automaton()
        return machine

    def __getstate__(self):
        return {"weights": self.weights, "curve": self.curve, "exceptions": self.exceptions}

    def measure(self, text: str) -> tuple[float, int]:
        """The summed weights of matched words, the best of each word, and the word count."""
        words = folded(text)
        if not words or not self.weights:
            return 0.0, len(words)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton.iter(f" {' '.join(words)} "):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            else:
                best[start] = max(weight, best.get(start, weight))
        return sum(w for at, w in best.items() if not any(a <= at < b for a, b in spared)), len(words)

    def inputs(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        return np.column_stack((np.ones(len(total)), np.log1p(total), np.log1p(100 * total / np.maximum(words, 1))))

    def scores(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(total, words) @ np.array(self.curve), -30, 30)))


def logistic(inputs: np.ndarray, labels: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weights of a logistic curve, by Newton steps."""
    weights = np.zeros(inputs.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(inputs @ weights, -30, 30)))
        slope = inputs.T @ (labels - p) - ridge * weights
        bend = (inputs * (p * (1 - p) + 1e-9)[:, None]).T @ inputs + ridge * np.eye(len(weights))
        weights = weights + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return tuple(weights.tolist())


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """The lexicon from ``docs`` and their ``labels`` (``doc_id``, ``toxic``), of which a bounded sample is used."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    size = marked.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1_000_000))
    chosen = marked.where(draw < int(min(1.0, sample_rows / max(size, 1)) * 1_000_000))
    texts = docs.select(F.col("doc_id"), F.col("text").alias("_text"))
    # The sample has at most about sample_rows small rows.
    rows = texts.join(F.broadcast(chosen), "doc_id").select("_toxic", "_text")

    @F.arrow_udf("array<string>")
    def supported(batch: pa.Array) -> pa.Array:
        return pa.array((patterns(folded(t.as_py() or "")) for t in batch), pa.list_(pa.string()))

    held = settle(rows)
    classes = {r["_toxic"]: r["count"] for r in held.groupBy("_toxic").count().collect()}
    bad, good = classes.get(1, 0), classes.get(0, 0)
    if not bad or not good:
        share = (bad + 0.5) / (bad + good + 1)
        return Lexicon({}, (float(np.log(share / (1 - share))), 0.0, 0.0), exceptions)
    base = bad / (bad + good)
    entries = held.select("_toxic", F.explode(supported("_text")).alias("pattern")).groupBy("pattern").agg(
        F.sum("_toxic").alias("a"), F.sum(1 - F.col("_toxic")).alias("b")
    )
    n = F.col("a") + F.col("b")
    ratio = F.col("a") * F.log(F.col("a") / (n * base)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (n * (1 - base)))).otherwise(0)
    entries = entries.where((F.col("a") > 0) & (F.col("a") / n >= LEAST_SHARE)).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    top = entries.orderBy(F.desc("ratio"), "pattern").limit(LEXICON_SIZE).collect()
    weights = {r["pattern"]: float(np.log((r["a"] + 0.5) / (bad + 1) / ((r["b"] + 0.5) / (good + 1)))) for r in top}
    lexicon = Lexicon(weights, exceptions=exceptions)
    measured = held.select("_toxic", measures(F.col("_text"), lexicon).alias("m")).select("_toxic", "m.total", "m.words").toPandas()
    inputs = lexicon.inputs(measured["total"].to_numpy(), measured["words"].to_numpy())
    return Lexicon(weights, logistic(inputs, measured["_toxic"].to_numpy(float)), exceptions)


MEASURED = "total double, words bigint, score double"


def measures(text: Column, lexicon: Lexicon) -> Column:
    """A struct of the summed weights, the word count and the score."""

    @F.pandas_udf(MEASURED)
    def measure(texts: pd.Series) -> pd.DataFrame:
        found = np.array([lexicon.measure(t or "") for t in texts], float).reshape(-1, 2)
        return pd.DataFrame({"total": found[:, 0], "words": found[:, 1].astype(np.int64), "score": lexicon.scores(found[:, 0], found[:, 1])})

    return measure(text)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id``, ``total``, ``words`` and ``score`` of every document."""
    found = docs.select("doc_id", measures(docs["text"], lexicon).alias("_"))
    return found.select("doc_id", "_.total", "_.words", "_.score")
