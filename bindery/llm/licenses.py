"""License scans: diagonal voting.

Every rolling run of words of a text (pairs, and runs of four for license bodies) is hashed
and joined by Spark to the runs of license templates.  A match votes for the diagonal
(document position minus template position) it lies on; a template quoted word by word
gathers all votes on one diagonal, an edited one on neighbouring diagonals, which are
merged: their distance may be a tenth of the template's words, 3 at least.  A merged span is
verified by the share of the template's runs it holds.  Templates may have any length.

Four short phrases are searched exactly (all votes of one diagonal); the longer notices and
bodies add labels of their own.  Null and empty texts have no words and no labels.
Repeated rows are scanned each for itself.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.llm.common import WordHashes, long_lists, rolling

#: Words of a run: phrases and notices, bodies.
SIZE, BODY_SIZE = 2, 4
#: Diagonals this close may belong to one edited quotation, or this part of the template's runs.
NEAR, NEAR_PART = 3, 10
#: Share of a template's runs that verifies it.
VERIFIED = 0.6

# Phrases, notices and license texts, in lower case and without marks.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "creative commons attribution 4 0 international": "cc-by-4.0",
    "creative commons attribution sharealike": "cc-by-sa",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this program is free software you can redistribute it and or modify it": "gpl-notice",
    "all rights reserved": "all-rights-reserved",
}
BODIES = {
    "mit-body": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the rights "
        "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to "
        "whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the software the software is provided as "
        "is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for "
        "any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
        "connection with the software or the use or other dealings in the software"
    ),
    "bsd-body": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this "
        "list of conditions and the following disclaimer in the documentation and or other materials provided with the "
        "distribution this software is provided by the copyright holders and contributors as is and any express or implied "
        "warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose "
        "are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental "
        "special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
        "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract "
        "strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if "
        "advised of the possibility of such damage"
    ),
    "isc-body": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies the software is provided as "
        "is and the author disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential "
        "damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ),
    "zlib-body": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
        "for any damages arising from the use of this software permission is granted to anyone to use this software for any "
        "purpose including commercial applications and to alter it and redistribute it freely subject to the following "
        "restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original "
        "software if you use this software in a product an acknowledgment in the product documentation would be appreciated but "
        "is not required altered source versions must be plainly marked as such and must not be misrepresented as being the "
        "original software this notice may not be removed or altered from any source distribution"
    ),
    "unlicense-body": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
        "compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial "
        "or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this "
        "software dedicate any and all copyright interest in the software to the public domain we make this dedication for the "
        "benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an "
        "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"
    ),
}
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))


class Templates:
    """The names, run lengths and labels of all templates: phrases first, bodies last."""

    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, bodies: dict[str, str] = BODIES):
        short = [*phrases, *notices]
        self.exact = len(phrases)
        self.labels = [*phrases.values(), *notices.values(), *bodies]
        hashes = WordHashes()
        self.runs = [rolling(hashes.of(words_of(t)), SIZE) for t in short]
        self.runs += [rolling(hashes.of(words_of(t)), BODY_SIZE) for t in bodies.values()]
        for label, run in zip(self.labels, self.runs, strict=True):
            if not len(run):
                raise ValueError(f"too few words for a template: {label}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """Runs of all templates: ``hash``, ``template``, ``at``; as many as the given templates have words."""
        rows = [(int(h), number, at) for number, run in enumerate(self.runs) for at, h in enumerate(run.view(np.int64))]
        return spark.createDataFrame(rows, "hash long, template int, at int")

    def of(self, values: list) -> Column:
        """The value of the template of a row."""
        return F.element_at(F.array(*map(F.lit, values)), F.col("template") + 1)

    def sizes(self) -> Column:
        return self.of(list(map(len, self.runs)))

    def reach(self) -> Column:
        """How far neighbouring diagonals of one span may lie apart; those of phrases stay alone."""
        far = [max(NEAR, len(run) // NEAR_PART) for run in self.runs]
        return self.of([0] * self.exact + far[self.exact :])


def runs(text: Column) -> Column:
    """A struct of the word count and the hashes of all rolling runs, the pairs first."""

    @F.arrow_udf("struct<n_words:bigint,runs:array<bigint>>")
    def hashed(texts: pa.Array) -> pa.Array:
        hashes, sizes, parts = WordHashes(), [], []
        for text in texts:
            words = hashes.of(words_of(text.as_py() or ""))
            sizes.append(len(words))
            parts.append(np.concatenate((rolling(words, SIZE), rolling(words, BODY_SIZE))))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), long_lists(parts)], ["n_words", "runs"])

    return hashed(text)


def diagonals(docs: DataFrame, known: Templates) -> DataFrame:
    """Votes by document and diagonal: ``row``, ``doc_id``, ``n_words``, ``template``, ``diagonal``, ``part``, ``votes``.

    ``votes`` has a bit for each of the 64 template positions of a part that voted.  A document without a match
    keeps one row with a null template.
    """
    hashed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", runs(docs["text"]).alias("_"))
    rolled = hashed.select("row", "doc_id", "_.n_words", F.posexplode_outer("_.runs").alias("place", "hash"))
    # The templates are fixed and few, so they can be sent to all tasks.
    found = rolled.join(F.broadcast(known.rows(docs.sparkSession)), "hash", "left")
    n_pairs = F.greatest(F.col("n_words") - (SIZE - 1), F.lit(0))
    start = F.when(F.col("place") < n_pairs, F.col("place")).otherwise(F.col("place") - n_pairs)
    keys = ["row", "doc_id", "n_words", "template", (start - F.col("at")).cast("bigint").alias("diagonal")]
    return found.groupBy(*keys, F.floor(F.col("at") / 64).alias("part")).agg(F.expr("bit_or(shiftleft(1L, at % 64))").alias("votes"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, bodies: dict[str, str] = BODIES) -> DataFrame:
    """Per document ``n_words``, the number and the first and last start of exact phrase places, their labels and those of verified spans."""
    known = Templates(phrases, notices, bodies)
    # Neighbouring diagonals of a document and template are one span.
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > known.reach(), F.lit(True))
    votes = diagonals(docs, known).withColumn("_new", far.cast("int")).withColumn("_span", F.sum("_new").over(order))
    keys = ["row", "doc_id", "n_words", "template", "_span"]
    parts = votes.groupBy(*keys, "part").agg(F.min("diagonal").alias("diagonal"), F.bit_count(F.bit_or("votes")).alias("votes"))
    spans = parts.groupBy(*keys).agg(F.min("diagonal").alias("diagonal"), F.sum("votes").alias("votes"))
    share = F.coalesce(F.col("votes") / known.sizes(), F.lit(0.0))
    place = (F.col("template") < known.exact) & (F.col("votes") == known.sizes())
    quoted = (F.col("template") >= known.exact) & (share >= VERIFIED)
    label = known.of(known.labels)
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(place, 1)).alias("n_places"),
        F.min(F.when(place, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(place, F.col("diagonal"))).alias("last_word"),
        F.sort_array(F.collect_set(F.when(place, label))).alias("base_labels"),
        F.sort_array(F.collect_set(F.when(place | quoted, label))).alias("labels"),
        F.coalesce(F.max(F.when(place | quoted, share)), F.max(share) / 2).alias("score"),
    )
