"""Licence scans by diagonal voting, with DataFrame functions only.

The rolling word k-grams of a text are hashed and joined to the positions of the same
hashes in licence templates. Hits of one template that lie on one diagonal (position
in the text less position in the template) vote together; neighbouring diagonals are
merged, so that an inserted or missing word doesn't break a span. A merged span reaches
to where the template's first and last word should stand; its words and the template's
are aligned, and it is verified by the number of words that must be put in, left out or
replaced, of which ``LEAST`` allows a share. A short template also names words that the
span must hold, and where spans of several templates overlap the best one counts.

A text within ``e`` edits of a template of ``n`` words has at least n - k + 1 - k * e
of its k-grams: spans with fewer votes can't pass and are not aligned.

A k-gram that no template has meets nothing in the join. Such k-grams are left out
before it, first by their words, then by their hash; the join's result is the same.

The templates are few and short, so their table is bounded by this file.

Defined results: a null or empty text has no words and no labels; words of other
scripts count as words; repeated rows are scanned each on their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.llm.common import cut, lit_array, table

#: Phrases that always give their label where their words stand consecutively.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: The words of well-known licence notices and texts, by paragraph; in
#: capitals those that a span must hold.
TEMPLATES = {
    "mit": (
        "this project is released under the MIT license",
        "is licensed under the terms of the MIT license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "apache-2": (
        "licensed under the APACHE license version 2 0",
        "licensed under the APACHE license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    "cc-by-nc": (
        "this work is licensed under CC BY NC 4 0",
        "this work is licensed under a creative commons attribution NONCOMMERCIAL 4 0 international license",
    ),
    "cc-by-sa": (
        "this work is licensed under CC BY SA 4 0",
        "this work is licensed under a creative commons attribution SHAREALIKE 4 0 international license",
    ),
    "cc-by": (
        "this work is licensed under CC BY 4 0",
        "this work is licensed under a creative commons ATTRIBUTION 4 0 international license",
    ),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",),
    "gpl": (
        "this work is licensed under the GNU general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the GNU general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the GNU general public license for more details",
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the GNU LESSER general public license as published by the free software foundation",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
    "mpl-2": ("this source code form is subject to the terms of the MOZILLA public license v 2 0 if a copy of the MPL was not distributed with this file you can obtain one at",
              "this source code form is subject to the terms of the MOZILLA public license v 2 0"),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    "all-rights-reserved": ("all RIGHTS reserved no part of this publication may be reproduced without permission",),
}

#: Words of a gram: any one edit of six words or more leaves such a run.
K = 3
#: Diagonals at most this far apart are one span.
SLACK = 3
#: Share of a template's words that must stay after an alignment.
LEAST = 0.75

_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Letters, digits and characters beyond ASCII. ``lower`` also folds those beyond,
    none of which becomes a letter of a phrase or a separator by it."""
    bare = F.btrim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _SEPARATORS, " "))
    return bare


def _hash(at, i: Column, k: int = K) -> Column:
    return F.xxhash64(*[F.get(at, i + j) for j in range(k)])


def _texts() -> list[tuple[str, str, list[str], list[str]]]:
    """(label, template, words, words that must be there)"""
    return [(label, f"{label}/{n}", text.lower().split(), sorted({w.lower() for w in text.split() if w.isupper()})) for label, texts in TEMPLATES.items() for n, text in enumerate(texts)]


def _code(w: Column, known: Column) -> Column:
    """Words as letters, one for each place of ``known`` and one for all others, so that
    the edit distance of two strings is that of the word sequences."""
    return F.array_join(F.transform(w, lambda x: F.char(F.lit(33) + F.array_position(known, x).cast("int"))), "")


def templates(spark: SparkSession, k: int = K, least: float = LEAST) -> DataFrame:
    """(h, label, template, position, words, known, code, must, edits, votes): every
    k-gram of every template, and what a span of the template is held to."""
    rows = []
    for label, name, words_, must in _texts():
        edits = int((1 - least) * len(words_))
        told = {"label": label, "template": name, "edits": edits, "votes": max(1, len(words_) - k + 1 - k * edits)}
        lists = {"words": words_, "known": list(dict.fromkeys(words_)), "must": must}
        rows.append(F.struct(*[F.lit(v).alias(c) for c, v in told.items()], *[lit_array(v, "string").alias(c) for c, v in lists.items()]))
    df = spark.range(1).select(F.inline(F.array(*rows))).withColumn("code", _code(F.col("words"), F.col("known")))
    grams = F.transform(F.sequence(F.lit(0), F.size("words") - k), lambda i: F.struct(_hash("words", i, k).alias("h"), i.alias("position")))
    return df.select("*", F.explode(grams).alias("g")).select("g.h", "g.position", *df.columns)


def _places(w: Column, phrase: str) -> Column:
    parts = phrase.split()

    def here(i):
        out = F.get(w, i) == parts[0]
        for j, part in enumerate(parts[1:], 1):
            out = out & (F.get(w, i + j) == part)
        return out

    return F.filter(F.sequence(F.lit(0), F.size(w) - 1), here)


def prepared(docs: DataFrame, k: int = K) -> DataFrame:
    """One row for each row of ``docs``, from a single pass over the texts: doc_id, key
    (a hash of the text), n_words, the places of each phrase, hits, the rolling k-grams
    (h, at) that some template has as well, and the words of texts that have hits."""
    hashes = [r["h"] for r in templates(docs.sparkSession, k).select("h").distinct().collect()]  # bounded by the templates
    at = [sorted({w[i + j] for _, _, w, _ in _texts() for i in range(len(w) - k + 1)}) for j in range(k)]
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("key"), words(F.col("text")).alias("bare"))
    rows = rows.select("doc_id", "key", "bare", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", " ")).alias("w"))
    none = F.array().cast("array<int>")
    # most texts hold no phrase; their words are only searched where the joined text does
    padded = F.concat(F.lit(" "), "bare", F.lit(" "))
    found = [F.when(padded.contains(f" {p} "), _places(F.col("w"), p)).otherwise(none).alias(label) for label, p in PHRASES.items()]

    def shared(i):
        # the last word first: it is the rarest to be in its place by chance
        here = F.get("w", i + (k - 1)).isin(at[k - 1])
        for j in range(k - 1):
            here = here & F.get("w", i + j).isin(at[j])
        return here & _hash("w", i, k).isin(hashes)

    hits = F.when(F.size("w") >= k, F.transform(F.filter(F.sequence(F.lit(0), F.size("w") - k), shared), lambda i: F.struct(_hash("w", i, k).alias("h"), i.alias("at"))))
    rows = rows.select("doc_id", "key", "w", F.size("w").cast("long").alias("n_words"), *found, hits.alias("hits"))
    return rows.withColumn("w", F.when(F.size("hits") > 0, F.col("w")))


def spans(rows: DataFrame, k: int = K, slack: int = SLACK, least: float = LEAST) -> DataFrame:
    """(doc_id, key, label, template, first, last, edits, share) of every verified span,
    from the hits of ``rows`` (see ``prepared``, written); repeated rows give theirs once."""
    known = templates(rows.sparkSession, k, least)
    once = rows.where(F.size("hits") > 0).dropDuplicates(["doc_id", "key"])
    hits = once.select("doc_id", "key", F.explode("hits").alias("g")).select("doc_id", "key", "g.h", "g.at")
    own = ["doc_id", "key", "template"]
    votes = hits.join(F.broadcast(known.select("h", "template", "position")), "h").select(*own, "at", (F.col("at") - F.col("position")).alias("diagonal"))
    # a diagonal holds a template's k-grams at most
    diagonals = votes.groupBy(*own, "diagonal").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    # neighbouring diagonals form one span
    side = W.partitionBy(*own).orderBy("diagonal")
    group = F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(side) <= slack, 0).otherwise(1)).over(side)
    merged = diagonals.withColumn("span", group).groupBy(*own, "span").agg(F.sum("n").alias("n"), F.min_by("diagonal", "first").alias("begin"), F.max_by("diagonal", "last").alias("end"))
    held = known.select("template", "label", "words", "known", "code", "must", F.col("edits").alias("most"), "votes").dropDuplicates(["template"])
    tried = merged.join(F.broadcast(held), "template").where(F.col("n") >= F.col("votes"))
    # where the template's first word should stand, by the first hit, and its last, by the last
    first, end = F.greatest(F.lit(0), F.col("begin")), F.col("end") + F.size("words")
    tried = tried.select(*own, "label", "words", "known", "code", "must", "most", first.alias("first"), end.alias("end"))
    texts = once.select(F.col("doc_id").alias("of_doc"), F.col("key").alias("of_key"), "w")
    seen = tried.join(texts, tried.doc_id.eqNullSafe(texts.of_doc) & (tried.key == texts.of_key))
    seen = seen.withColumn("part", F.slice("w", F.col("first") + 1, F.greatest(F.lit(0), F.least("end", F.size("w")) - F.col("first")))).drop("w")
    edits = F.levenshtein(_code(F.col("part"), F.col("known")), F.col("code"))
    kept = seen.withColumn("edits", edits).where((F.col("edits") <= F.col("most")) & (F.size(F.array_except("must", "part")) == 0))
    kept = kept.select(*own, "label", "first", (F.col("first") + F.size("part") - 1).alias("last"), "edits", (1 - F.col("edits") / F.size("words")).alias("share"))
    # of overlapping spans the best counts, and of equally good ones the longest
    by_place = W.partitionBy("doc_id", "key").orderBy("first", "last", "template")
    reach = F.max("last").over(by_place.rowsBetween(W.unboundedPreceding, -1))
    rank = F.row_number().over(W.partitionBy("doc_id", "key", "place").orderBy(F.desc("share"), F.desc(F.col("last") - F.col("first")), "template"))
    best = kept.withColumn("reach", reach).withColumn("place", F.sum(F.when(F.col("first") <= F.col("reach"), 0).otherwise(1)).over(by_place)).withColumn("rank", rank)
    return best.where("rank = 1").drop("reach", "place", "rank")


def scanned(docs: DataFrame, k: int = K, slack: int = SLACK, least: float = LEAST) -> DataFrame:
    """doc_id, n_words, places of the phrases and all labels of every row of ``docs``."""
    rows = cut(prepared(docs, k))
    places = F.concat(*[F.col(label) for label in PHRASES])
    base = rows.select(
        "doc_id",
        "key",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(label) > 0, F.lit(label)) for label in PHRASES])).alias("own"),
    )
    more = spans(rows, k, slack, least).groupBy(F.col("doc_id").alias("of_doc"), F.col("key").alias("of_key")).agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    joined = base.join(more, base.doc_id.eqNullSafe(more.of_doc) & (base.key == more.of_key), "left")
    labels = F.array_union("own", F.coalesce("more", F.array().cast("array<string>")))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("own"), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
