"""License texts in documents, by phrases and by diagonal voting.

Every rolling k-word fingerprint of a text is joined to the places where a template has it. The
difference of both places is a diagonal; hits vote for theirs, neighbouring diagonals (words
added or left out) are merged, and the span that the votes point to is verified by its edit
distance from the template.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import myers
from .words import ALNUM, Words, inside, rolling, segments

#: Fixed phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Public license notices and the labels of the method; a bounded table, part of the program.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "mit-notice"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit-notice"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache-notice"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-notice"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-notice"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-notice"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-notice"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-notice"),
    ("licensed under the mit license", "mit-mention"),
    ("released under the terms of the gnu general public license", "gpl-mention"),
    ("available under the creative commons cc by license", "cc-by-mention"),
    ("the software is provided as is without warranty of any kind express or implied", "warranty-disclaimer"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)
GRAM = 3
#: Diagonals at most this far apart are merged.
GAP = 3
#: Edits that a verified span may have, as a share of the template's words.
EDITS = 0.2


def _phrase_places(words: Words, h: np.ndarray) -> list[tuple[np.ndarray, str]]:
    """First words of every place where a phrase's words stand in one text."""
    out = []
    for phrase, label in PHRASES:
        p = Words([phrase.encode()], ALNUM)
        m = len(p)
        if len(h) < m:
            continue
        hit = inside(words, m).copy()
        for j, x in enumerate(p.hashes()):
            hit &= h[j : len(h) - m + 1 + j] == x
        at = np.flatnonzero(hit)
        same = [all(words.word(i + j) == w for j, w in enumerate(p.words(0))) for i in at.tolist()]
        out.append((at[np.array(same, dtype=bool)] if len(at) else at, label))
    return out


def phrases(df: DataFrame, kind: str) -> DataFrame:
    """Rows _id, _key, n_words, n_base, first_word, last_word, base (sorted labels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in segments(batches, "_text"):
            words = Words(texts, ALNUM, lower=True)
            n = np.zeros(len(texts), np.int64)
            first, last = np.full(len(texts), np.iinfo(np.int64).max), np.full(len(texts), -1)
            labels: list[set[str]] = [set() for _ in texts]
            for at, label in _phrase_places(words, words.hashes()):
                doc = words.doc[at]
                place = at - words.first[doc]
                np.add.at(n, doc, 1)
                np.minimum.at(first, doc, place)
                np.maximum.at(last, doc, place)
                for d in np.unique(doc).tolist():
                    labels[d].add(label)
            none = n == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(words.count.astype(np.int64)), pa.array(n), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([sorted(x) for x in labels], pa.list_(pa.string()))],
                names=["_id", "_key", "n_words", "n_base", "first_word", "last_word", "base"],
            )

    return df.mapInArrow(run, f"_id {kind}, _key long, n_words long, n_base long, first_word long, last_word long, base array<string>")


def votes(df: DataFrame, kind: str) -> DataFrame:
    """Candidate spans: _id, _key, template, diagonal, votes, first and span (fingerprints of the words around it)."""
    spark = df.sparkSession
    known = []
    for t, (text, _) in enumerate(TEMPLATES):
        w = Words([text.encode()], ALNUM)
        known += [(int(g), t, j, len(w)) for j, g in enumerate(rolling(w.hashes(), GRAM).view(np.int64).tolist())]
    places = F.broadcast(spark.createDataFrame(known, "gram long, template int, at int, size int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in segments(batches, "_text"):
            words = Words(texts, ALNUM, lower=True)
            h = words.hashes()
            # one gram a word, so that places match; those over a text's end are never a template's
            grams = np.zeros(len(h), np.uint64)
            if len(h) >= GRAM:
                grams[: len(h) - GRAM + 1] = np.where(inside(words, GRAM), rolling(h, GRAM), 0)
            offsets = pa.array(words.first.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(grams.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64)))],
                names=["_id", "_key", "grams", "words"],
            )

    rolled = df.mapInArrow(run, f"_id {kind}, _key long, grams array<long>, words array<long>")
    hits = rolled.select("_id", "_key", "words", F.posexplode("grams").alias("place", "gram")).join(places, "gram")
    from_ = F.greatest(F.col("place") - F.col("at") - 2 * GAP, F.lit(0))
    hits = hits.select("_id", "_key", "template", "size", (F.col("place") - F.col("at")).alias("diagonal"), from_.alias("first"), F.slice("words", from_ + 1, F.col("size") + 4 * GAP).alias("span"))
    lines = hits.groupBy("_id", "_key", "template", "size", "diagonal").agg(F.count("*").alias("votes"), F.first(F.struct("first", "span")).alias("x"))
    along = Window.partitionBy("_id", "_key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > GAP, F.lit(True))
    merged = lines.withColumn("_new", apart.cast("int")).withColumn("cluster", F.sum("_new").over(along))
    best = merged.groupBy("_id", "_key", "template", "size", "cluster").agg(F.sum("votes").alias("votes"), F.max_by(F.struct("diagonal", "x.first", "x.span"), F.struct("votes", -F.col("diagonal"))).alias("b"))
    return best.filter(F.col("votes") >= F.greatest(F.lit(2), F.ceil(F.lit(0.3) * (F.col("size") - GRAM + 1)))).select("_id", "_key", "template", "b.diagonal", "votes", "b.first", "b.span")


def spans(df: DataFrame, kind: str) -> DataFrame:
    """Verified spans: _id, _key, label, first_word, last_word, similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [Words([t.encode()], ALNUM).hashes().view(np.int64).tolist() for t, _ in TEMPLATES]
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, (t, first, span) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 5, 6)), strict=True)):
                pattern = patterns[t]
                distance, end = myers(pattern, span)
                if distance <= EDITS * len(pattern):
                    _, back = myers(pattern[::-1], span[:end][::-1])
                    for column, value in zip(out, (i, TEMPLATES[t][1], first + end - back, first + end - 1, 1 - distance / len(pattern)), strict=True):
                        column.append(value)
            at = pa.array(out[0], pa.int64())
            types = (pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, k) for c, k in zip(out[1:], types, strict=True))], names=["_id", "_key", "label", "first_word", "last_word", "similarity"])

    return votes(df, kind).mapInArrow(run, f"_id {kind}, _key long, label string, first_word long, last_word long, similarity double")


def scan(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: row_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. Null and
    empty texts have no words and no labels (empty strings), null places and score 0. Repeated
    rows each give a row; null ids are kept; an empty table gives none; extra columns are left out.
    """
    kind = df.schema[row_id].dataType.simpleString()
    own = df.select(F.col(row_id).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = spans(own, kind).groupBy("_id", "_key").agg(F.collect_set(F.struct("label", "first_word", "last_word", "similarity")).alias("spans"))
    found = found.withColumnRenamed("_id", "_fid").withColumnRenamed("_key", "_fkey")
    both = phrases(own, kind).join(found, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_key") == F.col("_fkey")), "left")
    method = F.coalesce(F.transform("spans", lambda s: s["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["similarity"])), F.lit(0.0))
    return both.select(
        F.col("_id").alias(row_id), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", method))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"), F.coalesce("spans", F.array().cast("array<struct<label:string,first_word:bigint,last_word:bigint,similarity:double>>")).alias("spans"),
    )
