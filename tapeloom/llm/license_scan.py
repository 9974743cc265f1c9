"""License scans by diagonal voting.

All rolling two-word hashes of all texts are joined to the positions of the same hashes in the templates (a bounded
table: the templates are a parameter). A hit at word p of a text and word t of a template votes for the diagonal p - t.
Votes are summed per text, template and diagonal; neighbouring diagonals, as small insertions and deletions make them,
are merged; what has enough votes is verified on the words of the text. Short phrases need all their votes on one
diagonal and all their words, so that their places are exact. Long templates need a few of their votes, and a share of their words
in order decides.

Null texts are empty. Rows that are equal in doc_id and text count once per row; other columns are not looked at.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.base import ascii_lower, mapped, stored
from tapeloom.llm.words import grams, joined, separators, word_hashes

# fixed values: phrases and their labels
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# fixed values: openings and notices of public licenses, by the label that a match gives
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mit-text": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Released under the MIT License",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = tuple(range(0x00, 0x30)) + tuple(range(0x3A, 0x61)) + tuple(range(0x7B, 0x80))
#: Share of a long template's votes and words that make a match; words by which merged diagonals may differ.
SHARE, SLACK = 0.6, 3
#: Votes that let a span through to the verification: so many, and such a share of the template's pairs, but never more than SHARE of them.
#: A changed word costs two pairs, so that 60 % of the words can leave few of them.
VOTES = 4, 0.2


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.encode().lower().decode())


def _hits_schema(kind: str) -> str:
    return f"key {kind}, place int, gram long"


def rolling_pairs(texts: DataFrame) -> DataFrame:
    """(key, place, gram): the hash of every two consecutive words and the number of the first of them."""

    def kernel(batch):
        data, begins = joined(batch.column(1).cast(pa.binary()).to_pylist())
        words, owner = word_hashes(data, begins, separators(_BETWEEN))
        pairs = grams(words, 2)
        inside = np.flatnonzero(owner[:len(pairs)] == owner[1:]) if len(pairs) else np.zeros(0, np.int64)
        own = owner[inside]
        count = np.bincount(owner, minlength=batch.num_rows) if len(owner) else np.zeros(batch.num_rows, np.int64)
        place = inside - (np.cumsum(count) - count)[own]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(own)), pa.array(place.astype(np.int32)), pa.array(pairs[inside].view(np.int64))], ["key", "place", "gram"])

    return mapped(texts.select("key", "text"), kernel, _hits_schema("long"))


def template_rows() -> tuple[list[tuple], list[tuple]]:
    """Templates (number, label, exact, words) and their pairs (gram, template, at)."""
    listed = [(label, True, words_of(p)) for p, label in PHRASES.items()] + [(label, False, words_of(t)) for label, ts in TEMPLATES.items() for t in ts]
    rows, pairs = [], []
    for n, (label, exact, words) in enumerate(listed):
        data, begins = joined([" ".join(words).encode()])
        hashes, _ = word_hashes(data, begins, separators(_BETWEEN))
        rows.append((n, label, exact, words))
        pairs += [(int(g), n, at) for at, g in enumerate(grams(hashes, 2).view(np.int64))]
    return rows, pairs


def _anchors(rows: list[tuple]) -> str:
    """A pattern that every text with a match contains: a match misses at most 1 - SHARE of a template's words.

    Of each template, the longest words that make up more than that; of a phrase, its longest word.
    """
    words = set()
    for _, _, exact, ws in rows:
        need = 1 if exact else (1 - SHARE) * len(ws)
        for w in sorted(set(ws), key=lambda w: (-len(w), w)):
            if sum(x in words for x in ws) > need or exact and sum(x in words for x in ws) == need:
                break
            words.add(w)
    return "|".join(re.escape(w) for w in sorted(words))


def diagonals(hits: DataFrame) -> DataFrame:
    """Votes of (key, template, place, at) per diagonal, then of merged neighbours: key, template, first, last, votes."""
    lines = hits.select("key", "template", (F.col("place") - F.col("at")).alias("line"), "at").distinct().groupBy("key", "template", "line").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("key", "template").orderBy("line")
    lines = lines.withColumn("apart", F.when(F.col("line") - F.lag("line").over(w) <= SLACK, 0).otherwise(1))
    lines = lines.withColumn("part", F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return lines.groupBy("key", "template", "part").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.sum("votes").alias("votes"))


def license_matches(docs: DataFrame) -> DataFrame:
    """key, label, exact, place, share of verified matches; key is a hash of doc_id and text (see ``keyed``)."""
    spark = docs.sparkSession
    rows, pairs = template_rows()
    grams_df = spark.createDataFrame(pairs, "gram long, template int, at int")
    kinds = spark.createDataFrame([(n, label, exact, len(words)) for n, label, exact, words in rows], "template int, label string, exact boolean, length int")
    # both tables are as large as the list of templates, whatever the input
    hits = rolling_pairs(docs).join(F.broadcast(grams_df), "gram").join(F.broadcast(kinds), "template")
    # few of a corpus's pairs are hits; written, so that both branches read them and the texts are cut once
    hits = stored(hits.select("key", "template", "place", "at", "exact", "length"), "hits")
    lines = hits.where("exact").select("key", "template", (F.col("place") - F.col("at")).alias("first"), "at", "length").distinct()
    exact = lines.groupBy("key", "template", "first", "length").agg(F.count("*").alias("votes")).where("votes = length - 1").select("key", "template", "first", F.col("first").alias("last"))
    enough = F.least(SHARE * (F.col("length") - 1), F.greatest(F.lit(float(VOTES[0])), VOTES[1] * (F.col("length") - 1)))
    long = diagonals(hits.where("not exact")).join(F.broadcast(kinds), "template").where(F.col("votes") >= enough).select("key", "template", "first", "last")
    spans = exact.union(long).groupBy("key").agg(F.collect_list(F.struct("template", "first", "last")).alias("spans"))
    spans = stored(spans, "spans")
    # every text with a span has one of the anchor words, so that only few texts move
    lower = ascii_lower(F.col("text"))
    texts = docs.select("key", "text").where(lower.rlike(_anchors(rows))).join(spans, "key").dropDuplicates(["key"])

    def verify(batch):
        out = []
        for key, text, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = words_of(text)
            for s in found:
                _, label, exact, want = rows[s["template"]]
                if exact:
                    share = float(words[s["first"]:s["first"] + len(want)] == want)
                else:
                    part = words[max(0, s["first"] - SLACK):s["last"] + len(want) + SLACK]
                    share = sum(b.size for b in SequenceMatcher(None, want, part, autojunk=False).get_matching_blocks()) / len(want)
                if share >= (1 if exact else SHARE):
                    out.append((key, label, exact, s["first"], share))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.float64()))],
                                         ["key", "label", "exact", "place", "share"])

    return mapped(texts, verify, "key long, label string, exact boolean, place long, share double")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: words, exact phrase places and the labels of phrases and templates; score is the best match's share."""
    docs = keyed(docs)
    base = F.col("exact")
    found = license_matches(docs).groupBy("key").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("place"))).alias("first_word"), F.max(F.when(base, F.col("place"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"))
    # upper-case letters count as word letters here, which saves the lower-casing
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    light = docs.select("doc_id", "key", F.regexp_count("text", F.lit(word)).cast("long").alias("n_words"))
    return light.join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
