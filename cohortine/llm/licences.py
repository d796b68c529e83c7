"""License scan by diagonal voting.

Templates are short phrases, notices and whole licenses. All rolling k-grams of words of all texts are held against those
of the templates (the hashes of the templates' grams go to every task; the places are found by a join). A gram at word p
of a text and word q of a template votes for the diagonal p - q. A phrase stands where all its grams vote for one
diagonal. A notice may stand where neighbouring diagonals (words inserted or left out shift them) together hold enough of
its grams: each diagonal is taken with those at most GAP above it, so a candidate is never longer than its template and
the gap.

Candidates are verified on the words themselves: the template is aligned with the words along its diagonals, and at most
a share of 1 - LEAST_WORDS of its words may be inserted, left out or exchanged. What tells licenses apart is not
negotiable: its numbers, names and clauses must stand, and no other number or clause may stand between its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import few, saved
from .text_keys import ALNUM, LOWER, gram_hashes, slices, words

GRAM = 3
#: Diagonals of a notice that lie no further apart are one candidate; share of a notice's grams that it must hold.
GAP = 3
LEAST_SHARE = 0.5
#: Share of a notice's words that must stand, and words that tell licenses apart (numbers do so too).
LEAST_WORDS = 0.75
TELLING = frozenset(b"affero lesser library sa nd nc by zero mit apache gnu bsd mozilla creative".split())


class Template(NamedTuple):
    label: str
    text: str
    phrase: bool  # must stand word for word


TEMPLATES = [
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("mit-line", "released under the mit license", False),
    Template("apache-2.0", "licensed under the apache license version 2 0", False),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", False),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", False),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", False),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", False),
    Template("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
    Template("apache-notice", "you may not use this file except in compliance with the license you may obtain a copy of the license at", False),
    Template("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", False),
]


def _words_of(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), np.uint8)
    found = words(data, np.array([0, len(data)]), ALNUM)
    lower = LOWER[data].tobytes()
    return [lower[a:b] for a, b in zip(found.starts.tolist(), found.ends.tolist(), strict=True)]


def _template_grams(templates: list[Template]) -> list[tuple[int, int, int, int, int]]:
    """(template, gram hash, place, words of the gram, grams of the template)."""
    out = []
    for number, t in enumerate(templates):
        data = np.frombuffer(t.text.encode(), np.uint8)
        found = words(data, np.array([0, len(data)]), ALNUM)
        k = min(GRAM, len(found.hashes))
        grams = gram_hashes(found.hashes, k).view(np.int64).tolist() if k else []
        out += [(number, g, q, k, len(grams)) for q, g in enumerate(grams)]
    return out


def _tells(word: bytes) -> bool:
    return word.isdigit() or word in TELLING


def align(template: list[bytes], text: list[bytes], low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of a template with words of a text, or none with at most `most` edits.

    Word q of the template may meet words p of the text with low <= p - q <= high. Words before and after the span are
    free; words that tell licenses apart can neither be exchanged nor left out nor inserted.
    """
    far = most + 1
    width = high - low + 1
    # cost and negative start of the best alignment of the first q words that ends before word q + low + i; of equally good
    # ones the shortest span stays
    cost = [0 if 0 <= low + i <= len(text) else far for i in range(width + 1)]
    start = [-low - i for i in range(width + 1)]
    for q, word in enumerate(template):
        fixed, above, begun = _tells(word), cost, start
        cost, start = [far] * (width + 1), [0] * (width + 1)
        for i in range(width + 1):  # before word q + 1 + low + i
            p = q + low + i
            best = (far, 0)
            if 0 <= p < len(text) and above[i] < far:
                best = (above[i] + (text[p] != word), begun[i]) if text[p] == word or not (fixed or _tells(text[p])) else best
            if i < width and not fixed:
                best = min(best, (above[i + 1] + 1, begun[i + 1]))
            if i and 0 <= p < len(text) and cost[i - 1] < far and not _tells(text[p]):
                best = min(best, (cost[i - 1] + 1, start[i - 1]))
            if best[0] <= most:
                cost[i], start[i] = best
    edits, i = min((c, i) for i, c in enumerate(cost))
    return (edits, -start[i], len(template) + low + i) if edits <= most else None


def gram_places(docs: DataFrame, grams: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """A row (doc_id, n_words) of each text, and (doc_id, gram, place) of each of its grams that a template has."""
    wanted = {k: np.unique(np.array([g for _, g, _, size, _ in grams if size == k], np.int64)) for k in sorted({g[3] for g in grams})}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, to, data, offsets in slices(batch.column(1)):
                found = words(data, offsets, ALNUM)
                n = np.diff(found.first)
                ends, starts, doc = (np.repeat(x, n) for x in (found.first[1:], found.first[:-1], ids[at:to]))
                gram, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for k, table in wanted.items():
                    own = gram_hashes(found.hashes, k).view(np.int64)
                    near = np.minimum(np.searchsorted(table, own), len(table) - 1)
                    hit = np.flatnonzero(table[near] == own)
                    hit = hit[hit + k <= ends[hit]]
                    gram.append(own[hit])
                    place.append(hit)
                gram, place = np.concatenate(gram), np.concatenate(place)
                blank = pa.nulls(to - at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids[at:to], doc[place]])), pa.concat_arrays([pa.array(n), pa.nulls(len(place), pa.int64())]),
                        pa.concat_arrays([blank, pa.array(gram)]), pa.concat_arrays([blank, pa.array(place - starts[place])]),
                    ],
                    ["doc_id", "n_words", "gram", "place"],
                )

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, n_words long, gram long, place long")


def _verified(docs: DataFrame, candidates: DataFrame, templates: list[Template]) -> DataFrame:
    """(doc_id, template, start, end, share) of the candidates (doc_id, template, low, high) that stand in the texts."""
    pieces = [_words_of(t.text) for t in templates]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(len(batch)):
                doc, text, offers = (batch.column(c)[i].as_py() for c in range(3))
                text = _words_of(text or "")
                for offer in offers:
                    piece = pieces[offer["template"]]
                    found = align(piece, text, offer["low"], offer["high"], int((1 - LEAST_WORDS) * len(piece)))
                    if found is not None:
                        out.append((doc, offer["template"], *found[1:], 1 - found[0] / len(piece)))
            columns = zip(*out, strict=True) if out else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "template", "start", "end", "share"])

    offers = candidates.groupBy("doc_id").agg(F.collect_list(F.struct("template", "low", "high")).alias("offers"))
    held = docs.join(few(saved(candidates.select("doc_id").distinct())), "doc_id", "left_semi")
    found = held.select("doc_id", "text").join(offers, "doc_id").mapInArrow(verify, "doc_id long, template int, start long, end long, share double")
    # neighbouring candidates find one span with different ends: of those that begin together the best stays
    best = F.max(F.struct("share", -F.col("end"))).alias("b")
    return found.groupBy("doc_id", "template", "start").agg(best).select("doc_id", "template", "start", (-F.col("b.col2")).alias("end"), "b.share")


def license_spans(docs: DataFrame, templates: list[Template] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_words) of each document, and (doc_id, label, phrase, start, end, share) of each template found in one.

    Null texts are empty. Rows with a null doc_id take no part, rows that repeat a doc_id are one document with the words
    of the longest and the finds of all. Templates may have any length. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    grams = _template_grams(templates)
    rows = saved(gram_places(docs, grams))
    sizes = rows.where("gram IS NULL").groupBy("doc_id").agg(F.max("n_words").alias("n_words"))
    table = spark.createDataFrame(grams, "template int, gram long, at int, k int, n_grams int")
    # both tables have a row for each template or gram of one, whatever the number of texts
    table = F.broadcast(table)
    kinds = spark.createDataFrame([(i, t.label, t.phrase, len(_words_of(t.text))) for i, t in enumerate(templates)], "template int, label string, phrase boolean, size int")
    kinds = F.broadcast(kinds)
    votes = rows.where("gram IS NOT NULL").join(table, "gram").select("doc_id", "template", "n_grams", "at", (F.col("place") - F.col("at")).alias("diagonal")).join(F.broadcast(kinds.select("template", "phrase")), "template")
    whole = votes.where("phrase").groupBy("doc_id", "template", "n_grams", "diagonal").agg(F.countDistinct("at").alias("held")).where("held = n_grams")
    phrases = whole.select("doc_id", "template", F.col("diagonal").alias("start"), F.lit(1.0).alias("share"))
    along = Window.partitionBy("doc_id", "template").orderBy("diagonal").rangeBetween(0, GAP)
    diagonals = votes.where("NOT phrase").groupBy("doc_id", "template", "n_grams", "diagonal").agg(F.collect_set("at").alias("own"))
    candidates = (
        diagonals.withColumn("held", F.size(F.array_distinct(F.flatten(F.collect_list("own").over(along)))))
        .where(F.col("held") >= LEAST_SHARE * F.col("n_grams"))
        .select("doc_id", "template", (F.col("diagonal") - GAP).alias("low"), (F.col("diagonal") + GAP).alias("high"))
    )
    notices = _verified(docs, saved(candidates), templates).select("doc_id", "template", "start", "end", "share")
    found = phrases.join(kinds, "template").select("doc_id", "label", "phrase", "start", (F.col("start") + F.col("size")).alias("end"), "share")
    return sizes, found.union(notices.join(kinds, "template").select("doc_id", "label", "phrase", "start", "end", "share"))


def license_report(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """Per document the phrases' places and labels, all labels, and the best share as score; see `license_spans`."""
    sizes, spans = license_spans(docs, templates)
    base = F.when(F.col("phrase"), F.col("start"))
    found = spans.groupBy("doc_id").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
    )
    return sizes.join(found, "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
