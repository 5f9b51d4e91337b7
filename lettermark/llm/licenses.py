"""License scans: phrases word by word, and templates by an exact set-similarity join of text blocks.

A block is a line. It meets a template when it holds at least the share `containment` of the template's distinct words.
Notices wrapped over lines are met by windows: stretches of a text of at most a template's words and a quarter more, over
line ends, that hold the same share of its distinct words. A window inside one line adds nothing to the line's block.
Words outside all templates cannot matter, so a block is the set of its template words, in order of how few documents
hold them. A block and a template that meet share a word among the first of each (prefix), the block has enough words
(length), and the places of the shared word leave room for the overlap (position); what passes is compared whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermark.llm.arrow import LOWER, WORD, hash_spans, runs, slices, text_bytes
from lettermark.session import cut_lineage

# Phrases and the labels they give.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label and wording of the templates. Short notices are reduced to at most four different words, all of
# which are needed at 80 %: of five, the one that names the license could be missing.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache", "under the Apache License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "under the BSD License"),
    ("bsd", "BSD 2-Clause License"),
    ("bsd", "BSD 3-Clause License"),
    ("cc-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-notice", "Creative Commons Attribution"),
    ("cc-notice", "under CC BY"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("gpl-notice", "GNU General Public License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("mit", "under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "Mozilla Public License"),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("public-domain", "into the public domain"),
    ("reserved-notice", "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher."),
    ("reserved-notice", "Copyright. All rights reserved."),
]
#: Words of all templates that may be sent to every task; more are refused.
MOST_WORDS = 1_000_000


def words_of(text: str) -> list[str]:
    lowered = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def _hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw]).astype(np.int64)
    starts = ends - np.array([len(w) for w in raw], np.int64)
    return hash_spans(np.frombuffer(b"".join(raw), np.uint8), starts, ends)


def required(size: int, percent: int) -> int:
    return max(1, -(-size * percent // 100))


def reach(text: str) -> int:
    """Words of a window for a template."""
    return -(-len(words_of(text)) * 5 // 4)


class Windows:
    """Finds the rows with a window that holds enough of a template's words."""

    def __init__(self, templates: list[tuple[str, str]], vocabulary: list[str], percent: int):
        number = {w: k for k, w in enumerate(vocabulary)}
        self.sets = [np.array(sorted({number[w] for w in words_of(text)}), np.int64) for _, text in templates]
        self.need = np.array([required(len(s), percent) for s in self.sets], np.int64)
        self.reach = [reach(text) for _, text in templates]
        self.words = np.concatenate(self.sets)
        self.heads = np.concatenate(([0], np.cumsum([len(s) for s in self.sets])[:-1]))
        self.size = len(vocabulary)

    def search(self, place: np.ndarray, word: np.ndarray, row: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
        """(row, template, most distinct words of a window) from the places of the template words, in order."""
        present = np.zeros(self.size, bool)
        present[word] = True
        for t in np.flatnonzero(np.add.reduceat(present[self.words].astype(np.int64), self.heads) >= self.need).tolist():
            own = np.zeros(self.size, bool)
            own[self.sets[t]] = True
            mine = own[word]
            held = np.bincount(np.unique(np.stack([row[mine], word[mine]], 1), axis=0)[:, 0], minlength=n) >= self.need[t]
            at = np.flatnonzero(mine & held[row])
            if not len(at):
                continue
            p, w, r = place[at], word[at], row[at]
            low = np.maximum(p - self.reach[t] + 1, place[at[np.searchsorted(r, r)]])
            count = np.zeros(len(at), np.int64)
            for one in self.sets[t].tolist():
                count += np.maximum.accumulate(np.where(w == one, p, -1)) >= low
            most = np.zeros(n, np.int64)
            np.maximum.at(most, r, count)
            for k in np.flatnonzero(most >= self.need[t]).tolist():
                yield k, t, int(most[k])


def scan_words(docs: DataFrame, phrases: dict[str, str], vocabulary: list[str], templates: list[tuple[str, str]], percent: int) -> DataFrame:
    """Per row of `docs` (doc_id, text): phrase places and the template words of the text and of its blocks.

    `found` lists the template words of the text, `blocks` the sets of template words of the lines that hold enough for
    any template, `windows` the templates met by windows with the most words that one holds.
    """
    listed = [(words_of(p), label) for p, label in phrases.items()]
    least = min(required(len(set(words_of(text))), percent) for _, text in templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        targets = [(_hashes(w), label) for w, label in listed]
        known = _hashes(vocabulary)
        order = np.argsort(known)
        known = known[order]
        windows = Windows(templates, vocabulary, percent)
        for batch in batches:
            offsets, data = text_bytes(batch.column(2))
            rows: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "found", "blocks", "windows")}
            for a, b in slices(offsets):
                raw, at = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
                starts, ends = runs(WORD[raw], at)
                h = hash_spans(raw, starts, ends)
                first = np.searchsorted(starts, at)
                n = b - a
                n_base, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                labels: list[set[str]] = [set() for _ in range(n)]
                for target, label in targets:
                    k = len(target)
                    hit = np.flatnonzero(h[: len(h) - k + 1] == target[0]) if len(h) >= k else np.zeros(0, np.int64)
                    for j in range(1, k):
                        hit = hit[h[hit + j] == target[j]]
                    row = np.searchsorted(first, hit, "right") - 1
                    inside = hit + k <= first[row + 1]
                    hit, row = hit[inside], row[inside]
                    np.add.at(n_base, row, 1)
                    np.minimum.at(low, row, hit - first[row])
                    np.maximum.at(high, row, hit - first[row])
                    for r in np.unique(row).tolist():
                        labels[r].add(label)
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[place] == h)
                word, row = order[place[hit]], np.searchsorted(first, hit, "right") - 1
                line = np.searchsorted(np.flatnonzero(raw == 10), starts[hit])
                found = [[] for _ in range(n)]
                for r, w in np.unique(np.stack([row, word], 1), axis=0).tolist():
                    found[r].append(w)
                blocks: list[list[list[int]]] = [[] for _ in range(n)]
                cells = np.unique(np.stack([row, line, word], 1), axis=0)
                if len(cells):
                    head = np.flatnonzero(np.concatenate(([True], (cells[1:, :2] != cells[:-1, :2]).any(1))))
                    for i, j in zip(head.tolist(), [*head[1:].tolist(), len(cells)], strict=True):
                        if j - i >= least:
                            blocks[cells[i, 0]].append(cells[i:j, 2].tolist())
                wide: list[list[dict[str, int]]] = [[] for _ in range(n)]
                for r, t, most in windows.search(hit, word, row, n):
                    wide[r].append({"template": t, "held": most})
                rows["n_words"] += np.diff(first).tolist()
                rows["n_base"] += n_base.tolist()
                rows["first_word"] += [int(x) if c else None for x, c in zip(low, n_base, strict=True)]
                rows["last_word"] += [int(x) if c else None for x, c in zip(high, n_base, strict=True)]
                rows["base_labels"] += [sorted(x) for x in labels]
                rows["found"] += found
                rows["blocks"] += blocks
                rows["windows"] += wide
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.struct([("template", pa.int32()), ("held", pa.int32())]))]
            columns = [pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "row_key", *rows])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row_key long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, found array<int>, blocks array<array<int>>, windows array<struct<template: int, held: int>>"
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(scan, schema)


def block_matches(scanned: DataFrame, templates: list[tuple[str, str]], vocabulary: list[str], percent: int) -> DataFrame:
    """(row_key, block, label, containment) of every block and template that meet; `block` counts the kept lines of a text."""
    spark: SparkSession = scanned.sparkSession
    seen = scanned.select(F.explode("found").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["word"]: r["n"] for r in seen.collect()}  # template words only
    order = sorted(range(len(vocabulary)), key=lambda w: (counts.get(w, 0), vocabulary[w]))
    rank = {w: i for i, w in enumerate(order)}
    sets = [(label, sorted(rank[vocabulary.index(w)] for w in set(words_of(text)))) for label, text in templates]
    rows = [(t, label, s, len(s), required(len(s), percent)) for t, (label, s) in enumerate(sets)]
    known = spark.createDataFrame(rows, "template int, label string, words array<int>, size int, need int")
    known = known.select("*", F.posexplode(F.slice("words", F.lit(1), F.col("size") - F.col("need") + 1)).alias("i", "word"))
    least = min(need for *_, need in rows)
    ranks = F.array(*[F.lit(rank[w]) for w in range(len(vocabulary))])
    blocks = scanned.where("size(blocks) > 0").select("row_key", F.posexplode("blocks").alias("block", "ids"))
    blocks = blocks.withColumn("mine", F.array_sort(F.transform("ids", lambda w: F.element_at(ranks, w + 1))))
    prefix = F.slice("mine", F.lit(1), F.size("mine") - least + 1)
    cand = blocks.select("row_key", "block", "mine", F.posexplode(prefix).alias("j", "word")).join(F.broadcast(known), "word")  # at most MOST_WORDS words
    room = F.least("i", "j") + 1 + F.least(F.col("size") - F.col("i") - 1, F.size("mine") - F.col("j") - 1)
    cand = cand.where((F.size("mine") >= F.col("need")) & (room >= F.col("need")))
    both = F.array_intersect("mine", "words")
    cand = cand.withColumn("both", both).where((F.array_min("both") == F.col("word")) & (F.size("both") >= F.col("need")))
    return cand.select("row_key", "block", "label", (F.size("both") / F.col("size")).alias("containment"))


def window_matches(scanned: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(row_key, label, containment) of every text and template that meet by a window."""
    rows = [(t, label, len(set(words_of(text)))) for t, (label, text) in enumerate(templates)]
    known = scanned.sparkSession.createDataFrame(rows, "template int, label string, size int")
    met = scanned.select("row_key", F.inline("windows"))
    return met.join(F.broadcast(known), "template").select("row_key", "label", (F.col("held") / F.col("size")).alias("containment"))  # at most MOST_WORDS templates


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, percent: int = 80) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is 1 for texts with a phrase, else the largest containment among the templates met, else 0. NULL and
    empty texts have no words. Equal rows get equal results, NULL ids are ids like others, other columns are ignored,
    an empty table gives no rows.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    vocabulary = sorted({w for _, text in templates for w in words_of(text)})
    if len(vocabulary) > MOST_WORDS:
        raise ValueError(f"the templates have more than {MOST_WORDS} words")
    scanned = cut_lineage(scan_words(docs, phrases, vocabulary, templates, percent))
    met = block_matches(scanned, templates, vocabulary, percent).drop("block").unionByName(window_matches(scanned, templates))
    met = met.groupBy("row_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    return scanned.join(met, "row_key", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )
