"""Licence scans (13): a positional index of rare licence words.

The words of all licence texts and phrases are weighed by how few documents hold them (IDF over the whole corpus).  A
file's heaviest words of a licence are looked up in the licence's postings; occurrences at one distance from their place
in the licence, give or take ``slack`` words, are a candidate.  It counts if every mandatory phrase stands inside and
enough words of the licence are at their places.  Short phrases are found by their heaviest word, and every word around it
is compared, so that none is missed.

Words are runs of digits, letters and non-ASCII characters, A-Z in lower case.  Null and empty texts have no words and
no labels.  Rows that repeat are judged alike; an empty table gives no rows.  Long texts are cut into words piece by
piece.  Columns besides ``doc_id`` and ``text`` are not read.  Documents are scanned twice, in no shuffle but that of
the word counts, one row a licence word and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.text import ITEM, raw_texts, session_of

#: Phrases that name a licence, and the label of each.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Passages of public licences, and phrases without which they are not that licence.
TEXTS = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ["permission is hereby granted", "to deal in the software without restriction"]),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
        ["redistribution and use in source and binary forms", "retain the above copyright notice"]),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ["for any purpose with or without fee is hereby granted"]),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ["you may not use this file except in compliance with the license"]),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ["under the terms of the gnu general public license", "as published by the free software foundation"]),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ["subject to the terms of the mozilla public license"]),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
        ["free and unencumbered software released into the public domain"]),
    "cc": (
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this "
        "license, visit http://creativecommons.org/licenses/by/4.0/.",
        ["licensed under the creative commons"]),
}
#: Bytes of a piece that is cut into words at once.
PIECE = 1 << 20
FOUND = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
         "places array<struct<label:string,start:long,stop:long,score:double>>")


def words(text: str) -> list[bytes]:
    return text.encode().translate(ITEM).split()


class Index:
    """Numbers of the licence words, and licences and phrases in these numbers."""

    def __init__(self, texts: dict[str, tuple[str, list[str]]], phrases: dict[str, str]):
        self.number: dict[bytes, int] = {}
        self.phrases = [(self.numbers(p), label) for p, label in phrases.items()]
        self.texts = [(label, self.numbers(text), [self.numbers(p) for p in must]) for label, (text, must) in texts.items()]

    def numbers(self, text: str) -> np.ndarray:
        return np.array([self.number.setdefault(w, len(self.number)) for w in words(text)], np.int64)

    def of(self, text: bytes | None) -> np.ndarray:
        """The number of every word of a text, -1 for words of no licence."""
        data, parts, start = (text or b"").translate(ITEM), [], 0
        while start < len(data):
            stop = data.find(b" ", start + PIECE)
            stop = len(data) if stop < 0 else stop
            found = data[start:stop].split()
            parts.append(np.fromiter(map(self.number.get, found, repeat(-1)), np.int32, len(found)))
            start = stop
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


class Scanner:
    """Finds phrases and licences in texts, given the weight of every licence word."""

    def __init__(self, index: Index, weights: np.ndarray, rare: int, slack: int, share: float):
        self.index, self.weights, self.rare, self.slack, self.share = index, weights, rare, slack, share

    def phrase(self, text: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """Every place where the phrase starts."""
        heavy = int(np.argmax(self.weights[phrase]))
        starts = np.flatnonzero(text == phrase[heavy]) - heavy
        starts = starts[(starts >= 0) & (starts + len(phrase) <= len(text))]
        for n, word in enumerate(phrase):
            starts = starts[text[starts + n] == word]
        return starts

    def all_of(self, text: np.ndarray, held: np.ndarray, phrases: list[np.ndarray]) -> list[np.ndarray]:
        """The places of every phrase; nothing if one has none."""
        out = []
        for phrase in phrases:
            if not held[phrase].all() or not len(places := self.phrase(text, phrase)):
                return []
            out.append(places)
        return out

    def licence(self, text: np.ndarray, held: np.ndarray, licence: np.ndarray, must: list[np.ndarray]) -> list[tuple[int, int, float]]:
        """Start, stop and share of the words of every place of a licence."""
        # a file that lacks too many of the words, or a mandatory phrase, cannot hold the licence
        if held[licence].mean() < self.share or not (needed := self.all_of(text, held, must)):
            return []
        mine = np.unique(licence[held[licence]])
        mine = mine[np.argsort(-self.weights[mine], kind="stable")][: self.rare]
        # a word votes for the strip of distances it has to its places in the licence, and for the strip before
        strips = []
        for word in mine:
            apart = np.flatnonzero(text == word)[:, None] - np.flatnonzero(licence == word)[None]
            strip = apart.ravel() // self.slack
            strips.append(np.unique(np.concatenate([strip, strip - 1])))
        strip, votes = np.unique(np.concatenate(strips), return_counts=True)
        strip = strip[votes >= max(2, len(mine) // 2)]
        for places in needed:  # a mandatory phrase starts between the first distance and the end of the licence
            low = np.searchsorted(places, strip * self.slack)
            strip = strip[low < np.searchsorted(places, (strip + 2) * self.slack + len(licence))]
        out = []
        for low in (strip * self.slack).tolist():
            high = low + 2 * self.slack  # distances of this strip and the next
            part = text[max(0, low): high + len(licence)]
            matched = np.zeros(len(licence), bool)
            for apart in range(low, high):
                a, b = max(0, -apart), min(len(licence), len(text) - apart)
                if a < b:
                    matched[a:b] |= text[a + apart: b + apart] == licence[a:b]
            found = float(matched.mean())
            if found >= self.share:
                at = np.flatnonzero(np.isin(part, licence)) + max(0, low)
                out.append((int(at[0]), int(at[-1]) + 1, found))
        return merged(out)

    def scan(self, data: bytes | None) -> dict:
        text = self.index.of(data)
        held = np.zeros(len(self.weights) + 1, bool)
        held[text] = True  # the last for words of no licence
        places = []
        for phrase, label in self.index.phrases:
            for starts in self.all_of(text, held, [phrase]):
                places += [(label, s, s + len(phrase), 1.0, True) for s in starts.tolist()]
        for label, licence, must in self.index.texts:
            places += [(label, *p, False) for p in self.licence(text, held, licence, must)]
        base = [p for p in places if p[4]]
        starts = [p[1] for p in base]
        return {"n_words": len(text), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                "base_labels": ",".join(sorted({p[0] for p in base})), "labels": ",".join(sorted({p[0] for p in places})),
                "score": max((p[3] for p in places), default=0.0),
                "places": [dict(zip(("label", "start", "stop", "score"), p, strict=False)) for p in sorted(places, key=lambda p: p[1:3])]}


def merged(places: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Overlapping places of one licence as one, with the highest share."""
    out: list[tuple[int, int, float]] = []
    for start, stop, share in sorted(places):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]), max(share, out[-1][2]))
        else:
            out.append((start, stop, share))
    return out


def document_counts(documents: DataFrame, index: Index) -> DataFrame:
    """``word, n``: documents that hold each licence word."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(len(index.number) + 1, np.int64)  # the last for words of no licence
        for batch in batches:
            for text in raw_texts(batch.column("text")):
                total[np.unique(index.of(text))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(index.number))), pa.array(total[:-1])], ["word", "n"])

    return documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def licenses(documents: DataFrame, texts: dict = TEXTS, phrases: dict = PHRASES, rare: int = 12, slack: int = 8,
             share: float = 0.6) -> DataFrame:
    """One row a document: words, places of the phrases, labels, the best share of a licence's words, all places.

    ``rare`` is how many of a file's heaviest words of a licence are looked up, ``share`` how much of its words must be
    at their places.  ``score`` is 1 where a phrase stands.
    """
    spark = session_of(documents)
    index = Index(texts, phrases)
    held = {r["word"]: r["n"] for r in document_counts(documents, index).collect()}  # a row a licence word
    weights = -np.log1p(np.array([held.get(w, 0) for w in range(len(index.number))], float))
    shared = spark.sparkContext.broadcast(Scanner(index, weights, rare, slack, share))
    kind = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                      ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                      ("places", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]):
        scanner = shared.value
        for batch in batches:
            found = pa.array([scanner.scan(t) for t in raw_texts(batch.column("text"))], kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found.flatten()], ["doc_id", *[f.name for f in kind]])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id long, {FOUND}")


def digest(documents: DataFrame) -> DataFrame:
    return licenses(documents).drop("places")
