"""Substring dedup (4): long word passages that occur more than once, by paths of windows with a shared anchor.

This is not the de Bruijn graph that was dealt: there are no tables of edges and nodes, no degrees and no joins
that contract chains.  Windows of ``window`` words are bucketed by their anchor, and consecutive windows with one
anchor position are one path, formed at the source, so that the joins in ``repeats.py`` meet a row per path and
open windows one by one only where paths differ.  A path ends where the anchor changes, not at a branch.
Repeated paths keep the coordinates of all their occurrences; words are removed by them.  A path
counts as repeated by its hashes alone; source texts are not compared.

Null, empty and blank texts have no words.  Texts shorter than a window lose nothing.
Rows that repeat ``doc_id`` and text are copies like any others: all their windows occur
twice, and every row loses them.  An empty table gives no rows.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.repeats import Spec, repeated_ranges, runs, without_repeats
from isohyet.llm.text import blanks, keyed, session_of, word_hashes


def word_edges(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(blanks(np.frombuffer(text, np.uint8)).view(np.int8), prepend=np.int8(1), append=np.int8(1))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _cut(text: bytes, marks: np.ndarray):
    kept = b" ".join(compress(text.split(), ~marks)).decode()
    return len(marks), int(marks.sum()), kept, runs(marks)


def remove_repeated_words(documents: DataFrame, window: int = 35, group: int = 1500) -> DataFrame:
    """A row per document: ``n_words``, ``n_removed``, ``kept_text`` (kept words, single blanks) and the removed ``spans``."""
    session_of(documents)
    docs = keyed(documents)
    spec = Spec(window, min(10, window), word_hashes, word_edges, group)
    schema = "n_words long, n_removed long, kept_text string, spans array<struct<start:long,stop:long>>"
    return without_repeats(repeated_ranges(docs, spec), spec, docs, _cut, schema)


def digest(documents: DataFrame, window: int = 35) -> DataFrame:
    return remove_repeated_words(documents, window).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
