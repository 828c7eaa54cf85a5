"""Suffix-array dedup (8): long byte strings that occur more than once, without a row per byte.

The dealt method, prefix doubling over all positions, is ``doubled``: ranks of all
suffixes by their first ``k``, then 2k, 4k, ... bytes, a sort or aggregate of rank pairs
each.  It moves a row per byte and round and cannot meet the limits (see the README),
so ``remove_repeated_bytes`` ranks sampled suffixes only (``repeats.py``): by their first
64 bytes, then by the whole path, then, where paths branch, by every window.  As in prefix
doubling a suffix leaves as soon as its rank is unique.  The results are the same.

Null counts as empty.  Texts shorter than a window lose nothing.  Rows that repeat
``doc_id`` and text are copies like any others.  Kept bytes need not be valid UTF-8.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.repeats import Spec, repeated_ranges, runs, without_repeats
from isohyet.llm.text import BYTE, KEY, SPAN_BASE, SpanHash, each_batch, keyed, raw_texts, session_of
from isohyet.session import cut_lineage


def byte_symbols(texts: list[bytes | None]) -> list[np.ndarray]:
    return [BYTE[np.frombuffer(t or b"", np.uint8)] for t in texts]


def byte_edges(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(len(text)), np.arange(1, len(text) + 1)


def _cut(text: bytes, marks: np.ndarray):
    spans = runs(marks)
    kept = np.frombuffer(text, np.uint8)[~marks].tobytes() if spans else text
    return len(text), int(marks.sum()), len(spans), kept, spans


SCHEMA = ("n_bytes long, n_removed long, n_spans long, kept binary, "
          "spans array<struct<start:long,stop:long>>")


def remove_repeated_bytes(documents: DataFrame, window: int = 400, group: int = 1500) -> DataFrame:
    """A row per document: ``n_bytes``, ``n_removed``, ``n_spans``, the ``kept`` bytes and the removed ``spans``."""
    session_of(documents)
    docs = keyed(documents)
    spec = Spec(window, min(64, window), byte_symbols, byte_edges, group)
    return without_repeats(repeated_ranges(docs, spec), spec, docs, _cut, SCHEMA)


def digest(documents: DataFrame, window: int = 400) -> DataFrame:
    return remove_repeated_bytes(documents, window).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def doubled(documents: DataFrame, window: int, start: int = 25) -> DataFrame:
    """Starts of repeated windows (``doc_id, th, p``) by prefix doubling over all positions, in rounds of Spark jobs.

    The rank of a position is the first place with the same prefix.  A round pairs the
    rank of each position with that at the present length further on (the last round
    overlaps, to end at ``window``), and positions of unique rank leave.  Rows of one key
    must not repeat: copies need ids of their own.
    """
    session_of(documents)
    docs = keyed(documents)
    length = min(start, window)

    def make():
        def step(batch):
            for i, symbols in enumerate(byte_symbols(raw_texts(batch.column("text")))):
                if len(symbols) >= length:
                    hashes = SpanHash(symbols, SPAN_BASE).rolling(length)
                    keys = [batch.column(c).take(pa.array(np.full(len(hashes), i))) for c in KEY]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(len(hashes))), pa.array(hashes.view(np.int64))],
                                                     [*KEY, "p", "rank"])

        return step

    def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
        names = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "p")).alias("rank_"))
        names = names.filter("n >= 2").select(*by, "rank_")
        return cut_lineage(rows.join(names, by).select(*KEY, "p", F.xxhash64("rank_").alias("rank")))

    rows = ranked(each_batch(docs, make, "doc_id long, th long, p long, rank long"), ["rank"])
    while length < window:
        step = min(length, window - length)
        ahead = rows.select("doc_id", "th", (F.col("p") - step).alias("p"), F.col("rank").alias("next"))
        on = F.expr("a.doc_id <=> b.doc_id AND a.th = b.th AND a.p = b.p")
        pairs = rows.alias("a").join(ahead.alias("b"), on).select("a.doc_id", "a.th", "a.p", "rank", "next")
        rows = ranked(pairs, ["rank", "next"])
        length += step
    return rows.select(*KEY, "p")
