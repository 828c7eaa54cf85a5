"""Exact dedup (1): documents that are equal without blanks, by counting quotient filters.

A filter splits the 64-bit fingerprint of a normalised text into a quotient (high bits) and a
remainder; it is a sorted run of remainders with counts for every quotient.  Each partition builds
one, equal texts of a partition being one slot, so that a group with a third of all rows moves once
a partition.  The filters meet by quotient and merge without loss, sorted remainders against
sorted remainders.  Only documents whose fingerprint counts more than once are compared byte by
byte (grouped by the normalised text itself).

Null counts as empty, and empty and blank texts are one group.  Of equal texts the longest original
stays (code points), then the smallest ``doc_id``, a null id last; of rows that repeat both, one.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.text import drop_rows, session_of
from isohyet.session import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
#: Fingerprints that a task holds before it hands a filter on.
HELD = 4_000_000


def filter_of(fingerprints: np.ndarray, counts: np.ndarray, bits: int):
    """Quotients, bounds of their runs, remainders and counts of the filter of some (repeated) fingerprints."""
    order = np.argsort(fingerprints)
    sorted_, counts = fingerprints[order], counts[order]
    head = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    counts = np.add.reduceat(counts, head)
    slots = sorted_[head]
    quotients = slots >> np.uint64(64 - bits)
    bounds = np.flatnonzero(np.r_[True, quotients[1:] != quotients[:-1], True])
    return quotients[bounds[:-1]], bounds, slots & np.uint64((1 << 64 - bits) - 1), counts


def _filters(fingerprints: DataFrame, bits: int) -> DataFrame:
    """A row per partition and quotient: the run of sorted remainders and their counts."""

    def emit(held):
        values = np.concatenate(held)
        quotients, bounds, remainders, counts = filter_of(values.view(np.uint64), np.ones(len(values), np.int64), bits)
        cuts = list(zip(bounds[:-1], bounds[1:], strict=True))
        yield pa.RecordBatch.from_arrays([
            pa.array(quotients.astype(np.int64)),
            pa.array([remainders[a:b].tobytes() for a, b in cuts], pa.binary()),
            pa.array([counts[a:b].tobytes() for a, b in cuts], pa.binary()),
        ], ["quotient", "remainders", "counts"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column("fp").to_numpy())
            n += batch.num_rows
            if n >= HELD:
                yield from emit(held)
                held, n = [], 0
        if n:
            yield from emit(held)

    return fingerprints.mapInArrow(run, "quotient long, remainders binary, counts binary")


def _merged(filters: DataFrame, bits: int) -> DataFrame:
    """Fingerprints that the filters together count more than once."""

    def merge(quotient, rows):
        remainders = np.concatenate([np.frombuffer(r, np.uint64) for r, _ in rows])
        counts = np.concatenate([np.frombuffer(c, np.int64) for _, c in rows])
        _, _, slots, counts = filter_of(remainders, counts, bits)  # below one quotient the high bits are zero
        often = slots[counts > 1] | np.uint64(quotient << 64 - bits)
        return pa.RecordBatch.from_arrays([pa.array(often.view(np.int64))], ["fp"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("quotient", "remainders", "counts"))
            for quotient, remainders, counts in zip(*columns, strict=True):
                if quotient != now and rows:
                    yield merge(now, rows)
                    rows = []
                now = quotient
                rows.append((remainders, counts))
        if rows:
            yield merge(now, rows)

    return filters.repartition("quotient").sortWithinPartitions("quotient").mapInArrow(run, "fp long")


def repeated_fingerprints(fingerprints: DataFrame, bits: int = 14) -> DataFrame:
    """Values of ``fp`` that occur more than once."""
    return _merged(_filters(fingerprints.select("fp"), bits), bits)


def exact_groups(documents: DataFrame, bits: int = 14) -> DataFrame:
    """A row per document: ``doc_id, keep_id, group_size, kept, text_sha256, th`` (``th``: hash of the original text)."""
    session_of(documents)
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.translate(text, BLANKS, "")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), plain.alias("plain"),
                            F.length(text).alias("chars"), F.xxhash64(plain).alias("fp"), F.xxhash64("text").alias("th"))
    often = cut_lineage(repeated_fingerprints(rows, bits))
    best = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("id")))
    groups = rows.join(often, "fp", "left_semi").groupBy("plain").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    groups = groups.filter("n > 1").select(F.unhex(F.sha2(F.col("plain").cast("binary"), 256)).alias("sha"), "best", "n")
    groups = cut_lineage(groups)

    listed = cut_lineage(rows.select("doc_id", "chars", "th", F.unhex(F.sha2(F.col("plain").cast("binary"), 256)).alias("sha"),
                                     F.monotonically_increasing_id().alias("row")))
    first = listed.join(groups, "sha").filter("chars = best.chars AND (~doc_id) <=> best.id")
    first = first.groupBy("sha").agg(F.min("row").alias("first"))
    chosen = cut_lineage(groups.join(first, "sha"))  # a table of its own, so that the next join can split a large group
    single = F.col("n").isNull()
    return listed.join(chosen, "sha", "left").select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.bitwise_not("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (single | (F.col("row") == F.col("first"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "th",
    )


def exact_dedup(documents: DataFrame, bits: int = 14) -> DataFrame:
    """The documents without their copies, all columns as they were."""
    return drop_rows(documents, exact_groups(documents, bits))


def digest(documents: DataFrame) -> DataFrame:
    return exact_groups(documents).drop("th")
