"""Benchmark decontamination (9): words of documents inside any n-gram of a benchmark.

The normalised n-grams of the benchmark become a sorted array of hashes that every task holds;
documents are scanned once, whole, and every hash that matches is verified word by word.  The
array is broadcast only up to ``max_bytes`` of benchmark text; a larger benchmark is cut by a hash
of its items into as many blocks as it takes, each of which scans the documents in turn.

Words are runs of digits, letters and non-ASCII characters, A-Z in lower case.  An item with
fewer words than ``n`` is one n-gram, one without words is none.  Rows with one ``item_id`` are
one item; items without an id count and hit, but have no name.  Null and empty texts have no
words.  Rows that repeat are judged alike.  Empty tables give no rows, or no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.text import ITEM, KEY, SPAN_BASE, SpanHash, keyed, raw_texts, session_of, word_hashes
from isohyet.session import cut_lineage

FOUND = "struct<n_words:long,spans:array<struct<start:long,stop:long>>,items:array<string>,unnamed:boolean>"


def index_of(items: list[tuple[str | None, bytes]], n: int) -> dict[int, tuple[np.ndarray, list]]:
    """For each length of n-gram its sorted hashes, and the item, words and place of each."""
    by_length: dict[int, list] = {}
    for (item, text), hashes in zip(items, word_hashes([t for _, t in items], ITEM) if items else [], strict=True):
        if len(hashes):
            size = min(n, len(hashes))
            rolled = SpanHash(hashes, SPAN_BASE).rolling(size)
            words = text.translate(ITEM).split()
            by_length.setdefault(size, []).append((rolled, [(item, words, p) for p in range(len(rolled))]))
    out = {}
    for size, parts in by_length.items():
        hashes = np.concatenate([h for h, _ in parts])
        places = [x for _, p in parts for x in p]
        order = np.argsort(hashes, kind="stable")
        out[size] = hashes[order], [places[i] for i in order]
    return out


def scan(texts: list[bytes | None], index: dict) -> list[dict]:
    """Words, merged spans of hit words and items of every text."""
    words = word_hashes(texts, ITEM) if texts else []
    sizes = np.array([len(x) for x in words], np.int64)
    stops = np.cumsum(sizes)
    joined = SpanHash(np.concatenate(words), SPAN_BASE) if len(words) else None
    matches: dict[int, list] = {}
    for size, (hashes, places) in index.items():
        if not len(words) or stops[-1] < size:
            continue
        rolled = joined.rolling(size)
        left = np.searchsorted(hashes, rolled)
        hits = np.flatnonzero(hashes[np.minimum(left, len(hashes) - 1)] == rolled)
        owner = np.searchsorted(stops, hits, side="right")
        inside = hits + size <= stops[owner]
        for doc, at in zip(owner[inside], hits[inside], strict=True):
            matches.setdefault(int(doc), []).append((int(at - stops[doc] + sizes[doc]), size, int(left[at])))
    out = []
    for doc, n in enumerate(sizes):
        spans, items, unnamed = [], set(), False
        if doc in matches:
            own = texts[doc].translate(ITEM).split()
            mask = np.zeros(int(n) + 1, np.int64)
            for start, size, left in matches[doc]:
                hashes, places = index[size]
                gram, k = own[start:start + size], left
                while k < len(hashes) and hashes[k] == hashes[left]:
                    item, item_words, p = places[k]
                    if item_words[p:p + size] == gram:
                        mask[start] += 1
                        mask[start + size] -= 1
                        items.add(item)
                    k += 1
            edge = np.flatnonzero(np.diff(np.r_[False, np.cumsum(mask[:-1]) > 0, False].view(np.int8)))
            spans = [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
            unnamed = None in items
        out.append({"n_words": int(n), "spans": spans, "items": sorted(x for x in items if x is not None), "unnamed": unnamed})
    return out


def _scanner(index: Broadcast):
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                      ("items", pa.list_(pa.string())), ("unnamed", pa.bool_())])

    @F.arrow_udf(FOUND)
    def found(text: pa.Array) -> pa.Array:
        return pa.array(scan(raw_texts(text), index.value), kind)

    return found


def _blocks(benchmark: DataFrame, n: int, max_bytes: int):
    """Broadcast indexes of the items, ``max_bytes`` of text each, one after the other."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = items.distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * size // max_bytes)) if size > max_bytes else 1  # hashed blocks differ in size: half full on average
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield blocks, spark.sparkContext.broadcast(index_of([(r[0], r[1].encode()) for r in part.collect()], n))


def _hits(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, n: int = 10, max_bytes: int = 16 << 20) -> DataFrame:
    """A row per document: ``doc_id, th, n_words, n_hit, items, n_items`` and, from one block, the hit ``spans`` of words."""
    session_of(documents)
    docs = keyed(documents)
    parts = []
    for blocks, index in _blocks(benchmark, n, max_bytes):
        part = docs.select(*KEY, _scanner(index)("text").alias("f")).select(*KEY, "f.*")
        if blocks == 1:
            return part.select(*KEY, "n_words", _hits(F.col("spans")).alias("n_hit"), "items",
                               (F.size("items") + F.col("unnamed").cast("int")).cast("long").alias("n_items"), "spans")
        parts.append(cut_lineage(part.dropDuplicates(KEY)))
        index.unpersist()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))  # noqa: E731  one row a block
    words = F.transform("spans", lambda s: F.sequence(s["start"], s["stop"] - 1))
    merged = every.withColumn("words", F.flatten(words)).groupBy(*KEY).agg(
        F.max("n_words").alias("n_words"), F.size(flat("words")).cast("long").alias("n_hit"), F.sort_array(flat("items")).alias("items"),
        F.max("unnamed").alias("unnamed"))
    on = F.expr("d.doc_id <=> m.doc_id AND d.th = m.th")
    joined = docs.select(*KEY).alias("d").join(merged.alias("m"), on).select("d.*", "n_words", "n_hit", "items", "unnamed")
    return joined.select(*KEY, "n_words", "n_hit", "items",
                         (F.size("items") + F.col("unnamed").cast("int")).cast("long").alias("n_items"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = 10, max_bytes: int = 16 << 20) -> DataFrame:
    """The documents without hits, all columns as they were."""
    session_of(documents)
    clean = documents
    for _, index in _blocks(benchmark, n, max_bytes):
        clean = clean.filter(F.size(_scanner(index)(F.col("text").cast("string"))["spans"]) == 0)
    return clean


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    names = F.concat_ws(",", F.sort_array("items"))
    return benchmark_hits(documents, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
