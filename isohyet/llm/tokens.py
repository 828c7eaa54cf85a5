"""Token counts (7): byte-pair merging with a heap and a linked list, counting only.

A text is cut at the special strings of the vocabulary (one token each, as the library does by
default), the rest by the pre-tokeniser's pattern.  A piece starts as one symbol a byte; the
adjacent pair of lowest rank, leftmost first, is popped from a heap and merged until none is left.
The count is the symbols at the start less the merges; no identifiers are made.  Counts of pieces
are remembered within a task, up to a bound.

Null counts as empty, empty texts have no tokens; rows that repeat are counted alike; an empty
table gives no rows.  The time for a piece of n bytes grows as n log n.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.text import session_of

#: Fixed value: the pattern of byte-level pre-tokenisers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED, LONGEST = 600_000, 48


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones themselves, others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """Ranks of pairs of symbols and the symbol that each pair becomes, as numbers."""

    def __init__(self, text: str):
        data = json.loads(text)
        model = data["model"]
        ids = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.shift = max(ids.values()).bit_length()
        self.pairs = {ids[a] << self.shift | ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.start = [ids[x] for x in byte_letters()]
        special = [x["content"] for x in data["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Tokens of one piece."""
        symbols = [self.start[b] for b in piece]
        n = len(symbols)
        pairs, shift = self.pairs, self.shift
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # rank and place in one number; the pair itself tells whether an entry is still true
        heap = []
        for i in range(n - 1):
            found = pairs.get(symbols[i] << shift | symbols[i + 1])
            if found:
                heap.append((found[0], i, symbols[i], symbols[i + 1]))
        heapify(heap)
        left = n
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i] = pairs[a << shift | b][1]
            symbols[j] = -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = pairs.get(symbols[i] << shift | symbols[k])
                if found:
                    heappush(heap, (found[0], i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0:
                found = pairs.get(symbols[h] << shift | symbols[i])
                if found:
                    heappush(heap, (found[0], h, symbols[h], symbols[i]))
        return left

    def of_piece(self, piece: str) -> int:
        value = self.merged(piece.encode())
        if len(piece) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = value
        return value

    def count(self, text: str) -> int:
        special = 0
        parts = [text]
        if self.special:
            parts = self.special.split(text)
            special = len(parts) - 1
        get, total = self.known.get, special
        for part in parts:
            for piece in self.pattern.findall(part):
                total += get(piece) or self.of_piece(piece)
        return total


@lru_cache(maxsize=2)
def _merges(text: str) -> Merges:
    return Merges(text)


def token_counter(documents: DataFrame, path: str):
    """A function of a text column to its number of tokens; ``path``: a byte-level BPE file (JSON) that the driver reads."""
    with open(path, encoding="utf-8") as file:
        vocabulary = session_of(documents).sparkContext.broadcast(file.read())  # a few megabytes, fixed by the tokenizer

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        merges = _merges(vocabulary.value)
        return pa.array([merges.count(t) if t else 0 for t in texts.to_pylist()], pa.int64())

    def of(text: Column) -> Column:
        return count(text)

    return of


def token_counts(documents: DataFrame, path: str) -> DataFrame:
    """All columns are dropped but ``doc_id``; ``n_bytes`` and ``n_tokens`` of every whole text."""
    count = token_counter(documents, path)
    return documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                            count(F.col("text")).alias("n_tokens"))


def digest(documents: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    return token_counts(documents, path).withColumn("over_limit", F.col("n_tokens") > limit)
