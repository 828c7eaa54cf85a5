"""Shared pieces of the text operators: words, span hashes, document keys, packed texts.

A document is known inside an operator by ``(doc_id, th)``, the id and a hash of
the text, compared null-safe.  Rows that repeat both are alike in every result,
and a null id is an id like any other.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.session import cut_lineage

ROOT = str(Path(__file__).resolve().parents[2])
SPACE = "[\\x20\\x09-\\x0D]"
#: For bytes.translate: A-Z in lower case, all else as it is.
LOWER = bytes(range(256)).lower()
#: Lower case, and a blank for every byte that is no digit, ASCII letter or part of a non-ASCII character.
ITEM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in LOWER)
KEY = ["doc_id", "th"]
#: Arrow batches small enough for long texts; shuffle files go when the job that wrote them is over.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def session_of(df: DataFrame) -> SparkSession:
    """The session of ``df``, with the settings of this folder."""
    spark = df.sparkSession
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)  # for Python workers of a local run from another folder
    return spark


def keyed(docs: DataFrame) -> DataFrame:
    """Only ``doc_id``, ``text`` and the hash ``th`` of the text; other columns cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64("text").alias("th"))


def same(left: str, right: str, names: list[str]) -> Column:
    """Null-safe equality of the named columns of two aliased tables."""
    on = F.lit(True)
    for name in names:
        on = on & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return on


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string or binary column, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class SpanHash:
    """Polynomial hashes modulo 2**64 of any spans of a sequence, from one running sum."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, symbols: np.ndarray, base: int):
        up, self.down = self.tables(base, len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    @classmethod
    def tables(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls.powers.get(base)
        if have is None or len(have[0]) < n:
            size = 1 << max(10, (n - 1).bit_length())
            made = []
            for b in (base, pow(base, -1, 1 << 64)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                made.append(np.cumprod(steps))
            have = cls.powers[base] = tuple(made)
        return have

    def of(self, start, stop) -> np.ndarray:
        """Hashes of the spans [start, stop)."""
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def rolling(self, width: int) -> np.ndarray:
        """Hashes of all spans of ``width`` symbols."""
        out = self.sums[width:] - self.sums[:-width]
        out *= self.down[: len(out)]
        return mix(out)


PRIME = (1 << 61) - 1
BLOCK = 1 << 12  #: numbers multiplied at once, so that what comes between stays in the processor's cache
_P, _S29, _S30, _S31, _S32, _S61 = (np.uint64(x) for x in (PRIME, 29, 30, 31, 32, 61))
_M29, _M30, _M31, _M32 = (np.uint64((1 << x) - 1) for x in (29, 30, 31, 32))


def drawn_base() -> int:
    """A base for ``PrimeHash``, drawn anew for every run, so that no text can be built against it."""
    return (1 << 31) + secrets.randbelow(PRIME - (1 << 32))


def reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo ``PRIME``."""
    x = (x & _P) + (x >> _S61)
    return np.minimum(x, x - _P)  # below PRIME the difference wraps around and is the larger one


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a1, a0, b1, b0 = a >> _S31, a & _M31, b >> _S31, b & _M31
    middle = a1 * b0
    middle += a0 * b1
    a1 *= b1
    a1 += a1
    a1 += middle >> _S30
    middle &= _M30
    middle <<= _S31
    a1 += middle
    a0 *= b0
    a1 += a0
    return reduced(a1)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo ``PRIME`` of numbers below it, from halves of 31 bits."""
    return np.concatenate([_times(a[i: i + BLOCK], b[i: i + BLOCK]) for i in range(0, len(a), BLOCK)] or [a])


class PrimeHash:
    """As ``SpanHash``, modulo the prime 2**61 - 1: different spans of n symbols share a hash for n of its bases at most."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, symbols: np.ndarray, base: int):
        up, self.down = self.tables(base, len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        for i in range(0, len(symbols), BLOCK):
            terms = _times(reduced(symbols[i: i + BLOCK]), up[i: i + BLOCK][: len(symbols) - i])
            high, low = np.cumsum(terms >> _S32), np.cumsum(terms & _M32)
            self.sums[i + 1: i + 1 + BLOCK] = reduced(((high & _M29) << _S32) + (high >> _S29) + low + self.sums[i])

    @classmethod
    def tables(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls.powers.get(base)
        if have is None or len(have[0]) < n:
            size = 1 << max(10, (n - 1).bit_length())
            made = []
            for b in (base, pow(base, -1, PRIME)):
                steps = np.ones(1, np.uint64)
                while len(steps) < size:
                    steps = np.concatenate([steps, times(steps, np.full(len(steps), pow(b, len(steps), PRIME), np.uint64))])
                made.append(steps)
            have = tuple(made)
            cls.powers = {base: have}  # a worker that serves several runs keeps the last one's
        return have

    def of(self, start, stop) -> np.ndarray:
        """Hashes of the spans [start, stop)."""
        return mix(times(reduced(self.sums[stop] + _P - self.sums[start]), self.down[start]))

    def rolling(self, width: int) -> np.ndarray:
        """Hashes of all spans of ``width`` symbols."""
        out = reduced(self.sums[width:] + _P - self.sums[:-width])
        return mix(times(out, self.down[: len(out)]))


#: Fixed odd numbers and a fixed random number for every byte value; results never depend on their choice.
WORD_BASE = 0xBF58476D1CE4E5B9
BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
SPAN_BASE = 0xD6E8FEB86659FD93
PLACE = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def blanks(data: np.ndarray) -> np.ndarray:
    """Whether each byte is one of ``SPACE``."""
    return _BLANK[data]


def _slices(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Cuts of about ``size`` bytes, each at a blank."""
    start = 0
    while start < len(data):
        stop = min(len(data), start + size)
        while stop < len(data) and not _BLANK[data[stop - 1]]:
            ahead = np.flatnonzero(_BLANK[data[stop: stop + size]])
            stop = stop + int(ahead[0]) + 1 if len(ahead) else min(len(data), stop + size)
        yield start, stop
        start = stop


def _words(part: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the words [start, stop) of ``part``."""
    size = stop - start
    inside = np.flatnonzero(~_BLANK[part])
    ends = np.cumsum(size)
    place = np.arange(len(inside)) - np.repeat(ends - size, size)
    sums = np.zeros(len(inside) + 1, np.uint64)
    np.cumsum(mix(BYTE[part[inside]] + place.astype(np.uint64) * PLACE), out=sums[1:])
    return mix(sums[ends] - sums[ends - size] + size.astype(np.uint64) * PLACE)


def word_hashes(texts: list[bytes | None], table: bytes | None = None, size: int = 1 << 18) -> list[np.ndarray]:
    """64-bit hashes of the words of every text; ``table`` translates bytes first. Blanks are those of ``SPACE``.

    A word is the sum of a mixed number for every byte at its place in the word, mixed with its length.  It is no polynomial: words
    built to collide in one, such as a Thue-Morse sequence and its complement, differ.
    """
    joined = b" ".join(t or b"" for t in texts) + b" "
    data = np.frombuffer(joined.translate(table) if table else joined, np.uint8)
    hashes, begins = [], []
    for a, b in _slices(data, size):
        part = data[a:b]
        edge = np.diff(_BLANK[part].view(np.int8), prepend=np.int8(1), append=np.int8(1))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        hashes.append(_words(part, start, stop))
        begins.append(start + a)
    hashes, begins = np.concatenate(hashes), np.concatenate(begins)
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    return np.split(hashes, np.searchsorted(begins, ends[:-1]))


def each_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """``mapInArrow`` with state made once per task by ``make``."""

    def run(batches):
        step = make()
        for batch in batches:
            yield from step(batch)

    return df.mapInArrow(run, schema)


def packed(df: DataFrame) -> DataFrame:
    """Key and text as zstd bytes (``packed``; null stays null), for a shuffle by document at a third of the size."""

    def make():
        zip_ = zstandard.ZstdCompressor(level=3).compress

        def step(batch):
            texts = [None if t is None else zip_(t) for t in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(texts, pa.binary())],
                                             ["doc_id", "th", "packed"])

        return step

    return each_batch(df.select("doc_id", "th", "text"), make, "doc_id long, th long, packed binary")


def unpack(column: pa.Array) -> list[bytes | None]:
    plain = zstandard.ZstdDecompressor().decompress
    return [None if t is None else plain(t) for t in raw_texts(column)]


def checked(stored: DataFrame, rows: int = 100_000) -> DataFrame:
    """A stored narrow table, marked for broadcast if it has no more than ``rows`` rows; beyond, joins shuffle it."""
    return F.broadcast(stored) if stored.count() <= rows else stored


def drop_rows(documents: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``documents``, all columns, without the rows that ``verdicts`` (``doc_id, th, kept``) does not keep.

    Of rows alike in ``doc_id`` and text one stays at most, any one.
    """
    states = verdicts.groupBy(*KEY).agg(F.count_if("kept").alias("stay"), F.count_if(~F.col("kept")).alias("go"))
    states = cut_lineage(states.filter("go > 0 OR stay > 1"))
    on = F.expr("CAST(d.doc_id AS LONG) <=> s.doc_id AND xxhash64(d.text) = s.th")
    stay = documents.alias("d").join(states.alias("s"), on, "left_anti")
    one = documents.alias("d").join(states.filter("stay > 0").alias("s"), on, "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.unionByName(one)
