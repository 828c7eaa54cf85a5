"""Cross-tokenizer alignment (12): which tokens of two vocabularies cover the same bytes, and how often.

Both token sequences of a text are cut at the byte offsets where tokens of both end.  All A-B pairs of a group
are linked.  The corpus count of a pair is the number of documents that hold it linked.

First pass: every task sums the pairs of its documents; the distinct pairs are cut by a hash into segments of about
``SEGMENT`` keys, and each segment gets a minimal perfect hash: bit arrays in which the keys that alone hold a bit are
placed, the others going to the next level; the rank of its bit is the slot of a key.  Tasks then write dense count
vectors by slot, summed segment by segment as a tree, and the key of every slot is kept to verify look-ups.  Second
pass: documents are aligned anew and look up their pairs, in blocks of ``BLOCK`` segments, each a bounded
broadcast; a further block scans the documents again.  Vocabularies bound the number of pairs, not the corpus.

Null and empty texts, and texts whose joined token bytes differ from a space and the text, have no tokens.  Rows that
repeat in id and text are documents of their own: each counts and each is returned.  Null ids are ids like
others; an empty table gives no rows.  Texts are tokenised in chunks, cut where neither tokenizer joins
across; a task remembers short ones.  Columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from isohyet.llm.text import KEY, keyed, mix, session_of
from isohyet.llm.tokens import PATTERN, byte_letters
from isohyet.session import cut_lineage

#: Keys of a segment, segments of a block, pairs that a task holds before it writes them.
SEGMENT, BLOCK, HELD = 1 << 16, 32, 1_000_000
#: Groups with more pairs are linked through their distinct tokens.
WIDE = 4096
#: Characters of a slice and of a word that ranks still take; documents at a time.
SLICE, LONG_WORD, AT_ONCE = 1 << 16, 400, 128
#: A pair is ``a << SHIFT | b``; above ``OWNER`` bits stands the document. Vocabularies have up to 2**24 tokens.
SHIFT, OWNER = 24, 48
#: A single blank between two characters at which neither tokenizer sees white space.
BOUNDARY = re.compile("(?<=[\\w!-/:-@\\[-`{-~]) (?=[\\w!-/:-@\\[-`{-~])")
WORD = re.compile(f"[^ ]{{{LONG_WORD}}}").search
#: Characters of which every version of the tables of letters and white space says the same.
PLAIN = re.compile("[\t\n\r -~\u00a1-\u024f\u0400-\u045f]*").fullmatch
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
KEPT = pa.schema([*((c, pa.int64()) for c in KEY), *((c, pa.binary()) for c in ("a", "b", "keys", "counts"))])
RESULT = ", ".join([f"{c} long" for c in (*KEY, *NUMBERS)] + ["groups_sha256 string"])


class Bytes:
    """The bytes of every token of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        stops = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[ids] - stops + sizes, sizes) + np.arange(stops[-1] if len(ids) else 0)]


class Aligner:
    """Both tokenizers of a task and the bytes of their tokens."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_model)
        letters = {letter: byte for byte, letter in enumerate(byte_letters())}
        data = json.loads(a_json)
        ids = {x["content"]: x["id"] for x in data["added_tokens"]} | data["model"]["vocab"]
        tokens = [b""] * (max(ids.values()) + 1)
        for piece, i in ids.items():
            tokens[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.a_bytes, self.b_bytes = Bytes(tokens), Bytes([self.piece(i) for i in range(self.b.get_piece_size())])
        # texts may be cut before a blank only if no piece goes on from another character to a blank
        self.cuts = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        self.ranks = self.by_rank(data)
        self.large = max(len(self.a_bytes.tokens), len(self.b_bytes.tokens)) > 1 << 16

    def written(self) -> list[str]:
        """Every id as text with what may follow it in the digest: inside a group, at its end."""
        return [f"{i}{mark}" for table, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))
                for mark in marks for i in range(len(table.tokens))]

    def by_rank(self, data: dict):
        """The vocabulary of A as ranks, if its ids stand in the order of its merges; else None."""
        ids = data["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        if [ids[a + b] for a, b in pairs] != list(range(256, 256 + len(pairs))):
            return None
        ranks = {self.a_bytes.tokens[i]: i for i in ids.values() if i < 256 + len(pairs)}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def piece(self, i: int) -> bytes:
        text = self.b.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if self.b.is_byte(i) else text.replace("▁", " ").encode()

    def slices(self, text: str) -> list[str]:
        """A long text, cut before single blanks between two solid characters; each slice without its leading blank."""
        out, start = [], 0
        while self.cuts and len(text) - start > SLICE:
            cut = BOUNDARY.search(text, start + SLICE)
            if not cut:
                break
            out.append(text[start: cut.start()])
            start = cut.end()
        return [*out, text[start:]]

    def ids_a(self, texts: list[str]) -> list[list[int]]:
        """Ids of A.  The ranks of the same vocabulary give the same ids sooner; they take the plain texts."""
        slow = [i for i, t in enumerate(texts) if self.ranks is None or not PLAIN(t) or WORD(t)]
        by_library = self.a.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False) if slow else []
        found = {i: e.ids for i, e in zip(slow, by_library, strict=True)}
        return [found[i] if i in found else self.ranks.encode_ordinary(t) for i, t in enumerate(texts)]

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of every text; none where the bytes differ."""
        parts = [self.slices(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(parts))
        a, b = self.ids_a([" " + t for t in flat]), self.b.encode(flat, num_threads=1)
        out, at = [], 0
        for text, each in zip(texts, parts, strict=True):
            ids = [np.fromiter(chain.from_iterable(side[at: at + len(each)]), np.int64) for side in (a, b)]
            at += len(each)
            want = np.frombuffer((" " + text).encode() if text else b"", np.uint8)
            true = all(np.array_equal(table.joined(x), want) for table, x in zip((self.a_bytes, self.b_bytes), ids, strict=True))
            out.append(tuple(ids) if true else (ids[0][:0], ids[1][:0]))
        return out

    def align(self, tokens: list[tuple[np.ndarray, np.ndarray]]) -> Aligned:
        a, b = (np.concatenate([t[side] for t in tokens]) for side in (0, 1))
        a_ends, b_ends = np.cumsum(self.a_bytes.sizes[a]), np.cumsum(self.b_bytes.sizes[b])
        return Aligned(a, b, a_ends, b_ends, np.cumsum([len(t[0]) for t in tokens]), np.cumsum([len(t[1]) for t in tokens]))


class Aligned:
    """Groups and links of some documents, one behind the other; ``_last`` are the ends of the documents in tokens."""

    def __init__(self, a, b, a_ends, b_ends, a_last, b_last):
        self.a, self.b, self.a_last, self.b_last = a, b, a_last, b_last
        total = int(a_ends[-1]) + 1 if len(a) else 1
        in_a, in_b = np.zeros(total, bool), np.zeros(total, bool)
        in_a[a_ends], in_b[b_ends] = True, True
        self.a_stop, self.b_stop = np.flatnonzero(in_b[a_ends]) + 1, np.flatnonzero(in_a[b_ends]) + 1  # of every group, in tokens
        last = np.searchsorted(self.a_stop, a_last, side="right")
        self.n_a, self.n_b, self.groups = (np.diff(x, prepend=0) for x in (a_last, b_last, last))
        keys, times, group = links(a, b, self.a_stop, self.b_stop)
        documents = np.repeat(np.arange(len(last)), self.groups)
        keys |= documents[group] << OWNER
        if times is None:
            keys.sort()
        else:
            order = np.argsort(keys)
            keys, times = keys[order], times[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        #: Distinct pairs of every document, the links of each, and its document.
        self.pairs, self.owner = keys[first] & (1 << OWNER) - 1, keys[first] >> OWNER
        self.times = np.diff(first, append=len(keys)) if times is None else np.add.reduceat(times, first)

    def per_document(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of every pair, by document."""
        out = np.zeros(len(self.n_a), np.int64)
        np.add.at(out, self.owner, values)
        return out

    def digests(self, written: list[str], n_a: int, n_b: int) -> list[str]:
        """SHA-256 of the groups of every document written out; empty without tokens."""
        a_start, b_start = np.append(0, self.a_stop[:-1])[: len(self.a_stop)], np.append(0, self.b_stop[:-1])[: len(self.b_stop)]
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        a_ends, b_ends = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        a_ends[self.a_stop - 1], b_ends[self.b_stop - 1] = 1, 1
        codes[np.arange(len(self.a)) + np.repeat(b_start, self.a_stop - a_start)] = self.a + a_ends * n_a
        codes[np.arange(len(self.b)) + np.repeat(self.a_stop, self.b_stop - b_start)] = 2 * n_a + self.b + b_ends * n_b
        stops = (self.a_last + self.b_last).tolist()
        return [hashlib.sha256("".join(map(written.__getitem__, codes[x:y].tolist()))[:-1].encode()).hexdigest() if y > x else ""
                for x, y in zip([0, *stops[:-1]], stops, strict=True)]


def links(a: np.ndarray, b: np.ndarray, a_stop: np.ndarray, b_stop: np.ndarray) -> tuple:
    """Linked pairs as numbers, the links of each (None: one each), and its group."""
    a_start, b_start = np.append(0, a_stop[:-1])[: len(a_stop)], np.append(0, b_stop[:-1])[: len(b_stop)]
    n_a, n_b = a_stop - a_start, b_stop - b_start
    wide = n_a * n_b > WIDE
    each = np.repeat(np.where(wide, 0, n_b), n_a)  # links of every A token
    token = np.repeat(np.arange(len(a)), each)
    group = np.repeat(np.arange(len(a_stop)), np.where(wide, 0, n_a * n_b))
    place = np.arange(len(token)) - np.repeat(np.cumsum(each) - each, each)
    keys = a[token] << SHIFT | b[b_start[group] + place]
    if not wide.any():
        return keys, None, group
    keys, times, group = [keys], [np.ones(len(group), np.int64)], [group]
    for g in np.flatnonzero(wide):
        x, n = np.unique(a[a_start[g]: a_stop[g]], return_counts=True)
        y, m = np.unique(b[b_start[g]: b_stop[g]], return_counts=True)
        keys.append((x[:, None] << SHIFT | y[None]).ravel())
        times.append((n[:, None] * m[None]).ravel())
        group.append(np.full(len(keys[-1]), g))
    return np.concatenate(keys), np.concatenate(times), np.concatenate(group)


def sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1) != 0)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


# --- minimal perfect hash --------------------------------------------------------------------------------------


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) >> np.uint64(20)).astype(np.int64) % segments


def _bit(keys: np.ndarray, level: int, size) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return (mix(keys.astype(np.uint64) ^ seed) >> np.uint64(1)).astype(np.int64) % size


class PerfectHash:
    """Slots 0 to n - 1 for n distinct keys: level by level, keys that alone hold a bit are placed there."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, keys: np.ndarray):
        self.sizes, self.bits, self.keys = sizes, bits, keys
        self.starts = np.cumsum(sizes) - sizes
        self.ranks = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        while len(left):
            size = 2 * len(left)
            at = _bit(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        made = cls(np.array(sizes, np.int64), bits, np.zeros(len(keys), np.int64))
        made.keys[made.slots(keys)] = keys
        return made

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; a key that was not built in gets any slot or -1."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, start) in enumerate(zip(self.sizes, self.starts, strict=True)):
            at = start + _bit(keys[open_], level, size)
            hit = self.bits[at].astype(bool)
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit]
        return out

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Slots of known keys, verified by the stored keys; -1 for others."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        slots = self.slots(keys)
        return np.where((slots >= 0) & (self.keys[slots] == keys), slots, -1)

    def pack(self) -> dict:
        return {"sizes": self.sizes.tobytes(), "bits": np.packbits(self.bits).tobytes(), "keys": self.keys.tobytes()}

    @classmethod
    def unpack(cls, row) -> PerfectHash:
        sizes = np.frombuffer(row["sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum()))
        return cls(sizes, bits, np.frombuffer(row["keys"], np.int64))


# --- passes over the documents ---------------------------------------------------------------------------------


def _some(batches: Iterator[pa.RecordBatch], names: list[str], size: int = AT_ONCE) -> Iterator[tuple[list, ...]]:
    """The columns as lists, few rows at a time."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in names]
        for i in range(0, batch.num_rows, size):
            yield tuple(c[i: i + size] for c in columns)


def _models(spark, a_path: str, b_path: str):
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def first_pass(docs: DataFrame, models, held: int = HELD) -> DataFrame:
    """Rows of two kinds: token ids of every document (``doc_id, th, a, b``), and distinct pairs with the documents
    of each (``keys, counts``, arrays of ``held`` pairs or so)."""

    def run(batches):
        own = Aligner(*models.value)
        zip_ = zstandard.ZstdCompressor(level=1).compress
        parts, waiting = [], 0

        def whole():
            return sums(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))

        def pairs(keys, counts):
            return pa.RecordBatch.from_pylist([{"keys": keys.tobytes(), "counts": counts.tobytes()}], KEPT)

        for ids, hashes, texts in _some(batches, [*KEY, "text"]):
            tokens = own.tokens(texts)
            keys = own.align(tokens).pairs
            packed = [[zip_(t[side].astype(np.uint32 if own.large else np.uint16).tobytes()) for t in tokens] for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), *(pa.array(x, pa.binary()) for x in packed),
                                              pa.nulls(len(ids), pa.binary()), pa.nulls(len(ids), pa.binary())], schema=KEPT)
            parts.append(sums(keys, np.ones(len(keys), np.int64)))
            waiting += len(parts[-1][0])
            if waiting > held:
                parts[:] = [whole()]
                waiting = len(parts[0][0])
                if waiting > held // 2:
                    yield pairs(*parts.pop())
                    waiting = 0
        if parts:
            yield pairs(*whole())

    return docs.mapInArrow(run, "doc_id long, th long, a binary, b binary, keys binary, counts binary")


def distinct_pairs(parts: DataFrame) -> DataFrame:
    """One row a distinct pair."""

    def run(batches):
        for batch in batches:
            for keys in batch.column("keys").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64))], ["pair"])

    return parts.select("keys").mapInArrow(run, "pair long").distinct()


def perfect_hashes(pairs: DataFrame, segments: int) -> DataFrame:
    """``segment, sizes, bits, keys``: a minimal perfect hash of the pairs of every segment."""

    def number(batches):
        for batch in batches:
            keys = batch.column("pair").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(segment_of(keys, segments)), batch.column("pair")], ["segment", "pair"])

    def build(table):
        made = PerfectHash.build(np.sort(table.column("pair").to_numpy())).pack()
        return pa.table({"segment": table.column("segment")[:1]} | {k: [v] for k, v in made.items()})

    return pairs.mapInArrow(number, "segment long, pair long").groupBy("segment").applyInArrow(
        build, "segment long, sizes binary, bits binary, keys binary")


def count_vectors(parts: DataFrame, hashes: DataFrame, segments: int) -> DataFrame:
    """``segment, counts``: documents of the pair of every slot, dense vectors summed as a tree of ``FAN`` branches."""
    def deal(batches):  # the pairs of every part, by segment
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                keys, counts = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
                if not len(keys):
                    continue
                where = segment_of(keys, segments)
                order = np.argsort(where, kind="stable")
                found, first = np.unique(where[order], return_index=True)
                for s, k, n in zip(found, np.split(keys[order], first[1:]), np.split(counts[order], first[1:]), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([k.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())],
                                                     ["segment", "k", "n"])

    def dense(key, left, right):
        found = PerfectHash.unpack(right.to_pylist()[0])
        total = np.zeros(len(found.keys), np.int64)
        for k, n in zip(left.column("k").to_pylist(), left.column("n").to_pylist(), strict=True):
            slots = found.look_up(np.frombuffer(k, np.int64))
            if (slots < 0).any():
                raise RuntimeError("a pair is not among the keys of its segment")
            total[slots] += np.frombuffer(n, np.int64)
        return vector(key, total)

    def add(key, table):
        return vector(key, sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()))

    def vector(key, total):
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "salt": pa.array([key[1].as_py()], pa.int64()),
                         "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "segment long, salt long, counts binary"
    leaves = max(1, -(-parts.count() // FAN))
    dealt = parts.mapInArrow(deal, "segment long, k binary, n binary").withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(leaves)))
    salted = hashes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(leaves - 1).cast("long"))))
    summed = dealt.groupBy("segment", "salt").cogroup(salted.groupBy("segment", "salt")).applyInArrow(dense, schema)
    while leaves > 1:
        leaves = -(-leaves // FAN)
        summed = summed.withColumn("salt", F.col("salt") % leaves).groupBy("segment", "salt").applyInArrow(add, schema)
    return summed.select("segment", "counts")


#: Vectors or parts of a segment that one task adds.
FAN = 16


def best_counts(hashes: DataFrame, counts: DataFrame) -> DataFrame:
    """``a, best``: the highest count of every A id; no more rows than the vocabulary of A."""

    def run(batches):
        for batch in batches:
            for keys, n in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                a, n = np.frombuffer(keys, np.int64) >> SHIFT, np.frombuffer(n, np.int64)
                best = np.zeros(int(a.max()) + 1, np.int64)
                np.maximum.at(best, a, n)
                found = np.flatnonzero(best)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(best[found])], ["a", "best"])

    joined = hashes.select("segment", "keys").join(counts, "segment").select("keys", "counts")
    return joined.mapInArrow(run, "a long, best long").groupBy("a").agg(F.max("best").alias("best"))


class Block:
    """Perfect hashes and counts of a run of segments."""

    def __init__(self, rows: list[dict], segments: int):
        self.segments = segments
        self.of = {r["segment"]: (PerfectHash.unpack(r), np.frombuffer(r["counts"], np.int64)) for r in rows}

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of the keys of this block, 0 for those of others."""
        out = np.zeros(len(keys), np.int64)
        where = segment_of(keys, self.segments)
        for s, (found, counts) in self.of.items():
            mine = np.flatnonzero(where == s)
            slots = found.look_up(keys[mine])
            out[mine[slots >= 0]] = counts[slots[slots >= 0]]
        return out


def looked_up(tokens: DataFrame, models, block, best) -> DataFrame:
    """Alignment of every document and the sums over its links whose pairs are in ``block``."""

    def run(batches):
        own = Aligner(*models.value)
        rows, first, segments = block.value
        table, top, written = Block(rows, segments), best.value, own.written()
        plain = zstandard.ZstdDecompressor().decompress
        for ids, hashes, *sides in _some(batches, [*KEY, "a", "b"]):
            a, b = ([np.frombuffer(plain(x), np.uint32 if own.large else np.uint16).astype(np.int64) for x in side] for side in sides)
            found = own.align(list(zip(a, b, strict=True)))
            keys, back = np.unique(found.pairs, return_inverse=True)
            counts = table.counts(keys)
            good = (counts > 0) & (counts == top[keys >> SHIFT])
            numbers = (found.n_a, found.n_b, found.groups, found.per_document(found.times),
                       found.per_document(found.times * good[back]), found.per_document(found.times * counts[back]))
            digests = found.digests(written, len(own.a_bytes.tokens), len(own.b_bytes.tokens)) if first == 0 else [""] * len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), *(pa.array(c, pa.int64()) for c in numbers),
                 pa.array(digests, pa.string())], [*KEY, *NUMBERS, "groups_sha256"])

    return tokens.mapInArrow(run, RESULT)


def pair_table(parts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Stored perfect hashes and count vectors of all pairs, and the number of segments."""
    pairs = cut_lineage(distinct_pairs(parts))
    segments = max(1, -(-pairs.count() // SEGMENT))
    hashes = cut_lineage(perfect_hashes(pairs, segments))
    return hashes, cut_lineage(count_vectors(parts, hashes, segments)), segments


def alignment(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row a document: tokens, groups, links, links with the best count of their A id, sum of counts, digest."""
    spark = session_of(documents)
    models = _models(spark, a_path, b_path)
    kept = cut_lineage(first_pass(keyed(documents), models))
    tokens = kept.filter("a IS NOT NULL").select(*KEY, "a", "b")
    hashes, counts, segments = pair_table(kept.filter("keys IS NOT NULL").select("keys", "counts"))
    highest = best_counts(hashes, counts).collect()  # bounded by the vocabulary of A
    top = np.zeros(max((r["a"] for r in highest), default=0) + 1, np.int64)
    top[[r["a"] for r in highest]] = [r["best"] for r in highest]
    best = spark.sparkContext.broadcast(top)
    found = []
    for first in range(0, segments, BLOCK):
        chosen = hashes.join(counts, "segment").filter(F.col("segment").between(first, first + BLOCK - 1))
        block = [r.asDict() for r in chosen.collect()]  # at most BLOCK segments
        found.append(looked_up(tokens, models, spark.sparkContext.broadcast((block, first, segments)), best))
    if len(found) == 1:
        return found[0].drop("th")
    sums_ = [F.first(c).alias(c) for c in NUMBERS[:4]] + [F.sum(c).alias(c) for c in NUMBERS[4:]]
    each = [part.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"), *[F.first(c).alias(c) for c in (*NUMBERS, "groups_sha256")])
            for part in found]
    whole = reduce(DataFrame.unionByName, each).groupBy(*KEY).agg(
        F.first("rows").alias("rows"), *sums_, F.max("groups_sha256").alias("groups_sha256"))
    repeated = whole.withColumn("rows", F.explode(F.expr("array_repeat(0, CAST(rows AS INT))")))
    return repeated.select("doc_id", *NUMBERS, "groups_sha256")
