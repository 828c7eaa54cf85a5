"""MinHash near-dedup (6): a multi-index Hamming join of signatures, links confirmed on whole shingle sets.

A document's set is its distinct shingles of ``words`` words, A-Z in lower case (with fewer words the whole
sequence, without words nothing).  Documents with equal sets are one class; all further work
is on classes.  A signature has ``CHUNKS`` chunks of ``CHUNK`` minimum hashes of 16 bits.  Two signatures that differ
in fewer than ``2 * CHUNKS`` places agree, by pigeonhole, in a chunk up to one error, so every chunk is
indexed under all choices of ``CHUNK - 1`` of its places, and all pairs within that distance share a bucket.
At a similarity of 0.85 (0.8) a pair shares none with a probability of 2e-8 (2e-6).

A bucket is not turned into pairs.  One member, the most connected, is compared with all others; the
components of the confirmed links tell which members still need comparing, with another
member in the next round.  After ``ROUNDS`` of these, a member stays only if enough of its shingles
occur in any other member that is left (a bound on all its similarities), and what remains meets only across
components, where bitmaps of the sets bound each similarity from above.  So no link that joins two
components is lost, and a large group costs a comparison per member and round.
Before texts are compared, sizes must allow the link, and one bit of each place must agree in all but ``BITS_APART``.

Null, empty and blank texts are linked with nothing.  Rows that repeat are in one class.  A component
is named by its smallest non-null ``doc_id``.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.text import KEY, LOWER, checked, drop_rows, each_batch, keyed, mix, packed, raw_texts, same, session_of, unpack, word_hashes
from isohyet.session import cut_lineage

CHUNKS, CHUNK, ROUNDS, MARKS = 10, 5, 3, 16
#: Signatures within the distance that shares a bucket differ in no more bits than places, so the bit test never rejects them.
BITS_APART = 2 * CHUNKS - 1
PLACES = CHUNKS * CHUNK
_RANDOM = np.random.default_rng(41)
FACTORS = _RANDOM.integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(1, 1 << 63, PLACES, dtype=np.uint64)


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    out = []
    for hashes in word_hashes(texts, LOWER) if texts else []:
        size = min(words, len(hashes))
        if not size:
            out.append(hashes)
            continue
        shingles = np.zeros(len(hashes) - size + 1, np.uint64)
        for i in range(size):
            shingles = mix(shingles + hashes[i: len(hashes) - size + 1 + i] + np.uint64(i + 1))
        out.append(np.unique(shingles + np.uint64(size)))
    return out


def signed(texts: list[bytes | None], words: int):
    """Set size, 128-bit identity, signature and one bit a place (as a number) of every text."""
    sets = shingle_sets(texts, words)
    sizes = np.array([len(x) for x in sets], np.int64)
    ids, signatures = np.zeros((len(sets), 2), np.uint64), np.zeros((len(sets), PLACES), np.uint16)
    full = np.flatnonzero(sizes)
    if len(full):
        joined = np.concatenate([sets[i] for i in full])
        starts = np.cumsum(sizes[full]) - sizes[full]
        for k, salt in enumerate((0x51, 0xA7)):
            ids[full, k] = np.add.reduceat(mix(joined + np.uint64(salt)), starts) + sizes[full].astype(np.uint64)
        for k in range(PLACES):
            signatures[full, k] = mix(np.minimum.reduceat(joined * FACTORS[k] + SHIFTS[k], starts)) >> np.uint64(48)
    bits = ((signatures & 1).astype(np.int64) << np.arange(PLACES)).sum(1)
    return sizes, ids, signatures, bits


def _rows(docs: DataFrame, words: int) -> DataFrame:
    """A row per document: key, ``n``, ``id`` of its set (null if empty), ``signature``, ``bits``."""

    def make():
        def step(batch):
            sizes, ids, signatures, bits = signed(raw_texts(batch.column("text")), words)
            empty = sizes == 0
            blobs = [[None if e else x.tobytes() for x, e in zip(rows, empty, strict=True)] for rows in (ids, signatures)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in KEY), pa.array(sizes), *(pa.array(x, pa.binary()) for x in blobs), pa.array(bits)],
                [*KEY, "n", "id", "signature", "bits"])

        return step

    return each_batch(docs.select(*KEY, "text"), make, "doc_id long, th long, n long, id binary, signature binary, bits long")


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, c, n, bits): all chunks of all signatures, each place left out in turn."""

    def make():
        def step(batch):
            blobs = raw_texts(batch.column("signature"))
            if not blobs:
                return
            chunks = np.frombuffer(b"".join(blobs), np.uint16).reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
            keys = []
            for chunk in range(CHUNKS):
                for out in range(CHUNK):
                    key = np.full(len(blobs), mix(np.array([chunk * CHUNK + out + 1], np.uint64))[0])
                    for place in range(CHUNK):
                        if place != out:
                            key = mix(key + chunks[:, chunk, place] + np.uint64(place))
                    keys.append(key)
            rows = pa.array(np.tile(np.arange(len(blobs)), len(keys)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), *(batch.column(x).take(rows) for x in ("c", "n", "bits"))],
                ["bucket", "c", "n", "bits"])

        return step

    return each_batch(classes.select("c", "n", "bits", "signature"), make, "bucket long, c long, n long, bits long")


def _texts(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """The packed text of one document of each class that shares a bucket."""
    sources = classes.join(members.select("c").distinct(), "c", "left_semi").select("c", "source.*")
    found = packed(docs).alias("t").join(sources.alias("s"), same("t", "s", KEY)).select("s.c", "t.packed")
    return cut_lineage(found.dropDuplicates(["c"]))


def _linked(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose whole sets are similar enough."""
    both = texts.select(F.col("c").alias("y"), F.col("packed").alias("b")).join(checked(pairs), "y")
    both = both.join(texts.select(F.col("c").alias("x"), F.col("packed").alias("a")), "x")

    def make():
        known: dict[str, tuple] = {}  # neighbouring rows often share a text

        def sets(side, column):
            out = []
            for blob, text in zip(raw_texts(column), unpack(column), strict=True):
                if known.get(side, (None,))[0] != blob:
                    known[side] = blob, shingle_sets([text], words)[0]
                out.append(known[side][1])
            return out

        def step(batch):
            keep = []
            for a, b in zip(sets("a", batch.column("a")), sets("b", batch.column("b")), strict=True):
                small = min(len(a), len(b))
                shared = len(np.intersect1d(a, b, assume_unique=True)) if 100 * small >= percent * max(len(a), len(b)) else 0
                keep.append(shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

        return step

    return each_batch(both.select("x", "y", "a", "b"), make, "x long, y long")


def components(links: DataFrame) -> DataFrame:
    """(c, label) of all linked nodes; ``label`` is the smallest node of the component.

    Every node hooks to its smallest neighbour and the graph is contracted, until no edge is left.
    Nodes are hashed numbers, so the rounds are logarithmic in the size of a component.
    """
    edges = cut_lineage(links.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).filter("x < y").distinct())
    labels = None
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        parents = cut_lineage(ends.groupBy("x").agg(F.min("y").alias("p")).select("x", F.least("x", "p").alias("p")))
        near, far = checked(parents.select("x", F.col("p").alias("u"))), checked(parents.select(F.col("x").alias("y"), F.col("p").alias("v")))
        if labels is None:
            labels = parents.select(F.col("x").alias("c"), F.col("p").alias("label"))
        else:
            moved = labels.join(near, labels["label"] == near["x"], "left")
            labels = cut_lineage(moved.select("c", F.coalesce("u", "label").alias("label")))
        edges = edges.join(near, "x").join(far, "y").select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"))
        edges = cut_lineage(edges.filter("x < y").distinct())
    return labels if labels is not None else edges.select(F.col("x").alias("c"), F.col("y").alias("label"))


def _possible(left: str, right: str, percent: int):
    """Whether the sizes and bits of two members allow a link."""
    a, b = F.col(f"{left}.n"), F.col(f"{right}.n")
    bits = F.bit_count(F.col(f"{left}.bits").bitwiseXOR(F.col(f"{right}.bits"))) <= BITS_APART
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & bits


def _sharing(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Members with ``common``, their shingles that any other member has, as far as these allow a link in their bucket."""

    def make():
        def step(batch):
            sets = shingle_sets(unpack(batch.column("packed")), words)
            if sets:
                rows = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
                yield pa.RecordBatch.from_arrays([batch.column("c").take(rows), pa.array(np.concatenate(sets).view(np.int64))],
                                                 ["c", "shingle"])

        return step

    names = [f"m{i}" for i in range(MARKS)]

    def bitmaps():
        def step(batch):
            marked = np.zeros((batch.num_rows, 64 * MARKS), bool)
            for row, own in zip(marked, shingle_sets(unpack(batch.column("packed")), words), strict=True):
                row[(mix(own) % np.uint64(64 * MARKS)).astype(np.int64)] = True
            bits = np.packbits(marked, 1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("c"), pa.array(marked.sum(1)), *(pa.array(np.ascontiguousarray(x)) for x in bits.T)], ["c", "marked", *names])

        return step

    left = checked(cut_lineage(members.select("c").distinct()))
    sources = cut_lineage(texts.join(left, "c", "left_semi").select("c", "packed"))
    shingles = cut_lineage(each_batch(sources, make, "c long, shingle long"))
    often = cut_lineage(shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("shingle"))
    common = shingles.join(checked(often), "shingle", "left_semi").groupBy("c").agg(F.count(F.lit(1)).alias("common"))
    least = checked(cut_lineage(members.groupBy("bucket").agg(F.min("n").alias("least"))))
    rows = cut_lineage(members.join(checked(cut_lineage(common)), "c").join(least, "bucket"))
    # the union is smallest with the smallest partner that the sizes allow
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    rows = rows.filter(100 * F.col("common") >= percent * (F.col("n") + partner - F.col("common"))).drop("least")
    return rows.join(each_batch(sources, bitmaps, "c long, marked long, " + ", ".join(f"{x} long" for x in names)), "c")


def _may_share(left: str, right: str):
    """An upper bound of the shingles that two members share: each lacks at least what its bitmap lacks."""
    both = sum((F.bit_count(F.col(f"{left}.m{i}").bitwiseAND(F.col(f"{right}.m{i}"))) for i in range(MARKS)), F.lit(0))
    lacks = [F.col(f"{x}.n") - (F.col(f"{x}.marked") - both) for x in (left, right)]
    return F.least(F.col(f"{left}.common"), F.col(f"{right}.common"), *lacks)


def class_labels(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(c, label) of the classes that are linked with another one."""
    buckets = _buckets(classes)
    shared = cut_lineage(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    members = cut_lineage(buckets.join(checked(shared), "bucket"))
    texts = _texts(docs, classes, members)
    degree = cut_lineage(members.groupBy("c").agg(F.sum("size").alias("degree")))
    members = cut_lineage(members.drop("size").join(checked(degree), "c").withColumn("label", F.col("c")))
    links, labels = None, None

    def unsettled(rows: DataFrame) -> DataFrame:
        """Rows of buckets that still hold different components."""
        mixed = rows.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b")
        return cut_lineage(rows.join(checked(cut_lineage(mixed.select("bucket"))), "bucket", "left_semi"))

    for turn in range(ROUNDS + 1):
        if turn:
            members = members.drop("label").join(checked(labels), "c", "left").withColumn("label", F.coalesce("label", "c"))
            members = unsettled(cut_lineage(members))
            if turn == ROUNDS and not members.isEmpty():
                members = unsettled(_sharing(members, texts, words, percent))
            if members.isEmpty():
                break
        different = (F.col("m.bucket") == F.col("l.bucket")) & _possible("m", "l", percent)
        if turn < ROUNDS:
            rank = F.xxhash64("bucket", "c", F.lit(turn)) if turn else F.col("degree")
            lead = members.groupBy("bucket").agg(F.max(F.struct(rank.alias("rank"), "c", "n", "bits", "label")).alias("l"))
            lead = cut_lineage(lead.select("bucket", "l.*"))
            pairs = members.alias("m").join(checked(lead).alias("l"), different & (F.col("m.label") != F.col("l.label")))
        else:
            # all that need comparing are the members outside the largest component of a bucket, with all others
            parts = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
            most = parts.groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("most")).select("bucket", "most.label")
            most = cut_lineage(most.withColumnRenamed("label", "largest"))
            known = cut_lineage(members.join(checked(most), "bucket"))
            outside = cut_lineage(known.filter("label != largest"))
            once = (F.col("l.label") == F.col("l.largest")) | (F.col("m.label") < F.col("l.label"))
            shared_ = _may_share("m", "l")
            enough = 100 * shared_ >= percent * (F.col("m.n") + F.col("l.n") - shared_)
            on = different & (F.col("m.label") != F.col("l.label")) & once & enough
            pairs = known.alias("l").join(outside.alias("m"), on)
        pairs = pairs.select(F.least("l.c", "m.c").alias("x"), F.greatest("l.c", "m.c").alias("y"))
        pairs = cut_lineage(pairs.distinct())
        found = cut_lineage(_linked(pairs, texts, words, percent))
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    return labels


def near_groups(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: ``doc_id, th, n_shingles, component_id``."""
    session_of(documents)
    docs = keyed(documents)
    rows = cut_lineage(_rows(docs, words))
    source = F.min(F.struct(F.col("doc_id").isNull().alias("null"), *KEY))
    classes = rows.filter("id IS NOT NULL").groupBy("id").agg(
        source.alias("source"), F.first("signature").alias("signature"), F.first("bits").alias("bits"),
        F.first("n").alias("n"))
    classes = classes.withColumn("c", F.xxhash64(F.monotonically_increasing_id()))  # one to one for a single number
    classes = cut_lineage(classes.withColumn("source", F.struct("source.doc_id", "source.th")))
    labels = class_labels(docs, classes, words, percent)
    named = classes.select("id", "c", F.col("source.doc_id").alias("least")).join(checked(labels), "c", "left")
    named = named.select("id", F.coalesce("label", "c").alias("label"), "least")
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = named.join(names, "label").select("id", "component_id")
    return rows.join(found, "id", "left").select(
        "doc_id", "th", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_dedup(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, all columns as they were."""
    groups = near_groups(documents, words, percent)
    return drop_rows(documents, groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def digest(documents: DataFrame) -> DataFrame:
    groups = near_groups(documents, words=3, percent=85)
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
