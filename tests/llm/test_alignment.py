import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from isohyet.llm import alignment
from isohyet.llm.tokens import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["<|endoftext|>a<|endoftext|>", " \n\n  x \n", "a" * 3000, "日本語 тест ¼ ²x　y", "it's we'll I'D 123abc!!! ... ", "\x00\x1c\x85\xa0 b",
       "é" * 300 + " " * 50, "🙂👩‍👩‍👧", "foo <s> bar </s> <unk> x", "▁ a▁b ▁▁", " ", "ﬁ Å ½ ' s 's", "xyz" * 200, "0" * 500 + " b",
       "".join(chr(0x4E00 + i * 7 % 9000) for i in range(3000))]


@pytest.fixture(scope="module")
def brute():
    """Rows of all columns by the contract, one document after the other."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {x: i for i, x in enumerate(byte_letters())}

    def a_bytes(i):
        return bytes(letters[c] for c in a.id_to_token(i)) if i < 50256 else b"<|endoftext|>"

    def b_bytes(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        sides = [(i, a_bytes(i)) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, b_bytes(i)) for i in b.encode(text)]
        if any(b"".join(x for _, x in side) != (" " + text).encode() for side in sides):
            return []
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in sides]
        common = set(ends[0]) & set(ends[1])
        out = []
        for side, stops in zip(sides, ends, strict=True):
            cut = [[]]
            for (i, _), e in zip(side, stops, strict=True):
                cut[-1].append(i)
                if e in common:
                    cut.append([])
            out.append(cut[:-1])
        return list(zip(*out, strict=True))

    def rows(docs):
        found = [groups(t) for _, t in docs]
        links = [Counter(p for x, y in g for p in ((i, j) for i in x for j in y)) for g in found]
        counts = Counter(p for each in links for p in each)
        best = {}
        for (i, _), n in counts.items():
            best[i] = max(best.get(i, 0), n)
        out = []
        for (key, _), g, each in zip(docs, found, links, strict=True):
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
            out.append((str(key), sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(each.values()),
                        sum(n for p, n in each.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in each.items()),
                        hashlib.sha256(text.encode()).hexdigest() if g else ""))
        return sorted(out)

    return rows


def rows(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_equals_brute_force(spark, table, messy, brute, folder):
    docs = [*messy, *((100 + i, t) for i, t in enumerate(ODD))]
    docs += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert rows(alignment.alignment(table(docs, extra=True), A, B)) == brute(docs)


def test_many_segments_blocks_and_parts(table, messy, brute, monkeypatch):
    for name, value in {"SEGMENT": 64, "BLOCK": 3, "HELD": 50, "FAN": 2, "WIDE": 4, "SLICE": 40, "AT_ONCE": 2}.items():
        monkeypatch.setattr(alignment, name, value)
    docs = [*messy, *((100 + i, t) for i, t in enumerate(ODD))]
    assert rows(alignment.alignment(table(docs), A, B)) == brute(docs)


def test_empty_and_null_tables(table):
    assert alignment.alignment(table([]), A, B).count() == 0
    assert rows(alignment.alignment(table([(1, None), (2, "")]), A, B)) == [(str(i), 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_perfect_hash_is_minimal_and_verified():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 47, 20_000))
    found = alignment.PerfectHash.unpack(alignment.PerfectHash.build(keys[::2]).pack())
    assert sorted(found.slots(keys[::2])) == list(range(len(keys[::2])))
    assert (found.look_up(keys[1::2]) == -1).all()
    assert found.keys[found.look_up(keys[::2])].tolist() == keys[::2].tolist()
