import public_tokenizers
import pytest
from tokenizers import Tokenizer

from isohyet.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["<|endoftext|>a<|endoftext|>", " \n\n  x \n", "a" * 3000, "日本語 тест ¼ ²x　y", "it's we'll I'D 123abc!!! ... ", "\x00\x1c\x85\xa0 b",
       "é" * 300 + " " * 50, "🙂👩‍👩‍👧", "ab<|endoftext|", "xyz" * 200]


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    return lambda t: len(own.encode(t or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(spark, table, messy, library, folder):
    rows = [*messy, *((100 + i, t) for i, t in enumerate(ODD))]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = tokens.digest(table(rows, extra=True), PATH).collect()
    want = sorted((str(i), len((t or "").encode()), library(t), library(t) > 1024) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_one_piece(library):
    merges = tokens.Merges(open(PATH, encoding="utf-8").read())
    for piece in ("", "a", "hello", " internationalisation", "aaaaaaaaaaaaa", "ÄÖÜ"):
        assert merges.merged(piece.encode()) == library(piece)


def test_empty_table(table):
    assert tokens.digest(table([]), PATH).count() == 0
