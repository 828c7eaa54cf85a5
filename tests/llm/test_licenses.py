import random
import re

import pytest

from isohyet.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
MIT, BSD = licenses.TEXTS["mit"][0], licenses.TEXTS["bsd"][0]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    """Words, places, first and last start and labels of the phrases, by looking at every place."""
    found, w = [], words(text)
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i: i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


@pytest.fixture
def rows(messy):
    rnd = random.Random(5)
    noise = lambda n: " ".join(rnd.choice(["the", "of", "ndo", "software", "licence", "x1"]) for _ in range(n))
    changed = MIT.split()
    changed[20:20] = ["inserted", "words"]
    return [*messy, (100, "MIT License mit license (MIT) LICENSE MIT-License"), (101, "apache\nlicense, gnu general  public license"),
            (102, noise(50) + " " + MIT + " " + noise(40) + " " + BSD), (103, " ".join(changed)), (104, MIT.replace("hereby granted", "denied")),
            (105, "public license general public license general public"), (106, noise(300)), (107, " ".join(MIT.split()[::-1])),
            (108, (MIT + " ") * 40), (109, "mit " * 5000 + "license"), (110, "permission is hereby granted"), (111, "MİT license")]


def test_base_equals_brute_force_and_labels_are_found(table, rows):
    got = licenses.licenses(table(rows, extra=True)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in got) == sorted(
        (str(i), *(x if n not in (2, 3) else str(x) for n, x in enumerate(base(t)))) for i, t in rows)
    found = {r.doc_id: r for r in got}
    assert found[102].labels == "bsd,mit" and found[102].score == 1
    assert found[103].labels == "mit" and 0.9 < found[103].score <= 1
    assert {found[i].labels for i in (104, 106, 107, 110)} == {""} and found[106].score == 0
    assert found[101].labels == "apache,gpl"
    place = next(p for p in found[102].places if p.label == "mit")
    text = words(dict(rows)[102])[place.start: place.stop]
    assert len(set(words(MIT)) - set(text)) == 0 and place.stop - place.start < 130
    assert sum(p.label == "mit" for p in found[108].places) >= 1
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in got if r.base_labels)
    assert all(0 <= r.score <= 1 for r in got)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(licenses, "PIECE", 7)
    index = licenses.Index(licenses.TEXTS, licenses.PHRASES)
    text = "The MIT license, naïve, 日本 and more-words of the apache\tlicense"
    assert index.of(text.encode()).tolist() == [index.number.get(w.encode(), -1) for w in words(text)]


def test_weights_come_from_all_documents(table):
    index = licenses.Index(licenses.TEXTS, licenses.PHRASES)
    got = {r["word"]: r["n"] for r in licenses.document_counts(table([(1, "mit mit license"), (2, "license"), (3, None)]), index).collect()}
    assert got[index.number[b"mit"]] == 1 and got[index.number[b"license"]] == 2 and got[index.number[b"apache"]] == 0


def test_empty_table(table):
    assert licenses.licenses(table([])).count() == 0
