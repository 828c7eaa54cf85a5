import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    """Rows (doc_id, text, lang) as a table with the columns of documents, and some that clash with results."""

    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        if extra:
            for name in ("th", "kept", "n", "shard", "score", "c", "label", "ranges", "packed"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def messy():
    """Nulls, empty, blank and long texts, odd characters, copies, near copies, repeated rows and ids."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["Über", "naïve", "日本", "x!", "A-b"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, passage = text(120), text(45)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "One"), (5, "one two"), (6, base), (7, base), (8, base.replace(" ", "  ")),
            (9, base + " more"), (10, base.upper()), (11, text(60) + " " + passage + " " + text(60)),
            (12, text(30) + " " + passage + " " + text(10)), (13, passage + "\n" + text(50)), (14, passage),
            (15, "same " * 200), (16, text(3000)), (17, "é" * 900), (18, "\x1c\x85 a b\x0bc"), (19, passage + " " + passage),
            (None, text(80)), (None, None), (None, base), (20, "dup row " * 20), (20, "dup row " * 20), (20, "other text")]
    changed = base.split()
    for k in range(30, 45):
        changed[k] = f"new{k}"
        rows.append((k, " ".join(changed)))
    return rows


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
