import corpus_pipeline
from isohyet.llm import quality

from test_contamination import brute as contaminated
from test_exact import plain
from test_near import brute as near_groups


def test_stages_match_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    columns = docs.columns
    kept = {r.doc_id for r in quality.digest(docs, labels).filter("predicted = 1").collect()}
    left = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    best = {}
    for doc_id, text in left:
        rank = (-len(text or ""), doc_id)
        best[plain(text)] = min(best.get(plain(text), rank), rank)
    ids = {r[1] for r in best.values()}
    left = [r for r in left if r[0] in ids]
    groups = {a: c for a, _, c in near_groups(left, 5, 80)}
    left = [r for r in left if groups[str(r[0])] == str(r[0])]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {a for a, *_, bad in contaminated(left, items, 10) if not bad}
    left = [r for r in left if str(r[0]) in clean]

    stages = dict(corpus_pipeline.STAGES)
    rows = docs
    for name in ("quality", "exact_dedup", "near_dedup", "decontamination"):
        rows = stages[name](spark, rows, folder)
        assert rows.columns == columns
    assert sorted(r.doc_id for r in rows.collect()) == sorted(r[0] for r in left)

    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in left}
    assert sum(r.length for r in packed) == sum(len((t or "").encode().split()) + 1 for _, t in left)


def test_stages_take_odd_and_empty_tables(spark, table, messy, folder):
    for rows in (messy, []):
        docs = table(rows, extra=True)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
            assert name == "packing" or docs.columns == columns
            docs.count()
