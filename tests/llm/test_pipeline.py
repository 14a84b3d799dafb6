"""The stages one by one against plain versions of what they keep."""

import corpus_pipeline
from fathom.llm import decontaminate as dc
from fathom.sources.scratch import durable


def test_stages_on_the_smallest_tables(spark, sf_dir, small_documents):
    from test_wide_simhash import plain_shingles

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    texts = {r[0]: r[1] for r in small_documents}
    assert len(kept["language_id"]) >= 0.98 * len(texts)
    ids = sorted(kept["language_id"])
    shingles = {i: plain_shingles(texts[i]) for i in ids}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    root = {i: i for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if root[i] != root[j] and alike(shingles[i], shingles[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    firsts = set(root.values())
    assert sorted(kept["simhash_near_dedup"]) == sorted(firsts)
    items = [dc.normalized(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {i for i in firsts if not any(t in dc.normalized(texts[i]) for t in items)}
    assert set(kept["benchmark_decontamination"]) <= clean
    assert len(kept["benchmark_decontamination"]) >= len(clean) - 2
    mixed = docs.collect()
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in mixed)
    assert sorted(r.start for r in rows)[0] == 0


def test_odd_rows_and_empty_tables_pass_every_stage(spark, sf_dir, make_docs, odd_rows, small_documents):
    for rows in ([], odd_rows + [(r[0] + 100, *r[1:]) for r in small_documents[:40]]):
        docs = make_docs(rows, extra=["score", "_x"])
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = durable(stage(spark, docs, sf_dir), name)
            assert docs.columns == columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_benchmark_and_mixing_stages_take_odd_rows(spark, sf_dir, make_docs, odd_rows):
    docs = make_docs(odd_rows, extra=["taken"])
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_columns_named_like_helper_columns_come_through(spark, sf_dir, make_docs, small_documents):
    """Every stage gives back the values of further columns, whatever their names."""
    names = ["size", "extra", "whole", "taken", "_row", "_time", "_part", "_words", "_set", "score", "_own_score", "c0", "node", "lang_pred"]
    rows = [(r[0], r[1], r[2], r[3]) for r in small_documents[:40]]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = make_docs(rows, extra=names)
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        found = out.select(*names).distinct().collect()
        assert [tuple(r) for r in found] == [tuple(f"own {n}" for n in names)], name
