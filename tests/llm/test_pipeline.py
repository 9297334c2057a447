import hashlib

import corpus_pipeline as P
from lakeloom.llm import decontaminate, near_dedup


def test_stages_keep_columns_and_only_drop_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: tuple(r) for r in docs.collect()}
    assert [n for n, _ in P.STAGES] == ["language_id", "quality", "near_dedup", "decontaminate", "byte_bpe"]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema == docs.schema, name
        kept = [tuple(r) for r in out.collect()]
        assert 0 < len(kept) <= len(rows) and len({k[0] for k in kept}) == len(kept) and all(rows[k[0]] == k for k in kept), name
    assert {r.doc_id for r in near_dedup.keep(docs).collect()} == {r.class_id for r in near_dedup.classes(docs).collect()}
    leaked = {r.doc_id for r in decontaminate.report(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in P.stage_decontaminate(spark, docs, sf).collect()} == set(rows) - leaked
    encoded = P.stage_byte_bpe(spark, docs, sf).collect()
    assert {(r.doc_id, r.decoded_sha256) for r in encoded} == {(i, hashlib.sha256(r[1].encode()).hexdigest()) for i, r in rows.items()}


def test_empty_and_odd_documents(spark):
    sf = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    odd = [(1, None, None, None, None, "x"), (1, None, None, None, None, "x"), (None, "", "en", "s", 0, None), (2, "word " * 50_000, "en", "s", 5, None)]
    for table in (spark.createDataFrame([], schema), spark.createDataFrame(odd, schema)):
        docs = table
        for name, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.schema == table.schema, name
            docs = spark.createDataFrame(docs.collect(), schema)
        assert P.STAGES[-1][1](spark, docs, sf).count() == docs.count()
