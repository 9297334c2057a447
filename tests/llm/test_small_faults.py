from pyspark.sql import functions as F

from lakeloom.llm import decontaminate, language_id, token_rollup


def test_keep_takes_a_column_named_gone(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "x", 1, 2)], "doc_id long, text string, gone int, gone_ int")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    kept = decontaminate.keep(docs, bench)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]


def test_rows_without_an_id_are_sampled(spark):
    rows = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    seen = []
    real = language_id.stored
    language_id.stored = lambda df, kind: seen.append(real(df, kind)) or seen[-1]
    try:
        language_id.fit(rows, sample_per_language=10)
    finally:
        language_id.stored = real
    assert 0 < seen[0].count() < 40


def test_two_compactions_at_once_count_once(spark):
    store = token_rollup.RollupStore(spark)
    one = spark.createDataFrame([("s", "en", "t", "insert", 5, None)], "source string, lang string, tokenizer string, op string, n_tokens long, old_n_tokens long")
    store.commit("a", one)
    store.commit("b", one)
    standing = store.commits()
    rows = standing.collect()
    real, store.commits = store.commits, lambda: spark.createDataFrame(rows, standing.schema)
    store.compact()
    store.compact()  # both saw the same standing batches
    store.commits = real
    assert [r.tokens for r in store.totals().collect()] == [10]
    store.commit("c", one)
    store.compact()
    assert [r.tokens for r in store.totals().collect()] == [15]
