"""Registered queries of this subpackage: opN_<name> applies operator N to its
whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import byte_bpe, decontaminate, language_id, merkle, near_dedup, prefix_trie, quality, suffix_dedup, token_files, token_rollup, url_templates, vector_search, warc
from lakeloom.llm.common import crc32_of_id, stored, table


BYTE_BPE_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE_FILE = public_tokenizers.path("word_bpe_49k.json")
PATTERN = public_tokenizers.PATTERN
END_ID = 1
BLOCK, ALLOW = ("net/", "example.com/de/"), ("example.net/en/", "org/fr/")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(language_id.training_rows(docs))
    return language_id.predict(docs, model).select(
        "doc_id", (F.pmod(crc32_of_id("doc_id"), F.lit(5)) == 0).alias("held_out"), "lang_pred", "score", "coverage")


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages"), BLOCK, ALLOW)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE_FILE, PATTERN)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write(table(spark, sf_dir, "documents"), WORD_BPE_FILE, END_ID)
    return token_files.read(files)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", (F.pmod(crc32_of_id("doc_id"), F.lit(4)) == 2).alias("held_out"), "score", "predicted")


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents counted under two versions: words between white space, and words
    with every punctuation mark apart. Batches: insert under the first; revise the counts
    of texts with a digit to the second's; insert all under the second; delete the texts
    without a full stop from the first; the first batch once more, which changes nothing."""
    text = F.coalesce("text", F.lit(""))
    counted = stored(table(spark, sf_dir, "documents").select(
        "source", "lang", text.rlike("[0-9]").alias("digit"), text.contains(".").alias("stop"),
        F.regexp_count(text, F.lit(r"[^ \t\n]+")).cast("long").alias("words"),
        F.regexp_count(text, F.lit(r"[^ \t\n.,;:!?]+|[.,;:!?]")).cast("long").alias("parts")), "token-counts")
    none = F.lit(None).cast("long")
    held = F.when(F.col("digit"), F.col("parts")).otherwise(F.col("words"))

    def changes(rows: DataFrame, tokenizer: str, op: str, n, old=none) -> DataFrame:
        return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(op).alias("op"), n.alias("n_tokens"), old.alias("old_n_tokens"))

    store = token_rollup.RollupStore(spark)
    first = changes(counted, "words-1", "insert", F.col("words"))
    store.commit("2026-01", first)
    store.commit("2026-02", changes(counted.where("digit"), "words-1", "revise", F.col("parts"), F.col("words")))
    store.commit("2026-03", changes(counted, "words-2", "insert", F.col("parts")))
    store.commit("2026-04", changes(counted.where("not stop"), "words-1", "delete", held))
    store.commit("2026-01", first)
    return store.totals()


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rest.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.lower_case_every_fifth(docs))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations")).drop("ref")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the repository's top; it imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_url_templates": op3_url_templates,
    "op4_warc": op4_warc,
    "op5_vector_search": op5_vector_search,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_token_files": op7_token_files,
    "op8_quality": op8_quality,
    "op9_token_rollup": op9_token_rollup,
    "op10_decontaminate": op10_decontaminate,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": pipeline,
}

_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_SHINGLES = "list_distinct(list_transform(range(0, greatest(len(w) - 4, 0)), lambda i: array_to_string(w[i + 1:i + 5], ' ')))"

_DIGITS, _NUMBERED, _MIXED = "'^[0-9]+$'", "'^[0-9]+\\.[A-Za-z0-9]+$'", "'^[0-9A-Fa-f-]{8,}$'"


def _token_sql(s: str) -> str:
    return (f"CASE WHEN regexp_matches({s}, {_DIGITS}) THEN '{{n}}' WHEN regexp_matches({s}, {_NUMBERED}) "
            f"THEN '{{n}}.' || regexp_extract({s}, '([^.]*)$', 1) WHEN regexp_matches({s}, {_MIXED}) AND regexp_matches({s}, '[0-9]') THEN '{{id}}' END")


def _level_sql(k: int) -> str:
    """Template after ``k`` levels (t{k}) from t{k - 1}."""
    return f"""
        s{k} AS (SELECT *, segments[{k}] AS segment FROM t{k - 1}),
        v{k} AS (SELECT host, template FROM (SELECT host, template, segment, sum(n) AS n FROM s{k} WHERE segment IS NOT NULL
                     AND ({_token_sql('segment')}) IS NULL GROUP BY ALL) GROUP BY host, template HAVING count(*) >= 10 AND count(*) >= 0.5 * sum(n)),
        t{k} AS (SELECT host, path, n, b, a, segments, CASE WHEN segment IS NULL THEN template ELSE template || '/' ||
                     coalesce({_token_sql('segment')}, CASE WHEN (host, template) IN (SELECT (host, template) FROM v{k}) THEN '*' END, segment) END AS template FROM s{k})"""


URL_SQL = f"""
    WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        r(rule, rule_host, prefix, ruled) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                   ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
        f AS (SELECT u.*, rule, ruled FROM u LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, prefix)),
        p AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(ruled, length(rule)) AS ruled
              FROM (SELECT *, row_number() OVER () AS _ FROM f) GROUP BY page_id, host, path),
        t0 AS (SELECT host, path, count(*) AS n, count(*) FILTER (ruled = 'block') AS b, count(*) FILTER (ruled = 'allow') AS a,
                   CASE WHEN path = '' THEN [] ELSE string_split(path, '/')[2:] END AS segments, '' AS template FROM p GROUP BY host, path),
        {",".join(map(_level_sql, (1, 2, 3, 4)))},
        t AS (SELECT host, path, b, a, template || CASE WHEN len(segments) > 4 THEN '/**' ELSE '' END AS template FROM t4),
        m AS (SELECT *, regexp_extract(template, '(?s)^(/[^/]*)', 1) AS branch FROM t),
        q AS (SELECT *, substr(template, length(branch) + 1) AS below FROM m),
        st AS (SELECT host, branch, count(DISTINCT below) AS subs, min(below) AS low, max(below) AS high, sum(b) AS b, sum(a) AS a
               FROM q WHERE branch <> '' GROUP BY host, branch),
        w AS (SELECT *, b + a AS c, b / (b + a) + 1.96 * 1.96 / (2 * (b + a)) AS middle,
                  1.96 * sqrt((b / (b + a)) * (a / (b + a)) / (b + a) + 1.96 * 1.96 / (4 * (b + a) * (b + a))) AS half FROM st),
        k AS (SELECT host, branch, subs, low, high, CASE WHEN c = 0 THEN 'none' WHEN (middle - half) / (1 + 1.96 * 1.96 / c) > 0.5 THEN 'block'
                  WHEN (middle + half) / (1 + 1.96 * 1.96 / c) < 0.5 THEN 'allow' ELSE 'mixed' END AS kind FROM w),
        j AS (SELECT host, branch, '/*' || CASE WHEN kind = 'none' THEN '' ELSE '{{' || kind || '}}' END AS joint
              FROM (SELECT *, count(*) OVER (PARTITION BY host, subs, low, high, kind) AS alike FROM k) WHERE alike > 1),
        z AS (SELECT host, path, b, a, coalesce(joint, branch) || below AS template FROM q LEFT JOIN j USING (host, branch)),
        g AS (SELECT coalesce(sum(b) / nullif(sum(b) + sum(a), 0), 0.5) AS share FROM t0),
        x AS (SELECT host, template, sum(b) AS tb, (sum(b) + 2.0::DOUBLE * any_value(share)) / (sum(b) + sum(a) + 2.0::DOUBLE) AS purity
              FROM z, g GROUP BY host, template)
    SELECT page_id, p.host, p.path, rule, coalesce(ruled, CASE WHEN tb > 0 AND purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict, template, purity
    FROM p JOIN z USING (host, path) JOIN x USING (host, template)"""

ORACLES: dict[str, str] = {
    "op3_url_templates": URL_SQL,
    "op5_vector_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
                   FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_token_rollup": r"""
        WITH c AS (SELECT source, lang, regexp_matches(coalesce(text, ''), '[0-9]') AS digit, contains(coalesce(text, ''), '.') AS stop,
                       len(regexp_extract_all(coalesce(text, ''), '[^ \t\n]+')) AS words,
                       len(regexp_extract_all(coalesce(text, ''), '[^ \t\n.,;:!?]+|[.,;:!?]')) AS parts FROM documents)
        SELECT source, lang, 'words-1' AS tokenizer, count(*) AS documents, sum(CASE WHEN digit THEN parts ELSE words END)::BIGINT AS tokens
        FROM c WHERE stop GROUP BY source, lang
        UNION ALL SELECT source, lang, 'words-2', count(*), sum(parts)::BIGINT FROM c GROUP BY source, lang""",
    "op10_decontaminate": f"""
        WITH i AS (SELECT item_id, {_SHINGLES} AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
             d AS (SELECT doc_id, unnest({_SHINGLES}) AS h FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
             e AS (SELECT item_id, len(s) AS n, unnest(s) AS h FROM i)
        SELECT doc_id, item_id, count(*) AS shared, any_value(n) AS item_shingles, count(*) / any_value(n) AS containment
        FROM d JOIN e USING (h) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n) - 1e-9""",
}
