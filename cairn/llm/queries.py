"""Queries op1 to op10 and the pipeline over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, embedding_dedup, minhash, packing, quality_lm, quality_rules, toxicity, url_tree, warc

#: (verdict, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: What both turns of the conversation that op1 adds say.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{CONTROL_TEXT}'), (-7L, 1L, 'assistant', '{CONTROL_TEXT}') AS t(conv_id, turn, role, text)")
    convs = chat.format_conversations(rows.unionByName(more))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    convs = convs.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return convs.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), with_ids=False)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.perplexity_filter(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).drop("block_bytes", "record_id")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_tree.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.encode_and_decode(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return out.drop("ids", "decoded")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def quality_rule_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4 that no model decides."""
    out = quality_rules.rule_statistics(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7 that rules decide."""
    host, path = url_tree.host_and_path(F.col("url"))
    return url_tree.apply_rules(_table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path")), URL_RULES)


OPERATORS = (op1_chat, op2_embedding_dedup, op3_packing, op4_quality_rules, op5_quality_classifier, op6_warc, op7_url_filters, op8_toxicity, op9_bpe, op10_minhash)
QUERIES = {f.__name__: f for f in (*OPERATORS, quality_rule_base, url_rules)}

#: DuckDB's SQL for the queries that SQL can express: models, tokenizers and packing are held against brute force in tests/llm.
CONTROL = r"(/?s>|/?INST\]|/?SYS>>)"
WORD = "[^ \\t\\n\\x0b\\f\\r]+"
ORACLES: dict[str, str] = {
    "op1_chat": rf"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{CONTROL_TEXT}'), (-7, 1, 'assistant', '{CONTROL_TEXT}')) v),
e AS (SELECT *, CASE WHEN contains(text, '</s>') OR regexp_matches(text, '[<\[]\\+{CONTROL}') THEN regexp_replace(text, '([<\[])(\\*){CONTROL}', '\1\\\2\3', 'g') ELSE text END AS shown FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
sum(8 + length(role) + length(shown)) AS chars FROM e GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, true AS identical FROM g""",
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
low AS (SELECT u, min(v) AS c FROM reach GROUP BY 1), n AS (SELECT u, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, low.c AS component_id, e.vec_id = low.c AS kept FROM embeddings e JOIN low ON e.vec_id = low.u LEFT JOIN n ON e.vec_id = n.u""",
    "quality_rule_base": rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
l AS (SELECT doc_id, len(f) - len(list_distinct(f)) AS dup FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS f FROM w)),
p AS (SELECT doc_id, unnest(range(len(w) - 2)) AS i, w FROM w WHERE len(w) >= 3), t AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS t FROM p), c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM t),
r AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM c, (VALUES (0), (1), (2)) o(k) WHERE n > 1 GROUP BY 1),
s AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(list_sum(list_transform(w.w, lambda x: length(x))) AS BIGINT) AS word_chars, CAST(length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(l.dup AS BIGINT) AS n_dup_lines, coalesce(r.r, 0) AS n_repeat_words
FROM w JOIN l ON w.doc_id = l.doc_id LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s""",
    "op6_warc": """
WITH p AS (SELECT page_id, url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, upper(sha1(coalesce(html, ''))) AS h FROM pages),
d AS (SELECT *, list_aggregate(list_transform(range(8), lambda k: list_aggregate(list_transform(range(4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(5 * k + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * j AS INT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url AS target, true AS block_intact FROM f""",
    "url_rules": rf"""
WITH h AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_tree.UPPER}', '{url_tree.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM h),
r AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{h}', '{q}')" for v, h, q in URL_RULES)}) t(verdict, host, path)),
f AS (SELECT p.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS k FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, f.verdict AS ruled FROM p LEFT JOIN f ON p.page_id = f.page_id AND f.k = 1""",
    "op10_minhash": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_tree.UPPER}', '{url_tree.LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), b AS (SELECT a.doc_id AS u, c.doc_id AS v, count(*) AS n FROM s a JOIN s c ON a.s = c.s AND a.doc_id < c.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM b JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * b.n >= 75 * (x.n + y.n - b.n)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.u, both_ways.v FROM reach JOIN both_ways ON reach.v = both_ways.u),
low AS (SELECT u, min(v) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, low.c AS component_id, d.doc_id = low.c AS kept FROM documents d JOIN low ON d.doc_id = low.u LEFT JOIN n ON d.doc_id = n.doc_id""",
}
