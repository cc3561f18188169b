"""Queries of transcripts, roles, tone and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.functions import stats, text as T, times
from cairn.operators import audit, scoring, tone, transcripts
from cairn.plans.registry import NEGATIVE, POSITIVE, WORDS, query, rounded, table, word_counts

TITLES, FIRMS, GROUPS = r"\b(chief|president|director)\b", r"\b(bank|capital|securities)\b", r"executives?$|analysts?$|unidentified"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as scored utterances: users are analysts, assistants management, the first two turns remarks."""
    w = word_counts(spark, sf_dir)
    role = F.when(F.col("role") == "user", "analyst").when(F.col("role") == "assistant", "management").otherwise("operator")
    p, n = (F.try_divide(F.col(c), F.col("nw")) for c in ("pos", "neg"))
    return w.select(F.col("call").alias("call_id"), F.col("turn").alias("utterance_idx"), role.alias("role"), F.when(F.col("turn") < 2, "remarks").otherwise("qa").alias("section"), n.alias("p_neg"), (1 - p - n).alias("p_neu"), p.alias("p_pos"), F.col("nw").alias("n_tokens"))


SCORES = f"""{WORDS}, scores AS (SELECT call AS call_id, turn, CASE role WHEN 'user' THEN 'analyst' WHEN 'assistant' THEN 'management' ELSE 'operator' END AS role, CASE WHEN turn < 2 THEN 'remarks' ELSE 'qa' END AS section,
neg / nullif(nw, 0) AS p_neg, 1 - pos / nullif(nw, 0) - neg / nullif(nw, 0) AS p_neu, pos / nullif(nw, 0) AS p_pos, nw AS t FROM words)"""


def _js(p: list[str], q: list[str]) -> str:
    parts = " + ".join(f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END" for a, b in zip(p, q) for x, y in ((a, b), (b, a)))
    return f"CASE WHEN abs({' + '.join(p)} - 1) <= 1e-6 AND abs({' + '.join(q)} - 1) <= 1e-6 THEN sqrt(greatest(({parts}) / 2, 0)) END"


def _mean(test: str, part: str) -> str:
    return f"sum(CASE WHEN {test} THEN {part} * t END) / nullif(sum(CASE WHEN {test} THEN t END), 0)"


SIDES = {"a": "true", "mq": "role = 'management' AND section = 'qa'", "aq": "role = 'analyst' AND section = 'qa'", "mr": "role = 'management' AND section = 'remarks'"}
FEATURES = f"""{SCORES}, g AS (SELECT call_id, {", ".join(f"{_mean(t, f'p_{p}')} AS {k}_{p}" for k, t in SIDES.items() for p in ("neg", "neu", "pos"))},
CASE WHEN count(*) > 1 THEN stddev_pop(p_pos - p_neg) END AS disp, bool_or(section = 'qa') AS qa, count(*) AS n, count(*) FILTER (WHERE {SIDES["mq"]}) AS n_m, count(*) FILTER (WHERE {SIDES["aq"]}) AS n_a FROM scores GROUP BY 1),
features AS (SELECT call_id, a_neg AS p_neg, a_neu AS p_neu, a_pos AS p_pos, a_pos - a_neg AS net_tone, disp AS tone_dispersion, {_js([f"aq_{p}" for p in ("neg", "neu", "pos")], [f"mq_{p}" for p in ("neg", "neu", "pos")])} AS mgmt_analyst_divergence,
(mq_pos - mq_neg) - (aq_pos - aq_neg) AS mgmt_analyst_divergence_signed, (mr_pos - mr_neg) - (mq_pos - mq_neg) AS qa_remarks_gap, qa AS qa_detected, n AS n_utt_scored, n_m AS n_utt_mgmt_qa, n_a AS n_utt_analyst_qa FROM g)"""
REALS = ["p_neg", "p_neu", "p_pos", "net_tone", "tone_dispersion", "mgmt_analyst_divergence", "mgmt_analyst_divergence_signed", "qa_remarks_gap"]


@query(f"WITH {FEATURES} SELECT call_id, {', '.join(f'round({c}, 5) AS {c}' for c in REALS)}, qa_detected, n_utt_scored, n_utt_mgmt_qa, n_utt_analyst_qa FROM features")
def call_features(spark, sf_dir):
    return rounded(tone.call_features(scores(spark, sf_dir)), 5)


@query(f"""WITH {FEATURES}, l AS (SELECT *, {", ".join(f"lag({c}) OVER w AS l_{c}" for c in REALS[:4])} FROM features WINDOW w AS (PARTITION BY call_id % 7 ORDER BY call_id))
SELECT call_id, round(net_tone - l_net_tone, 5) AS delta_tone, round({_js(["p_neg", "p_neu", "p_pos"], ["l_p_neg", "l_p_neu", "l_p_pos"])}, 5) AS tone_js_prev FROM l""")
def call_history(spark, sf_dir):
    f = tone.call_features(scores(spark, sf_dir)).withColumn("ticker", F.col("call_id") % 7)
    return rounded(tone.history_features(f, "ticker", "call_id").select("call_id", "delta_tone", "tone_js_prev"), 5)


@query(f"""WITH {SCORES}, l AS (SELECT *, CASE WHEN p_neg IS NULL THEN 'pos' WHEN p_neg >= p_neu AND p_neg >= p_pos THEN 'neg' WHEN p_neu >= p_pos THEN 'neu' ELSE 'pos' END AS label FROM scores WHERE p_neg IS NOT NULL)
SELECT role, section, count(*) AS n, {", ".join(f"round(sum(CASE WHEN label = '{k}' THEN t ELSE 0 END) / sum(t), 5) AS f_{k}" for k in ("neg", "neu", "pos"))}, {", ".join(f"round(sum(p_{k} * t) / sum(t), 5) AS p_{k}" for k in ("neg", "neu", "pos"))} FROM l GROUP BY 1, 2""")
def label_shares(spark, sf_dir):
    s = scores(spark, sf_dir).filter("p_neg is not null").withColumn("n_tokens", F.col("n_tokens").cast("double"))
    return rounded(tone.label_shares(s, ["role", "section"], "n_tokens"), 5)


@query(f"WITH {SCORES}, e AS (SELECT call_id, role, sum((p_pos - p_neg) * t) / nullif(sum(t), 0) AS v FROM scores GROUP BY 1, 2) SELECT call_id, count(v) AS n_entities, round(CASE WHEN count(v) >= 2 THEN stddev_samp(v) END, 5) AS dispersion FROM e GROUP BY 1")
def entity_dispersion(spark, sf_dir):
    e = scores(spark, sf_dir).withColumn("v", F.col("p_pos") - F.col("p_neg")).groupBy("call_id", "role").agg(stats.weighted_mean("v", "n_tokens").alias("v"))
    return rounded(tone.entity_dispersion(e, "call_id", "v"), 5)


#: Users open the questions here, from their first turn that holds this text on.
MARKER = "th"


@query(f"""WITH u AS (SELECT conv_id AS call_id, turn AS utterance_idx, role AS speaker, role = 'user' AS op, role = 'user' AND contains(lower(text), '{MARKER}') AS opens FROM conversations),
s AS (SELECT *, coalesce(utterance_idx >= min(CASE WHEN opens THEN utterance_idx END) OVER (PARTITION BY call_id), false) AS qa FROM u),
r AS (SELECT *, bool_or(NOT qa AND NOT op) OVER (PARTITION BY call_id, speaker) AS before FROM s)
SELECT call_id, utterance_idx, CASE WHEN qa THEN 'qa' ELSE 'remarks' END AS section, CASE WHEN op THEN 'operator' WHEN before THEN 'management' ELSE 'analyst' END AS role FROM r""")
def infer_roles(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    u = transcripts.check_utterances(c.select(F.col("conv_id").alias("call_id"), F.col("turn").alias("utterance_idx"), F.col("role").alias("speaker"), "text"))
    return transcripts.infer_roles(u, [MARKER], [], [], r"from ([A-Z]\w+)", "user").select("call_id", "utterance_idx", "section", "role")


@query(f"WITH {SCORES} SELECT count(DISTINCT call_id) AS calls, count(DISTINCT CASE WHEN section = 'qa' THEN call_id END) AS calls_with_qa, round(avg(CASE WHEN role <> 'operator' THEN 1.0 END), 6) AS classified, count(*) FILTER (WHERE role = 'management') AS management, count(*) FILTER (WHERE role = 'analyst') AS analyst, count(*) FILTER (WHERE role = 'operator') AS operator, CAST(0 AS BIGINT) AS unknown FROM scores")
def role_coverage(spark, sf_dir):
    return rounded(transcripts.role_coverage(scores(spark, sf_dir)))


@query("""WITH u AS (SELECT conv_id AS call_id, count(*) AS n, sum(length(text)) AS c FROM conversations GROUP BY 1) SELECT call_id, n FROM u WHERE c >= 500 AND n >= 5""")
def quality_filter(spark, sf_dir):
    u = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id"), F.length("text").alias("n_chars"))
    kept, _ = transcripts.quality_filter(u)
    return kept.groupBy("call_id").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT conv_id AS call_id, count(*) AS n, sum(length(text)) AS c FROM conversations GROUP BY 1) SELECT count(*) FILTER (WHERE c >= 500 AND n >= 5) AS kept, count(*) FILTER (WHERE c < 500) AS short, count(*) FILTER (WHERE c >= 500 AND n < 5) AS few FROM u""")
def quality_report(spark, sf_dir):
    u = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id"), F.length("text").alias("n_chars"))
    return transcripts.quality_filter(u)[1]


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS utterance_idx, trim(role) AS speaker, length(trim(text)) AS n_chars FROM conversations WHERE trim(text) <> ''""")
def explode_payload(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    items = F.transform("t", lambda x: F.create_map(F.lit("name"), x["role"], F.lit("content"), x["text"]))
    out = transcripts.explode_payload(c.select("conv_id", F.to_json(items).alias("payload")), "conv_id", "payload")
    return out.select("conv_id", F.col("utterance_idx").cast("long").alias("utterance_idx"), "speaker", F.col("n_chars").cast("long").alias("n_chars"))


@query("""SELECT upper(p_brand) || '_1993Q' || (p_partkey % 4 + 1) || CASE WHEN row_number() OVER w > 1 THEN '_' || row_number() OVER w ELSE '' END AS call_id, p_partkey FROM part WINDOW w AS (PARTITION BY upper(p_brand), p_partkey % 4 ORDER BY p_partkey)""")
def normalise_calls(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = p.select("p_partkey", F.concat(F.lit(" "), F.lower("p_brand")).alias("ticker"), F.lit(1993).alias("year"), (F.col("p_partkey") % 4 + 1).cast("int").alias("quarter"), F.to_timestamp(F.lit("1993-02-03 10:00:00")).alias("call_datetime"))
    return transcripts.normalise_calls(raw, "p_partkey").select("call_id", "p_partkey")


@query("""WITH e AS (SELECT event_id, CAST(ts AS DATE) AS d, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s FROM events) SELECT event_id, CAST(s > 0 AS BOOLEAN) AS has_time FROM e""")
def combine_times(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("d"), F.date_format("ts", "HH:mm:ss").alias("t"))
    return transcripts.combine_times(e, "d", "t").select("event_id", "has_time")


@query("""SELECT s_suppkey, CASE n_name WHEN 'FRANCE' THEN 'GERMANY' WHEN 'CHINA' THEN 'JAPAN' ELSE n_name END AS n_name, n_name AS raw FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def canonical_names(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return transcripts.canonical(s, "n_name", {"FRANCE": "GERMANY", "CHINA": "JAPAN"}, "raw")


def _sets(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_nationkey").alias("n"))
    return s, {"core_a": s.filter("n < 5"), "core_b": s.filter("n between 4 and 8")}


UNIVERSE = """u AS (SELECT s_suppkey AS ticker, s_nationkey < 5 OR s_nationkey BETWEEN 4 AND 8 OR s_nationkey = 12 AS named, CASE WHEN s_nationkey IN (3, 15) THEN 'b' || s_nationkey END AS sensitivity_block, s_nationkey = 20 AS is_delisted,
CASE WHEN s_nationkey < 5 THEN 'core_a' WHEN s_nationkey BETWEEN 4 AND 8 THEN 'core_b' WHEN s_nationkey = 12 THEN 'net' WHEN s_nationkey = 20 THEN 'delisted' END AS l, s_suppkey % 3 > 0 AS in_dataset FROM supplier),
universe AS (SELECT ticker, named AND sensitivity_block IS NULL AS in_core, sensitivity_block, is_delisted, CASE WHEN sensitivity_block IS NOT NULL THEN 'sensitivity:' || sensitivity_block ELSE l END AS layer, in_dataset FROM u WHERE l IS NOT NULL OR sensitivity_block IS NOT NULL)"""


def universe(spark, sf_dir) -> DataFrame:
    s, curated = _sets(spark, sf_dir)
    blocks = s.filter("n in (3, 15)").select("ticker", F.concat(F.lit("b"), F.col("n").cast("string")).alias("block"))
    return transcripts.candidate_universe(curated, s.filter("n = 12"), blocks, s.filter("n = 20"), s.filter("ticker % 3 > 0"))


@query(f"WITH {UNIVERSE} SELECT * FROM universe")
def candidate_universe(spark, sf_dir):
    return universe(spark, sf_dir)


@query(f"WITH {UNIVERSE} SELECT ticker FROM universe WHERE in_dataset AND (in_core OR is_delisted OR sensitivity_block = 'b15')")
def select_tickers(spark, sf_dir):
    return transcripts.select_tickers(universe(spark, sf_dir), ["b15"])


@query(f"WITH {UNIVERSE} SELECT layer, count(*) AS n_candidates, count(*) FILTER (WHERE in_dataset) AS n_in_dataset, count(*) FILTER (WHERE in_core) AS n_in_core FROM universe GROUP BY 1")
def layer_summary(spark, sf_dir):
    return audit.layer_summary(universe(spark, sf_dir), ["in_dataset", "in_core"])


@query(f"""WITH {UNIVERSE}, b AS (SELECT ticker, CASE WHEN sensitivity_block IS NOT NULL THEN sensitivity_block WHEN ticker IN (1, 7) THEN 'core_borderline' ELSE 'core' END AS block FROM universe)
SELECT ticker, block, block IN ('core', 'core_borderline') AS in_strict, block = 'core' AS in_core FROM b""")
def call_blocks(spark, sf_dir):
    u = universe(spark, sf_dir)
    return audit.call_blocks(u.select("ticker"), u, [1, 7])


@query("""SELECT n.n_name, CASE WHEN r.r_name IN ('ASIA') THEN 'by_sector' WHEN n.n_name IN ('BRAZIL', 'FRANCE') THEN 'by_industry' ELSE 'other:' || r.r_name END AS verdict FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""")
def universe_review(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return audit.review(n, "r_name", "n_name", ["ASIA"], ["BRAZIL", "FRANCE"]).select("n_name", "verdict")


@query("SELECT s_suppkey AS ticker FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey IN (3, 4) OR (n_name <> 'JAPAN' AND (r_name = 'ASIA' OR n_name = 'PERU'))")
def programmatic_net(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"))
    return transcripts.programmatic_net(s, [3, 4], ["JAPAN"], ["ASIA"], ["PERU"]).select("ticker")


@query("""WITH p AS (SELECT l.quality AS gold, CASE WHEN length(d.text) >= 300 THEN 1 ELSE 0 END AS pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
c AS (SELECT k AS class, count(*) FILTER (WHERE gold = k) AS support, count(*) FILTER (WHERE pred = k) AS predicted, count(*) FILTER (WHERE gold = k AND pred = k) AS hits FROM p, (VALUES (0), (1)) t(k) GROUP BY k)
SELECT class, support, predicted, hits, round(hits / nullif(predicted, 0), 6) AS precision, round(hits / nullif(support, 0), 6) AS recall, round(sum(hits) OVER () / sum(support) OVER (), 6) AS accuracy FROM c""")
def class_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") >= 300).cast("int").alias("pred"))
    return rounded(transcripts.class_scores(table(spark, sf_dir, "labels").join(d, "doc_id"), "quality", "pred", [0, 1]))


@query("""SELECT count(*) AS n, round(avg(CASE WHEN l.quality = l.toxic THEN 1.0 ELSE 0.0 END), 6) AS agree, round(sum(CASE WHEN l.quality = l.toxic THEN d.n_chars ELSE 0 END) / sum(d.n_chars), 6) AS agree_weighted FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def agreement(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return rounded(stats.agreement(table(spark, sf_dir, "labels").join(d, "doc_id"), "quality", "toxic", "n_chars"))


@query("""WITH n AS (SELECT source, lang, count(*) AS c FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, lang) AS k FROM n) SELECT source, lang FROM r WHERE k = 1""")
def most_frequent(spark, sf_dir):
    return transcripts.most_frequent(table(spark, sf_dir, "documents"), "source", "lang")


@query("""WITH s AS (SELECT source, count(*) AS n_utterances, count(DISTINCT lang) AS n_tickers FROM documents GROUP BY 1), l AS (SELECT source, string_agg(lang, ',' ORDER BY lang) AS tickers FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY lang) AS k FROM (SELECT DISTINCT source, lang FROM documents)) WHERE k <= 4 GROUP BY 1),
t AS (SELECT source, text AS example FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, text) AS k FROM documents) WHERE k = 1)
SELECT s.source, n_utterances, n_tickers, tickers, md5(example) AS example FROM s JOIN l ON s.source = l.source JOIN t ON s.source = t.source""")
def header_summary(spark, sf_dir):
    return transcripts.header_summary(table(spark, sf_dir, "documents"), "source", "lang", "text").withColumn("example", F.md5("example")).withColumn("n_utterances", F.col("n_utterances").cast("long"))


@query("""SELECT source, arg_min(lang, doc_id) AS lang, left(arg_min(text, doc_id), 50) AS text FROM documents GROUP BY 1""")
def first_heard(spark, sf_dir):
    return transcripts.first_heard(table(spark, sf_dir, "documents"), ["source"], "doc_id", ["lang", "text"], "text", 50)


@query("SELECT year(o_orderdate) AS year, count(*) AS n_calls, count(DISTINCT o_custkey) AS n_firm FROM orders GROUP BY 1")
def coverage_by_year(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("year"), F.col("o_custkey").alias("firm"))
    return audit.coverage(o, "year", "firm")


@query("""WITH l AS (SELECT unnest(['FRANCE', 'ATLANTIS', 'PERU']) AS ticker), c AS (SELECT n_name AS ticker, count(*) AS n, min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS z FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT l.ticker, c.n IS NOT NULL AS present, coalesce(c.n, 0) AS n_calls, a AS first_year, z AS last_year FROM l LEFT JOIN c ON l.ticker = c.ticker""")
def survivorship(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("ticker"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").cast("long").alias("year"))
    return audit.presence(o.join(c, "c_custkey"), ["FRANCE", "ATLANTIS", "PERU"])


@query("""WITH m AS (SELECT count(*) AS a, count(DISTINCT o_custkey) AS b, median(o_totalprice) AS c FROM orders) SELECT unnest(['orders', 'firms', 'median']) AS metric, round(unnest([CAST(a AS DOUBLE), b, c]), 4) AS value FROM m""")
def quality_metrics(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return rounded(audit.vertical(o, {"orders": F.count("*"), "firms": F.countDistinct("o_custkey"), "median": F.percentile("o_totalprice", F.lit(0.5))}), 4)


@query("""SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'classified' WHEN l.doc_id IS NULL THEN 'no_distance' WHEN d.n_chars < 400 THEN 'no_decision' WHEN l.toxic = 0 THEN 'missing:toxic' ELSE 'short_history' END AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def classification_reason(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    d = d.select("doc_id", F.when(F.col("quality") == 1, 1).alias("s"), F.col("quality").alias("r"), F.when(F.col("n_chars") >= 400, 1).alias("d"), F.when(F.col("toxic") != 0, 1).alias("toxic"))
    return audit.reason(d, "s", "r", "d", ["toxic"]).select("doc_id", "reason")


@query(f"""WITH {SCORES} SELECT count(p_neu) AS n, round(avg(CAST(p_neu < 0.6 AS INT)), 6) AS low, round(avg(CAST(p_neu > 0.9 AS INT)), 6) AS high, round(avg(CAST(p_neu > 0.2 AND p_neu < 0.8 AS INT)), 6) AS middle FROM scores""")
def saturation(spark, sf_dir):
    return rounded(audit.saturation(scores(spark, sf_dir), "p_neu", 0.6, 0.9, 0.2))


@query(f"""WITH {WORDS}, p AS (SELECT call, role, sum(nw) AS w FROM words GROUP BY 1, 2), t AS (SELECT unnest([25.0, 100.0, 250.0]) AS threshold), g AS (SELECT threshold, call FROM p, t WHERE w >= threshold GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT CAST(t.threshold AS DOUBLE) AS threshold, count(g.call) AS groups FROM t LEFT JOIN g ON t.threshold = g.threshold GROUP BY 1""")
def threshold_survivors(spark, sf_dir):
    p = word_counts(spark, sf_dir).groupBy("call", "role").agg(F.sum("nw").alias("w"))
    return audit.survivors(p, "call", "w", [25.0, 100.0, 250.0])


@query("""SELECT 'o_custkey' AS other, round(corr(o_totalprice, o_custkey), 6) AS corr FROM orders UNION ALL SELECT 'o_orderkey', round(corr(o_totalprice, o_orderkey), 6) FROM orders""")
def volume_bias(spark, sf_dir):
    return rounded(audit.volume_bias(table(spark, sf_dir, "orders"), "o_totalprice", ["o_custkey", "o_orderkey"]))


@query("""WITH a AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 5 > 0), b AS (SELECT doc_id, length(text) + doc_id % 3 AS n_chars FROM documents WHERE doc_id % 7 > 0), j AS (SELECT a.n_chars AS x, b.n_chars AS y, a.doc_id AS i, b.doc_id AS k FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT 'n_chars' AS "column", count(*) FILTER (WHERE i IS NOT NULL AND k IS NOT NULL) AS n, count(*) FILTER (WHERE i IS NULL OR k IS NULL) AS alone, round(corr(x, y), 6) AS corr, CAST(max(abs(x - y)) AS DOUBLE) AS max_diff, CAST(0 AS BIGINT) AS one_null FROM j""")
def compare_columns(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a = d.filter("doc_id % 5 > 0").select("doc_id", "n_chars")
    b = d.filter("doc_id % 7 > 0").select("doc_id", (F.length("text") + F.col("doc_id") % 3).alias("n_chars"))
    return rounded(audit.compare_columns(a, b, ["doc_id"], ["n_chars"]))


#: Words of one or more letters between white space, as the scorer counts them.
TOKENS = "regexp_split_to_array(trim(lower(text)), '\\s+')"


@query(f"""WITH w AS (SELECT conv_id, turn, list_filter({TOKENS}, lambda x: x <> '') AS w FROM conversations), c AS (SELECT conv_id, turn, len(w) AS n, len(list_filter(w, lambda x: list_contains({[x.lower() for x in POSITIVE]}, x))) AS p, len(list_filter(w, lambda x: list_contains({[x.lower() for x in NEGATIVE]}, x))) AS q FROM w)
SELECT conv_id, turn, n AS n_tokens, round(p / nullif(n, 0), 6) AS p_pos, round(q / nullif(n, 0), 6) AS p_neg FROM c""")
def injected_scorer(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    out = scoring.score_texts(c, "text", scoring.lexicon_scorer(POSITIVE, NEGATIVE), {0: "negative", 1: "neutral", 2: "positive"}, limit=64)
    return rounded(out.select("conv_id", "turn", "n_tokens", "p_pos", "p_neg"))


@query(f"""WITH {WORDS}, s AS (SELECT call, turn, neg / nullif(nw, 0) AS n, pos / nullif(nw, 0) AS p, (neg + 1) / (nw + 2) AS n2, (pos + 1) / (nw + 2) AS p2 FROM words), l AS (SELECT *, 1 - n - p AS u, 1 - n2 - p2 AS u2 FROM s WHERE n IS NOT NULL)
SELECT count(*) AS n, round(corr(p, p2), 5) AS corr, round(avg(abs(p - p2)), 6) AS mean_diff, round(max(abs(p - p2)), 6) AS max_diff FROM l""")
def scorer_agreement(spark, sf_dir):
    w = word_counts(spark, sf_dir).filter("nw > 0").select("call", "turn", "nw", "pos", "neg")
    first = w.select("call", "turn", (F.col("neg") / F.col("nw")).alias("p_neg"), (F.col("pos") / F.col("nw")).alias("p_pos")).withColumn("p_neu", 1 - F.col("p_neg") - F.col("p_pos"))
    second = w.select("call", "turn", ((F.col("neg") + 1) / (F.col("nw") + 2)).alias("p_neg"), ((F.col("pos") + 1) / (F.col("nw") + 2)).alias("p_pos")).withColumn("p_neu", 1 - F.col("p_neg") - F.col("p_pos"))
    out = audit.scorer_agreement(first, second, ["call", "turn"]).drop("same_label")
    return out.select("n", F.round("corr", 5).alias("corr"), F.round("mean_diff", 6).alias("mean_diff"), F.round("max_diff", 6).alias("max_diff"))


@query(r"""SELECT doc_id, left(trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g')), 80) AS start FROM documents""")
def collapsed_start(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse(F.regexp_replace("text", "[ \\t\\n\\x0b\\f\\r]+", " "), 80).alias("start"))


@query("SELECT doc_id, list_aggregate(list_transform(range(CAST(ceil(length(text) / 500) AS BIGINT)), lambda i: length(substr(text, i * 500 + 1, 500))), 'count') AS pieces FROM documents")
def giant_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.split_giant(F.col("text"), 500)).cast("long").alias("pieces"))


@query("""SELECT event_id, CAST(ts AS DATE) AS d, CAST(year(ts) AS VARCHAR) || 'Q' || quarter(ts) AS label FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-10' AND CAST(ts AS DATE) <= DATE '2024-01-20'""")
def in_period(spark, sf_dir):
    e = transcripts.in_period(table(spark, sf_dir, "events"), "ts", "2024-01-10", "2024-01-20")
    return e.select("event_id", F.to_date("ts").alias("d"), F.concat(F.year("ts").cast("string"), F.lit("Q"), F.quarter("ts").cast("string")).alias("label"))


@query()
def parsed_transcripts(spark, sf_dir):
    """Conversations as plain transcripts, parsed back; tests hold the parser against its rules."""
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.initcap("role"), F.lit(" -- Firm\n"), F.regexp_replace("text", r"(?m)^.*--.*$", ""))
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return transcripts.parse_transcripts(whole, "conv_id", "text")


@query()
def permutation_null(spark, sf_dir):
    """Tone distances under random dealing of words; hashes seed the draws, so there is no SQL."""
    w = word_counts(spark, sf_dir).filter("nw > 0").groupBy("call", "role").agg(F.sum("nw").cast("int").alias("nw"), F.sum("pos").cast("int").alias("p"), F.sum("neg").cast("int").alias("n"))
    flags = lambda k: F.flatten(F.transform("e", lambda x: F.concat(F.array_repeat(F.lit(1.0), x[k]), F.array_repeat(F.lit(0.0), x["nw"] - x[k]))))
    g = w.groupBy("call").agg(F.array_sort(F.collect_list(F.struct("role", "nw", "p", "n"))).alias("e"))
    rows = g.select("call", F.transform("e", lambda x: x["nw"]).alias("sizes"), flags("p").alias("pos"), F.flatten(F.transform("e", lambda x: F.concat(F.array_repeat(F.lit(0.0), x["nw"] - x["n"]), F.array_repeat(F.lit(1.0), x["n"])))).alias("neg"))
    return rounded(tone.permutation_null(rows, "call", "sizes", ["pos", "neg"], 50))


@query("""SELECT event_id, CASE WHEN hour(ts) >= 5 THEN ts - INTERVAL 5 HOUR ELSE ts - INTERVAL 5 HOUR END AS local FROM events""")
def local_times(spark, sf_dir):
    """Instants in New York's winter; back through times.localise they give the same."""
    e = table(spark, sf_dir, "events").select("event_id", F.from_utc_timestamp("ts", "US/Eastern").alias("local"), "ts")
    return e.filter(times.localise(F.col("local")) == F.col("ts")).select("event_id", "local")


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '')) AS words FROM documents""")
def document_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"))


@query()
def packed_chunks(spark, sf_dir):
    """Chunks of at most 64 words of every document; a test holds them against Python."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.pack_chunks(F.col("text"), 64)).alias("chunk", "text"))
    return d.select("doc_id", "chunk", F.size(F.split("text", r"\s+")).alias("words"), F.md5("text").alias("digest"))


@query()
def shuffled_documents(spark, sf_dir):
    """A fixed random order, English first."""
    return transcripts.priority_shuffle(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", F.col("lang") == "en")
