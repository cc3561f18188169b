"""Named queries over the driver's tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cairn.functions import stats, text as T, times
from cairn.operators import joins, tone, transcripts, windows
from cairn.plans import market
from cairn.plans.registry import BANDS, KEYED, ORACLES, PANEL, QUERIES, RETURNS, SIGNALS, WORDS, keyed_signals, panel, query, returns, rounded, signals, table, word_counts

POINTS = "points AS (SELECT call, role, sum(nw) AS w, sum(pos) / sum(nw) AS p, sum(neg) / sum(nw) AS n FROM words GROUP BY 1, 2 HAVING sum(nw) > 0)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = word_counts(spark, sf_dir).filter("nw > 0").withColumn("p", F.col("pos") / F.col("nw")).withColumn("n", F.col("neg") / F.col("nw"))
    return tone.entity_points(w, "call", "role", "nw", ["p", "n"])


def _distance(centre: str, mean: str) -> str:
    return f"""WITH {WORDS}, {POINTS}, c AS (SELECT *, {centre} FROM points),
d AS (SELECT call, w, sqrt((p - cp) * (p - cp) + (n - cn) * (n - cn)) AS d FROM c)
SELECT call, count(*) AS n_entities, round({mean}, 6) AS distance FROM d GROUP BY 1 HAVING count(*) >= 2"""


EQUAL = "avg(p) OVER (PARTITION BY call) AS cp, avg(n) OVER (PARTITION BY call) AS cn"
POOLED = "sum(p * w) OVER (PARTITION BY call) / sum(w) OVER (PARTITION BY call) AS cp, sum(n * w) OVER (PARTITION BY call) / sum(w) OVER (PARTITION BY call) AS cn"


@query(f"WITH {WORDS} SELECT call, turn, role, nw, pos, neg FROM words")
def word_count_lexicon(spark, sf_dir):
    return word_counts(spark, sf_dir)


@query(_distance(EQUAL, "avg(d)"))
def equal_weight_distance(spark, sf_dir):
    return rounded(tone.tone_distance(_points(spark, sf_dir), "call", ["p", "n"]))


@query(_distance(POOLED, "avg(d)"))
def pooled_centroid_distance(spark, sf_dir):
    return rounded(tone.tone_distance(_points(spark, sf_dir), "call", ["p", "n"], centre="pooled"))


@query(_distance(EQUAL, "sum(d * w) / sum(w)"))
def volume_weighted_distance(spark, sf_dir):
    return rounded(tone.tone_distance(_points(spark, sf_dir), "call", ["p", "n"], weighted=True))


@query(f"""WITH {WORDS} SELECT role, round(sum(pos) / sum(nw), 6) AS tone, count(*) AS n FROM words GROUP BY role""")
def weighted_mean_by_role(spark, sf_dir):
    w = word_counts(spark, sf_dir).withColumn("f", F.try_divide("pos", "nw"))
    return rounded(w.groupBy("role").agg(stats.weighted_mean("f", "nw").alias("tone"), F.count("*").alias("n")))


@query(f"""WITH {WORDS} SELECT call, CAST(sum(CASE WHEN role = 'user' THEN nw ELSE 0 END) AS BIGINT) AS user_words, CAST(sum(CASE WHEN role = 'assistant' AND turn > 1 THEN nw ELSE 0 END) AS BIGINT) AS later_words, count(*) FILTER (WHERE pos > neg) AS positive_turns FROM words GROUP BY call""")
def filtered_agg_role_section(spark, sf_dir):
    w = word_counts(spark, sf_dir)
    return w.groupBy("call").agg(
        F.sum(F.when(F.col("role") == "user", F.col("nw")).otherwise(0)).alias("user_words"),
        F.sum(F.when((F.col("role") == "assistant") & (F.col("turn") > 1), F.col("nw")).otherwise(0)).alias("later_words"),
        F.count_if(F.col("pos") > F.col("neg")).alias("positive_turns"),
    )


@query(f"""WITH {WORDS}, b AS (SELECT *, sum(CASE WHEN role = 'user' AND coalesce(prev, '') <> 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY call ORDER BY turn) AS block
FROM (SELECT *, lag(role) OVER (PARTITION BY call ORDER BY turn) AS prev FROM words WHERE role IN ('user', 'assistant')))
SELECT call, CAST(block AS BIGINT) AS block, CAST(sum(CASE WHEN role = 'user' THEN nw ELSE 0 END) AS BIGINT) AS asked, CAST(sum(CASE WHEN role = 'assistant' THEN nw ELSE 0 END) AS BIGINT) AS answered FROM b GROUP BY 1, 2""")
def question_answer_blocks(spark, sf_dir):
    b = joins.pair_answers(word_counts(spark, sf_dir), "call", "turn", "role", "user", "assistant")
    part = lambda r: F.sum(F.when(F.col("role") == r, F.col("nw")).otherwise(0)).cast("long")
    return b.groupBy("call", "block").agg(part("user").alias("asked"), part("assistant").alias("answered"))


@query(r"""SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+([A-Z0-9"''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')) AS n_sentences FROM documents""")
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query(f"WITH {SIGNALS} SELECT id, firm, round(x - lag(x) OVER (PARTITION BY firm ORDER BY day, id), 6) AS delta FROM signals")
def lag_delta(spark, sf_dir):
    s = signals(spark, sf_dir).withColumn("t", F.struct("day", "id"))
    return rounded(windows.lag_delta(s, "firm", "t", "x", "delta").select("id", "firm", "delta"))


@query(f"WITH {SIGNALS} SELECT id, round(avg(x) OVER (PARTITION BY firm ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS past FROM signals")
def expanding_mean_past(spark, sf_dir):
    return rounded(windows.past_mean(signals(spark, sf_dir), "firm", ["day", "id"], "x", "past").select("id", "past"))


@query(f"""WITH {SIGNALS} SELECT id, CASE WHEN count(x) OVER w >= 4 THEN round(avg(x) OVER w, 6) END AS past FROM signals WINDOW w AS (PARTITION BY firm ORDER BY day, id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def rolling4_mean_past(spark, sf_dir):
    return rounded(windows.past_mean(signals(spark, sf_dir), "firm", ["day", "id"], "x", "past", 4, 4).select("id", "past"))


@query(f"""WITH {SIGNALS}, a AS (SELECT *, CAST(day - DATE '1970-01-01' AS BIGINT) AS d FROM signals),
t AS (SELECT *, sum(x) OVER w AS s, count(x) OVER w AS n, sum(x) OVER o AS os, count(x) OVER o AS own FROM a
WINDOW w AS (ORDER BY d RANGE BETWEEN 90 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY firm ORDER BY d RANGE BETWEEN 90 PRECEDING AND 1 PRECEDING))
SELECT id, CASE WHEN n - own >= 3 THEN round((coalesce(s, 0) - coalesce(os, 0)) / (n - own), 4) END AS peers FROM t""")
def peer_mean_90d_ex_self(spark, sf_dir):
    return rounded(windows.peer_mean(signals(spark, sf_dir), "firm", "day", "x", "peers").select("id", "peers"), 4)


@query(f"""WITH {SIGNALS} SELECT id, CASE WHEN count(x) OVER w - 1 >= 3 THEN round((sum(x) OVER w - x) / (count(x) OVER w - 1), 4) END AS others FROM signals WINDOW w AS (PARTITION BY day)""")
def loo_group_mean(spark, sf_dir):
    return rounded(windows.leave_one_out(signals(spark, sf_dir), ["day"], "x", "others").select("id", "others"), 4)


@query(f"""WITH {KEYED}, {PANEL}, e AS (SELECT id, key, day FROM keyed)
SELECT e.id, e.key, round(p.close, 6) AS close FROM e ASOF LEFT JOIN panel p ON e.key = p.key AND e.day > p.date""")
def asof_backward_strict(spark, sf_dir):
    e = keyed_signals(spark, sf_dir).select("id", "key", F.col("day").alias("date"))
    return rounded(joins.asof_backward(e, panel(spark, sf_dir), ["key"], "date", ["close"]).select("id", "key", "close"))


@query(f"""WITH {KEYED}, {PANEL}, e AS (SELECT id, key, day FROM keyed)
SELECT e.id, e.key, p.date AS session FROM e ASOF LEFT JOIN panel p ON e.key = p.key AND e.day <= p.date""")
def asof_forward_inclusive(spark, sf_dir):
    e = keyed_signals(spark, sf_dir).select("id", "key", F.col("day").alias("date"))
    return joins.asof_forward(e, panel(spark, sf_dir), ["key"], "date", "session").select("id", "key", "session")


@query(f"""WITH {KEYED}, {PANEL}, e AS (SELECT id, key, day FROM keyed),
m AS (SELECT e.id, p.date, row_number() OVER (PARTITION BY e.id ORDER BY abs(e.day - p.date), p.date) AS r FROM e JOIN panel p ON e.key = p.key AND p.date BETWEEN e.day - 3 AND e.day + 3)
SELECT e.id, m.date AS fact_day FROM e LEFT JOIN m ON e.id = m.id AND m.r = 1""")
def nearest_join_3d(spark, sf_dir):
    e = keyed_signals(spark, sf_dir).select("id", "key", "day")
    p = panel(spark, sf_dir).select("key", F.col("date").alias("fact_day"))
    return joins.nearest(e, p, ["key"], "day", "fact_day", []).select("id", "fact_day")


@query(f"""WITH {PANEL} SELECT key, date, round(lead(close, 4) OVER w / close - 1, 6) AS ret_5, round(lead(close, 20) OVER w / close - 1, 6) AS ret_21 FROM panel WINDOW w AS (PARTITION BY key ORDER BY date)""")
def forward_return_positions(spark, sf_dir):
    return rounded(joins.forward_returns(panel(spark, sf_dir), "key", "date", "close", "close", [5, 21]).select("key", "date", "ret_5", "ret_21"))


@query(f"""WITH {PANEL}, v AS (SELECT key, date, CASE WHEN count(*) OVER w = 60 THEN avg(close * volume) OVER w END AS adv FROM panel WINDOW w AS (PARTITION BY key ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT key, date, round(adv, 0) AS adv FROM v WHERE adv >= 500000""")
def rolling_adv_filter(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("dollars", F.col("close") * F.col("volume"))
    return rounded(windows.full_mean(p, "key", "date", "dollars", 60, "adv").filter("adv >= 500000").select("key", "date", "adv"), 0)


@query(f"""WITH {RETURNS}, g AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY date) - 1 AS pos FROM rets WHERE r IS NOT NULL AND m IS NOT NULL),
s AS (SELECT *, count(*) OVER e AS n, regr_slope(r, m) OVER e AS b, avg(r) OVER e AS ar, avg(m) OVER e AS am, sum(r) OVER v AS vr, sum(m) OVER v AS vm, count(*) OVER v AS vn FROM g
WINDOW e AS (PARTITION BY key ORDER BY date ROWS BETWEEN 60 PRECEDING AND 11 PRECEDING), v AS (PARTITION BY key ORDER BY date ROWS BETWEEN 1 PRECEDING AND 3 FOLLOWING))
SELECT key, date, round(vr - vn * (ar - b * am) - b * vm, 4) AS car FROM s WHERE n >= 30 AND vn = 5 AND pos >= 1""")
def market_model_car(spark, sf_dir):
    cars = market.market_model_cars(returns(spark, sf_dir), "key", "date", "r", "m", (-1, 3), (-60, -11), 30)
    return rounded(cars.filter("car is not null").select("key", "date", "car"), 4)


@query(f"""WITH {RETURNS} SELECT key, year(date) * 12 + month(date) - 1 AS ym, round(exp(sum(ln(1 + r))) - 1, 4) AS mret FROM rets GROUP BY 1, 2""")
def monthly_compound_return(spark, sf_dir):
    return rounded(market.monthly_returns(returns(spark, sf_dir), "key", "date", "r"), 4)


@query(f"""WITH {SIGNALS}, f AS (SELECT firm, year(day) * 12 + month(day) - 1 + g AS ym, x, day, id, g FROM signals, (VALUES (1), (2), (3)) t(g)),
r AS (SELECT *, row_number() OVER (PARTITION BY firm, ym ORDER BY day DESC, id DESC, g) AS k FROM f) SELECT firm, ym, id, round(x, 4) AS x FROM r WHERE k = 1""")
def latest_in_3_months(spark, sf_dir):
    s = signals(spark, sf_dir).withColumn("m", times.month_index(F.col("day"))).withColumn("o", F.struct("day", "id"))
    return rounded(joins.fan_out_latest(s, "firm", "m", "o").select("firm", "ym", "id", "x"), 4)


@query(f"""WITH {KEYED}, {RETURNS}, f AS (SELECT key, year(day) * 12 + month(day) - 1 + g AS ym, x, day, id, g FROM keyed, (VALUES (1), (2), (3)) t(g)),
l AS (SELECT key, ym, x FROM (SELECT *, row_number() OVER (PARTITION BY key, ym ORDER BY day DESC, id DESC, g) AS k FROM f) WHERE k = 1),
mr AS (SELECT key, year(date) * 12 + month(date) - 1 AS ym, product(1 + r) - 1 AS mret FROM rets WHERE r IS NOT NULL GROUP BY 1, 2),
j AS (SELECT l.key, l.ym, l.x, mr.mret, row_number() OVER (PARTITION BY l.ym ORDER BY l.x DESC, l.key) AS hi, row_number() OVER (PARTITION BY l.ym ORDER BY l.x, l.key) AS lo FROM l JOIN mr ON l.key = mr.key AND l.ym = mr.ym),
a AS (SELECT ym, count(*) AS n_uni, avg(mret) FILTER (WHERE hi <= 10) AS top, avg(mret) FILTER (WHERE lo <= 10) AS bottom, avg(mret) AS universe FROM j GROUP BY ym HAVING count(*) >= 5),
h AS (SELECT key, ym FROM j WHERE hi <= 10 AND ym IN (SELECT ym FROM a)), o AS (SELECT ym, lag(ym) OVER (ORDER BY ym) AS last FROM a),
t AS (SELECT o.ym, CASE WHEN o.last IS NULL THEN 1.0 ELSE 1.0 - (SELECT count(*) FROM h x JOIN h y ON x.key = y.key WHERE x.ym = o.ym AND y.ym = o.last) / 10.0 END AS turnover FROM o)
SELECT a.ym, n_uni, round(top, 4) AS top, round(bottom, 4) AS bottom, round(universe, 4) AS universe, round(CAST(turnover AS DOUBLE), 4) AS turnover, round(top - 0.002 * turnover, 4) AS top_net FROM a JOIN t ON a.ym = t.ym""")
def top10_monthly_portfolio(spark, sf_dir):
    s = keyed_signals(spark, sf_dir).withColumn("m", times.month_index(F.col("day"))).withColumn("o", F.struct("day", "id"))
    last = joins.fan_out_latest(s, "key", "m", "o").select("key", "ym", "x")
    rets = market.monthly_returns(returns(spark, sf_dir).dropna(subset=["r"]), "key", "date", "r")
    return rounded(market.top_k_portfolio(last, rets, "key", "x", least=5), 4)


@query("""WITH p AS (SELECT l.quality AS gold, CASE WHEN length(d.text) >= 300 THEN 1 ELSE 0 END AS pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT gold, count(*) FILTER (WHERE pred = 0) AS "0", count(*) FILTER (WHERE pred = 1) AS "1", round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END), 6) AS recall FROM p GROUP BY gold""")
def confusion_matrix(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") >= 300).cast("int").alias("pred"))
    return rounded(transcripts.confusion(table(spark, sf_dir, "labels").join(d, "doc_id"), "quality", "pred", [0, 1]))


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.05) AS lo, quantile_cont(o_totalprice, 0.95) AS hi FROM orders),
w AS (SELECT o_orderkey AS id, least(greatest(o_totalprice, lo), hi) AS x FROM orders, q) SELECT id, round((x - avg(x) OVER ()) / stddev_samp(x) OVER (), 5) AS z FROM w""")
def winsor_zscore(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("z"))
    return rounded(stats.zscore(stats.winsorize(o, ["z"]), ["z"]), 5)


@query("""SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size BETWEEN 11 AND 25 THEN 'medium' WHEN p_size BETWEEN 26 AND 40 THEN 'large' WHEN p_size IS NOT NULL THEN 'Other' END AS band FROM part""")
def range_table_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", joins.range_lookup(p, "p_size", BANDS).alias("band"))


@query("""WITH b AS (SELECT CASE WHEN t < 34200 THEN 'pre_open' WHEN t > 57600 THEN 'after_close' ELSE 'intraday' END AS session FROM (SELECT hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS t FROM events))
SELECT session, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM b GROUP BY session""")
def session_shares(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(times.session_bucket(F.col("ts")).alias("session")).agg(F.count("*").alias("n"))
    return e.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("""SELECT h.h AS hour, coalesce(c.n, 0) AS n FROM (SELECT unnest(range(24)) AS h) h LEFT JOIN (SELECT hour(ts) AS h, count(*) AS n FROM events WHERE value > 50 GROUP BY 1) c ON h.h = c.h""")
def hour_histogram(spark, sf_dir):
    c = table(spark, sf_dir, "events").filter("value > 50").groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    return spark.range(24).withColumnRenamed("id", "hour").join(c, "hour", "left").fillna(0, ["n"])


@query("""SELECT event_id, CASE WHEN hour(ts) * 3600 + minute(ts) * 60 + second(ts) < 29700 THEN 'same_open' ELSE 'next_open' END AS rule,
CASE WHEN hour(ts) * 3600 + minute(ts) * 60 + second(ts) < 29700 THEN CAST(ts AS DATE) ELSE CAST(ts AS DATE) + 1 END AS day FROM events""")
def decision_intent(spark, sf_dir):
    rule, day = times.decision_intent(F.col("ts"), F.lit(True))
    return table(spark, sf_dir, "events").select("event_id", rule.alias("rule"), day.alias("day"))


@query("""SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total, count(*) AS n FROM events GROUP BY 1""")
def json_payload(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.count("*").alias("n"))


@query(f"""WITH {SIGNALS}, q AS (SELECT *, year(day) * 4 + quarter(day) AS p, x * 2 + id % 7 AS y FROM signals),
r AS (SELECT p, rank() OVER (PARTITION BY p ORDER BY x) + (count(*) OVER (PARTITION BY p, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY p ORDER BY id % 7) + (count(*) OVER (PARTITION BY p, id % 7) - 1) / 2.0 AS ry FROM q)
SELECT p, round(corr(rx, ry), 6) AS ic, count(*) AS n FROM r GROUP BY p""")
def rank_ic_by_quarter(spark, sf_dir):
    s = signals(spark, sf_dir).withColumn("p", F.year("day") * 4 + F.quarter("day")).withColumn("y", F.col("id") % 7)
    return rounded(stats.rank_ic(s, "x", "y", ["p"]))


@query(f"""WITH {RETURNS}, d AS (SELECT date, avg(r) * 0.001 AS r FROM rets WHERE r IS NOT NULL GROUP BY date), c AS (SELECT date, r, exp(sum(ln(1 + r)) OVER (ORDER BY date)) AS c FROM d)
SELECT date, round(c, 5) AS equity, round(c / greatest(1.0, max(c) OVER (ORDER BY date)) - 1, 5) AS drawdown FROM c""")
def equity_drawdown(spark, sf_dir):
    d = returns(spark, sf_dir).dropna(subset=["r"]).groupBy("date").agg((F.avg("r") * 0.001).alias("r"))
    w = Window.orderBy("date")  # a row per day
    d = d.withColumn("equity", F.exp(F.sum(F.log1p("r")).over(w)))
    return rounded(d.select("date", "equity", (F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(w)) - 1).alias("drawdown")), 5)


@query(f"""WITH {SIGNALS}, e AS (SELECT quantile_cont(x, 1.0 / 3) AS a, quantile_cont(x, 2.0 / 3) AS b FROM signals) SELECT CASE WHEN x <= a THEN 1 WHEN x <= b THEN 2 ELSE 3 END AS bucket, count(*) AS n, round(avg(x), 4) AS mean FROM signals, e GROUP BY 1""")
def quantile_buckets(spark, sf_dir):
    b = stats.quantile_bucket(signals(spark, sf_dir), "x", 3)
    return rounded(b.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("x").alias("mean")), 4)


@query(f"""WITH {RETURNS}, v AS (SELECT key, date, count(r) OVER w AS n, stddev_pop(r) OVER w AS s FROM rets WINDOW w AS (PARTITION BY key ORDER BY date ROWS BETWEEN 2 FOLLOWING AND 21 FOLLOWING)) SELECT key, date, CASE WHEN n >= 15 THEN round(s, 5) END AS vol FROM v""")
def realised_volatility(spark, sf_dir):
    return rounded(windows.realised_volatility(returns(spark, sf_dir), "key", "date", "r", 2, 21, 15, "vol").select("key", "date", "vol"), 5)


@query(f"""WITH {SIGNALS}, l AS (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY day DESC, id DESC) AS k FROM signals) SELECT firm, id, day FROM l WHERE k = 1""")
def keep_last(spark, sf_dir):
    w = Window.partitionBy("firm").orderBy(F.desc("day"), F.desc("id"))
    return signals(spark, sf_dir).withColumn("k", F.row_number().over(w)).filter("k = 1").select("firm", "id", "day")


@query(f"""WITH {SIGNALS}, a AS (SELECT id, day, x, CAST(day - DATE '1970-01-01' AS BIGINT) AS d FROM signals),
w AS (SELECT id, x, d, list(x) OVER (ORDER BY d RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING) AS h FROM a)
SELECT id, CASE WHEN len(h) >= 20 THEN round((len(list_filter(h, lambda v: v < x)) + 0.5 * len(list_filter(h, lambda v: v = x))) / len(h), 6) END AS pct FROM w""")
def pit_midrank(spark, sf_dir):
    return rounded(windows.midrank(signals(spark, sf_dir), "day", "x", "pct", 30).select("id", "pct"))


@query(f"""WITH {KEYED}, {PANEL}, a AS (SELECT key, day, x, list(x) OVER (ORDER BY CAST(day - DATE '1970-01-01' AS BIGINT) RANGE BETWEEN 90 PRECEDING AND 1 PRECEDING) AS h FROM keyed),
q AS (SELECT key, day, CASE WHEN len(h) >= 20 THEN (len(list_filter(h, lambda v: v < x)) + 0.5 * len(list_filter(h, lambda v: v = x))) / len(h) END AS pct FROM a),
s AS (SELECT key, day, CASE WHEN pct <= 0.2 THEN -1 WHEN pct >= 1 - 0.2 THEN 1 ELSE 0 END AS side FROM q WHERE pct IS NOT NULL),
p AS (SELECT key, date, close, row_number() OVER k - 1 AS pos, close / (close * 0.99) - 1 AS day0, close / lag(close) OVER k - 1 AS later FROM panel WINDOW k AS (PARTITION BY key ORDER BY date)),
e AS (SELECT p.key, p.pos, s.side, least(1.0 / (5 * count(*) OVER (PARTITION BY p.date, s.side)), 0.1) AS w, row_number() OVER () AS eid FROM s JOIN p ON s.key = p.key AND p.date = s.day + 1 WHERE s.side <> 0),
h AS (SELECT e.eid, e.side, e.w, t.k, p.date, CASE WHEN t.k = 0 THEN p.day0 ELSE p.later END AS r FROM e CROSS JOIN (SELECT unnest(range(5)) AS k) t JOIN p ON p.key = e.key AND p.pos = e.pos + t.k),
g AS (SELECT *, w * exp(sum(ln(1 + coalesce(r, 0))) OVER v) AS grown, lead(k) OVER v IS NULL AS ends FROM h WINDOW v AS (PARTITION BY eid ORDER BY k)),
d AS (SELECT date, sum(side * w * r) AS ret, sum(CASE WHEN k = 0 THEN w ELSE 0 END + CASE WHEN ends THEN grown ELSE 0 END) AS turnover, count(*) AS n_positions, sum(side * w) AS exposure FROM g GROUP BY date),
c AS (SELECT DISTINCT date FROM panel WHERE date BETWEEN (SELECT min(date) FROM d) AND (SELECT max(date) FROM d))
SELECT c.date, round(coalesce(ret, 0), 4) AS ret, round(coalesce(turnover, 0), 4) AS turnover, coalesce(n_positions, 0) AS n_positions, round(coalesce(exposure, 0), 4) AS exposure,
round(coalesce(ret, 0) - coalesce(turnover, 0) * 5 / 1e4, 4) AS net FROM c LEFT JOIN d ON c.date = d.date""")
def calendar_time_portfolio(spark, sf_dir):
    """Signals by rank, entered at the open of the next day where their supplier has one, held 5 rows; net of 5 bps a side."""
    p = joins.with_position(panel(spark, sf_dir).withColumn("open", F.col("close") * 0.99), "key", "date")
    s = keyed_signals(spark, sf_dir)
    ranked = windows.midrank(s, "day", "x", "pct", 90).withColumn("side", windows.side("pct")).filter("side != 0").withColumn("date", F.date_add("day", 1))
    events = ranked.join(p.select("key", "date", "pos"), ["key", "date"]).select("key", "date", "pos", "side")
    held = market.tranches(events, p, "key", 5)
    return rounded(market.calendar_portfolio(held, p.select("date")), 4)


@query()
def placebo_fake_dates(spark, sf_dir):
    """All events and the operator's own numbers of turns and rows; no SQL, since the moves are hashes."""
    cars = market.market_model_cars(returns(spark, sf_dir), "key", "date", "r", "m", (-1, 3), (-60, -11), 30).select("key", "pos", "car")
    return rounded(market.placebo_cars(cars, cars.filter("car is not null").select("key", "pos"), "key"))


# More queries register themselves.
from cairn.plans import market_queries, panel_queries, text_queries  # noqa: E402, F401
