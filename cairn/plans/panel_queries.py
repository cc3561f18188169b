"""Queries of windows, joins in time, statistics and regressions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cairn.functions import stats, times
from cairn.operators import audit, joins, regress, tone, transcripts, windows
from cairn.plans.registry import KEYED, PANEL, RETURNS, SIGNALS, WORDS, keyed_signals, panel, query, returns, rounded, signals, table, word_counts


PAIRS = f"{SIGNALS}, d AS (SELECT id, firm, day, x / 1e5 AS x, x / 2e5 + (id % 11) / 10.0 AS y, year(day) * 4 + quarter(day) AS q FROM signals)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    return s.select("id", "firm", "day", (F.col("x") / 1e5).alias("x"), (F.col("x") / 2e5 + F.col("id") % 11 / 10).alias("y"), (F.year("day") * 4 + F.quarter("day")).alias("q"))


@query(f"WITH {PANEL}, f AS (SELECT *, CASE WHEN volume > 20 THEN close END AS c FROM panel), l AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY key ORDER BY date) AS x FROM f) SELECT key, date, round(x / nullif(lag(x) OVER (PARTITION BY key ORDER BY date), 0) - 1, 5) AS ret, round(c * volume, 4) AS dollar_volume FROM l")
def daily_returns(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("close", F.when(F.col("volume") > 20, F.col("close")))
    return windows.daily_returns(p, "key", "date").select("key", "date", F.round("ret", 5).alias("ret"), F.round("dollar_volume", 4).alias("dollar_volume"))


@query(f"WITH {SIGNALS}, l AS (SELECT id, day, lead(x) OVER w AS nx, lead(day) OVER w AS nd FROM signals WINDOW w AS (PARTITION BY firm ORDER BY day, id)) SELECT id, CASE WHEN nd - day BETWEEN 30 AND 200 THEN round(nx, 4) END AS next_x FROM l")
def next_within(spark, sf_dir):
    out = windows.next_within(signals(spark, sf_dir), "firm", "day", "x", "next_x", order=["day", "id"])
    return rounded(out.select("id", "next_x"), 4)


@query(f"WITH {RETURNS}, mr AS (SELECT key, year(date) * 12 + month(date) - 1 AS ym, product(1 + r) - 1 AS mret FROM rets WHERE r IS NOT NULL GROUP BY 1, 2) SELECT key, ym, CASE WHEN count(mret) OVER f = 11 THEN round(exp(sum(ln(1 + mret)) OVER f) - 1, 3) END AS momentum, round(max(mret) OVER l, 4) AS reversal FROM mr WINDOW f AS (PARTITION BY key ORDER BY ym RANGE BETWEEN 12 PRECEDING AND 2 PRECEDING), l AS (PARTITION BY key ORDER BY ym RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)")
def monthly_momentum(spark, sf_dir):
    from cairn.plans import market

    m = market.monthly_returns(returns(spark, sf_dir).dropna(subset=["r"]), "key", "date", "r")
    return windows.monthly_momentum(m, "key", "ym", "mret").select("key", "ym", F.round("momentum", 3).alias("momentum"), F.round("reversal", 4).alias("reversal"))


@query(f"""WITH {RETURNS}, v AS (SELECT key, date, lead(1, 121) OVER k IS NOT NULL AS whole, count(r) OVER a AS n20, stddev_pop(r) OVER a AS s20, count(r) OVER b AS n120, stddev_pop(r) OVER b AS s120, count(r) OVER c AS n2, avg(abs(r)) OVER c AS e FROM rets
WINDOW k AS (PARTITION BY key ORDER BY date), a AS (PARTITION BY key ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING), b AS (PARTITION BY key ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 120 FOLLOWING), c AS (PARTITION BY key ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))
SELECT key, date, CASE WHEN whole AND n20 >= 15 THEN round(s20, 5) END AS vol_20, CASE WHEN whole AND n120 >= 90 THEN round(s120, 5) END AS vol_120, CASE WHEN whole AND n2 = 2 THEN round(e, 5) END AS echo FROM v""")
def echo_volatility(spark, sf_dir):
    return rounded(windows.echo_volatility(returns(spark, sf_dir), "key", "date", "r").select("key", "date", "vol_20", "vol_120", "echo"), 5)


@query(f"""WITH {SIGNALS}, h AS (SELECT id, x, list(x) OVER (PARTITION BY firm ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM signals)
SELECT id, CASE WHEN len(h) >= 6 THEN round((len(list_filter(h, lambda v: v < x)) + 0.5 * len(list_filter(h, lambda v: v = x))) / len(h), 6) END AS pct FROM h""")
def own_midrank(spark, sf_dir):
    return rounded(windows.own_midrank(signals(spark, sf_dir), "firm", ["day", "id"], "x", "pct").select("id", "pct"))


@query(f"""WITH {SIGNALS}, h AS (SELECT id, x, count(x) OVER w AS n, median(x) OVER w AS m FROM signals WINDOW w AS (PARTITION BY firm ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, CASE WHEN n >= 4 THEN CASE WHEN x > m THEN 'high' ELSE 'low' END END AS side FROM h""")
def past_median_split(spark, sf_dir):
    return windows.past_median_split(signals(spark, sf_dir), "firm", ["day", "id"], "x", "side").select("id", "side")


@query(f"WITH {SIGNALS} SELECT id, round(lag(x) OVER (PARTITION BY firm ORDER BY day, id), 4) AS last_x FROM signals")
def lagged_signal(spark, sf_dir):
    return rounded(windows.lag_value(signals(spark, sf_dir), "firm", ["day", "id"], "x", "last_x").select("id", "last_x"), 4)


@query(f"""WITH {WORDS}, p AS (SELECT call, role, sum(nw) AS w, sum(pos) / sum(nw) AS p, sum(neg) / sum(nw) AS n FROM words GROUP BY 1, 2 HAVING sum(nw) >= 25), m AS (SELECT *, median(w) OVER (PARTITION BY call) AS mw FROM p), k AS (SELECT * FROM m WHERE w >= mw),
c AS (SELECT *, avg(p) OVER (PARTITION BY call) AS cp, avg(n) OVER (PARTITION BY call) AS cn FROM k)
SELECT call, count(*) AS n_entities, round(avg(sqrt((p - cp) * (p - cp) + (n - cn) * (n - cn))), 6) AS distance FROM c GROUP BY 1 HAVING count(*) >= 1""")
def above_median_distance(spark, sf_dir):
    w = word_counts(spark, sf_dir).filter("nw > 0").withColumn("p", F.col("pos") / F.col("nw")).withColumn("n", F.col("neg") / F.col("nw"))
    points = tone.entity_points(w, "call", "role", "nw", ["p", "n"], 25)
    return rounded(tone.tone_distance(points, "call", ["p", "n"], above_median=True, least=1))


@query("SELECT o_orderkey AS id, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end, CAST(DATE '1999-01-01' - CAST(o_orderdate AS DATE) AS INT) AS gap FROM orders")
def quarter_ends(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), times.quarter_end(F.col("o_orderdate")).alias("quarter_end"), times.gap_days(F.lit("1999-01-01"), F.col("o_orderdate")).alias("gap"))


@query("SELECT count(*) AS missing FROM (SELECT DISTINCT doc_id FROM documents WHERE n_chars >= 400) d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def scoring_backlog(spark, sf_dir):
    n = audit.backlog(table(spark, sf_dir, "documents").filter("n_chars >= 400"), table(spark, sf_dir, "labels"), ["doc_id"])
    return spark.range(1).select(F.lit(n).cast("long").alias("missing"))


@query("SELECT count(*) AS rows, count(o_totalprice) AS with_value, CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last, round(avg(o_totalprice), 3) AS mean, round(median(o_totalprice), 3) AS median FROM orders")
def run_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    return rounded(audit.run_summary(o, "o_totalprice", "d"), 3)


@query(f"""WITH {PAIRS}, e AS (SELECT quantile_cont(x, 1.0 / 3) AS a, quantile_cont(x, 2.0 / 3) AS z FROM d), h AS (SELECT avg(y) AS m, var_samp(y) AS v, count(*) AS n FROM d, e WHERE x > z), l AS (SELECT avg(y) AS m, var_samp(y) AS v, count(*) AS n FROM d, e WHERE x <= a)
SELECT h.n AS n_high, l.n AS n_low, round(h.m - l.m, 5) AS diff, round((h.m - l.m) / sqrt(h.v / h.n + l.v / l.n), 3) AS t FROM h, l""")
def high_minus_low(spark, sf_dir):
    from cairn.plans import market

    f = market.high_minus_low(pairs(spark, sf_dir), "x", "y")
    return spark.range(1).select(F.lit(f["n_high"]).cast("long").alias("n_high"), F.lit(f["n_low"]).cast("long").alias("n_low"), F.round(F.lit(f["diff"]), 5).alias("diff"), F.round(F.lit(f["t"]), 3).alias("t"))


FLOWS = "flows AS (SELECT l_suppkey AS key, CAST(date_trunc('quarter', l_shipdate) AS DATE) + 90 AS period, CAST(date_trunc('quarter', l_shipdate) AS DATE) + 120 AS filed, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.to_date(F.date_trunc("quarter", "l_shipdate"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.date_add(q, 90).alias("period"), F.date_add(q, 120).alias("filed")).agg(F.sum("l_quantity").alias("v"))


@query(f"""WITH {KEYED}, {FLOWS}, k AS (SELECT e.id, f.v, row_number() OVER (PARTITION BY e.id ORDER BY f.period DESC) AS r FROM keyed e JOIN flows f ON e.key = f.key AND f.filed < e.day),
g AS (SELECT id, max(v) FILTER (WHERE r = 1) AS last, sum(v) FILTER (WHERE r <= 4) AS sum_4, count(*) FILTER (WHERE r <= 17) AS n, stddev_samp(v) FILTER (WHERE r <= 16) AS s FROM k GROUP BY 1)
SELECT e.id, round(last, 2) AS last, round(sum_4, 2) AS sum_4, n, CASE WHEN n >= 8 THEN round(s, 4) END AS std_16 FROM keyed e LEFT JOIN g ON e.id = g.id""")
def trailing_flows(spark, sf_dir):
    out = windows.trailing_flows(keyed_signals(spark, sf_dir), flows(spark, sf_dir), ["key"], "id", "day", "filed", "period", "v")
    return out.select("id", F.round("last", 2).alias("last"), F.round("sum_4", 2).alias("sum_4"), "n", F.round("std_16", 4).alias("std_16"))


@query(f"""WITH {KEYED}, {FLOWS}, k AS (SELECT e.id, f.v, row_number() OVER (PARTITION BY e.id ORDER BY f.period) AS r FROM keyed e JOIN flows f ON e.key = f.key AND f.period > e.day)
SELECT e.id, round(s, 4) AS future_std FROM keyed e LEFT JOIN (SELECT id, stddev_samp(v) AS s FROM k WHERE r <= 4 GROUP BY 1 HAVING count(*) = 4) g ON e.id = g.id""")
def future_flows(spark, sf_dir):
    return rounded(windows.future_flows(keyed_signals(spark, sf_dir), flows(spark, sf_dir), ["key"], "id", "day", "period", "v").select("id", "future_std"), 4)


@query(f"""WITH {KEYED}, {FLOWS}, k AS (SELECT e.id, f.v, f.period, row_number() OVER (PARTITION BY e.id ORDER BY f.period DESC, f.filed DESC) AS r FROM keyed e JOIN flows f ON e.key = f.key AND f.filed < e.day)
SELECT e.id, round(k.v, 2) AS v, k.period AS period_end FROM keyed e LEFT JOIN k ON e.id = k.id AND k.r = 1""")
def known_at(spark, sf_dir):
    out = joins.known_at(keyed_signals(spark, sf_dir), flows(spark, sf_dir), ["key"], "day", "filed", "period", "v")
    return out.select("id", F.round("v", 2).alias("v"), "period_end")


@query(f"""WITH {KEYED}, {PANEL}, late AS (SELECT * FROM panel WHERE date >= DATE '1995-01-01'), f AS (SELECT key, arg_min(close, date) AS first FROM late GROUP BY 1)
SELECT e.id, round(coalesce(p.close, f.first), 4) AS close, p.close IS NULL AND f.first IS NOT NULL AS extrapolated FROM keyed e ASOF LEFT JOIN late p ON e.key = p.key AND e.day >= p.date LEFT JOIN f ON e.key = f.key""")
def asof_or_first(spark, sf_dir):
    e = keyed_signals(spark, sf_dir).select("id", "key", F.col("day").alias("date"))
    p = panel(spark, sf_dir).filter("date >= '1995-01-01'")
    return rounded(joins.asof_or_first(e, p, ["key"], "date", "close").select("id", "close", "extrapolated"), 4)


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'first' WHEN 'Brand#12' THEN 'second' ELSE lower(p_type) END AS name FROM part")
def lookup_fallback(spark, sf_dir):
    t = spark.sql("SELECT * FROM VALUES ('Brand#11', 'first'), ('Brand#12', 'second') AS t(p_brand, name)")
    return joins.lookup(table(spark, sf_dir, "part"), t, "p_brand", "name", F.lower("p_type")).select("p_partkey", "name")


@query(f"WITH {RETURNS}, a AS (SELECT date, avg(r) AS x FROM rets WHERE key % 2 = 0 GROUP BY 1), b AS (SELECT date, avg(r) AS x FROM rets WHERE key % 2 = 1 GROUP BY 1) SELECT a.date, round(a.x, 5) AS even, round(b.x, 5) AS odd FROM a JOIN b ON a.date = b.date")
def aligned_series(spark, sf_dir):
    r = returns(spark, sf_dir)
    one = lambda k: r.filter(F.col("key") % 2 == k).groupBy("date").agg(F.avg("r").alias("x"))
    return rounded(joins.aligned({"even": one(0), "odd": one(1)}, "date", "x"), 5)


@query(f"""WITH {PANEL}, p AS (SELECT key, date, row_number() OVER (PARTITION BY key ORDER BY date) - 1 AS pos FROM panel),
e AS (SELECT o_orderkey AS id, o_custkey % (SELECT count(*) FROM supplier) + 1 AS key, CAST(o_orderdate AS DATE) AS day, o_orderkey % 3 > 0 AS has_time, o_orderkey % 24 AS h FROM orders),
f AS (SELECT e.*, p.date AS first, p.pos FROM e ASOF LEFT JOIN p ON e.key = p.key AND e.day <= p.date)
SELECT id, pos + CASE WHEN has_time AND first = day AND h >= 16 THEN 1 ELSE 0 END AS pos FROM f""")
def event_anchor(spark, sf_dir):
    p = joins.with_position(panel(spark, sf_dir), "key", "date")
    e = keyed_signals(spark, sf_dir).select("id", "key", (F.unix_seconds(F.col("day").cast("timestamp")) + F.col("id") % 24 * 3600).cast("timestamp").alias("ts"), (F.col("id") % 3 > 0).alias("has_time"))
    return joins.event_anchor(e, p, ["key"], "ts", "has_time").select("id", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {SIGNALS} SELECT id FROM signals WHERE day + 63 <= DATE '1996-06-30'")
def completed_outcomes(spark, sf_dir):
    return joins.completed(signals(spark, sf_dir), "day", 63, "1996-06-30").select("id")


@query("SELECT year(o_orderdate) AS year, round(product(1 + o_totalprice / 1e9) FILTER (WHERE o_custkey % 2 = 0) - 1, 5) AS a, round(product(1 + o_totalprice / 1e9) FILTER (WHERE o_custkey % 2 = 1) - 1, 5) AS b FROM orders GROUP BY 1")
def annual_pivot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("b").alias("s"), F.to_date("o_orderdate").alias("d"), (F.col("o_totalprice") / 1e9).alias("r"))
    return rounded(audit.annual_pivot(o, "s", "d", "r").withColumn("year", F.col("year").cast("long")), 5)


@query("SELECT 'o_totalprice' AS \"column\", count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(stddev_samp(o_totalprice) / avg(o_totalprice), 4) AS cv, round(quantile_cont(o_totalprice, 0.05), 4) AS p5, round(median(o_totalprice), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(min(o_totalprice), 4) AS least, round(max(o_totalprice), 4) AS most FROM orders")
def describe(spark, sf_dir):
    return rounded(stats.describe(table(spark, sf_dir, "orders"), ["o_totalprice"]), 4)


@query("SELECT round(quantile_cont(l_extendedprice, 0.001), 4) AS a, round(quantile_cont(l_extendedprice, 0.5), 4) AS b, round(quantile_cont(l_extendedprice, 0.95), 4) AS c FROM lineitem")
def exact_quantiles(spark, sf_dir):
    """By histograms even where one task could sort all values."""
    q = stats.quantiles(table(spark, sf_dir, "lineitem"), {"l_extendedprice": [0.001, 0.5, 0.95]}, most=500)["l_extendedprice"]
    return spark.range(1).select(*(F.round(F.lit(x), 4).alias(n) for n, x in zip("abc", q)))


@query("SELECT o_orderkey AS id, round((o_totalprice - 100000 - o_custkey) / greatest(abs(100000 + o_custkey), 0.01), 6) AS surprise FROM orders")
def surprise(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return rounded(o.select(F.col("o_orderkey").alias("id"), stats.surprise(F.col("o_totalprice"), 100000 + F.col("o_custkey")).alias("surprise")))


@query("""WITH f AS (SELECT p_partkey AS id, p_retailprice - 950 AS assets, p_size * 10 AS equity, p_size - 5 AS debt, p_retailprice AS cap, p_size - 20 AS income, CASE WHEN p_size % 2 = 0 THEN p_size END AS rd, p_size - 10 AS tax, p_size - 25 AS inc4, p_size / 10.0 AS sr, p_size / 7.0 AS sc FROM part), g AS (SELECT *, CASE WHEN assets > 0 THEN assets END AS a FROM f)
SELECT id, round(ln(a), 5) AS ln_assets, round(CASE WHEN a IS NOT NULL THEN equity / nullif(cap, 0) END, 5) AS btm, round(CASE WHEN debt >= 0 THEN debt / a END, 5) AS lev, round(income / a, 5) AS roa, round(CASE WHEN a IS NOT NULL THEN coalesce(rd / a, 0) END, 5) AS rd_at, round(CASE WHEN a IS NOT NULL AND abs(inc4 + tax) > 1e-9 THEN tax / (inc4 + tax) END, 5) AS etr, round(CASE WHEN sr > 1e-12 THEN sc / sr END, 5) AS smooth FROM g""")
def accounting_ratios(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("double")
    f = p.select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") - 950).alias("assets"), (size * 10).alias("equity"), (size - 5).alias("debt"), F.col("p_retailprice").alias("market_cap"), (size - 20).alias("income"), F.when(F.col("p_size") % 2 == 0, size).alias("research_4q"), (size - 10).alias("tax_4q"), (size - 25).alias("income_4q"), (size / 10).alias("std_roa"), (size / 7).alias("std_cfo"))
    return rounded(stats.accounting_ratios(f).select("id", "ln_assets", "btm", "lev", "roa", "rd_at", "etr", "smooth"), 5)


@query(f"WITH {RETURNS}, d AS (SELECT date, avg(r) * 0.001 AS r FROM rets WHERE r IS NOT NULL GROUP BY 1), c AS (SELECT date, r, exp(sum(ln(1 + r)) OVER (ORDER BY date)) AS c FROM d), p AS (SELECT *, max(c) OVER (ORDER BY date) AS p FROM c) SELECT count(r) AS n, round(arg_max(c, date) - 1, 4) AS total, round(power(arg_max(c, date), 1.0 / ((max(date) - min(date)) / 365.25)) - 1, 4) AS cagr, round(stddev_samp(r) * sqrt(252), 4) AS vol, round(avg(r) / stddev_samp(r) * sqrt(252), 4) AS sharpe, round(min(c / p - 1), 4) AS max_drawdown, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 4) AS hit_rate FROM p")
def performance(spark, sf_dir):
    d = returns(spark, sf_dir).filter("r is not null").groupBy("date").agg((F.avg("r") * 0.001).alias("r"))
    return rounded(stats.performance(d, "date", "r"), 4)


@query(f"""WITH {RETURNS}, d AS (SELECT date, avg(r) * 0.01 AS g, avg(volume) / 100 AS t FROM rets WHERE r IS NOT NULL GROUP BY 1), n AS (SELECT date, t, g - t * 5 / 1e4 AS r FROM d), m AS (SELECT *, r - avg(r) OVER () AS e FROM n),
l AS (SELECT *, {", ".join(f"lag(e, {k}) OVER (ORDER BY date) AS l{k}" for k in range(1, 6))} FROM m),
v AS (SELECT avg(r) AS mean, count(*) AS n, (sum(e * e) + 2 * ({" + ".join(f"(1 - {k} / 6.0) * sum(e * l{k})" for k in range(1, 6))})) / count(*) AS var, stddev_samp(r) AS sd, avg(t) AS turn FROM l)
SELECT round(mean / sd * sqrt(252), 4) AS sharpe_net, round(mean / sqrt(var / n), 3) AS nw_t_net, round(turn * 252, 4) AS annual_turnover, round(turn * 252 * 5 / 1e4, 5) AS cost_drag FROM v""")
def performance_after_costs(spark, sf_dir):
    d = returns(spark, sf_dir).filter("r is not null").groupBy("date").agg((F.avg("r") * 0.01).alias("r"), (F.avg("volume") / 100).alias("t"))
    out = stats.performance(d, "date", "r", turnover="t", bps=5.0)
    return out.select(F.round("sharpe_net", 4).alias("sharpe_net"), F.round("nw_t_net", 3).alias("nw_t_net"), F.round("annual_turnover", 4).alias("annual_turnover"), F.round("cost_drag", 5).alias("cost_drag"))


@query(f"WITH {RETURNS}, d AS (SELECT date, avg(r) FILTER (WHERE key % 2 = 0) AS a, avg(r) FILTER (WHERE key % 2 = 1) AS b FROM rets GROUP BY 1), e AS (SELECT a - b AS e FROM d WHERE a - b IS NOT NULL) SELECT count(*) AS n, round(avg(e) * 252, 3) AS excess_annual, round(avg(e) / stddev_samp(e) * sqrt(252), 4) AS information_ratio, round(avg(e) / stddev_samp(e) * sqrt(count(*)), 4) AS t, round(avg(CASE WHEN e > 0 THEN 1.0 ELSE 0.0 END), 4) AS ahead FROM e")
def excess_over_benchmark(spark, sf_dir):
    r = returns(spark, sf_dir)
    one = lambda k: r.filter(F.col("key") % 2 == k).groupBy("date").agg(F.avg("r").alias("r"))
    out = stats.excess_over(one(0), one(1), "date", "r")
    return out.select("n", F.round("excess_annual", 3).alias("excess_annual"), *(F.round(c, 4).alias(c) for c in ("information_ratio", "t", "ahead")))


@query(f"""WITH {SIGNALS}, q AS (SELECT *, year(day) * 4 + quarter(day) AS p FROM signals),
r AS (SELECT p, rank() OVER (PARTITION BY p ORDER BY x) + (count(*) OVER (PARTITION BY p, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY p ORDER BY id % 7) + (count(*) OVER (PARTITION BY p, id % 7) - 1) / 2.0 AS ry FROM q),
i AS (SELECT corr(rx, ry) AS ic FROM r GROUP BY p) SELECT round(avg(ic) / stddev_samp(ic), 5) AS ratio, round(skewness(ic) * 0, 5) AS zero FROM i""")
def information_ratio(spark, sf_dir):
    s = signals(spark, sf_dir).withColumn("p", F.year("day") * 4 + F.quarter("day")).withColumn("y", F.col("id") % 7)
    return stats.rank_ic(s, "x", "y", ["p"]).agg(F.round(stats.information_ratio("ic"), 5).alias("ratio"), F.lit(0.0).alias("zero"))


@query("WITH m AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders) SELECT round(avg(power((o_totalprice - m) / s, 3)), 4) AS skew, round(avg(power((o_totalprice - m) / s, 4)), 4) AS kurtosis FROM orders, m")
def moments(spark, sf_dir):
    return rounded(table(spark, sf_dir, "orders").agg(*stats.moments("o_totalprice")), 4)


@query(f"""WITH {PAIRS}, c AS (SELECT firm, x - avg(x) OVER (PARTITION BY firm) AS x, y - avg(y) OVER (PARTITION BY firm) AS y FROM d), b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, count(*) AS n, count(DISTINCT firm) AS g FROM c),
s AS (SELECT firm, sum(x * (y - b * x)) AS s FROM c, b GROUP BY 1), m AS (SELECT sum(s * s) AS m FROM s)
SELECT n, g AS clusters, round(b, 5) AS coef, round(b / sqrt(m / xx / xx * g / (g - 1) * (n - 1) / (n - 1 - g)), 3) AS t FROM b, m""")
def panel_regression(spark, sf_dir):
    f = regress.panel_ols(pairs(spark, sf_dir), "y", ["x"], ["firm"], "firm")
    return spark.range(1).select(F.lit(f["n"]).cast("long").alias("n"), F.lit(f["clusters"]).cast("long").alias("clusters"), F.round(F.lit(f["coef"]["x"]), 5).alias("coef"), F.round(F.lit(f["t"]["x"]), 3).alias("t"))


@query(f"""WITH {PAIRS}, r AS (SELECT id, day, x, y, count(*) OVER w AS n, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a FROM d WINDOW w AS (ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT id, CASE WHEN n >= 250 THEN round(y - a - b * x, 4) END AS residual FROM r""")
def residual_pit(spark, sf_dir):
    return rounded(regress.residualize_pit(pairs(spark, sf_dir), "day", "y", ["x"], "residual").select("id", "residual"), 4)


@query(f"""WITH {PAIRS}, m AS (SELECT *, median(x) OVER (PARTITION BY q) AS m FROM d), h AS (SELECT *, x > m AS hi FROM m), l AS (SELECT q, hi, quantile_cont(y, 0.05) AS a, quantile_cont(y, 0.95) AS z FROM h GROUP BY 1, 2),
c AS (SELECT h.q, h.hi, least(greatest(y, a), z) AS y FROM h JOIN l ON h.q = l.q AND h.hi = l.hi)
SELECT q, count(*) AS n, count(*) FILTER (WHERE hi) AS n_high, count(*) FILTER (WHERE NOT hi) AS n_low, round(avg(y) FILTER (WHERE hi) - avg(y) FILTER (WHERE NOT hi), 5) AS spread FROM c GROUP BY 1 HAVING count(*) >= 60""")
def median_spread(spark, sf_dir):
    return rounded(regress.median_spread(pairs(spark, sf_dir), "q", "x", "y"), 5)


@query(f"""WITH {PAIRS}, w AS (SELECT *, count(x) OVER v AS k, median(x) OVER v AS m FROM d WINDOW v AS (PARTITION BY firm ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), h AS (SELECT *, x > m AS hi FROM w WHERE k >= 4),
l AS (SELECT firm, hi, quantile_cont(y, 0.05) AS a, quantile_cont(y, 0.95) AS z, count(*) AS n FROM h GROUP BY 1, 2), f AS (SELECT firm FROM l WHERE n >= 2 GROUP BY 1 HAVING count(*) = 2),
s AS (SELECT h.firm, avg(least(greatest(y, a), z)) FILTER (WHERE h.hi) - avg(least(greatest(y, a), z)) FILTER (WHERE NOT h.hi) AS s FROM h JOIN l ON h.firm = l.firm AND h.hi = l.hi JOIN f ON h.firm = f.firm GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END), 5) AS share, round(avg(s), 5) AS mean, round(avg(s) / stddev_pop(s) * sqrt(count(*)), 3) AS t FROM s HAVING count(*) >= 5""")
def firm_votes(spark, sf_dir):
    s = windows.past_median_split(pairs(spark, sf_dir), "firm", ["day", "id"], "x", "side")
    out = regress.firm_votes(s, "firm", "side", "y", 1, least=2, firms=5)
    return out.select("n", F.round("share", 5).alias("share"), F.round("mean", 5).alias("mean"), F.round("t", 3).alias("t")).filter("n >= 5")


@query(f"""WITH {SIGNALS}, i AS (SELECT day, day + 10 AS ends, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM signals), f AS (SELECT day, ends, CAST(least(((i + 1) * 5 - 1) // n, 4) AS BIGINT) AS f FROM i),
s AS (SELECT f AS fold, min(day) AS a, max(ends) AS z FROM f GROUP BY 1) SELECT s.fold, CASE WHEN f.f = s.fold THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM f, s WHERE f.f = s.fold OR f.ends < s.a OR f.day > s.z + 15 GROUP BY 1, 2""")
def purged_folds(spark, sf_dir):
    from cairn.plans import market

    s = signals(spark, sf_dir).select("id", "day", F.date_add("day", 10).alias("ends"))
    return market.purged_folds(s, "day", "ends").groupBy(F.col("fold").cast("long").alias("fold"), "part").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS t, event_type AS v, avg(value) - 50 AS r FROM events GROUP BY 1, 2), o AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM d)),
b AS (SELECT t, CAST(CASE WHEN i < (n % 8) * (n // 8 + 1) THEN i // (n // 8 + 1) ELSE n % 8 + (i - (n % 8) * (n // 8 + 1)) // (n // 8) END AS INT) AS b FROM o), s AS (SELECT v, b, count(*) AS n, sum(r) AS s, sum(r * r) AS ss FROM d JOIN b ON d.t = b.t GROUP BY 1, 2),
m AS (SELECT x AS id FROM range(256) t(x) WHERE bit_count(x) = 4), a AS (SELECT id, v, (id >> b) & 1 = 1 AS k, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM s, m GROUP BY 1, 2, 3),
p AS (SELECT id, v, max((s / n) / nullif(sqrt(greatest((ss - s * s / n) / (n - 1), 0)), 0)) FILTER (WHERE k) AS x, max((s / n) / nullif(sqrt(greatest((ss - s * s / n) / (n - 1), 0)), 0)) FILTER (WHERE NOT k) AS y FROM a GROUP BY 1, 2),
r AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY x DESC, v) AS best, rank() OVER (PARTITION BY id ORDER BY y) AS rk, count(*) OVER (PARTITION BY id) AS k FROM p) SELECT round(avg(CASE WHEN rk / (k + 1) <= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS pbo FROM r WHERE best = 1""")
def overfitting_probability(spark, sf_dir):
    from cairn.plans import market

    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("t"), F.col("event_type").alias("v")).agg((F.avg("value") - 50).alias("r"))
    return spark.range(1).select(F.round(F.lit(market.overfitting_probability(d, "t", "v", "r", 8)), 6).alias("pbo"))


@query(f"""WITH {WORDS}, m AS (SELECT *, role = 'user' AS ask, role = 'user' AND coalesce(lag(role) OVER (PARTITION BY call ORDER BY turn), '') <> 'user' AS opens FROM words WHERE role IN ('user', 'assistant')), b AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY call ORDER BY turn) AS block FROM m),
q AS (SELECT call, block, sum(nw) AS nw, sum(pos) AS pos FROM b WHERE ask GROUP BY 1, 2), s AS (SELECT call, block, sum(nw) AS nw, sum(pos) AS pos FROM b WHERE NOT ask GROUP BY 1, 2)
SELECT s.call, CAST(s.block AS BIGINT) AS block, round(CAST(greatest(s.nw - coalesce(q.nw, 0) * CASE WHEN s.nw > 0 THEN 1 ELSE 0 END, 0) AS DOUBLE), 4) AS nw, round(CAST(greatest(s.pos - coalesce(q.pos, 0) * CASE WHEN s.nw > 0 THEN 1 ELSE 0 END, 0) AS DOUBLE), 4) AS pos FROM s LEFT JOIN q ON s.call = q.call AND s.block = q.block""")
def question_adjusted(spark, sf_dir):
    b = joins.pair_answers(word_counts(spark, sf_dir), "call", "turn", "role", "user", "assistant")
    b = b.withColumn("role", F.when(F.col("role") == "user", "analyst").otherwise("management")).withColumn("who", F.lit("m"))
    out = tone.question_adjusted(b, "call", "block", "role", "who", ["nw", "pos"], True)
    return out.select("call", F.col("block").cast("long").alias("block"), F.round("nw", 4).alias("nw"), F.round("pos", 4).alias("pos"))


@query("""WITH q AS (SELECT l_suppkey AS key, CAST(date_trunc('year', l_shipdate) AS DATE) AS start, CAST(date_trunc('quarter', l_shipdate) AS DATE) + 90 AS ends, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3), c AS (SELECT key, start, ends, ends + 30 AS filed, sum(v) OVER (PARTITION BY key, start ORDER BY ends) AS v FROM q),
d AS (SELECT key, ends, filed, v, 0 AS o FROM c WHERE ends - start BETWEEN 70 AND 100 UNION ALL SELECT key, ends, greatest(filed, pf), v - pv, 1 FROM (SELECT *, lag(v) OVER w AS pv, lag(ends) OVER w AS pe, lag(filed) OVER w AS pf FROM c WINDOW w AS (PARTITION BY key, start ORDER BY ends)) WHERE ends - pe BETWEEN 70 AND 100),
r AS (SELECT *, row_number() OVER (PARTITION BY key, ends ORDER BY o, filed, v) AS k FROM d) SELECT key, ends, filed, round(v, 2) AS v FROM r WHERE k = 1""")
def year_to_date_quarters(spark, sf_dir):
    start, q = (F.to_date(F.date_trunc(u, "l_shipdate")) for u in ("year", "quarter"))
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key"), start.alias("start"), F.date_add(q, 90).alias("ends")).agg(F.sum("l_quantity").alias("v"))
    f = f.withColumn("v", F.sum("v").over(Window.partitionBy("key", "start").orderBy("ends"))).withColumn("filed", F.date_add("ends", 30))
    return windows.quarterly_from_year_to_date(f, ["key"], "start", "ends", "filed", "v").select("key", "ends", "filed", F.round("v", 2).alias("v"))


@query(f"""WITH {PANEL}, m AS (SELECT key, date, lag(close, 21) OVER w / nullif(lag(close, 252) OVER w, 0) - 1 AS momentum, lag(close, 1) OVER w / nullif(lag(close, 21) OVER w, 0) - 1 AS reversal, median(close * volume) OVER (PARTITION BY key ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS d FROM panel WINDOW w AS (PARTITION BY key ORDER BY date))
SELECT key, date, round(momentum, 4) AS momentum, round(reversal, 4) AS reversal, round(ln(d), 4) AS log_volume FROM m""")
def market_controls(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("dollars", F.col("close") * F.col("volume"))
    return rounded(windows.market_controls(p, "key", "date", "close", "dollars").select("key", "date", "momentum", "reversal", "log_volume"), 4)


@query(f"WITH {SIGNALS}, c AS (SELECT max(day) - INTERVAL 18 MONTH AS cut FROM signals) SELECT CASE WHEN day <= cut THEN 'past' ELSE 'held' END AS part, count(*) AS n FROM signals, c GROUP BY 1")
def holdout_split(spark, sf_dir):
    from cairn.plans import market

    past, held = market.holdout(signals(spark, sf_dir), "day")
    both = past.withColumn("part", F.lit("past")).unionByName(held.withColumn("part", F.lit("held")))
    return both.groupBy("part").agg(F.count("*").alias("n"))


@query(f"WITH {SIGNALS} SELECT firm, min(id) AS id FROM signals GROUP BY 1")
def ordered_distinct(spark, sf_dir):
    return transcripts.ordered_distinct(signals(spark, sf_dir), "firm", "id")


@query("SELECT event_id, CAST(ts AS DATE) AS day, epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 14 HOUR + INTERVAL 30 MINUTE) AS opens FROM events")
def open_instant(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.to_date("ts").alias("day"), F.unix_micros(times.open_instant(F.to_date("ts"))).alias("opens"))


@query("SELECT quality, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS k FROM labels) WHERE k <= 20 GROUP BY 1")
def quota_sample(spark, sf_dir):
    """Which rows a hash picks has no SQL; how many of each class has."""
    return transcripts.quota_sample(table(spark, sf_dir, "labels"), "quality", "doc_id", 20).groupBy("quality").agg(F.count("*").alias("n"))


@query("SELECT 30 AS groups, sum(CASE WHEN k <= 30 THEN 1 ELSE 0 END) > 0 AS some FROM (SELECT row_number() OVER (ORDER BY o_custkey) AS k FROM (SELECT DISTINCT o_custkey FROM orders))")
def group_sample(spark, sf_dir):
    s = transcripts.sample_groups(table(spark, sf_dir, "orders"), "o_custkey", 30)
    return s.agg(F.countDistinct("o_custkey").cast("int").alias("groups"), (F.count("*") > 0).alias("some"))


@query()
def within_window_placebo(spark, sf_dir):
    from cairn.plans import market

    s = signals(spark, sf_dir).withColumn("w", F.year("day") * 4 + F.quarter("day")).withColumn("y", F.col("id") % 7)
    return rounded(market.within_window_placebo(s, "w", "x", "y", "id", 20))


@query()
def regime_comparison(spark, sf_dir):
    """Rank correlations, outcomes and Sharpe ratios before and from 1996, with p-values by resampling."""
    s = pairs(spark, sf_dir)
    d = returns(spark, sf_dir).filter("r is not null").groupBy("date").agg(F.avg("r").alias("r"))
    found = {"ic": stats.compare_ic(s, "x", "y", "day", 1996, 500), "outcome": stats.compare_means(s, "y", "day", 1996, 500), "sharpe": stats.compare_sharpe(d, "date", "r", "1996-01-01", iters=200)}
    return rounded(stats.regimes(spark, found))


@query()
def out_of_sample_residuals(spark, sf_dir):
    out = regress.out_of_sample(pairs(spark, sf_dir), "day", "1996-12-31", "1997-12-31", "y", ["x"], "firm", "q", 30, least=100)
    return rounded(out.select("id", "residual"))


@query()
def walk_forward(spark, sf_dir):
    return rounded(regress.walk_forward(pairs(spark, sf_dir), "day", ["1995-12-31", "1996-12-31", "1997-12-31"], "y", "x", [], ["firm"], "firm", "q", least=100))


@query()
def control_arms(spark, sf_dir):
    d = pairs(spark, sf_dir).withColumn("z", F.col("id") % 5)
    return rounded(regress.control_arms(d, "y", "x", {"alone": [], "with_z": ["z"]}, ["firm"], "firm"))


@query()
def iqr_effect(spark, sf_dir):
    f = regress.iqr_effect(pairs(spark, sf_dir), "y", "x", [], ["firm", "q"], "firm", least=100)
    return spark.range(1).select(F.lit(f["n"]).cast("long").alias("n"), *(F.round(F.lit(float(f[k])), 6).alias(k) for k in ("iqr", "effect", "p")))
