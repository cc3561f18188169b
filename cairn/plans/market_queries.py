"""Queries of event studies and portfolios, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from cairn.functions import stats
from cairn.operators import joins, windows
from cairn.plans import market
from cairn.plans.registry import KEYED, PANEL, RETURNS, SIGNALS, keyed_signals, panel, query, returns, rounded, signals, table

SIDES = f"""{KEYED}, {PANEL}, s AS (SELECT id, key, day, CASE WHEN x > 200000 THEN 1 WHEN x < 60000 THEN -1 ELSE 0 END AS side FROM keyed),
p AS (SELECT key, date, close, row_number() OVER k - 1 AS pos, count(*) OVER (PARTITION BY key) AS size, close / lag(close) OVER k - 1 AS r FROM panel WINDOW k AS (PARTITION BY key ORDER BY date))"""


def sided(spark, sf_dir):
    side = F.when(F.col("x") > 200000, 1).when(F.col("x") < 60000, -1).otherwise(0)
    p = joins.with_position(panel(spark, sf_dir), "key", "date")
    s = keyed_signals(spark, sf_dir).select("id", "key", F.col("day").alias("date"), side.alias("side"))
    return s.join(p.select("key", "date", "pos"), ["key", "date"]), p


@query(f"""WITH {SIDES}, e AS (SELECT row_number() OVER () AS eid, p.key, s.side, p.pos + 1 AS enter, least(p.pos + 11, p.size - 1) AS leave FROM s JOIN p ON s.key = p.key AND s.day = p.date WHERE s.side <> 0 AND p.pos + 1 < p.size - 2),
h AS (SELECT e.side, p.date, e.side * p.r - 0.0005 * ((p.pos = e.enter + 1)::INT + (p.pos = e.leave)::INT) AS x FROM e JOIN p ON e.key = p.key AND p.pos > e.enter AND p.pos <= e.leave WHERE p.r IS NOT NULL)
SELECT date, round(avg(x) FILTER (WHERE side = 1), 5) AS long, round(avg(x) FILTER (WHERE side = -1), 5) AS short, count(x) FILTER (WHERE side = 1) AS n_long, count(x) FILTER (WHERE side = -1) AS n_short,
round(coalesce(avg(x) FILTER (WHERE side = 1), 0) + coalesce(avg(x) FILTER (WHERE side = -1), 0), 5) AS long_short FROM h GROUP BY 1""")
def equal_weight_open(spark, sf_dir):
    e, p = sided(spark, sf_dir)
    return rounded(market.equal_weight_open(e, p, "key", 10), 5)


@query(f"""WITH {RETURNS}, g AS (SELECT *, r - 0.0001 AS x, m - 0.0001 AS y, row_number() OVER (PARTITION BY key ORDER BY date) - 1 AS pos FROM rets WHERE r IS NOT NULL AND m IS NOT NULL),
s AS (SELECT *, count(*) OVER e AS n, regr_slope(x, y) OVER e AS b, sum(x) OVER v AS vx, sum(y) OVER v AS vy, count(*) OVER v AS vn FROM g
WINDOW e AS (PARTITION BY key ORDER BY date ROWS BETWEEN 150 PRECEDING AND 51 PRECEDING), v AS (PARTITION BY key ORDER BY date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT key, date, round(vx - b * vy, 4) AS car FROM s WHERE n >= 70 AND vn = 3 AND pos >= 1""")
def capm_announcement_car(spark, sf_dir):
    r = returns(spark, sf_dir).withColumn("rf", F.lit(0.0001))
    cars = market.market_model_cars(r, "key", "date", "r", "m", (-1, 1), (-150, -51), 70, alpha=False, risk_free="rf")
    return rounded(cars.filter("car is not null").select("key", "date", "car"), 4)


@query(f"""WITH {RETURNS}, g AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY date) - 1 AS pos FROM rets WHERE r IS NOT NULL AND m IS NOT NULL),
s AS (SELECT *, count(*) OVER e AS n, regr_slope(r, m) OVER e AS b, avg(r) OVER e AS ar, avg(m) OVER e AS am, sum(r) OVER v AS vr, sum(m) OVER v AS vm, count(*) OVER v AS vn FROM g
WINDOW e AS (PARTITION BY key ORDER BY date ROWS BETWEEN 60 PRECEDING AND 11 PRECEDING), v AS (PARTITION BY key ORDER BY date ROWS BETWEEN 1 PRECEDING AND 3 FOLLOWING)),
c AS (SELECT close, vr - vn * (ar - b * am) - b * vm AS car FROM s WHERE n >= 30 AND vn = 5 AND pos >= 1), q AS (SELECT quantile_cont(close, 1.0 / 3) AS a, quantile_cont(close, 2.0 / 3) AS z FROM c)
SELECT CASE WHEN close <= a THEN 1 WHEN close <= z THEN 2 ELSE 3 END AS bucket, count(*) AS n, round(avg(car), 4) AS mean_car, round(avg(car) * sqrt(count(*)) / stddev_samp(car), 2) AS t FROM c, q GROUP BY 1""")
def car_by_tercile(spark, sf_dir):
    cars = market.market_model_cars(returns(spark, sf_dir), "key", "date", "r", "m", (-1, 3), (-60, -11), 30)
    out = market.bucket_cars(cars, "close")
    return out.select("bucket", "n", F.round("mean_car", 4).alias("mean_car"), F.round("t", 2).alias("t"))


@query(f"""WITH {KEYED}, {PANEL}, v AS (SELECT key, date, CASE WHEN count(*) OVER w = 60 THEN avg(close * volume) OVER w END AS adv FROM panel WINDOW w AS (PARTITION BY key ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), n AS (SELECT * FROM v WHERE adv IS NOT NULL)
SELECT e.id, round(n.adv, 0) AS adv FROM keyed e ASOF JOIN n ON e.key = n.key AND e.day > n.date WHERE n.adv >= 500000""")
def liquid_events(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("dollars", F.col("close") * F.col("volume"))
    return rounded(market.liquid(keyed_signals(spark, sf_dir), p, "key", "day", "dollars", 60, 500000.0).select("id", "adv"), 0)


@query(f"""WITH {PANEL}, c AS (SELECT DISTINCT date FROM panel WHERE key <= 3), b AS (SELECT key, date, close / lag(close) OVER (PARTITION BY key ORDER BY date) - 1 AS r FROM panel WHERE key IN (2, 5)), g AS (SELECT c.date, k.key FROM c, (VALUES (2), (5)) k(key))
SELECT CAST(g.key AS BIGINT) AS ticker, g.date, round(coalesce(b.r, 0), 5) AS ret_cc FROM g LEFT JOIN b ON g.key = b.key AND g.date = b.date""")
def buy_and_hold(spark, sf_dir):
    p = windows.daily_returns(panel(spark, sf_dir), "key", "date", volume=None, name="ret_cc").withColumnRenamed("key", "ticker")
    out, missing = market.buy_and_hold(p, [2, 5, -1], p.filter("ticker <= 3"))
    assert missing == [-1]
    return rounded(out.withColumn("ticker", F.col("ticker").cast("long")), 5)


@query(f"WITH {RETURNS}, d AS (SELECT date, avg(r) AS net, avg(volume) / 100 AS exposure, avg(m) AS m FROM rets GROUP BY 1) SELECT date, round(net - exposure * coalesce(m, 0), 5) AS hedged FROM d")
def hedged_series(spark, sf_dir):
    r = returns(spark, sf_dir)
    p = r.groupBy("date").agg(F.avg("r").alias("net"), (F.avg("volume") / 100).alias("exposure"))
    return rounded(market.hedged(p, r.select("date", F.col("m").alias("r"))).select("date", "hedged"), 5)


@query(f"WITH {RETURNS}, d AS (SELECT date, avg(r) * 0.01 AS r FROM rets WHERE r IS NOT NULL GROUP BY 1) SELECT round(avg(r) / stddev_samp(r), 6) AS sharpe FROM d")
def daily_sharpe(spark, sf_dir):
    d = returns(spark, sf_dir).filter("r is not null").groupBy("date").agg((F.avg("r") * 0.01).alias("r"))
    return rounded(d.agg(stats.sharpe("r", 1).alias("sharpe")))


@query(f"WITH {SIGNALS} SELECT turn, count(*) AS n, round(sum(x), 0) AS total FROM signals, (VALUES (1), (2), (3)) t(turn) GROUP BY 1")
def shuffled_signals(spark, sf_dir):
    """Each turn deals out the same values; tests hold that they move."""
    out = market.shuffled_signals(signals(spark, sf_dir), "x", ["id"], 3)
    return out.groupBy("turn").agg(F.count("*").alias("n"), F.round(F.sum("x"), 0).alias("total"))


@query()
def robustness_grid(spark, sf_dir):
    """Strategies by horizon and feature; calendar_time_portfolio holds the machinery against SQL."""
    p = joins.with_position(panel(spark, sf_dir).withColumn("open", F.col("close") * 0.99), "key", "date")
    e = keyed_signals(spark, sf_dir).select("key", F.col("day").alias("d"), "x", (-F.col("x")).alias("minus"))
    run = lambda own, q, h, f: market.ranked_strategy(own, q, "key", "d", f, hold=h)
    return rounded(market.robustness_grid(e, p, "key", [3, 5], ["x", "minus", "absent"], run))


@query(f"WITH {PANEL} SELECT date, count(*) AS n, round(sum(close), 4) AS total FROM panel GROUP BY 1")
def daily_totals(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("date").agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("total"))


@query(f"WITH {PANEL}, g AS (SELECT key, date, close, row_number() OVER (PARTITION BY key ORDER BY date) - 1 AS pos FROM panel) SELECT key, date, pos FROM g")
def row_positions(spark, sf_dir):
    return joins.with_position(panel(spark, sf_dir), "key", "date").select("key", "date", F.col("pos").cast("long").alias("pos"))


@query("SELECT o_custkey AS firm, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3")
def top_of_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.select(F.col("o_custkey").alias("firm"), F.col("o_orderkey").alias("id"), F.row_number().over(w).cast("long").alias("place")).filter("place <= 3")
