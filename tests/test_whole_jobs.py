"""Queries that no SQL can express, against Python over all rows."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from cairn.plans import catalog, market
from cairn.plans.registry import returns


def brute_sentences(text):
    return len([s for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+(?=[A-Z0-9\"'])", text or "") if s.strip(" ")])


def test_sentence_counts_of_every_document(spark, sf_dir, tmp_path):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    odd = [None, "", " ", "A. B. C. D", "Is it 1. 2. 3? Yes! X! \"Q\" 'r'", "x.  \n Y.\t Z"]
    rows = docs + [(10**6 + i, t) for i, t in enumerate(odd)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in catalog.QUERIES["sentence_counts"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((i, brute_sentences(t)) for i, t in rows)
    assert dict(got)[10**6 + 3] == 4


def brute_placebo(spark, cars, events, iters, least, most):
    """The mean car per turn, event by event, with the moves as Spark hashes them."""
    at = {(r["key"], r["pos"]): r["car"] for r in cars.collect()}
    turns = events.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(iters)))).withColumn("h", F.xxhash64("key", "pos", "turn", F.lit(42)))
    found = defaultdict(list)
    for r in turns.collect():
        to = (r["key"], r["pos"] + (least + r["h"] % (most - least + 1)) * (1 if (r["h"] >> 40) % 2 == 0 else -1))
        if to in at:
            found[r["turn"]].append(at[to])
    known = {t: [x for x in v if x is not None] for t, v in found.items()}
    return {t: (sum(v) / len(v) if v else None, len(v)) for t, v in known.items()}


def test_placebo_moves_every_event(spark, sf_dir):
    panel = returns(spark, sf_dir).filter("key <= 2")
    cars = market.market_model_cars(panel, "key", "date", "r", "m", (-1, 3), (-60, -11), 30).persist()
    events = cars.filter("car is not null").select("key", "pos")
    for limits in ((20, 22, 250), (300, 1, 3)):
        got = {r["turn"]: (r["car"], r["n"]) for r in market.placebo_cars(cars, events, "key", *limits).collect()}
        want = brute_placebo(spark, cars, events, *limits)
        assert got.keys() == want.keys() and all(got[t][1] == n and abs(got[t][0] - c) < 1e-9 for t, (c, n) in want.items())
    odd = spark.createDataFrame([(1, 5, 0.5), (1, 6, None), (2, 0, 1.0), (None, 5, 9.0)], "key long, pos int, car double")
    got = {r["turn"]: (r["car"], r["n"]) for r in market.placebo_cars(odd, odd.select("key", "pos"), "key", 50, 1, 2).collect()}
    assert got == brute_placebo(spark, odd.filter("key is not null"), odd.filter("key is not null").select("key", "pos"), 50, 1, 2)


def test_placebo_query_takes_all_events_and_turns(spark, sf_dir):
    out = catalog.QUERIES["placebo_fake_dates"](spark, sf_dir).collect()
    cars = market.market_model_cars(returns(spark, sf_dir), "key", "date", "r", "m", (-1, 3), (-60, -11), 30)
    events = cars.filter("car is not null").count()
    assert sorted(r["turn"] for r in out) == list(range(1, 1001)) and all(events / 2 < r["n"] <= events for r in out)


def brute_within_window(spark, df, iters):
    """Spearman's correlation per turn over (w, k, x, y) with places by row_number, ranks by pandas."""
    rows = df.dropna(subset=["x", "y", "w"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(iters)))).withColumn("h", F.xxhash64("k", "turn", F.lit(42))).toPandas()
    found = {}
    for turn, own in rows.groupby("turn"):
        own = own.sort_values(["w", "k"])
        dealt = own.sort_values(["w", "h"])["x"].to_numpy() if turn else own["x"].to_numpy()
        found[turn] = (own.assign(x=dealt)[["x", "y"]].rank().corr().iloc[0, 1], len(own))
    return found


def test_within_window_placebo_ranks_once(spark, monkeypatch):
    rows = [(i % 3 if i % 50 else None, i, float(i * 7919 % 1009 % 400) if i % 41 else None, float(i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "w int, k long, x double, y double")
    want = brute_within_window(spark, df, 6)
    shapes = []
    for held, most in ((1 << 20, 1 << 16), (960, 50), (1, 50)):
        monkeypatch.setattr(market, "HELD", held)
        monkeypatch.setattr(market.stats.pooled_rank, "__defaults__", (most,))
        out = market.within_window_placebo(df, "w", "x", "y", "k", 6)
        got = {r["turn"]: (r["ic"], r["n"]) for r in out.collect()}
        assert got.keys() == want.keys() and all(got[t][1] == n and abs(got[t][0] - ic) < 1e-12 for t, (ic, n) in want.items())
        shapes.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert "Generate" not in shapes[0] and "Generate" in shapes[2]  # rows are multiplied by turns in wide windows alone
    odd = [([], []), ([(1, 1, 1.0, 2.0), (1, 2, 2.0, 1.0)], [(0, None, 2), (1, None, 2)]), ([(1, i, 1.0, float(i)) for i in range(4)], [(0, None, 4), (1, None, 4)])]
    for some, said in odd:
        one = spark.createDataFrame(some, "w int, k long, x double, y double")
        assert sorted(tuple(r) for r in market.within_window_placebo(one, "w", "x", "y", "k", 1).collect()) == said
