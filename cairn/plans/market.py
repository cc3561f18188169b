"""Event studies, portfolios and their validation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cairn.functions import stats
from cairn.operators import joins


def market_model_cars(panel: DataFrame, key: str, time: str, ret: str, market: str, event: tuple[int, int] = (-1, 10), estimation: tuple[int, int] = (-120, -21), least: int = 60, alpha: bool = True, risk_free: str | None = None) -> DataFrame:
    """car for every row of the panel as if it were an event: returns beyond alpha + beta * market over the event rows, both
    estimated over the estimation rows; with risk_free both are in excess of that column, and alpha may stay out of the
    prediction. Sums over windows of prefix sums: a fixed number of lags a row, whatever the width."""
    good = panel.dropna(subset=[ret, market, *([risk_free] if risk_free else [])]).withColumn("one", F.lit(1.0))
    free = F.col(risk_free) if risk_free else F.lit(0.0)
    r, m = F.col(ret) - free, F.col(market) - free
    w = Window.partitionBy(key).orderBy(time)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    terms = {"n": F.col("one"), "r": r, "m": m, "rm": r * m, "mm": m * m}
    good = good.withColumn("pos", F.row_number().over(w) - 1).withColumns({f"_{k}": F.sum(v).over(run) for k, v in terms.items()})

    def over(k: str, first: int, last: int):
        """The sum over rows first to last; cut at the series' start, null beyond its end."""
        upto = F.lag(f"_{k}", -last).over(w) if last <= 0 else F.lead(f"_{k}", last).over(w)
        before = F.lag(f"_{k}", 1 - first).over(w) if first <= 0 else F.lead(f"_{k}", first - 1).over(w)
        return upto - F.coalesce(before, F.lit(0.0))

    sums = good.withColumns({f"e_{k}": over(k, *estimation) for k in terms} | {f"v_{k}": over(k, *event) for k in ("n", "r", "m")})
    beta = F.try_divide(F.col("e_n") * F.col("e_rm") - F.col("e_r") * F.col("e_m"), F.col("e_n") * F.col("e_mm") - F.col("e_m") * F.col("e_m"))
    sums = sums.withColumn("beta", beta).withColumn("alpha", F.try_divide(F.col("e_r") - F.col("beta") * F.col("e_m"), F.col("e_n")))
    full = (F.col("e_n") >= least) & (F.col("v_n") == event[1] - event[0] + 1) & (F.col("pos") + event[0] >= 0)
    expected = F.col("beta") * F.col("v_m") + (F.col("alpha") * F.col("v_n") if alpha else F.lit(0.0))
    return sums.withColumn("car", F.when(full, F.col("v_r") - expected)).select(*panel.columns, "pos", "beta", "alpha", "car")


def high_minus_low(events: DataFrame, feature: str, car: str = "car", k: int = 3) -> dict | None:
    """Difference of the means of the highest and the lowest bucket, with Welch's t and p; null under two events in either."""
    own = bucket_moments(events, feature, car, k)
    low, high = own.get(1), own.get(k)
    if not low or not high or min(low[2], high[2]) < 2:
        return None
    found = stats.welch(high[0], high[1], high[2], low[0], low[1], low[2])
    return {"diff": high[0] - low[0], "t": found and found[0], "p": found and found[1], "n_high": high[2], "n_low": low[2]}


def bucket_moments(events: DataFrame, feature: str, car: str, k: int) -> dict[int, tuple[float, float, int]]:
    """Mean, sample variance and number of each bucket."""
    out = stats.quantile_bucket(events.dropna(subset=[feature, car]), feature, k).groupBy("bucket")
    return {r["bucket"]: (r["m"], r["v"], r["n"]) for r in out.agg(F.avg(car).alias("m"), F.var_samp(car).alias("v"), F.count("*").alias("n")).collect()}  # k rows


#: Moved events of a key that one step of placebo_cars holds.
MOVES = 1 << 20


def _hash_int(value: np.ndarray | int, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int, continued from the hash of the columns before it."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (seed + p5 + np.uint64(4)) ^ (np.asarray(value).astype(np.uint64) & np.uint64(0xFFFFFFFF)) * p1
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def placebo_cars(cars: DataFrame, events: DataFrame, key: str, iters: int = 1000, least: int = 22, most: int = 250, seed: int = 42) -> DataFrame:
    """Mean car per turn with each event moved by a hashed number of rows, `least` to `most` either way.

    Every event moves in every turn. Moves are made beside the cars of their key (one row per key and pos), so what is shuffled
    are cars, events and a sum per key and turn, not events times turns."""

    def move(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        size = 1 + max(held["pos"].max(), 0) if len(held) else 1
        at = held["pos"].to_numpy(np.int64)
        there, value = np.zeros(size, bool), np.full(size, np.nan)
        there[at], value[at] = True, held["car"].to_numpy(np.float64)
        pos, first = asked["at"].to_numpy(np.int64), asked["h"].to_numpy(np.int64).view(np.uint64)
        rows, sums, known = (np.zeros(iters, t) for t in (np.int64, np.float64, np.int64))
        step = max(1, MOVES // iters)
        for a in range(0, len(pos), step):
            h = _hash_int(seed, _hash_int(np.arange(1, iters + 1)[:, None], first[None, a : a + step])).view(np.int64)
            to = pos[None, a : a + step] + (h % (most - least + 1) + least) * np.where((h >> 40) % 2 == 0, 1, -1)
            inside = (to >= 0) & (to < size)
            to = np.where(inside, to, 0)
            hit, car = inside & there[to], value[to]
            good = hit & ~np.isnan(car)
            rows, sums, known = rows + hit.sum(1), sums + np.where(good, car, 0.0).sum(1), known + good.sum(1)
        out = pd.DataFrame({"turn": np.arange(1, iters + 1, dtype=np.int32), "s": sums, "n": known})
        return out[rows > 0]

    held = cars.filter(F.col(key).isNotNull()).select(key, "pos", "car")
    asked = events.filter(F.col(key).isNotNull() & F.col("pos").isNotNull()).select(F.col(key).alias("_k"), F.col("pos").alias("at"), F.xxhash64(F.col(key), F.col("pos")).alias("h"))
    moved = held.groupBy(key).cogroup(asked.groupBy("_k")).applyInPandas(move, "turn int, s double, n long")
    return moved.groupBy("turn").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("car"), F.sum("n").alias("n"))


def bucket_cars(events: DataFrame, feature: str, car: str = "car", k: int = 3) -> DataFrame:
    """Per quantile bucket of a feature: n, mean and its t."""
    out = stats.quantile_bucket(events.dropna(subset=[feature, car]), feature, k)
    return out.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(car).alias("mean_car"), F.try_divide(F.avg(car) * F.sqrt(F.count("*")), F.stddev_samp(car)).alias("t"))


def tranches(events: DataFrame, panel: DataFrame, key: str, hold: int, cap: float = 0.1) -> DataFrame:
    """A row for each day that an event (key, pos, date, side) is held: w, r, entry, last and exit_w; day 0 from open to close, then
    close to close. w is min(1 / (hold * events of its day and side), cap) among events that have a price. The last day, the
    hold's or the series' end, leaves at exit_w: w grown by all returns of the event; null returns don't grow it."""
    w = Window.partitionBy(key).orderBy("pos")
    positive = lambda c: F.when(c > 0, c)
    days = panel.select(key, "pos", "date", (F.col("close") / positive(F.col("open")) - 1).alias("first"), (F.col("close") / positive(F.lag("close").over(w)) - 1).alias("next"))
    priced = events.filter("side != 0").join(panel.select(key, "pos"), [key, "pos"], "left_semi")
    n = F.count("*").over(Window.partitionBy("date", "side"))
    own = F.row_number().over(Window.partitionBy(key, "pos").orderBy("side"))  # several events of one key and row
    held = priced.withColumn("w", F.least(1.0 / (hold * n), F.lit(cap))).withColumn("_id", own).withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(hold - 1))))
    held = held.select(key, F.col("pos").alias("entry"), "_id", "side", "w", "day", (F.col("pos") + F.col("day")).alias("pos"))
    rows = held.join(days, [key, "pos"]).withColumn("r", F.when(F.col("day") == 0, F.col("first")).otherwise(F.col("next")))
    path = Window.partitionBy(key, "entry", "_id").orderBy("day")
    grown = F.exp(F.sum(F.log1p(F.coalesce("r", F.lit(0.0)))).over(path))
    last = F.lead("day").over(path).isNull()
    return rows.withColumn("last", last).withColumn("exit_w", F.when(F.col("last"), F.col("w") * grown)).select(key, "entry", "side", "w", "day", "date", "r", "last", "exit_w")


def calendar_portfolio(held: DataFrame, calendar: DataFrame, bps: float = 5.0, variant: str = "long_short") -> DataFrame:
    """Per day of the calendar from the first to the last position: ret, turnover (entries at w, exits at exit_w), n_positions,
    exposure, and net of costs per side; days in cash are 0. variant long_only drops shorts, which their events' weights allow
    for by side."""
    if variant not in ("long_short", "long_only"):
        raise ValueError(f"variant {variant}")
    rows = held.filter("side > 0") if variant == "long_only" else held
    daily = rows.groupBy("date").agg(
        F.sum(F.col("side") * F.col("w") * F.col("r")).alias("ret"),
        F.sum(F.when(F.col("day") == 0, F.col("w")).otherwise(0.0) + F.coalesce("exit_w", F.lit(0.0))).alias("turnover"),
        F.count("*").alias("n_positions"),
        F.sum(F.col("side") * F.col("w")).alias("exposure"),
    )
    whole = Window.partitionBy()  # a row per day
    out = joins.on_calendar(daily.withColumn("_on", F.lit(1)), calendar, "date", ["ret", "turnover", "n_positions", "exposure"])
    out = out.withColumn("_a", F.min(F.when(F.col("_on") == 1, F.col("date"))).over(whole)).withColumn("_z", F.max(F.when(F.col("_on") == 1, F.col("date"))).over(whole))
    out = out.filter(F.col("date").between(F.col("_a"), F.col("_z"))).drop("_on", "_a", "_z")
    return stats.apply_costs(out, "ret", "turnover", bps)


def hedged(portfolio: DataFrame, market: DataFrame, ret: str = "net", name: str = "hedged") -> DataFrame:
    """The portfolio's return less its exposure times the market's (date, r); a day without a market return hedges nothing."""
    one = market.groupBy("date").agg(F.first("r", True).alias("_m"))
    return portfolio.join(one, "date", "left").withColumn(name, F.col(ret) - F.col("exposure") * F.coalesce("_m", F.lit(0.0))).drop("_m")


def liquid(events: DataFrame, panel: DataFrame, key: str, time: str, dollars: str, rows: int = 60, least: float = 5e6) -> DataFrame:
    """Events whose key's mean dollar volume over its last `rows` rows strictly before the event is at least `least`."""
    from cairn.operators import windows

    adv = windows.full_mean(panel, key, "date", dollars, rows, "adv").select(key, F.col("date").alias(time), "adv")
    return joins.asof_backward(events, adv, [key], time, ["adv"]).filter(F.col("adv") >= least)


def equal_weight_open(events: DataFrame, panel: DataFrame, key: str, hold: int = 63, cost: float = 0.0005) -> DataFrame:
    """Per day the mean return of open longs and of open shorts, long less short, and numbers of positions.

    events (key, pos, side) enter at the close of the row after theirs and leave `hold` rows later or at the series' end; returns
    count from the row after the entry; events in the last two rows are left out. Both legs pay cost on entering and leaving."""
    size = panel.groupBy(key).agg((F.max("pos") + 1).alias("_size"))
    own = events.filter("side != 0").select(key, "pos", "side").join(size, key).withColumn("_in", F.col("pos") + 1).filter("_in < _size - 2")
    own = own.withColumn("_out", F.least(F.col("_in") + hold, F.col("_size") - 1))
    held = own.withColumn("pos", F.explode(F.sequence(F.col("_in") + 1, F.col("_out"))))
    r = F.col("close") / F.lag("close").over(Window.partitionBy(key).orderBy("pos")) - 1
    days = panel.select(key, "pos", "date", r.alias("r"))
    trades = (F.col("pos") == F.col("_in") + 1).cast("int") + (F.col("pos") == F.col("_out")).cast("int")
    rows = held.join(days, [key, "pos"]).filter("r is not null").withColumn("x", F.col("side") * F.col("r") - trades * cost)
    leg = lambda s: F.when(F.col("side") == s, F.col("x"))
    out = rows.groupBy("date").agg(F.avg(leg(1)).alias("long"), F.avg(leg(-1)).alias("short"), F.count(leg(1)).alias("n_long"), F.count(leg(-1)).alias("n_short"))
    return out.withColumn("long_short", F.coalesce("long", F.lit(0.0)) + F.coalesce("short", F.lit(0.0)))


def shuffled_signals(events: DataFrame, signal: str, order: list[str], turns: int = 20, seed: int = 42) -> DataFrame:
    """events with turn 1 to `turns`, the signal of each row dealt to another row of the turn by hash.

    Ranks within hash buckets and buckets' sizes give both sides' places, so no task orders a whole turn."""
    rows = events.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(turns))))
    parts = 256

    def placed(df: DataFrame, salt: int, name: str) -> DataFrame:
        h = F.xxhash64(*order, "turn", F.lit(seed + salt))
        df = df.withColumn("_h", h).withColumn("_b", F.pmod(F.shiftright("_h", 20), F.lit(parts)).cast("int"))
        sizes = df.groupBy("turn", "_b").agg(F.count("*").alias("_c"))
        sizes = sizes.withColumn("_o", F.sum("_c").over(Window.partitionBy("turn").orderBy("_b")) - F.col("_c")).drop("_c")
        within = F.row_number().over(Window.partitionBy("turn", "_b").orderBy("_h", *order)) - 1
        return df.withColumn("_i", within).join(sizes, ["turn", "_b"]).withColumn(name, F.col("_o") + F.col("_i")).drop("_h", "_b", "_o", "_i")

    to = placed(rows.drop(signal), 1, "_p")
    source = placed(rows.select(*order, "turn", signal), 2, "_p").select("turn", "_p", signal)
    return to.join(source, ["turn", "_p"]).drop("_p").select(*events.columns, "turn")


def buy_and_hold(prices: DataFrame, names: list[str], calendar: DataFrame, key: str = "ticker", ret: str = "ret_cc") -> tuple[DataFrame, list[str]]:
    """(key, date, ret) of benchmarks on the calendar, 0 where they have no return, and the names that prices lack, which are
    left out rather than shown as flat."""
    found = prices.filter(F.col(key).isin(names))
    there = [r[0] for r in found.select(key).distinct().collect()]
    grid = calendar.select("date").distinct().withColumn(key, F.explode(F.array(*map(F.lit, sorted(there))))) if there else calendar.select("date").limit(0).withColumn(key, F.lit(""))
    out = grid.join(found.select(key, "date", ret), [key, "date"], "left").fillna(0.0, [ret])
    return out.select(key, "date", ret), [n for n in names if n not in there]


def monthly_returns(daily: DataFrame, key: str, day: str, ret: str) -> DataFrame:
    """Compounded return per key and month index ym."""
    ym = (F.year(day) * 12 + F.month(day) - 1).alias("ym")
    return daily.groupBy(key, ym).agg((F.product(1 + F.col(ret)) - 1).alias("mret"))


def top_k_portfolio(signals: DataFrame, returns: DataFrame, key: str, signal: str, k: int = 10, least: int = 100, bps: float = 10.0) -> DataFrame:
    """Per month the k highest and lowest signals, equally weighted: n_uni, top, bottom, universe, turnover, top_net.

    signals (key, ym, signal) are joined to returns (key, ym, mret); months under `least` keys are left out; ties go by key. One
    pass over the ranked rows: a month keeps the names of its k, and turnover compares months."""
    both = signals.join(returns.dropna(subset=["mret"]), [key, "ym"]).dropna(subset=[signal])
    by = Window.partitionBy("ym")
    ranked = both.withColumn("hi", F.row_number().over(by.orderBy(F.desc(signal), F.asc(key)))).withColumn("lo", F.row_number().over(by.orderBy(F.asc(signal), F.asc(key))))
    months = ranked.groupBy("ym").agg(
        F.count("*").alias("n_uni"),
        F.avg(F.when(F.col("hi") <= k, F.col("mret"))).alias("top"),
        F.avg(F.when(F.col("lo") <= k, F.col("mret"))).alias("bottom"),
        F.avg("mret").alias("universe"),
        F.collect_set(F.when(F.col("hi") <= k, F.col(key))).alias("held"),
    ).filter(F.col("n_uni") >= least)
    before = F.lag("held").over(Window.orderBy("ym"))  # a row per month
    out = months.withColumn("turnover", F.when(before.isNull(), 1.0).otherwise(1.0 - F.size(F.array_intersect("held", before)) / F.lit(float(k))))
    return out.withColumn("top_net", F.col("top") - 2 * bps / 1e4 * F.col("turnover")).select("ym", "n_uni", "top", "bottom", "universe", "turnover", "top_net")


def purged_folds(df: DataFrame, time: str, ends: str, k: int = 5, embargo_days: int = 15) -> DataFrame:
    """(fold, part) rows: each row tests in one fold and trains in those whose test span its own [time, ends] stays clear of.

    Rows of one time are numbered within it, after the rows of earlier times, which a table of one row per time counts."""
    per = df.groupBy(time).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.orderBy(time))  # a row per time
    per = per.select(F.col(time).alias("_t"), (upto - F.col("_c")).alias("_o"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    hashed = F.xxhash64(*(F.col(f"`{c}`").cast("string") for c, t in df.dtypes if not t.startswith("map")))
    rows = df.join(per, F.col(time).eqNullSafe(F.col("_t"))).withColumn("_i", F.col("_o") + F.row_number().over(Window.partitionBy(time).orderBy(hashed)) - 1)
    rows = rows.withColumn("_f", F.least(F.floor(((F.col("_i") + 1) * k - 1) / F.col("_n")), F.lit(k - 1)).cast("int"))
    spans = rows.groupBy(F.col("_f").alias("fold")).agg(F.min(time).alias("_a"), F.max(ends).alias("_b"))
    out = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).join(F.broadcast(spans), "fold")  # k rows
    test = F.col("_f") == F.col("fold")
    clear = (F.col(ends) < F.col("_a")) | (F.col(time) > F.date_add("_b", embargo_days))
    return out.withColumn("part", F.when(test, "test").when(clear, "train")).filter("part is not null").select(*df.columns, "fold", "part")


def overfitting_probability(returns: DataFrame, time: str, variant: str, ret: str, blocks: int = 16) -> float | None:
    """Share of splits of `blocks` time blocks in half whose best variant in sample is no better than the median out of it.

    Blocks are summed first; splits see blocks * variants rows, not the series."""
    n = returns.select(time).distinct().count()
    if n < blocks:
        return None
    order = returns.select(time).distinct().withColumn("_i", F.row_number().over(Window.orderBy(time)) - 1)
    big = n % blocks
    size = n // blocks
    block = F.when(F.col("_i") < big * (size + 1), F.floor(F.col("_i") / (size + 1))).otherwise(big + F.floor((F.col("_i") - big * (size + 1)) / size))
    sums = returns.join(order.withColumn("b", block.cast("int")), time).groupBy(variant, "b").agg(F.count(ret).alias("n"), F.sum(ret).alias("s"), F.sum(F.col(ret) * F.col(ret)).alias("ss"))
    spark = returns.sparkSession
    splits = spark.range(1 << blocks).filter(F.bit_count("id") == blocks // 2)
    both = sums.join(F.broadcast(splits))
    inside = F.expr("(shiftright(id, b) & 1) = 1")

    def sharpe(test):
        n, s, ss = (F.sum(F.when(test, F.col(c))) for c in ("n", "s", "ss"))
        return F.try_divide(s / n, F.sqrt(F.greatest((ss - s * s / n) / (n - 1), F.lit(0.0))))

    per = both.groupBy("id", variant).agg(sharpe(inside).alias("x"), sharpe(~inside).alias("y"))
    by = Window.partitionBy("id")
    ranked = per.withColumn("best", F.row_number().over(by.orderBy(F.desc("x"), variant))).withColumn("rank", F.rank().over(by.orderBy("y"))).withColumn("k", F.count("*").over(by))
    return ranked.filter("best = 1").agg(F.avg((F.col("rank") / (F.col("k") + 1) <= 0.5).cast("double"))).first()[0]


def holdout(df: DataFrame, day: str, months: int = 18) -> tuple[DataFrame, DataFrame]:
    """Rows up to `months` before the last day, and those after; rows without a day are in neither."""
    cut = df.agg(F.add_months(F.max(day), -months)).first()[0]
    return df.filter(F.col(day) <= F.lit(cut)), df.filter(F.col(day) > F.lit(cut))


#: Rows of a window that one task of within_window_placebo() deals.
HELD = 1 << 20


def within_window_placebo(df: DataFrame, window: str, signal: str, ret: str, key: str, iters: int = 200, seed: int = 42) -> DataFrame:
    """Pooled rank correlation per turn with signals dealt anew within each window by hash; turn 0 is the true one.

    The rows of a window in order of key get its signals in order of a hash of key and turn. Dealing keeps the values of both sides,
    so all turns share one ranking and differ in a sum of products, which a window's task makes for every turn: what is shuffled are
    rows, not rows times turns. Windows beyond HELD rows deal rows times turns out by buckets of the hash, with the same result."""
    rows = df.dropna(subset=[signal, ret]).filter(F.col(window).isNotNull())
    rows = rows.select(F.col(window).alias("_w"), F.col(key).alias("_k"), F.col(signal).cast("double").alias("_x"), F.col(ret).cast("double").alias("_y"))
    middle = (rows.count() + 1) / 2
    wide = rows.groupBy("_w").agg(F.count("*").alias("_n")).filter(F.col("_n") > HELD).select("_w")  # at most a row for each HELD of the input
    ranked = stats.pooled_rank(stats.pooled_rank(rows, "_x", "_rx"), "_y", "_ry")
    ranked = ranked.select("_w", "_k", (F.col("_rx") - middle).alias("_x"), (F.col("_ry") - middle).alias("_y"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_k", "_x", "_y"], na_position="first")
        x, y, h = pdf["_x"].to_numpy(), pdf["_y"].to_numpy(), pdf["_h"].to_numpy(np.int64).view(np.uint64)
        sums = [x @ y]
        for turn in range(1, iters + 1):
            sums.append(x[np.argsort(_hash_int(seed, _hash_int(turn, h)).view(np.int64), kind="stable")] @ y)
        return pd.DataFrame({"turn": np.arange(iters + 1, dtype=np.int32), "s": sums, "xx": x @ x, "yy": y @ y, "n": len(x)})

    held = ranked.join(F.broadcast(wide), "_w", "left_anti").withColumn("_h", F.xxhash64("_k"))
    sums = held.groupBy("_w").applyInPandas(deal, "turn int, s double, xx double, yy double, n long")
    if not wide.isEmpty():
        sums = sums.unionByName(_deal_wide(ranked.join(F.broadcast(wide), "_w", "left_semi"), iters, seed))
    out = sums.groupBy("turn").agg(*(F.sum(c).alias(c) for c in ("s", "xx", "yy", "n")))
    varied = (F.col("n") >= 3) & (F.col("xx") > 0) & (F.col("yy") > 0)
    return out.select("turn", F.when(varied, F.col("s") / (F.sqrt("xx") * F.sqrt("yy"))).alias("ic"), "n")


def _deal_wide(rows: DataFrame, iters: int, seed: int) -> DataFrame:
    """Sums per turn as in within_window_placebo(), of windows that no task should hold. Turns are ranked within buckets of the hash, whose sizes
    give the places; only the order by key sorts a whole window in one task, once and on disk where memory ends."""
    order = ["_k", "_x", "_y"]
    places = rows.select("_w", F.col("_y").alias("_to"), (F.row_number().over(Window.partitionBy("_w").orderBy(*order)) - 1).alias("_p"))
    turns = F.explode(F.sequence(F.lit(1), F.lit(iters))) if iters > 0 else F.explode(F.array().cast("array<int>"))
    dealt = rows.withColumn("turn", turns).withColumn("_g", F.xxhash64("_k", "turn", F.lit(seed))).withColumn("_b", F.shiftright("_g", 54))
    sizes = dealt.groupBy("turn", "_w", "_b").agg(F.count("*").alias("_c"))
    sizes = sizes.withColumn("_o", F.sum("_c").over(Window.partitionBy("turn", "_w").orderBy("_b")) - F.col("_c")).drop("_c")
    within = F.row_number().over(Window.partitionBy("turn", "_w", "_b").orderBy("_g", *order)) - 1
    dealt = dealt.withColumn("_i", within).join(sizes.hint("merge"), ["turn", "_w", "_b"]).withColumn("_p", F.col("_o") + F.col("_i")).select("turn", "_w", "_p", "_x")
    pairs = dealt.join(places.hint("merge"), ["_w", "_p"]).select("turn", "_x", F.col("_to").alias("_y"))
    pairs = pairs.unionByName(rows.select(F.lit(0).alias("turn"), "_x", "_y"))
    square = lambda c: F.sum(F.col(c) * F.col(c))
    return pairs.groupBy("turn").agg(F.sum(F.col("_x") * F.col("_y")).alias("s"), square("_x").alias("xx"), square("_y").alias("yy"), F.count("*").alias("n"))


def robustness_grid(events: DataFrame, panel: DataFrame, key: str, horizons: list[int], features: list[str], run, least: int = 50) -> DataFrame:
    """(horizon, feature, status, n_events, sharpe, n_days) of run(events, panel, horizon, feature), which gives a daily series
    (date, net), over all pairs; no pair is dropped: status is ok, no_column or few_events."""
    out = []
    for h in horizons:
        for f in features:
            if f not in events.columns:
                out.append((h, f, "no_column", 0, None, None))
                continue
            own = events.dropna(subset=[f])
            n = own.count()
            if n < least:
                out.append((h, f, "few_events", n, None, None))
                continue
            row = run(own, panel, h, f).agg(stats.sharpe("net").alias("s"), F.count("net").alias("d")).first()
            out.append((h, f, "ok", n, row["s"], row["d"]))
    return events.sparkSession.createDataFrame(out, "horizon int, feature string, status string, n_events long, sharpe double, n_days long")


def ranked_strategy(events: DataFrame, panel: DataFrame, key: str, day: str, signal: str, hold: int = 63, top: float = 0.2, direction: int = 1, days: int = 90, history: int = 20, cap: float = 0.1, bps: float = 5.0, variant: str = "long_short") -> DataFrame:
    """Percentile, sides, tranches and the calendar portfolio in one: events (key, day, signal) on a panel (key, pos, date, open,
    close). Each event enters on its day, which must be one of its key's."""
    from cairn.operators import windows

    ranked = windows.midrank(events, day, signal, "_pct", days, history).withColumn("side", windows.side("_pct", top, direction)).filter("side != 0")
    placed = ranked.join(panel.select(key, F.col("date").alias(day), "pos"), [key, day]).select(key, F.col(day).alias("date"), "pos", "side")
    return calendar_portfolio(tranches(placed, panel, key, hold, cap), panel.select("date"), bps, variant)
