"""Point-in-time windows: a row never sees its own instant or later ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def lag_delta(df: DataFrame, key: str, time: str, value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(time)))


def past_mean(df: DataFrame, key: str, order: list[str], value: str, name: str, rows: int | None = None, least: int = 1) -> DataFrame:
    """Mean of the last `rows` (or all) strictly earlier rows, null under `least` values."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding if rows is None else -rows, -1)
    return df.withColumn(name, F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def full_mean(df: DataFrame, key: str, order: str, value: str, rows: int, name: str) -> DataFrame:
    """Mean of the last `rows` rows with this one; null until there are so many."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - rows, 0)
    return df.withColumn(name, F.when(F.count(value).over(w) == rows, F.avg(value).over(w)))


def peer_mean(df: DataFrame, key: str, day: str, value: str, name: str, days: int = 90, least: int = 3, by: list[str] | None = None) -> DataFrame:
    """Mean of other keys' values in [day - days, day), null under `least` of them.

    Sums per day first, so the window over all keys runs on one row per day (and group), not over the facts."""
    by = by or []
    d = F.unix_date(F.to_date(day))
    rows = df.withColumn("_d", d)
    daily = rows.groupBy(*by, "_d").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    all_w = Window.partitionBy(*by).orderBy("_d").rangeBetween(-days, -1)
    total = daily.select(*by, "_d", F.sum("_s").over(all_w).alias("_s"), F.sum("_n").over(all_w).alias("_n"))
    own_daily = rows.groupBy(*by, key, "_d").agg(F.sum(value).alias("_os"), F.count(value).alias("_on"))
    own_w = Window.partitionBy(*by, key).orderBy("_d").rangeBetween(-days, -1)
    own = own_daily.select(*by, key, "_d", F.sum("_os").over(own_w).alias("_os"), F.sum("_on").over(own_w).alias("_on"))
    out = rows.join(total, [*by, "_d"], "left").join(own, [*by, key, "_d"], "left")
    n = F.coalesce("_n", F.lit(0)) - F.coalesce("_on", F.lit(0))
    s = F.coalesce("_s", F.lit(0.0)) - F.coalesce("_os", F.lit(0.0))
    return out.withColumn(name, F.when(n >= least, F.try_divide(s, n))).select(*df.columns, name)


def leave_one_out(df: DataFrame, by: list[str], value: str, name: str, least: int = 3) -> DataFrame:
    w = Window.partitionBy(*by)
    n = F.count(value).over(w) - F.when(F.col(value).isNotNull(), 1).otherwise(0)
    return df.withColumn(name, F.when(n >= least, F.try_divide(F.sum(value).over(w) - F.coalesce(value, F.lit(0.0)), n)))


#: Rows that midrank() aims at in one range of values.
RANGE_ROWS = 20_000


def midrank(df: DataFrame, day: str, value: str, name: str, days: int = 90, least: int = 20) -> DataFrame:
    """(less + half of equal) / n over values in [day - days, day), null under `least`.

    Equal values of a day are counted first. Values are cut into ranges and time into shards of `days`: what lies in lower ranges is
    a sum over a table of days by ranges, and a task ranks one range within one shard and the one before it. So a task's rows are
    bounded by the range's, a hot value is a row per day, and a result belongs to a day and value, not to a row."""
    good = df.select(F.unix_date(F.to_date(day)).alias("_d"), F.col(value).cast("double").alias("_v")).filter("_d is not null and _v is not null and not isnan(_v)")
    counts = good.groupBy("_d", "_v").agg(F.count("*").alias("_n"))
    n = good.count()
    parts = max(1, min(4096, n // RANGE_ROWS))
    edges = sorted(set(good.agg(F.percentile_approx("_v", F.array(*(F.lit(i / parts) for i in range(1, parts))), 10 * parts)).first()[0])) if parts > 1 and n else []
    place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("_v"))) if edges else F.lit(0)
    counts = counts.withColumn("_r", place.cast("int"))
    # Per day and range: values in lower ranges, then over the window of days before.
    cells = counts.groupBy("_d", "_r").agg(F.sum("_n").alias("_m"))
    grid = cells.select("_d").distinct().withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(len(edges))))).join(cells, ["_d", "_r"], "left").fillna(0, ["_m"])
    below = F.sum("_m").over(Window.partitionBy("_d").orderBy("_r")) - F.col("_m")
    grid = grid.withColumn("_low", below).withColumn("_all", F.sum("_m").over(Window.partitionBy("_d")))
    past = Window.partitionBy("_r").orderBy("_d").rangeBetween(-days, -1)
    grid = grid.select("_d", "_r", F.sum("_low").over(past).alias("_low"), F.sum("_all").over(past).alias("_all"))

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_d", kind="stable")
        d, n, own = pdf["_d"].to_numpy(), pdf["_n"].to_numpy(), pdf["_own"].to_numpy(bool)
        values, at = np.unique(pdf["_v"].to_numpy(), return_inverse=True)
        held = np.zeros(len(values) + 1, np.int64)
        twice = np.zeros(len(d))
        add = cut = 0
        starts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        for a, z in zip(starts, np.append(starts[1:], len(d))):
            if not own[a]:
                continue
            while add < a:
                held[at[add] + 1] += n[add]
                add += 1
            while cut < add and d[cut] < d[a] - days:
                held[at[cut] + 1] -= n[cut]
                cut += 1
            upto = np.cumsum(held)
            twice[a:z] = upto[at[a:z]] + upto[at[a:z] + 1]
        return pd.DataFrame({"_d": d, "_v": pdf["_v"].to_numpy(), "_r": pdf["_r"].to_numpy(), "_twice": twice})[own]

    shard = F.floor(F.col("_d") / days)
    dealt = counts.withColumn("_s", shard).withColumn("_own", F.lit(True)).unionByName(counts.withColumn("_s", shard + 1).withColumn("_own", F.lit(False)))
    ranks = dealt.groupBy("_r", "_s").applyInPandas(rank, "_d int, _v double, _r int, _twice double")
    ranks = ranks.join(grid.filter(F.col("_all") >= least), ["_d", "_r"]).select("_d", "_v", ((F.col("_low") + F.col("_twice") / 2) / F.col("_all")).alias(name))
    rows = df.withColumn("_d", F.unix_date(F.to_date(day))).withColumn("_v", F.col(value).cast("double"))
    return rows.drop(*({name} & set(df.columns))).join(ranks, ["_d", "_v"], "left").select(*(c for c in df.columns if c != name), name)


def side(percent: str, top: float = 0.2, direction: int = 1):
    """+1 above the top zone's edge, -1 under the bottom's (which wins where they touch), else 0; null without a percentile."""
    p = F.col(percent)
    return F.when(p.isNull(), None).when(p <= top, -direction).when(p >= 1 - top, direction).otherwise(0)


def _own_history(df: DataFrame, key: str, order: list[str], value: str, name: str, kind: str, of) -> DataFrame:
    """Adds of(sorted earlier values, value) per row of a key; a key's rows are one sweep."""
    from bisect import insort

    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        held: list[float] = []
        out = []
        for v in pdf[value].astype(float):
            out.append(None if v != v else of(held, v))
            if v == v:
                insort(held, v)
        return pdf.assign(**{name: pd.Series(out, index=pdf.index, dtype=object)})

    schema = StructType([f for f in df.schema if f.name != name] + [StructField(name, _parse_datatype_string(kind))])
    return df.drop(*({name} & set(df.columns))).groupBy(key).applyInPandas(sweep, schema)


def past_median_split(df: DataFrame, key: str, order: list[str], value: str, name: str, least: int = 4) -> DataFrame:
    """high or low against the median of a key's own earlier values, null under `least` of them."""

    def split(held: list[float], v: float):
        n = len(held)
        return None if n < least else "high" if v > (held[(n - 1) // 2] + held[n // 2]) / 2 else "low"

    return _own_history(df, key, order, value, name, "string", split)


def own_midrank(df: DataFrame, key: str, order: list[str], value: str, name: str, least: int = 6) -> DataFrame:
    """(less + half of equal) / n among a key's own earlier values, null under `least` of them."""
    from bisect import bisect_left, bisect_right

    def rank(held: list[float], v: float):
        return None if len(held) < least else (bisect_left(held, v) + bisect_right(held, v)) / 2 / len(held)

    return _own_history(df, key, order, value, name, "double", rank)


def daily_returns(panel: DataFrame, key: str, time: str, close: str = "close", volume: str | None = "volume", name: str = "ret") -> DataFrame:
    """Simple returns from one row to the next and, with volume, dollar_volume. A missing close takes the one before it, so its
    return is 0; the first is null."""
    w = Window.partitionBy(key).orderBy(time)
    filled = panel.withColumn("_c", F.last(close, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = filled.withColumn(name, F.try_divide("_c", F.lag("_c").over(w)) - 1).drop("_c")
    return out.withColumn("dollar_volume", F.col(close) * F.col(volume)) if volume else out


def lag_value(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(key).orderBy(*order)))


def next_within(df: DataFrame, key: str, time: str, value: str, name: str, low: int = 30, high: int = 200, order: list[str] | None = None) -> DataFrame:
    """The next row's value if it comes `low` to `high` days later; rows go by `order`, which is the time unless given."""
    w = Window.partitionBy(key).orderBy(*(order or [time]))
    gap = F.datediff(F.lead(time).over(w), F.col(time))
    return df.withColumn(name, F.when(gap.between(low, high), F.lead(value).over(w)))


def monthly_momentum(monthly: DataFrame, key: str, ym: str, ret: str) -> DataFrame:
    """momentum over the months m - 12 to m - 2, all eleven of them, and reversal, the return of m - 1. monthly has a row per
    key and month number; a month without a row is missing."""
    w = Window.partitionBy(key).orderBy(ym)
    far = w.rangeBetween(-12, -2)
    return monthly.withColumns({
        "momentum": F.when(F.count(ret).over(far) == 11, F.exp(F.sum(F.log1p(ret)).over(far)) - 1),
        "reversal": F.max(ret).over(w.rangeBetween(-1, -1)),
    })


def echo_volatility(panel: DataFrame, key: str, time: str, ret: str) -> DataFrame:
    """Population deviations of returns over rows +1 to +20 (15 of them at least) and +1 to +120 (90), and the mean absolute return
    of rows +1 and +2, for rows that have 121 more."""
    w = Window.partitionBy(key).orderBy(time)
    whole = F.lead(F.lit(1), 121).over(w).isNotNull()

    def deviation(last: int, least: int):
        f = w.rowsBetween(1, last)
        return F.when(whole & (F.count(ret).over(f) >= least), F.stddev_pop(ret).over(f))

    two = w.rowsBetween(1, 2)
    return panel.withColumns({"vol_20": deviation(20, 15), "vol_120": deviation(120, 90), "echo": F.when(whole & (F.count(ret).over(two) == 2), F.avg(F.abs(ret)).over(two))})


def trailing_flows(events: DataFrame, facts: DataFrame, by: list[str], event: str, time: str, filed: str, end: str, value: str) -> DataFrame:
    """Per event the flows filed strictly before it, by period: last, sum_4 (of the last four, or as many as there are), n, and
    std_16 (sample deviation of the last 16, from 8 on). event is the events' key."""
    known = events.join(facts.select(*by, filed, end, value), by).filter(F.col(filed) < F.col(time))
    place = F.row_number().over(Window.partitionBy(event).orderBy(F.desc(end), F.desc(filed)))
    known = known.withColumn("_r", place).filter("_r <= 17")
    upto = lambda k: F.when(F.col("_r") <= k, F.col(value))
    sums = known.groupBy(event).agg(
        F.max(upto(1)).alias("last"), F.sum(upto(4)).alias("sum_4"), F.count(value).alias("n"), F.when(F.count(value) >= 8, F.stddev_samp(upto(16))).alias("std_16")
    )
    return events.join(sums, event, "left")


def future_flows(events: DataFrame, facts: DataFrame, by: list[str], event: str, time: str, end: str, value: str, k: int = 4) -> DataFrame:
    """Per event the sample deviation of the next k periods that end after it, null with fewer."""
    ahead = events.join(facts.select(*by, end, value), by).filter(F.col(end) > F.col(time))
    ahead = ahead.withColumn("_r", F.row_number().over(Window.partitionBy(event).orderBy(end))).filter(F.col("_r") <= k)
    out = ahead.groupBy(event).agg(F.when(F.count(value) == k, F.stddev_samp(value)).alias("future_std"))
    return events.join(out, event, "left")


def market_controls(panel: DataFrame, key: str, time: str, close: str, dollars: str) -> DataFrame:
    """Momentum from 252 to 21 rows back, reversal from 21 to 1, log median of the last 60 dollar volumes: all before the row."""
    w = Window.partitionBy(key).orderBy(time)
    before = w.rowsBetween(-60, -1)
    return panel.withColumns({
        "momentum": F.try_divide(F.lag(close, 21).over(w), F.lag(close, 252).over(w)) - 1,
        "reversal": F.try_divide(F.lag(close, 1).over(w), F.lag(close, 21).over(w)) - 1,
        "log_volume": F.when(F.count(dollars).over(before) > 0, F.ln(F.percentile(dollars, F.lit(0.5)).over(before))),
    })


def realised_volatility(panel: DataFrame, key: str, time: str, ret: str, first: int, last: int, least: int, name: str) -> DataFrame:
    """Population deviation of returns from row `first` to row `last` after each row."""
    w = Window.partitionBy(key).orderBy(time).rowsBetween(first, last)
    return panel.withColumn(name, F.when(F.count(ret).over(w) >= least, F.stddev_pop(ret).over(w)))


def set_turnover(sets: DataFrame, order: str, members: str, size: int, name: str = "turnover") -> DataFrame:
    """Share of a period's members that the period before did not hold; the first period is all new. sets has a row per period."""
    last = F.lag(members).over(Window.orderBy(order))
    return sets.withColumn(name, F.when(last.isNull(), 1.0).otherwise(F.size(F.array_except(members, last)) / size))


def quarterly_from_year_to_date(facts: DataFrame, by: list[str], start: str, end: str, filed: str, value: str) -> DataFrame:
    """Periods of 70 to 100 days: those reported, and differences of one year's running totals, filed with the later of the pair.
    A reported period goes before a derived one."""
    w = Window.partitionBy(*by, start).orderBy(end)
    derived = facts.withColumn("_v", F.col(value) - F.lag(value).over(w)).withColumn("_s", F.lag(end).over(w)).withColumn("_f", F.greatest(filed, F.lag(filed).over(w)))
    derived = derived.filter(F.datediff(end, "_s").between(70, 100)).select(*by, end, F.col("_f").alias(filed), F.col("_v").alias(value), F.lit(1).alias("_o"))
    direct = facts.filter(F.datediff(end, start).between(70, 100)).select(*by, end, filed, value, F.lit(0).alias("_o"))
    both = direct.unionByName(derived)
    first = Window.partitionBy(*by, end).orderBy("_o", filed, value)
    return both.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r", "_o")
