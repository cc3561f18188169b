"""Joins in time: as-of, nearest, range, bitemporal, fan-out, and row positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Days of a bucket of time: a key's rows are dealt to tasks by bucket, and what came before a bucket is one row per bucket.
BUCKET_DAYS = 128


def _bucketed(events: DataFrame, panel: DataFrame, by: list[str], time: str, held: list[Column], days: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Events with and without a time as (by, _t, _b, _e, nulls of held), the panel's rows below the first, and events' own columns."""
    own = [c for c in events.columns if c not in by]
    tick = F.unix_micros(F.col(time).cast("timestamp"))
    right = panel.select(*by, tick.alias("_t"), *held).filter("_t is not null")
    names = right.columns[len(by) + 1 :]
    kinds = dict(right.dtypes)
    left = events.select(*by, tick.alias("_t"), F.struct(*own).alias("_e"), *(F.lit(None).cast(kinds[n]).alias(n) for n in names))
    both = left.filter("_t is not null").unionByName(right.withColumn("_e", F.lit(None).cast(left.schema["_e"].dataType)))
    return both.withColumn("_b", F.floor(F.col("_t") / F.lit(days * 86_400_000_000))), left.filter("_t is null"), own


def asof_backward(events: DataFrame, panel: DataFrame, by: list[str], time: str, values: list[str], strict: bool = True, days: int = BUCKET_DAYS) -> DataFrame:
    """events with the panel's last non-null `values` before (strict) or not after each event's time, per `by`.

    Both sides are one table, dealt by key and bucket of time, so that a hot key is many tasks. Within a bucket a running last is
    kept; the last of earlier buckets comes from a table of one row per key and bucket. Events without time or match get nulls.
    Several panel rows of one instant give the greatest. time is a date or timestamp."""
    held = [F.col(v).alias(f"_v_{v}") for v in values]
    both, timeless, own = _bucketed(events, panel, by, time, held, days)
    ends = both.groupBy(*by, "_b").agg(*(F.max(F.when(F.col(f"_v_{v}").isNotNull(), F.struct("_t", f"_v_{v}"))).alias(f"_l_{v}") for v in values))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_b", *(F.max(f"_l_{v}").over(before)[f"_v_{v}"].alias(f"_c_{v}") for v in values))
    upto = Window.partitionBy(*by, "_b").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    latest = {v: F.max(F.when(F.col(f"_v_{v}").isNotNull(), F.struct("_t", f"_v_{v}"))).over(upto)[f"_v_{v}"] for v in values}
    found = both.withColumns({f"_f_{v}": c for v, c in latest.items()}).filter("_e is not null")
    found = found.join(ends, [*by, "_b"], "left").select(*by, "_e", *(F.coalesce(f"_f_{v}", f"_c_{v}").alias(v) for v in values))
    found = found.unionByName(timeless.select(*by, "_e", *(F.col(f"_v_{v}").alias(v) for v in values)))
    return found.select(*by, *(F.col("_e")[c].alias(c) for c in own), *values).select(*events.columns, *values)


def asof_forward(events: DataFrame, panel: DataFrame, by: list[str], time: str, name: str, days: int = BUCKET_DAYS) -> DataFrame:
    """events with `name`: the panel's first time at or after each event's, per `by`; null beyond its end. Dealt like asof_backward."""
    both, timeless, own = _bucketed(events, panel, by, time, [F.col(time).alias("_p")], days)
    after = Window.partitionBy(*by).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    firsts = both.groupBy(*by, "_b").agg(F.min("_p").alias("_l")).select(*by, "_b", F.min("_l").over(after).alias("_c"))
    ahead = Window.partitionBy(*by, "_b").orderBy("_t").rangeBetween(0, Window.unboundedFollowing)
    found = both.withColumn("_f", F.min("_p").over(ahead)).filter("_e is not null")
    found = found.join(firsts, [*by, "_b"], "left").select(*by, "_e", F.coalesce("_f", "_c").alias(name))
    found = found.unionByName(timeless.select(*by, "_e", F.col("_p").alias(name)))
    return found.select(*by, *(F.col("_e")[c].alias(c) for c in own), name).select(*events.columns, name)


def asof_or_first(events: DataFrame, panel: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """As-of, inclusive; before the panel's start its first value, with extrapolated true."""
    first = panel.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(value, time).alias("_first"))
    out = asof_backward(events, panel, by, time, [value], strict=False).join(first, by, "left")
    return out.withColumn("extrapolated", F.col(value).isNull() & F.col("_first").isNotNull()).withColumn(value, F.coalesce(value, "_first")).drop("_first")


def nearest(events: DataFrame, facts: DataFrame, by: list[str], time: str, fact_time: str, values: list[str], days: int = 3, bucket: int = BUCKET_DAYS) -> DataFrame:
    """events with the values of the fact nearest in days, at most `days` away, the earlier of equals; of a day's facts the first.

    One union, dealt by key and bucket of days: the last fact up to a day and the first from it on lie in a window of `days`. Only
    facts within `days` of a bucket's edge go to two."""
    day = lambda c: F.unix_date(F.to_date(c))
    own = [c for c in events.columns if c not in by]
    daily = facts.select(*by, day(fact_time).alias("_d"), F.struct(fact_time, *values).alias("_s")).filter("_d is not null").groupBy(*by, "_d").agg(F.min("_s").alias("_s"))
    slot = lambda d: F.floor(d / bucket)
    right = daily.withColumn("_b", F.explode(F.array_distinct(F.array(slot(F.col("_d") - days), slot(F.col("_d") + days)))))
    left = events.select(*by, day(time).alias("_d"), F.struct(*own).alias("_e"))
    both = left.withColumn("_b", slot(F.col("_d"))).withColumn("_s", F.lit(None).cast(right.schema["_s"].dataType)).unionByName(right.withColumn("_e", F.lit(None).cast(left.schema["_e"].dataType)))
    w = Window.partitionBy(*by, "_b").orderBy("_d")
    fact = F.when(F.col("_s").isNotNull(), F.struct("_d", "_s"))
    both = both.withColumn("_p", F.max(fact).over(w.rangeBetween(-days, 0))).withColumn("_n", F.min(fact).over(w.rangeBetween(0, days))).filter("_e is not null")
    closer = F.col("_n")["_d"] - F.col("_d") < F.col("_d") - F.col("_p")["_d"]
    both = both.withColumn("_f", F.when(F.col("_p").isNull() | closer, F.col("_n")).otherwise(F.col("_p"))["_s"])
    return both.select(*by, *(F.col("_e")[c].alias(c) for c in own), "_f").select(*events.columns, F.col("_f")[fact_time].alias(fact_time), *(F.col("_f")[v].alias(v) for v in values))


def range_lookup(df: DataFrame, column: str, ranges: list[tuple[int, int, str]], other: str = "Other") -> Column:
    """The name of the first range (low, high, name) that holds the column; null stays null. Ranges are a fixed table."""
    out = F.lit(other)
    for low, high, name in reversed(ranges):
        out = F.when(F.col(column).between(low, high), name).otherwise(out)
    return F.when(F.col(column).isNotNull(), out)


def known_at(events: DataFrame, facts: DataFrame, by: list[str], time: str, filed: str, end: str, value: str) -> DataFrame:
    """The value of the latest period `end` among facts filed strictly before each event: a running maximum over filings."""
    facts = facts.withColumn("_best", F.max(F.struct(end, filed, value)).over(Window.partitionBy(*by).orderBy(filed).rowsBetween(Window.unboundedPreceding, 0)))
    panel = facts.select(*by, F.col(filed).alias(time), F.struct(F.col("_best")[end].alias("end"), F.col("_best")[value].alias("value")).alias("_b"))
    out = asof_backward(events, panel, by, time, ["_b"])
    return out.withColumn(value, F.col("_b")["value"]).withColumn("period_end", F.col("_b")["end"]).drop("_b")


def fan_out_latest(signals: DataFrame, by: str, month: str, order: str, ahead: int = 3) -> DataFrame:
    """Each signal holds for the next `ahead` months; per key and month the latest counts. Adds ym."""
    wide = signals.withColumn("_gap", F.explode(F.sequence(F.lit(1), F.lit(ahead)))).withColumn("ym", F.col(month) + F.col("_gap"))
    last = Window.partitionBy(by, "ym").orderBy(F.desc(order), F.asc("_gap"))
    return wide.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "_gap")


def with_position(panel: DataFrame, key: str, time: str) -> DataFrame:
    return panel.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(time)) - 1)


def forward_returns(panel: DataFrame, key: str, time: str, opens: str, close: str, horizons: list[int]) -> DataFrame:
    """Entry at the open of each row, exit at the close h - 1 rows on: ret_h, null beyond the end or without a positive open."""
    w = Window.partitionBy(key).orderBy(time)
    good = F.when(F.col(opens) > 0, F.col(opens))
    return panel.withColumns({f"ret_{h}": F.lead(close, h - 1).over(w) / good - 1 for h in horizons})


def on_calendar(series: DataFrame, calendar: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """A row for each day of the calendar; days without a position are 0."""
    return calendar.select(time).distinct().join(series, time, "left").fillna(0, subset=columns)


def pair_answers(turns: DataFrame, call: str, order: str, role: str, asks: str = "analyst", answers: str = "management") -> DataFrame:
    """block: the number of the question that a turn asks or answers, 0 before the first."""
    w = Window.partitionBy(call).orderBy(order)
    main = turns.filter(F.col(role).isin(asks, answers))
    new = (F.col(role) == asks) & (F.coalesce(F.lag(role).over(w), F.lit("")) != asks)
    return main.withColumn("_n", new.cast("int")).withColumn("block", F.sum("_n").over(w)).drop("_n")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, fallback: Column | None = None) -> DataFrame:
    """df with a dimension table's value by key, else the fallback. Of several rows of a key the least value counts; Spark
    broadcasts the table where its size allows."""
    one = table.groupBy(key).agg(F.min(value).alias("_found"))
    out = df.join(one, key, "left")
    return out.withColumn(value, F.coalesce("_found", fallback) if fallback is not None else F.col("_found")).drop("_found")


def aligned(series: dict[str, DataFrame], time: str, ret: str, how: str = "inner") -> DataFrame:
    """Series (time, ret) side by side, a column for each name."""
    out = None
    for name, df in series.items():
        one = df.select(time, F.col(ret).alias(name))
        out = one if out is None else out.join(one, time, how)
    return out


def event_anchor(events: DataFrame, panel: DataFrame, by: list[str], time: str, has_time: str, closes: int = 16 * 3600) -> DataFrame:
    """events with pos, the row of the panel (by, date, pos) that first knows of them: the first session from the day on, and the
    one after it if the day is a session and the time, where there is one, at or after the close (in seconds). Null beyond the end."""
    days = panel.select(*by, F.col("date").alias("_day"))
    found = asof_forward(events.withColumn("_day", F.to_date(time)), days, by, "_day", "_first")
    found = found.join(panel.select(*by, F.col("date").alias("_first"), F.col("pos").alias("_pos")), [*by, "_first"], "left")
    late = F.coalesce(F.col(has_time), F.lit(False)) & (F.col("_first") == F.col("_day")) & (F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time) >= closes)
    return found.withColumn("pos", F.col("_pos") + F.coalesce(late, F.lit(False)).cast("int")).select(*events.columns, "pos")


def completed(events: DataFrame, time: str, horizon_days: int, cut) -> DataFrame:
    """Events whose outcome is known by a cut."""
    return events.filter(F.date_add(F.to_date(time), horizon_days) <= F.lit(cut))
