"""Coverage and quality tables, reason codes and audits of stored columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions import stats


def coverage(calls: DataFrame, by: str, other: str | None = None) -> DataFrame:
    """Calls per value of `by`, with distinct values of `other`, else first and last year."""
    if other:
        return calls.groupBy(by).agg(F.count("*").alias("n_calls"), F.countDistinct(other).alias(f"n_{other}"))
    return calls.groupBy(by).agg(F.count("*").alias("n_calls"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def presence(calls: DataFrame, names: list[str], column: str = "ticker") -> DataFrame:
    """A row per name of a fixed list: whether calls have it, how many, first and last year."""
    listed = calls.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], f"{column} string")
    found = coverage(calls.filter(F.col(column).isin(names)), column)
    return listed.join(found, column, "left").select(column, F.col("n_calls").isNotNull().alias("present"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), "first_year", "last_year")


def layer_summary(universe: DataFrame, flags: list[str], layer: str = "layer") -> DataFrame:
    """Per layer the number of candidates and of those with each flag."""
    return universe.groupBy(layer).agg(F.count("*").alias("n_candidates"), *(F.count_if(F.col(f)).alias(f"n_{f}") for f in flags))


def vertical(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(metric, value) of aggregates, all from one pass, in their order."""
    row = df.agg(*(c.cast("double").alias(f"m{i}") for i, c in enumerate(metrics.values())))
    pairs = ", ".join(f"{i}, m{i}" for i in range(len(metrics)))
    names = F.array(*map(F.lit, metrics))
    return row.select(F.expr(f"stack({len(metrics)}, {pairs}) as (i, value)")).select(F.get(names, "i").alias("metric"), "value")


def reason(df: DataFrame, signal: str, raw: str, decided: str, confounders: list[str], name: str = "reason") -> DataFrame:
    """Why a call has no signal: classified, no_distance, no_decision, missing:<columns>, else short_history."""
    lacking = F.concat_ws(",", *(F.when(F.col(c).isNull(), c) for c in confounders))
    code = F.when(F.col(signal).isNotNull(), "classified").when(F.col(raw).isNull(), "no_distance").when(F.col(decided).isNull(), "no_decision").when(lacking != "", F.concat(F.lit("missing:"), lacking)).otherwise("short_history")
    return df.withColumn(name, code)


def call_blocks(calls: DataFrame, universe: DataFrame, borderline: list[str]) -> DataFrame:
    """Adds block (that of the universe, else core_borderline or core), in_strict and in_core."""
    own = universe.select("ticker", "sensitivity_block").distinct()
    block = F.when(F.trim(F.coalesce("sensitivity_block", F.lit(""))) != "", F.col("sensitivity_block")).when(F.col("ticker").isin(borderline), "core_borderline").otherwise("core")
    out = calls.join(own, "ticker", "left").withColumn("block", block).drop("sensitivity_block")
    return out.withColumn("in_strict", F.col("block").isin("core", "core_borderline")).withColumn("in_core", F.col("block") == "core")


def review(df: DataFrame, sector: str, industry: str, sectors: list[str], industries: list[str], name: str = "verdict") -> DataFrame:
    """by_sector, by_industry, delisted where no sector is known, else other:<sector>."""
    code = F.when(F.col(sector).isin(sectors), "by_sector").when(F.col(industry).isin(industries), "by_industry").when(F.col(sector).isNull(), "delisted").otherwise(F.concat(F.lit("other:"), sector))
    return df.withColumn(name, code)


def compare_columns(stored: DataFrame, again: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A row per column of both tables: rows, those only in one, correlation, greatest difference, rows where just one is null."""
    left = stored.select(*keys, F.lit(True).alias("_l"), *(F.col(c).cast("double").alias(f"_a{i}") for i, c in enumerate(columns)))
    right = again.select(*keys, F.lit(True).alias("_r"), *(F.col(c).cast("double").alias(f"_b{i}") for i, c in enumerate(columns)))
    both = left.join(right, keys, "full")
    row = both.agg(
        F.count(F.when(F.col("_l") & F.col("_r"), 1)).alias("n"),
        F.count(F.when(F.col("_l").isNull() | F.col("_r").isNull(), 1)).alias("alone"),
        *(a for i in range(len(columns)) for a in (
            F.corr(f"_a{i}", f"_b{i}").alias(f"c{i}"),
            F.max(F.abs(F.col(f"_a{i}") - F.col(f"_b{i}"))).alias(f"d{i}"),
            F.count(F.when(F.col("_l") & F.col("_r") & (F.col(f"_a{i}").isNull() != F.col(f"_b{i}").isNull()), 1)).alias(f"u{i}"),
        )),
    )
    parts = [F.struct(F.lit(c).alias("column"), "n", "alone", F.col(f"c{i}").alias("corr"), F.col(f"d{i}").alias("max_diff"), F.col(f"u{i}").alias("one_null")) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def saturation(scores: DataFrame, column: str, low: float = 0.01, high: float = 0.99, inner: float = 0.05) -> DataFrame:
    """Shares of values under low, over high, and between inner and 1 - inner."""
    x = F.col(column)
    share = lambda test: F.avg(test.cast("double"))
    return scores.agg(F.count(x).alias("n"), share(x < low).alias("low"), share(x > high).alias("high"), share((x > inner) & (x < 1 - inner)).alias("middle"))


def survivors(points: DataFrame, group: str, weight: str, thresholds: list[float], least: int = 2) -> DataFrame:
    """(threshold, groups): groups that keep `least` entities of at least that weight. One count per group, then per threshold."""
    per = points.groupBy(group).agg(*(F.count_if(F.col(weight) >= t).alias(f"n{i}") for i, t in enumerate(thresholds)))
    row = per.agg(*(F.count_if(F.col(f"n{i}") >= least).alias(f"n{i}") for i in range(len(thresholds))))
    return row.select(F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("groups")) for i, t in enumerate(thresholds)))).alias("x")).select("x.*")


def volume_bias(distances: DataFrame, value: str, others: list[str]) -> DataFrame:
    """(other, corr): correlation of a measure with each of other columns, nulls left out pair by pair."""
    row = distances.agg(*(F.corr(value, o).alias(f"c{i}") for i, o in enumerate(others)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(o).alias("other"), F.col(f"c{i}").alias("corr")) for i, o in enumerate(others)))).alias("x")).select("x.*")


def backlog(eligible: DataFrame, done: DataFrame, keys: list[str]) -> int:
    """How many eligible keys are not done."""
    return eligible.select(*keys).distinct().join(done.select(*keys), keys, "left_anti").count()


def scorer_agreement(a: DataFrame, b: DataFrame, keys: list[str], parts: tuple[str, ...] = ("p_neg", "p_neu", "p_pos")) -> DataFrame:
    """One row on two scorers of the same rows: n, correlation, mean and greatest difference of the last part, share of equal labels."""
    both = a.select(*keys, *(F.col(p).alias(f"_a_{p}") for p in parts)).join(b.select(*keys, *(F.col(p).alias(f"_b_{p}") for p in parts)), keys)
    best = lambda side: F.array_position(F.array(*(F.col(f"_{side}_{p}") for p in parts)), F.greatest(*(F.col(f"_{side}_{p}") for p in parts)))
    gap = F.abs(F.col(f"_a_{parts[-1]}") - F.col(f"_b_{parts[-1]}"))
    return both.agg(F.count("*").alias("n"), F.corr(f"_a_{parts[-1]}", f"_b_{parts[-1]}").alias("corr"), F.avg(gap).alias("mean_diff"), F.max(gap).alias("max_diff"), F.avg((best("a") == best("b")).cast("double")).alias("same_label"))


def assert_selected_before(selected: DataFrame, known: str, held: str) -> DataFrame:
    """selected, if every signal was known before the month it is held in; month numbers or dates."""
    from cairn.functions import times

    return times.assert_no_lookahead(selected, held, known)


def run_summary(df: DataFrame, value: str, date: str) -> DataFrame:
    """One row about a stage's output: rows, rows with a value, first and last day, mean and median of the value."""
    q = stats.quantiles(df, {value: [0.5]})[value][0]
    return df.agg(F.count("*").alias("rows"), F.count(value).alias("with_value"), F.min(date).alias("first"), F.max(date).alias("last"), F.avg(value).alias("mean"), F.lit(q).cast("double").alias("median"))


def annual_pivot(daily: DataFrame, series: str, day: str, ret: str) -> DataFrame:
    """Compounded return per year, a column for each of the series' names."""
    names = sorted(r[0] for r in daily.select(series).distinct().collect())  # portfolios
    return daily.groupBy(F.year(day).alias("year")).pivot(series, names).agg(F.product(1 + F.col(ret)) - 1)


def share_of(column: str, *by: str) -> Column:
    """A row's part of the sum in its group."""
    return F.try_divide(F.col(column), F.sum(column).over(Window.partitionBy(*by)))
