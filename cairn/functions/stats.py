"""Statistics: column expressions over groups, and driver-side formulas on their few results."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*(F.nanvl(c, F.lit(None)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns))


def weighted_mean(value: str, weight: str) -> Column:
    """Null without rows of both and at zero weight."""
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    return F.try_divide(F.sum(F.when(both, F.col(value) * F.col(weight))), F.sum(F.when(both, F.col(weight))))


def js_distance(p: list[Column], q: list[Column]) -> Column:
    """Jensen-Shannon distance to base 2; null unless both sum to 1 within 1e-6."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    total = F.lit(0.0)
    for a, b in zip(p, q):
        m = (a + b) / 2
        total = total + (part(a, m) + part(b, m)) / 2
    good = (F.abs(sum(p[1:], p[0]) - 1) <= 1e-6) & (F.abs(sum(q[1:], q[0]) - 1) <= 1e-6)
    return F.when(good, F.sqrt(F.greatest(total, F.lit(0.0))))


#: js_distance() as SQL text over arrays p and q.
JS_SQL = (
    "CASE WHEN abs(aggregate(p, 0D, (a, x) -> a + x) - 1) <= 1e-6 AND abs(aggregate(q, 0D, (a, x) -> a + x) - 1) <= 1e-6 THEN "
    "sqrt(greatest(aggregate(zip_with(p, q, (x, y) -> (CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0D END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0D END) / 2), 0D, (a, x) -> a + x), 0D)) END"
)


#: Values that one task may sort for an exact quantile; beyond, histograms narrow the interval first.
SORTED = 1 << 16
#: Bins of one such histogram.
BINS = 4096


def quantiles(df: DataFrame, probabilities: dict[str, list[float]], most: int = SORTED) -> dict[str, list[float | None]]:
    """Exact quantiles, linear between neighbours, of several columns; nulls and NaN don't count, a column without values gives nulls.

    Up to `most` values are sorted in one aggregation. Beyond, each wanted order statistic is closed in by histograms of BINS
    bins, so no task holds more than `most` distinct values and the driver some thousand counts, whatever the input."""
    columns = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in probabilities}
    rows = df.select(*(x.alias(c) for c, x in columns.items()))
    sizes = rows.agg(*(a for c in probabilities for a in (F.count(c), F.min(c), F.max(c)))).first()
    small = [c for k, c in enumerate(probabilities) if 0 < sizes[3 * k] <= most]
    out: dict[str, list[float | None]] = {c: [None] * len(p) for c, p in probabilities.items()}
    if small:
        found = rows.agg(*(F.percentile(c, F.array(*map(F.lit, probabilities[c]))).alias(c) for c in small)).first()
        out |= {c: list(found[c]) for c in small}
    for k, (c, ps) in enumerate(probabilities.items()):
        n, low, high = sizes[3 * k : 3 * k + 3]
        if n > most:
            at = [p * (n - 1) for p in ps]
            ranks = sorted({r for x in at for r in (math.floor(x), math.ceil(x))})
            value = _order_statistics(rows.select(F.col(c).alias("x")).dropna(), ranks, low, high, n, most)
            out[c] = [value[math.floor(x)] + (value[math.ceil(x)] - value[math.floor(x)]) * (x - math.floor(x)) for x in at]
    return out


def _order_statistics(rows: DataFrame, ranks: list[int], low: float, high: float, n: int, most: int) -> dict[int, float]:
    """The values of rows (x) in [low, high], n of them, at ranks from 0."""
    if low == high:
        return dict.fromkeys(ranks, low)
    inside = rows.filter(F.col("x").between(low, high))
    if n <= most:
        found = inside.agg(F.percentile("x", F.array(*(F.lit(r / (n - 1) if n > 1 else 0.0) for r in ranks)))).first()[0]
        return dict(zip(ranks, found))
    width = (high - low) / BINS
    spot = F.least(F.floor((F.col("x") - low) / width), F.lit(BINS - 1)) if width > 0 and math.isfinite(width) else F.when(F.col("x") <= low / 2 + high / 2, 0).otherwise(1)
    counts = inside.groupBy(spot.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("z")).orderBy("b").collect()  # at most BINS
    out, before = {}, 0
    for b, m, a, z in counts:
        own = [r for r in ranks if before <= r < before + m]
        if own:
            part = rows.filter(F.col("x").between(a, z))
            out |= {r + before: v for r, v in _order_statistics(part, [r - before for r in own], a, z, m, most).items()}
        before += m
    return out


def winsor_limits(df: DataFrame, columns: list[str], low: float = 0.05, high: float = 0.95) -> dict[str, tuple]:
    return {c: tuple(q) for c, q in quantiles(df, {c: [low, high] for c in columns}).items()}


def clip(c: Column, low, high) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def winsorize(df: DataFrame, columns: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Columns held between their exact quantiles, all found in one aggregation."""
    return df.withColumns({c: clip(F.col(c), *lim) for c, lim in winsor_limits(df, columns, low, high).items()})


def zscore(df: DataFrame, columns: list[str], ddof: int = 1) -> DataFrame:
    sd = F.stddev_samp if ddof else F.stddev_pop
    row = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(sd(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    return df.withColumns({c: F.try_divide(F.col(c) - row[f"m{i}"], F.lit(row[f"s{i}"])) for i, c in enumerate(columns)})


def quantile_bucket(df: DataFrame, column: str, k: int, name: str = "bucket") -> DataFrame:
    """Right-closed buckets 1 to k between linear quantiles: equal values share one, unlike ntile."""
    edges = quantiles(df, {column: [i / k for i in range(1, k)]})[column]
    out = F.lit(k)
    for i, e in reversed([(i, e) for i, e in enumerate(edges, 1) if e is not None]):
        out = F.when(F.col(column) <= e, i).otherwise(out)
    return df.withColumn(name, F.when(F.col(column).isNotNull(), out))


def sharpe(ret: str, periods: int = 252) -> Column:
    """Null with fewer than two values and for a constant series."""
    return F.when((F.count(ret) >= 2) & (F.max(ret) != F.min(ret)), F.avg(ret) / F.stddev_samp(ret) * math.sqrt(periods))


def average_rank(column: str, *by: str) -> Column:
    """Rank with ties at their mean."""
    ties = F.count("*").over(Window.partitionBy(*by, column))
    return F.rank().over(Window.partitionBy(*by).orderBy(column)) + (ties - 1) / 2.0


def pooled_rank(df: DataFrame, column: str, name: str, most: int = SORTED) -> DataFrame:
    """Adds the rank of a column of doubles, without nulls and NaN, over all rows, with ties at their mean.

    Equal values are counted first. Values are cut into ranges of about `most`, and what lies in lower ranges is a table of one row
    per range, so no task orders all rows."""
    counts = df.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    parts = max(1, min(4096, counts.count() // most))
    edges = sorted(set(counts.agg(F.percentile_approx("_v", F.array(*(F.lit(i / parts) for i in range(1, parts))), 10 * parts)).first()[0])) if parts > 1 else []

    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(edges), v.to_numpy(np.float64)).astype(np.int32))

    counts = counts.withColumn("_r", place("_v") if edges else F.lit(0))
    low = counts.groupBy("_r").agg(F.sum("_n").alias("_m"))
    low = low.select("_r", (F.sum("_m").over(Window.orderBy("_r")) - F.col("_m")).alias("_low"))  # a row per range
    upto = F.sum("_n").over(Window.partitionBy("_r").orderBy("_v"))
    ranks = counts.withColumn("_u", upto).join(F.broadcast(low), "_r").select("_v", (F.col("_low") + F.col("_u") - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(ranks.hint("merge"), F.col(column) == F.col("_v")).drop("_v")


def rank_ic(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Spearman correlation per group of `by`; null under three pairs or for constants."""
    good = df.dropna(subset=[x, y]).withColumn("_rx", average_rank(x, *by)).withColumn("_ry", average_rank(y, *by))
    varied = (F.max("_rx") != F.min("_rx")) & (F.max("_ry") != F.min("_ry"))
    return good.groupBy(*by).agg(F.when((F.count("*") >= 3) & varied, F.corr("_rx", "_ry")).alias("ic"), F.count("*").alias("n"))


def newey_west_t(df: DataFrame, order: str, ret: str, lags: int = 5) -> float | None:
    """t of the mean with Bartlett weights. df is one series, a row per period."""
    w = Window.orderBy(order)
    row = df.filter(F.col(ret).isNotNull()).select(F.col(ret).alias("r"), order)
    mean, n = row.agg(F.avg("r"), F.count("r")).first()
    if n < max(8, lags + 2):
        return None
    dev = row.withColumn("d", F.col("r") - mean)
    sums = dev.select("d", *(F.lag("d", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)))
    got = sums.agg(F.sum(F.col("d") * F.col("d")), *(F.sum(F.col("d") * F.col(f"l{k}")) for k in range(1, lags + 1))).first()
    var = got[0] / n + 2 * sum((1 - k / (lags + 1)) * got[k] / n for k in range(1, lags + 1))
    return mean / math.sqrt(var / n) if var > 0 else None


def deflated_sharpe(sr: float, variance: float, trials: int, n: int, skew: float, kurtosis: float) -> float | None:
    """Probability that a per-period Sharpe ratio beats the best of `trials` without skill. kurtosis is not in excess."""
    if n < 2 or trials < 1 or variance < 0:
        return None
    norm, euler = NormalDist(), 0.5772156649015329
    best = 0.0
    if trials > 1:
        best = math.sqrt(variance) * ((1 - euler) * norm.inv_cdf(1 - 1 / trials) + euler * norm.inv_cdf(1 - 1 / (trials * math.e)))
    spread = 1 - skew * sr + (kurtosis - 1) / 4 * sr * sr
    return norm.cdf((sr - best) * math.sqrt(n - 1) / math.sqrt(spread)) if spread > 0 else None


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0

    def fraction(x, a, b):
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d or 1e-300)
                c = 1 + num / c or 1e-300
                h *= c * d
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def welch(m1: float, v1: float, n1: int, m0: float, v0: float, n0: int) -> tuple[float, float] | None:
    """t and p of a difference of means."""
    e1, e0 = v1 / n1, v0 / n0
    if e1 + e0 <= 0:
        return None
    t = (m1 - m0) / math.sqrt(e1 + e0)
    return t, student_p(t, (e1 + e0) ** 2 / (e1**2 / (n1 - 1) + e0**2 / (n0 - 1)))


#: Buckets by hash, so that labels are dealt alike in any partitioning.
BUCKETS = 64


def bootstrap_mean(df: DataFrame, column: str, draws: int = 2000, seed: int = 42, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the mean by a Poisson bootstrap. Equal values are counted first: a value that n rows share weighs
    Poisson(n) in a draw, seeded by the value, so partitions and their order don't matter and copies cost one row."""
    counts = df.select(F.col(column).cast("double").alias("x")).dropna().groupBy("x").count()

    def draw(batches):
        s, n = np.zeros(draws), np.zeros(draws)
        for pdf in batches:
            for x, k in zip(pdf["x"].to_numpy(), pdf["count"].to_numpy()):
                w = np.random.default_rng([seed, int(np.float64(x).view(np.uint64))]).poisson(k, draws)
                s += w * x
                n += w
        yield pd.DataFrame({"draw": np.arange(draws), "s": s, "n": n})

    sums = counts.mapInPandas(draw, "draw int, s double, n double").groupBy("draw").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))
    cut = (1 - level) / 2
    return tuple(sums.agg(F.percentile("m", F.array(F.lit(cut), F.lit(1 - cut)))).first()[0])


def permutation_p(df: DataFrame, value: str, group: str, iters: int = 1000, seed: int = 42) -> float | None:
    """Two-sided p, +1 corrected, of the difference of two groups' means under random dealing of their labels.

    In each turn the number of labels that a bucket of rows gets is hypergeometric, and within it they go to random rows: an
    exact permutation without sorting all rows in one place. Null without rows of both groups."""
    rows = df.select(F.col(value).cast("double").alias("x"), F.col(group).cast("int").alias("g")).dropna().filter("g in (0, 1)")
    counts = rows.groupBy("x").agg(F.count("*").alias("k"), F.sum("g").alias("ones")).withColumn("b", F.pmod(F.xxhash64("x"), F.lit(BUCKETS)).cast("int"))
    per = {r["b"]: r for r in counts.groupBy("b").agg(F.sum("k").alias("n"), F.sum("ones").alias("ones"), F.sum(F.col("x") * F.col("k")).alias("s"), F.sum(F.col("x") * F.col("ones")).alias("s1")).collect()}
    n, n1 = (sum(r[c] for r in per.values()) for c in ("n", "ones"))
    if not 0 < n1 < n:
        return None
    total, first = (sum(r[c] for r in per.values()) for c in ("s", "s1"))
    seen = first / n1 - (total - first) / (n - n1)
    names = sorted(per)
    dealt = np.random.default_rng([seed, n, n1]).multivariate_hypergeometric([per[b]["n"] for b in names], n1, size=iters, method="marginals")
    shares = {b: dealt[:, i] for i, b in enumerate(names)}

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, b = pdf.sort_values("x"), int(pdf["b"].iloc[0])
        x, k = pdf["x"].to_numpy(), pdf["k"].to_numpy(np.int64)
        rng = np.random.default_rng([seed, b])
        sums = [float(rng.multivariate_hypergeometric(k, m, method="marginals") @ x) for m in shares[b]]
        return pd.DataFrame({"t": np.arange(iters), "s": sums})

    sums = counts.select("b", "x", "k").groupBy("b").applyInPandas(deal, "t int, s double").groupBy("t").agg(F.sum("s").alias("s"))
    diff = F.col("s") / n1 - (F.lit(total) - F.col("s")) / (n - n1)
    beyond = sums.filter(F.abs(diff) >= abs(seen) * (1 - 1e-12)).count()
    return (beyond + 1) / (iters + 1)


def performance(curve: DataFrame, date: str, ret: str, periods: int = 252, turnover: str | None = None, bps: float = 0.0, lags: int = 5, base: float | None = None) -> DataFrame:
    """One row of one series: n, total, cagr, vol, sharpe, max_drawdown, hit_rate; null returns are flat days.

    The peak starts at the first value, or at `base` where given. With turnover also: sharpe_net, nw_t_net, max_drawdown_net, annual_turnover,
    cost_drag, after costs of bps per side. cagr counts years of 365.25 days between the first and the last day."""
    w = Window.orderBy(date)  # a row per day

    def path(df: DataFrame, column: str) -> DataFrame:
        df = df.withColumn("_c", F.exp(F.sum(F.log1p(F.coalesce(F.col(column), F.lit(0.0)))).over(w)))
        peak = F.max("_c").over(w)
        return df.withColumn("_p", peak if base is None else F.greatest(F.lit(base), peak))

    down = F.min(F.col("_c") / F.col("_p") - 1)
    last = F.max_by("_c", date)
    years = F.datediff(F.max(date), F.min(date)) / F.lit(365.25)
    out = path(curve, ret).agg(
        F.count(ret).alias("n"),
        (last - 1).alias("total"),
        F.when(years > 0, F.pow(last, F.try_divide(F.lit(1.0), years)) - 1).alias("cagr"),
        (F.stddev_samp(ret) * math.sqrt(periods)).alias("vol"),
        sharpe(ret, periods).alias("sharpe"),
        down.alias("max_drawdown"),
        F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"),
    )
    if turnover is None:
        return out
    net = apply_costs(curve, ret, turnover, bps, "_net")
    t = newey_west_t(net, date, "_net", lags)
    more = path(net, "_net").agg(
        sharpe("_net", periods).alias("sharpe_net"),
        F.lit(t).cast("double").alias("nw_t_net"),
        down.alias("max_drawdown_net"),
        annual_turnover(turnover, periods).alias("annual_turnover"),
        (annual_turnover(turnover, periods) * (bps / 1e4)).alias("cost_drag"),
    )
    return out.withColumn("_k", F.lit(1)).join(more.withColumn("_k", F.lit(1)), "_k").drop("_k")  # a row each


def apply_costs(df: DataFrame, ret: str, turnover: str, bps: float, name: str = "net") -> DataFrame:
    """Returns less turnover at bps per side; a null turnover costs nothing."""
    return df.withColumn(name, F.col(ret) - F.coalesce(F.col(turnover), F.lit(0.0)) * (bps / 1e4))


def annual_turnover(turnover: str, periods: int = 252) -> Column:
    return F.avg(turnover) * periods


def information_ratio(ic: str) -> Column:
    """Mean over deviation; null under two values or without spread."""
    return F.when((F.count(ic) >= 2) & (F.max(ic) != F.min(ic)), F.avg(ic) / F.stddev_samp(ic))


def moments(ret: str) -> list[Column]:
    """Population skew, and kurtosis that is 3 for the normal."""
    return [F.skewness(ret).alias("skew"), (F.kurtosis(ret) + 3).alias("kurtosis")]


def excess_over(series: DataFrame, benchmark: DataFrame, date: str, ret: str, periods: int = 252) -> DataFrame:
    """One row: n, annual excess over a benchmark of the same columns, information ratio, t of the excess and the share of
    days ahead, over the days that both have."""
    both = series.select(date, F.col(ret).alias("_s")).join(benchmark.select(date, F.col(ret).alias("_b")), date)
    both = both.withColumn("_e", F.col("_s") - F.col("_b")).filter("_e is not null")
    varied = (F.count("_e") >= 2) & (F.max("_e") != F.min("_e"))
    return both.agg(
        F.count("_e").alias("n"),
        F.when(F.count("_e") >= 2, F.avg("_e") * periods).alias("excess_annual"),
        F.when(varied, F.avg("_e") / F.stddev_samp("_e") * math.sqrt(periods)).alias("information_ratio"),
        F.when(varied, F.avg("_e") / F.stddev_samp("_e") * F.sqrt(F.count("_e"))).alias("t"),
        F.avg((F.col("_e") > 0).cast("double")).alias("ahead"),
    )


def surprise(actual: Column, expected: Column, floor: float = 0.01) -> Column:
    """Relative surprise; the divisor is at least `floor`."""
    return (actual - expected) / F.greatest(F.abs(expected), F.lit(floor))


def accounting_ratios(facts: DataFrame) -> DataFrame:
    """Adds ln_assets, btm, lev, roa, rd_at, etr, smooth to facts (assets, equity, debt, market_cap, income, research_4q,
    tax_4q, income_4q, std_roa, std_cfo). All are null without positive assets; lacking research counts as none."""
    a = F.when(F.col("assets") > 0, F.col("assets"))
    base = F.col("income_4q") + F.col("tax_4q")
    return facts.withColumns({
        "ln_assets": F.ln(a),
        "btm": F.when(a.isNotNull(), F.try_divide("equity", "market_cap")),
        "lev": F.when(F.col("debt") >= 0, F.col("debt") / a),
        "roa": F.col("income") / a,
        "rd_at": F.when(a.isNotNull(), F.coalesce(F.col("research_4q") / a, F.lit(0.0))),
        "etr": F.when(a.isNotNull() & (F.abs(base) > 1e-9), F.col("tax_4q") / base),
        "smooth": F.when(F.col("std_roa") > 1e-12, F.col("std_cfo") / F.col("std_roa")),
    })


def agreement(df: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """One row: n, share of rows whose labels agree, and the share by weight."""
    w = F.col(weight) if weight else F.lit(1)
    same = F.col(a).eqNullSafe(F.col(b))
    return df.agg(F.count("*").alias("n"), F.avg(same.cast("double")).alias("agree"), F.try_divide(F.sum(F.when(same, w).otherwise(0)), F.sum(w)).alias("agree_weighted"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: n, mean, sd, cv, p5, p50, p95, least, most."""
    q = quantiles(df, {c: [0.05, 0.5, 0.95] for c in columns})
    row = df.agg(*(f(c).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp), ("a", F.min), ("z", F.max)))).first()
    real = lambda x: None if x is None else float(x)
    out = []
    for i, c in enumerate(columns):
        m, sd = real(row[f"m_{i}"]), real(row[f"s_{i}"])
        out.append((c, row[f"n_{i}"], m, sd, sd / m if m and sd is not None else None, *q[c], real(row[f"a_{i}"]), real(row[f"z_{i}"])))
    return df.sparkSession.createDataFrame(out, "column string, n long, mean double, sd double, cv double, p5 double, p50 double, p95 double, least double, most double")


def compare_means(df: DataFrame, value: str, date: str, split_year: int, iters: int = 1000, seed: int = 42) -> dict:
    """A value's mean before and from a year, their difference and its p by permutation."""
    rows = df.select(F.col(value).cast("double").alias("x"), (F.year(date) >= split_year).cast("int").alias("g")).dropna()
    got = {r["g"]: r for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("m")).collect()}
    pre, post = got.get(0), got.get(1)
    diff = post["m"] - pre["m"] if pre and post else None
    p = permutation_p(rows, "x", "g", iters, seed) if diff is not None else None
    return {"pre": pre and pre["m"], "post": post and post["m"], "diff": diff, "p": p, "n_pre": pre["n"] if pre else 0, "n_post": post["n"] if post else 0}


def compare_ic(events: DataFrame, x: str, y: str, date: str, split_year: int, iters: int = 1000, seed: int = 42) -> dict:
    """Mean rank correlation by quarter before and from a year."""
    by_quarter = rank_ic(events.withColumn("_q", F.date_trunc("quarter", date).cast("date")), x, y, ["_q"]).filter("ic is not null")
    return compare_means(by_quarter, "ic", "_q", split_year, iters, seed)


def compare_sharpe(series: DataFrame, date: str, ret: str, split, periods: int = 252, block: int = 21, iters: int = 1000, seed: int = 42) -> dict:
    """Sharpe ratios before and from a date, and the p of their difference by circular moving blocks.

    series is one portfolio, a row per day, so it is collected once and its draws are dealt to tasks by number."""
    spark = series.sparkSession
    rows = series.select(F.col(date).alias("d"), F.col(ret).cast("double").alias("r")).dropna().orderBy("d").toPandas()
    early = pd.to_datetime(rows["d"]) < pd.Timestamp(split)
    halves = [rows.loc[early, "r"].to_numpy(), rows.loc[~early, "r"].to_numpy()]

    def ratio(r: np.ndarray) -> float:
        sd = r.std(ddof=1) if len(r) > 1 and r.min() != r.max() else 0.0
        return float(r.mean() / sd * math.sqrt(periods)) if sd else math.nan

    before, after = map(ratio, halves)
    out = {"pre": before, "post": after, "diff": after - before, "p": None, "n_pre": len(halves[0]), "n_post": len(halves[1])}
    if min(map(len, halves)) < 2 * block:
        return out

    def draw(batches):
        for pdf in batches:
            found = []
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, int(i)])
                picks = [(rng.integers(0, len(x), -(-len(x) // block))[:, None] + np.arange(block)).reshape(-1)[: len(x)] % len(x) for x in halves]
                found.append(ratio(halves[1][picks[1]]) - ratio(halves[0][picks[0]]))
            yield pd.DataFrame({"d": found})

    drawn = spark.range(iters).mapInPandas(draw, "d double").filter(~F.isnan("d"))
    side = F.col("d") <= 0 if out["diff"] > 0 else F.col("d") >= 0
    n, opposite = drawn.agg(F.count("*"), F.count_if(side)).first()
    out["p"] = min(1.0, 2.0 * (1 + opposite) / (n + 1))
    return out


def regimes(spark, found: dict[str, dict]) -> DataFrame:
    """Comparisons by name as a table."""
    real = lambda x: None if x is None or x != x else float(x)
    rows = [(k, *(real(v[c]) for c in ("pre", "post", "diff", "p")), v["n_pre"], v["n_post"]) for k, v in found.items()]
    return spark.createDataFrame(rows, "metric string, pre double, post double, diff double, p double, n_pre long, n_post long")
