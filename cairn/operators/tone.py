"""Distances between speakers' tones, role features and their null by permutation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cairn.functions import stats, text as T


def entity_points(rows: DataFrame, group: str, entity: str, weight: str, parts: list[str], least: float = 0) -> DataFrame:
    """Per group and entity: weight, and the weighted mean of each part; entities of no more than zero or under `least` weight go."""
    return (
        rows.groupBy(group, entity)
        .agg(F.sum(weight).alias("w"), *(F.sum(F.col(p) * F.col(weight)).alias(f"_{p}") for p in parts))
        .filter((F.col("w") > 0) & (F.col("w") >= least))
        .select(group, entity, "w", *(F.try_divide(f"_{p}", "w").alias(p) for p in parts))
    )


def tone_distance(points: DataFrame, group: str, parts: list[str], centre: str = "equal", weighted: bool = False, above_median: bool = False, least: int = 2) -> DataFrame:
    """Mean distance of a group's entities from its centre: n_entities, distance. Groups under `least` entities are absent.

    centre: equal (mean of entities) or pooled (mean of weight); weighted: the mean of distances goes by weight;
    above_median: entities under the group's median weight don't count."""
    w = Window.partitionBy(group)
    if above_median:
        points = points.withColumn("_m", F.percentile("w", F.lit(0.5)).over(w)).filter("w >= _m")
    for p in parts:
        mid = F.avg(p).over(w) if centre == "equal" else F.sum(F.col(p) * F.col("w")).over(w) / F.sum("w").over(w)
        points = points.withColumn(f"_c_{p}", mid)
    off = F.sqrt(sum(((F.col(p) - F.col(f"_c_{p}")) ** 2 for p in parts), F.lit(0.0)))
    mean = F.sum(off * F.col("w")) / F.sum("w") if weighted else F.avg(off)
    return points.groupBy(group).agg(F.count("*").alias("n_entities"), mean.alias("distance")).filter(F.col("n_entities") >= least)


def call_features(scores: DataFrame) -> DataFrame:
    """A row per call of scores (call_id, role, section, p_neg, p_neu, p_pos, n_tokens): the mean distribution by tokens and its net
    tone, population deviation of utterances' net tones (null for one), divergence of analysts from management in the questions
    (Jensen-Shannon, and the signed difference of net tones), management's remarks less its answers, whether there are
    questions, and numbers of utterances. One pass; what has no utterances or tokens is null."""
    parts = ("p_neg", "p_neu", "p_pos")
    net, tokens = F.col("p_pos") - F.col("p_neg"), F.col("n_tokens")
    management, analyst = F.col("role") == "management", F.col("role") == "analyst"
    remarks, qa = F.col("section") == "remarks", F.col("section") == "qa"
    sides = {"all": F.lit(True), "mq": management & qa, "aq": analyst & qa, "mr": management & remarks}
    sums = [F.sum(F.when(test, F.col(p) * tokens)).alias(f"{k}_{p}") for k, test in sides.items() for p in parts]
    weights = [F.nullif(F.sum(F.when(test, tokens)), F.lit(0)).alias(f"{k}_w") for k, test in sides.items()]
    got = scores.groupBy("call_id").agg(
        *sums,
        *weights,
        F.when(F.count("*") > 1, F.stddev_pop(net)).alias("tone_dispersion"),
        F.coalesce(F.max(qa), F.lit(False)).alias("qa_detected"),
        F.count("*").alias("n_utt_scored"),
        F.count_if(management & qa).alias("n_utt_mgmt_qa"),
        F.count_if(analyst & qa).alias("n_utt_analyst_qa"),
    )
    mean = {k: [F.col(f"{k}_{p}") / F.col(f"{k}_w") for p in parts] for k in sides}
    tone = {k: m[2] - m[0] for k, m in mean.items()}
    return got.select(
        "call_id",
        *(m.alias(p) for p, m in zip(parts, mean["all"])),
        tone["all"].alias("net_tone"),
        "tone_dispersion",
        stats.js_distance(mean["aq"], mean["mq"]).alias("mgmt_analyst_divergence"),
        (tone["mq"] - tone["aq"]).alias("mgmt_analyst_divergence_signed"),
        (tone["mr"] - tone["mq"]).alias("qa_remarks_gap"),
        "qa_detected",
        "n_utt_scored",
        "n_utt_mgmt_qa",
        "n_utt_analyst_qa",
    )


def history_features(features: DataFrame, key: str = "ticker", order: str = "call_datetime") -> DataFrame:
    """Adds delta_tone and tone_js_prev against the key's call before; null for the first, and where a part is null."""
    w = Window.partitionBy(key).orderBy(order)
    parts = ("p_neg", "p_neu", "p_pos")
    with_last = features.withColumns({f"_{p}": F.lag(p).over(w) for p in parts} | {"_t": F.lag("net_tone").over(w)})
    js = stats.js_distance([F.col(p) for p in parts], [F.col(f"_{p}") for p in parts])
    return with_last.withColumns({"delta_tone": F.col("net_tone") - F.col("_t"), "tone_js_prev": js}).drop("_t", *(f"_{p}" for p in parts))


def manager_distance(scores: DataFrame, role: str = "management", least: int = 2, tokens: int = 25) -> DataFrame:
    """(call_id, tone_distance, n_managers) of scores with speaker: persons by match key, each with `tokens` or more; only calls
    with questions; null under `least` persons, no row without any."""
    heard = scores.withColumn("_qa", F.max(F.col("section") == "qa").over(Window.partitionBy("call_id"))).filter(F.col("_qa") & (F.col("role") == role))
    named = heard.withColumn("_k", T.match_key(F.col("speaker"))).filter("_k != ''")
    points = entity_points(named, "call_id", "_k", "n_tokens", ["p_pos", "p_neg"], tokens)
    out = tone_distance(points, "call_id", ["p_pos", "p_neg"], least=1)
    return out.select("call_id", F.when(F.col("n_entities") >= least, F.col("distance")).alias("tone_distance"), F.col("n_entities").alias("n_managers"))


def label_shares(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Shares of hard labels, and mean probabilities, per group; with weight by it."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = hard_labels(df)
    share = [F.try_divide(F.sum(F.when(F.col("label") == k, w).otherwise(0.0)), F.sum(w)).alias(f"f_{k}") for k in ("neg", "neu", "pos")]
    mean = [F.try_divide(F.sum(F.col(f"p_{k}") * w), F.sum(w)).alias(f"p_{k}") for k in ("neg", "neu", "pos")]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *share, *mean)


def entity_dispersion(points: DataFrame, group: str, value: str, name: str = "dispersion") -> DataFrame:
    """Sample deviation of entities' values per group, null under two. points has a row per entity."""
    return points.groupBy(group).agg(F.count(value).alias("n_entities"), F.when(F.count(value) >= 2, F.stddev_samp(value)).alias(name))


def question_adjusted(turns: DataFrame, call: str, block: str, role: str, entity: str, words: list[str], floor: bool) -> DataFrame:
    """Managers' word counts less their share of the words of the question they answer; at floor never below zero."""
    keys = [call, block]
    asked = turns.filter(F.col(role) == "analyst").groupBy(*keys).agg(*(F.sum(w).alias(f"_q_{w}") for w in words))
    said = turns.filter(F.col(role) == "management").groupBy(*keys, entity).agg(*(F.sum(w).alias(w) for w in words))
    w = Window.partitionBy(*keys)
    share = F.try_divide(F.col(words[0]), F.sum(words[0]).over(w))
    out = said.withColumn("_share", share).join(asked, keys, "left")
    less = {x: F.col(x) - F.coalesce(f"_q_{x}", F.lit(0)) * F.coalesce("_share", F.lit(0.0)) for x in words}
    return out.withColumns({x: F.greatest(c, F.lit(0.0)) if floor else c for x, c in less.items()}).select(call, block, entity, *words)


def hard_labels(df: DataFrame) -> DataFrame:
    """label: that of the greatest probability, the first of neg, neu, pos among equals."""
    n, u, p = F.col("p_neg"), F.col("p_neu"), F.col("p_pos")
    return df.withColumn("label", F.when((n >= u) & (n >= p), "neg").when(u >= p, "neu").otherwise("pos"))


def permutation_null(words: DataFrame, group: str, sizes: str, values: list[str], draws: int = 200, seed: int = 42) -> DataFrame:
    """Distance under random dealing of a group's words to entities of fixed sizes: observed, e_null, sd_null, td_adj and z.

    words: one row per group, with sizes array<int> (those of 0 are left out) and arrays of numbers of one length, such as 1 for
    positive and 1 for negative words, dealt together in that order. Distance is the mean Euclidean one from the mean of
    entities; sd_null is the population's; td_adj = observed - e_null; z is null without spread. Draws are seeded by the group."""

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                g, s, v = row[0], np.array([x for x in row[1] if x > 0], int), np.column_stack([np.asarray(x, float) for x in row[3:]])
                if len(s) < 2 or s.sum() != len(v):
                    continue
                cuts = np.concatenate(([0], np.cumsum(s)[:-1]))

                def distance(x):
                    m = np.add.reduceat(x, cuts, axis=0) / s[:, None]
                    return np.sqrt(((m - m.mean(axis=0)) ** 2).sum(axis=1)).mean()

                rng = np.random.default_rng([seed, int(row[2]) & 0xFFFFFFFFFFFFFFFF])
                null = np.array([distance(rng.permutation(v, axis=0)) for _ in range(draws)])
                seen, mean, sd = distance(v), null.mean(), null.std()
                out.append((g, seen, mean, sd, seen - mean, (seen - mean) / sd if sd > 0 else None))
            yield pd.DataFrame(out, columns=[group, "observed", "e_null", "sd_null", "td_adj", "z"])

    kind = dict(words.dtypes)[group]
    return words.select(group, sizes, F.xxhash64(group).alias("_h"), *values).mapInPandas(run, f"{group} {kind}, observed double, e_null double, sd_null double, td_adj double, z double")
