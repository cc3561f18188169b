"""Rule statistics and hashed n-gram log-likelihood ratios, by DataFrame functions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, Scratch

#: Hash buckets of n-grams: the size of the one model table that reaches the driver and every task.
BUCKETS = 1 << 16
#: Share of trusted documents that the threshold may reject, and the width of the score histogram's bins.
LOSS, BIN = 0.002, 0.01


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def rule_statistics(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` of docs (doc_id, text) with words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = docs.select(*carry, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))
    n = F.size("words")
    trios = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    )
    base = words.select(*carry, "words", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"), lines.alias("lines"), trios.alias("trios"))
    base = base.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    again = F.size(F.array_distinct("trios")) < F.size("trios")
    order = F.when(again, F.sort_array(F.transform("trios", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    base = base.withColumn("order", order).drop("trios")
    twice = F.filter("order", lambda x, k: (F.when(k > 0, F.get("order", k - 1)["h"]) == x["h"]) | F.coalesce(F.get("order", k + 1)["h"] == x["h"], F.lit(False)))
    base = base.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("order")
    covered = F.aggregate(F.transform("at", lambda v, k: F.coalesce(F.least(F.lit(3), F.get("at", k + 1) - v), F.lit(3))), F.lit(0), lambda a, x: a + x)
    base = base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")
    return base.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def gram_buckets(words: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of a text's single words and pairs of neighbours; letters keep their case."""
    n = F.size(words)
    singles = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    pairs = F.when(n < 2, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.get(words, i - 1), F.get(words, i)), F.lit(buckets)).cast("int"))
    )
    return F.concat(singles, pairs)


def ratio_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smooth: float = 1.0) -> list[float]:
    """log(target / raw) of each bucket: docs (doc_id, text) are the raw corpus, those in trusted (doc_id) the target."""
    marked = docs.join(trusted.select("doc_id").distinct().withColumn("target", F.lit(1)).hint("merge"), "doc_id", "left")
    grams = marked.select("target", words_of(F.coalesce("text", F.lit(""))).alias("words")).select("target", F.explode(gram_buckets(F.col("words"), buckets)).alias("g"))
    found = grams.groupBy("g").agg(F.count("*").alias("raw"), F.count("target").alias("target")).collect()  # at most `buckets` rows
    raw, target = [smooth] * buckets, [smooth] * buckets
    for g, r, t in found:
        raw[g] += r
        target[g] += t
    if sum(target) <= smooth * buckets * 1.0000001:
        return [0.0] * buckets
    all_raw, all_target = math.log(sum(raw)), math.log(sum(target))
    return [round(math.log(t) - all_target - math.log(r) + all_raw, 5) for r, t in zip(raw, target)]


def ratio_score(words: Column, weights: list[float]) -> Column:
    """Mean weight of a text's n-grams; 0 without words. The weights are one literal array."""
    table = F.from_json(F.lit(json.dumps(weights, separators=(",", ":"))), "array<double>")
    total = F.aggregate(gram_buckets(words, len(weights)), F.lit(0.0), lambda a, g: a + F.get(table, g))
    return F.coalesce(F.try_divide(total, F.greatest(2 * F.size(words) - 1, F.lit(0))), F.lit(0.0))


def threshold(scored: DataFrame, labels: DataFrame) -> float | None:
    """The score that parts labelled good from bad documents best among those that lose at most LOSS of the good ones.

    From a histogram of bins of BIN, at most a few thousand rows. None without labels of both kinds."""
    bins = scored.select("doc_id", "score").join(labels.filter("quality is not null").select("doc_id", "quality"), "doc_id").groupBy(F.floor(F.col("score") / BIN).cast("long").alias("bin"), "quality").count().collect()
    good, bad = {}, {}
    for b, q, n in bins:
        (good if q else bad)[b] = n
    if not good or not bad:
        return None
    best, cut, lost, caught = -1.0, None, 0, 0
    for b in sorted({*good, *bad}):
        gain = caught / sum(bad.values()) - lost / sum(good.values())
        if lost <= LOSS * sum(good.values()) and gain > best:
            best, cut = gain, b * BIN
        lost, caught = lost + good.get(b, 0), caught + bad.get(b, 0)
    return cut


def _judge(docs: DataFrame, labels: DataFrame, buckets: int, carry: tuple[str, ...]) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "quality")
    weights = ratio_weights(docs.select("doc_id", "text"), labels.filter("quality = 1"), buckets)
    stats = rule_statistics(docs, carry)
    scored = scratch.save(stats.withColumn("score", ratio_score(F.col("words"), weights)).drop("words"))
    cut = threshold(scored, labels)
    passed = F.lit(True) if cut is None else F.col("score") >= cut
    return scored.withColumn("kept", ~F.col("base_failed") & passed)


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of docs (doc_id, text): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    score and kept. labels (doc_id, quality): 1 marks the trusted target, 0 known bad documents.

    Words are runs of `[^\\x20\\x09-\\x0D]`; null text has none. score is the mean log ratio of the hashed words and word
    pairs between target and raw multinomials, smoothed by one count a bucket. kept is false if base_failed, else
    score >= threshold(); without labels of both kinds all that pass the base are kept. Windows of three words are told apart
    by 64-bit hashes. Repeated doc_ids keep their rows, null ones match no label; other columns are ignored; an empty
    table gives an empty one. Counts gather `buckets` rows whatever the input. Texts are shuffled once, to mark targets;
    the labels grow with the input and so are not broadcast.
    """
    return _judge(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels, buckets, ("doc_id",))


def keep_good(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of docs (doc_id, text, others) that quality_rules() keeps, with all their columns.

    The verdict is found beside each row and decides that row alone: null and repeated doc_ids need no join, and columns of
    any name come through. The scored rows are written once, since the cut is known only when all are scored."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return _judge(rows, labels, buckets, ("doc_id", "row")).filter("kept").select("row.*")
