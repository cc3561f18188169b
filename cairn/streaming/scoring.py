"""Incremental scoring: each call once, as files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.functions import text as T


def lexicon_scores(utterances: DataFrame, positive: list[str], negative: list[str], text: str = "text") -> DataFrame:
    """Adds n_tokens, p_neg, p_neu, p_pos by word lists; null shares without words."""
    n = F.size(T.letters_words(F.col(text)))
    out = utterances.withColumns({"n_tokens": n, "_p": T.lexicon_count(F.col(text), positive), "_n": T.lexicon_count(F.col(text), negative)})
    return out.withColumns({"p_neg": F.try_divide("_n", "n_tokens"), "p_pos": F.try_divide("_p", "n_tokens")}).withColumn("p_neu", 1 - F.col("p_neg") - F.col("p_pos")).drop("_p", "_n")


def score_stream(spark: SparkSession, source: str, schema: str, key: list[str], score: Callable[[DataFrame], DataFrame], target: str, state: str):
    """Scores new parquet files of a folder into another; a key that comes again within a file batch is scored once."""
    rows = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        score(batch.dropDuplicates(key)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
