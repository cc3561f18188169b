"""Registry of named queries over the driver's tables, and the tables that stand for those of the domain.

Conversations stand for calls, orders for signals of firms, lineitem by supplier and day for a panel of prices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cairn.functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
POSITIVE, NEGATIVE = ["the", "and", "de", "die", "la"], ["of", "that", "que", "der", "le"]
BANDS = [(1, 10, "small"), (11, 25, "medium"), (26, 40, "large")]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*(F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, date, close, volume) per supplier and ship day."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("key"), F.to_date("l_shipdate").alias("date")).agg(F.avg("l_extendedprice").alias("close"), F.sum("l_quantity").alias("volume"))


PANEL = "panel AS (SELECT l_suppkey AS key, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, firm, day, x) per order."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("firm"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("x"))


SIGNALS = "signals AS (SELECT o_orderkey AS id, o_custkey AS firm, CAST(o_orderdate AS DATE) AS day, o_totalprice AS x FROM orders)"


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call, turn, role, nw, pos, neg) per turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("call"), "turn", "role", F.size(T.letters_words(F.col("text"))).alias("nw"), T.lexicon_count(F.col("text"), POSITIVE).alias("pos"), T.lexicon_count(F.col("text"), NEGATIVE).alias("neg"))


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w.upper()}'" for w in words) + "]"


WORDS = f"""w0 AS (SELECT conv_id AS call, turn, role, regexp_extract_all(replace(replace(upper(text), 'ß', 'SS'), 'ẞ', 'SS'), '[A-Z]+') AS w FROM conversations),
words AS (SELECT call, turn, role, len(w) AS nw, len(list_filter(w, lambda x: list_contains({_list(POSITIVE)}, x))) AS pos, len(list_filter(w, lambda x: list_contains({_list(NEGATIVE)}, x))) AS neg FROM w0)"""


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with r, from one row of a key to the next, and m, the day's mean of r."""
    p = panel(spark, sf_dir)
    p = p.withColumn("r", F.col("close") / F.lag("close").over(Window.partitionBy("key").orderBy("date")) - 1)
    return p.withColumn("m", F.avg("r").over(Window.partitionBy("date")))


RETURNS = f"{PANEL}, r0 AS (SELECT *, close / lag(close) OVER (PARTITION BY key ORDER BY date) - 1 AS r FROM panel), rets AS (SELECT key, date, close, volume, r, avg(r) OVER (PARTITION BY date) AS m FROM r0)"


def keyed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with key, a supplier for each firm: firms go round all of the table's suppliers."""
    return signals(spark, sf_dir).withColumn("key", F.col("firm") % table(spark, sf_dir, "supplier").count() + 1)


KEYED = f"{SIGNALS}, keyed AS (SELECT *, firm % (SELECT count(*) FROM supplier) + 1 AS key FROM signals)"
