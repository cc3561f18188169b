"""Readers and writers of the file formats that pipelines use."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import _parse_datatype_string


def read_jsonl_last(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """JSON lines without malformed ones; of each key the last by `order`."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; a byte order mark before it is no part of the first name. Columns go by name, in the schema's order."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c.lstrip("\ufeff").strip('"'): c for c in rows.columns}
    wanted = _parse_datatype_string(schema).fields
    return rows.select(*((F.col(f"`{names[f.name]}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))


def read_shards(spark: SparkSession, folders: list[str], schema: str | None = None) -> DataFrame:
    """Parquet shards of several folders by name, columns that a folder lacks null; shards being written (dot or underscore names)
    don't count."""
    reader = lambda p: spark.read.schema(schema).parquet(p) if schema else spark.read.option("mergeSchema", True).parquet(p)
    out = reader(folders[0])
    for p in folders[1:]:
        out = out.unionByName(reader(p), allowMissingColumns=True)
    return out


#: Names of price columns, as vendors write them, and ours.
PRICE_COLUMNS = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}
PRICE_SCHEMA = "date date, ticker string, open double, high double, low double, close double, volume double"


def tidy_prices(raw: DataFrame, ticker: str, date: str | None = None) -> DataFrame:
    """Vendor columns to ours, the date without a time, and the ticker; the first column is the date if none has that name."""
    day = date or next((c for c in raw.columns if c.lower() == "date"), raw.columns[0])
    known = {v: k for k, v in PRICE_COLUMNS.items()}
    found = {ours: next((c for c in raw.columns if c in (vendor, ours)), None) for ours, vendor in known.items()}
    return raw.select(F.to_date(F.col(f"`{day}`")).alias("date"), F.lit(ticker).alias("ticker"), *(F.col(f"`{c}`").alias(ours) for ours, c in found.items() if c))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A typed table without rows."""
    return spark.createDataFrame([], schema)


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(number, code, name, low, high) of a text file with header lines `n code name` and indented `low-high` lines."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).withColumn("line", F.monotonically_increasing_id())
    head = F.regexp_extract("value", r"^\s{0,2}(\d+)\s+(\S+)\s+(\S.*)$", 1)
    lines = lines.withColumn("h", F.when(head != "", F.struct(head.cast("int").alias("number"), F.regexp_extract("value", r"^\s{0,2}\d+\s+(\S+)", 1).alias("code"), F.trim(F.regexp_extract("value", r"^\s{0,2}\d+\s+\S+\s+(\S.*)$", 1)).alias("name"))))
    now = F.last("h", True).over(Window.partitionBy("file").orderBy("line"))
    low, high = (F.regexp_extract("value", r"^\s+(\d{3,4})-(\d{3,4})", i) for i in (1, 2))
    return lines.withColumn("g", now).filter((low != "") & F.col("g").isNotNull()).select("g.number", "g.code", "g.name", low.cast("int").alias("low"), high.cast("int").alias("high"))


def company_facts(docs: DataFrame, key: str, json: str, tags: dict[str, list[str]]) -> DataFrame:
    """(key, var, start, end, filed, val) of nested company facts in dollars; of a variable's tags the first that is there."""
    unit = "array<struct<start:date,end:date,val:double,filed:date>>"
    facts = docs.select(key, F.from_json(json, f"struct<facts:struct<`us-gaap`:map<string,struct<units:map<string,{unit}>>>>>").alias("j")).select(key, F.col("j.facts.us-gaap").alias("g"))
    picked = [F.struct(F.lit(var).alias("var"), F.coalesce(*(F.try_element_at(F.try_element_at("g", F.lit(t))["units"], F.lit("USD")) for t in names)).alias("rows")) for var, names in tags.items()]
    return facts.select(key, F.explode(F.array(*picked)).alias("p")).select(key, F.col("p.var").alias("var"), F.explode("p.rows").alias("r")).select(key, "var", "r.start", "r.end", "r.filed", "r.val")


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends rows whose key the parquet table does not hold yet; the number of keys added. A run that was cut short resumes.

    Each call is one shard, written beside the table and moved in when whole: a failed run leaves none of its rows behind. A null
    key counts as one key like any other."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(where) and any(x.getPath().getName().startswith("shard=") for x in files.listStatus(where)):
        done = spark.read.parquet(path).select(F.col(key).alias("_done")).distinct()
        df = df.join(done, F.col(key).eqNullSafe(F.col("_done")), "left_anti")
    name = uuid.uuid4().hex
    part = jvm.org.apache.hadoop.fs.Path(f"{path}/_part-{name}")
    df.write.parquet(part.toString())
    added = spark.read.schema(df.schema).parquet(part.toString()).select(key).distinct().count()
    if added:
        files.rename(part, jvm.org.apache.hadoop.fs.Path(f"{path}/shard={name}"))
    else:
        files.delete(part, True)
    return added


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def markdown(df: DataFrame, rows: int = 1000) -> str:
    """A small result as a table for reports."""
    head = df.columns
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in df.limit(rows).collect()])


def quality_report(tables: dict[str, DataFrame], title: str = "Quality") -> str:
    """Small tables under their headings, as Markdown."""
    return "\n\n".join([f"# {title}", *(f"## {i}. {name}\n\n{markdown(df)}" for i, (name, df) in enumerate(tables.items(), 1))]) + "\n"


def plot_hours(hours: DataFrame, path: str) -> bool:
    """A histogram of (hour, n) as PNG; false where matplotlib is missing."""
    try:
        import matplotlib
    except ImportError:
        return False
    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    rows = hours.orderBy("hour").collect()
    figure, axes = plt.subplots()
    axes.bar([r["hour"] for r in rows], [r["n"] for r in rows])
    axes.set_xlabel("hour")
    figure.savefig(path)
    plt.close(figure)
    return True


def plot_equity(curves: dict[str, DataFrame], path: str) -> bool:
    """Curves (date, equity, drawdown) as PNG: equity on a log scale above, the first curve's drawdown below."""
    try:
        import matplotlib
    except ImportError:
        return False
    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    figure, (top, low) = plt.subplots(2, 1, sharex=True)
    for i, (name, df) in enumerate(curves.items()):
        rows = df.orderBy("date").toPandas()  # a row per day
        top.plot(rows["date"], rows["equity"], label=name)
        if not i:
            low.fill_between(rows["date"], rows["drawdown"], 0)
    top.set_yscale("log")
    top.legend()
    figure.savefig(path)
    plt.close(figure)
    return True
