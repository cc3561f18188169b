"""Shared folder, intermediate tables and text buffers for the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: White space between words, as a regular expression of Java: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a session within one JVM (as in tests) gets a
    folder of its own, and any other an error, since executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Bytes of an Arrow batch between the JVM and Python, about; Spark's own limits are 10,000 rows and 64 MB.
BATCH = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session by BATCH, unless its settings bound them: a batch stands in the JVM beside its heap, in
    Python's buffers and in what is made of them, for each task at once. Results don't depend on batches."""
    if not spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


#: Rows of a run of texts at most, whatever their length.
ROWS = 1024


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of what lies before them.

    Results read them lazily, so those that drop() does not delete earlier go with the application."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.n = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}", 0
        path, files = self._files(self.path)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _files(self, path: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def folder(self) -> str:
        self.n += 1
        return f"{self.path}/{self.n}"

    def save(self, df: DataFrame) -> DataFrame:
        path = self.folder()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def again(self, df: DataFrame) -> DataFrame:
        """A table of save() read anew, for joins with itself."""
        return self.spark.read.schema(df.schema).parquet(df._scratch_path)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of save() that no later plan reads."""
        path, files = self._files(df._scratch_path)
        files.delete(path, True)


#: Bits of a map that says which rows a later pass over a table reads: 2 MB whatever the input. It only spares other rows the
#: work; where it is full, all are read, and the exact join or filter that follows picks the right ones.
MARKS = 1 << 24


def bitmap(ids: DataFrame, column: str = "doc_id") -> np.ndarray:
    """Marks of the numbers in a column, at most MARKS / 32 rows from Spark."""
    at = F.pmod(F.col(column), F.lit(MARKS))
    words = ids.filter(F.col(column).isNotNull()).select(F.shiftright(at, 5).alias("w"), F.expr(f"shiftleft(1L, cast(pmod({column}, 32) as int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(MARKS // 32, np.int64)
    out[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    return out.astype(np.uint32)


def marked(batch: pa.RecordBatch, marks: np.ndarray, want: bool = True, column: int = 0) -> pa.RecordBatch:
    """The rows whose number in a column is marked, and some others; with want false, the rest."""
    ids = batch.column(column).cast("int64").fill_null(0).to_numpy(zero_copy_only=False) % MARKS
    return batch.filter(pa.array(((marks[ids >> 5] >> (ids & 31).astype(np.uint32)) & 1 == 1) == want))


def without(docs: DataFrame, out_ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of docs whose number is not in out_ids, a table of Scratch.save. Rows that bitmap() leaves unmarked are read past
    the join; the others meet the exact ids in one that is dealt by id at every size. Null numbers stay."""
    at, marks = docs.columns.index(column), bitmap(out_ids, column)

    def rows(want: bool):
        return lambda batches: (marked(b, marks, want, at) for b in batches)

    unsure = docs.mapInArrow(rows(True), docs.schema).join(out_ids.select(column).distinct().hint("merge"), column, "left_anti")
    return docs.mapInArrow(rows(False), docs.schema).unionByName(unsure.select(*docs.columns))


def text_chunks(texts: pa.Array, most: int):
    """Yields (first row, byte offsets from 0, bytes as uint8) over runs of rows of about `most` bytes; null is empty."""
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = texts.fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, n, row + ROWS)
        yield row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end
