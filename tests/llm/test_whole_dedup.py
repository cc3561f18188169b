import numpy as np
import pandas as pd
import pyarrow as pa

from cairn.llm import common, embedding_dedup, minhash


def test_a_pair_that_misses_the_sorted_line_is_counted():
    """4096 vectors of one label, crowded around one direction: 2048 pairs just above the threshold, most lines of which collide."""
    rng = np.random.default_rng(3)
    centre, dim = rng.standard_normal(64), 64
    base = centre / np.linalg.norm(centre) + 0.3 * rng.standard_normal((2048, dim)) / np.sqrt(dim) * 8
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.standard_normal((2048, dim))
    off -= (off * base).sum(1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    units = np.concatenate((base, 0.9801 * base + np.sqrt(1 - 0.9801**2) * off))
    df = pd.DataFrame({"vec_id": np.arange(4096), "copies": 1, "dim": dim, "unit": [u.tobytes() for u in units]})
    out = embedding_dedup._tile(0.98, 24, 2.0)(df, df)
    near = units @ units.T >= 0.98
    want = near.sum(1) - 1
    assert want.sum() >= 4096
    got = dict(zip(*(out[out.kind == 0][c] for c in ("u", "v"))))
    assert [got.get(i, 0) for i in range(4096)] == want.tolist()


def test_texts_reach_python_in_batches_bounded_by_bytes(spark):
    """42 MB of texts in one partition, after near_duplicates() has begun: no batch is much over BATCH, and all rows are read."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "n"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    minhash.near_duplicates(spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string"))
    docs = spark.range(2000, numPartitions=1).selectExpr("id AS doc_id", "repeat('ab ', 7000) AS text")
    rows = docs.mapInArrow(sizes, "bytes long, n long").collect()
    assert sum(r["n"] for r in rows) == 2000 and max(r["bytes"] for r in rows) < 2 * common.BATCH
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))  # a bound of the session's own stays
    common.bounded_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 1 << 20
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
