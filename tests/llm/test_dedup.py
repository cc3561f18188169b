import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import embedding_dedup, minhash, queries
from cairn.llm.common import Scratch
from cairn.llm.components import connected_components


def components(nodes, links):
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_documents(texts):
    from collections import defaultdict

    sets = {i: shingles(t) for i, t in texts.items()}
    by, both = defaultdict(list), defaultdict(int)
    for i in sorted(sets):
        for s in sets[i]:
            for j in by[s]:
                both[j, i] += 1
            by[s].append(i)
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    return {i: len(s) for i, s in sets.items()}, components(texts, links)


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(2000, 2300)] + [(7, 7), (None, 3)]
    want = components({x for e in edges if None not in e for x in e}, [e for e in edges if None not in e])
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect())
    assert got == {n: c for n, c in want.items() if n != c}
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_op10_against_brute_force(spark, sf_dir):
    for path in (sf_dir, sf_dir.replace("0.001", "0.01")):
        texts = dict(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect())
        sizes, want = brute_documents(texts)
        got = queries.op10_minhash(spark, path).collect()
        assert len(got) == len(texts)
        for r in got:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (sizes[r["doc_id"]], want[r["doc_id"]], r["doc_id"] == want[r["doc_id"]])


def test_minhash_planted(spark):
    """Chains, edited copies around the threshold, one large group, a passage that all share, short and odd texts."""
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(vocabulary, 60))
    texts, base = {}, list(rng.choice(vocabulary, 200))
    for i in range(150):
        words = list(base)
        for k in rng.choice(200, rng.integers(0, 9), replace=False):
            words[k] = str(rng.choice(vocabulary))
        texts[i] = " ".join(words)
    for i in range(150, 300):
        texts[i] = passage + " " + " ".join(rng.choice(vocabulary, 60))
    chain = list(rng.choice(vocabulary, 300))
    for i in range(300, 340):
        texts[i] = " ".join(chain[(i - 300) * 8 : (i - 300) * 8 + 120])
    odd = ["", None, " \n\t", "One", "one", "ONE two three", "one  two\nthree", "é É", "É é", "a b c d e", "A B c d e", "x " * 40000, "y" * 100000]
    texts |= {400 + i: t for i, t in enumerate(odd)}
    rows = [(i, t) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit("clash")).withColumn("hub", F.lit(1))
    sizes, want = brute_documents(texts)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    more = minhash.near_duplicates(spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (2, "c"), (None, "c"), (None, None)], "doc_id long, text string"))
    rows = more.collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def brute_vectors(rows):
    good = {}
    for i, v, label in rows:
        if v is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        u = np.asarray(v, float)
        good[i] = (label, u / np.sqrt(u @ u))
    ids = sorted(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= 0.98]
    counts = {i: 0 for i, _, _ in rows}
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    return counts, components(counts, links)


def test_op2_against_brute_force(spark, sf_dir):
    for path in (sf_dir, sf_dir.replace("0.001", "0.01")):
        rows = [tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
        counts, want = brute_vectors(rows)
        got = queries.op2_embedding_dedup(spark, path).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (counts[i], want[i], i == want[i]) for i in counts}


@pytest.mark.parametrize("tile", [4096, 16])
def test_vectors_odd_and_dense(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE_BYTES", tile * 16 * 8)
    monkeypatch.setattr(embedding_dedup, "TILE_LEAST", 4)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + rng.standard_normal(16) * 0.11).astype(np.float32).tolist(), 1) for i in range(150)]
    rows += [(200 + i, rng.standard_normal(16).astype(np.float32).tolist(), i % 3) for i in range(60)]
    rows += [(300, [0.0] * 16, 1), (301, None, 1), (302, [1.0, None], 1), (303, [float("nan"), 1.0], 1), (304, [1.0, 2.0], None), (305, [1.0, 2.0], 7), (306, [2.0, 4.0], 7), (307, [1.0, 2.0, 0.0], 7), (308, [], 7), (309, [float("inf"), 1.0], 1), (310, [1.0, 2.0], 7)]
    counts, want = brute_vectors(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit("clash"))
    got = embedding_dedup.near_vectors(df).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (counts[i], want[i], i == want[i]) for i in counts}
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_calibration():
    need = embedding_dedup.needed_collisions(24, 2.0)
    assert 10 < need < 24 and embedding_dedup.needed_collisions(24, 0.5) < need
