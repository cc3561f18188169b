"""Near-duplicate embeddings by collision-counting projections."""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch
from .components import connected_components

#: Bytes of vectors of a cell that one task holds against as many others, and the least number of vectors whatever their length.
TILE_BYTES, TILE_LEAST = 32 << 20, 1024
#: Leading projections that may cut a label into cells, and the half-width of their windows in standard deviations.
LEADS, LEAD_WIDTH = 12, 4.5
#: Probability with which a pair at the threshold may miss the collision count.
MISS = 1e-6


def directions(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng([17, dim]).standard_normal((dim, count))


def window(cosine: float) -> float:
    """Standard deviation of the difference of two unit vectors' projections at this cosine."""
    return sqrt(max(0.0, 2 - 2 * cosine)) or 1e-9


def needed_collisions(projections: int, widths: float, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold reaches with probability 1 - miss; windows are `widths` deviations."""
    p = erf(widths / sqrt(2))
    tail = 0.0
    for k in range(projections + 1):
        tail += comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if tail > miss:
            return k
    return projections


def _units(batches):
    """Unit vectors of valid rows; those of one length are divided together."""
    names = ["vec_id", "label", "dim", "unit"]
    for batch in batches:
        lists = batch.column(2).cast(pa.large_list(pa.float64()))
        offsets, values = lists.offsets.to_numpy(), lists.values
        flat = values.to_numpy(zero_copy_only=False)  # null components are NaN
        sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        known = batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes[(sizes > 0) & known]).tolist():
            at = np.flatnonzero((sizes == dim) & known)
            v = flat[offsets[at][:, None] + np.arange(dim)]
            peak = np.abs(v).max(axis=1)
            good = np.isfinite(peak) & (peak > 0)
            at, v = at[good], v[good] / peak[good, None]
            v /= np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
            rows = pa.array(at, pa.int64())
            units = pa.array([u.tobytes() for u in v], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.full(len(at), dim), pa.int32()), units], names)


def _cells(half: float):
    """Each vector's own cell, and with it every cell that its windows around the leading projections touch."""

    def place(batches):
        for batch in batches:
            dims, cuts = batch.column("dim").to_numpy(), batch.column("cuts").to_numpy()
            at, cells, homes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for dim, cut in {*zip(dims.tolist(), cuts.tolist())}:
                own = np.flatnonzero((dims == dim) & (cuts == cut))
                unit = np.frombuffer(b"".join(batch.column("unit").take(pa.array(own)).to_pylist()), np.float64).reshape(-1, dim)
                p = unit @ directions(dim, LEADS)[:, :cut]
                home = (p >= 0) @ (1 << np.arange(cut))
                row, cell = np.arange(len(own)), np.zeros(len(own), np.int64)
                for k in range(cut):
                    low, high = p[row, k] < half, p[row, k] >= -half
                    row, cell = np.concatenate((row[low], row[high])), np.concatenate((cell[low], cell[high] | (1 << k)))
                at.append(own[row])
                cells.append(cell)
                homes.append(cell == home[row])
            out = batch.take(pa.array(np.concatenate(at), pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(homes))], [*out.schema.names, "cell", "home"])

    return place


def _tile(cosine: float, projections: int, widths: float):
    half, need = widths * window(cosine) * (1 + 1e-9), needed_collisions(projections, widths)

    def count(home: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"kind": pd.Series(dtype="int32"), "u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})
        if home.empty or asks.empty:
            return none
        dim = int(home["dim"].iloc[0])
        lines = directions(dim, LEADS + projections)[:, LEADS:]
        sides = []
        for df in (home, asks):
            unit = np.frombuffer(b"".join(df["unit"]), np.float64).reshape(-1, dim)
            sides.append((df["vec_id"].to_numpy(), df["copies"].to_numpy(), unit, unit @ lines))
        (hid, hn, hu, hp), (qid, qn, qu, qp) = sides
        # Each line sorted; a query's window on it is a run of that order, and its vectors collide once.
        orders, first, last = [], [], []
        for k in range(projections):
            order = np.argsort(hp[:, k], kind="stable")
            placed = hp[order, k]
            orders.append(order)
            first.append(np.searchsorted(placed, qp[:, k] - half, side="left"))
            last.append(np.searchsorted(placed, qp[:, k] + half, side="right"))
        first, last = np.array(first).T, np.array(last).T
        found, rows, held = [], [], 0

        def confirm():
            i = np.repeat([r for r, _ in rows], [len(c) for _, c in rows]).astype(np.int64)
            j = np.concatenate([c for _, c in rows])
            near = np.einsum("ij,ij->i", qu[i], hu[j]) >= cosine
            found.append((i[near], j[near]))

        hits = np.zeros(len(hid), np.uint8)
        for q in range(len(qid)):
            hits[:] = 0
            for order, lo, hi in zip(orders, first[q].tolist(), last[q].tolist()):
                hits[order[lo:hi]] += 1
            near = np.flatnonzero(hits >= need)
            near = near[hid[near] > qid[q]]
            if len(near):
                rows.append((q, near))
                held += len(near)
                if held > 1 << 16:
                    confirm()
                    rows, held = [], 0
        if rows:
            confirm()
        if not found or not sum(len(x) for x, _ in found):
            return none
        i, j = (np.concatenate(x) for x in zip(*found))
        nodes, at = np.unique(np.concatenate((qid[i], hid[j])), return_inverse=True)
        left, right = at[: len(i)], at[len(i) :]
        links = np.bincount(left, hn[j], len(nodes)) + np.bincount(right, qn[i], len(nodes))
        low = np.arange(len(nodes))
        while True:
            new = low.copy()
            np.minimum.at(new, left, low[right])
            np.minimum.at(new, right, low[left])
            new = np.minimum(new, new[new])
            if (new == low).all():
                break
            low = new
        joined = np.flatnonzero(low != np.arange(len(nodes)))
        return pd.concat([pd.DataFrame({"kind": np.int32(0), "u": nodes, "v": links.astype(np.int64)}), pd.DataFrame({"kind": np.int32(1), "u": nodes[joined], "v": nodes[low[joined]]})])

    return count


def near_vectors(vectors: DataFrame, cosine: float = 0.98, projections: int = 24, widths: float = 2.0) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) per row of vectors (vec_id, embedding, label).

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine, in double precision,
    reaches `cosine`. Null, empty and zero vectors, those with null or non-finite components or a null label link with
    nothing: n_links 0, own component, kept true. Vectors of one direction and label are one class, whose copies are only
    counted. Repeated vec_ids are rows of one vector and are counted apart; a null vec_id links with nothing.

    A pair at the threshold differs by a normal deviate of known deviation on each random line, so it falls into the window
    of `widths` deviations around the asking vector with known probability; the count of collisions over all lines that a
    candidate must reach is the largest that such a pair reaches with probability 1 - 1e-6. Every line is sorted, so a window is
    a run of its order. The cosine confirms candidates.
    A label with more vectors than a tile (TILE_BYTES) is cut into cells by the signs of leading projections: a vector is at home
    in one cell and asks in every cell that its window touches, 1.6 times as many with each cut, which is why tiles are large: 16
    million vectors of 64 components in one label take 8 cuts and some 50 copies. Cells above a tile are dealt out in tiles, each
    pair of tiles one task. A task returns one link count and at most one edge per vector, so a dense group costs its size in rows.
    Joins are sort-merge joins at every size.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding"))
    units = scratch.save(rows.mapInArrow(_units, "vec_id long, label string, dim int, unit binary"))
    classes = scratch.save(units.groupBy("label", "dim", "unit").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    tile_rows = F.greatest(F.lit(TILE_LEAST), F.floor(F.lit(TILE_BYTES) / (F.col("dim") * 8)))
    cuts = F.least(F.lit(LEADS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / tile_rows)))).cast("int")
    sized = classes.join(sizes.filter(F.col("n") > 1).hint("merge"), ["label", "dim"]).withColumn("cuts", cuts)
    schema = "vec_id long, label string, dim int, unit binary, copies long, cuts int, cell int, home boolean"
    placed = scratch.save(sized.select("vec_id", "label", "dim", "unit", "copies", "cuts").mapInArrow(_cells(LEAD_WIDTH * window(cosine)), schema))
    key = ["label", "dim", "cell"]
    full = placed.groupBy(*key).agg(F.sum(F.col("home").cast("long")).alias("h"), F.count("*").alias("q")).filter("h > 0 and q > 1")
    full = full.select(*key, F.ceil(F.col("h") / tile_rows).cast("int").alias("hs"), F.ceil(F.col("q") / tile_rows).cast("int").alias("qs"))
    full = scratch.save(full)
    tile = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    what = ["vec_id", "dim", "unit", "copies", "label", "cell"]
    home = placed.filter("home").join(full.hint("merge"), key).select(*what, tile("hs").alias("a"), others("qs").alias("b"))
    asks = scratch.again(placed).join(scratch.again(full).hint("merge"), key).select(*what, tile("qs").alias("b"), others("hs").alias("a"))
    group = ["label", "dim", "cell", "a", "b"]
    found = scratch.save(home.groupBy(*group).cogroup(asks.groupBy(*group)).applyInPandas(_tile(cosine, projections, widths), "kind int, u long, v long"))
    counts = found.filter("kind = 0").groupBy(F.col("u").alias("rep")).agg(F.sum("v").alias("links"))
    known = connected_components(found.filter("kind = 1").select("u", "v"), scratch)
    of = (
        classes.withColumnRenamed("vec_id", "rep")
        .join(counts.hint("merge"), "rep", "left")
        .join(known.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
        .select("label", "dim", "unit", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    linked = units.join(of.hint("merge"), ["label", "dim", "unit"]).select("vec_id", "n_links", "component")
    valid = units.select("vec_id").distinct()
    alone = rows.select("vec_id").join(valid.hint("merge"), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    return linked.union(alone).select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))
