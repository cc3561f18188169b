"""Near-duplicate documents by b-bit MinHash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, bitmap, bounded_batches, marked, text_chunks, without
from .components import connected_components

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]
#: Bytes of text that are hashed at a time.
_CHUNK = 1 << 20
#: Turns with hubs drawn by hash before all pairs that are left.
TURNS = 1
#: Minima of the longer signatures of documents in buckets that stay open.
FINE = 1024


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, _CHUNK + 1), base, _U)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def shingle_sets(offsets: np.ndarray, data: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text of a chunk its sorted distinct 64-bit shingle hashes (see near_duplicates)."""
    n, docs = len(data), len(offsets) - 1
    none = np.empty(0, _U)
    if not n:
        return [none] * docs
    data = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    if not len(starts):
        return [none] * docs
    up, down = _powers(n + 1)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTE[data] * up[:n], dtype=_U)))
    words = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))
    first = np.searchsorted(starts, offsets[:-1])
    counts = np.searchsorted(starts, offsets[1:]) - first
    weights = [_U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]
    weights += [_U(int(x) | 1) for x in np.random.default_rng(7).integers(1, 2**63, max(0, width - 5))]
    if len(words) >= width:
        m = len(words) - width + 1
        grams = np.zeros(m, _U)
        for k in range(width):
            grams += _mix(words[k : k + m] + weights[k]) * weights[k]
        grams = _mix(grams)
    out = []
    for a, c in zip(first.tolist(), counts.tolist()):
        if c >= width:
            out.append(np.unique(grams[a : a + c - width + 1]))
        elif c:
            h = _U(0xC2B2AE3D27D4EB4F) * _U(c + 1)
            for w, k in zip(words[a : a + c], weights):
                h = h + _mix(np.array([w + k], _U))[0] * k
            out.append(_mix(np.array([h], _U)))
        else:
            out.append(none)
    return out


def _signer(perms: int, rows: int, width: int, marks: np.ndarray | None = None):
    """mapInArrow function: each document's set size, set digest, packed 2-bit signature and band keys."""
    factors = np.random.default_rng(11).integers(1, 2**63, perms, dtype=np.uint64) * _U(2) + _U(1)
    band_keys = np.random.default_rng(13).integers(1, 2**63, (perms // rows, rows), dtype=np.uint64) * _U(2) + _U(1)
    longs = -(-perms // 32)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d0", pa.int64()), ("d1", pa.int64())]
        + [(f"s{i}", pa.int64()) for i in range(longs)]
        + [("bands", pa.list_(pa.int64()))]
    )

    def sign(batches):
        np.seterr(over="ignore")
        for batch in batches:
            batch = batch if marks is None else marked(batch, marks)
            ids = batch.column(0)
            for row, offsets, data in text_chunks(batch.column(1), _CHUNK):
                sets = shingle_sets(offsets, data, width)
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                minima = np.zeros((len(sets), perms), _U)
                block: list[int] = []
                size = 0
                for i in some.tolist():
                    block.append(i)
                    size += int(sizes[i])
                    if size >= 1 << 15 or i == some[-1]:
                        flat = np.concatenate([sets[j] for j in block])
                        at = np.concatenate(([0], np.cumsum(sizes[block])[:-1]))
                        for p in range(perms):
                            minima[block, p] = np.minimum.reduceat(flat * factors[p], at)
                        block, size = [], 0
                bits = np.zeros((len(sets), longs * 32), np.uint64)
                bits[:, :perms] = _mix(minima) & _U(3)
                packed = np.zeros((len(sets), longs), np.uint64)
                for k in range(32):
                    packed |= bits[:, k::32] << _U(2 * k)
                keys = _mix((_mix(minima.reshape(len(sets), -1, rows)) * band_keys).sum(axis=2, dtype=np.uint64) + np.arange(perms // rows, dtype=np.uint64) * _U(_BASE))
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                digests = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                held = np.where(sizes > 0, perms // rows, 0)
                flat_keys = keys[sizes > 0].reshape(-1).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(held))), pa.int32()), pa.array(flat_keys))
                columns = [ids.slice(row, len(sets)).cast(pa.int64()), pa.array(sizes), pa.array(digests[:, 0]), pa.array(digests[:, 1])]
                columns += [pa.array(packed[:, i].view(np.int64)) for i in range(longs)] + [bands]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return sign, longs


def _set_reader(width: int, marks: np.ndarray):
    def read(batches):
        np.seterr(over="ignore")
        for batch in batches:
            batch = marked(batch, marks)
            for row, offsets, data in text_chunks(batch.column(1), _CHUNK):
                sets = shingle_sets(offsets, data, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)).cast(pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "shingles"])

    return read


def _confirm(percent: int):
    def confirm(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _estimate(longs: int, perms: int) -> Column:
    """Similarity from the count of equal 2-bit minima, less the quarter that agrees by chance."""
    differ = F.lit(0)
    for i in range(longs):
        x = F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return ((F.lit(perms) - differ) / F.lit(float(perms)) - 0.25) / 0.75


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, perms: int = 200, rows: int = 5, slack: float = 0.14) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) per row of docs (doc_id, text): the groups of near duplicates.

    A text's set holds the distinct `width`-word shingles of its words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased), as 64-bit
    hashes; a text of fewer words has its whole word sequence as its one shingle; null, empty and blank texts have the
    empty set and link with nothing. Documents link when 100 * |intersection| >= percent * |union|.

    Each of `perms` minima keeps its two low bits in packed longs; `perms / rows` bands of whole minima give candidates. At
    the defaults a pair at the threshold shares no band with probability 2e-5, and the bit estimate, which must reach the
    threshold less `slack` (four standard errors), loses 3e-5. Full sets confirm every link. Equal sets are one class, so
    copies cost one row each. In each band bucket the smallest member is the hub. Documents are held against their smallest
    hub; then, by turns, those of each bucket that are not yet joined to a hub, the smallest or one drawn by hash, against
    it; and last all pairs of a bucket that are still in different components against each other. So a group of thousands of copies costs about its size, and no pair that
    could still join two groups is left out.

    Repeated doc_ids each get their row and share one component. A null doc_id gets a null component and kept true. Empty
    input gives an empty result; other columns of docs are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "minhash")
    sign, longs = _signer(perms, rows, width)
    signs = [f"s{i}" for i in range(longs)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, d0 long, d1 long, " + ", ".join(f"{s} long" for s in signs) + ", bands array<long>"
    signed = scratch.save(texts.mapInArrow(sign, schema))
    some = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = scratch.save(
        some.select("doc_id", "d0", "d1").join(classes.filter("copies > 1"), ["d0", "d1"]).filter("doc_id != rep").distinct()
    )
    # A repeated doc_id with another text must stay, so only rows of the same set are left out.
    first = scratch.save(some.join(copies.hint("merge"), ["doc_id", "d0", "d1"], "left_anti"))
    rep = first.select("doc_id", F.explode("bands").alias("key"))
    buckets = rep.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    members = scratch.save(rep.join(buckets.hint("merge"), "key").drop("n"))
    cut = max(0.0, percent / 100 - slack)
    near = _estimate(longs, perms) >= cut
    alike = 100 * F.least("a.n_shingles", "b.n_shingles") >= percent * F.greatest("a.n_shingles", "b.n_shingles")

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs (doc_id, hub) whose sizes and bits allow the link, as (u, v)."""
        one = scratch.again(first).select("doc_id", "n_shingles", *signs).distinct()
        left = pairs.join(one, "doc_id").alias("a")
        two = scratch.again(first).select("doc_id", "n_shingles", *signs).distinct().alias("b")
        both = left.join(two, (F.col("a.hub") == F.col("b.doc_id")) & alike & near)
        return scratch.save(both.select(F.col("a.doc_id").alias("u"), F.col("a.hub").alias("v")).distinct())

    def confirmed(pairs: DataFrame) -> DataFrame:
        marks = bitmap(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")))
        sets = scratch.save(texts.mapInArrow(_set_reader(width, marks), "doc_id long, shingles binary"))
        full = pairs.join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("y")).hint("merge"), "v").join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("x")).hint("merge"), "u")
        links = scratch.save(full.select("u", "v", "x", "y").mapInArrow(_confirm(percent), "u long, v long").distinct())
        scratch.drop(sets)
        return links

    def with_component(df: DataFrame, found: DataFrame, key: str = "doc_id", name: str = "component") -> DataFrame:
        found = found.select(F.col("node").alias(key), F.col("component").alias(name))
        return df.join(found, key, "left").withColumn(name, F.coalesce(name, key))

    def joined(found: DataFrame, links: DataFrame) -> DataFrame:
        return connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links), scratch)

    nearest = members.filter("doc_id != hub").groupBy("doc_id").agg(F.min("hub").alias("hub"))
    known = connected_components(confirmed(likely(nearest)).union(copies.select("doc_id", "rep")), scratch)
    rest = members.drop("hub")
    for turn in range(1 + TURNS):
        rest = with_component(rest, known)
        keys = rest.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 != c1").select("key")
        rest = scratch.save(rest.join(keys, "key", "left_semi"))
        order = F.xxhash64(F.col("doc_id"), F.col("key"), F.lit(turn)) if turn else F.col("doc_id")
        hubs = scratch.again(rest).groupBy("key").agg(F.min_by(F.struct("doc_id", "component"), order).alias("h"))
        pairs = rest.select("key", "doc_id", "component").join(hubs, "key").filter("component != h.component")
        pairs = likely(pairs.select("doc_id", F.col("h.doc_id").alias("hub")).distinct())
        if not pairs.isEmpty():
            known = joined(known, confirmed(pairs))
        rest = rest.drop("component")
    # What is left gets longer signatures, whose estimate is that much closer, before all its pairs are held together.
    rest = with_component(rest, known)
    keys = rest.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 != c1").select("key")
    rest = scratch.save(rest.join(keys, "key", "left_semi"))
    finer, longs = _signer(FINE, FINE, width, bitmap(rest.select("doc_id")))
    signs = [f"s{i}" for i in range(longs)]
    fine = texts.mapInArrow(finer, "doc_id long, n_shingles long, d0 long, d1 long, " + ", ".join(f"{s} long" for s in signs) + ", bands array<long>")
    rest = scratch.save(rest.join(scratch.save(fine.select("doc_id", "n_shingles", *signs)), "doc_id"))
    own = scratch.again(rest).groupBy("doc_id").agg(F.collect_set("key").alias("keys"))  # no more than its bands
    rest = scratch.save(rest.join(own, "doc_id"))
    near = _estimate(longs, FINE) >= percent / 100 - slack * (perms / FINE) ** 0.5
    other = scratch.again(rest).alias("b")
    once = F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("a.key")
    pairs = rest.alias("a").join(other, (F.col("a.key") == F.col("b.key")) & (F.col("a.component") != F.col("b.component")) & (F.col("a.doc_id") > F.col("b.doc_id")) & alike & near & once)
    pairs = scratch.save(pairs.select(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v")).distinct())
    if not pairs.isEmpty():
        known = joined(known, confirmed(pairs))
    out = with_component(signed.select("doc_id", "n_shingles"), known)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of docs (doc_id, text, others) of each group of near_duplicates(), with all its columns: that of the smallest doc_id.

    Rows without a shingle (null, empty and blank texts) all stay. Where doc_ids repeat or are null, the rows are written with
    numbers of their own first, which later passes read, and of a group the row of the smallest number stays; so identical
    rows are copies like any others."""
    scratch = Scratch(docs.sparkSession, "unique")
    counts = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().agg(F.max("count"), F.max(F.col("doc_id").isNull())).first()
    if counts[0] is None or (counts[0] == 1 and not counts[1]):
        found = near_duplicates(docs, **options).filter(~F.col("kept"))
        return without(docs, scratch.save(found.select("doc_id")))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    numbered = scratch.save(docs.select(F.monotonically_increasing_id().alias("doc_id"), row))
    found = near_duplicates(numbered.select("doc_id", "row.text"), **options).filter(~F.col("kept"))
    return without(numbered, scratch.save(found.select("doc_id"))).select("row.*")
