"""Quality by the perplexity of an interpolated modified Kneser-Ney character model of trusted text."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, bitmap, marked, text_chunks

#: Symbols of the dense table of train(), which perplexity_filter does not use: 0 stands before a text, 1 for all characters but
#: the SYMBOLS - 2 most frequent of trusted text.
SYMBOLS = 128
#: Bits of a symbol of the whole alphabet (code point + 1, 0 stands before a text) in the key of a trigram.
BITS = 21
#: Blocks that the documents of a file's split are dealt to, and the trigrams of a task's block that are merged at once.
BLOCKS, HELD = 16, 1 << 20
#: Languages whose limits are broadcast at most, and the salts of the join beyond.
FEW, SALTS = 10_000, 64


def _codes(offsets: np.ndarray, data: np.ndarray):
    """Code points of a chunk, and the number of each text's."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    ends = lead[offsets]
    return points, np.diff(ends), ends


def _points(batches):
    for batch in batches:
        total = np.zeros(0x110000, np.int64)
        for _, offsets, data in text_chunks(batch.column(0), 1 << 22):
            total += np.bincount(_codes(offsets, data)[0], minlength=0x110000)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["c", "n"])


def _table(alphabet: list[int]) -> np.ndarray:
    table = np.ones(0x110000, np.uint8)
    table[alphabet] = np.arange(2, 2 + len(alphabet))
    return table


def _grams(offsets: np.ndarray, data: np.ndarray, table: np.ndarray):
    points, sizes, ends = _codes(offsets, data)
    c = table[points].astype(np.int32)
    b, a = np.zeros_like(c), np.zeros_like(c)
    if len(c):
        b[1:] = c[:-1]
        a[2:] = c[:-2]
        starts = ends[:-1][sizes > 0]
        b[starts] = 0
        a[starts] = 0
        second = starts[sizes[sizes > 0] > 1] + 1
        a[second] = 0
    return (a * SYMBOLS + b) * SYMBOLS + c, sizes, ends


def _counter(alphabet: list[int]):
    def count(batches):
        table, total = _table(alphabet), np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, offsets, data in text_chunks(batch.column(0), 1 << 22):
                grams = _grams(offsets, data, table)[0]
                at, n = np.unique(grams, return_counts=True)
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["g", "n"])

    return count


def _discounts(counts: DataFrame, n: str) -> list[float]:
    """Discounts of counts of 1, 2 and 3 or more, from the numbers of n-grams seen one to four times."""
    seen = dict(counts.filter(F.col(n) <= 4).groupBy(n).count().collect())
    n1, n2, n3, n4 = (seen.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    return [min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def _order(counts: DataFrame, context: list[str], n: str, name: str) -> DataFrame:
    """Counts joined to their contexts' sums, both dealt by context: head, the discounted share, and rest, the lower order's."""
    d = _discounts(counts, n)
    less = F.when(F.col(n) == 1, d[0]).when(F.col(n) == 2, d[1]).otherwise(d[2])
    sums = counts.groupBy(*context).agg(F.sum(n).alias("all"), F.sum(less).alias("less"))
    return counts.join(sums, context).select(*counts.columns, ((F.col(n) - less) / F.col("all")).alias(f"head{name}"), (F.col("less") / F.col("all")).alias(f"rest{name}"))


def train(texts: DataFrame, scratch: Scratch) -> tuple[list[int], np.ndarray]:
    """Alphabet and log-probability table (SYMBOLS ** 3) of texts (text)."""
    points = texts.mapInArrow(_points, "c int, n long").groupBy("c").agg(F.sum("n").alias("n"))
    alphabet = [r[0] for r in points.orderBy(F.desc("n"), "c").limit(SYMBOLS - 2).collect()]
    counted = texts.mapInArrow(_counter(alphabet), "g int, n long").groupBy("g").agg(F.sum("n").alias("n"))
    s = SYMBOLS
    tri = scratch.save(counted.select(F.expr(f"g div {s * s}").cast("int").alias("a"), F.expr(f"g div {s} % {s}").cast("int").alias("b"), F.expr(f"g % {s}").cast("int").alias("c"), "n"))
    bi = tri.groupBy("b", "c").agg(F.count("*").alias("m"))
    uni = bi.groupBy("c").agg(F.count("*").alias("k"))
    three, two = _order(tri, ["a", "b"], "n", "3"), _order(bi, ["b"], "m", "2")
    low = np.full(s, 0.0)
    for c, k in uni.collect():  # at most SYMBOLS rows
        low[c] = k
    low = (low + 0.5) / (low.sum() + 0.5 * s)
    pair, rest = np.zeros((s, s)), np.ones(s)
    for b, c, head, more in two.select("b", "c", "head2", "rest2").collect():  # at most SYMBOLS ** 2
        pair[b, c], rest[b] = head, more
    pair += rest[:, None] * low[None, :]
    full, back = np.zeros((s, s, s), np.float32), np.ones((s, s))
    found = three.select("a", "b", "c", "head3", "rest3").toPandas()  # at most SYMBOLS ** 3
    full[found.a, found.b, found.c] = found.head3
    back[found.a, found.b] = found.rest3
    full += (back[:, :, None] * pair[None, :, :]).astype(np.float32)
    return alphabet, np.log(full).reshape(-1)


def _keys(offsets: np.ndarray, data: np.ndarray):
    """The trigram that ends at each character, over the whole alphabet, with the texts' sizes and ends."""
    points, sizes, ends = _codes(offsets, data)
    c = points.astype(np.int64) + 1
    b, a = np.zeros_like(c), np.zeros_like(c)
    b[1:], a[2:] = c[:-1], c[:-2]
    starts = ends[:-1][sizes > 0]
    b[starts] = 0
    a[starts] = 0
    a[starts[sizes[sizes > 0] > 1] + 1] = 0
    return (a << 2 * BITS) | (b << BITS) | c, sizes, ends


def _key_counts(batches):
    for batch in batches:
        for _, offsets, data in text_chunks(batch.column(0), 1 << 22):
            at, n = np.unique(_keys(offsets, data)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int64))], ["g", "n"])


def _block_keys(batches):
    """The distinct trigrams of each block (block, text) in a task."""
    held: dict[int, list[np.ndarray]] = {}
    sizes: dict[int, int] = {}
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        for block in np.unique(blocks).tolist():
            for _, offsets, data in text_chunks(batch.column(1).filter(pa.array(blocks == block)), 1 << 22):
                found = np.unique(_keys(offsets, data)[0])
                held.setdefault(block, []).append(found)
                sizes[block] = sizes.get(block, 0) + len(found)
            if sizes.get(block, 0) > HELD:
                held[block] = [np.unique(np.concatenate(held[block]))]
                sizes[block] = 0
    for block, parts in held.items():
        g = np.unique(np.concatenate(parts))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), block, np.int64)), pa.array(g)], ["block", "g"])


def _symbols(counts: DataFrame) -> DataFrame:
    symbol = lambda k: F.shiftright("g", k * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    return counts.withColumns({"a": symbol(2), "b": symbol(1), "c": symbol(0)})


def count_trigrams(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, n, a, b, c) of texts (text), dealt by trigram."""
    return scratch.save(_symbols(texts.mapInArrow(_key_counts, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))))


def log_probabilities(asked: DataFrame, tri: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, log) of distinct trigrams g by joins to the counts, dealt by trigram and context. Only tables by single symbols, which
    Unicode bounds, are broadcast. A character that trusted text lacks has the share of one unseen symbol."""
    bi = scratch.save(tri.groupBy("b", "c").agg(F.count("*").alias("m")))
    uni = bi.groupBy("c").agg(F.count("*").alias("k"))
    three, two = _order(tri, ["a", "b"], "n", "3"), _order(bi, ["b"], "m", "2")
    total, symbols = uni.agg(F.sum("k"), F.count("*")).first()
    mass = total + 0.5 * (symbols + 1)
    low = uni.select("c", ((F.col("k") + 0.5) / mass).alias("low"))
    out = _symbols(asked.select("g")).join(three.select("g", "head3").hint("merge"), "g", "left")
    out = out.join(three.select("a", "b", "rest3").distinct().hint("merge"), ["a", "b"], "left")
    out = out.join(two.select("b", "c", "head2").hint("merge"), ["b", "c"], "left")
    out = out.join(F.broadcast(two.select("b", "rest2").distinct()), "b", "left").join(F.broadcast(low), "c", "left")
    zero, one = F.lit(0.0), F.lit(1.0)
    pair = F.coalesce("head2", zero) + F.coalesce("rest2", one) * F.coalesce("low", F.lit(0.5 / mass))
    return out.select("g", F.log(F.coalesce("head3", zero) + F.coalesce("rest3", one) * pair).alias("log"))


def _score(texts: pa.Table, known: pa.Table) -> pa.Table:
    """Perplexities of a block's texts by the log-probabilities of its trigrams."""
    g, logs = known.column("g").to_numpy(), known.column("log").to_numpy()
    order = np.argsort(g, kind="stable")
    g, logs = g[order], logs[order]
    counts, worths = [np.zeros(0, np.int64)], [np.zeros(0)]
    for _, offsets, data in text_chunks(texts.column("text"), 1 << 21):
        keys, sizes, ends = _keys(offsets, data)
        at = np.searchsorted(g, keys)
        if len(keys) and (not len(g) or at.max() >= len(g) or (g[at] != keys).any()):
            raise ValueError("a block lacks trigrams of its texts: the two reads of the documents differ")
        sums = np.concatenate(([0.0], np.cumsum(logs[at]))) if len(keys) else np.zeros(1)
        total = sums[ends[1:]] - sums[ends[:-1]]
        counts.append(sizes)
        worths.append(np.where(sizes > 0, np.exp(-total / np.maximum(sizes, 1)), np.nan))
    n = np.concatenate(counts).astype(np.int64)
    worth = pa.array(np.round(np.concatenate(worths), 9), mask=n == 0)
    return pa.table([texts.column("doc_id"), texts.column("lang"), pa.array(n), worth], ["doc_id", "lang", "n_chars", "perplexity"])


def perplexity_filter(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, margin: float = 1.05) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): n_chars, perplexity, threshold, kept. labels (doc_id, quality): 1 is trusted.

    A trigram model of all characters of Unicode with modified Kneser-Ney discounts at every order is trained on all trusted
    documents; counts are summed per task and then dealt by n-gram, contexts joined by shard, and grow with trusted text. Documents
    are dealt to blocks, whose distinct trigrams are joined to the counts by shard and meet the block's texts again. Both reads of
    docs must give the same rows. A document's perplexity is per character, null
    without text. It is kept up to margin times the `quantile` of its language's trusted documents; a language without any
    takes the one of all; without trusted documents everything is kept, with null perplexity and threshold. Null
    languages are one language, texts without characters are kept. Repeated doc_ids keep their rows; other columns are
    ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "perplexity")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    trusted = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    marks = bitmap(trusted)

    def likely(batches):
        for batch in batches:
            yield marked(batch, marks)

    some = texts.select("doc_id", "text").mapInArrow(likely, "doc_id long, text string")
    chosen = scratch.save(some.join(trusted.hint("merge"), "doc_id", "left_semi").select("text"))
    tri = count_trigrams(chosen, scratch)
    scratch.drop(chosen)
    if tri.isEmpty():
        none = F.lit(None).cast("double")
        return texts.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("kept"))
    block = F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.pmod(F.xxhash64("doc_id", "text"), F.lit(BLOCKS)))
    asks = scratch.save(texts.select(block.alias("block"), "text").mapInArrow(_block_keys, "block long, g long"))
    logs = scratch.save(log_probabilities(asks.select("g").distinct(), tri, scratch))
    known = scratch.again(asks).join(logs.hint("merge"), "g").select(F.col("block").alias("of"), "g", "log")
    dealt = texts.select(block.alias("block"), "doc_id", "lang", "text").groupBy("block")
    scored = scratch.save(dealt.cogroup(known.groupBy("of")).applyInArrow(_score, "doc_id long, lang string, n_chars long, perplexity double"))
    good = scored.join(trusted, "doc_id", "left_semi").filter("perplexity is not null")
    own, everyone = _limits(good, quantile)
    everyone = F.lit(math.inf if everyone is None else everyone)
    if own.count() <= FEW:
        scored = scored.join(F.broadcast(own), "lang", "left")
    else:  # a hot language meets its limit in as many tasks as there are salts
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        wide = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        scored = scored.withColumn("salt", F.coalesce(salt, F.lit(0))).join(wide.hint("merge"), ["lang", "salt"], "left")
    out = scored.withColumn("threshold", margin * F.coalesce("own", everyone))
    return out.select("doc_id", "n_chars", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))


def _limits(good: DataFrame, quantile: float) -> tuple[DataFrame, float | None]:
    """(lang, own), and that of all: the least edge of a bin of 1e-4 in the logarithm up to which a share of `quantile` of the
    perplexities lies. Counted per bin first, so no task holds a language's documents, and the same in any partitioning."""
    bins = good.groupBy("lang", F.ceil(F.log("perplexity") * 10_000).alias("bin")).count()
    w = Window.partitionBy("lang")
    upto = bins.withColumn("upto", F.sum("count").over(w.orderBy("bin"))).withColumn("all", F.sum("count").over(w))
    own = upto.filter(F.col("upto") >= quantile * F.col("all")).groupBy("lang").agg(F.exp(F.min("bin") / 10_000).alias("own"))
    whole = bins.groupBy("bin").agg(F.sum("count").alias("count"))
    w = Window.partitionBy()  # a row per bin
    upto = whole.withColumn("upto", F.sum("count").over(w.orderBy("bin"))).withColumn("all", F.sum("count").over(w))
    return own, upto.filter(F.col("upto") >= quantile * F.col("all")).agg(F.exp(F.min("bin") / 10_000)).first()[0]
