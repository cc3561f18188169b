"""Packing by cutting-stock column generation."""

from __future__ import annotations

import functools
import itertools
import json
import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import bpe
from .common import Scratch

#: Characters of text whose distinct chunks are encoded once, chunks that are folded together (which bounds the fold's arrays), bytes
#: from which on a word goes to the library instead, and most simplex rounds (any round's basis packs everything).
BLOCK, FOLD, LONG, ROUNDS = 12 << 20, 1 << 14, 200, 2000


@functools.lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _unsure(character: str) -> bool:
    """Whether Python's tables and the library's may treat a character apart: controls, and code points without a character in
    Python's version of Unicode."""
    return character < " " or unicodedata.category(character) in ("Cn", "Cs")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class WordEncoder:
    """Token ids of chunks between white space, for lower-casing BPE with word ends (NFC, lower case, then byte-level merges).

    Neither normal form, lower case nor tokens cross white space, so a text's ids are its chunks' ids one after the other."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"]:
            raise ValueError(f"{path} is no lower-casing byte-level BPE with word ends")
        vocab, letters = model["vocab"], _byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + end] for x in letters], np.int64)
        pairs, joined = {}, []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs.setdefault(vocab[a] << bpe._SHIFT | vocab[b], rank)
            joined.append(vocab[a + b])
        self.result = np.array(joined, np.int64)
        self.moves, self.slots = (np.array(x, np.int64) for x in bpe.displacement_map(pairs))
        self.words = regex.compile(steps[0]["pattern"]["Regex"] + "| ").findall
        self.space = regex.compile(r"\s+")
        #: Texts with a special token's string go to the library as a whole, whatever their case.
        names = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, names)) or "(?!)", regex.IGNORECASE)
        #: What all of those begin with, as far as it has no case: a quick way to say that a text has none.
        self.mark = "".join(itertools.takewhile(lambda c: c.lower() == c.upper(), os.path.commonprefix(names)))
        self.path = path

    def split(self, text: str) -> list[str]:
        """At Unicode white space; str.split() also takes U+001C to U+001F for it, which the tokenizer does not."""
        return [x for x in self.space.split(text) if x] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, one after the other, and where each chunk's begin (with the end)."""
        parts = [self._fold(chunks[a : a + FOLD]) for a in range(0, len(chunks), FOLD)]
        none = np.empty(0, np.uint32)
        return np.concatenate([none, *(t for t, _ in parts)]), np.concatenate(([0], np.cumsum(np.concatenate([none, *(n for _, n in parts)]), dtype=np.int64)))

    def _fold(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, one after the other, and how many each has."""
        text = " ".join(chunks)
        alone, odd = set(), set(filter(_unsure, set(text)))
        if odd or max(map(len, chunks), default=0) >= LONG:
            alone = {k for k, c in enumerate(chunks) if len(c) >= LONG or not odd.isdisjoint(c)}
            text = " ".join("" if k in alone else c for k, c in enumerate(chunks))
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # no final form of sigma
        # Words and the spaces between chunks, each ended by a line break.
        codes = np.frombuffer("\n".join([*self.words(text.lower()), ""]).encode("utf-8", "replace"), np.uint8)
        stop = codes == 10
        of_word = np.cumsum(stop) - stop
        chunk = np.cumsum(codes[np.flatnonzero(stop) - 1] == 32) if len(codes) else np.empty(0, np.int64)
        tokens = self.inner[codes]
        ends = np.flatnonzero(stop) - 1
        tokens[ends] = self.last[codes[ends]]
        inside = ~stop & (codes != 32)
        word_of = of_word[inside]
        done = bpe.fold_flat(word_of, tokens[inside], self.moves, self.slots, self.result)
        word, token = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        of, token = chunk[word[order]], token[order]
        if alone:
            tok = _tokenizer(self.path)
            more = [(k, tok.encode(chunks[k], add_special_tokens=False).ids) for k in sorted(alone)]
            of = np.concatenate([of, *(np.full(len(ids), k) for k, ids in more)]).astype(np.int64)
            token = np.concatenate([token, *(np.array(ids, np.int64) for _, ids in more)]).astype(np.int64)
            order = np.argsort(of, kind="stable")
            of, token = of[order], token[order]
        return token.astype(np.uint32), np.bincount(of, minlength=len(chunks))


def _cutter(path: str, capacity: int, end: int, with_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def cut(batches):
        encoder = WordEncoder(path)
        last = np.array([end], np.uint32)

        def finish(docs, refs, numbers):
            tokens, ends = encoder.encode(list(numbers))
            counts = np.diff(ends)
            rows = []
            for i, r in zip(docs, refs):
                if isinstance(r, str):
                    own = np.array(_tokenizer(path).encode(r, add_special_tokens=False).ids, np.uint32)
                else:
                    own = bpe._ragged(tokens, ends[r], counts[r]) if len(r) else tokens[:0]
                ids = np.concatenate((own, last)).astype("<u4")
                for a in range(0, len(ids), capacity):
                    raw = ids[a : a + capacity].tobytes()
                    rows.append((i, a, len(raw) // 4, zlib.crc32(raw), len(ids), raw if with_ids else None))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

        docs, refs, numbers, size = [], [], bpe._Numbers(), 0
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                docs.append(i.as_py())
                if encoder.mark in text and encoder.special.search(text):
                    refs.append(text)
                else:
                    chunks = encoder.split(text)
                    refs.append(np.fromiter(map(numbers.__getitem__, chunks), np.int32, len(chunks)))
                size += len(text)
                if size >= BLOCK:
                    yield finish(docs, refs, numbers)
                    docs, refs, numbers, size = [], [], bpe._Numbers(), 0
        if docs:
            yield finish(docs, refs, numbers)

    return cut


def best_pattern(worth: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern of most worth, and its count of each class."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = int(np.searchsorted(sizes, c, "right"))
        best[c] = best[c - 1]
        if fit:
            tries = best[c - sizes[:fit]] + worth[:fit]
            k = int(tries.argmax())
            if tries[k] > best[c] + 1e-12:
                best[c], take[c] = tries[k], k
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        k = take[c]
        if k < 0:
            c -= 1
        else:
            pattern[k] += 1
            c -= sizes[k]
    return float(best[capacity]), pattern


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({class: number}, times) that hold exactly `counts` pieces of each class, a class being its size.

    The linear program over all patterns is solved by column generation (revised simplex; the knapsack prices columns).
    Its rounding errors could cost a sequence, never a piece: counts are kept in whole numbers.
    Times are rounded down, and what is left, a few pieces for each pattern, goes largest first; so does all, if that takes fewer sequences.
    """
    sizes = np.array(sorted(s for s, n in counts.items() if n), np.int64)
    if not len(sizes):
        return []
    need = np.array([counts[int(s)] for s in sizes], float)
    m = len(sizes)
    columns = [np.eye(m, dtype=np.int64)[i] * (capacity // sizes[i]) for i in range(m)]
    inverse = np.diag(1.0 / np.array([c.sum() for c in columns], float))
    x = inverse @ need
    for _ in range(ROUNDS):
        prices = inverse.sum(axis=0)
        gain, pattern = best_pattern(np.maximum(prices, 0), sizes, capacity)
        total = float(prices @ need)
        if total - total / gain <= max(0.5, 5e-4 * total):  # the optimum is no less than total / gain (Farley's bound)
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        columns[leave] = pattern
        inverse[leave] /= step[leave]
        others = np.arange(m) != leave
        inverse[others] -= np.outer(step[others], inverse[leave])
        x = np.maximum(inverse @ need, 0)
    left = need.astype(np.int64)
    plan = []
    for c, times in sorted(zip(columns, np.floor(x + 1e-9).astype(np.int64)), key=lambda p: -p[1]):
        times = int(min(times, *(left[k] // c[k] for k in np.flatnonzero(c)))) if times else 0
        if times > 0:
            left -= c * times
            plan.append(({int(sizes[k]): int(c[k]) for k in np.flatnonzero(c)}, times))
    plan += _greedy(left, sizes, capacity)
    whole = _greedy(need.astype(np.int64), sizes, capacity)
    return min(plan, whole, key=lambda p: sum(t for _, t in p))


def _greedy(left: np.ndarray, sizes: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns filled largest first, each taken as often as the pieces left allow."""
    plan = []
    while left.any():
        room, pattern = capacity, {}
        for k in np.flatnonzero(left)[::-1]:
            if n := min(int(left[k]), room // int(sizes[k])):
                pattern[k] = n
                room -= n * int(sizes[k])
        times = min(int(left[k]) // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= n * times
        plan.append(({int(sizes[k]): n for k, n in pattern.items()}, times))
    return plan


def pack_pieces(pieces: DataFrame, key: list[str], capacity: int = 4096, width: int = 8) -> DataFrame:
    """Adds sequence_id and offset to pieces (length from 1 to capacity, key: columns that tell pieces apart).

    Lengths are rounded up to classes of `width` tokens; their histogram, at most capacity / width rows, reaches the driver,
    which plans patterns. Pieces are ranked within class and salt and so need no task to hold a class; a table of
    runs of ranks, whose size depends on the number of classes alone, says which place of which pattern a rank takes.
    """
    units = capacity // width
    classed = pieces.withColumn("class", F.ceil(F.col("length") / width).cast("int"))
    found = dict(classed.groupBy("class").count().collect())
    salts = 64 + max(found.values(), default=0) // 100_000
    runs, sequence = [], 0
    used = dict.fromkeys(found, 0)
    for pattern, times in plan_patterns(found, units):
        slot = 0
        for size, n in sorted(pattern.items(), reverse=True):
            runs.append((size, used[size], used[size] + n * times, n, sequence, slot))
            used[size] += n * times
            slot += n
        sequence += times
    assert used == found
    spark = pieces.sparkSession
    table = spark.createDataFrame(runs, "run_class int, low long, high long, each int, first long, slot int")
    salted = classed.withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(salts)).cast("int"))
    held = salted.groupBy("class", "salt").agg(F.count("*").alias("n"))
    base = held.select(F.col("class").alias("base_class"), F.col("salt").alias("base_salt"), (F.sum("n").over(Window.partitionBy("class").orderBy("salt")) - F.col("n")).alias("base"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("class", "salt").orderBy(*key)) - 1)
    ranked = ranked.join(base, (F.col("class") == F.col("base_class")) & (F.col("salt") == F.col("base_salt"))).withColumn("rank", F.col("rank") + F.col("base"))
    # Runs number a few for each of at most `units` classes, whatever the input.
    placed = ranked.join(F.broadcast(table), (F.col("class") == F.col("run_class")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    at = F.col("rank") - F.col("low")
    placed = placed.withColumn("sequence_id", F.col("first") + F.expr("(rank - low) div each")).withColumn("place", F.col("slot") + at % F.col("each"))
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end: int = 2, with_ids: bool = True) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset.

    A document's ids (null text is empty) are those of the tokenizers library without added special tokens, and end with `end`. Documents of more than `capacity` ids are cut every `capacity`,
    others stay whole. ids are little-endian unsigned 32-bit (null unless with_ids). Rows of one doc_id, or of none, are
    documents of their own. An empty table gives no row; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = texts.mapInArrow(_cutter(tokenizer_path, capacity, end, with_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    pieces = scratch.save(pieces if with_ids else pieces.drop("ids"))
    return pack_pieces(pieces, ["doc_id", "start", "ids_crc32"], capacity)
