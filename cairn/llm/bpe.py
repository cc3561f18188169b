"""Byte-level BPE: ranked merges are folded over the bytes of distinct words, with numpy or as Spark expressions."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Characters of text whose distinct words are folded together, and bytes from which on a word is merged with a heap instead.
BLOCK, LONG = 6 << 20, 200
_SHIFT = 17


@functools.lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


@functools.lru_cache(4)
def rank_map(path: str) -> tuple[list[int], list[int]]:
    """All pairs of tokens that join to a token, with its rank, as displacement_map."""
    ranks = read_ranks(path)
    pairs = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                pairs[a << _SHIFT | b] = rank
    return displacement_map(pairs)


def displacement_map(pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """Ranks of pairs (left << 17 | right) as a hash map without collisions: displacements, and slots of pair and rank.

    A pair's slot is (pair % slots + displacements[pair % len(displacements)]) % slots and holds pair << 17 | rank;
    other slots hold -1.
    """
    size, spread = _prime(int(1.4 * len(pairs)) + 11), _prime(len(pairs) // 2 + 5)
    groups: dict[int, list[int]] = {}
    for p in pairs:
        groups.setdefault(p % spread, []).append(p)
    slots, moves = [-1] * size, [0] * spread
    for g, members in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
        bases = [p % size for p in members]
        d = 0
        while True:
            at = {(b + d) % size for b in bases}
            if len(at) == len(bases) and all(slots[x] < 0 for x in at):
                break
            d += 1
        moves[g] = d
        for p in members:
            slots[(p % size + d) % size] = p << _SHIFT | pairs[p]
    return moves, slots


def _literal(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), "array<bigint>")


def fold_merges(word: Column, moves: Column, slots: Column, n_moves: int, n_slots: int) -> Column:
    """Tokens of a word given as the ranks of its bytes: the pair of least rank, the first of equals, joins until none can."""

    def rank(a: Column, b: Column) -> Column:
        pair = F.shiftleft(a.cast("long"), _SHIFT).bitwiseOR(b.cast("long"))

        def held(x: Column) -> Column:
            slot = F.get(slots, ((x % n_slots + F.get(moves, (x % n_moves).cast("int"))) % n_slots).cast("int"))
            return F.when(F.shiftright(slot, _SHIFT) == x, slot.bitwiseAND(F.lit((1 << _SHIFT) - 1)).cast("int"))

        return F.get(F.transform(F.array(pair), held), F.lit(0))

    def step(acc: Column, _: Column) -> Column:
        def join(x: Column) -> Column:
            p, r, m, at = acc["p"], acc["r"], x["m"], x["at"].cast("int")
            n = F.size(p)
            left = F.when(at > 1, F.array(rank(F.get(p, at - 2), m))).otherwise(F.array().cast("array<int>"))
            right = F.when(at + 1 < n, F.array(rank(m, F.get(p, at + 1)))).otherwise(F.array().cast("array<int>"))
            tokens = F.concat(F.slice(p, 1, at - 1), F.array(m), F.slice(p, at + 2, n))
            ranks = F.concat(F.slice(r, 1, F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, n))
            return F.struct(tokens.alias("p"), ranks.alias("r"))

        least = F.array_min(acc["r"])
        found = F.transform(F.array(least), lambda m: F.struct(m.alias("m"), F.array_position(acc["r"], m).alias("at")))
        return F.when(least.isNull(), acc).otherwise(F.get(F.transform(found, join), F.lit(0)))

    n = F.size(word)
    none = F.array().cast("array<int>")
    ranks = F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.get(word, i - 1), F.get(word, i)))
    folded = F.aggregate(F.sequence(F.lit(2), n), F.struct(word.alias("p"), F.when(n > 1, ranks).otherwise(none).alias("r")), step, lambda a: a["p"])
    return F.when(n < 2, word).otherwise(folded)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word, by a heap of pairs: n log n steps."""
    n = len(word)
    nxt, prev, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = []

    def push(i):
        j = nxt[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or end[nxt[i]] != stop:
            continue
        j = nxt[i]
        alive[j] = False
        end[i], nxt[i] = end[j], nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


@functools.lru_cache(2)
def _tables(path: str):
    ranks = read_ranks(path)
    moves, slots = (np.array(x, np.int64) for x in rank_map(path))
    return ranks, np.array([ranks[bytes([b])] for b in range(256)], np.int64), moves, slots


def _pair_ranks(left: np.ndarray, right: np.ndarray, moves: np.ndarray, slots: np.ndarray) -> np.ndarray:
    pair = left << _SHIFT | right
    slot = slots[(pair % len(slots) + moves[pair % len(moves)]) % len(slots)]
    return np.where(slot >> _SHIFT == pair, slot & ((1 << _SHIFT) - 1), _NONE)


_NONE = 1 << 40


def fold_flat(word: np.ndarray, token: np.ndarray, moves: np.ndarray, slots: np.ndarray, result: np.ndarray | None = None) -> list[tuple]:
    """Parts (word, token) of all words' tokens after all merges. word numbers the tokens' words and rises. A rank's pair joins
    to the token result[rank], or the rank itself. In each turn every word that has a pair left joins its pair of least rank."""
    done = [(word[:0], token[:0])]
    rank = np.full(len(token), _NONE, np.int64)
    if len(token):
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = _pair_ranks(token[inner], token[inner + 1], moves, slots)
    while len(token):
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        least = np.minimum.reduceat(rank, starts)
        counts = np.diff(np.concatenate((starts, [len(token)])))
        each = np.repeat(least, counts)
        open_ = each != _NONE
        if not open_.all():
            done.append((word[~open_], token[~open_]))
            token, word, rank, each = token[open_], word[open_], rank[open_], each[open_]
            if not len(token):
                break
        at = np.flatnonzero(rank == each)
        at = at[np.concatenate(([True], word[at][1:] != word[at][:-1]))]
        token[at] = each[at] if result is None else result[each[at]]
        stay = np.ones(len(token), bool)
        stay[at + 1] = False
        at = at - np.arange(len(at))
        token, word, rank = token[stay], word[stay], rank[stay]
        rank[at] = _NONE
        for near in (at[at + 1 < len(token)], at[at > 0] - 1):
            near = near[word[near] == word[near + 1]]
            rank[near] = _pair_ranks(token[near], token[near + 1], moves, slots)
    return done


def merge_words(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of words, one after the other, and where each word's begin (with the end).

    The fold of fold_merges over all words at once."""
    ranks, of, moves, slots = _tables(path)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    whole = {k: [r] for k, w in enumerate(words) if (r := ranks.get(w)) is not None}
    whole |= {int(k): merge_long(words[k], ranks) for k in np.flatnonzero(sizes >= LONG) if k not in whole}
    word = np.repeat(np.arange(len(words)), sizes)
    token = of[np.frombuffer(b"".join(words), np.uint8)]
    if whole:
        rest = np.ones(len(words), bool)
        rest[list(whole)] = False
        token, word = token[rest[word]], word[rest[word]]
    done = fold_flat(word, token, moves, slots)
    if whole:
        done.append((np.repeat(list(whole), [len(t) for t in whole.values()]), np.concatenate([np.array(t, np.int64) for t in whole.values()])))
    word, token = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(word, kind="stable")
    return token[order].astype(np.uint32), np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(words)))))


def _ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = int(sizes.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    return values[shift + np.arange(total)]


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _coder(path: str, pattern: str, block: int, with_ids: bool):
    """Texts to results, a block at a time."""

    def code(batches):
        import regex

        find = regex.compile(pattern).findall
        pieces = {v: k for k, v in read_ranks(path).items()}
        pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]

        def finish(ids, refs, numbers):
            tokens, ends = merge_words([w.encode("utf-8", "replace") for w in numbers], path)
            counts = np.diff(ends)
            rows = []
            for i, r in zip(ids, refs):
                own = _ragged(tokens, ends[r], counts[r]) if len(r) else tokens[:0]
                text = b"".join(map(pieces.__getitem__, own.tolist()))
                raw = own.astype("<u4").tobytes()
                rows.append((i, len(own), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text).hexdigest(), raw if with_ids else None, text if with_ids else None))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

        ids, refs, numbers, size = [], [], _Numbers(), 0
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                found = find(text)
                ids.append(i.as_py())
                refs.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                size += len(text)
                if size >= block:
                    yield finish(ids, refs, numbers)
                    ids, refs, numbers, size = [], [], _Numbers(), 0
        if ids:
            yield finish(ids, refs, numbers)

    return code


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True, block: int = BLOCK) -> DataFrame:
    """One row (doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded) per row of docs (doc_id, text).

    ids are unsigned little-endian 32-bit token ids, decoded the concatenated bytes of their pieces (both null unless
    with_ids). Each match of pattern is encoded by itself; a match that is a token is that token. Null text is empty and has no
    token. Repeated rows are encoded again, a null doc_id stays null, other columns are ignored, no input gives no row.

    Nothing is shuffled. A task numbers the distinct words of a block of `block` characters, folds the ranked merges over
    all of them at once, and puts the block's documents together from the words' tokens. A document's tokens are one
    value; nothing larger than a block or the longest document is held. Words of LONG bytes or more are merged by a heap,
    since a fold of n merges over n bytes takes n * n steps. fold_merges is the same fold as Spark expressions.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_coder(ranks_path, pattern, block, with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded binary")


def encode_words(words: DataFrame, ranks_path: str) -> DataFrame:
    """words (word) with tokens (array<int>), by fold_merges and a literal rank map alone."""
    ranks = read_ranks(ranks_path)
    moves, slots = rank_map(ranks_path)
    of = F.from_json(F.lit(json.dumps([ranks[bytes([b])] for b in range(256)])), "array<int>")
    known = F.hex(F.encode("word", "UTF-8"))
    codes = F.transform(F.sequence(F.lit(1), F.octet_length("word")), lambda i: F.get(of, F.conv(F.substr(known, 2 * i - 1, F.lit(2)), 16, 10).cast("int")))
    codes = F.when(F.octet_length("word") > 0, codes).otherwise(F.array().cast("array<int>"))
    return words.withColumn("bytes", codes).select("word", fold_merges(F.col("bytes"), _literal(moves), _literal(slots), len(moves), len(slots)).alias("tokens"))
