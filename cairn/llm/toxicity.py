"""Toxicity by Levenshtein automata over a lexicon trie and the context of each match."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import MARKS, Scratch, bitmap, bounded_batches, marked

#: A term needs this many contexts (words before it, hashed to 64) in toxic documents, and this share of them at equal numbers
#: of toxic and clean documents. Copies of one document repeat its contexts, so they don't make its words terms.
CONTEXTS, PURITY = 6, 0.97
#: Most labelled rows that the regression is fitted on.
MOST_ROWS = 50_000
#: Lengths of beginnings of words that may be terms, the least length of a term that takes an edit, and words on either side of
#: a match that are its context.
STEMS, FUZZY, WINDOW = (4, 5, 6), 5, 6
#: Share of a beginning's toxic documents from which on one word has it to itself, and is the term instead.
ALONE = 0.8
#: Share of clean labelled documents that may hold a word one edit from a term which takes edits.
CONFUSED = 0.002
#: What a match with an edit and a quoted one count beside an exact, unquoted one. Set, not learned: labels may have neither.
EDITED, QUOTED = 0.75, 0.2
#: Words whose kind or terms a task remembers, and states that an automaton makes, before it starts anew.
WORDS, STATES = 1 << 16, 1 << 14
QUOTES = "\"“”„«»‘’'"
#: Of a document: its matches' weight, the densest run of unquoted ones, and their weight among its words.
FEATURES = ("weight", "dense", "share")
#: Beside the features, numbers of matches by kind: they don't enter the score.
KINDS = ("exact", "edited", "quoted")


def normal(word: str) -> str:
    """Lower case, without what is neither letter nor digit at either end."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b].lower()


class Automaton:
    """The union of the terms' Levenshtein automata, walked along the lexicon's trie and made deterministic as words ask.

    terms: each with whether it takes an edit. A term that ends in `*` is a beginning: any further letters match."""

    def __init__(self, terms: dict[str, bool]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, bool] = {}
        self.open: set[int] = set()
        for term, takes_edit in terms.items():
            node = 0
            for ch in term.removesuffix("*"):
                node = self.children[node].setdefault(ch, len(self.children))
                if node == len(self.children):
                    self.children.append({})
            if term.endswith("*"):
                self.open.add(node)
            self.ends[node] = self.ends.get(node, False) or takes_edit
        self._restart()

    def _restart(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, nodes: set) -> int:
        nodes = nodes | {(c, 1) for n, e in nodes if e == 0 for c in self.children[n].values()}
        key = frozenset(x for x in nodes if x[1] == 0 or (x[0], 0) not in nodes)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
        return self.states[key]

    def _step(self, state: int, ch: str) -> int:
        after = set()
        for n, e in self.sets[state]:
            if ch in self.children[n]:
                after.add((self.children[n][ch], e))
            if n in self.open:
                after.add((n, e))
            if e == 0:
                after.add((n, 1))
                after.update((c, 1) for c in self.children[n].values())
        return self._state(after)

    def _walk(self, word: str) -> frozenset:
        if len(self.sets) > STATES:
            self._restart()
        state = self.start
        for ch in word:
            nxt = self.steps[state].get(ch)
            if nxt is None:
                nxt = self.steps[state][ch] = self._step(state, ch)
            state = nxt
            if not self.sets[state]:
                break
        return self.sets[state]

    def edits(self, word: str) -> int | None:
        """0 for a term, 1 for a word one edit from a term that takes one, else null."""
        found = [e for n, e in self._walk(word) if n in self.ends and (e == 0 or self.ends[n])]
        return min(found) if found else None


class Matches(dict):
    """Kinds of words: 0 none, 1 a term, 2 a term with one edit. Forgets all when large."""

    def __init__(self, terms: dict[str, bool]) -> None:
        self.automaton = Automaton(terms)

    def __missing__(self, word: str) -> int:
        if len(self) > WORDS:
            self.clear()
        plain = normal(word)
        e = self.automaton.edits(plain) if plain else None
        self[word] = kind = 0 if e is None else e + 1
        return kind


def features(text: str, kinds: Matches) -> list[float]:
    """The values of FEATURES and KINDS. A match is quoted if a word of its window before it, or itself, begins with a quotation
    mark and one after it, or itself, ends with one."""
    words = text.split()
    hits = [i for i, k in enumerate(map(kinds.__getitem__, words)) if k]
    weight, counts, sharp = 0.0, [0, 0, 0], []
    for i in hits:
        edited = kinds[words[i]] == 2
        worth = EDITED if edited else 1.0
        before, after = words[max(0, i - WINDOW) : i + 1], words[i : i + WINDOW + 1]
        if any(w[0] in QUOTES for w in before) and any(w.rstrip(".,;:!?")[-1:] in QUOTES and w.rstrip(".,;:!?") for w in after):
            counts[2] += 1
            worth *= QUOTED
        else:
            counts[edited] += 1
            sharp.append(i)
        weight += worth
    dense = near = 0
    for at, i in enumerate(sharp):
        near = max(near, at)
        while near + 1 < len(sharp) and sharp[near + 1] - i <= 2 * WINDOW:
            near += 1
        dense = max(dense, near - at)
    return [float(np.log1p(weight)), float(np.log1p(dense)), weight / max(1, len(words)) * 100, *map(float, counts)]


def _term_bit(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) % MARKS


def _word_counts(marks: np.ndarray | None = None):
    """mapInArrow function of texts: per word or stem (with `*`) its contexts as bits, and documents. With marks, only marked terms."""
    schema = pa.schema([("term", pa.string()), ("mark", pa.int64()), ("bits", pa.int64()), ("n", pa.int64())])

    def count(batches):
        held: dict[str, list[int]] = {}
        known: dict[str, tuple] = {}

        def terms(word: str) -> tuple:
            """A word as it counts for the next one's context, and its terms."""
            plain = normal(word)
            out = (plain, *(plain[:k] + "*" for k in STEMS if len(plain) > k)) if len(plain) >= 3 else ()
            if marks is not None:
                out = tuple(t for t in out if marks[(b := _term_bit(t)) >> 5] >> np.uint32(b & 31) & 1)
            if len(known) > WORDS:
                known.clear()
            known[word] = found = (1 << (zlib.crc32(plain.encode("utf-8", "replace")) & 63), out)
            return found

        def flush():
            keys = list(held)
            bits = [held[k][0] - (1 << 64) * (held[k][0] >= 1 << 63) for k in keys]
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([_term_bit(k) for k in keys], pa.int64()), pa.array(bits, pa.int64()), pa.array([held[k][1] for k in keys], pa.int64())], schema=schema)
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                seen: dict[str, int] = {}
                last = 1
                for word in (text.as_py() or "").split():
                    bit, own = known.get(word) or terms(word)
                    for t in own:
                        seen[t] = seen.get(t, 0) | last
                    last = bit
                for term, bits in seen.items():
                    row = held.setdefault(term, [0, 0])
                    row[0] |= bits
                    row[1] += 1
                if len(held) > 3 * WORDS:
                    yield flush()
        yield flush()

    return count


def _choose(found: dict[str, int]) -> list[str]:
    """Terms of found (term, toxic documents) without beginnings that stand for one word (ALONE), and without terms that a shorter
    beginning covers."""
    top: dict[str, int] = {}
    for t, n in found.items():
        if not t.endswith("*"):
            for k in STEMS:
                top[t[:k]] = max(n, top.get(t[:k], 0))
    heads = {t[:-1] for t, n in found.items() if t.endswith("*") and top.get(t[:-1], 0) < ALONE * n}
    bare = [t for t in found if not t.endswith("*")] + [h + "*" for h in heads]
    return sorted(t for t in bare if not any(t[:k] in heads for k in range(1, len(t.removesuffix("*")) + (not t.endswith("*")))))


def _confusions(terms: list[str]):
    """mapInArrow function of texts: for each text the terms of which it has a word at one edit, but no match."""

    def confused(batches):
        plain = [t for t in terms if len(t.removesuffix("*")) >= FUZZY]
        whole, near = Matches(dict.fromkeys(terms, False)), Automaton(dict.fromkeys(plain, True))
        names = {}
        for t in plain:
            node = 0
            for ch in t.removesuffix("*"):
                node = near.children[node][ch]
            names.setdefault(node, []).append(t)
        known: dict[str, tuple] = {}

        def of(word: str) -> tuple:
            if len(known) > WORDS:
                known.clear()
            text = normal(word)
            found = () if not text or whole[word] else tuple({t for n, e in near._walk(text) if e and n in near.ends for t in names[n]})
            known[word] = found
            return found

        for batch in batches:
            held: dict[str, int] = {}
            for text in batch.column(0):
                hits = set()
                for word in (text.as_py() or "").split():
                    found = known.get(word)
                    hits.update(of(word) if found is None else found)
                for t in hits:
                    held[t] = held.get(t, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "n"])

    return confused


def learn_lexicon(texts: DataFrame, scratch: Scratch) -> dict[str, bool]:
    """Terms of texts (text, toxic), all that reach CONTEXTS and PURITY, each with whether it takes an edit: those of FUZZY letters
    or more of which hardly a clean document holds a word at one edit (CONFUSED). Counts cover all rows: those of toxic texts find
    candidates, those of clean ones are of candidates alone. The lexicon, which grows with the vocabulary, and a bitmap of
    fixed size reach the driver; tasks get the whole lexicon and build its trie."""
    numbers = dict(texts.groupBy("toxic").count().collect())
    n1, n0 = numbers.get(1, 0), numbers.get(0, 0)
    if not n1 or not n0:
        return {}
    schema = "term string, mark long, bits long, n long"
    toxic = texts.filter("toxic = 1").select("text").mapInArrow(_word_counts(), schema)
    toxic = toxic.groupBy("term", "mark").agg(F.bit_count(F.bit_or("bits")).alias("contexts"), F.sum("n").alias("toxic")).filter(F.col("contexts") >= CONTEXTS)
    toxic = scratch.save(toxic)
    clean = texts.filter("toxic = 0").select("text")
    counts = clean.mapInArrow(_word_counts(bitmap(toxic, "mark")), schema).groupBy("term").agg(F.sum("n").alias("clean"))
    sums = toxic.join(counts.hint("merge"), "term", "left").fillna(0, ["clean"])
    share = (F.col("toxic") / n1) / (F.col("toxic") / n1 + (F.col("clean") + 0.5) / n0)
    terms = _choose(dict(sums.filter(share >= PURITY).select("term", "toxic").collect()))
    near = dict(clean.mapInArrow(_confusions(terms), "term string, n long").groupBy("term").agg(F.sum("n")).collect())  # of terms
    return {t: len(t.removesuffix("*")) >= FUZZY and near.get(t, 0) <= CONFUSED * n0 for t in terms}


def _reader(lexicon, carry: tuple[str, ...]):
    def read(batches):
        kinds, names = Matches(lexicon.value), (*FEATURES, *KINDS)
        for batch in batches:
            rows = np.array([features(t or "", kinds) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *(pa.array(rows[:, i]) for i in range(len(names)))], [*carry, *names])

    return read


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights, the last of them constant, by Newton's method with a ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + (ridge * len(x) / 100 + 1e-6) * np.eye(len(w)), x.T @ (y - p) - ridge * len(x) / 100 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """fit_logistic() with no weight of a feature below zero: more matches never make a document cleaner."""
    use = np.ones(x.shape[1], bool)
    while True:
        w = fit_logistic(x[:, use], y)
        if (w[:-1] >= 0).all():
            out = np.zeros(x.shape[1] + 1)
            out[np.append(use, True)] = w
            return out
        use[np.flatnonzero(use)[w[:-1] < 0]] = False


def misspelled(x: np.ndarray) -> np.ndarray:
    """Features of documents as if every match had an edit: toxic ones teach the fit what misspelled terms are worth."""
    return np.column_stack([np.log1p(EDITED * np.expm1(x[:, 0])), x[:, 1], EDITED * x[:, 2]])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _judge(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The columns `carry` of docs (doc_id long, text string), the features, score and predicted."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("toxic")).filter(~held_out(F.col("doc_id")))
    marks = bitmap(known.select(F.col("doc_id").cast("long").alias("doc_id")))

    def labelled(batches):
        for batch in batches:
            yield marked(batch, marks)

    some = docs.select("doc_id", "text").mapInArrow(labelled, "doc_id long, text string")
    taught = scratch.save(some.join(known.hint("merge"), "doc_id").select("text", "toxic"))
    lexicon = docs.sparkSession.sparkContext.broadcast(learn_lexicon(taught, scratch))
    scratch.drop(taught)
    schema = StructType([docs.schema[c] for c in carry] + [StructField(f, DoubleType()) for f in (*FEATURES, *KINDS)])
    rows = scratch.save(docs.mapInArrow(_reader(lexicon, carry), schema))
    sample = rows.select("doc_id", *FEATURES).join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(MOST_ROWS).select(*FEATURES, "toxic").toPandas()
    y = sample["toxic"].to_numpy(float)
    if len(y) and 0 < y.sum() < len(y):
        x = sample[list(FEATURES)].to_numpy(float)
        more = misspelled(x[(y == 1) & (x[:, 0] > 0)])
        w = fit_rising(np.vstack([x, more]), np.append(y, np.ones(len(more))))
        z = F.lit(float(w[-1]))
        for f, k in zip(FEATURES, w):
            z = z + F.col(f) * float(k)
        score = F.round(1 / (1 + F.exp(-z)), 9)
    else:
        score = F.lit(float(y.mean()) if len(y) else 0.0)
    return rows.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (doc_id, held_out, score, predicted, features) per row of docs (doc_id, text).

    Learns from labels (doc_id, toxic) whose crc32(doc_id as text) mod 5 is not 0: the lexicon from all of their documents
    (words and beginnings of words that stand in many contexts of toxic documents and hardly in clean ones), the weights of
    a logistic regression on match features from at most MOST_ROWS of them, those of the smallest hashes. A match is a term or a
    word one edit from one that takes edits, which counts EDITED; in its window of words it is quoted, if quotation marks open
    before and close after it, and then counts QUOTED of that, or abuse. The fit sees each toxic document with matches a second
    time with all its terms misspelled. Null and empty texts have no match. Without labels of both kinds all scores are the share of
    toxic labels, 0 without any. Repeated doc_ids keep their rows; a null doc_id is not held out and has no label;
    other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return _judge(rows, labels, ("doc_id",)).select("doc_id", out, "score", "predicted", *FEATURES, *KINDS)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, others) that score_toxicity() does not predict toxic, with all their columns.

    The verdict is found beside each row and decides that row alone: null and repeated doc_ids need no join, and columns of
    any name come through. The scored rows are written once, since the weights are known only when features are."""
    others = F.struct(F.col("doc_id"), *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), others.alias("row"))
    kept = _judge(rows, labels, ("doc_id", "text", "row")).filter("predicted = 0")
    return kept.select(*("text" if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
