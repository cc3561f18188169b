"""Scoring of texts by an injected model, in Arrow batches ordered by length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.functions import text as T

#: What a scorer is: texts to an array (n, 3) of probabilities or logits in the model's order of labels.
Scorer = Callable[[list[str]], np.ndarray]
#: What a measure of length is, in words, tokens or characters.
Measure = Callable[[str], int]
COLUMNS = "p_neg double, p_neu double, p_pos double"


def count_words(text: str) -> int:
    return len(text.split())


def pieces(text: str, limit: int, measure: Measure = count_words) -> list[str]:
    """Sentences packed greedily into chunks of at most `limit` by an injected measure; a longer sentence is cut at words, a
    longer word halved until its parts fit. Nothing is lost."""
    import re

    def fitting(unit: str) -> Iterator[str]:
        if measure(unit) <= limit or len(unit) <= 1:
            yield unit
            return
        words = unit.split()
        if len(words) > 1:
            now: list[str] = []
            for w in words:
                if now and measure(" ".join([*now, w])) > limit:
                    yield from fitting(" ".join(now)) if len(now) == 1 else iter([" ".join(now)])
                    now = []
                now.append(w)
            yield from fitting(" ".join(now)) if len(now) == 1 else iter([" ".join(now)])
        else:
            yield from fitting(unit[: len(unit) // 2])
            yield from fitting(unit[len(unit) // 2 :])

    out: list[str] = []
    for sentence in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'])", text):
        for unit in fitting(sentence.strip()) if sentence.strip() else ():
            if out and measure(out[-1] + " " + unit) <= limit:
                out[-1] += " " + unit
            else:
                out.append(unit)
    return out


def by_length(texts: list[str], score: Scorer, batch: int, measure: Measure = count_words) -> np.ndarray:
    """Scores of texts, asked in batches of like length and put back in order."""
    order = np.argsort([measure(t) for t in texts], kind="stable")
    found = [np.asarray(score([texts[i] for i in order[a : a + batch]]), float) for a in range(0, len(texts), batch)]
    out = np.empty((len(texts), 3))
    if found:
        out[order] = np.vstack(found)
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def score_texts(df: DataFrame, text: str, load: Callable[[], Scorer], labels: dict[int, str] | None = None, logits: bool = False, batch: int = 16, limit: int = 512, measure: Measure = count_words) -> DataFrame:
    """df with p_neg, p_neu, p_pos, net_tone, n_tokens, n_chunks of its texts; null without text.

    load() gives a task its model once. Texts are cut into pieces of at most `limit`, the pieces of an Arrow batch are scored by
    length, and a text's distribution is its pieces' mean by tokens. labels names the model's outputs, in any order."""
    order = T.label_order(labels) if labels else (0, 1, 2)
    at = df.columns.index(text)
    names = ["p_neg", "p_neu", "p_pos", "n_tokens", "n_chunks"]
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    schema = StructType([*df.schema.fields, *(StructField(c, DoubleType() if c[0] == "p" else LongType()) for c in names)])

    def run(batches):
        score = None
        for b in batches:
            score = score or load()
            cut = [pieces(t or "", limit, measure) for t in b.column(at).to_pylist()]
            flat = [c for cs in cut for c in cs]
            found = by_length(flat, score, batch, measure)[:, list(order)]
            found = softmax(found) if logits and len(found) else found
            weight = np.array([measure(c) for c in flat], float)
            of = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
            total = np.bincount(of, weight, len(cut))
            none = total <= 0
            shares = [pa.array(np.bincount(of, found[:, k] * weight, len(cut)) / np.where(none, 1, total), mask=none) for k in range(3)]
            counts = [pa.array(total.astype(np.int64)), pa.array([len(c) for c in cut], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *shares, *counts], [*b.schema.names, *names])

    return df.mapInArrow(run, schema).withColumn("net_tone", F.col("p_pos") - F.col("p_neg"))


def score_sentences(utterances: DataFrame, key: list[str], text: str, load: Callable[[], Scorer], **options) -> DataFrame:
    """A row per sentence, numbered within its utterance, with its scores."""
    rows = utterances.select(*key, F.posexplode(T.sentences(F.col(text))).alias("sentence_idx", "sentence"))
    return score_texts(rows, "sentence", load, **options)


def lexicon_scorer(positive: list[str], negative: list[str]) -> Callable[[], Scorer]:
    """A loader of a word-list scorer, for tests and baselines."""
    pos, neg = frozenset(w.lower() for w in positive), frozenset(w.lower() for w in negative)

    def load() -> Scorer:
        def score(texts: list[str]) -> np.ndarray:
            out = []
            for t in texts:
                words = t.lower().split()
                p, n = (sum(w in s for w in words) / max(1, len(words)) for s in (pos, neg))
                out.append((n, 1 - n - p, p))
            return np.array(out).reshape(-1, 3)

        return score

    return load


def measure_speed(texts: list[str], score: Scorer, sizes: tuple[int, ...] = (16, 32, 64)) -> pd.DataFrame:
    """Texts per second by batch size, on the driver: a harness for choosing `batch`."""
    import time

    rows = []
    for size in sizes:
        start = time.perf_counter()
        by_length(texts, score, size)
        rows.append((size, len(texts) / max(time.perf_counter() - start, 1e-9)))
    return pd.DataFrame(rows, columns=["batch", "texts_per_second"])
