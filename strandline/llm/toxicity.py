"""Toxicity by maximum-scoring segments.

Word scores are log-odds of a word's document counts in toxic and in other labelled texts,
under a Dirichlet prior shaped by the counts of all documents; words without significant
evidence get a small negative score. One linear scan over a text's scores finds every
maximal scoring segment (Ruzzo and Tompa). Scores of random texts follow an extreme-value
law: with lambda from the corpus's own word frequencies and K from the segments of clean
labelled texts, a segment of score S in n words is expected K n exp(-lambda S) times. The
evidence of a text's significant segments is summed and turned into a probability.

Defined results: null and empty texts have no segments and get the score of the bias;
repeated rows are scored each; a null doc_id is not held out; an empty table gives an
empty result; with no labels, or no toxic ones, every score is 0 or near it; other
columns are neither read nor clashed with.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_ALNUM, binary, id_field, map_batches, materialize, table
from .labels import MAX_LABELLED, held_out, platt, sample, sigmoid

THRESHOLD = 0.5
#: Model parameters. Toxic labelled texts that a word must stand in before it can count as evidence.
LEAST_TEXTS = 5
#: Standard errors by which a word's log-odds must exceed 0.
LEAST_Z = 3.0
#: Weight of the prior, in words; and what a word without evidence scores.
PRIOR = 500.0
LEAST_PRIOR = 0.5
DRIFT = -0.4
#: Standard errors that are taken off a word's log-odds.
MARGIN = 1.5
#: Segments expected this often or more by chance aren't significant.
MOST_EXPECTED = 0.5
#: lambda is held at this rate at most: with few labelled texts the law would be steeper than they can tell.
MOST_RATE = 5.0


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, stop, score), left to right, in linear time."""
    hits = np.flatnonzero(scores > 0)
    if not len(hits):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    # candidates: start, stop, sum before, sum at the end, nearest earlier one with a smaller sum before
    stack: list[tuple[int, int, float, float, int]] = []
    for i in hits.tolist():
        start, left, right = i, float(total[i]), float(total[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, i + 1, left, right, j))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r, _ in stack]


def tail_rate(values: np.ndarray, weights: np.ndarray) -> float:
    """lambda > 0 with mean exp(lambda * score) = 1, where the mean score is negative."""
    p = weights / weights.sum()
    if not (values > 0).any() or p @ values >= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    while p @ np.exp(np.minimum(hi * values, 600)) < 1:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if p @ np.exp(np.minimum(mid * values, 600)) < 1 else (lo, mid)
    return hi


class Model:
    """Word scores, the extreme-value law, and the two numbers of the probability."""

    def __init__(self, words: dict[bytes, float], rate: float, k: float = 1.0, a: float = 1.0, b: float = 0.0):
        self.words, self.rate, self.k, self.a, self.b = words, rate, k, a, b

    def state(self) -> tuple:
        """What __init__ takes: plain values, so that workers need no copy of this module to unpickle a broadcast."""
        return self.words, self.rate, self.k, self.a, self.b

    def segments(self, text: bytes) -> tuple[list[tuple[int, int, float]], int]:
        parts = text.translate(LOWER_ALNUM).split()
        get = self.words.get
        return maximal_segments(np.array([get(w, DRIFT) for w in parts], float)), len(parts)

    def significant(self, text: bytes) -> list[tuple[int, int, float]]:
        """(first word, word after the last, evidence) of each significant segment."""
        found, n = self.segments(text)
        out = []
        for a, b, s in found:
            e = np.log(self.k * n) - self.rate * s
            if e < np.log(MOST_EXPECTED):
                out.append((a, b, float(-e)))
        return out

    def evidence(self, text: bytes) -> float:
        return float(np.log1p(sum(e for _, _, e in self.significant(text))))


def count_words(df: DataFrame, keep: set[bytes] | None = None) -> DataFrame:
    """(word, texts, other) over texts: the texts with a word by label, or, for the words in `keep`, all occurrences.

    Counts are summed in each task first. The row with a null word has the totals, so that long texts don't pass for toxic ones.
    """
    labelled = keep is None
    kept = None if labelled else df.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for b in batches:
            side = b.column("label").to_pylist() if labelled else None
            for k, t in enumerate(binary(b.column("text"))):
                parts = (t or b"").translate(LOWER_ALNUM).split()
                if labelled:
                    c = int(side[k] > 0)
                    once = set(parts)
                    tables[c].update(once)
                    n[c] += len(once)
                else:
                    tables[0].update(filter(kept.value.__contains__, parts))
                    n[0] += len(parts)
        words = [None, *(tables[0].keys() | tables[1].keys())]
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, pa.binary()),
                    pa.array([n[1] if w is None else tables[1][w] for w in part], pa.int64()),
                    pa.array([n[0] if w is None else tables[0][w] for w in part], pa.int64()),
                ],
                names=["word", "texts", "other"],
            )

    columns = [F.col("label"), F.col("text")] if labelled else [F.col("text")]
    made = map_batches(df, columns, run, "word binary, texts long, other long")
    return made.groupBy("word").agg(F.sum("texts").alias("texts"), F.sum("other").alias("other"))


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Model:
    """Labels from about `bound` rows at most; prior and law from every document.

    The driver sees words that stand in LEAST_TEXTS toxic texts of the bounded sample, and one number a labelled text.
    """
    chosen = materialize(sample(docs, labels, "toxic", bound))
    counted = materialize(count_words(chosen))
    sizes = counted.where(F.col("word").isNull()).first()
    n_toxic, n_clean = (sizes["texts"], sizes["other"]) if sizes else (0, 0)
    rows = counted.where(F.col("word").isNotNull() & (F.col("texts") >= LEAST_TEXTS)).collect()
    if not rows or not n_clean:
        model = Model({}, 1.0)
        model.a, model.b = 0.0, -10.0
        return model
    words = [bytes(r["word"]) for r in rows]
    corpus = {None if r["word"] is None else bytes(r["word"]): r["other"] for r in count_words(docs, set(words)).collect()}
    all_words = max(1, corpus.get(None, 1))
    seen = np.array([max(1, corpus.get(w, 1)) for w in words], float)
    prior = PRIOR * seen / all_words + LEAST_PRIOR
    toxic = np.array([r["texts"] for r in rows], float) + prior
    clean = np.array([r["other"] for r in rows], float) + prior
    odds = np.log(toxic / np.maximum(n_toxic + 2 * prior - toxic, 0.5)) - np.log(clean / np.maximum(n_clean + 2 * prior - clean, 0.5))
    z = odds / np.sqrt(1 / toxic + 1 / clean)
    sure = z >= LEAST_Z
    score = np.where(sure, odds - odds / z * MARGIN, DRIFT)
    values = np.append(score[sure], DRIFT)
    weights = np.append(seen[sure], max(1.0, all_words - seen[sure].sum()))
    model = Model({w: float(s) for w, s in zip(words, score) if s > 0}, min(tail_rate(values, weights), MOST_RATE))
    shared = docs.sparkSession.sparkContext.broadcast(model.state())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            found = [m.segments(t) for t in binary(b.column("text"))]
            parts = [np.array([s for _, _, s in f], np.float64).tobytes() for f, _ in found]
            n = [size for _, size in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), pa.array(n, pa.int64()), pa.array(parts, pa.binary())],
                names=["label", "n", "segments"],
            )

    fits = map_batches(chosen, [F.col("label"), F.col("text")], run, "label int, n long, segments binary").collect()
    y = np.array([int(r["label"] > 0) for r in fits])
    n = np.array([r["n"] for r in fits], float)
    segments = [np.frombuffer(r["segments"], np.float64) for r in fits]
    # K: segments seen in clean texts against those expected at K = 1
    low = min((float(s.min()) for s in segments if len(s)), default=1.0)
    in_clean = sum(len(s) for s, c in zip(segments, y) if not c)
    model.k = max(1e-9, (in_clean + 0.5) / max(1.0, n[y == 0].sum() * np.exp(-model.rate * low)))
    logs = [np.log(model.k * max(m, 1)) - model.rate * s for s, m in zip(segments, n)]
    x = np.array([np.log1p(sum(-e for e in l.tolist() if e < np.log(MOST_EXPECTED))) for l in logs])
    model.a, model.b = platt(x, y)
    return model


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out, score and predicted of every document, and the words its passages span."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = spark.sparkContext.broadcast(train(docs, table(spark, sf_dir, "labels")).state())  # words of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*model.value)
        for b in batches:
            found = [m.significant(t or b"") for t in binary(b.column("text"))]
            x = np.array([np.log1p(sum(e for _, _, e in f)) for f in found])
            s = sigmoid(m.a * x + m.b)
            spans = [" ".join(f"{a}-{z}" for a, z, _ in f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(spans, pa.string())],
                names=["doc_id", "held_out", "score", "predicted", "passages"],
            )

    columns = [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text")]
    return map_batches(docs, columns, run, f"{id_field(docs)}, held_out boolean, score double, predicted int, passages string")
