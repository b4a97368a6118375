"""Quality classifier: naive Bayes support vectors.

A text is a set of n-grams: its lower-cased words, pairs of them, and runs of one to three
word shapes (letters, digits and marks with repeats folded). The indicators, hashed to `BUCKETS`
features, are scaled by the log ratio of their smoothed counts in good and in bad texts.
A linear hinge-loss model is fitted on them by dual coordinate descent, and its margin is
turned into a probability on rows that it wasn't fitted on.

What the driver holds is bounded twice: about MAX_LABELLED labelled rows (labels.sample) and
about MAX_IDS feature ids of theirs; beyond, rows are thinned by a hash of their features.

Defined results: null and empty texts have no features and get the score of the bias;
repeated rows are scored each; a null doc_id is not held out; an empty table gives an
empty result; with no labels, or labels of one class, all scores are that class's share (1
if there are none); a doc_id of several labels counts with its largest; texts of any length
count whole; other columns, whatever their names, are neither read nor clashed with.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, binary, col, id_field, map_batches, materialize, process_cache, release, table
from .labels import MAX_LABELLED, held_out, platt, sample, sigmoid

BUCKETS = 1 << 18
ALPHA = 1.0
COST = 1.0
EPOCHS = 12
#: Feature ids of labelled rows that the driver fits on, about.
MAX_IDS = 8_000_000
THRESHOLD = 0.3
#: Words whose codes a Python worker remembers.
CACHED_WORDS = 300_000
#: Fixed value: the class of each byte; other bytes stand for themselves.
SHAPE = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)
RUNS = re.compile(rb"(.)\1+", re.S)
#: Odd multipliers that hash runs of checksums.
MIX, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Codes(dict):
    """A word's checksum, lower-cased, above that of its shape; worked out once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        shape = RUNS.sub(rb"\1", word.translate(SHAPE))
        code = zlib.crc32(word.translate(LOWER)) << 32 | zlib.crc32(shape, 1)
        if len(word) < 64:
            self[word] = code
        return code


def features(text: bytes, codes: Codes) -> np.ndarray:
    """The hashed n-grams of a text, distinct and sorted: runs of shapes are hashed by multiplying their checksums, all at once."""
    raw = text.split()
    code = np.fromiter(map(codes.__getitem__, raw), np.uint64, len(raw))
    shape, word = code & np.uint64(0xFFFFFFFF), code >> np.uint64(32)
    two = shape[:-1] * MIX + shape[1:]
    three = two[:-1] * MIX + shape[2:]
    pairs = word[:-1] * MIX + word[1:]
    runs = (np.concatenate([shape, two + np.uint64(1), three + np.uint64(2), pairs + np.uint64(3)]) * SPREAD) >> np.uint64(32)
    ids = np.concatenate([word, runs]) % np.uint64(BUCKETS)
    ids = np.sort(ids.astype(np.int32))
    return ids[np.diff(ids, prepend=-1) > 0].astype(np.int64)


def fit_hinge(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 3):
    """Dual coordinate descent for the L1-loss linear SVM; rows are feature ids of value scale/sqrt(n + 1), and a bias of value 1/sqrt(n + 1)."""
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    root = np.array([1 / np.sqrt(len(r) + 1) for r in rows])
    norm = np.array([(scale[r] @ scale[r] + 1) * q * q for r, q in zip(rows, root)]) + 1e-12
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x = scale[rows[i]]
            g = y[i] * (w[rows[i]] @ x + bias) * root[i] - 1
            if (alpha[i] <= 0 and g >= 0) or (alpha[i] >= cost[i] and g <= 0):
                continue
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i] * root[i]
                w[rows[i]] += step * x
                bias += step
                worst = max(worst, abs(g))
                alpha[i] = new
        if worst < 1e-3:
            break
    return np.append(w, bias)


class Model:
    """Weights of the scaled indicators, bias, and the two numbers of the probability."""

    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights, bias, a, b

    def state(self) -> tuple:
        """What __init__ takes: plain values, so that workers need no copy of this module to unpickle a broadcast."""
        return self.weights, self.bias, self.a, self.b

    def margin(self, ids: np.ndarray) -> float:
        return (float(self.weights[ids].sum()) + self.bias) / np.sqrt(len(ids) + 1)


def fit(rows: list[np.ndarray], y: np.ndarray, buckets: int = BUCKETS) -> Model:
    """y is 0 or 1. Every fourth row only calibrates."""
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 1.0
        p = min(max(share, 1e-4), 1 - 1e-4)
        return Model(np.zeros(buckets), 0.0, 0.0, float(np.log(p / (1 - p))))
    train = np.arange(len(rows)) % 4 != 0
    if len(set(y[train].tolist())) < 2 or len(set(y[~train].tolist())) < 2:
        train[:] = True
    part = np.flatnonzero(train)
    counts = np.full((2, buckets), ALPHA)  # of the rows that are trained on alone: the others show how sure the model may be
    for i in part:
        counts[y[i], rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    share = y[part].mean()
    cost = COST * np.where(y[part] > 0, 0.5 / share, 0.5 / (1 - share))
    w = fit_hinge([rows[i] for i in part], ratio, np.where(y[part] > 0, 1.0, -1.0), cost, EPOCHS)
    model = Model(w[:-1] * ratio, float(w[-1]), 1.0, 0.0)
    rest = np.flatnonzero(~train) if not train.all() else part
    model.a, model.b = platt(np.array([model.margin(rows[i]) for i in rest]), y[rest])
    return model


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, most_ids: int = MAX_IDS) -> Model:
    """Fit on about `bound` labelled rows and `most_ids` feature ids at most; only those ids reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for b in batches:
            ids = [features(t, codes).astype(np.int32) for t in binary(b.column("text"))]
            made = [pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("label"), *made], names=["label", "ids", "n"])

    chosen = sample(docs, labels, "quality", bound)
    rows = held = materialize(map_batches(chosen, [F.col("label"), F.col("text")], run, "label int, ids binary, n long"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    if total > most_ids:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(9), "ids"), F.lit(1 << 20)) < int(most_ids / total * (1 << 20)))
    made = rows.select("label", "ids").collect()
    release(held)
    made.sort(key=lambda r: (zlib.crc32(bytes(r["ids"])), r["label"]))  # an order that doesn't hang on partitions
    return fit([np.frombuffer(r["ids"], np.int32) for r in made], np.array([int(r["label"] > 0) for r in made], np.int64))


def scores(model: Model, texts: list[bytes | None], codes: Codes) -> np.ndarray:
    return sigmoid(model.a * np.array([model.margin(features(t or b"", codes)) for t in texts]) + model.b)


def shared_codes() -> Codes:
    return process_cache("codes").setdefault("all", Codes())


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out, score and predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = spark.sparkContext.broadcast(train(docs, table(spark, sf_dir, "labels")).state())  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*model.value)
        for b in batches:
            s = scores(fitted, binary(b.column("text")), shared_codes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    columns = [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text")]
    return map_batches(docs, columns, run, f"{id_field(docs)}, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score `threshold` or more, all columns as they came."""
    text = docs.columns.index("text")
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels).state())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*model.value)
        for b in batches:
            s = scores(fitted, binary(b.column(text)), shared_codes())
            yield b.filter(pa.array(s >= threshold))

    names = [f"c{i}" for i in range(len(docs.columns))]  # any column name passes: mapInArrow itself takes plain ones alone
    fields = [T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, docs.schema.fields)]
    plain = map_batches(docs, [col(c).alias(n) for c, n in zip(docs.columns, names)], run, T.StructType(fields))
    return plain.toDF(*docs.columns)
