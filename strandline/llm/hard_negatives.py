"""Hard-negative mining by norm-bucketed maximum-inner-product search.

Candidates are sorted by norm, largest first, into spans (range partitions) of buckets of
BUCKET rows. By Cauchy-Schwarz no score in a bucket exceeds the anchor's norm times the
bucket's largest norm. An anchor's windows each ask for the best k scores between two limits,
and what a window still needs is the larger of its lower limit and its running kth score: a
span or bucket that can't reach that is passed over.

A search has two waves. The first looks at the span of the largest norms; its kth scores
raise the limits, and the second visits the spans that the raised limits still reach. In a
wave, anchors go, in blocks of similar norms, to the spans they reach, and a span's buckets to
the blocks that reach it; a task holds one block, and buckets stream past it, so memory
doesn't grow with a span. Each visit hands on at most k rows a window.

First come the positives (one window without limits, same label), whose scores set the
windows of the negatives (other labels).

Defined results: rows with a null label, a null vector, or a null or non-finite component take
no part; shorter vectors are filled with zeros; components beyond +-4096 are taken as +-4096;
repeated rows are rows of their own, as anchors too; of equal scores and ids the row of the
larger norm comes first; a null id comes last, is never an anchor and is returned as null; an
anchor without positives or without scores in a window has no rows there; an empty table gives
an empty result; other columns are neither read nor clashed with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, release, table
from .vectors import matrix, quantised, width_of

SCALE = 256
#: Fixed values of the contract's query: positives, negatives each, and the window in hundredths of the positive's score.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 3, 50, 95
#: Rows of a bucket, anchors of a block, and anchors compared with a bucket at a time.
BUCKET, BLOCK, SLICE = 1024, 8192, 1024
#: Stands for "no limit" and "nothing found"; scores are below 2^53.
FAR = 1 << 60
#: Stands for a null id, after all others.
LAST_ID = (1 << 63) - 1
#: Norms are taken too large by this, beyond any rounding.
SLACK = 1e-9


def buckets_of(kept: DataFrame, width: int) -> DataFrame:
    """span, bucket, top (largest norm) and the bucket's rows in binary columns: rows, ids, labels, norms, q."""
    spans = max(1, int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("square").desc(), F.col("vec_id"), F.col("label"), F.col("q")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        span, done, held = TaskContext.get().partitionId(), 0, []

        def emit(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks().to_batches()[0]
            norm = np.sqrt(part.column("square").to_numpy().astype(np.float64)) * (1 + SLACK)
            flat = [np.arange(part.num_rows) + ((span << 40) + done), part.column("vec_id").to_numpy(), part.column("label").to_numpy(), norm, matrix(part.column("q"), width).astype(np.int32)]
            arrays = [pa.array([span], pa.int32()), pa.array([done // BUCKET], pa.int64()), pa.array([norm[0]]), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in flat]]
            return pa.RecordBatch.from_arrays(arrays, names=["span", "bucket", "top", "rows", "ids", "labels", "norms", "q"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BUCKET:
                whole = pa.Table.from_batches(held)
                for _ in range(whole.num_rows // BUCKET):
                    yield emit(whole.slice(0, BUCKET))
                    whole, done = whole.slice(BUCKET), done + BUCKET
                held = whole.to_batches()
        if sum(x.num_rows for x in held):
            yield emit(pa.Table.from_batches(held))

    ranged = kept.repartitionByRange(spans, *order).sortWithinPartitions(*order)
    fields = "span int, bucket long, top double, rows binary, ids binary, labels binary, norms binary, q binary"
    return materialize(ranged.select("vec_id", "label", "square", "q").mapInArrow(run, fields))


def arrays_of(kind: type, column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def anchors_of(buckets: DataFrame, every: int, width: int) -> DataFrame:
    """row, id, label, norm, q and block of the rows whose id `every` divides; blocks hold similar norms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, ids, labels = (arrays_of(np.int64, b.column(c)) for c in ("rows", "ids", "labels"))
            at = np.flatnonzero((ids % every == 0) & (ids != LAST_ID))
            q = arrays_of(np.int32, b.column("q")).reshape(-1, width)[at]
            arrays = [pa.array(x[at]) for x in (row, ids, labels, arrays_of(np.float64, b.column("norms")))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([x.tobytes() for x in q], pa.binary())], names=["row", "id", "label", "norm", "q"])

    found = materialize(buckets.select("rows", "ids", "labels", "norms", "q").mapInArrow(run, "row long, id long, label long, norm double, q binary"))
    blocks = max(1, -(-found.count() // BLOCK))
    out = materialize(found.repartitionByRange(blocks, F.col("norm").desc(), "row").withColumn("block", F.spark_partition_id()))
    release(found)
    return out


class Best:
    """The best k (score, id, row) so far of each anchor in one window: larger scores, then smaller ids, then smaller rows."""

    def __init__(self, n: int, k: int, low: np.ndarray, high: np.ndarray):
        self.score = np.full((n, k), -FAR)
        self.id, self.row = np.full((n, k), LAST_ID), np.full((n, k), LAST_ID)
        self.low, self.high = low, high

    def needs(self) -> np.ndarray:
        """The least score that can still count."""
        return np.maximum(self.low, self.score[:, -1])

    def take(self, at: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, rows: np.ndarray, place: np.ndarray) -> None:
        """scores and fits (anchors `at`, candidates); place is each candidate's rank by (id, row)."""
        kth, by, among = self.score[at, -1, None], self.id[at, -1, None], self.row[at, -1, None]
        earlier = (ids < by) | ((ids == by) & (rows < among))
        fits = fits & (scores >= self.low[at, None]) & (scores <= self.high[at, None]) & ((scores > kth) | ((scores == kth) & earlier))
        hit = np.flatnonzero(fits.any(axis=1))
        if not len(hit):
            return
        at, scores, fits, width = at[hit], scores[hit], fits[hit], len(ids)
        k = min(self.score.shape[1], width)
        order = np.where(fits, scores * width + (width - 1 - place), -(FAR << 2))  # all different
        top = np.argpartition(order, width - k, axis=1)[:, width - k :]
        found = np.take_along_axis(fits, top, 1)
        score = np.concatenate([self.score[at], np.where(found, np.take_along_axis(scores, top, 1), -FAR)], 1)
        own = np.concatenate([self.id[at], np.where(found, ids[top], LAST_ID)], 1)
        row = np.concatenate([self.row[at], np.where(found, rows[top], LAST_ID)], 1)
        first = np.lexsort((row, own, -score), axis=1)[:, : self.score.shape[1]]
        for held, new in ((self.score, score), (self.id, own), (self.row, row)):
            held[at] = np.take_along_axis(new, first, 1)


class Visit:
    """A block of anchors; buckets of one span are shown to it in order of norm."""

    def __init__(self, rows: list[tuple], k: int, same: bool, width: int):
        self.same = same
        self.row, self.label, self.norm = (np.array([r[i] for r in rows]) for i in (0, 1, 2))
        self.q = np.frombuffer(b"".join(r[3] for r in rows), np.int32).reshape(-1, width).astype(np.float64)
        windows = max(len(r[4]) for r in rows)
        low = np.array([[*r[4], *[FAR] * (windows - len(r[4]))] for r in rows], np.int64)
        high = np.array([[*r[5], *[-FAR] * (windows - len(r[5]))] for r in rows], np.int64)
        self.windows = [Best(len(rows), k, low[:, w], high[:, w]) for w in range(windows)]

    def show(self, top: float, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> None:
        most = self.norm * top
        open_to = np.array([(w.needs() <= most) & (w.low <= w.high) for w in self.windows])
        active = np.flatnonzero(open_to.any(axis=0))
        if not len(active):
            return
        place = np.empty(len(ids), np.int64)
        place[np.lexsort((rows, ids))] = np.arange(len(ids))
        other = q.T.astype(np.float64)
        for at in (active[i : i + SLICE] for i in range(0, len(active), SLICE)):
            scores = (self.q[at] @ other).astype(np.int64)  # exact: all partial sums are below 2^53
            fits = self.label[at, None] == labels
            fits = fits & (self.row[at, None] != rows) if self.same else ~fits
            for w, best in enumerate(self.windows):
                use = np.flatnonzero(open_to[w, at])
                if len(use):
                    best.take(at[use], scores[use], fits[use], ids, rows, place)

    def found(self) -> pa.RecordBatch:
        parts = []
        for w, best in enumerate(self.windows):
            i, k = np.nonzero(best.score > -FAR)
            parts.append((self.row[i], np.full(len(i), w), best.score[i, k], best.id[i, k], best.row[i, k]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts)], names=["row", "window", "score", "id", "by"])


def visits(anchors: DataFrame, buckets: DataFrame, k: int, same: bool, width: int) -> DataFrame:
    """row, window, score, id, by: the best k that each anchor finds in each span that it visits; anchors have a `span` a row."""
    pairs = anchors.select("block", "span").distinct()
    none = F.lit(None)
    queries = anchors.select("block", "span", F.lit(-1).cast("long").alias("bucket"), "row", "label", "norm", "q", "low", "high", none.cast("binary").alias("rows"), none.cast("binary").alias("ids"), none.cast("binary").alias("labels"))
    shown = buckets.join(pairs, "span").select("block", "span", "bucket", none.cast("long").alias("row"), none.cast("long").alias("label"), F.col("top").alias("norm"), "q", none.cast("array<long>").alias("low"), none.cast("array<long>").alias("high"), "rows", "ids", "labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, visit = None, [], None
        for b in batches:
            for block, span, bucket, row, label, norm, q, low, high, of_rows, ids, labels in zip(*(c.to_pylist() for c in b.columns)):
                if (block, span) != now:
                    if visit:
                        yield visit.found()
                    now, rows, visit = (block, span), [], None
                if bucket < 0:
                    rows.append((row, label, norm, q, low, high))
                    continue
                visit = visit or Visit(rows, k, same, width)
                own = np.frombuffer(of_rows, np.int64)
                visit.show(norm, own, np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(q, np.int32).reshape(len(own), width))
        if visit:
            yield visit.found()

    dealt = queries.unionByName(shown).repartition("block", "span").sortWithinPartitions("block", "span", "bucket")
    return dealt.mapInArrow(run, "row long, window long, score long, id long, by long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each (row, window), with their rank: a window has at most k rows a span."""
    w = Window.partitionBy("row", "window").orderBy(F.col("score").desc(), "id", "by")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(anchors: DataFrame, buckets: DataFrame, tops: list[float], k: int, same: bool, width: int) -> DataFrame:
    """row, window, rank, score, id: for each anchor and window the best k of the scores from low to high, of rows of the same label or of others.

    anchors has row, label, norm, q, block, and arrays low and high of its windows' limits.
    """
    need = F.array_min(F.transform("low", lambda x, i: F.when(x <= F.col("high")[i], x).otherwise(F.lit(FAR))))
    reach = F.size(F.filter(F.array(*[F.lit(t) for t in tops]), lambda t: t * F.col("norm") >= F.col("need")))

    def wave(rows: DataFrame, first: int, last: int) -> DataFrame:
        at = rows.withColumn("need", need).withColumn("reach", F.least(reach, F.lit(last))).where(F.col("reach") > first)
        at = at.withColumn("span", F.explode(F.sequence(F.lit(first), F.col("reach") - 1))).drop("need", "reach")
        return materialize(visits(at, buckets, k, same, width))

    begun = wave(anchors, 0, 1)
    if len(tops) == 1:
        return ranked(begun, k)
    kth = ranked(begun, k).where(F.col("rank") == k).groupBy("row")
    kth = kth.agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))  # an entry a window
    raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("kth", i.cast("long")), x)))
    rest = wave(materialize(anchors.join(kth, "row", "left").withColumn("low", raised).drop("kth")), 1, len(tops))
    return ranked(begun.unionByName(rest), k)


def parted(score: Column, hundredths: int, up: bool) -> Column:
    """hundredths * score / 100, rounded up or down to an integer."""
    whole = score * F.lit(-hundredths if up else hundredths)
    down = ((whole - F.pmod(whole, F.lit(100))) / F.lit(100)).cast("long")  # divides evenly: exact below 2^53
    return -down if up else down


def mine(rows: DataFrame, every: int, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, of rows (vec_id, label, embedding); anchors are the rows whose vec_id `every` divides."""
    spark = rows.sparkSession
    vec_id = F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST_ID))
    kept = quantised(rows.where("label IS NOT NULL"), scale, vec_id=vec_id, label=F.col("label").cast("long"))
    square = F.aggregate("q", F.lit(0).cast("long"), lambda s, v: s + v.cast("long") * v)
    kept = materialize(kept.withColumn("square", square))
    fields = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    width = max(1, width_of(kept))
    buckets = buckets_of(kept, width)
    release(kept)
    tops = [r["top"] for r in buckets.groupBy("span").agg(F.max("top").alias("top")).orderBy("span").collect()]  # a row a partition
    if not tops:
        return spark.createDataFrame([], fields)
    spans = buckets.select("span").distinct().orderBy("span")
    if spans.agg(F.max("span")).first()[0] != len(tops) - 1:  # empty ranges in between
        order = spark.createDataFrame([(r["span"], i) for i, r in enumerate(spans.collect())], "span int, at int")
        buckets = buckets.join(F.broadcast(order), "span").drop("span").withColumnRenamed("at", "span")
    anchors = anchors_of(buckets, every, width)
    open_window = {"low": F.array(F.lit(-FAR)), "high": F.array(F.lit(FAR))}
    near = search(anchors.withColumns(open_window), buckets, tops, positives, True, width)
    near = materialize(near.join(anchors.select("row", F.col("id").alias("anchor_id")), "row"))
    own = near.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("scores"))  # `positives` entries
    limits = {"low": F.transform("scores", lambda s: parted(s, least, True)), "high": F.transform("scores", lambda s: parted(s, most, False))}
    asking = materialize(anchors.join(own.withColumns(limits).drop("scores"), "row"))
    hard = search(asking, buckets, tops, negatives, False, width)
    pair = near.select("row", (F.col("rank") - 1).cast("long").alias("window"), "anchor_id", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    known = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return hard.join(pair, ["row", "window"]).select("anchor_id", known("positive").alias("positive_id"), "rank", known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 3 hard negatives for each of the 5 positives of every anchor (vec_id divisible by 50)."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", shifted), 50)


OP13_SQL = """WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score
  FROM kept a, kept c WHERE a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
positive AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
