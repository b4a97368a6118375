"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Weights and sizes give every source a target in words, at most `most` times its size. The
words a source gives are laid out as one stream: whole passes over its permuted documents,
then as many documents of a last pass as come nearest to the target. The stream is cut
into blocks. A tree over the output shards halves them again and again and draws, without
replacement, how many blocks of each source go left and right, so that every shard gets
whole blocks and all blocks are dealt out. Which blocks those are is a permutation of each
source's blocks, cut at the shards' counts: shards are disjoint. Rows are shuffled inside
their shard by a seeded key.

What reaches the driver is a row a source; documents are ranked by range partitions and
prefix sums, so a source with most rows is spread like any other.

Defined results: a null text has no words, and a document without words is taken with 0
words; a null source is a source of its own, the last; null ids and repeated rows count
each (rows equal in doc_id, size and, in `mix`, in all columns are interchangeable); an
empty table gives an empty result; texts of any length count whole; other columns, whatever
their names, pass through `mix`.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, materialize, passing, placed, positions, row_digest, table, unused

#: Weights by rank of the source, the mix's share of all words, the most passes.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SHARDS = 16
#: Sources up to which their table is broadcast; beyond, it is joined like any other.
MOST_BROADCAST = 10_000
#: Blocks a shard gets on average.
BLOCKS = 64
SEED = 11


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """total shared by weight; none above `most` times its size, the excess shared anew."""
    out = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if sizes[i] > 0]
    left = float(total)
    while open_:
        each = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if each * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = each * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split_blocks(blocks: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """How many blocks of each source every shard gets: rows are shards, columns sources."""
    out = np.zeros((shards, len(blocks)), np.int64)
    rng = np.random.default_rng(seed)

    def halve(lo: int, hi: int, colors: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = colors
            return
        mid = (lo + hi) // 2
        n = round(int(colors.sum()) * (mid - lo) / (hi - lo))
        left = rng.multivariate_hypergeometric(colors, n, method="marginals") if colors.sum() else colors
        halve(lo, mid, left)
        halve(mid, hi, colors - left)

    halve(0, shards, np.array(blocks, np.int64))
    return out


def words(column: str = "text"):
    """Words of a text, null: none."""
    return F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def plan(sizes: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """sizes (source, size, and any columns that tell rows apart) plus source_size, target, taken, copies.

    A column `place` only tells rows apart and draws nothing. copies is an array of (shard, key) structs: one entry each time the document is taken.
    """
    spark = sizes.sparkSession
    per = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row a source
    per.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    total = sum(r["size"] for r in per)
    goal = targets([r["size"] for r in per], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(per))], SHARE * total)
    block = max(1, math.ceil(sum(goal) / (shards * BLOCKS)))
    n_blocks = [max(1, math.ceil(g / block)) for g in goal]
    cuts = np.cumsum(split_blocks(n_blocks, shards, seed), axis=0).T.tolist() if per else []
    rows, before = [], 0
    rng = np.random.default_rng(seed + 1)
    for r, g, n, c in zip(per, goal, n_blocks, cuts):
        step = int(rng.integers(1, max(2, n)))
        while math.gcd(step, n) != 1:
            step += 1
        passes = int(g // r["size"]) if r["size"] else 0
        rows.append((r["source"], before, r["size"], g, passes, g - passes * r["size"], n, step, int(rng.integers(0, n)), c))
        before += r["size"]
    fields = "s string, base long, source_size long, target double, passes int, rest double, blocks long, step long, first long, cuts array<long>"
    sources = spark.createDataFrame(rows, fields)  # a row a source
    if len(rows) <= MOST_BROADCAST:
        sources = F.broadcast(sources)
    keys = [c for c in sizes.columns if c not in ("source", "size")]
    drawn = sizes.withColumn("__draw", F.xxhash64(F.lit(seed), *[F.col(c) for c in keys if c != "place"], "source", "size"))
    order = [F.col("source").isNull(), F.col("source"), F.col("__draw"), *[F.col(c) for c in keys]]
    placed = positions(drawn, order, {"__before": F.col("size")})
    placed = placed.join(sources, F.col("source").eqNullSafe(F.col("s"))).withColumn("__at", F.col("__before") - F.col("base"))
    last = (F.col("size") > 0) & (F.col("__at") + F.col("size") / 2 < F.col("rest"))
    times = F.col("passes") + last.cast("int")

    def copy(k):
        at = F.least((k * F.col("source_size") + F.col("__at")) / block, F.col("blocks") - 1).cast("long")
        turned = F.pmod(at * F.col("step") + F.col("first"), F.col("blocks"))
        shard = F.size(F.filter("cuts", lambda c: c <= turned))
        return F.struct(shard.cast("int").alias("shard"), F.xxhash64("__draw", k).alias("key"))

    numbers = F.filter(F.array(*[F.lit(k) for k in range(MOST)]), lambda k: k < F.col("__times"))
    return placed.withColumn("__times", times).select(
        *sizes.columns, "source_size", "target", (F.col("size") * F.col("__times")).alias("taken"),
        F.transform(numbers, copy).alias("copies"),
    )


def mixed(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, str, str]:
    """The rows the mix takes, as often as it takes them, gathered shard by shard, and the names of two more columns: shard and key.

    Rows are written once with their place, size and a digest of all their columns; the plan
    and the rows are both read from there. Draws come from the digest, so that they don't
    hang on how the input's files are split; rows equal in every column are interchangeable.
    A shard is spread over slices by key, so that no shard passes through one task, and rows
    of a slice are sorted by key: that is their shuffle.
    """
    place, size, draw, copy, shard, key = unused(docs, "__place", "__size", "__draw", "__copy", "shard", "key")
    whole = placed(docs, place, **{size: words(), draw: row_digest(docs, seed)})
    with passing(docs.sparkSession) as keep:
        made = plan(whole.select("source", col(size).alias("size"), col(draw).alias("digest"), col(place).alias("place")), shards, seed)
        # written first: where that table is small, Spark sends it to all tasks, and the texts are shuffled once, to their shards
        taken = keep(materialize(made.where(F.size("copies") > 0).select(F.col("place").alias(place), F.explode("copies").alias(copy))))
    out = whole.join(taken, place)
    slices = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    out = out.select(*[col(c) for c in docs.columns], col(copy)["shard"].alias(shard), col(copy)["key"].alias(key))
    at = (col(shard) * slices + F.pmod(col(key), F.lit(slices))).cast("int")
    return out.repartitionById(shards * slices, at).sortWithinPartitions(col(shard), col(key)), shard, key


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows of `mixed` in the columns of docs alone."""
    rows, _, _ = mixed(docs, shards, seed)
    return rows.select(*[col(c) for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document, and the shards that get them."""
    docs = table(spark, sf_dir, "documents")
    sizes = materialize(docs.select("doc_id", F.col("source").cast(T.StringType()).alias("source"), words().alias("size")))
    made = plan(sizes)
    return made.select(
        "doc_id", "size", "source_size", "target", "taken", F.col("copies.shard").alias("shards")
    )
