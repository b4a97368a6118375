"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are 64 majority bits over the XXH64 of 3-word shingles. Two link at `radius`
or fewer differing bits. By the pigeonhole principle such a pair agrees on one of
radius + 1 bands, so fingerprints meet in blocks of one band's value. In a block the
bits are stored vertically: plane b holds bit b of 64 fingerprints in one machine word.
One query fingerprint against a word updates 64 distances at once with a carry-save
counter that overflows beyond the radius, and a word whose lanes have all overflowed is
abandoned. Blocks above `block_rows` are split over Spark by bands of their free bits,
again and again; as fingerprints in it are distinct, this ends, and no pair is lost.
Each block hands on a spanning forest, never all its pairs.

Defined results: a null text counts as empty; empty text has fingerprint 0, linked like
any other; repeated rows each get a row; a null doc_id is never a component_id unless the
whole component has none (then null); an empty table gives an empty result; other columns
are neither read nor clashed with. A text of any length is hashed in pieces of bounded size
beyond its own words. Equal doc_ids of one component give one component_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, binary, col, map_batches, materialize, placed, release, row_digest, spread_join, table, unused

RADIUS = 3
BLOCK_ROWS = 8192
U64 = (1 << 64) - 1


def shingle_hashes(text: bytes, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `words` lower-cased words; of all words if there are fewer."""
    parts = text.translate(LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(start, end[words - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The key columns and fp (the fingerprint's 64 bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(t or b"")) for t in binary(b.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=[*keys, "fp"])

    schema = ", ".join([*[f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys], "fp long"])
    return map_batches(docs, [*[F.col(k) for k in keys], F.col("text")], run, schema)


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 to a word."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near_pairs(
    fps: np.ndarray, ends: np.ndarray, radius: int = RADIUS, chunk: int = 1 << 15
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j < ends[i] at `radius` or fewer differing bits, by bit-sliced comparison.

    fps are laid out block by block; ends[i] is where i's block ends.
    """
    if len(fps) < 2:
        return
    vertical = planes(fps)
    width = max(1, radius.bit_length())
    first = (1 << width) - 1 - radius  # the counter overflows when the distance exceeds the radius
    rows = np.flatnonzero(ends > np.arange(len(fps)) + 1)
    lo_word, hi_word = (rows + 1) >> 6, (ends[rows] - 1) >> 6
    n_words = hi_word - lo_word + 1
    cut = np.searchsorted(np.cumsum(n_words), np.arange(chunk, n_words.sum() + chunk, chunk), side="left") + 1
    begin = 0
    for stop in np.unique(np.minimum(cut, len(rows))):
        if stop <= begin:
            continue
        reps = n_words[begin:stop]
        query = np.repeat(rows[begin:stop], reps)
        word = np.repeat(lo_word[begin:stop], reps) + (np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps))
        begin = stop
        lo = np.clip(query + 1 - 64 * word, 0, 63).astype(np.uint64)
        hi = np.clip(ends[query] - 64 * word, 1, 64).astype(np.uint64)
        lanes = (np.uint64(U64) << lo) & (np.uint64(U64) >> (np.uint64(64) - hi))
        q = fps[query]
        count = [np.full(len(q), U64 if first >> k & 1 else 0, np.uint64) for k in range(width)]
        for b in range(64):
            carry = vertical[b, word] ^ (np.uint64(0) - ((q >> np.uint64(b)) & np.uint64(1)))
            for k in range(width):
                count[k], carry = count[k] ^ carry, count[k] & carry
            lanes &= ~carry
            if b % 8 == 7:  # abandon words in which every lane exceeds the radius
                keep = np.flatnonzero(lanes)
                if len(keep) < len(lanes):
                    query, word, q, lanes = query[keep], word[keep], q[keep], lanes[keep]
                    count = [c[keep] for c in count]
                if not len(keep):
                    break
        if len(lanes):
            at, lane = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield query[at], 64 * word[at] + lane


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n items the smallest item that the pairs connect it to."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            far = np.flatnonzero(a != b)
            if not len(far):
                break
            a, b = a[far], b[far]
            i, j = i[far], j[far]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    return root


def bands(mask: int, parts: int) -> list[int]:
    """The 64 - popcount(mask) free bits in `parts` bands, each joined to mask."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(k * len(free) / parts) for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = RADIUS, block_rows: int = BLOCK_ROWS, known: int = 0) -> DataFrame:
    """(a, b) of distinct fingerprints: a forest with the components of all links at `radius` bits.

    `known` is how many they are, where the caller has counted: bands are split, before any
    block is looked at, until blocks of evenly spread fingerprints fit `block_rows`.
    """
    masks = [0]

    def split(rows: DataFrame, masks: list[int]) -> tuple[DataFrame, list[int]]:
        under = {m: bands(m, radius + 1) for m in masks}
        of = F.create_map(
            *[x for m, c in under.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(k)) for k in c]))]
        )
        out = rows.select("fp", F.explode(of[F.col("mask")]).alias("mask"))
        return out.withColumn("val", F.col("fp").bitwiseAND(F.col("mask"))), sorted({k for c in under.values() for k in c})

    rows, masks = split(distinct.select("fp", F.lit(0).cast("long").alias("mask")), masks)
    while known >> min(bin(m).count("1") for m in masks) > block_rows:
        rows, masks = split(rows.select("fp", "mask"), masks)
    out = None
    while True:
        counts = rows.groupBy("mask", "val").count().where(F.col("count") > block_rows).select("mask", "val")
        small = 64 - min(bin(m).count("1") for m in masks)
        last = (1 << max(0, small)) <= block_rows  # distinct fingerprints can't fill a block any more
        hot = None if last else materialize(counts)
        if hot is not None and hot.isEmpty():
            hot = None
        cold = rows if hot is None else rows.join(hot, ["mask", "val"], "left_anti")
        found = compare(cold, radius, block_rows)
        out = found if out is None else out.unionByName(found)
        if hot is None:
            return out
        rows, masks = split(rows.join(hot, ["mask", "val"], "left_semi").select("fp", "mask"), masks)
        rows = materialize(rows)


def compare(rows: DataFrame, radius: int, block_rows: int) -> DataFrame:
    """Spanning forests of blocks (mask, val)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(mask: np.ndarray, val: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.r_[True, (mask[1:] != mask[:-1]) | (val[1:] != val[:-1])]
            starts = np.flatnonzero(new)
            ends = np.repeat(np.r_[starts[1:], len(fp)], np.diff(np.r_[starts, len(fp)]))
            root = forest(len(fp), near_pairs(fp.view(np.uint64), ends, radius))
            far = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.array(fp[root[far]])], names=["a", "b"])

        held: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            held.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "val", "fp")])
            size += b.num_rows
            if size >= 4 * block_rows:
                mask, val, fp = (np.concatenate(x) for x in zip(*held))
                cut = int(np.flatnonzero((mask != mask[-1]) | (val != val[-1]))[-1]) + 1 if (
                    (mask != mask[-1]) | (val != val[-1])
                ).any() else 0
                if cut:
                    yield from emit(mask[:cut], val[:cut], fp[:cut])
                held, size = [[mask[cut:], val[cut:], fp[cut:]]], len(fp) - cut
        if size:
            yield from emit(*(np.concatenate(x) for x in zip(*held)))

    dealt = rows.repartition("mask", "val").sortWithinPartitions("mask", "val")
    return dealt.select("mask", "val", "fp").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root is the component's smallest node.

    Alternating large-star and small-star rounds over (a, b) edges, each written to the
    shared folder. No neighbour list is ever collected: minima are aggregated and joined back.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    )
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = materialize(both.groupBy("v").agg(F.min(F.least("u", "v")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = spread_join(both.where("u > v"), low, "v", "n").select(F.col("u").alias("v"), F.col("m").alias("u"))
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(least, "v")
            .select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        last, now = now, materialize(small)
        release(last)
        release(low)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_duplicates(docs: DataFrame, keys: list[str], radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Key columns, fp and root (the fingerprint that stands for the component) of each row."""
    fps = materialize(fingerprints(docs, keys))
    distinct = materialize(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    roots = components(links(distinct.select("fp"), radius, block_rows, distinct.count()))
    of = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "n")
    return spread_join(fps, materialize(of), "fp", "n").select(*[col(k) for k in keys], "fp", "root")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    marked = materialize(near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"]))
    first = materialize(marked.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    return spread_join(marked, first, "root", "n").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component stays: the smallest doc_id, nulls last; all columns are kept.

    Rows are written once with a place of their own, which both the fingerprints and the
    choice read, so repeated rows and null ids are safe and another split of the input's
    files between the two reads changes nothing.
    """
    place, digest = unused(docs, "__place", "__digest")
    whole = placed(docs, place, **{digest: row_digest(docs)})
    keyed = whole.select(col(place).alias("__place"), col(digest).alias("digest"), "doc_id", "text")
    marked = near_duplicates(keyed, ["__place", "digest", "doc_id"], radius)
    best = marked.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("digest"), F.col("__place"))).alias("b")
    )
    return whole.join(best.select(F.col("b.__place").alias(place)), place, "left_semi").drop(place, digest)
