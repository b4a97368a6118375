"""Vector code compression: product quantisation by Elkan's form of Lloyd's rounds.

A vector's integer components are cut into equal parts, and each part position has a
codebook. A row's state holds, for every part, the entry it is assigned to, an upper bound of
the distance to it, and a lower bound of the distance to each entry. A round shifts the bounds
by how far the entries moved. By the triangle inequality a part keeps its entry, without a
distance, where the upper bound is strictly below half the way to the nearest other entry; an
entry is left out where the upper bound is strictly below its lower bound or below half the
way between the two entries. All other distances are computed as integers, and the least wins,
of equal ones the lower index. As bounds are rounded outwards and compared strictly, an entry
that is left out is truly farther, so the result is exactly that of comparing all entries.

States are tables in the shared folder, one a round, and the round before is dropped. Bounds
take two bytes each. Only sums by (part, entry, component), a fixed number, reach the driver;
they are pre-summed in each task, so neither a hot label nor equal vectors gather anywhere.

Defined results: rows whose vector is null or holds a null or non-finite component are
dropped; shorter vectors, and lengths that the parts don't divide, are filled with zeros;
components beyond +-4096 are taken as +-4096; of equal vec_ids the smaller vector comes first
into the codebooks, a null vec_id last; with fewer rows than entries the codebooks are
smaller; repeated rows are coded each; null labels are one label; an empty table gives an
empty result; other columns are neither read nor clashed with. A label's sum of errors beyond
a long's range is the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, spread_join, table
from .vectors import listed, matrix, quantised, width_of

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows that a task works on at a time.
CHUNK = 2048
#: How far bounds are moved outwards, beyond any rounding of the square roots and sums.
SLACK = 1e-6


def pack_up(x: np.ndarray) -> np.ndarray:
    """Two bytes that stand for no less than x: the upper half of a float32, rounded up."""
    return ((x * (1 + SLACK)).astype(np.float32).view(np.uint32) >> 16).astype(np.uint16) + np.uint16(1)


def pack_down(x: np.ndarray) -> np.ndarray:
    """Two bytes that stand for no more than x."""
    return ((x * (1 - SLACK)).astype(np.float32).view(np.uint32) >> 16).astype(np.uint16)


def unpack(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint32) << 16).view(np.float32).astype(np.float64)


def half_ways(book: np.ndarray) -> np.ndarray:
    """(part, entry, entry): half the distance between entries, never too much; an entry has none to itself."""
    apart = np.sqrt(((book[:, :, None] - book[:, None]) ** 2).sum(-1))
    k = np.arange(book.shape[1])
    apart[:, k, k] = np.inf
    return apart / 2 * (1 - SLACK)


def assign(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Move each part to its nearest entry, in place; how many distances each row took.

    x (rows, parts, components); code and upper (rows, parts); lower (rows, parts, entries).
    """
    row, part = np.nonzero(upper >= half.min(axis=2)[np.arange(len(book)), code])
    own = code[row, part]
    near = half[part, own]
    maybe = (lower[row, part] <= upper[row, part][:, None]) & (near <= upper[row, part][:, None])
    keep = maybe.any(axis=1)
    row, part, own, near, maybe = row[keep], part[keep], own[keep], near[keep], maybe[keep]
    k = np.arange(len(row))
    exact = ((x[row, part] - book[part, own]) ** 2).sum(-1)
    tight = np.sqrt(exact)
    lower[row, part, own] = tight * (1 - SLACK)
    upper[row, part] = tight * (1 + SLACK)
    maybe &= (lower[row, part] <= upper[row, part][:, None]) & (near <= upper[row, part][:, None])
    at, entry = np.nonzero(maybe)
    far = ((x[row[at], part[at]] - book[part[at], entry]) ** 2).sum(-1)
    lower[row[at], part[at], entry] = np.sqrt(far) * (1 - SLACK)
    squares = np.full(maybe.shape, np.iinfo(np.int64).max)
    squares[k, own] = exact
    squares[at, entry] = far
    code[row, part] = squares.argmin(axis=1)  # the lower index of equal ones
    upper[row, part] = np.sqrt(squares.min(axis=1)) * (1 + SLACK)
    return np.bincount(row, minlength=len(x)) + np.bincount(row[at], minlength=len(x))


def advance(state: DataFrame, book: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The state after one assignment; `moved` is None at the first, when there are no bounds yet."""
    parts, entries, size = book.shape
    half = half_ways(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(lo, CHUNK) for lo in range(0, whole.num_rows, CHUNK)):
                n = b.num_rows
                x = matrix(b.column("q"), parts * size).reshape(n, parts, size)
                if moved is None:
                    code, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts, entries))
                    upper, took = np.full((n, parts), np.inf), 0
                else:
                    def held(name: str, kind: type, *shape: int) -> np.ndarray:
                        return np.frombuffer(b"".join(b.column(name).to_pylist()), kind).reshape(n, *shape)

                    code = held("code", np.uint8, parts).astype(np.int64)
                    upper = unpack(held("upper", np.uint16, parts)) + moved[np.arange(parts), code]
                    lower = np.maximum(unpack(held("lower", np.uint16, parts, entries)) - moved, 0)
                    took = b.column("distances").to_numpy(zero_copy_only=False)
                took = took + assign(x, code, upper, lower, book, half)
                upper = np.where(np.isinf(upper), 3e38, upper)  # a lone entry: nothing was compared
                flat = [code.astype(np.uint8), pack_up(upper), pack_down(lower).reshape(n, -1)]
                made = [pa.array([r.tobytes() for r in a], pa.binary()) for a in flat]
                made.append(pa.array(took.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], names=["vec_id", "label", "q", "code", "upper", "lower", "distances"])

    first = state.schema
    ids = ", ".join(f"{c} {first[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    columns = ["vec_id", "label", "q"] + ([] if moved is None else ["code", "upper", "lower", "distances"])
    return state.select(*columns).mapInArrow(run, f"{ids}, q array<int>, code binary, upper binary, lower binary, distances int")


def moved_entries(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """Each entry replaced by floor(sum / count) of its parts; unused entries stay. Tasks hand on their own sums."""
    parts, entries, size = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, size), np.int64)
        for b in batches:
            x = matrix(b.column("q"), parts * size).reshape(-1, size)
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            slot = (np.arange(parts) * entries + code).ravel()
            count += np.bincount(slot, minlength=len(count))
            np.add.at(total, slot, x)
        used = np.flatnonzero(count)
        slot, place = np.repeat(used, size), np.tile(np.arange(size), len(used))
        arrays = [pa.array(slot.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(count[slot]), pa.array(total[slot, place])]
        yield pa.RecordBatch.from_arrays(arrays, names=["slot", "place", "n", "s"])

    sums = state.select("q", "code").mapInArrow(run, "slot int, place int, n long, s long")
    out = book.copy()
    for r in sums.groupBy("slot", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # a row a component of the codebooks
        out[r["slot"] // entries, r["slot"] % entries, r["place"]] = r["s"] // r["n"]
    return out


def with_errors(state: DataFrame, book: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances over all parts) and distances."""
    parts, _, size = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("q"), parts * size).reshape(-1, parts, size)
            codes = b.column("code").to_pylist()
            code = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, parts)
            error = ((x - book[np.arange(parts), code]) ** 2).sum((1, 2))
            made = [pa.array([c.hex() for c in codes], pa.string()), pa.array(error, pa.int64()), b.column("distances")]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), *made], names=["vec_id", "label", "code", "error", "distances"])

    ids = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    return state.select("vec_id", "label", "q", "code", "distances").mapInArrow(run, f"{ids}, code string, error long, distances int")


def encode(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, distances) of the usable rows of (vec_id, label, embedding), and the codebooks (part, entry, component)."""
    kept = materialize(quantised(rows, scale, vec_id=F.col("vec_id"), label=F.col("label")))
    size = max(1, -(-width_of(kept) // parts))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(min(entries, 256)).collect()
    book = np.zeros((parts, len(first), size), np.int64)
    for k, r in enumerate(first):
        book[:, k] = np.pad(np.array(r["q"], np.int64), (0, parts * size - len(r["q"]))).reshape(parts, size)
    if not first:
        ids = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
        return rows.sparkSession.createDataFrame([], f"{ids}, code string, error long, distances int"), book
    state, moved = kept, None
    for _ in range(rounds):
        last, state = state, materialize(advance(state, book, moved))
        release(last)
        new = moved_entries(state, book)
        moved = np.sqrt(((new - book) ** 2).sum(-1)) * (1 + SLACK)
        book = new
    done = materialize(with_errors(advance(state, book, moved), book))
    release(state)
    return done, book


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable embedding."""
    coded, book = encode(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    told = coded.withColumn("kind", F.coalesce(F.concat(F.lit("v"), F.col("label").cast("string")), F.lit("none")))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = materialize(told.groupBy("kind").agg(total.alias("label_error"), F.count(F.lit(1)).alias("n")))
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return spread_join(told, sums, "kind", "n").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The same by comparing all entries in every round."""
    size = "CAST(width / 8 AS INT)"
    steps = [
        """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "dims AS (SELECT max(len(q)) AS width FROM kept)",
        f"comp AS (SELECT vec_id, label, CAST((i - 1) // ({size}) AS INT) AS part, CAST((i - 1) % ({size}) AS INT) AS place, q[i] AS v FROM (SELECT kept.*, width, unnest(range(1, width + 1)) AS i FROM kept, dims))",
        "start AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 16)",
        "book0 AS (SELECT part, CAST(entry AS INT) AS entry, place, v FROM comp JOIN start USING (vec_id))",
    ]
    for r in range(7):
        steps.append(f"dist{r} AS MATERIALIZED (SELECT c.vec_id, c.part, b.entry, sum((c.v - b.v) * (c.v - b.v)) AS d FROM comp c JOIN book{r} b USING (part, place) GROUP BY ALL)")
        steps.append(f"code{r} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM dist{r} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)")
        if r < 6:
            steps.append(f"mean{r} AS (SELECT part, entry, place, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM comp JOIN code{r} USING (vec_id, part) GROUP BY ALL)")
            steps.append(f"book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN mean{r} m USING (part, entry, place))")
    steps.append("coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM code6 GROUP BY vec_id)")
    steps.append("digest AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) AS sha FROM book6)")
    return f"""WITH {(chr(10) + ', ').join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest"""


OP12_SQL = _sql()
