"""What the corpus operators share: shared-folder tables, batch sizes, words, row positions."""

from __future__ import annotations

import os
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch

#: Rows that Python works on at a time. Spark bounds the Arrow batches themselves by bytes
#: (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB by default), so long texts don't pile up.
BATCH_ROWS = 512
#: Rows of one key beyond which `spread_join` sends the key's other side to all tasks.
HOT_ROWS = 100_000

#: Byte tables for bytes.translate. Lower-casing touches A-Z alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and every ASCII byte that is no digit or letter becomes a blank.
LOWER_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and every later read sees the same rows."""
    spark = df.sparkSession
    path = scratch.folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_folder = path
    return out


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """df written in buckets of `key`: joins on it shuffle the other side alone. To be released like a materialized frame.

    The table's name is dropped at once: its files and their buckets are all that is read.
    """
    spark = df.sparkSession
    path, name = scratch.folder(spark), f"strandline_{uuid.uuid4().hex}"
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartition(n, col(key)).write.bucketBy(n, key).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    out._strandline_folder = path
    return out


def release(df: DataFrame | None) -> None:
    """Drop the folder of a materialized frame that nothing will read again."""
    path = getattr(df, "_strandline_folder", None)
    if path:
        scratch.drop(df.sparkSession, path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Frames that are materialized inside go at its end, but for those that are handed to what it yields."""
    before, kept = set(scratch.folders(spark)), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._strandline_folder)
        return df

    try:
        yield keep
    finally:
        for path in set(scratch.folders(spark)) - before - kept:
            scratch.drop(spark, path)


def col(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_field(docs: DataFrame) -> str:
    """doc_id in a schema string, with the type it has in docs."""
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like the wished ones that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_digest(df: DataFrame, seed: int = 0) -> Column:
    """A long of all columns that can be hashed: what tells rows apart, wherever they lie."""
    plain = [f.name for f in df.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return F.xxhash64(F.lit(seed), *[col(c) for c in plain])


def placed(df: DataFrame, place: str, **more: Column) -> DataFrame:
    """df with a unique long `place` a row, and more columns, written once: all readers see one and the same place."""
    return materialize(df.select(*[col(c) for c in df.columns], F.monotonically_increasing_id().alias(place), *[c.alias(n) for n, c in more.items()]))


def spread_join(rows: DataFrame, small: DataFrame, key: str, n: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows joined on `key` to small (one row a key, column `n` says how many rows have it); keys may be null on neither side.

    Keys of more than `hot_rows` rows are at most count(rows) / hot_rows: those go to all
    tasks by broadcast, so that their rows need no shuffle; the others are joined as usual.
    """
    hot = F.broadcast(small.where(F.col(n) > hot_rows))
    heavy = rows.join(hot, key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(small.where(F.col(n) <= hot_rows), key)
    return heavy.unionByName(cold)


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, whatever task fills it."""
    module = sys.modules.setdefault("_strandline_cache", types.ModuleType("_strandline_cache"))
    return module.__dict__.setdefault(name, {})


def binary(column: pa.Array) -> list:
    """A string column as UTF-8 bytes (None stays)."""
    return column.cast(pa.binary()).to_pylist()


def map_batches(df: DataFrame, columns: list[Column], fn: Callable, schema: str) -> DataFrame:
    """mapInArrow over the given columns only, so that the scan reads no others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(b.slice(lo, BATCH_ROWS) for b in batches for lo in range(0, b.num_rows, BATCH_ROWS))

    return df.select(*columns).mapInArrow(run, schema)


def text_sha(column: Column | str = "text") -> Column:
    """Which texts are equal: the digest of the text, null and empty told apart."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNull(), F.lit("null")).otherwise(F.sha2(c, 256))


def positions(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Total order without a global window: range partitions, running sums in each, then offsets.

    Adds for every entry of `sums` a long column of that name: the sum over all earlier rows.
    The partition totals that reach the driver are one row a partition. Rows equal in all of
    `order` come in any order among themselves; a tie-break of their own keeps many of them
    from falling into one partition.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = list(sums)
    kept = df.columns
    ranged = df.withColumns({f"__v{i}": sums[c].cast("long") for i, c in enumerate(names)} | {"__tie": F.monotonically_increasing_id()})
    order = [*order, F.col("__tie")]
    ranged = ranged.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("__tie")
    extra = [T.StructField(f"__before{i}", T.LongType()) for i in range(len(names))]
    schema = T.StructType([*ranged.schema.fields, *extra, T.StructField("__pid", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        total = [0] * len(names)
        for b in batches:
            arrays, fields = list(b.columns), list(b.schema.names)
            for i in range(len(names)):
                v = b.column(f"__v{i}").to_numpy(zero_copy_only=False).astype(np.int64)
                c = np.cumsum(v)
                arrays.append(pa.array(c - v + total[i]))
                fields.append(f"__before{i}")
                total[i] += int(c[-1]) if len(c) else 0
            arrays.append(pa.array(np.full(b.num_rows, pid, np.int32)))
            yield pa.RecordBatch.from_arrays(arrays, names=[*fields, "__pid"])

    done = materialize(ranged.mapInArrow(run, schema))
    per = (
        done.groupBy("__pid")
        .agg(*[F.sum(f"__v{i}").alias(f"s{i}") for i in range(len(names))])
        .orderBy("__pid")
        .collect()  # a row a partition
    )
    offsets, at = [], [0] * len(names)
    for r in per:
        offsets.append((r["__pid"], *at))
        at = [a + r[f"s{i}"] for i, a in enumerate(at)]
    fields = ", ".join(["__pid int", *[f"__o{i} long" for i in range(len(names))]])
    shift = F.broadcast(spark.createDataFrame(offsets, fields)) if offsets else spark.createDataFrame([], fields)
    return done.join(shift, "__pid").select(
        *kept, *[(F.col(f"__before{i}") + F.col(f"__o{i}")).alias(c) for i, c in enumerate(names)]
    )


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file is; nothing of it is copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def quiet_threads() -> None:
    """One thread a worker: the cluster already runs a task a core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
