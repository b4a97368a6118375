"""Gapless running ids in a total order, without a window over all rows.

Rows are range-partitioned and sorted by the order. In the written table each row knows its
partition and its place there; the rows before a partition are the sum of the counts of the
partitions before it, a number a partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written

#: Fixed value: the bits that Spark's monotonically increasing ids give to the place in a partition.
PLACE_BITS = 33


def running_ids(rows: DataFrame, order: Sequence[Column], name: str, first: int = 1) -> DataFrame:
    """rows with a long column `name`: first, first + 1, ... in the given order.

    Rows that tie in `order` get different ids in some order. An empty frame stays empty. The
    result reads a table in the shared folder.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = f"{name}__at"
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    table = written(ranged.withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, PLACE_BITS).cast("int")
    counts = {r["p"]: r["n"] for r in table.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    before = list(accumulate([counts.get(p, 0) for p in range(max(counts, default=-1) + 1)], initial=first))
    start = F.element_at(F.lit(before), part + 1)
    place = F.col(at).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return table.withColumn(name, start + place).drop(at)
