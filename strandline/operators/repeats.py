"""Work on texts that many rows share: each different text is worked out once, and rows look it up."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import spread, written

#: Bytes of texts, and of what is found in them, up to which each task gets all of them.
BROADCAST_BYTES = 16_000_000


def once_each(df: DataFrame, keys: Sequence[str], work: Callable[[DataFrame], DataFrame], row_bytes: int, how: str = "inner") -> DataFrame:
    """df with the columns that `work` adds to a frame of the text columns `keys`.

    The different keys go over as many tasks as a shuffle has, however few bytes they are; what
    `work` makes of them, about row_bytes a row beside the keys, is a table. df is read twice.
    """
    told = written(work(spread(df.select(*keys).distinct())))
    lengths = sum((F.coalesce(F.octet_length(k), F.lit(0)) for k in keys), F.lit(row_bytes))
    size = told.agg(F.sum(lengths)).first()[0] or 0
    named = told.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(F.broadcast(named) if size <= BROADCAST_BYTES else named.hint("merge"), same, how).drop(*[f"__{k}" for k in keys])
