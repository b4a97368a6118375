"""Balanced label propagation: linked documents move towards their neighbours' shards.

Documents are linked through hubs: all rows with the same value of a hub column (here the
text's digest, the smallest and the largest digest among its lines, and the smallest among
its runs of five words) are neighbours. A round counts each
hub's rows by shard, joins the counts back, and every row names the shard where it would
have most neighbours. Moves are granted from the largest gain down, as far as the target
shard's quota has room, so loads stay near even. At the end rows beyond a shard's exact
quota, the least linked ones, fill the shards below theirs: counts are at most one apart.

What reaches the driver in a round is a table of shards x shards x gains. Hub counts are
aggregated before they are shuffled, and no neighbour list is ever built. Counts of hubs of
very many rows are broadcast (there can be only few), so that no hub's rows meet in one task.

Defined results: a null text has size 1 and the checksum of an empty one, 0; null ids and
repeated rows are placed each, rows equal in text and id in any order among themselves; of
shards liked equally, the hub's digest picks one; texts of any length count whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_ROWS, materialize, positions, release, table

SHARDS = 8
ROUNDS = 6
#: Share above the even load that a shard may reach between rounds.
SLACK = 0.05
#: A hub's links weigh as much in all as UNIT times its weight, so that a huge hub doesn't outweigh equal texts.
UNIT = 10_000
#: Gains are told apart in so many steps, so that the table of moves stays small.
STEPS = 50


def case(values: list[int], of: Column) -> Column:
    """values[of] for a small list."""
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), (of + 1).cast("int"))


def quotas(moves: list[tuple[int, int, int, int]], loads: list[int], cap: int) -> dict[tuple[int, int, int], float]:
    """The share granted of each (from, to, gain, rows) move: largest gains first, while the target has room."""
    loads = list(loads)
    share: dict[tuple[int, int, int], float] = {}
    left = sorted(moves, key=lambda m: (-m[2], m[0], m[1]))
    for _ in range(4):  # moves out make room for moves in
        rest = []
        for a, b, gain, n in left:
            take = max(0, min(n, cap - loads[b]))
            if take:
                loads[a] -= take
                loads[b] += take
                share[a, b, gain] = share.get((a, b, gain), 0.0) + take
            if take < n:
                rest.append((a, b, gain, n - take))
        left = rest
    total = {(a, b, gain): n for a, b, gain, n in moves}
    return {k: v / total[k] for k, v in share.items()}


def attach(rows: DataFrame, counts: DataFrame, hub: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with the columns of counts (one row a value of `hub`, `n` rows have it), null where there is no such value.

    Values of more than hot_rows rows are at most count(rows) / hot_rows: they are broadcast.
    Rows without a value, or with such a one, are dealt out evenly in the other join.
    """
    more = [c for c in counts.columns if c not in (hub, "n")]
    hot, cold = counts.where(F.col("n") > hot_rows), counts.where(F.col("n") <= hot_rows)
    hot = F.broadcast(hot.select(F.col(hub).alias("__hot"), *[F.col(c).alias(f"__h{c}") for c in more]))
    cold = cold.select(F.col(hub).alias("__key"), F.lit(0).cast("long").alias("__salt"), *[F.col(c).alias(f"__c{c}") for c in more])
    done = rows.join(hot, F.col(hub) == F.col("__hot"), "left")
    idle = F.col(hub).isNull() | F.col("__hot").isNotNull()
    done = done.withColumns({"__key": F.when(idle, 0).otherwise(F.col(hub)), "__salt": F.when(idle, F.pmod("seed", F.lit(1 << 20)) + 1).otherwise(0)})
    done = done.join(cold, ["__key", "__salt"], "left")
    return done.select(*rows.columns, *[F.coalesce(f"__h{c}", f"__c{c}").alias(c) for c in more])


def propagate(nodes: DataFrame, hubs: dict[str, int], shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """nodes (with a long `seed` column) plus `label` and `support` (how much links it to its best shard); hubs maps hub columns to the weight of their links."""
    now = materialize(nodes.withColumn("label", F.pmod(F.xxhash64(F.lit(7), "seed"), F.lit(shards)).cast("int")).withColumn("support", F.lit(0).cast("long")))
    total = now.count()
    even = total / shards
    cap = math.ceil(even + max(SLACK * even, 3 * math.sqrt(even)))  # chance alone makes loads uneven by its root
    for turn in range(rounds):
        scored = now
        for h, weight in hubs.items():
            counts = (
                now.where(F.col(h).isNotNull())
                .groupBy(h)
                .agg(F.count("*").alias("n"), *[F.count_if(F.col("label") == s).alias(f"c{s}") for s in range(shards)])
                .where("n > 1")
                .select(h, "n", F.array(*[F.floor(F.col(f"c{s}") * (weight * UNIT) / F.col("n")) for s in range(shards)]).alias(f"__{h}"), F.floor(weight * UNIT / F.col("n")).alias(f"__one_{h}"))
            )
            scored = attach(scored, counts, h)
        near = [sum(F.coalesce(F.get(F.col(f"__{h}"), F.lit(s)), F.lit(0)) for h in hubs) for s in range(shards)]
        own = sum(F.coalesce(F.col(f"__one_{h}"), F.lit(0)) for h in hubs)
        linked = F.greatest(*[F.col(f"__{h}").isNotNull() for h in hubs], F.lit(False))
        # ties fall to a shard that the hub's value picks, the same for all its rows: else pairs swap for ever
        turned = F.coalesce(*[F.when(F.col(f"__{h}").isNotNull(), F.col(h)) for h in hubs], F.lit(0))
        liked = F.array(*[near[s] * shards + F.pmod(turned + s, F.lit(shards)).cast("int") for s in range(shards)])
        scored = scored.withColumns({"__near": F.array(*near), "__own": own, "linked": linked, "__liked": liked})
        best = (F.array_position("__liked", F.array_max("__liked")) - 1).cast("int")
        best = F.when(F.col("linked"), best).otherwise(F.col("label"))
        gain = F.get("__near", F.col("best")) - F.get("__near", F.col("label")) + F.col("__own")
        moved = materialize(
            scored.withColumn("best", best)
            .withColumn("gain", F.when(F.col("best") == F.col("label"), 0).otherwise(F.least(F.ceil(F.lit(STEPS) * gain / (sum(hubs.values()) * UNIT)), F.lit(STEPS))).cast("int"))
            .select(*nodes.columns, "label", F.get("__near", F.col("best")).cast("long").alias("support"), "gain", "best")
        )
        table_of_moves = moved.groupBy("label", "best", "gain").count().collect()  # shards x shards x gains rows
        loads = [sum(r["count"] for r in table_of_moves if r["label"] == s) for s in range(shards)]
        wanted = [(r["label"], r["best"], r["gain"], r["count"]) for r in table_of_moves if r["best"] != r["label"]]
        release(now)
        share = quotas(wanted, loads, cap)
        if not share:
            return moved.drop("gain", "best")
        granted = F.element_at(
            F.create_map(*[x for (a, b, g), p in share.items() for x in (F.lit(f"{a}-{b}-{g}"), F.lit(p))]),
            F.concat_ws("-", "label", "best", "gain"),
        )
        first = next(iter(hubs))
        draw = F.pmod(F.xxhash64(F.lit(turn), F.col(first), F.pmod(F.col("seed"), F.lit(97))), F.lit(1 << 20)) / (1 << 20)
        label = F.when((F.col("best") != F.col("label")) & (draw < granted), F.col("best")).otherwise(F.col("label"))
        now = moved.withColumn("label", label).drop("gain", "best")
    return now


def settle(labelled: DataFrame, order: list[Column], shards: int = SHARDS) -> DataFrame:
    """Adds shard and slot: row counts at most one apart, slots gapless from 0.

    `order` sorts a label's rows; the last ones leave where a label has too many.
    """
    loads = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    total = sum(loads.values())
    load = [loads.get(s, 0) for s in range(shards)]
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    begin = [sum(load[:s]) for s in range(shards)]
    over = [max(0, load[s] - quota[s]) for s in range(shards)]
    lack = [max(0, quota[s] - load[s]) for s in range(shards)]
    spilled = [sum(over[:s]) for s in range(shards)]
    filled = [sum(lack[:s]) for s in range(shards)]
    placed = positions(labelled, [F.col("label"), *order], {"__at": F.lit(1)})
    rank = F.col("__at") - case(begin, F.col("label"))
    placed = placed.withColumn("__rank", rank).withColumn("__quota", case(quota, F.col("label")))
    placed = placed.withColumn("__spill", F.col("__rank") - F.col("__quota") + case(spilled, F.col("label")))
    to = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        to = F.when(F.col("__spill") < filled[s] + lack[s], F.lit(s)).otherwise(to)
    stays = F.col("__rank") < F.col("__quota")
    placed = placed.withColumn("shard", F.when(stays, F.col("label")).otherwise(to).cast("int"))
    slot = F.when(stays, F.col("__rank")).otherwise(
        case(load, F.col("shard")) + F.col("__spill") - case(filled, F.col("shard"))
    )
    return placed.withColumn("slot", slot.cast("long")).drop("__at", "__rank", "__quota", "__spill")


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the hubs of each row; texts stay behind."""
    text = F.coalesce("text", F.lit(""))
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S")), lambda x: F.xxhash64(x))
    parts = F.transform(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: F.xxhash64(x))
    runs = F.transform(F.array(parts), lambda p: F.transform(F.slice(p, 1, F.greatest(F.size(p) - 4, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(p, i + k) for k in range(1, 5)])))
    lowest = F.transform(F.array(lines), lambda d: F.struct(F.array_min(d).alias("low"), F.array_max(d).alias("high")))[0]
    return docs.select("doc_id", text.alias("text"), lowest.alias("lines"), F.array_min(runs[0]).alias("low_run")).select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("same_text"),
        F.col("lines.low").alias("low_line"),
        F.when(F.col("lines.low") != F.col("lines.high"), F.col("lines.high")).alias("high_line"),
        "low_run",
        F.xxhash64("text", F.col("doc_id")).alias("seed"),
    )


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Every row's shard and slot."""
    labelled = propagate(nodes(docs), {"same_text": 3, "low_line": 1, "high_line": 1, "low_run": 1}, shards, rounds)
    order = [F.col("support").desc(), F.col("same_text"), F.col("doc_id"), F.col("size")]
    return settle(labelled, order, shards)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law `rows`."""
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
