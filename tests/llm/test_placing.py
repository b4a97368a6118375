import collections
import re
import zlib

import numpy as np
import pytest

from strandline.llm import mixing, sharding

ROWS = (
    [(i, f"text {i % 40} " * (i % 13), "en", ["a", "b", "ä", None, "c"][i % 5]) for i in range(300)]
    + [(500 + i, "the hot copy of them all", "en", "b") for i in range(120)]
    + [(7, "text 7", "en", "ä"), (7, "text 7", "en", "ä"), (None, None, None, None), (None, "", "en", ""), (900, "w " * 4000, "en", "c")]
)


@pytest.mark.parametrize("rows", [ROWS, [], [(1, "one")]], ids=["rows", "empty", "one"])
def test_shards(spark, folder, rows):
    got = sharding.op2_sharding(spark, folder(documents=rows)).collect()
    assert len(got) == len(rows)
    shards = collections.Counter(r.shard for r in got)
    if len(rows) > 1:
        assert max(shards.values()) - min(shards[s] for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(shards[s]))
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} <= {("rows", None)}


def test_copies_end_up_together(spark, folder):
    rows = [(i, f"copy of {i // 3} " * 5, "en", "a") for i in range(600)]
    got = sharding.op2_sharding(spark, folder(documents=rows)).collect()
    split = collections.defaultdict(set)
    for r in got:
        split[r.text_crc32].add(r.shard)
    assert np.mean([len(s) > 1 for s in split.values()]) < 0.05  # by chance nearly all would be split


def test_quotas_keep_targets_within_their_cap():
    share = sharding.quotas([(0, 1, 5, 100), (1, 0, 5, 40), (0, 1, 1, 100)], [150, 100], 140)
    moved = {k: v * n for k, v in share.items() for n in [{(0, 1, 5): 100, (1, 0, 5): 40, (0, 1, 1): 100}[k]]}
    into = sum(v for (a, b, _), v in moved.items() if b == 1) - sum(v for (a, b, _), v in moved.items() if a == 1)
    assert 100 + into <= 140 and moved[0, 1, 5] > 0


def water(sizes, total, weights):
    """Targets by bisection on the level."""
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * s, mid * w) for s, w in zip(sizes, weights)) < total else (lo, mid)
    return [min(2 * s, hi * w) for s, w in zip(sizes, weights)]


@pytest.mark.parametrize("rows", [ROWS, [], [(1, None, None, None)]], ids=["rows", "empty", "no words"])
def test_mix(spark, folder, rows):
    path = folder(documents=rows)
    got = mixing.op5_mixing(spark, path).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((d, size(t)) for d, t, *_ in rows)
    per = collections.Counter()
    for _, t, _, s in ((*r, None, None)[:4] for r in rows):
        per[s] += size(t)
    order = sorted(per, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, water([per[s] for s in order], 1.5 * sum(per.values()), [(5, 2, 1)[i % 3] for i in range(len(order))])))
    source = {d: s for d, _, _, s in ((*r, None, None)[:4] for r in rows) if d is not None}
    taken, most = collections.Counter(), collections.Counter()
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size) and len(r.shards) == (r.taken // r.size if r.size else len(r.shards))
        if r.doc_id is not None:
            s = source[r.doc_id]
            assert abs(r.target - goal[s]) < 1e-6 * (1 + goal[s]) and r.source_size == per[s]
            taken[s] += r.taken
            most[s] = max(most[s], r.size)
    for s in taken:
        assert abs(taken[s] - goal[s]) <= most[s] + 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.op5_mixing(spark, path).collect()))


def test_mixed_rows_follow_the_plan(spark, folder):
    path = folder(documents=ROWS)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = out.select(mixing.words().alias("n")).groupBy().sum("n").first()[0]
    sizes = [len((t or "").split()) for _, t, *_ in ROWS]
    assert abs(words - 1.5 * sum(sizes)) <= 4000 / 2 + 5 * 20 / 2  # half the largest document of each source
    taken = {r.doc_id: r.n for r in out.groupBy("doc_id").agg({"*": "count"}).toDF("doc_id", "n").collect() if r.doc_id is not None}
    assert all(n <= 2 for d, n in taken.items() if d != 7)


def test_splitting_tree_deals_out_every_block():
    blocks = [7, 0, 500, 64]
    dealt = mixing.split_blocks(blocks, 13)
    assert dealt.sum(axis=0).tolist() == blocks and (dealt >= 0).all()
    assert np.ptp(dealt.sum(axis=1)) <= 2


def test_near_copies_of_one_line_end_up_together(spark, folder):
    """Texts of one line that differ in a word share their runs of words, not their line."""
    rows = []
    for i in range(200):
        base = [f"w{i}x{k}" for k in range(40)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base[:20], "other", *base[21:]]))]
    shard = {r.doc_id: r.shard for r in sharding.op2_sharding(spark, folder(documents=rows)).collect()}
    assert np.mean([shard[2 * i] == shard[2 * i + 1] for i in range(200)]) > 0.7  # an eighth by chance


def test_hot_hubs_are_joined_like_others(spark):
    rows = spark.createDataFrame([(i, i % 3 if i % 4 else None, i) for i in range(60)], "k int, h long, seed long")
    counts = spark.createDataFrame([(0, 100, 7), (1, 2, 8)], "h long, n long, x int")
    got = {(r.k, r.x) for r in sharding.attach(rows, counts, "h", 50).collect()}
    assert got == {(i, {0: 7, 1: 8}.get(i % 3) if i % 4 else None) for i in range(60)}


def resplit(spark, path):
    """How many tasks read a table: set small and large, between the call and the action."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("op", ["near_text", "simhash", "mix"])
def test_rows_stand_when_files_are_split_otherwise(spark, folder, op):
    from strandline.llm import near_text, simhash

    rows = [(i % 70, f"text {i % 40} goes on {' and on ' * (i % 13)} {i % 40}", "en", "ab"[i % 2]) for i in range(200)] + [(None, "no id", "en", "a")] * 5
    path = folder(documents=rows)
    spark.read.parquet(f"{path}/documents.parquet").repartition(24).write.parquet(f"{path}/many.parquet")
    fn = {"near_text": near_text.keep_one, "simhash": simhash.keep_one, "mix": mixing.mix}[op]
    want = sorted(map(str, fn(spark.read.parquet(f"{path}/many.parquet")).collect()))
    frame = fn(spark.read.parquet(f"{path}/many.parquet"))
    for _ in resplit(spark, path):
        assert sorted(map(str, frame.collect())) == want
        assert sorted(map(str, fn(spark.read.parquet(f"{path}/many.parquet")).collect())) == want


@pytest.mark.parametrize("op", ["near_text", "simhash", "mix"])
def test_columns_of_any_name_pass_through(spark, op):
    from strandline.llm import near_text, simhash

    odd = spark.createDataFrame(
        [(1, "some words " * 20, "x", 7, "y", 1, 2, 3)], "doc_id long, text string, `a.b` string, __place int, source string, shard int, `key` int, __copy int"
    )
    fn = {"near_text": near_text.keep_one, "simhash": simhash.keep_one, "mix": mixing.mix}[op]
    out = fn(odd)
    assert out.columns == odd.columns and set(out.collect()) == set(odd.collect())


def test_a_shard_is_gathered_and_shuffled_by_key(spark, folder):
    docs = spark.read.parquet(folder(documents=ROWS) + "/documents.parquet")
    rows, shard, key = mixing.mixed(docs)
    parts = rows.select(shard, key).rdd.glom().collect()
    for p in parts:
        assert [r[1] for r in p] == sorted(r[1] for r in p) and len({r[0] for r in p}) <= 1
