import random
import re

import numpy as np
import pytest
import xxhash

from strandline.llm import simhash

ODD = [(1, None), (2, ""), (3, "  \n"), (4, "One"), (5, "ONE"), (6, "one two"), (7, "a b c"), (7, "a b c"), (None, "A B C"),
       (None, None), (8, "é È x y"), (9, "word " * 30000), (10, "nul\x00l a\x85b c d")]


def brute(rows, radius=3):
    fps = []
    for _, t in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    low = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    return sorted(((r[0], f"{f:016x}", low[g]) for r, f, g in zip(rows, fps, group)), key=str)


def near_copies(n, seed=0):
    rng = random.Random(seed)
    base = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(300)]
    rows = []
    for i in range(n):
        w = list(base) if i % 3 else [rng.choice("klmnop") * 3 for _ in range(200)]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("rows", [ODD, near_copies(80), []], ids=["odd", "near", "empty"])
def test_query(spark, folder, rows):
    got = sorted(map(tuple, simhash.op1_simhash(spark, folder(documents=rows)).collect()), key=str)
    assert got == brute(rows)


def test_hot_blocks_are_split_without_loss(spark):
    rng = np.random.default_rng(1)
    fps = {0}
    while len(fps) < 700:
        fps.add(int(rng.choice(list(fps))) ^ int(sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 6)))))
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, 3, block_rows=16)).collect()}
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3 and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if g in (a, b) else g for g in root]
    pairs = lambda key: {(i, j) for i in range(len(fps)) for j in range(i) if key(i) == key(j)}
    own = [roots.get(simhash.signed(f), simhash.signed(f)) for f in fps]
    assert pairs(lambda i: own[i]) == pairs(lambda i: root[i])


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for k in range(1, 300, 2):
        fps[k] = fps[k - 1] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 9)).astype(np.uint64))
    ends = np.repeat([100, 101, 300], [100, 1, 199])
    got = {(int(a), int(b)) for i, j in simhash.near_pairs(fps, ends, radius, chunk=64) for a, b in zip(i, j)}
    want = {(i, j) for i in range(300) for j in range(i + 1, ends[i]) if bin(int(fps[i] ^ fps[j])).count("1") <= radius}
    assert got == want and (radius < 3 or want)


def test_keep_one(spark, folder):
    rows = near_copies(40) + [(None, "lone text without an id"), (3, near_copies(40)[3][1]), (99, None)]
    docs = spark.read.parquet(folder(documents=rows) + "/documents.parquet")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute(rows)}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
