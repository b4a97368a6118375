"""Vector codes and hard negatives against comparing everything with everything."""

import hashlib
import math
import random

import numpy as np
import pytest

from strandline.llm import hard_negatives, vector_codes
from tests.oracle import compare

SCHEMA = "vec_id long, embedding array<float>, label int, q int, code string, row int, span int"


def table(spark, path, rows):
    spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def plain_codes(rows, width):
    """The contract, word by word."""
    rows = usable(rows)
    q = [[math.floor(4096 * float(np.float32(x))) for x in r[1]] + [0] * (width - len(r[1])) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, q[i]))[:16]
    size = width // 8
    books = [[q[i][p * size : (p + 1) * size] for i in order] for p in range(8)]

    def nearest(v, book):
        far = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in book]
        return min(range(len(book)), key=lambda k: (far[k], k)), min(far)

    for _ in range(6):
        for p in range(8):
            parts = [v[p * size : (p + 1) * size] for v in q]
            of = [nearest(v, books[p])[0] for v in parts]
            for k in range(len(order)):
                own = [v for v, a in zip(parts, of) if a == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    last = [[nearest(v[p * size : (p + 1) * size], books[p]) for p in range(8)] for v in q]
    error = [sum(d for _, d in x) for x in last]
    total = {}
    for r, e in zip(rows, error):
        total[r[2]] = total.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{k:02x}" for k, _ in x), e, total[r[2]], sha) for r, x, e in zip(rows, last, error)), key=repr)


def plain_negatives(rows, width):
    rows = [r for r in usable(rows) if r[2] is not None]
    q = [np.array([math.floor(256 * float(np.float32(x))) for x in r[1]] + [0] * (width - len(r[1]))) for r in rows]
    label = [(r[2] + 1) % 10 if r[0] is not None and r[0] % 7 == 0 else r[2] for r in rows]
    out = []
    for i, r in enumerate(rows):
        if r[0] is None or r[0] % 50:
            continue
        score = [int(q[i] @ v) for v in q]
        first = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-score[j], rows[j][0] is None, rows[j][0] or 0))
        for p in [j for j in first if label[j] == label[i]][:5]:
            own = [j for j in first if label[j] != label[i] and 50 * score[p] <= 100 * score[j] <= 95 * score[p]][:3]
            out += [(r[0], rows[p][0], k + 1, rows[j][0], score[p], score[j]) for k, j in enumerate(own)]
    return sorted(out, key=repr)


def found(df, names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


CODES = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
PAIRS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def odd_rows(seed, n, spread):
    """Ties, repeated rows and ids, null and non-finite components, null labels and ids, short vectors, norms of many sizes."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        size = math.exp(rnd.gauss(0, spread))
        rows.append((i, [round(rnd.gauss(0, 1) * size, 1) for _ in range(16)], rnd.choice([0, 1, 2, 9, None])))
    rows += rows[:20] + [(r[0] + 50, r[1], r[2]) for r in rows[40:60]]
    rows += [(50, None, 1), (51, [None] * 16, 1), (52, [float("nan")] * 16, 1), (53, [0.5] * 15 + [float("inf")], 2), (None, [1.0] * 16, 1), (54, [0.5] * 3, 1), (100, [0.25] * 9, 2)]
    rows += [(1000 + i, [1.0, -1.0] * 8, 3) for i in range(60)]  # one very common vector
    return rows


@pytest.mark.parametrize("seed,spread", [(1, 0.0), (2, 1.5)])
def test_codes_and_negatives_of_odd_rows(spark, tmp_path, seed, spread):
    rows = odd_rows(seed, 250, spread)
    sf = table(spark, tmp_path, rows)
    assert found(vector_codes.op12_vector_codes(spark, sf), CODES) == plain_codes(rows, 16)
    assert found(hard_negatives.op13_hard_negatives(spark, sf), PAIRS) == plain_negatives(rows, 16)


def test_few_and_no_rows(spark, tmp_path):
    rows = [(50, [1.0] * 8, 1), (3, [0.5] * 8, 1), (4, [0.6] * 8, 2), (5, [], 2)]
    some = table(spark, tmp_path / "some", rows)
    assert found(vector_codes.op12_vector_codes(spark, some), CODES) == plain_codes(rows, 8)
    assert found(hard_negatives.op13_hard_negatives(spark, some), PAIRS) == plain_negatives(rows, 8)
    for name, none in (("none", []), ("bad", [(1, None, 1), (50, [float("nan")], 2)]), ("empty", [(50, [], 1), (51, [], 1), (52, [], 2)])):
        sf = table(spark, tmp_path / name, none)
        assert found(vector_codes.op12_vector_codes(spark, sf), CODES) == plain_codes(none, 8)
        assert found(hard_negatives.op13_hard_negatives(spark, sf), PAIRS) == plain_negatives(none, 1)


def test_blocks_and_small_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKET", 16)
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "SLICE", 2)
    rows = odd_rows(5, 600, 1.0)
    assert found(hard_negatives.op13_hard_negatives(spark, table(spark, tmp_path, rows)), PAIRS) == plain_negatives(rows, 16)


def test_bounds_spare_distances_and_change_nothing(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(16, 32)) * 3
    rows = [(i, [float(x) for x in centres[i % 16] + rnd.normal(size=32) * 0.1], i % 3) for i in range(2000)]
    coded, _ = vector_codes.encode(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    took = sum(r["distances"] for r in coded.collect())
    assert took < 0.35 * 2000 * 8 * 16 * 7
    want = {r[0]: r[1:3] for r in plain_codes(rows[:], 32)}
    assert {r["vec_id"]: (r["code"], r["error"]) for r in coded.collect()} == want


def test_far_buckets_are_passed_over(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rnd.normal(size=8) * 1.01 ** (i % 1000)], i % 3) for i in range(4000)]
    anchors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    kept = hard_negatives.quantised(anchors, 256, vec_id=anchors["vec_id"], label=anchors["label"].cast("long"))
    kept = kept.selectExpr("*", "aggregate(q, 0L, (s, v) -> s + cast(v AS long) * v) AS square")
    monkeypatch.setattr(hard_negatives, "BUCKET", 64)
    buckets = hard_negatives.buckets_of(kept, 8)
    tops = [r[0] for r in buckets.groupBy("span").agg({"top": "max"}).orderBy("span").select("max(top)").collect()]
    assert len(tops) > 1 and tops == sorted(tops, reverse=True)
    shown = []
    visit = hard_negatives.Visit([(-1, 0, 100.0, np.full(8, 35, np.int32).tobytes(), [0], [1 << 60])], 2, True, 8)
    for b in sorted(buckets.collect(), key=lambda b: (b["span"], b["bucket"])):
        before = visit.windows[0].needs()[0]
        if before <= 100.0 * b["top"]:
            shown.append(b["top"])
        visit.show(b["top"], *(np.frombuffer(b[c], np.int64) for c in ("rows", "ids", "labels")), np.frombuffer(b["q"], np.int32).reshape(-1, 8))
    assert len(shown) < 0.6 * buckets.count()


def test_against_sql(spark):
    for name, query, sql in (("op12", vector_codes.op12_vector_codes, vector_codes.OP12_SQL), ("op13", hard_negatives.op13_hard_negatives, hard_negatives.OP13_SQL)):
        assert compare(spark, "/root/testdata/sf0.01", name, query, sql) is None
