import re

import duckdb
import pytest

from strandline.llm import labels, quality_model, quality_rules, toxicity

ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "a b c d e f a b c d e f g h i j"), (6, "# # $ % & | <> " * 5), (7, "line one here\nline one here\nother\n\nline one here"),
       (7, "line one here\nline one here\nother\n\nline one here"), (None, "no id but enough words to pass the first rule of all"), (8, "x " * 5000), (9, "LOUD WORDS ONLY " * 6),
       (10, "é è ü " * 9 + "nb sp\x0bvt\x85nel"), (11, "w1 w2 w3 w4 w5 w1 w2 w3 w4 w5 " + " ".join(f"v{i}" for i in range(60)))]


def windows(words, n=5):
    seen = {}
    for i in range(len(words) - n + 1):
        seen.setdefault(tuple(words[i : i + n]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(n)})


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), windows(words)


def test_rules_against_brute_force_and_sql(spark, folder):
    path = folder(documents=ODD)
    got = quality_rules.op8_quality_rules(spark, path).collect()
    counts = sorted((tuple(r)[:6] for r in got), key=str)
    assert counts == sorted(((d, *brute(t)) for d, t in ODD), key=str)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    assert sorted(map(str, con.execute(quality_rules.OP8_SQL).fetchall())) == sorted(str(tuple(r)) for r in got)


def test_cascade_keeps_what_the_query_keeps_in_any_order(spark, folder):
    path = folder(documents=ODD)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rules = quality_rules.kept(docs)
    assert rules.columns == docs.columns
    want = sorted((r.doc_id for r in quality_rules.op8_quality_rules(spark, path).where("kept").collect()), key=str)
    assert sorted((r.doc_id for r in rules.collect()), key=str) == want
    again = quality_rules.kept(docs, quality_rules.RULES[::-1])
    assert sorted((r.doc_id for r in again.collect()), key=str) == want


def test_rules_on_an_empty_table(spark, folder):
    assert quality_rules.op8_quality_rules(spark, folder()).count() == 0


def test_classifier_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    made = quality_model.op10_quality_model(spark, sf).toPandas()
    told = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = made.merge(told, on="doc_id")
    test = both[both.held_out]
    assert len(made) == 1000 and len(test) > 30
    assert ((test.predicted > 0) == (test.quality > 0)).mean() > 0.9
    assert (made.score.between(0, 1)).all() and ((made.score >= 0.3) == (made.predicted == 1)).all()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    made = toxicity.op4_toxicity(spark, sf).toPandas()
    both = made.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    test = both[both.held_out]
    hit = test[test.toxic > 0].predicted.mean()
    false = test[test.toxic == 0].predicted.mean()
    assert hit > 0.8 and false < 0.02


@pytest.mark.parametrize("fn", [quality_model.op10_quality_model, toxicity.op4_toxicity])
@pytest.mark.parametrize("told", [[], [(1, 1, 0), (2, 1, 0)], [(1, None, None), (None, 1, 1)]], ids=["none", "one class", "nulls"])
def test_odd_input(spark, folder, fn, told):
    got = fn(spark, folder(documents=ODD, labels=told)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}


def test_maximal_segments_against_definition():
    import numpy as np

    def brute(x):  # Ruzzo-Tompa's recursive definition
        best = max(((sum(x[i:j]), -(j - i), i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        _, _, i, j = best
        return brute_at(x, 0, i) + [(i, j)] + brute_at(x, j, len(x))

    def brute_at(x, a, b):
        return [(a + i, a + j) for i, j in brute(x[a:b])]

    rng = np.random.default_rng(0)
    for _ in range(150):
        x = np.round(rng.normal(-0.2, 1, rng.integers(0, 14)), 3)
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(x)] == brute(list(x))


def test_sample_never_holds_out_of_fold_rows(spark, folder):
    import zlib

    docs = spark.read.parquet(folder(documents=[(i, f"text {i}") for i in range(60)], labels=[(i, 1, 0) for i in range(60)]) + "/documents.parquet")
    told = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    texts = {r.text for r in labels.sample(docs, told, "quality").collect()}
    assert texts == {f"text {i}" for i in range(60) if zlib.crc32(str(i).encode()) % 5}


def test_cheap_rules_go_before_dear_ones_of_equal_worth(spark):
    dear = quality_rules.Rule("dear", lambda c: (c["n_repeat_words"] < 0) | (c["n_words"] < 10))
    cheap = quality_rules.Rule("cheap", lambda c: c["n_words"] < 10)
    never = quality_rules.Rule("never", lambda c: c["n_words"] < 0)
    rows = [(" ".join(f"w{(i * j) % 97}" for j in range(1500)),) for i in range(60)] + [("short",)] * 60
    sample = spark.createDataFrame(rows, "text string")
    order = [r.name for r in quality_rules.ordered(sample, [never, dear, cheap], 6)]
    assert order.index("cheap") == 0 and order[-1] == "never"


def test_columns_of_any_name_pass_through(spark):
    odd = spark.createDataFrame([(1, "some words " * 20, "x", 7, "y")], "doc_id long, text string, `a.b` string, __text int, `tick``s` string")
    assert quality_rules.kept(odd, quality_rules.RULES[:1]).collect() == odd.collect()
    told = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality_model.kept(odd, told, 0.0).collect() == odd.collect()


def test_hinge_against_a_plain_solver():
    """The primal loss of dual coordinate descent is that of projected gradient steps on the dual, worked out densely."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 12, rng.integers(1, 6))) for _ in range(40)]
    scale, y = rng.normal(size=12), rng.choice([-1.0, 1.0], 40)
    cost = np.full(40, 0.7)
    x = np.zeros((40, 13))
    for i, r in enumerate(rows):
        x[i, r] = scale[r]
        x[i, 12] = 1
        x[i] /= np.sqrt(len(r) + 1)
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha = np.zeros(40)
    for _ in range(20_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, cost)
    want = (alpha * y) @ x
    got = quality_model.fit_hinge(rows, scale, y, cost, 2000)
    loss = lambda w: w @ w / 2 + cost @ np.maximum(0, 1 - y * (x @ w))
    assert abs(loss(got) - loss(want)) < 1e-2 * loss(want) and np.allclose(got, want, atol=0.05)


def test_classifier_query_against_a_plain_version(spark, folder):
    """Counted log ratios, and scores from whole texts, one by one."""
    import random
    import zlib

    import numpy as np

    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices([f"g{k}" for k in range(40)] if i % 2 else [f"B-{k}!" for k in range(40)], k=30))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "x" * 300 + "!9" * 40)]
    told = [(i, i % 2, 0) for i in range(80)]
    path = folder(documents=rows, labels=told)
    got = {r.doc_id: r for r in quality_model.op10_quality_model(spark, path).collect()}
    fit = sorted(
        ((quality_model.features(t.encode(), quality_model.Codes()).astype(np.int32), told[i][1]) for i, t in rows[:80] if zlib.crc32(str(i).encode()) % 5),
        key=lambda p: (zlib.crc32(p[0].tobytes()), p[1]),
    )
    seen = {0: {}, 1: {}}
    for ids, label in fit:
        for x in ids.tolist():
            seen[label][x] = seen[label].get(x, 0) + 1
    model = quality_model.fit([f for f, _ in fit], np.array([c for _, c in fit]))
    total = [sum(s.values()) + quality_model.BUCKETS for s in (seen[0], seen[1])]
    for x in list(seen[1])[:50]:
        ratio = np.log((seen[1][x] + 1) / total[1]) - np.log((seen[0].get(x, 0) + 1) / total[0])
        assert abs(model.weights[x]) < 1e-12 or np.sign(model.weights[x]) == np.sign(ratio)
    for i, t in rows:
        ids = quality_model.features((t or "").encode(), quality_model.Codes())
        p = 1 / (1 + np.exp(-(model.a * (sum(model.weights[k] for k in ids.tolist()) + model.bias) / np.sqrt(len(ids) + 1) + model.b)))
        assert abs(got[i].score - p) < 1e-9 and got[i].predicted == int(got[i].score >= 0.3)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_whole_shapes_count():
    a, b = (quality_model.features(w.encode(), quality_model.Codes()) for w in ("a1" * 12 + "!", "a1" * 12 + "?"))
    assert set(a.tolist()) != set(b.tolist()) and len(set(a.tolist()) & set(b.tolist())) == 0


def test_toxicity_query_against_a_plain_version(spark, folder):
    """Word odds counted by hand, segments by definition, scores document by document."""
    import math
    import random
    import zlib
    from collections import Counter

    import numpy as np

    rng = random.Random(9)
    clean = [f"word{k}" for k in range(60)]
    bad = [f"vile{k}" for k in range(6)]
    rows, told = [], []
    for i in range(300):
        w = rng.choices(clean, k=40)
        if i % 4 == 0:
            at = rng.randrange(30)
            w[at : at + 6] = rng.choices(bad, k=6)
        rows.append((i, " ".join(w)))
        told.append((i, 1, int(i % 4 == 0)))
    rows += [(400, None), (401, ""), (402, " ".join(bad * 3))]
    got = {r.doc_id: r for r in toxicity.op4_toxicity(spark, folder(documents=rows, labels=told)).collect()}
    fit = [(t, y) for (i, t), (_, _, y) in zip(rows, told) if zlib.crc32(str(i).encode()) % 5]
    n = {c: sum(len(set(t.split())) for t, y in fit if y == c) for c in (0, 1)}
    texts = {c: Counter(w for t, y in fit if y == c for w in set(t.split())) for c in (0, 1)}
    corpus = Counter(w for _, t in rows for w in (t or "").split())
    all_words = sum(corpus.values())
    score, weight = {}, {}
    for w, k in texts[1].items():
        if k < toxicity.LEAST_TEXTS:
            continue
        prior = toxicity.PRIOR * corpus[w] / all_words + toxicity.LEAST_PRIOR
        x, z = k + prior, texts[0][w] + prior
        odds = math.log(x / max(n[1] + 2 * prior - x, 0.5)) - math.log(z / max(n[0] + 2 * prior - z, 0.5))
        sure = odds / math.sqrt(1 / x + 1 / z)
        if sure >= toxicity.LEAST_Z:
            score[w], weight[w] = odds - odds / sure * toxicity.MARGIN, corpus[w]
    assert score and set(score) <= set(bad)
    values = np.array([*score.values(), toxicity.DRIFT])
    weights = np.array([*weight.values(), max(1.0, all_words - sum(weight.values()))], float)
    rate = min(toxicity.tail_rate(values, weights), 5.0)
    segments = lambda t: [s for _, _, s in toxicity.maximal_segments(np.array([score.get(w, toxicity.DRIFT) for w in t.split()], float))]
    found = [(segments(t), len(t.split()), y) for t, y in fit]
    low = min(min(s) for s, _, _ in found if s)
    k = max(1e-9, (sum(len(s) for s, _, y in found if not y) + 0.5) / max(1.0, sum(m for _, m, y in found if not y) * math.exp(-rate * low)))
    evidence = lambda s, m: math.log1p(sum(-e for e in (math.log(k * max(m, 1)) - rate * v for v in s) if e < math.log(toxicity.MOST_EXPECTED)))
    a, b = labels.platt(np.array([evidence(s, m) for s, m, _ in found]), np.array([y for _, _, y in found]))
    for i, t in rows:
        p = 1 / (1 + math.exp(-(a * evidence(segments(t or ""), len((t or "").split())) + b)))
        assert abs(got[i].score - p) < 1e-6 and got[i].predicted == int(p >= 0.5)
    assert got[402].predicted == 1 and got[401].predicted == 0
