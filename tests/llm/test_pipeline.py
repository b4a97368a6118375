import collections
import random
import re
import subprocess
import sys

import corpus_pipeline
import pytest
from conftest import ROOT
from tokenizers import Tokenizer

from strandline.llm import mixing, packing, quality_model, quality_rules, registry
from strandline.llm.common import table, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_agree_with_their_operators(spark, tmp_path):
    docs = table(spark, SF, "documents")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        made = spark.read.parquet(f"{tmp_path}/{k}")
        ids = collections.Counter(r.doc_id for r in made.select("doc_id").collect())
        before = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
        if name == "quality_rules":
            kept = quality_rules.op8_quality_rules(spark, SF).where("kept").select("doc_id").collect()
            assert ids == collections.Counter(r.doc_id for r in kept)
        elif name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
            assert ids == collections.Counter(r[0] for r in one_of_each(rows))
        elif name == "mixing":
            assert max(ids.values()) <= 2 and set(ids) <= set(before)
        elif name == "packing":
            want = sum(packing.pack(docs, tokenizer_path()).select("length").rdd.map(lambda r: r[0]).collect())
            assert sum(r.length for r in made.select("length").collect()) == want and set(ids) == set(before)
        else:
            assert all(ids[i] <= before[i] for i in ids)
        if name != "packing":
            assert made.columns == names
        docs = made
    assert quality_model and mixing


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


def test_empty_documents(spark, folder):
    assert corpus_pipeline.run(spark, folder()).count() == 0


BLANK = r"[^\x20\x09-\x0D]+"


def rejected(text):
    """The quality rules, one by one."""
    text = text or ""
    words, lines = re.findall(BLANK, text), text.split("\n")
    full = [x for x in lines if re.search(BLANK, x)]
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    repeated = len({i + k for a in at.values() if len(a) > 1 for i in a for k in range(5)})
    chars = sum(map(len, words))
    return (
        len(words) < 10 or 100 * repeated > 20 * len(words) or 10 * len(re.findall(r"[#*$%&|<>]", text)) > 3 * chars
        or 2 * (len(full) - len(set(full))) > len(lines) or not 2 * len(words) <= chars <= 30 * len(words)
        or 10 * len(re.findall("[A-Z]", text)) > 6 * chars
    )


def shingles(text):
    """The set of runs of five lower-cased words; of all words if there are fewer."""
    w = re.findall(BLANK, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def one_of_each(rows):
    """Of texts linked by a similarity of 0.8 or more, the one of the smallest doc_id."""
    own = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if own[i] == own[j] or 10 * both >= 8 * (len(own[i]) + len(own[j]) - both):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    best = {}
    for r, g in zip(rows, group):
        if g not in best or (r[0] is None, r[0] or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = r
    return list(best.values())


def levels(sizes, total, weights):
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * s, mid * w) for s, w in zip(sizes, weights)) < total else (lo, mid)
    return [min(2 * s, hi * w) for s, w in zip(sizes, weights)]


def corpus(seed=5):
    """Good prose, junk of other words and shapes, near and exact copies, odd rows; and the labels of some."""
    rng = random.Random(seed)
    good, bad = ([f"{p}{a}{b}" for a in "aeiou" for b in "lmnrst"] for p in ("ver", "zx-9q"))
    rows, labels, junk = [], [], set()
    for i in range(200):
        poor = i % 4 == 0
        rows.append((i, " ".join(rng.choices(bad if poor else good, k=rng.randint(40, 90))), "en", ["a", "b", None][i % 3]))
        if i % 3:
            labels.append((i, 0 if poor else 1, 0))
        if poor:
            junk.add(i)
    for i in range(1, 60, 2):
        rows.append((300 + i, rows[i][1] + (" tail" if i % 3 else ""), "en", "b"))
    rows += [(400, None), (401, ""), (402, "short one"), (403, "# " * 60), (1, rows[1][1], "en", "a"), (None, rows[2][1] + " x", "en", "c"), (404, "again and again " * 40)]
    return [(*r, *[None, None][: 4 - len(r)]) for r in rows], labels, junk


def test_pipeline_against_brute_force(spark, folder):
    rows, labels, junk = corpus()
    got = corpus_pipeline.run(spark, folder(documents=rows, labels=labels)).collect()
    left = one_of_each([r for r in rows if not rejected(r[1]) and not (r[0] in junk or r[0] is not None and r[0] >= 300 and r[0] - 300 in junk)])
    t = Tokenizer.from_file(tokenizer_path())
    tokens = {r[0]: len(t.encode(r[1], add_special_tokens=False).ids) + 1 for r in left}
    size = {r[0]: len(re.findall(BLANK, r[1])) for r in left}
    packed = collections.Counter()
    for r in got:
        packed[r.doc_id] += r.length
        assert r.doc_tokens == tokens[r.doc_id]  # nothing that a stage rejects comes back
    times = {d: n // tokens[d] for d, n in packed.items()}
    assert all(n == times[d] * tokens[d] and times[d] in (1, 2) for d, n in packed.items())
    per = collections.Counter()
    for r in left:
        per[r[3]] += size[r[0]]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    for s, goal in zip(order, levels([per[s] for s in order], 1.5 * sum(per.values()), [(5, 2, 1)[i % 3] for i in range(len(order))])):
        own = [r[0] for r in left if r[3] == s]
        assert abs(sum(times.get(d, 0) * size[d] for d in own) - goal) <= max(size[d] for d in own)
    held = collections.Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held[r.sequence_id]
        held[r.sequence_id] += r.length
    assert sorted(held) == list(range(len(held))) and all(held[s] == 2048 for s in range(len(held) - 1))


@pytest.mark.parametrize("rows", [[(1, None)], [(None, None, None, None)] * 3], ids=["null text", "null rows"])
def test_pipeline_on_rows_of_nulls(spark, folder, rows):
    assert corpus_pipeline.run(spark, folder(documents=rows)).count() == 0


def test_reruns_agree_when_files_are_split_otherwise(spark, folder):
    rows, labels, _ = corpus()
    path = folder(documents=rows, labels=labels)
    want = sorted((r.doc_id is None, r.doc_id, r.start, r.doc_tokens) for r in corpus_pipeline.run(spark, path).collect() if r.start == 0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = sorted((r.doc_id is None, r.doc_id, r.start, r.doc_tokens) for r in corpus_pipeline.run(spark, path).collect() if r.start == 0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def test_scratch_tables_go(tmp_path):
    """At most two copies of the texts stand at a time, and nothing after the session."""
    code = f"""
import os, sys
from pyspark.sql import SparkSession
base = {str(tmp_path)!r}
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", base).getOrCreate())
import corpus_pipeline
from strandline import scratch
size = lambda path: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)
texts = lambda: sum("text" in spark.read.parquet(p).columns for p in scratch.folders(spark))
docs, held = spark.read.parquet({SF!r} + "/documents.parquet"), []
for k, (name, step) in enumerate(corpus_pipeline.STAGES):
    out = step(spark, docs, {SF!r})
    held.append((name, texts(), len(scratch.folders(spark))))
    out.write.parquet(base + "/out-" + str(k))
    docs = spark.read.parquet(base + "/out-" + str(k))
print(held)
assert all(n <= 1 and folders <= 2 for _, n, folders in held), held
corpus_pipeline.run(spark, {SF!r}).count()
assert texts() == 0, held
spark.stop()
assert [x for x in os.listdir(base) if x.startswith("strandline")] == []
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=300)
