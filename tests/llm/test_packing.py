import random
import zlib
from array import array

import numpy as np
import pytest
from tokenizers import Tokenizer

from strandline.llm import packing
from strandline.llm.common import tokenizer_path

ODD = [(1, None), (2, ""), (3, " "), (4, "a  b   c"), (5, "\n \n  x\t y \r\n z "), (6, "don't  we'll\x00 \x00b"), (7, "nb sp   wide"),
       (8, " lead and trail "), (8, "same id"), (None, "no id"), (9, "<|endoftext|> is text"), (16, "a <|endoftext|> b"), (17, "x<|endoftext|>"), (10, "x" * 9000), (11, "word " * 3000),
       (12, "\x00start of it"), (13, "\x00a  b"), (14, "é è　ü 日本 語"), (15, "#### 12,345.67 $%&")]


def encode(rows):
    t = Tokenizer.from_file(tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for _, x in rows]


def fuzz(n):
    rng = random.Random(2)
    return [(i, "".join(rng.choice([" ", " ", "\n", "\t", "ab", "The", "don't", "9", "é", "!!", " "]) for _ in range(rng.randint(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("rows", [ODD, fuzz(300), []], ids=["odd", "fuzz", "empty"])
def test_pieces(spark, folder, rows):
    path = folder(documents=rows)
    got = packing.op9_packing(spark, path).collect()
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sum(r.length for r in got) == sum(map(len, encode(rows)))
    for s, pieces in by_seq.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or s == max(by_seq)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for (doc, _), ids in zip(rows, encode(rows)):
        own = [r for r in by_doc[doc, len(ids)] if r.start + r.length <= len(ids)]
        crcs = {(r.start, r.length): r.ids_crc32 for r in own}
        if sum(1 for d, _ in rows if d == doc) == 1:
            at = 0
            for start, length in sorted(crcs):
                assert start == at
                assert crcs[start, length] == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
                at += length
            assert at == len(ids)


def test_sequences_round_trip(spark, folder):
    rows = [(i, f"text number {i} " * (i % 7 * 60)) for i in range(60)]
    docs = spark.read.parquet(folder(documents=rows) + "/documents.parquet")
    pieces = packing.pack(docs, tokenizer_path(), length=64)
    whole = {r.sequence_id: array("H", bytes(r.ids)) for r in packing.sequences(pieces, 64).collect()}
    assert all(len(x) == 64 for x in whole.values())
    want = dict(zip([i for i, _ in rows], encode(rows)))
    got = {}
    for r in pieces.collect():
        got.setdefault(r.doc_id, {})[r.start] = list(whole[r.sequence_id][r.offset : r.offset + r.length])
    assert {d: [x for _, p in sorted(parts.items()) for x in p] for d, parts in got.items()} == want


def test_added_tokens_get_the_tokenizers_own_ids():
    plain = Tokenizer.from_file(tokenizer_path()).encode("a <|endoftext|> b", add_special_tokens=False).ids
    assert plain == [64, 220, 50256, 275]
    (made,) = packing.Encoder(tokenizer_path()).encode(["a <|endoftext|> b"])
    assert np.frombuffer(made, "<u2").tolist() == [*plain, 1]


def test_long_words_are_forgotten(monkeypatch):
    """What is remembered is bounded by characters, and forgetting changes no id."""
    from tokenizers import Tokenizer

    from strandline.llm.common import tokenizer_path

    monkeypatch.setattr(packing, "CACHED_CHARS", 2000)
    encoder, plain = packing.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for i in range(6):
        text = " ".join(f"{chr(97 + i + k)}" * 700 for k in range(3)) + " short words and more"
        ids = np.frombuffer(encoder.encode([text])[0], "<u2").tolist()
        assert ids == plain.encode(text, add_special_tokens=False).ids + [packing.END_ID]
        assert encoder.held <= 2000
