"""Byte-level BPE against the library that reads the same rank file."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from strandline.llm import byte_pairs
from strandline.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return byte_pairs.read_vocabulary(PATH)


def test_perfect_hash(vocabulary):
    keys = vocabulary.keys
    assert sorted(vocabulary.entry.tolist()) == list(range(len(keys)))  # a slot each and none besides
    assert vocabulary.look_up(keys).tolist() == vocabulary.ids.tolist()
    known = set(keys)
    others = [k + b"\x01" for k in keys if k + b"\x01" not in known] + [b"x" * 1000]
    assert set(vocabulary.look_up(others).tolist()) == {-1}


def texts():
    rnd = random.Random(7)
    mixed = ["".join(rnd.choice("abcde 'é漢字\U0001f642.,!1\t\n　\x1c") for _ in range(rnd.randrange(60))) for _ in range(400)]
    return [
        None, "", " ", "\n", "a", "  a", "a  ", "it's we'll I'd 'S", "<|endoftext|> x", " 　", "\x00\x01", "é", "z" * 3000, "ab" * 2000,
        "word " * 3000, "\t" * 500, "\U0001f642" * 300, *mixed, *mixed[:50],
    ]


def test_ids_are_the_library_s(vocabulary, library, monkeypatch):
    for chars, tokens in ((byte_pairs.CHARS, byte_pairs.TOKENS), (100, 7)):
        monkeypatch.setattr(byte_pairs, "CHARS", chars)
        monkeypatch.setattr(byte_pairs, "TOKENS", tokens)
        encoder = byte_pairs.Encoder(vocabulary, public_tokenizers.PATTERN)
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts())]
        assert got == [library.encode_ordinary(t or "") for t in texts()]
        assert [vocabulary.decoded(np.array(x, np.int64)) for x in got] == [(t or "").encode() for t in texts()]


def test_forgetting_changes_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(byte_pairs, "REMEMBERED", 1000)
    encoder = byte_pairs.Encoder(vocabulary, public_tokenizers.PATTERN)
    for t in texts() * 2:
        assert np.frombuffer(b"".join(encoder.encode([t])), "<u4").tolist() == library.encode_ordinary(t or "")


def test_unknown_ids_fail(vocabulary):
    with pytest.raises(ValueError):
        vocabulary.decoded(np.array([1 << 20]))


def test_query(spark, folder, library):
    docs = [(i, t) for i, t in enumerate(texts())] + [(None, "x"), (3, "three again")]
    docs += [(900, "long text, " * 500_000), (901, "q" * 1_000_000)]  # 5.5 MB, and a word of 1 MB
    rows = byte_pairs.op11_byte_pairs(spark, folder(documents=docs)).collect()
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows), key=repr)
    want = []
    for i, t in docs:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_empty_table(spark, folder):
    assert byte_pairs.op11_byte_pairs(spark, folder()).collect() == []
