"""Byte-level BPE encoding and decoding by a two-tier lookup.

A text is split into pre-tokens by the tokenizer's pattern. First tier: a minimal perfect
hash over the vocabulary gives every distinct pre-token of a batch the one slot where it
could be, and its bytes are compared there, all in arrays; most pre-tokens are whole
entries and end here. Second tier, for misses: the pre-token's bytes are a linked list, a heap
holds the ranks of adjacent pairs, and the least rank, of equal ones the leftmost, is
merged until none is left; pairs are looked up in the vocabulary. Decoding joins the
entries' bytes. Both are passes without a shuffle.

The hash is made on the driver from the vocabulary alone (its size is the vocabulary's, about
2 MB here) and sent to the executors once.

Defined results: a null text counts as empty and has no ids; repeated rows are encoded each;
null ids of documents pass through; texts of any length are encoded whole, a bounded number
of pre-tokens at a time, and so are pre-tokens of any length, in n log n steps; strings that
name special tokens are ordinary text; an empty table gives an empty result; other columns
are neither read nor clashed with. Ids outside the vocabulary fail to decode.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_field, map_batches, process_cache, table, tokenizer_path

#: Pre-tokens looked up at a time, and characters of texts that share a lookup.
TOKENS, CHARS = 1 << 17, 1 << 20
#: Bytes of misses (with their ids) that a Python worker remembers; beyond, it starts anew. Longer pre-tokens aren't remembered.
REMEMBERED, LONGEST = 96 << 20, 256
#: Bytes of a batch that is handed on.
FLUSH = 16 << 20
#: Keys a bucket of the perfect hash, on average.
LOAD = 1
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    for m in MIX:
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


def hashes(flat: np.ndarray, sizes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the strings that lie end to end in flat; none longer than `powers`, none empty."""
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - np.repeat(starts, sizes)
    return mixed(np.add.reduceat((flat.astype(np.uint64) + np.uint64(1)) * powers[place], starts))


def slots(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    """A hash's slot under its bucket's seed; a negative seed is the slot itself."""
    moved = (mixed(h + seed.astype(np.uint64) * STEP) % np.uint64(n)).astype(np.int64)
    return np.where(seed < 0, -seed - 1, moved)


class Vocabulary:
    """Byte strings by rank, found through a minimal perfect hash: as many slots as entries."""

    def __init__(self, entries: list[tuple[bytes, int]]):
        self.keys, self.ids = [k for k, _ in entries], np.array([r for _, r in entries], np.int64)
        sizes = np.array([len(k) for k in self.keys], np.int64)
        n, flat = len(entries), np.frombuffer(b"".join(self.keys), np.uint8)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.full(int(sizes.max()), BASE), dtype=np.uint64)
            h = hashes(flat, sizes, self.powers)
            if len(np.unique(h)) < n:
                raise ValueError("two entries have one hash")
            self.seeds = np.zeros(max(1, n // LOAD), np.int64)
            at = self.place(h, n)
        #: slot -> entry, its size and where its bytes begin
        self.entry = np.empty(n, np.int64)
        self.entry[at] = np.arange(n)
        self.sizes, self.starts, self.flat = sizes, np.cumsum(sizes) - sizes, flat
        order = np.full(int(self.ids.max()) + 1, -1)
        order[self.ids] = np.arange(n)
        self.by_id = order  # rank -> entry

    def place(self, h: np.ndarray, n: int) -> np.ndarray:
        """Find a seed for each bucket, full ones first, so that no two entries share a slot.

        Buckets of one size try a seed together; of those that want one slot the first gets it.
        """
        bucket = (h % np.uint64(len(self.seeds))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        count = np.bincount(bucket, minlength=len(self.seeds))
        starts = np.cumsum(count) - count
        taken, out = np.zeros(n, bool), np.empty(n, np.int64)
        for size in range(int(count.max()), 1, -1):
            left, seed = np.flatnonzero(count == size), 0
            while len(left):
                own = order[starts[left][:, None] + np.arange(size)]
                at = slots(h[own], np.full(own.shape, seed), n)
                ordered = np.sort(at, axis=1)
                free = np.flatnonzero(~taken[at].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
                first = np.full(n, len(left))
                np.minimum.at(first, at[free].ravel(), np.repeat(free, size))
                got = free[(first[at[free]] == free[:, None]).all(axis=1)]
                self.seeds[left[got]], out[own[got]], taken[at[got]] = seed, at[got], True
                left, seed = np.delete(left, got), seed + 1
        alone, rest = np.flatnonzero(count == 1), np.flatnonzero(~taken)  # a lone entry takes any free slot
        self.seeds[alone], out[order[starts[alone]]] = -rest - 1, rest
        return out

    def look_up(self, tokens: list[bytes]) -> np.ndarray:
        """The rank of each token, none of them empty, or -1."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        fit = np.flatnonzero(sizes <= len(self.powers))
        out = np.full(len(tokens), -1)
        if not len(fit):
            return out
        sizes = sizes[fit]
        flat = np.frombuffer(b"".join(tokens if len(fit) == len(tokens) else [tokens[i] for i in fit.tolist()]), np.uint8)
        with np.errstate(over="ignore"):
            h = hashes(flat, sizes, self.powers)
            entry = self.entry[slots(h, self.seeds[(h % np.uint64(len(self.seeds))).astype(np.int64)], len(self.keys))]
        like = np.flatnonzero(self.sizes[entry] == sizes)
        if len(like):
            starts = (np.cumsum(sizes) - sizes)[like]
            of = sizes[like]
            place = np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of)
            same = flat[np.repeat(starts, of) + place] == self.flat[np.repeat(self.starts[entry[like]], of) + place]
            whole = np.logical_and.reduceat(same, np.cumsum(of) - of)
            out[fit[like[whole]]] = self.ids[entry[like[whole]]]
        return out

    def ranks(self) -> dict[bytes, int]:
        return dict(zip(self.keys, self.ids.tolist()))

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        if not len(ids):
            return b""
        if ids.max() >= len(self.by_id) or (self.by_id[ids] < 0).any():
            raise ValueError("an id is not in the vocabulary")
        keys = self.keys
        return b"".join([keys[e] for e in self.by_id[ids].tolist()])


def merged(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token by merging: a heap of pairs over linked bytes.

    A part begins at i and ends where the next begins, at after[i]. pair[i] is the rank of the
    part with the next one, and the heap holds (rank, i); what pair doesn't hold any more is
    passed over.
    """
    n, get = len(token), ranks.get
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    pair = [get(token[i : i + 2], -1) for i in range(n - 1)]
    pair.append(-1)
    heap = [(r, i) for i, r in enumerate(pair) if r >= 0]
    heapify(heap)
    while heap:
        r, i = heappop(heap)
        if pair[i] != r:
            continue
        gone = after[i]
        pair[gone] = pair[i] = -1  # no longer parts, or to be set below
        after[i] = stop = after[gone]
        if stop < n:
            before[stop] = i
            pair[i] = r = get(token[i : after[stop]], -1)
            if r >= 0:
                heappush(heap, (r, i))
        if (h := before[i]) >= 0:
            pair[h] = r = get(token[h:stop], -1)
            if r >= 0:
                heappush(heap, (r, h))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Ids of whole texts as little-endian uint32."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.ranks, self.pattern = vocabulary, vocabulary.ranks(), regex.compile(pattern)
        self.misses: dict[bytes, list[int]] = {}
        self.remembered = 0

    def of_tokens(self, tokens: list[bytes]) -> list[list[int]]:
        """Ids of distinct pre-tokens."""
        found = self.vocabulary.look_up(tokens)
        out = [[r] for r in found.tolist()]
        for i in np.flatnonzero(found < 0).tolist():
            token = tokens[i]
            ids = self.misses.get(token)
            if ids is None:
                ids = merged(token, self.ranks)
                if len(token) <= LONGEST:
                    if self.remembered > REMEMBERED:
                        self.misses, self.remembered = {}, 0
                    self.misses[token] = ids
                    self.remembered += 250 + 9 * len(token)
            out[i] = ids
        return out

    def joined(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pre-tokens, one after another, and how many ids each pre-token has."""
        known: dict[str, int] = {}
        for t in tokens:
            if t not in known:
                known[t] = len(known)
        at = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        if not len(at):
            return np.empty(0, "<u4"), at
        ids = self.of_tokens([t.encode() for t in known])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        starts, n = np.cumsum(sizes) - sizes, sizes[at]
        flat = np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum()))
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return flat[np.repeat(starts[at], n) + place], n

    def long(self, text: str) -> bytes:
        """One text, TOKENS pre-tokens at a time."""
        tokens = (m.group() for m in self.pattern.finditer(text))
        parts = []
        while part := list(islice(tokens, TOKENS)):
            parts.append(self.joined(part)[0].tobytes())
        return b"".join(parts)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Texts share a lookup, up to CHARS characters together."""
        held, size = [], 0
        for t in texts:
            t = t or ""
            if held and size + len(t) > CHARS:
                yield from self.together(held)
                held, size = [], 0
            if len(t) > CHARS:
                yield self.long(t)
            else:
                held.append(t)
                size += len(t)
        yield from self.together(held)

    def together(self, texts: list[str]) -> Iterator[bytes]:
        split = [self.pattern.findall(t) for t in texts]
        ids, n = self.joined([t for own in split for t in own])
        ends = np.cumsum(np.r_[0, n])[np.cumsum([len(own) for own in split], dtype=np.int64)] if split else []
        lo = 0
        for hi in ends:
            yield ids[lo:hi].tobytes()
            lo = hi


def read_vocabulary(path: str) -> Vocabulary:
    """A rank file: a base64 entry and its rank a line."""
    with open(path, "rb") as lines:
        return Vocabulary([(base64.b64decode(a), int(b)) for a, b in (x.split() for x in lines if x.strip())])


def flushed(ids: pa.Array, made: Iterator[tuple], names: list[str], fields: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of the key column and what `made` gives a row (bytes last), of about FLUSH bytes each."""
    held, size, done = [], 0, 0
    for row in made:
        held.append(row)
        size += len(row[-1])
        if size > FLUSH:
            yield pa.RecordBatch.from_arrays([ids.slice(done, len(held)), *[pa.array(c, f) for c, f in zip(zip(*held), fields)]], names=names)
            held, size, done = [], 0, done + len(held)
    if held:
        yield pa.RecordBatch.from_arrays([ids.slice(done, len(held)), *[pa.array(c, f) for c, f in zip(zip(*held), fields)]], names=names)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian uint32) of every text, by the rank file at `path`."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = process_cache("byte_pairs")
        if (path, pattern) not in cache:
            cache[path, pattern] = Encoder(shared.value, pattern)
        encoder = cache[path, pattern]
        for b in batches:
            ids = ((len(x) // 4, x) for x in encoder.encode(b.column("text").to_pylist()))
            yield from flushed(b.column("doc_id"), ids, ["doc_id", "n_tokens", "ids"], [pa.int64(), pa.binary()])

    return map_batches(docs, [F.col("doc_id"), F.col("text")], run, f"{id_field(docs)}, n_tokens long, ids binary")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """tokens (doc_id, n_tokens, ids) with `bytes`, what the ids stand for."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for b in batches:
            rows = zip(b.column("n_tokens").to_pylist(), b.column("ids").to_pylist())
            made = ((n, x, vocabulary.decoded(np.frombuffer(x, "<u4").astype(np.int64))) for n, x in rows)
            yield from flushed(b.column("doc_id"), made, ["doc_id", "n_tokens", "ids", "bytes"], [pa.int64(), pa.binary(), pa.binary()])

    return map_batches(tokens, [F.col(c) for c in ("doc_id", "n_tokens", "ids")], run, f"{id_field(tokens)}, n_tokens long, ids binary, bytes binary")


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes decoded from them, of every document."""
    from public_tokenizers import PATTERN

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    whole = decoded(encoded(table(spark, sf_dir, "documents"), path, PATTERN), path)
    return whole.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
