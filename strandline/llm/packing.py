"""Concatenate and cut: documents become one token stream, cut into fixed windows.

First pass: tokenize, and keep with each document the running token total of its
partition. The partition totals, one row a partition, give global offsets. Second pass:
a document's place in the stream is its partition's offset plus its running total, so
windows are arithmetic and a document that crosses a border leaves one record a window.
Nothing is shuffled and no text is tokenized twice.

Defined results: a null text counts as empty and packs its end token alone; repeated rows
are packed each; null ids pass through; an empty table gives an empty result; other
columns are not read. Only the last sequence can need padding. A text that holds one of the
tokenizer's added tokens (an end-of-text mark, say) gets the ids the tokenizer itself gives.
Texts of any length are packed whole.
"""

from __future__ import annotations

import gc
import zlib
from array import array
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialize, process_cache, quiet_threads, table, tokenizer_path

LENGTH = 2048
END_ID = 1
#: Words, and characters of words, whose ids a Python worker remembers; beyond, it starts to remember anew.
CACHED_WORDS, CACHED_CHARS = 700_000, 16_000_000
#: New words that are encoded as one text.
WORDS_A_TEXT = 1000
#: Fixed value: white space other than the blank and the line feed.
OTHER_BLANKS = [chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def uneven(text: str) -> bool:
    """White space beside white space, or of an unusual kind: there splits may look beyond it."""
    return (
        "  " in text or "\n " in text or " \n" in text or "\n\n" in text or any(c in text for c in OTHER_BLANKS)
    )


class Encoder:
    """Token ids of whole texts as little-endian uint16, with an end id.

    Where white space stands alone, a byte-level BPE never merges over it: a word has ids of
    its own, with the blank before it or, at the start of a line, without. Those are
    remembered, and new words are encoded many at once, a line each. Any other text goes to
    the tokenizer whole.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        quiet_threads()
        self.tokenizer = Tokenizer.from_file(path)
        #: tokens that the tokenizer finds before it splits words, such as an end-of-text mark
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.end = array("H", [end_id]).tobytes()
        (self.line_id,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = array("H", [self.line_id]).tobytes()
        self.leading: dict[str, bytes] = {"": b""}  # a line's first word
        self.spaced: dict[str, bytes] = {}  # a word with the blank before it
        self.marks: dict[str, bytes] = {}  # marks after letters
        self.held = 0  # characters of all these

    def ids(self, texts: list[str]) -> list[array]:
        return [array("H", e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, known: dict[str, bytes], words: list[str], before: str) -> None:
        """Ids of words that hold no white space.

        Letters and the marks after them are split before merging, so such a word is its
        letters' ids and its marks' ids: most are known from other words.
        """
        plain: set[str] = set()
        made: list[tuple[str, str, str]] = []
        for word in words:
            letters = word.rstrip(punctuation)
            if letters != word and letters.isalpha():
                made.append((word, letters, word[len(letters) :]))
                if letters not in known:
                    plain.add(letters)
            else:
                plain.add(word)
        self.encode_words(known, list(plain), before)
        self.encode_words(self.marks, list({m for _, _, m in made}.difference(self.marks)), "")
        for word, letters, marks in made:
            known[word] = known[letters] + self.marks[marks]

    def encode_words(self, known: dict[str, bytes], words: list[str], before: str) -> None:
        """Words are encoded WORDS_A_TEXT to a text, one a line, and cut at the line feeds."""
        parts = [words[k : k + WORDS_A_TEXT] for k in range(0, len(words), WORDS_A_TEXT)]
        for part, ids in zip(parts, self.ids([before + ("\n" + before).join(p) for p in parts])):
            ids.append(self.line_id)
            cuts = np.flatnonzero(np.frombuffer(ids, np.uint16) == self.line_id).tolist()
            if len(cuts) != len(part):
                raise ValueError("the tokenizer merges over line feeds")
            raw, start = ids.tobytes(), 0
            for word, stop in zip(part, cuts):
                known[word] = raw[2 * start : 2 * stop]
                start = stop + 1

    def encode(self, texts: list[str | None]) -> list[bytes]:
        first, later = self.leading, self.spaced
        get, odd = later.get, []
        plan: list[list[list] | None] = []
        gaps: list[tuple[list, int, str]] = []  # a line's words, the place of an unknown one, and that word
        for t in texts:
            if not t or uneven(t) or any(a in t for a in self.added):
                plan.append(None)
                odd.append(t or "")
                continue
            lines = []
            for line in t.split("\n"):
                words = line.split(" ")
                row = list(map(get, words))
                row[0] = first.get(words[0])
                if None in row:
                    gaps += [(row, i, words[i]) for i, x in enumerate(row) if x is None]
                lines.append(row)
            plan.append(lines)
        whole = iter(self.ids(odd))
        lead, rest = {w for _, i, w in gaps if not i}, {w for _, i, w in gaps if i}
        if "" in rest:  # a trailing blank leaves an empty word, which can't have a line of its own
            rest.discard("")
            later[""] = self.ids([" "])[0].tobytes()
        self.held += sum(map(len, lead)) + sum(map(len, rest))
        self.learn(first, list(lead), "")
        self.learn(later, list(rest), " ")
        for row, i, word in gaps:
            row[i] = later[word] if i else first[word]
        join, line = b"".join, self.line
        out = [(next(whole).tobytes() if rows is None else line.join(map(join, rows))) + self.end for rows in plan]
        if self.held > CACHED_CHARS or len(first) + len(later) + len(self.marks) > CACHED_WORDS:
            self.leading, self.spaced, self.marks, self.held = {"": b""}, {}, {}, 0
        return out


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (uint16 bytes), n, and start: the tokens before it in its partition __pid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        cache = process_cache("encoders")
        if (path, end_id) not in cache:
            cache[path, end_id] = Encoder(path, end_id)
        encoder, total = cache[path, end_id], 0
        for b in batches:
            gc.disable()  # a batch makes many small objects and no cycles
            try:
                ids = encoder.encode(b.column("text").to_pylist())
            finally:
                gc.enable()
            n = np.fromiter((len(x) // 2 for x in ids), np.int64, len(ids))
            ends = np.cumsum(n)
            arrays = [b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(n), pa.array(ends - n + total)]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(np.full(len(ids), pid, np.int32))], names=["doc_id", "ids", "n", "start", "__pid"]
            )
            total += int(n.sum())

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        docs, [F.col("doc_id"), F.col("text")], run, f"doc_id {kind}, ids binary, n long, start long, __pid int"
    )


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces, with their ids as uint16 bytes in `ids`: one row a document and window."""
    spark = docs.sparkSession
    stream = materialize(tokenized(docs, path, end_id))
    totals = stream.groupBy("__pid").agg(F.sum("n").alias("n")).orderBy("__pid").collect()  # a row a partition
    offsets, at = [], 0
    for r in totals:
        offsets.append((r["__pid"], at))
        at += r["n"]
    shift = F.broadcast(spark.createDataFrame(offsets, "__pid int, __offset long"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.column("place").to_numpy(zero_copy_only=False)
            n = b.column("n").to_numpy(zero_copy_only=False)
            ids = b.column("ids").to_pylist()
            row, starts, sizes, parts, crcs = [], [], [], [], []
            for k, (g, m, x) in enumerate(zip(place.tolist(), n.tolist(), ids)):
                lo = 0
                while lo < m:
                    hi = min(m, lo + length - (g + lo) % length)
                    part = x[2 * lo : 2 * hi]
                    row.append(k)
                    starts.append(lo)
                    sizes.append(hi - lo)
                    parts.append(part)
                    crcs.append(zlib.crc32(np.frombuffer(part, "<u2").astype("<u4").tobytes()))
                    lo = hi
            row = np.array(row, np.int64)
            starts = np.array(starts, np.int64)
            at = place[row] + starts
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(row)),
                    pa.array(starts),
                    pa.array(sizes, pa.int64()),
                    pa.array(crcs, pa.int64()),
                    pa.array(n[row]),
                    pa.array(at // length),
                    pa.array(at % length),
                    pa.array(parts, pa.binary()),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    placed = stream.join(shift, "__pid").withColumn("place", F.col("start") + F.col("__offset"))
    return map_batches(
        placed,
        [F.col(c) for c in ("doc_id", "place", "n", "ids")],
        run,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary",
    )


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """sequence_id and ids (uint16 bytes, padded to `length`): a group holds at most `length` ids."""
    joined = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    whole = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    pad = F.lit(array("H", [pad_id]).tobytes() * length)
    return joined.select("sequence_id", F.substring(F.concat(whole, pad), 1, 2 * length).alias("ids"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")
