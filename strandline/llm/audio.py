"""Audio features over stored 8-bit sound.

Bytes are stored as 8-bit mono PCM in a WAVE container, read back, resampled by a polyphase
filter (each output uses one phase of a windowed-sinc low pass), cut into overlapping
windows and turned into log-mel bands. A two-threshold (hysteresis) pass over frame
energies marks segments. Bands are cut into tensors of a fixed shape, FRAMES x BANDS, each
with its time span; `tensor_array` wraps them as Arrow fixed-shape tensors. `stored` gives
the container and an Arrow stream of them a row; op6_audio writes that table to the shared
folder and derives everything it returns from the bytes read back.

Everything is worked out in pieces of bounded size, so long payloads need little memory.

Defined results: a null or empty text is 64 zero bytes of sound; repeated rows and equal
texts give the same values each; null ids pass through, of whatever type; texts of any
length are stored whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, id_field, map_batches, materialize, table

RATE = 8000
UP, DOWN = 3, 4
TAPS = 12
WINDOW, HOP = 256, 128
BANDS = 16
FRAMES = 32
#: Decibels above the mean energy at which a segment begins, and below which it ends.
BEGIN_DB, END_DB = 0.25, -0.25
#: Output samples resampled, and frames analysed, at a time.
PIECE, FRAME_PIECE = 1 << 16, 512


def payload(text: bytes) -> bytes:
    """The bytes, filled with 0 up to a positive multiple of 64."""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def to_wave(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM in a RIFF/WAVE container."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(samples) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * (len(samples) % 2)


def from_wave(media: bytes) -> tuple[bytes, int]:
    """The samples and rate of a container made of RIFF chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAVE container")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        if name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def low_pass(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """A Hamming-windowed sinc in `up` phases of `taps` taps: row p is phase p, oldest sample first."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    h *= up / h.sum()
    return np.ascontiguousarray(h.reshape(taps, up).T[:, ::-1]).astype(np.float32)


def resample(samples: bytes, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Output k is phase (k * down) % up of the filter over the samples up to k * down // up."""
    x = np.frombuffer(samples, np.uint8)
    bank = low_pass(up, down, taps)
    n = -(-len(x) * up // down)
    out = np.empty(n, np.float32)
    piece = PIECE // up * up
    for lo in range(0, n, piece):
        hi = min(n, lo + piece)
        first, last = lo * down // up - (taps - 1), (hi - 1) * down // up + 1
        part = np.full(last - first, 0, np.float32)
        a, b = max(first, 0), min(last, len(x))
        part[a - first : b - first] = (x[a:b].astype(np.float32) - 128.0) / 128.0
        windows = np.lib.stride_tricks.sliding_window_view(part, taps)
        for p in range(min(up, hi - lo)):
            k = np.arange(lo + p, hi, up)
            at = k[0] * down // up - lo * down // up
            out[lo + p : hi : up] = windows[at::down][: len(k)] @ bank[k[0] * down % up]
    return out


def mel_bank(rate: float, window: int = WINDOW, bands: int = BANDS) -> np.ndarray:
    """Triangles that overlap by half on the mel scale: frequencies x bands."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(window, 1 / rate)[:, None]
    rise = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


class Analyser:
    """Log-mel bands and segments; filters are made once."""

    def __init__(self, rate: int = RATE):
        self.rate = rate * UP / DOWN
        self.bank = mel_bank(self.rate)
        self.window = np.hanning(WINDOW).astype(np.float32)

    def log_mel(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(frames x BANDS log-mel, energy in dB of each frame)."""
        n = max(1, -(-(len(y) - WINDOW) // HOP) + 1)
        y = np.concatenate([y, np.zeros(max(0, (n - 1) * HOP + WINDOW - len(y)), np.float32)])
        frames = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP][:n]
        mel, energy = np.empty((n, BANDS), np.float32), np.empty(n, np.float32)
        for lo in range(0, n, FRAME_PIECE):
            part = frames[lo : lo + FRAME_PIECE] * self.window
            power = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32) ** 2
            mel[lo : lo + FRAME_PIECE] = np.log(power @ self.bank + 1e-6)
            energy[lo : lo + FRAME_PIECE] = 10 * np.log10((part * part).mean(axis=1) + 1e-9)
        return mel, energy

    def segments(self, energy: np.ndarray) -> list[tuple[float, float]]:
        """(start, stop) in seconds: from a frame above BEGIN_DB until one below END_DB."""
        level = energy - energy.mean()
        mark = np.where(level > BEGIN_DB, 1, np.where(level < END_DB, -1, 0))
        seen = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
        on = (seen >= 0) & (mark[np.maximum(seen, 0)] > 0)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
        step = HOP / self.rate
        return [(a * step, (b - 1) * step + WINDOW / self.rate) for a, b in edges.reshape(-1, 2).tolist()]

    def tensors(self, mel: np.ndarray) -> Iterator[tuple[float, float, np.ndarray]]:
        """(start, stop, FRAMES x BANDS) pieces; the last one is filled with its lowest value."""
        step = HOP / self.rate
        for lo in range(0, len(mel), FRAMES):
            part = mel[lo : lo + FRAMES]
            full = np.full((FRAMES, BANDS), part.min(), np.float32)
            full[: len(part)] = part
            yield lo * step, (lo + len(part) - 1) * step + WINDOW / self.rate, full


def digest(mel: np.ndarray, segments: list[tuple[float, float]]) -> str:
    """Frames, mean of each band, segments and the seconds they span, as text."""
    means = ",".join(f"{v + 0.0:.2f}" for v in mel.mean(axis=0, dtype=np.float64))
    return f"{len(mel)};{means};{len(segments)};{sum(b - a for a, b in segments):.3f}"


def tensor_array(values: np.ndarray) -> pa.Array:
    """n x FRAMES x BANDS numbers as an Arrow fixed-shape tensor array."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(values, np.float32))


def to_ipc(pieces: list[tuple[float, float, np.ndarray]]) -> bytes:
    """Pieces as an Arrow stream: start_s, stop_s and a fixed-shape tensor each."""
    values = tensor_array(np.stack([m for _, _, m in pieces]))
    made = pa.record_batch([pa.array([p[k] for p in pieces], pa.float64()) for k in (0, 1)] + [values], names=["start_s", "stop_s", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, made.schema) as out:
        out.write_batch(made)
    return sink.getvalue().to_pybytes()


def from_ipc(stored: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start_s, stop_s and the n x FRAMES x BANDS numbers of an Arrow stream."""
    read = pa.ipc.open_stream(stored).read_all().combine_chunks()
    values = read.column("log_mel").chunk(0)
    if not isinstance(values.type, pa.FixedShapeTensorType) or list(values.type.shape) != [FRAMES, BANDS]:
        raise ValueError(f"no tensors of {FRAMES} x {BANDS}")
    return read.column("start_s").to_numpy(), read.column("stop_s").to_numpy(), values.to_numpy_ndarray()


def joined(start: np.ndarray, stop: np.ndarray, values: np.ndarray, rate: float = RATE * UP / DOWN) -> np.ndarray:
    """Frames x BANDS of all pieces: as many frames of each as its span has, without its filling."""
    frames = np.rint((stop - start - WINDOW / rate) * rate / HOP).astype(np.int64) + 1
    return values[np.arange(FRAMES) < frames[:, None]]


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, an Arrow stream of fixed-shape tensors with their spans, and the segments, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyser = Analyser()
        for b in batches:
            for k, t in enumerate(binary(b.column("text"))):  # a row at a time: media and tensors are large
                media = to_wave(payload(t or b""))
                mel, energy = analyser.log_mel(resample(from_wave(media)[0]))
                spans = [{"start_s": a, "stop_s": z} for a, z in analyser.segments(energy)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(k, 1),
                        pa.array([len(t or b"")], pa.int64()),
                        pa.array([media], pa.binary()),
                        pa.array([to_ipc(list(analyser.tensors(mel)))], pa.binary()),
                        pa.array([spans], pa.list_(pa.struct([("start_s", pa.float64()), ("stop_s", pa.float64())]))),
                    ],
                    names=["doc_id", "n_bytes", "media", "tensors", "segments"],
                )

    schema = f"{id_field(docs)}, n_bytes long, media binary, tensors binary, segments array<struct<start_s: double, stop_s: double>>"
    return map_batches(docs, [F.col("doc_id"), F.col("text")], run, schema)


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored and read back of every document, and the features of the tensors read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                n, media, tensors_, spans = (b.column(c)[k].as_py() for c in ("n_bytes", "media", "tensors", "segments"))
                back, _ = from_wave(media)
                rows.append(
                    (
                        n,
                        len(back),
                        hashlib.sha256(back).hexdigest(),
                        zlib.crc32(back[-64:]),
                        len(media),
                        hashlib.sha256(media).hexdigest(),
                        digest(joined(*from_ipc(tensors_)), [(s["start_s"], s["stop_s"]) for s in spans]),
                    )
                )
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made], names=names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    docs = table(spark, sf_dir, "documents")
    schema = (
        f"{id_field(docs)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )
    made = materialize(stored(docs))
    return map_batches(made, [F.col(c) for c in ("doc_id", "n_bytes", "media", "tensors", "segments")], run, schema)
