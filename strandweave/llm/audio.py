"""Audio columns: polyphase resampling, log-mel filterbanks and energy segments as fixed-shape Arrow tensors."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames as fr


@dataclass(frozen=True)
class AudioSpec:
    """up / down is the resampling ratio; frame and hop are in resampled samples; high and low in dB over the median."""

    rate: int = 8000
    up: int = 2
    down: int = 3
    taps: int = 16
    frame: int = 256
    hop: int = 128
    mels: int = 40
    chunk: int = 32
    high: float = 2.0
    low: float = 0.5

    @property
    def out_rate(self) -> float:
        return self.rate * self.up / self.down


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """A WAV file of unsigned 8-bit mono samples, one for each byte."""
    sink = io.BytesIO()
    with wave.open(sink, "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(1)
        out.setframerate(rate)
        out.writeframes(payload)
    return sink.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as source:
        if source.getsampwidth() != 1 or source.getnchannels() != 1:
            raise ValueError("8-bit mono is expected")
        return source.readframes(source.getnframes())


@lru_cache(maxsize=8)
def phases(spec: AudioSpec) -> np.ndarray:
    """The low-pass filter, a windowed sinc, as one row of taps for each of the `up` phases."""
    n = spec.up * spec.taps
    t = (np.arange(n) - (n - 1) / 2) / max(spec.up, spec.down)
    h = np.sinc(t) * np.hanning(n + 2)[1:-1]
    h *= spec.up / h.sum()
    return h.reshape(spec.taps, spec.up).T.astype(np.float32)


def resample(x: np.ndarray, spec: AudioSpec) -> np.ndarray:
    """Polyphase: output n takes the taps of phase (n * down) mod up from sample (n * down) div up backwards."""
    size = -(-len(x) * spec.up // spec.down)
    padded = np.concatenate([np.zeros(spec.taps - 1, np.float32), x, np.zeros(spec.taps, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, spec.taps)
    out = np.empty(size, np.float32)
    for r in range(spec.up):
        n = len(range(r, size, spec.up))
        at = r * spec.down // spec.up
        out[r :: spec.up] = windows[at : at + n * spec.down : spec.down][:n] @ phases(spec)[r * spec.down % spec.up][::-1]
    return out


@lru_cache(maxsize=8)
def filterbank(spec: AudioSpec) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, overlapping by half."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    top = spec.out_rate / 2
    edges = 700 * (10 ** (np.linspace(0, mel(top), spec.mels + 2) / 2595) - 1)
    freq = np.linspace(0, top, spec.frame // 2 + 1)[:, None]
    rise = (freq - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - freq) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mels(y: np.ndarray, spec: AudioSpec) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames x mels) and frame energy in dB, in slices of frames; a short signal is one padded frame."""
    n = max(1, -(-(len(y) - spec.frame) // spec.hop) + 1)
    y = np.concatenate([y, np.zeros(max(0, (n - 1) * spec.hop + spec.frame - len(y)), np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(y, spec.frame)[:: spec.hop][:n]
    shape = np.hanning(spec.frame + 1)[:-1].astype(np.float32)
    mels, energy = [], []
    for k in range(0, n, 4096):
        part = windows[k : k + 4096]
        power = np.abs(np.fft.rfft(part * shape)).astype(np.float32) ** 2
        mels.append(np.log(power @ filterbank(spec) + 1e-6))
        energy.append(10 * np.log10((part * part).mean(axis=1) + 1e-9))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray, spec: AudioSpec) -> np.ndarray:
    """Stretches (first frame, end) that begin over the high threshold and last while over the low one."""
    level = np.median(energy)
    above, below = energy >= level + spec.high, energy < level + spec.low
    event = np.where(above, 1, np.where(below, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = np.where(last >= 0, event[np.maximum(last, 0)], -1) == 1
    edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return edges.reshape(-1, 2)


def features(samples: bytes, spec: AudioSpec) -> tuple[bytes, str]:
    """An Arrow stream of tensors (chunk x mels, half floats) with their time spans, and a short description.

    A chunk's rows are log_mel, start_s, end_s, n_frames and the energy segments within it, in seconds.
    The last chunk is filled with zeros beyond n_frames.
    """
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mels, energy = log_mels(resample(x, spec), spec)
    spans = segments(energy, spec)
    n = -(-len(mels) // spec.chunk)
    held = np.zeros((n * spec.chunk, spec.mels), np.float16)
    held[: len(mels)] = mels
    step = spec.hop / spec.out_rate
    starts = np.arange(n) * spec.chunk
    ends = np.minimum(starts + spec.chunk, len(mels))
    kind = pa.fixed_shape_tensor(pa.float16(), (spec.chunk, spec.mels))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(held.ravel()), spec.chunk * spec.mels)
    within = [[{"start_s": max(a, s) * step, "end_s": min(b, e) * step} for a, b in spans[(spans[:, 0] < e) & (spans[:, 1] > s)].tolist()] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    table = pa.table(
        {
            "log_mel": pa.ExtensionArray.from_storage(kind, flat),
            "start_s": starts * step,
            "end_s": ends * step,
            "n_frames": ends - starts,
            "segments": pa.array(within, pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))),
        }
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    text = f"frames={len(mels)};segments={len(spans)};active={int((spans[:, 1] - spans[:, 0]).sum())};level_db={np.median(energy):.1f};mel=" + ",".join(f"{v:.1f}" for v in mels.mean(axis=0, dtype=np.float64))
    return sink.getvalue().to_pybytes(), text


def audio_columns(df: DataFrame, spec: AudioSpec | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's text as audio: media (WAV), features (Arrow tensors), their description and checksums.

    The payload is the text's UTF-8 with blanks up to a positive multiple of 192 bytes; it is stored as 8-bit
    samples, read back from the stored form, and only what was read back is measured.  A null text is empty,
    a null id stays null, equal texts get equal values and repeated rows are answered each; an empty table gives no rows.
    """
    spec = spec or AudioSpec()
    schema = pa.schema(
        [("doc_id", pa.int64())]
        + [(n, pa.int64()) for n in ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes")]
        + [(n, pa.string()) for n in ("payload_sha256", "media_sha256", "feature")]
        + [("media", pa.binary()), ("features", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in fr.batches_of(batches):
            rows = []
            for doc_id, text in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True):
                raw = text.encode("utf-8")
                media = to_wav(raw.ljust(max(192, -(-len(raw) // 192) * 192), b" "), spec.rate)
                payload = from_wav(media)
                tensors, described = features(payload, spec)
                rows.append((doc_id, len(raw), len(payload), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(payload).hexdigest(), hashlib.sha256(media).hexdigest(), described, media, tensors))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return fr.with_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, tail_crc32 long, media_bytes long, payload_sha256 string, media_sha256 string, feature string, media binary, features binary")
