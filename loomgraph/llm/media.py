"""Media columns (8): audio features of 8-bit samples.

A payload is stored as a mono 8-bit PCM file (RIFF/WAVE), which holds it byte for byte. What is stored is read
back, resampled by a polyphase filter (3 up, 4 down), cut into overlapped frames, and turned into log-mel bands.
Frames are grouped to segments by energy with hysteresis: a segment opens above the higher threshold and closes
below the lower one. The bands leave as Arrow tensors of one fixed shape, each with its time span.

All numbers of a document depend on its bytes alone, never on the batch that it came in.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.common import arrow_schema, documents, ship, slices

UNIT = 576
PAD = 255
RATE = 8000
UP, DOWN = 3, 4
TAPS = 16
FRAME, HOP = 256, 128
BANDS = 32
CLIP = 64
OPEN_DB, CLOSE_DB = 1.0, 0.5
#: The columns that media_table can return.
COLUMNS = {
    "doc_id": "long", "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long",
    "media_sha256": "string", "feature": "string", "n_frames": "long", "segments": "array<struct<start_s:double,end_s:double>>", "clips": "binary", "clips_sha256": "string", "media": "binary",
}


def padded(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of 576."""
    return data + bytes([PAD]) * ((-len(data)) % UNIT or (UNIT if not data else 0))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload + b"\0" * (n % 2)


def from_wav(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate of a mono 8-bit PCM file; its chunks may come in any order."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif name == b"data":
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("the file has no samples")


@lru_cache(1)
def _filter() -> np.ndarray:
    """The low-pass filter's phases: UP x TAPS, a Hann-windowed sinc at the lower of both band limits, each phase of sum 1."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hanning(n + 2)[1:-1]
    phases = h.reshape(TAPS, UP).T
    return (phases / phases.sum(axis=1, keepdims=True))[:, ::-1].astype(np.float32).copy()


@lru_cache(1)
def _mel() -> np.ndarray:
    """Triangular filters: (FRAME / 2 + 1) x BANDS, evenly spaced in mel up to half the new rate."""
    top = RATE * UP / DOWN / 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(top), BANDS + 2) / 2595) - 1)
    f = np.linspace(0, top, FRAME // 2 + 1)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def resampled(samples: np.ndarray) -> np.ndarray:
    """UP / DOWN times as many samples; each phase of the output is one strided product."""
    n = -(-len(samples) * UP // DOWN)
    x = np.concatenate([np.zeros(TAPS - 1, np.float32), samples, np.zeros(DOWN, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(x, TAPS)
    out = np.empty(n, np.float32)
    for r in range(min(UP, n)):
        start, phase = divmod(r * DOWN, UP)
        out[r::UP] = windows[start::DOWN][: len(out[r::UP])] @ _filter()[phase]
    return out


def log_mel(signal: np.ndarray) -> np.ndarray:
    """Frames x BANDS; the signal is padded by zeros to whole frames, one at least."""
    frames = max(1, 1 + -(-(len(signal) - FRAME) // HOP))
    x = np.zeros((frames - 1) * HOP + FRAME, np.float32)
    x[: len(signal)] = signal
    cut = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(cut, axis=1)).astype(np.float32) ** 2
    return np.log(power @ _mel() + np.float32(1e-6))


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Frames [from, to) of each segment. Thresholds are OPEN_DB over and CLOSE_DB under the median energy."""
    energy = 10 * np.log10(np.exp(mel).sum(axis=1) + 1e-9)
    middle = float(np.median(energy))
    event = np.where(energy >= middle + OPEN_DB, 1, np.where(energy < middle - CLOSE_DB, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = (last >= 0) & (event[last] == 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2)]


def clips(mel: np.ndarray) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """The bands as CLIP x BANDS tensors, the last one padded by zeros, and the seconds that each spans."""
    n = -(-len(mel) // CLIP)
    out = np.zeros((n, CLIP, BANDS), np.float32)
    out.reshape(-1, BANDS)[: len(mel)] = mel
    step = HOP * DOWN / UP / RATE
    return out, [(k * CLIP * step, min(len(mel), (k + 1) * CLIP) * step) for k in range(n)]


def clips_to_arrow(tensors: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """An Arrow stream: clip (fixed-shape tensor), start_s, end_s."""
    import pyarrow as pa

    kind = pa.fixed_shape_tensor(pa.float32(), [CLIP, BANDS])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1)), CLIP * BANDS)
    table = pa.table({"clip": pa.ExtensionArray.from_storage(kind, flat), "start_s": pa.array([a for a, _ in spans], pa.float64()), "end_s": pa.array([b for _, b in spans], pa.float64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def clips_from_arrow(data: bytes):
    """The table that ``clips_to_arrow`` made."""
    import pyarrow as pa

    return pa.ipc.open_stream(data).read_all()


def described(data: bytes, columns: tuple[str, ...]) -> dict:
    payload = padded(data)
    media = to_wav(payload)
    back, _ = from_wav(media)
    out = {
        "n_bytes": len(data), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-32:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "media": media,
    }
    if {"feature", "n_frames", "segments", "clips", "clips_sha256"} & set(columns):
        mel = log_mel(resampled((np.frombuffer(back, np.uint8).astype(np.float32) - 128) / 128))
        spans = segments(mel)
        step = HOP * DOWN / UP / RATE
        quarter = mel.mean(axis=0, dtype=np.float64).reshape(4, -1).mean(axis=1)
        voiced = sum(b - a for a, b in spans)
        out |= {"n_frames": len(mel), "segments": [{"start_s": a * step, "end_s": b * step} for a, b in spans]}
        out["feature"] = f"frames={len(mel)};segments={len(spans)};voiced={voiced};mel={','.join(f'{x:.2f}' for x in quarter)}"
        if {"clips", "clips_sha256"} & set(columns):
            out["clips"] = clips_to_arrow(*clips(mel))
            out["clips_sha256"] = hashlib.sha256(out["clips"]).hexdigest()
    return {c: out[c] for c in columns}


def media_table(docs: DataFrame, columns: tuple[str, ...] = tuple(COLUMNS), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``, with the columns asked for (any of COLUMNS).

    ``media`` is the stored file, ``clips`` an Arrow stream of fixed-shape tensors with time spans (see
    ``clips_from_arrow``). Null text is empty text: its payload is 576 bytes of 255. A null id stays null. Repeated
    rows get equal values. Texts are described one at a time, whole, so a worker holds some 30 bytes for each byte of the
    longest. Other columns are ignored. An empty table gives none.
    """
    import pyarrow as pa

    ship(docs.sparkSession)

    of_text = tuple(c for c in columns if c != "doc_id")
    schema = ", ".join(f"{c} {COLUMNS[c]}" for c in columns)
    kinds = arrow_schema(schema)

    def described_batches(batches):
        for batch in batches:
            for lo, hi, data, at in slices(batch, 1, 1 << 20):
                raw = data.tobytes()
                rows = [described(raw[at[k] : at[k + 1]], of_text) for k in range(hi - lo)]
                made = {c: [r[c] for r in rows] for c in of_text} | {"doc_id": batch.column(0).slice(lo, hi - lo)}
                yield pa.record_batch([pa.array(made[f.name], f.type) if f.name != "doc_id" else made["doc_id"].cast(f.type) for f in kinds], schema=kinds)

    rows = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as text")
    return rows.mapInArrow(described_batches, schema)


def op8_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns and the segments' spans; the tensors by the digest of their Arrow stream."""
    shown = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "segments", "clips_sha256")
    return media_table(documents(spark, sf_dir), shown)
