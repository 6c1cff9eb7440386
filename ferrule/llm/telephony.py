"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV files, expanded, resampled and stored as PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import table

#: WAVE format tags.
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
#: IMA ADPCM step sizes and index steps.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: Payload bytes are padded to a multiple of this.
FRAME = 576
RATE, RATE_OUT = 8000, 16000
#: Bytes of an ADPCM block: 4 of header, then two samples a byte. FRAME is a multiple of it.
IMA_BLOCK = 36
#: Payload bytes that are worked on at a time; a longer one is worked on alone.
GROUP = 1 << 20
TAPS = 16


@cache
def mulaw_table() -> np.ndarray:
    """G.711 mu-law: 256 codes -> 16-bit samples."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


@cache
def alaw_table() -> np.ndarray:
    """G.711 A-law: 256 codes -> 16-bit samples."""
    code = np.arange(256) ^ 0x55
    chord, step = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(chord == 0, step + 8, (step + 0x108) << np.maximum(chord - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def ima_decode(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks (n, bytes) -> samples (n, 1 + 2 * (bytes - 4)); one step at a time over all blocks."""
    n, width = blocks.shape
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = value
    body = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * (width - 4)):
        code = (body[k >> 1] >> (4 * (k & 1))) & 15
        step = STEPS[index]
        diff = ((2 * (code & 7).astype(np.int32) + 1) * step) >> 3
        value += np.where(code & 8, -diff, diff)
        np.clip(value, -32768, 32767, out=value)
        index += INDEX_STEPS[code]
        np.clip(index, 0, 88, out=index)
        out[k + 1] = value
    return out.T


@cache
def _filter(up: int, down: int) -> np.ndarray:
    """Windowed-sinc taps in 13-bit fixed point, one row a phase, each row summing to 1."""
    cut = min(1.0, up / down)
    at = np.arange(TAPS) - (TAPS // 2 - 1) - np.arange(up)[:, None] / up
    taps = np.sinc(at * cut) * np.cos(np.pi * at / (TAPS + 2)) ** 2
    taps = np.rint(taps / taps.sum(axis=1, keepdims=True) * 8192).astype(np.int32)
    taps[:, TAPS // 2 - 1] += 8192 - taps.sum(axis=1, dtype=np.int32)
    return taps


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """16-bit samples at ``rate`` -> at ``to``; integer arithmetic, silence before and after."""
    g = int(np.gcd(rate, to))
    up, down = to // g, rate // g
    if up == down:
        return samples.astype(np.int16)
    taps, n = _filter(up, down), -(-len(samples) * up // down)
    x = np.concatenate([np.zeros(TAPS // 2 - 1, np.int32), samples, np.zeros(TAPS + down, np.int32)])
    out = np.empty(n, np.int16)
    for p in range(min(up, n)):
        base, phase = divmod(p * down, up)
        m = -(-(n - p) // up)
        total = np.full(m, 4096, np.int32)
        for t in np.flatnonzero(taps[phase]):
            total += taps[phase, t] * x[base + t : base + t + down * m : down][:m]
        out[p::up] = np.clip(total >> 13, -32768, 32767)
    return out


def wav(data: bytes, tag: int, rate: int = RATE) -> bytes:
    """A mono WAV file; 8-bit samples for the G.711 tags, 16-bit for PCM, blocks of IMA_BLOCK bytes for ADPCM."""
    align, bits = {PCM: (2, 16), IMA: (IMA_BLOCK, 4)}.get(tag, (1, 8))
    per = 1 + 2 * (IMA_BLOCK - 4)
    extra = struct.pack("<HH", 2, per) if tag == IMA else b"" if tag == PCM else struct.pack("<H", 0)
    a_second = rate * align // per if tag == IMA else rate * align
    head = struct.pack("<HHIIHH", tag, 1, rate, a_second, align, bits) + extra
    samples = {PCM: len(data) // 2, IMA: len(data) // IMA_BLOCK * per}.get(tag, len(data))
    fact = b"" if tag == PCM else struct.pack("<4sII", b"fact", 4, samples)
    body = struct.pack("<4sI", b"fmt ", len(head)) + head + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) & 1)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(body), b"WAVE") + body


def unwav(media: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, block bytes, data) of a WAV file; an error where it is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data" and fmt:
            return fmt[0], fmt[2], fmt[4], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a WAV file without samples")


def expand(tag: int, block: int, data: bytes) -> np.ndarray:
    """Stored bytes -> 16-bit samples; an incomplete last ADPCM block counts as silence-padded."""
    codes = np.frombuffer(data, np.uint8)
    if tag == MULAW:
        return mulaw_table()[codes]
    if tag == ALAW:
        return alaw_table()[codes]
    if tag == PCM:
        return np.frombuffer(data, "<i2")
    if tag == IMA:
        if len(codes) % block:
            codes = np.concatenate([codes, np.zeros(-len(codes) % block, np.uint8)])
        return ima_decode(codes.reshape(-1, block)).ravel()
    raise ValueError(f"format tag {tag}")


def store(docs: DataFrame, id_col: str = "doc_id", data_col: str = "text", tag: int = MULAW) -> DataFrame:
    """``docs`` -> (id, n_bytes, media): each text's UTF-8, or binary value, as the 8-bit samples of a WAV file.

    Null counts as empty. Bytes 255 are appended up to a positive multiple of FRAME. One row per row, repeated rows
    included; other columns are not read; an empty table gives an empty result.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [x.as_py() or b"" for x in b.column(1)]
            media = [wav(x + b"\xff" * (max(FRAME, -(-len(x) // FRAME) * FRAME) - len(x)), tag) for x in data]
            yield pa.record_batch([b.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(data_col).cast("binary").alias("data")).mapInArrow(work, schema)


def decode(rows: DataFrame, id_col: str = "id", media_col: str = "media", rate: int = RATE_OUT) -> DataFrame:
    """(id, media) -> (id, format, rate, pcm): each WAV file as 16-bit PCM at ``rate``, itself a WAV file.

    A null file has null columns; a broken file has format -1 and no pcm.
    """
    schema = T.StructType([T.StructField("id", rows.schema[id_col].dataType), T.StructField("format", T.IntegerType()), T.StructField("rate", T.IntegerType()), T.StructField("pcm", T.BinaryType())])

    def one(media: bytes | None) -> tuple:
        if media is None:
            return None, None, None
        try:
            tag, own, block, data = unwav(media)
            return tag, rate, wav(resample(expand(tag, block, data), own, rate).astype("<i2").tobytes(), PCM, rate)
        except ValueError:
            return -1, None, None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [one(x.as_py()) for x in part.column(1)]
                yield pa.record_batch([part.column(0), *[pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))]], names=["id", "format", "rate", "pcm"])

    return rows.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(work, schema)


def _features(payloads: list[bytes]) -> list[str]:
    """Of payloads of whole frames: for each reading of the bytes its energy and sign changes, and the PCM's checksum."""
    codes = np.frombuffer(b"".join(payloads), np.uint8)
    sizes = np.array([len(p) for p in payloads])
    starts = np.cumsum(sizes) - sizes
    shown = []
    ima = ima_decode(codes.reshape(-1, IMA_BLOCK)).ravel()
    per = 1 + 2 * (IMA_BLOCK - 4)
    for name, x, first in (("mu", mulaw_table()[codes], starts), ("a", alaw_table()[codes], starts), ("ima", ima, starts // IMA_BLOCK * per)):
        wide = x.astype(np.int64)
        energy = np.add.reduceat(wide * wide, first)
        turns = np.append((x[1:] < 0) != (x[:-1] < 0), False).astype(np.int64)
        turns[first[1:] - 1] = 0
        shown.append([f"{name}:{e},{t}" for e, t in zip(energy.tolist(), np.add.reduceat(turns, first).tolist())])
    # silence between the payloads, so that none reaches into another through the filter
    gap = TAPS
    room = np.zeros(len(codes) + gap * len(sizes), np.int16)
    room[np.arange(len(codes)) + np.repeat(gap * np.arange(len(sizes)), sizes)] = mulaw_table()[codes]
    pcm = resample(room, RATE, RATE_OUT).astype("<i2")
    at = 2 * (starts + gap * np.arange(len(sizes)))
    return [f"{m} {a} {i} pcm:{zlib.crc32(pcm[s : s + 2 * n]):08x}" for m, a, i, s, n in zip(*shown, at.tolist(), sizes.tolist())]


def digests(rows: DataFrame) -> DataFrame:
    """(id, n_bytes, media) of ``store`` -> hashes of the stored form and of the payload read back, and features."""
    names = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    kinds = {pa.int64(): T.LongType(), pa.string(): T.StringType()}
    schema = T.StructType([rows.schema["id"], rows.schema["n_bytes"], *[T.StructField(k, kinds[v]) for k, v in names.items()]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            while at < b.num_rows:
                media, held = [], 0
                while at + len(media) < b.num_rows and held < GROUP:
                    media.append(b.column(2)[at + len(media)].as_py())
                    held += len(media[-1])
                payloads = [unwav(m)[3] for m in media]
                found = [[len(p) for p in payloads], [hashlib.sha256(p).hexdigest() for p in payloads], [zlib.crc32(p[-32:]) for p in payloads], [len(m) for m in media], [hashlib.sha256(m).hexdigest() for m in media], _features(payloads)]
                part = b.slice(at, len(media))
                yield pa.record_batch([part.column(0), part.column(1), *[pa.array(x, k) for x, k in zip(found, names.values())]], names=["id", "n_bytes", *names])
                at += len(media)

    return rows.select("id", "n_bytes", "media").mapInArrow(work, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    return digests(store(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
