"""Telephony audio: companded and ADPCM payloads, expanded with tables and numpy, stored as 8-bit samples and resampled PCM.

The stored form is a RIFF/WAVE file of 8-bit mu-law samples (format tag 7, 8 kHz, mono).  Expansion
of mu-law and A-law is one table lookup a sample; IMA ADPCM is decoded for all blocks of a batch at
once, one step a nibble position.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

UNIT = 576
RATE = 8000
#: WAVE format tags.
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "ima_adpcm": 17}
HEADER = 46


def mulaw_table() -> np.ndarray:
    """PCM of the 256 mu-law codes, from the law's definition (bias 33, eight segments)."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    value = ((((code & 0x0F) << 1) + 33) << ((code >> 4) & 7)) - 33
    return (np.where(code & 0x80, -value, value) << 2).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of the 256 A-law codes (even bits inverted, eight segments)."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    seg, low = (code >> 4) & 7, ((code & 0x0F) << 4) + 8
    value = np.where(seg == 0, low, (low + 0x100) << np.maximum(seg - 1, 0))
    return np.where(code & 0x80, value, -value).astype(np.int16)


def step_table() -> np.ndarray:
    """The 89 IMA step sizes."""
    # Fixed values of the public IMA ADPCM format.
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
        np.int32,
    )


MULAW, ALAW, STEPS = mulaw_table(), alaw_table(), step_table()
_INDEX_MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def adpcm_decode(payload: np.ndarray, block: int = UNIT) -> np.ndarray:
    """PCM of IMA ADPCM blocks, shape (blocks, 2 * block - 7): a header (predictor, index, zero) and then nibbles, low first.

    All blocks advance together: the loop is over the positions in a block, each step a few numpy
    operations over all blocks.  An index in a header over 88 counts as 88.
    """
    b = payload.reshape(-1, block)
    pred = (b[:, 0].astype(np.int32) | (b[:, 1].astype(np.int32) << 8)).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.minimum(b[:, 2].astype(np.int32), 88)
    body = np.ascontiguousarray(b[:, 4:].T)
    out = np.empty((2 * body.shape[0] + 1, b.shape[0]), np.int16)
    out[0] = pred
    # The signed change of each (index, nibble), as the format sums the step's shifts.
    nib = np.arange(16)
    s = STEPS[:, None]
    diff = (s >> 3) + np.where(nib & 4, s, 0) + np.where(nib & 2, s >> 1, 0) + np.where(nib & 1, s >> 2, 0)
    change = np.where(nib & 8, -diff, diff).astype(np.int32).ravel()
    after = np.clip(np.arange(89)[:, None] + _INDEX_MOVE[nib][None, :], 0, 88).astype(np.int32).ravel() * 16
    index *= 16
    k = 1
    for row in body:
        for half in (row & 15, row >> 4):
            at = index + half
            pred += change[at]
            np.clip(pred, -32768, 32767, out=pred)
            index = after[at]
            out[k] = pred
            k += 1
    return out.T


def adpcm_encode(pcm: np.ndarray, block: int = UNIT) -> np.ndarray:
    """IMA ADPCM blocks of rows of 2 * block - 7 samples; the inverse that tests need, also across blocks."""
    x = pcm.astype(np.int32)
    n = x.shape[0]
    pred, index = x[:, 0].copy(), np.zeros(n, np.int32)
    out = np.zeros((n, block), np.uint8)
    out[:, 0], out[:, 1] = pred & 255, (pred >> 8) & 255
    for j in range(1, x.shape[1]):
        step, d = STEPS[index], x[:, j] - pred
        nib = np.where(d < 0, 8, 0)
        d = np.abs(d)
        change = step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            hit = d >= part
            nib |= np.where(hit, bit, 0)
            d = np.where(hit, d - part, d)
            change = change + np.where(hit, part, 0)
        pred = np.clip(np.where(nib & 8, pred - change, pred + change), -32768, 32767)
        index = np.clip(index + _INDEX_MOVE[nib], 0, 88)
        out[:, 4 + (j - 1) // 2] |= (nib << (4 * ((j - 1) % 2))).astype(np.uint8)
    return out


def wav(payload: bytes, tag: int = TAGS["mulaw"], rate: int = RATE) -> bytes:
    """A RIFF/WAVE file of 8-bit samples (18-byte format chunk)."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 38 + n) + b"WAVEfmt " + struct.pack("<IHHIIHHH", 18, tag, 1, rate, rate, 1, 8, 0) + b"data" + struct.pack("<I", n) + payload


def wav_payload(media: bytes) -> tuple[int, bytes]:
    """(format tag, samples) of such a file, found by walking its chunks; anything else raises ValueError."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, tag = 12, None
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if kind == b"fmt ":
            tag = struct.unpack("<H", media[at + 8 : at + 10])[0]
        elif kind == b"data":
            if tag is None or at + 8 + n > len(media):
                break
            return tag, media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no samples")


def half_band(reach: int = 16) -> np.ndarray:
    """Weights of the samples on either side of a point halfway between two: a sinc under a Kaiser window, for ``reach`` samples each way; they sum to 1/2 a side."""
    x = np.arange(reach) + 0.5
    w = np.sinc(x) * np.i0(8.0 * np.sqrt(1 - (x / reach) ** 2))
    return (w / (2 * w.sum())).astype(np.float32)


HALF_BAND = half_band()


def resample_double(pcm: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each signal of ``pcm`` (signals begin at ``bounds``, the total last) at twice the rate.

    A half-band low-pass keeps the samples and interpolates the points between them, so the images over
    the old half rate are filtered out.  A signal is silent before its first and after its last sample.
    """
    reach, size = len(HALF_BAND), np.diff(bounds)
    # Signals apart by enough silence that no tap reaches the next one.
    at = np.arange(len(pcm)) + np.repeat(reach * (1 + np.arange(len(size))), size)
    apart = np.zeros(len(pcm) + reach * (len(size) + 1), np.float32)
    apart[at] = pcm
    between = np.zeros(len(pcm), np.float32)
    for k, c in enumerate(HALF_BAND):
        between += c * (apart[at - k] + apart[at + 1 + k])
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip(np.rint(between), -32768, 32767)
    return out


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text as a telephony file in a binary column, written to the shared folder and read again.

    The UTF-8 bytes of a text, filled with 255 (mu-law silence) to a positive multiple of 576, are its
    samples.  A null text is empty and so one unit of silence.  Other columns of the input don't matter.
    Rows are independent, so copies and hot keys need no shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    @B.tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column(0)
            for a, n, data, offs in B.text_blocks(batch):
                raw = data.tobytes()
                size = np.diff(offs)
                media = [wav(raw[s:e] + b"\xff" * (-(e - s) % UNIT if e > s else UNIT)) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([i.slice(a, n), pa.array(size), pa.array(media, pa.binary())], schema=schema)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return B.stored(src.mapInArrow(encode, "doc_id long, n_bytes long, media binary"), "media", B.bucket_count(docs), **PACKED)


#: The stored files take most of the disk; zstd keeps them smaller than the default codec.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}
DECODED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm16k binary"


def _decoded(rows: list[tuple[int, bytes]]) -> dict:
    payloads = [wav_payload(m)[1] for _, m in rows]
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    bounds = np.cumsum([0, *map(len, payloads)])
    at = bounds[:-1]
    length = np.diff(bounds).astype(np.float64)
    u, a = MULAW[flat], ALAW[flat]
    adpcm = adpcm_decode(flat)
    per = bounds // UNIT
    rms = lambda x: np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, at) / length)
    cross = np.zeros(len(flat))
    cross[1:] = (u[1:] < 0) != (u[:-1] < 0)
    cross[at] = 0
    zero = np.add.reduceat(cross, at)
    peak = np.maximum.reduceat(np.abs(u.astype(np.int32)), at)
    block_rms = np.add.reduceat((adpcm.astype(np.float64) ** 2).sum(1), per[:-1]) / (np.diff(per) * adpcm.shape[1])
    rms_u, rms_a = rms(u), rms(a)
    doubled = resample_double(u, bounds)
    out = {"pcm": [], "feature": []}
    for k in range(len(rows)):
        pcm = doubled[2 * bounds[k] : 2 * bounds[k + 1]].tobytes()
        out["feature"].append(f"mulaw_rms={rms_u[k]:.3f};alaw_rms={rms_a[k]:.3f};adpcm_rms={np.sqrt(block_rms[k]):.3f};peak={peak[k]};zero_crossings={zero[k]:.0f};pcm16k_bytes={len(pcm)};pcm16k_crc32={zlib.crc32(pcm)}")
        out["pcm"].append(pcm)
    out["payload"] = payloads
    return out


def decode(stored: DataFrame) -> DataFrame:
    """Reads the stored files: digests of the samples read back, features of the three expansions, and 16 kHz PCM.

    feature: root mean squares under mu-law, A-law and ADPCM, the peak and zero crossings, and size and
    crc32 of the resampled PCM, which is the column pcm16k (16-bit little-endian).  Equal files give equal values.
    """
    names = [c.split()[0] for c in DECODED.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in DECODED.split(", ")])

    @B.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(2)
            size = np.array([len(m) for m in (x.as_buffer() for x in media)], np.int64)
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(np.cumsum(size[a:]), B.BLOCK_BYTES)) + a)
                rows = [(k, media[k].as_py()) for k in range(a, min(b, batch.num_rows))]
                x = _decoded(rows)
                n = len(rows)
                cols = {
                    "doc_id": batch.column(0).slice(a, n), "n_bytes": batch.column(1).slice(a, n),
                    "payload_bytes": [len(p) for p in x["payload"]], "payload_sha256": [hashlib.sha256(p).hexdigest() for p in x["payload"]],
                    "tail_crc32": [zlib.crc32(p[-32:]) for p in x["payload"]], "media_bytes": size[a : a + n].tolist(),
                    "media_sha256": [hashlib.sha256(m).hexdigest() for _, m in rows], "feature": x["feature"], "pcm16k": x["pcm"],
                }
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type) for k, c in ((k, cols[k]) for k in names)], schema=schema)
                a += n

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, DECODED)

