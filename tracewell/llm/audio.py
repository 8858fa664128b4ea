"""Telephony audio as a media column: mu-law, A-law and IMA ADPCM in RIFF files, decoded to resampled 16-bit PCM.

A payload of bytes is stored losslessly as the 8-bit samples of a mu-law file (or A-law, or as ADPCM blocks of 64
bytes); reading expands the companded codes by tables of 256 and steps through ADPCM blocks side by side, one numpy
step for the n-th sample of all blocks. Samples at 8 kHz are resampled to 16 kHz.
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

from .shared import PIECE_BYTES, arrow_map

BLOCK, RATE = 64, 8000
CODECS = {"mulaw": 7, "alaw": 6, "adpcm": 17}


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, step = (code >> 4) & 7, (code & 15) << 4
    size = np.where(part == 0, step + 8, (step + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()
# Fixed values of the IMA ADPCM format: step sizes, and how an index moves with a code's size.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
_code = np.arange(16)
#: What a code adds at each index, and the index after it.
ADDS = np.where(_code & 8, -1, 1) * ((STEPS[:, None] >> 3) + (STEPS[:, None] >> 2) * (_code & 1) + (STEPS[:, None] >> 1) * (_code >> 1 & 1) + STEPS[:, None] * (_code >> 2 & 1))
NEXT = np.clip(np.arange(len(STEPS))[:, None] + MOVES[_code & 7], 0, len(STEPS) - 1)


def decode_adpcm(payload: np.ndarray) -> np.ndarray:
    """Samples of whole blocks of BLOCK bytes: a first sample, an index (cut to its range), and a code in each half byte."""
    blocks = payload.reshape(-1, BLOCK)
    value = blocks[:, :2].copy().view("<i2").reshape(-1).astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    codes = np.empty((2 * (BLOCK - 4), len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    adds, follow = ADDS.reshape(-1).astype(np.int32), NEXT.reshape(-1).astype(np.int32)
    for i, code in enumerate(codes, 1):
        at = index * 16 + code
        value = np.clip(value + adds[at], -32768, 32767)
        index = follow[at]
        out[i] = value
    return out.T.reshape(-1)


def samples(codec: str, payload: np.ndarray) -> np.ndarray:
    """16-bit samples of a payload."""
    return {"mulaw": lambda: MULAW[payload], "alaw": lambda: ALAW[payload], "adpcm": lambda: decode_adpcm(payload)}[codec]()


def resampled(pcm: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample and its rounded mean with the next one; the last of each sound (they end at `ends`) is held."""
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    after = np.empty(len(pcm), np.int32)
    after[:-1] = pcm[1:]
    after[ends - 1] = pcm[ends - 1]
    out[1::2] = (after + pcm + 1) >> 1
    return out


def header(codec: str, n: int) -> bytes:
    """RIFF, format and data chunk heads of a mono file at 8 kHz; the sizes of RIFF are 32 bits, so a payload stays below 4 GB."""
    if codec == "adpcm":
        per = 2 * (BLOCK - 4) + 1
        fmt = struct.pack("<HHIIHHHH", CODECS[codec], 1, RATE, RATE * BLOCK // per, BLOCK, 4, 2, per)
    else:
        fmt = struct.pack("<HHIIHHH", CODECS[codec], 1, RATE, RATE, 1, 8, 0)
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(fmt) + 8 + n) + b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", n)


def store(codec: str, payload: bytes) -> bytes:
    return header(codec, len(payload)) + payload


def read(media: bytes) -> tuple[str, bytes]:
    """Codec and payload of a stored file, by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF wave file")
    at, codec = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            tag = int.from_bytes(media[at + 8 : at + 10], "little")
            codec = next((k for k, v in CODECS.items() if v == tag), None)
        if name == b"data" and codec:
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no format or data chunk")


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK or (BLOCK if not text else 0))


def features(codec: str, payload: np.ndarray, offsets: np.ndarray) -> tuple[list[str], list[np.ndarray]]:
    """A short description and the resampled PCM of each sound; sounds lie end to end, each of whole blocks."""
    pcm = samples(codec, payload)
    at = offsets * len(pcm) // max(1, len(payload))
    wide = pcm.astype(np.int64)
    out = resampled(pcm, at[1:])
    turns = np.zeros(len(pcm), np.int64)
    turns[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
    turns[at[:-1]] = 0
    peak, energy, crossings = np.maximum.reduceat(np.abs(wide), at[:-1]), np.add.reduceat(wide * wide, at[:-1]), np.add.reduceat(turns, at[:-1])
    pcms = [out[2 * a : 2 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    said = [f"{codec};samples={len(p) // 2};peak={k};energy={e};crossings={c};pcm={len(p)}:{zlib.crc32(p):08x}" for p, k, e, c in zip(pcms, peak.tolist(), energy.tolist(), crossings.tolist(), strict=True)]
    return said, pcms


def telephony(docs: DataFrame, codec: str = "mulaw", keep_media: bool = True) -> DataFrame:
    """doc_id, the digest columns, and with keep_media the stored file and its resampled PCM, for each row of `docs` (doc_id, text).

    A null text counts as empty and an empty one as 64 bytes of 0; no text is cut. Equal texts give equal values, so
    repeated rows give equal rows; a null doc_id stays null, an empty table gives an empty result, and other columns are
    left out.
    Sounds are decoded together, about PIECE_BYTES at a time; a longer text goes alone.
    """
    others = [] if keep_media else [x for x in CODECS if x != codec]

    def described(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        media = [store(codec, padded(t)) for t in texts]
        payloads = [read(m)[1] for m in media]
        offsets = np.append(0, np.cumsum([len(p) for p in payloads]))
        joined = np.frombuffer(b"".join(payloads), np.uint8)
        said, pcms = features(codec, joined, offsets)
        for x in others:
            said = [f"{a};{b}" for a, b in zip(said, features(x, joined, offsets)[0], strict=True)]
        rows = [(len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), f) for t, p, m, f in zip(texts, payloads, media, said, strict=True)]
        return _rows(ids, [(*r, m, p.tobytes()) for r, m, p in zip(rows, media, pcms, strict=True)] if keep_media else rows)

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
        first, held, size = 0, [], 0
        for i in range(len(texts)):
            held.append(texts[i].as_py() or b"")
            size += len(held[-1]) + BLOCK
            if size > PIECE_BYTES or i == len(texts) - 1:
                yield described(ids.slice(first, len(held)), held)
                first, held, size = i + 1, [], 0

    schema = SCHEMA + (", media binary, pcm binary" if keep_media else "")
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("text")), fn, schema)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
_NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "pcm"]


def _rows(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    n = len(rows[0]) if rows else 7
    columns = [pa.array([r[c] for r in rows], _TYPES[c]) for c in range(n)]
    return pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *_NAMES[:n]])


def op4_telephony_audio(spark, sf_dir: str) -> DataFrame:
    """Stored as mu-law; the feature has what all three decoders make of the stored bytes."""
    from .shared import table

    return telephony(table(spark, sf_dir, "documents"), keep_media=False)
