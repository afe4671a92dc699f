"""Media columns: telephony audio.

A payload of bytes is stored as a WAV file of 8-bit G.711 samples (8 kHz,
mono), which keeps it byte for byte, in a Parquet table. Reading takes the
stored bytes from there and expands mu-law or A-law by lookup tables, or
decodes IMA ADPCM blocks, one numpy step for each sample position across all
blocks at once; the linear samples are resampled to 16 kHz and can be stored
as 16-bit PCM.

Null and empty texts are empty payloads; a payload is padded with zero bytes
to a positive multiple of 64. Short files are worked on in groups of about
SEGMENT bytes and long ones in segments of as many, so that the arrays of the
samples do not grow with a text; its file and PCM, which are single values,
do. Rows that repeat an id are rows of their own and equal texts give equal
values; a column of the input that is called like one of the result is not
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .durable import shared_folder

BLOCK, RATE = 64, 8000
#: Bytes of payload that are decoded at a time; a multiple of BLOCK.
SEGMENT = 1 << 20
#: Format tags of WAV files.
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "ima_adpcm": 17}

# Fixed values of the IMA ADPCM standard.
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
IMA_STEP = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def mulaw_table() -> np.ndarray:
    """16-bit sample of each mu-law code."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    magnitude = (((u & 0x0F) << 3) + 0x84 << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit sample of each A-law code."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    segment, low = (a >> 4) & 7, (a & 0x0F) << 4
    magnitude = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(a & 0x80, magnitude, -magnitude).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples (n, 1 + 2 (width - 4)) of n mono blocks (n, width): a predictor, a step index, then nibbles, low first."""
    head = blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int32) << 8)
    value = np.where(head >= 1 << 15, head - (1 << 16), head)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(IMA_STEP) - 1)
    out = np.empty((len(blocks), 1 + 2 * (blocks.shape[1] - 4)), np.int16)
    out[:, 0] = value
    for i in range(out.shape[1] - 1):
        code = (blocks[:, 4 + i // 2] >> (4 * (i % 2))).astype(np.int32) & 15
        step = IMA_STEP[index]
        move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
        index = np.clip(index + IMA_INDEX[code & 7], 0, len(IMA_STEP) - 1)
        out[:, 1 + i] = value
    return out


def double_rate(samples: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Twice the samples by linear interpolation; each signal (from `starts`) ends by repeating its last sample."""
    after = np.empty_like(samples)
    after[:-1] = samples[1:]
    after[-1] = samples[-1]
    ends = np.append(starts[1:], len(samples)) - 1
    after[ends] = samples[ends]
    out = np.empty(2 * len(samples), np.int16)
    out[0::2] = samples
    out[1::2] = (samples.astype(np.int32) + after) >> 1
    return out


def wav(data: bytes, codec: str = "mulaw", rate: int = RATE, bits: int = 8, block: int = 1) -> bytes:
    """A mono WAV file around ready coded data."""
    fmt = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate * block, block, bits, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(data)) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body + b"\0" * (len(data) & 1)


def unwav(file: bytes) -> tuple[str, int, memoryview]:
    """(codec, rate, coded data) of a mono WAV file; the data is a view, not a copy."""
    view = memoryview(file).cast("B")
    if view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate = 12, None, 0
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", view, at + 8)
        elif name == b"data":
            return {v: k for k, v in TAGS.items()}[tag], rate, view[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data in the WAV file")


def decode(file: bytes, block: int = BLOCK) -> np.ndarray:
    """Linear 16-bit samples of a mono WAV file in any codec of TAGS."""
    codec, _, data = unwav(file)
    raw = np.frombuffer(data, np.uint8)
    if codec == "pcm":
        return raw.view("<i2")
    if codec == "ima_adpcm":
        return decode_ima(raw.reshape(-1, block)).reshape(-1)
    return TABLES[codec][raw]


def payload(text: bytes) -> bytes:
    """The bytes padded with zeros to a positive multiple of BLOCK."""
    return text + b"\0" * (-len(text) % BLOCK or (0 if text else BLOCK))


def _summary(samples: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(energy, peak, sign changes) of each signal."""
    wide = samples.astype(np.int64)
    turn = np.zeros(len(samples), np.int64)
    turn[1:] = (samples[1:] < 0) != (samples[:-1] < 0)
    turn[starts] = 0
    return list(zip(np.add.reduceat(wide * wide, starts).tolist(), np.maximum.reduceat(np.abs(wide), starts).tolist(), np.add.reduceat(turn, starts).tolist(), strict=True))


def _signals(coded: np.ndarray) -> dict[str, np.ndarray]:
    return {"mulaw": TABLES["mulaw"][coded], "alaw": TABLES["alaw"][coded], "ima": decode_ima(coded.reshape(-1, BLOCK)).reshape(-1)}


def _named(rows: dict[str, tuple[int, int, int]], pcm_crc: int) -> str:
    return ";".join(f"{name}:energy={e},peak={p},turns={t}" for name, (e, p, t) in rows.items()) + f";pcm16k:crc32={pcm_crc}"


def features(payloads: list[memoryview], keep_pcm: bool = False) -> list[tuple[str, bytes | None]]:
    """(feature, 16 kHz PCM or None) of each payload; together they are short, or there is one."""
    if len(payloads) == 1 and len(payloads[0]) > SEGMENT:
        return [_long_features(payloads[0], keep_pcm)]
    sizes = np.array([len(b) for b in payloads])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    coded = np.frombuffer(b"".join(payloads), np.uint8)
    signals = _signals(coded)
    wide = double_rate(signals["mulaw"], starts)
    per = len(signals["ima"]) // (len(coded) // BLOCK)
    at = {"mulaw": starts, "alaw": starts, "ima": starts // BLOCK * per}
    found = {name: _summary(signals[name], at[name]) for name in signals}
    out = []
    for k, (a, n) in enumerate(zip(starts, sizes, strict=True)):
        pcm = wide[2 * a : 2 * (a + n)].tobytes()
        out.append((_named({name: rows[k] for name, rows in found.items()}, zlib.crc32(pcm)), pcm if keep_pcm else None))
    return out


def _long_features(payload_: memoryview, keep_pcm: bool) -> tuple[str, bytes | None]:
    """The same for one long payload, segment by segment; what stands between two segments is counted too."""
    whole = np.frombuffer(payload_, np.uint8)
    rows, last, crc, kept = dict.fromkeys(("mulaw", "alaw", "ima"), (0, 0, 0)), {}, 0, []
    for lo in range(0, len(whole), SEGMENT):
        coded = whole[lo : lo + SEGMENT]
        for name, samples in _signals(coded).items():
            (energy, peak, turns) = _summary(samples, np.zeros(1, np.int64))[0]
            e, p, t = rows[name]
            between = int(bool((samples[0] < 0) != (last[name] < 0))) if name in last else 0
            rows[name], last[name] = (e + energy, max(p, peak), t + turns + between), samples[-1]
        linear = TABLES["mulaw"][whole[lo : lo + SEGMENT + 1]]  # with the next segment's first sample
        pcm = double_rate(linear, np.zeros(1, np.int64))[: 2 * len(coded)].tobytes()
        crc = zlib.crc32(pcm, crc)
        if keep_pcm:
            kept.append(pcm)
    return _named(rows, crc), b"".join(kept) if keep_pcm else None


def stored(documents: DataFrame, codec: str = "mulaw", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (the WAV file) of every row."""

    def work(batches):
        for batch in batches:
            data, offsets = textvec.utf8(batch.column(1))
            for lo, hi in textvec.groups(offsets, SEGMENT):
                files = [wav(payload(data[a:b].tobytes()), codec) for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets[lo : hi + 1]), pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(work, "doc_id long, n_bytes long, media binary")


FIELDS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, pcm_16k binary"


def read_back(table: DataFrame, keep_media: bool = True, keep_pcm: bool = True) -> DataFrame:
    """doc_id, n_bytes and FIELDS of every row of a table of stored media.

    `feature` names energy, peak and sign changes of the stored bytes expanded as mu-law, as A-law and as ADPCM
    blocks, and the checksum of the resampled PCM. `keep_media` and `keep_pcm` leave the large columns null.
    """

    def work(batches):
        for batch in batches:
            data = batch.column(2).cast(pa.large_binary())
            ends = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, data.offset * 8)
            for lo, hi in textvec.groups(ends, SEGMENT):
                files = [memoryview(data[i].as_buffer()) for i in range(lo, hi)]
                back = [unwav(f)[2] for f in files]
                found = features(back, keep_pcm)
                columns = [
                    pa.array([len(b) for b in back], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back]),
                    pa.array([zlib.crc32(b[-BLOCK:]) for b in back], pa.int64()),
                    pa.array([len(f) for f in files], pa.int64()),
                    pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                    pa.array([f for f, _ in found]),
                    batch.column(2).slice(lo, hi - lo) if keep_media else pa.nulls(hi - lo, pa.binary()),
                    pa.array([x for _, x in found], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *columns], names=["doc_id", "n_bytes", *[f.split()[0] for f in FIELDS.split(", ")]])

    return table.select("doc_id", "n_bytes", "media").mapInArrow(work, f"doc_id long, n_bytes long, {FIELDS}")


def media(documents: DataFrame, folder: str | None = None, keep_media: bool = True, keep_pcm: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as a media file in a Parquet table in `folder` (default: a new one in the shared checkpoint folder) and returns `read_back` of that table."""
    from uuid import uuid4

    spark = documents.sparkSession
    folder = folder or f"{shared_folder(spark)}/media-{uuid4()}"
    stored(documents, id_col=id_col, text_col=text_col).write.option("compression", "zstd").parquet(folder)
    return read_back(spark.read.parquet(folder), keep_media, keep_pcm)
