"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers.

G.711 samples are expanded by 256-entry lookup tables made from the law's rule.
IMA ADPCM blocks are decoded with numpy across the blocks of all files of a batch: they
advance one nibble at a time together, so the Python loop is as long as one block, not
as the files.  Decoded 16-bit samples are resampled (through a low-pass filter where the
rate falls, by linear interpolation elsewhere) and stored as PCM.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tipoff.llm.common import Workspace, map_batches, text_or_empty

PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17

#: Fixed values of the IMA ADPCM format.
IMA_STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
IMA_INDEX = (-1, -1, -1, -1, 2, 4, 6, 8)


def mu_law_table() -> np.ndarray:
    """G.711 mu-law: 14-bit magnitudes, scaled to 16 bits."""
    u = ~np.arange(256) & 0xFF
    magnitude = ((((u & 0x0F) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -magnitude, magnitude).astype(np.int16)


def a_law_table() -> np.ndarray:
    """G.711 A-law: 13-bit magnitudes, scaled to 16 bits."""
    a = np.arange(256) ^ 0x55
    exponent, mantissa = (a >> 4) & 7, (a & 0x0F) << 4
    magnitude = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, magnitude, -magnitude).astype(np.int16)


MU_TABLE, A_TABLE = mu_law_table(), a_law_table()


def decode_ima(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM: blocks of ``block`` bytes with a 4-byte header each.

    A short last block is decoded as far as it goes.
    """
    whole, rest = divmod(len(data), block)
    out = [_ima_blocks(np.frombuffer(data, np.uint8, whole * block).reshape(whole, block))] if whole else []
    if rest > 4:
        out.append(_ima_blocks(np.frombuffer(data, np.uint8, rest, whole * block).reshape(1, rest)))
    return np.concatenate([x.reshape(-1) for x in out]) if out else np.zeros(0, np.int16)


def _ima_blocks(blocks: np.ndarray) -> np.ndarray:
    steps, moves = np.array(IMA_STEPS), np.array(IMA_INDEX)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(blocks[:, 2].astype(np.int64), 88)
    nibbles = np.empty((len(blocks), 2 * (blocks.shape[1] - 4)), np.int64)
    nibbles[:, 0::2], nibbles[:, 1::2] = blocks[:, 4:] & 15, blocks[:, 4:] >> 4
    out = np.empty((len(blocks), nibbles.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(nibbles.shape[1]):  # all blocks together
        code, step = nibbles[:, k], steps[index]
        change = (step >> 3) + ((code >> 2) & 1) * step + ((code >> 1) & 1) * (step >> 1) + (code & 1) * (step >> 2)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + moves[code & 7], 0, 88)
        out[:, k + 1] = value
    return out


def encode_ima(samples: np.ndarray, block: int) -> bytes:
    """Encode 16-bit samples, for tests and fixtures (one block at a time)."""
    out, per = bytearray(), 2 * (block - 4) + 1
    index = 0
    for s in range(0, len(samples), per):
        part = samples[s : s + per].astype(int).tolist()
        value = part[0]
        out += struct.pack("<hBB", value, index, 0)
        codes = []
        for x in part[1:]:
            step, gap = IMA_STEPS[index], x - value
            code = (8 if gap < 0 else 0) | min(7, abs(gap) * 4 // step)
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + IMA_INDEX[code & 7]))
            codes.append(code)
        codes += [0] * (len(codes) % 2)
        out += bytes(a | b << 4 for a, b in zip(codes[::2], codes[1::2], strict=True))
    return bytes(out)


def wav(kind: int, rate: int, data: bytes, bits: int = 8, block: int | None = None) -> bytes:
    """A mono WAV file; other formats than PCM carry a fact chunk."""
    align = block or bits // 8
    extra = struct.pack("<HH", 2, 2 * (align - 4) + 1) if kind == IMA_ADPCM else (b"" if kind == PCM else struct.pack("<H", 0))
    per_second = rate * align // (2 * (align - 4) + 1) if kind == IMA_ADPCM else rate * align
    fmt = struct.pack("<HHIIHH", kind, 1, rate, per_second, align, bits) + extra
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if kind != PCM:
        body += b"fact" + struct.pack("<II", 4, len(data) if kind != IMA_ADPCM else len(data) // align * (2 * (align - 4) + 1))
    body += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(format, rate, block align, data) of a WAV file; ValueError if it is none."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate, _, align = struct.unpack_from("<HHIIH", media, at + 8)
            fmt = (kind, rate, align)
        elif name == b"data" and fmt:
            return *fmt, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def samples(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, 16-bit samples) of a WAV file of one of the four formats."""
    kind, rate, align, data = read_wav(media)
    if kind == MU_LAW:
        return rate, MU_TABLE[np.frombuffer(data, np.uint8)]
    if kind == A_LAW:
        return rate, A_TABLE[np.frombuffer(data, np.uint8)]
    if kind == IMA_ADPCM:
        return rate, decode_ima(data, align)
    if kind == PCM and align == 2:
        return rate, np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    raise ValueError(f"format {kind} with blocks of {align}")


def samples_of(media: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """``samples`` of several files; whole ADPCM blocks of one size are decoded at once."""
    out: list[tuple[int, np.ndarray] | None] = []
    blocks: dict[int, list[tuple[int, int, bytes]]] = {}
    for i, m in enumerate(media):
        kind, rate, align, data = read_wav(m)
        if kind == IMA_ADPCM and align > 4 and data and len(data) % align == 0:
            blocks.setdefault(align, []).append((i, rate, data))
            out.append(None)
        else:
            out.append(samples(m))
    for align, found in blocks.items():
        decoded = _ima_blocks(np.frombuffer(b"".join([d for _, _, d in found]), np.uint8).reshape(-1, align))
        at = 0
        for i, rate, data in found:
            n = len(data) // align
            out[i] = (rate, decoded[at : at + n].reshape(-1))
            at += n
    return out


#: Zero crossings of the low-pass filter on each side, and the sum of its integer taps.
LOBES, TAP_SUM = 8, 1 << 14


@functools.cache
def low_pass_taps(rate: int, to: int) -> np.ndarray:
    """A sinc that ends at half of the lower rate, under a Hann window, in integers."""
    half = -(-LOBES * rate // to)
    t = np.arange(-half, half + 1)
    shape = np.sinc(t * to / rate) * (1 + np.cos(np.pi * t / (half + 1)))
    taps = np.rint(shape / shape.sum() * TAP_SUM).astype(np.int32)
    taps[half] += TAP_SUM - taps.sum()  # a constant stays what it is
    return taps


def low_pass(x: np.ndarray, rate: int, to: int, step: int) -> np.ndarray:
    """Every ``step``-th sample of x without what the lower rate can't carry; beyond its
    ends x goes on as it ends.  Sums stay within 32 bits."""
    taps = low_pass_taps(rate, to)
    wide = np.pad(x, len(taps) // 2, "edge").astype(np.int32)
    last = (len(x) - 1) // step * step
    total = np.full(last // step + 1, TAP_SUM // 2, np.int32)
    for t in np.flatnonzero(taps):
        total += taps[t] * wide[t : t + last + 1 : step]
    return np.clip(total // TAP_SUM, -32768, 32767).astype(np.int16)


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in integers: sample k lies at k * rate / to.  To a lower rate,
    a low-pass filter comes first, so that nothing folds back."""
    if rate == to or len(x) < 2:
        return x
    n = (len(x) - 1) * to // rate + 1
    if rate % to == 0:  # every sample is one of the source's
        return low_pass(x, rate, to, rate // to)
    if to < rate:
        x = low_pass(x, rate, to, 1)
    if to % rate == 0:  # a whole factor: every source interval has the same places
        f = to // rate
        wide = x.astype(np.int32)
        step = np.arange(f, dtype=np.int32)
        between = (wide[:-1, None] * (f - step) + wide[1:, None] * step) // f
        return np.append(between.reshape(-1), wide[-1]).astype(np.int16)[:n]
    k = np.arange(n, dtype=np.int64) * rate
    i, part = k // to, k % to
    j = np.minimum(i + 1, len(x) - 1)
    return ((x[i].astype(np.int64) * (to - part) + x[j].astype(np.int64) * part) // to).astype(np.int16)


def decode_column(df: DataFrame, media_col: str, rate: int = 16000) -> DataFrame:
    """df's rows with (media_rate, pcm, media_error): 16-bit little-endian PCM at ``rate``.

    A null or broken media value gives null PCM and says why; columns of df that
    have one of the new names are replaced, all others are carried.
    """
    new = ("media_rate", "pcm", "media_error")
    kept = df.drop(*new)
    at = kept.columns.index(media_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rates, pcm, errors = [], [], []
        for media in batch.column(at).to_pylist():
            try:
                if media is None:
                    raise ValueError("null")
                r, x = samples(media)
                rates.append(r)
                pcm.append(resample(x, r, rate).astype("<i2").tobytes())
                errors.append(None)
            except (ValueError, struct.error) as e:
                rates.append(None)
                pcm.append(None)
                errors.append(str(e))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates, pa.int32()), pa.array(pcm, pa.binary()), pa.array(errors, pa.string())], names=[*batch.schema.names, *new])

    schema = StructType([*kept.schema.fields, *StructType.fromDDL("media_rate int, pcm binary, media_error string").fields])
    return map_batches(kept, run, schema)


def describe(x: np.ndarray) -> str:
    """Length, peak, root mean square and zero crossings of samples, in integers."""
    wide = x.astype(np.int32)
    peak = int(np.abs(wide).max()) if len(x) else 0
    square = int((wide.astype(np.int64) ** 2).sum())
    crossings = int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
    return f"n={len(x)};peak={peak};rms={int((square // max(1, len(x))) ** 0.5)};zc={crossings}"


#: Bytes of one ADPCM block of the stored texts; a divisor of the unit.
TEXT_BLOCK = 36


def text_wav(payload: bytes, rate: int) -> bytes:
    """The payload as a file's samples: mu-law, A-law, or ADPCM blocks at twice the rate
    (two samples a byte).  Which one follows from the payload, so that equal texts are
    equal files."""
    pick = zlib.crc32(payload) & 7
    if pick == 0:
        return wav(IMA_ADPCM, 2 * rate, payload, 4, TEXT_BLOCK)
    return wav(A_LAW if pick < 4 else MU_LAW, rate, payload)


def store_texts(docs: DataFrame, unit: int, rate: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes, filled up with 255, as telephony audio."""
    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(text_or_empty(text_col), "utf-8").alias("raw"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column(1).to_pylist()
        media = [text_wav(r + b"\xff" * (max(1, -(-len(r) // unit)) * unit - len(r)), rate) for r in raw]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_batches(got, run, "doc_id long, n_bytes long, media binary")


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
FORMATS = {A_LAW: "alaw", MU_LAW: "ulaw", IMA_ADPCM: "ima", PCM: "pcm"}


def text_audio(docs: DataFrame, unit: int = 576, rate: int = 8000, to_rate: int = 4000, id_col: str = "doc_id", text_col: str = "text", feature: Callable[[np.ndarray], str] = describe) -> DataFrame:
    """Store texts as telephony audio, read the stored column back, return it as PCM.

    The media table is written to the shared folder and reread; payload digests are
    of the data chunk that was read.  Its samples are expanded or decoded, resampled
    to ``to_rate`` and returned as 16-bit PCM, the column ``pcm``, which is stored where
    the result is; the feature is the format and a description of the PCM.  Null texts
    are empty (one unit of filling); repeated rows and null ids are kept; further columns
    are not carried; an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "media")
    stored = work.put(store_texts(docs, unit, rate, id_col, text_col), "audio")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        every = batch.column(2).to_pylist()
        for media, (r, x) in zip(every, samples_of(every), strict=True):
            kind, _, _, payload = read_wav(media)
            pcm = resample(x, r, to_rate)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{FORMATS[kind]};{feature(pcm)}", pcm.astype("<i2").tobytes()))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=[*[f.split()[0] for f in MEDIA.split(", ")], "pcm"])

    return map_batches(stored, run, MEDIA + ", pcm binary")
