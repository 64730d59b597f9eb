"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers, decoded to resampled PCM.

mu-law and A-law bytes expand by 256-entry tables built from their rules; ADPCM blocks are independent, so
all blocks of many recordings decode together, one sample of every block at a time. PCM is resampled by a
windowed-sinc polyphase filter in segments of bounded size and stored as 16-bit WAV.

Null or empty media: rate and sample count 0, an empty recording. Bytes that aren't a WAV file of a known
format: the ``error`` field says so, the other fields are null. Repeated rows stay; columns named like the
output are replaced.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import blocks
from ._shared import written

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11
UNIT = 64  # payload bytes of an ADPCM block
SEGMENT = 1 << 18

# Fixed values of the IMA ADPCM format: the change of the step index for each code, and the step sizes.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exp, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(exp == 0, low + 8, (low + 0x108) << np.maximum(exp - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: _mulaw_table(), ALAW: _alaw_table()}


def compand(pcm: np.ndarray, law: int) -> np.ndarray:
    """The codes whose expansion is nearest to each sample."""
    table = TABLES[law].astype(np.int32)
    order = np.argsort(table, kind="stable")
    mids = (table[order][1:] + table[order][:-1]) / 2
    return order[np.searchsorted(mids, pcm)].astype(np.uint8)


def wav(data: bytes, fmt: int, rate: int = 8000, channels: int = 1) -> bytes:
    """A RIFF/WAVE file around sample data of one of the formats."""
    bits, align = {PCM: (16, 2 * channels), ADPCM: (4, UNIT + 4)}.get(fmt, (8, channels))
    extra = struct.pack("<HH", 2, 2 * UNIT + 1) if fmt == ADPCM else b""
    speed = rate * align // (2 * UNIT + 1) if fmt == ADPCM else rate * align
    head = struct.pack("<HHIIHH", fmt, channels, rate, speed, align, bits) + extra
    chunks = b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def unwav(blob: bytes) -> tuple[int, int, int, int, memoryview]:
    """Format, rate, channels, bytes of a block and sample data; ValueError if it isn't such a file."""
    view = memoryview(blob)
    if len(blob) < 12 or bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAV file")
    at, head = 12, None
    while at + 8 <= len(blob):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", blob, at + 4)[0]
        if name == b"fmt ":
            head = struct.unpack_from("<HHIIH", blob, at + 8)
        elif name == b"data":
            if head is None:
                raise ValueError("no format chunk")
            return head[0], head[2], head[1], head[4], view[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no sample data")


def adpcm_blocks(coded: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks (a row each): the header's sample, then two for each byte."""
    n, width = coded.shape
    head = np.ascontiguousarray(coded[:, :4])
    value = head[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(head[:, 2].astype(np.int32), 0, 88)
    body = np.ascontiguousarray(coded[:, 4:].T)
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = value
    at = 1
    for row in body:
        for code in (row & 15, row >> 4):
            step = STEPS[index]
            diff = step >> 3
            diff += np.where(code & 4, step, 0)
            diff += np.where(code & 2, step >> 1, 0)
            diff += np.where(code & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - diff, value + diff), -32768, 32767)
            index = np.clip(index + INDEX_STEP[code], 0, 88)
            out[at] = value
            at += 1
    return out.T


def decode(fmt: int, data, channels: int = 1, align: int = UNIT + 4) -> np.ndarray:
    """Mono 16-bit samples of one recording; several channels (not of ADPCM) are averaged."""
    raw = np.frombuffer(data, np.uint8)
    if fmt in TABLES:
        pcm = TABLES[fmt][raw]
    elif fmt == PCM:
        pcm = np.frombuffer(data, "<i2", len(raw) // 2)
    elif fmt == ADPCM and channels == 1 and align > 4:
        if len(raw) % align:
            raw = np.pad(raw, (0, align - len(raw) % align))
        return adpcm_blocks(raw.reshape(-1, align)).ravel()
    else:
        raise ValueError(f"format {fmt} with {channels} channels")
    if channels > 1:
        pcm = pcm[: len(pcm) // channels * channels].reshape(-1, channels).mean(1).round().astype(np.int16)
    return pcm


def resample(pcm: np.ndarray, rate: int, to: int, taps: int = 8) -> np.ndarray:
    """Polyphase windowed-sinc resampling; sample i of the result is at time i / to."""
    if rate == to or not len(pcm):
        return np.asarray(pcm, np.int16)
    up, down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    cut = min(1.0, to / rate)
    half = math.ceil(taps / cut)
    k = np.arange(-half, half + 1)
    filters = []
    for phase in range(up):
        t = k - phase / up
        h = cut * np.sinc(cut * t) * np.where(np.abs(t) <= half, np.cos(np.pi * t / (2 * half + 2)) ** 2, 0)
        filters.append((h / h.sum()).astype(np.float32)[::-1])
    n_out = -(-len(pcm) * up // down)
    out = np.empty(n_out, np.int16)
    for lo in range(0, n_out, SEGMENT * up):
        hi = min(n_out, lo + SEGMENT * up)
        a, b = lo * down // up, (hi - 1) * down // up + 1
        x = np.zeros(b - a + 2 * half, np.float32)
        s, e = max(0, a - half), min(len(pcm), b + half)
        x[s - a + half : e - a + half] = pcm[s:e]
        for phase in range(up):
            # outputs i with i * down % up == phase; each phase occurs once in every run of up outputs
            first = next((i for i in range(lo, min(lo + up, hi)) if i * down % up == phase), None)
            if first is None:
                continue
            at = np.arange(first, hi, up) * down // up - a
            y = np.convolve(x, filters[phase], "valid")[at]
            out[first:hi:up] = np.clip(np.rint(y), -32768, 32767)
    return out


def features(pcm: np.ndarray) -> str:
    """Whole numbers that describe samples: count, peak, energy, sign changes, checksum."""
    wide = pcm.astype(np.int64)
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"n={len(pcm)};peak={int(np.abs(wide).max(initial=0))};energy={int(wide @ wide)};turns={turns};crc={zlib.crc32(np.ascontiguousarray(pcm)):08x}"


def decode_media(df: DataFrame, media: str = "media", out: str = "audio", rate: int = 16000) -> DataFrame:
    """df with a struct column: source format and rate, samples, the resampled PCM as a WAV file, features, error."""
    kind = pa.struct([("format", pa.int32()), ("source_rate", pa.int32()), ("n_samples", pa.int64()), ("wav", pa.binary()), ("features", pa.string()), ("error", pa.string())])

    @F.arrow_udf("format int, source_rate int, n_samples bigint, wav binary, features string, error string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in parts:
            rows = []
            for item in arr:
                blob = item.as_py()
                if not blob:
                    rows.append((None, 0, 0, None, "", None))
                    continue
                try:
                    fmt, source, channels, align, data = unwav(blob)
                    pcm = resample(decode(fmt, data, channels, align), source, rate)
                    rows.append((fmt, source, len(pcm), wav(pcm.tobytes(), PCM, rate), features(pcm), None))
                except (ValueError, struct.error) as e:
                    rows.append((None, None, None, None, None, str(e)))
            yield pa.array([dict(zip((f.name for f in kind), r, strict=True)) for r in rows], kind)

    return df.withColumn(out, run(media))


def padded(text_bytes: bytes) -> bytes:
    return text_bytes + b"\0" * (max(UNIT, -(-len(text_bytes) // UNIT) * UNIT) - len(text_bytes))


def store_payload(payload: bytes, fmt: int) -> bytes:
    """The payload as a WAV file's sample data, byte for byte; for ADPCM in blocks with empty headers."""
    if fmt == ADPCM:
        coded = np.zeros((len(payload) // UNIT, UNIT + 4), np.uint8)
        coded[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        payload = coded.tobytes()
    return wav(payload, fmt)


def read_payload(blob: bytes) -> tuple[int, bytes, memoryview]:
    """Format, payload and sample data of a stored file."""
    fmt, _, _, align, data = unwav(blob)
    if fmt == ADPCM:
        return fmt, np.frombuffer(data, np.uint8).reshape(-1, align)[:, 4:].tobytes(), data
    return fmt, bytes(data), data


FORMATS = (MULAW, ALAW, ADPCM)


def _encode():
    """A UDF of texts: the bytes of each and, as media, a telephony audio file whose samples they are; the text's checksum picks one of FORMATS."""
    kind = pa.struct([("n_bytes", pa.int64()), ("media", pa.binary())])

    @F.arrow_udf("n_bytes bigint, media binary")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in parts:
            rows = []
            for _, _, data, offs in blocks(arr, 2 << 20):
                for a, b in zip(offs[:-1], offs[1:], strict=True):
                    payload = padded(data[a:b].tobytes())
                    rows.append({"n_bytes": int(b - a), "media": store_payload(payload, FORMATS[zlib.crc32(payload) % len(FORMATS)])})
            yield pa.array(rows, kind)

    return run


def _describe(rate: int, files: bool):
    """A UDF of stored files, and the names of its fields: their payload, and the PCM file they decode and resample to, as ``wav`` only with files.

    Features come from the PCM file as it is read back.
    """
    kinds = {"payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string", "wav_bytes": "bigint", "wav_sha256": "string"}
    kinds |= {"wav": "binary"} if files else {}
    types = pa.struct([(n, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in kinds.items()])

    def described(row: dict, fmt: int, pcm: np.ndarray) -> None:
        stored = wav(resample(pcm, 8000, rate).tobytes(), PCM, rate)
        read_fmt, read_rate, _, _, data = unwav(stored)
        row["feature"] = f"format={fmt};rate={read_rate};" + features(decode(read_fmt, data))
        row["wav_bytes"], row["wav_sha256"] = len(stored), hashlib.sha256(stored).hexdigest()
        if files:
            row["wav"] = stored

    @F.arrow_udf(", ".join(f"{n} {t}" for n, t in kinds.items()))
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in parts:
            rows: list[dict] = []
            coded, owner, waiting = [], [], []

            def decoded(coded: list, owner: list, waiting: list) -> None:  # ADPCM blocks of many files together
                if waiting:
                    pcm, at = adpcm_blocks(np.concatenate(coded)), 0
                    for row, n in zip(waiting, owner, strict=True):
                        described(row, ADPCM, pcm[at : at + n].ravel())
                        at += n
                for part in (coded, owner, waiting):
                    part.clear()

            for item in arr:
                blob = item.as_py()
                fmt, back, samples = read_payload(blob)
                row = {"payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-UNIT:]), "media_bytes": len(blob), "media_sha256": hashlib.sha256(blob).hexdigest()}
                rows.append(row)
                if fmt != ADPCM:
                    described(row, fmt, decode(fmt, samples))
                    continue
                coded.append(np.frombuffer(samples, np.uint8).reshape(-1, UNIT + 4))
                owner.append(len(coded[-1]))
                waiting.append(row)
                if sum(owner) * UNIT >= 2 << 20:
                    decoded(coded, owner, waiting)
            decoded(coded, owner, waiting)
            yield pa.array(rows, types)

    return run, list(kinds)


def text_audio(docs: DataFrame, rate: int = 16000, files: bool = True) -> DataFrame:
    """docs with a struct ``audio``: each text's bytes as a telephony audio file, read back, decoded, resampled and stored as a PCM file.

    Equal texts have equal values. With ``files`` the two files are kept, as ``media`` and ``wav``; they take 5 to 9 times the text.
    """
    run, names = _describe(rate, files)
    df = docs.withColumn("__stored", _encode()("text"))
    df = df.withColumn("__read", run("__stored.media"))
    fields = ["__stored.n_bytes", *(f"__read.{n}" for n in names), *(["__stored.media"] if files else [])]
    return df.withColumn("audio", F.struct(*fields)).drop("__stored", "__read")


def op2_audio(spark, sf_dir: str) -> DataFrame:
    """The media files are written as a table; digests and features come from what is read there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", _encode()("text").alias("a"))
    stored, _ = written(docs.select("doc_id", "a.n_bytes", "a.media"), "media")
    return stored.select("doc_id", "n_bytes", _describe(16000, False)[0]("media").alias("a")).select("doc_id", "n_bytes", "a.*")
