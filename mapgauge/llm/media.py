"""Telephony audio in media columns: mu-law and A-law by table, ADPCM by numpy across blocks, resampled PCM."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapgauge.llm.common import small_batches, text_of

#: Fixed values of the wave container: format tags and the bits of a sample.
MULAW, ALAW, ADPCM, PCM = 7, 6, 17, 1
BITS = {MULAW: 8, ALAW: 8, ADPCM: 4, PCM: 16}
#: Fixed values of IMA ADPCM: what a code adds to the step's index.
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: Fixed values of IMA ADPCM: the step sizes.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
        7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law, 256 codes to 16-bit samples, by its rule: inverted bits, 3 bits of exponent, 4 of mantissa, bias 132."""
    c = ~np.arange(256, dtype=np.int32) & 0xFF
    x = ((((c & 15) << 3) + 132) << ((c >> 4) & 7)) - 132
    return np.where(c & 0x80, -x, x).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law, 256 codes to 16-bit samples, by its rule: every other bit inverted, 3 bits of exponent, 4 of mantissa."""
    c = np.arange(256, dtype=np.int32) ^ 0x55
    e, m = (c >> 4) & 7, (c & 15) << 4
    x = np.where(e == 0, m + 8, (m + 264) << np.maximum(e - 1, 0))
    return np.where(c & 0x80, x, -x).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def wave(samples: bytes, tag: int = MULAW, rate: int = 8000, block: int = 1) -> bytes:
    """A mono wave file around the stored samples."""
    bits = BITS[tag]
    per_second = rate * bits // 8 if tag != ADPCM else rate * block // ((block - 4) * 2 + 1)
    extra = struct.pack("<HH", 2, (block - 4) * 2 + 1) if tag == ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, per_second, block if tag == ADPCM else bits // 8, bits) + extra
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if tag != PCM:
        body += b"fact" + struct.pack("<II", 4, len(samples) if tag != ADPCM else (len(samples) // block) * ((block - 4) * 2 + 1))
    body += b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def unwave(media: bytes) -> tuple[int, int, int, memoryview]:
    """(format tag, rate, block size, stored samples) of a mono wave file; ValueError if it isn't one, or is damaged."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at, fmt = 12, None
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + n > len(media):
            raise ValueError("a wave file cut short")
        if kind == b"fmt ":
            if n < 16:
                raise ValueError("a format cut short")
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif kind == b"data":
            if fmt is None:
                raise ValueError("samples without a format")
            tag, channels, rate, _, block, bits = fmt
            if tag not in BITS or bits != BITS[tag]:
                raise ValueError(f"format {tag} of {bits} bits")
            if channels != 1 or rate < 1:
                raise ValueError(f"{channels} channels at rate {rate}")
            if tag == ADPCM and block <= 4 or tag == PCM and n % 2:
                raise ValueError("a block cut short")
            return tag, rate, block, memoryview(media)[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no samples")


def adpcm_samples(n: int, block: int) -> int:
    """Samples of n stored bytes; a last block cut short counts as far as it goes."""
    whole, short = divmod(n, block)
    return whole * ((block - 4) * 2 + 1) + (max(0, (short - 4) * 2 + 1) if short >= 4 else 0)


def adpcm(data, block: int, chunk: int = 1 << 16) -> np.ndarray:
    """IMA ADPCM, mono: blocks advance together, `chunk` of them, one code of each at a step. A last block cut short is decoded
    as far as it goes."""
    raw = np.frombuffer(data, np.uint8)
    n = -(-len(raw) // block)
    out = np.empty((n, (block - 4) * 2 + 1), np.int16)
    for a in range(0, n, chunk):
        own = raw[a * block : (a + chunk) * block]
        if len(own) % block:
            own = np.concatenate([own, np.zeros(-len(own) % block, np.uint8)])
        b = own.reshape(-1, block)
        x = b[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
        at = np.minimum(b[:, 2].astype(np.int32), 88)
        part = out[a : a + len(b)]
        part[:, 0] = x
        for k in range((block - 4) * 2):
            c = ((b[:, 4 + k // 2] >> (4 * (k & 1))) & 15).astype(np.int32)
            s = STEPS[at]
            d = (s >> 3) + np.where(c & 1, s >> 2, 0) + np.where(c & 2, s >> 1, 0) + np.where(c & 4, s, 0)
            x = np.clip(np.where(c & 8, x - d, x + d), -32768, 32767)
            at = np.clip(at + INDEX[c], 0, 88)
            part[:, k + 1] = x
    return out.reshape(-1)[: adpcm_samples(len(raw), block)]


def to_adpcm(pcm: np.ndarray, block: int = 256) -> bytes:
    """The encoder, for tests and for sources that hold PCM; blocks advance together here too."""
    per = (block - 4) * 2 + 1
    n = max(1, -(-len(pcm) // per))
    x = np.zeros(n * per, np.int32)
    x[: len(pcm)] = pcm
    x = x.reshape(n, per)
    out = np.zeros((n, block), np.uint8)
    out[:, :2] = x[:, :1].astype("<i2").view(np.uint8)
    p, at = x[:, 0].copy(), np.zeros(n, np.int32)
    for k in range(per - 1):
        s, d = STEPS[at], x[:, k + 1] - p
        c, rest, got = np.where(d < 0, 8, 0), np.abs(d), s >> 3
        for bit, part in ((4, s), (2, s >> 1), (1, s >> 2)):
            take = rest >= part
            c, rest, got = c | np.where(take, bit, 0), rest - np.where(take, part, 0), got + np.where(take, part, 0)
        p = np.clip(np.where(c & 8, p - got, p + got), -32768, 32767)
        at = np.clip(at + INDEX[c], 0, 88)
        out[:, 4 + k // 2] |= (c << (4 * (k & 1))).astype(np.uint8)
    return out.tobytes()


def expand(stored: list[tuple]) -> list[np.ndarray]:
    """16-bit samples of what is stored, for (tag, block, data) of several files: tables for the companded ones; ADPCM
    files of one block size are decoded together, each padded to whole blocks."""
    out: list = [None] * len(stored)
    together: dict[int, list[int]] = {}
    for i, (tag, block, data) in enumerate(stored):
        if tag == ADPCM:
            together.setdefault(block, []).append(i)
        else:
            out[i] = TABLES[tag][np.frombuffer(data, np.uint8)] if tag in TABLES else np.frombuffer(data, "<i2").astype(np.int16)
    for block, own in together.items():
        size = [len(stored[i][2]) for i in own]
        wide = adpcm(b"".join(x for i, n in zip(own, size, strict=True) for x in (stored[i][2], b"\0" * (-n % block))), block)
        at = 0
        for i, n in zip(own, size, strict=True):
            out[i] = wide[at : at + adpcm_samples(n, block)]
            at += -(-n // block) * ((block - 4) * 2 + 1)
    return out


def resample(pcm: np.ndarray, rate: int, to: int, chunk: int = 1 << 20) -> np.ndarray:
    """Linear interpolation in whole numbers, so that equal input gives equal output everywhere; `chunk` samples at a time."""
    if rate == to or len(pcm) == 0:
        return pcm
    n = len(pcm) * to // rate
    out = np.empty(n, np.int16)
    for a in range(0, n, chunk):
        at = np.arange(a, min(n, a + chunk), dtype=np.int64) * rate
        i, f = at // to, at % to
        x, y = pcm[i].astype(np.int64), pcm[np.minimum(i + 1, len(pcm) - 1)].astype(np.int64)
        out[a : a + chunk] = (x * (to - f) + y * f) // to
    return out


def feature(pcm: np.ndarray, chunk: int = 1 << 20) -> str:
    """Peak, mean square and sign changes, in whole numbers; `chunk` samples at a time."""
    if not len(pcm):
        return "0:0:0"
    peak = total = changes = 0
    for a in range(0, len(pcm), chunk):
        x = pcm[max(0, a - 1) : a + chunk].astype(np.int64)  # the sample before, for the change of sign
        changes += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        x = x[1:] if a else x
        peak, total = max(peak, int(np.abs(x).max())), total + int((x * x).sum())
    return f"{peak}:{total // len(pcm)}:{changes}"


#: Bytes of media that a task decodes together; a larger file is decoded alone.
TOGETHER = 1 << 20


def store_audio(df: DataFrame, payload_col: str, out_col: str = "media", tag: int = MULAW, rate: int = 8000, block: int = 64, tag_col: str | None = None) -> DataFrame:
    """df with out_col: the bytes of payload_col, unchanged, as the samples of a wave file (null: no samples): 8-bit ones, or for
    ADPCM blocks of `block` bytes. tag_col: a column with each row's format. A file is one row, of any length up to
    what an array holds (2 GB). Other columns stay; one called out_col is replaced."""
    kept = [c for c in df.columns if c != out_col]
    schema = df.select(*kept).schema.add(out_col, "binary")
    small_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            payload = b.column(payload_col)
            tags = b.column(tag_col).to_pylist() if tag_col else [tag] * b.num_rows
            media = pa.array([wave(x.as_buffer().to_pybytes() if x.is_valid else b"", t, rate, block) for x, t in zip(payload, tags, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), media], names=[*kept, out_col])

    return df.select(*kept).mapInArrow(run, schema)


def decode_audio(df: DataFrame, media_col: str = "media", to_rate: int = 16000, pcm: bool = True) -> DataFrame:
    """df with what a media column holds: `samples` (the stored bytes, read back), `codec`, `rate`, `feature` (of the
    expanded samples), `pcm` (16-bit little endian, resampled to to_rate; left out if pcm is False), `error`.
    A null or damaged file gives nulls and its error; a file without samples gives empty bytes. Files are decoded about
    1 MB together, a longer one alone; its samples are widened and resampled in parts. Other columns stay; those of the
    new names are replaced."""
    kept = [c for c in df.columns if c not in ("samples", "codec", "rate", "feature", "pcm", "error")]
    schema = df.select(*kept).schema.add("samples", "binary").add("codec", "integer").add("rate", "integer").add("feature", "string").add("error", "string")
    schema = schema.add("pcm", "binary") if pcm else schema
    kinds = {"samples": pa.binary(), "codec": pa.int32(), "rate": pa.int32(), "feature": pa.string(), "error": pa.string(), "pcm": pa.binary()}
    names = list(kinds)[: 6 if pcm else 5]

    def opened(x):
        if not x.is_valid:
            return None, "null"
        try:
            return unwave(x.as_buffer().to_pybytes()), None
        except ValueError as e:
            return None, str(e)

    def run(batches):
        for b in batches:
            size = [x.as_buffer().size if x.is_valid else 0 for x in b.column(media_col)]
            a = 0
            while a < b.num_rows:
                z, n = a + 1, size[a]
                while z < b.num_rows and n + size[z] <= TOGETHER:
                    n += size[z]
                    z += 1
                part, a = b.slice(a, z - a), z
                got = [opened(x) for x in part.column(media_col)]
                wide = iter(expand([(g[0], g[2], g[3]) for g, _ in got if g]))
                done = {k: [] for k in names}
                for g, error in got:
                    w = resample(next(wide), g[1], to_rate) if pcm and g else next(wide) if g else None
                    row = (bytes(g[3]), g[0], g[1], feature(w), None, w.astype("<i2", copy=False).tobytes() if pcm else None) if g else (None, None, None, None, error, None)
                    for k, v in zip(names, row, strict=False):
                        done[k].append(v)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *[pa.array(done[k], kinds[k]) for k in names]], names=[*kept, *names])

    return df.select(*kept).mapInArrow(run, schema)


def text_payload(df: DataFrame, text_col: str = "text", out_col: str = "payload", unit: int = 64) -> DataFrame:
    """df with out_col: the text's UTF-8 bytes (null: none), then bytes 0 up to a positive multiple of unit. All other columns stay."""
    raw = F.encode(text_of(text_col), "UTF-8")
    n = F.octet_length(raw)
    pad = F.when(n == 0, unit).otherwise(F.pmod(-n, F.lit(unit)))
    return df.withColumn(out_col, F.concat(raw, F.encode(F.repeat(F.lit("\0"), pad.cast("int")), "UTF-8")))


def payload_format(payload_col: str = "payload"):
    """mu-law, A-law or ADPCM, by the payload's checksum: equal payloads, equal formats."""
    return F.element_at(F.array(F.lit(MULAW), F.lit(ALAW), F.lit(ADPCM)), (F.crc32(payload_col) % 3 + 1).cast("int"))


def op5_media(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = text_payload(docs).select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), "payload")
    stored = store_audio(docs.withColumn("_format", payload_format()), "payload", tag_col="_format").drop("payload", "_format")
    back = decode_audio(stored, to_rate=16000, pcm=True)
    tail = F.expr("substring(samples, -64, 64)")
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "codec",
        F.octet_length("pcm").cast("long").alias("pcm_bytes"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
    )
