"""MPEG audio as a media column: write payloads as frames, and parse any stream of frames.

Writer: MPEG-1 Layer III, 48 kHz, mono, CRC-protected. An ID3v2.3 tag names the payload's length, a first small frame
carries the Xing table (frames, bytes, 100 seek points), then each frame holds 576 payload bytes behind an all-zero side
info, which decoders play as silence.

Parser: ID3v2 and ID3v1 tags, all MPEG versions and layers, Xing/Info and VBRI tables, CRC-16 checks of Layers I and III, and
resynchronisation: a header counts only if another header (or the end, or a tag) follows at the length it announces, so
chance sync patterns inside the data are passed over. Durations are exact (samples and rate, never a float).

Media tables hold durations (samples and rate) and frame offsets beside the bytes, so that seeking reads no stream.

Limits: checksums of Layer II, which cover tables by bitrate, are not verified (they count in neither crc_checked nor
crc_errors); frames of ID3v2.2 tags, unsynchronised tags and extended headers yield no tags, though their length is
skipped; free-format frames are skipped as noise; of a frame's body, payload holds the first 576 bytes, which is all only
of the writer's own.

Defined results: null media and media without any frame give 0 frames, 0 samples, an empty payload and no offsets; a
truncated last frame is not counted; repeated rows each get their own row; other columns pass through untouched,
but for columns of the result's names, which are replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.llm.common import documents, free_name, scratch_path

UNIT = 576
PAD = 255

# Fixed values of the MPEG audio formats (ISO/IEC 11172-3 and 13818-3): kbit/s by index 1 to 14, Hz by index, and the generator of the CRC.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
CRC_POLYNOMIAL = 0x8005

#: The writer's headers: sync, MPEG-1, Layer III, protected, 224 kbit/s (672 bytes) or 64 kbit/s (192 bytes), 48 kHz, mono.
DATA_HEADER = bytes((0xFF, 0xFA, 0xC4, 0xC0))
TABLE_HEADER = bytes((0xFF, 0xFA, 0x54, 0xC0))
SIDE = 17
DATA_FRAME, TABLE_FRAME = 672, 192


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = ((crc << 1) ^ CRC_POLYNOMIAL if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


#: Most frames of a stream have the same header and side info.
known_crc16 = lru_cache(4096)(crc16)


@lru_cache(4096)
def header_of(word: int) -> tuple[int, int, int, int, int, int, bool] | None:
    """(version bits, layer, Hz, kbit/s, bytes, samples, protected) of a frame header, None if it isn't one."""
    if word >> 21 != 0x7FF:
        return None
    version, layer, rate, bits = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 10 & 3, word >> 12 & 15
    if version == 1 or layer == 4 or rate == 3 or bits in (0, 15) or word & 3 == 2:
        return None
    hz, kbps, pad = RATES[version][rate], BITRATES[1 if version == 3 else 2, layer][bits - 1], word >> 9 & 1
    if layer == 1:
        size, samples = (12 * kbps * 1000 // hz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        size = samples // 8 * kbps * 1000 // hz + pad
    return version, layer, hz, kbps, size, samples, not word >> 16 & 1


def padded(text: bytes) -> bytes:
    """The payload of a text: bytes 255 up to a positive multiple of 576."""
    return text + bytes([PAD]) * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def encode_stream(payload: bytes) -> bytes:
    """The MPEG audio file that carries payload, whose length is a multiple of 576."""
    if len(payload) % UNIT:
        raise ValueError(f"a payload has a multiple of {UNIT} bytes")
    n = len(payload) // UNIT
    text = b"\x00payload_bytes\x00" + str(len(payload)).encode()
    body = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    size = len(body)
    tag = b"ID3\x03\x00\x00" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + body
    total = TABLE_FRAME + n * DATA_FRAME
    toc = bytes(min(255, (TABLE_FRAME + (k * n // 100) * DATA_FRAME) * 256 // total) for k in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, total) + toc
    side = bytes(SIDE)
    first = TABLE_HEADER + struct.pack(">H", known_crc16(TABLE_HEADER[2:] + side)) + side + table
    frames = np.zeros((n, DATA_FRAME), np.uint8)
    head = np.frombuffer(DATA_HEADER + struct.pack(">H", known_crc16(DATA_HEADER[2:] + side)) + side, np.uint8)
    frames[:, : len(head)] = head
    frames[:, len(head) : len(head) + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    return tag + first.ljust(TABLE_FRAME, b"\0") + frames.tobytes()


def _tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """Text tags, and where the frames begin and end."""
    tags: dict[str, str] = {}
    at, end = 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end and max(data[at + 6 : at + 10]) < 128:
        size = data[at + 6] << 21 | data[at + 7] << 14 | data[at + 8] << 7 | data[at + 9]
        wide, p, stop = data[at + 3] == 4, at + 10, min(end, at + 10 + size)
        while p + 10 <= stop and data[p] and data[p + 4] < 128:
            raw = data[p + 4 : p + 8]
            length = raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3] if wide else int.from_bytes(raw, "big")
            body = data[p + 10 : min(stop, p + 10 + length)]
            if data[p : p + 1] == b"T" and body:
                code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                parts = body[1:].decode(code, "replace").split("\0")
                if data[p : p + 4] == b"TXXX" and len(parts) > 1:
                    tags[parts[0]] = parts[1]
                else:
                    tags[data[p : p + 4].decode("latin-1")] = parts[0]
            p += 10 + length
        at = at + 10 + size + (10 if wide and data[at + 5] & 16 else 0)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, lo, hi in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            tags.setdefault(name, data[end + lo : end + hi].split(b"\0")[0].decode("latin-1").strip())
    return tags, min(at, end), end


def _table(frame: bytes, head: tuple) -> dict | None:
    """The variable-bitrate table of a frame, if it has one."""
    version, layer, _, _, _, _, protected = head
    if layer != 3:
        return None
    mono = frame[3] >> 6 == 3
    side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
    for at in (4 + side, 6 + side):
        if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
            flags, p = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            out: dict = {"kind": frame[at : at + 4].decode(), "frames": None, "bytes": None, "toc": []}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], p = int.from_bytes(frame[p : p + 4], "big"), p + 4
            if flags & 4:
                out["toc"] = list(frame[p : p + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, _ = struct.unpack(">IIHHHH", frame[46:62])
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries) if 62 + (i + 1) * width <= len(frame)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return None


def parse_stream(data: bytes | None) -> dict:
    """Everything that the parser reports of one stream; see the module's text for odd input."""
    data = data or b""
    tags, at, end = _tags(data)
    out: dict = {"tags": tags, "version": None, "layer": None, "sample_rate": None, "frames": 0, "samples": 0, "offsets": [], "table": None, "crc_checked": 0, "crc_errors": 0, "skipped_bytes": 0}
    chunks, first, kind = [], True, None
    while at + 4 <= end:
        head = header_of(int.from_bytes(data[at : at + 4], "big"))
        ok = head is not None and at + head[4] <= end and (kind is None or head[:3] == kind)
        if ok and at + head[4] + 4 <= end:
            after = header_of(int.from_bytes(data[at + head[4] : at + head[4] + 4], "big"))
            ok = after is not None and after[:3] == head[:3]
        elif ok:
            ok = at + head[4] == end or kind is not None
        if not ok:
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            out["skipped_bytes"] += found - at
            at = found
            continue
        version, layer, hz, _, size, samples, protected = head
        kind = head[:3]
        frame = data[at : at + size]
        side = ((17 if frame[3] >> 6 == 3 else 32) if version == 3 else (9 if frame[3] >> 6 == 3 else 17)) if layer == 3 else 0
        if protected and layer != 2:
            # Of Layer III the side info, of Layer I the bit allocation: four bits a subband, shared by both channels above a joint bound.
            mode, bound = frame[3] >> 6, (frame[3] >> 4 & 3) * 4 + 4
            covered = side if layer == 3 else 16 if mode == 3 else 16 + bound // 2 if mode == 1 else 32
            out["crc_checked"] += 1
            out["crc_errors"] += known_crc16(frame[2:4] + frame[6 : 6 + covered]) != int.from_bytes(frame[4:6], "big")
        if first and (table := _table(frame, head)):
            out["table"] = table
        else:
            out["offsets"].append(at)
            out["frames"] += 1
            out["samples"] += samples
            body = 4 + 2 * protected + side
            chunks.append(frame[body : body + UNIT])
        first = False
        out |= {"version": {3: "1", 2: "2", 0: "2.5"}[version], "layer": layer, "sample_rate": hz}
        at += size
    out["skipped_bytes"] += max(0, end - at)
    payload = b"".join(chunks)
    length = tags.get("payload_bytes", "")
    out["payload"] = payload[: int(length)] if length.isdigit() else payload
    return out


PARSED = T.StructType([
    T.StructField("payload", T.BinaryType()),
    T.StructField("mpeg_version", T.StringType()),
    T.StructField("layer", T.IntegerType()),
    T.StructField("sample_rate", T.IntegerType()),
    T.StructField("frames", T.LongType()),
    T.StructField("samples", T.LongType()),
    T.StructField("frame_offsets", T.ArrayType(T.LongType())),
    T.StructField("table_kind", T.StringType()),
    T.StructField("table_frames", T.LongType()),
    T.StructField("table_bytes", T.LongType()),
    T.StructField("seek_table", T.ArrayType(T.LongType())),
    T.StructField("crc_checked", T.LongType()),
    T.StructField("crc_errors", T.LongType()),
    T.StructField("skipped_bytes", T.LongType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a binary column that holds each whole text (null: empty) as an MPEG audio file."""
    docs = docs.drop(media)
    schema = T.StructType([*docs.schema.fields, T.StructField(media, T.BinaryType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([encode_stream(padded(x or b"")) for x in texts], pa.binary())], names=[*batch.schema.names, media])

    return docs.mapInArrow(write, schema)


def with_parsed(df: DataFrame, media: str = "media", to: str = "audio") -> DataFrame:
    """df with its media column replaced by a struct of everything that parse_stream() reports."""
    keep = [f for f in df.schema.fields if f.name not in (media, to)]
    schema = T.StructType([*keep, T.StructField(to, PARSED)])
    names = [f.name for f in keep]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(PARSED)
        for batch in batches:
            rows = []
            for data in batch.column(media).to_pylist():
                x = parse_stream(data)
                t = x["table"] or {"kind": None, "frames": None, "bytes": None, "toc": None}
                rows.append({"payload": x["payload"], "mpeg_version": x["version"], "layer": x["layer"], "sample_rate": x["sample_rate"], "frames": x["frames"], "samples": x["samples"], "frame_offsets": x["offsets"], "table_kind": t["kind"], "table_frames": t["frames"], "table_bytes": t["bytes"], "seek_table": t["toc"], "crc_checked": x["crc_checked"], "crc_errors": x["crc_errors"], "skipped_bytes": x["skipped_bytes"], "tags": list(x["tags"].items())})
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(rows, kind)], names=[*names, to])

    return df.mapInArrow(read, schema)


STORED = ("frames", "samples", "sample_rate", "frame_offsets")


def with_seeking(df: DataFrame, media: str = "media", prefix: str = "") -> DataFrame:
    """df with frames, samples, sample_rate and frame_offsets of its media as columns; such names get the prefix and replace what df has."""
    whole = free_name(df, "whole")
    a = with_parsed(df.withColumn(whole, F.col(media)), media, "audio")
    return a.withColumnRenamed(whole, media).withColumns({f"{prefix}{c}": F.col(f"audio.{c}") for c in STORED}).drop("audio")


def op7_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    """Every text stored as MPEG audio in a table of media, read back from it, and digested."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    path = scratch_path(spark, "media")
    with_seeking(with_media(docs).drop("text")).write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema("doc_id bigint, n_bytes bigint, media binary, frames bigint, samples bigint, sample_rate int, frame_offsets array<bigint>").parquet(path)
    stored = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    a = with_parsed(stored)
    name = free_name(a, "offsets_crc32")
    return a.withColumn(name, F.crc32(F.array_join("audio.frame_offsets", ",").cast("binary"))).select(
        "doc_id",
        "n_bytes",
        F.octet_length("audio.payload").cast("long").alias("payload_bytes"),
        F.sha2("audio.payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("audio.payload", -32, 32)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.format_string(
            "mpeg%s layer%d frames=%d samples=%d/%d table=%s:%d:%d crc=%d/%d skipped=%d offsets=%d",
            *(f"audio.{c}" for c in ("mpeg_version", "layer", "frames", "samples", "sample_rate", "table_kind", "table_frames", "table_bytes", "crc_errors", "crc_checked", "skipped_bytes")),
            name,
        ).alias("feature"),
        "frames",
        "samples",
        "sample_rate",
        (F.col("frame_offsets") == F.col("audio.frame_offsets")).alias("offsets_agree"),
    )
