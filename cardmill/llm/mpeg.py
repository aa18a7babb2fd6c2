"""MPEG audio as a media column: frames, tags, variable-bitrate tables, checksums, durations and seek offsets.

`mpeg_encode` stores bytes without loss: silent Layer III frames carry them as ancillary data, the part of a frame
that a decoder skips. `mpeg_decode` reads any MPEG audio bytes, damaged ones too.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

DECODED = pa.struct(
    [
        ("version", pa.string()),
        ("layer", pa.int32()),
        ("sample_rate", pa.int32()),
        ("channels", pa.int32()),
        ("frames", pa.int64()),
        ("samples", pa.int64()),
        ("duration_s", pa.float64()),
        ("variable_bitrate", pa.string()),
        ("promised_frames", pa.int64()),
        ("promised_bytes", pa.int64()),
        ("checked", pa.int64()),
        ("bad_checksums", pa.int64()),
        ("unsynchronised_bytes", pa.int64()),
        ("truncated", pa.bool_()),
        ("tags", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
        ("seek_offsets", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)
# Fixed values of the format: kbit/s by index (1 to 14), samples a second by index, for version 1 and for 2 and 2.5.
BITRATES = {
    ("1", 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    ("1", 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    ("1", 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    ("2", 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    ("2", 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    ("2", 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
LAYERS = {3: 1, 2: 2, 1: 3}

#: What `mpeg_encode` writes: version 1, Layer III, 48 kHz, one channel, with checksums.
OWNER = b"payload-bytes\0"
SIDE_MONO = 17
FRAME_HEAD = 4 + 2 + SIDE_MONO


@lru_cache(maxsize=4096)
def checksum(covered: bytes) -> int:
    """CRC-16 of the format over the covered bytes."""
    value = 0xFFFF
    for byte in covered:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005) & 0xFFFF if value & 0x8000 else value << 1
    return value


@lru_cache(maxsize=4096)
def header(four: bytes) -> tuple | None:
    """Version, layer, sample rate, channels, bytes and samples of a frame, and whether it has a checksum."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(four[1] >> 3 & 3), LAYERS.get(four[1] >> 1 & 3)
    rate_index, frequency = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer is None or rate_index in (0, 15) or frequency == 3 or four[3] & 3 == 2:
        return None
    sample_rate = SAMPLE_RATES[version][frequency]
    bitrate = 1000 * BITRATES["1" if version == "1" else "2", layer][rate_index - 1]
    padding = four[2] >> 1 & 1
    if layer == 1:
        size, samples = (12 * bitrate // sample_rate + padding) * 4, 384
    else:
        samples = 576 if layer == 3 and version != "1" else 1152
        size = samples // 8 * bitrate // sample_rate + padding
    return version, layer, sample_rate, 1 if four[3] >> 6 == 3 else 2, size, samples, not four[1] & 1


def side_bytes(version: str, channels: int) -> int:
    return (17 if channels == 1 else 32) if version == "1" else (9 if channels == 1 else 17)


def covered_by_checksum(data: bytes, at: int, frame: tuple) -> bytes | None:
    """What the checksum of a frame covers besides its header; None where the format's Layer II tables are needed."""
    version, layer, _, channels = frame[:4]
    if layer == 3:
        return data[at + 6 : at + 6 + side_bytes(version, channels)]
    if layer == 1:
        mode = data[at + 3] >> 6
        bound = 4 * ((data[at + 3] >> 4 & 3) + 1) if mode == 1 else 32
        bits = 4 * (bound * channels + 32 - bound)
        return data[at + 6 : at + 6 + bits // 8]
    return None


def tag_size(data: bytes, at: int) -> int:
    """Bytes of the ID3v2 tag at a position, 0 if there is none or it is not whole."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or any(b & 0x80 for b in data[at + 6 : at + 10]):
        return 0
    size = 10 + syncsafe(data[at + 6 : at + 10]) + (10 if data[at + 5] & 0x10 else 0)
    return size if at + size <= len(data) else 0


def syncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def read_tag(data: bytes, at: int, tags: list) -> int | None:
    """Text frames of an ID3v2.3 or 2.4 tag go to `tags`; the stored payload length is returned if it has one."""
    version, flags, end, promised = data[at + 3], data[at + 5], at + 10 + syncsafe(data[at + 6 : at + 10]), None
    at += 10
    if version not in (3, 4) or flags & 0x80:
        return None
    if flags & 0x40 and at + 4 <= end:
        four = data[at : at + 4]
        at += syncsafe(four) if version == 4 else 4 + int.from_bytes(four, "big")
    while at + 10 <= end and data[at] != 0:
        name, four = data[at : at + 4], data[at + 4 : at + 8]
        size = syncsafe(four) if version == 4 else int.from_bytes(four, "big")
        body = data[at + 10 : min(end, at + 10 + size)]
        if name == b"PRIV" and body.startswith(OWNER):
            promised = int.from_bytes(body[len(OWNER) :], "big")
        elif name[:1] == b"T" and name != b"TXXX" and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            tags.append({"name": name.decode("latin-1"), "value": body[1:].decode(code, "replace").strip("\0")})
        at += 10 + size
    return promised


def trailing_tags(data: bytes, at: int) -> dict[int, bool]:
    """Where the sound may end, by the marks of tags behind it, and whether an ID3v1 tag would follow there.

    Sound can hold the same bytes as a mark, so the frames decide which of these it is.
    """
    ends = {len(data): False}
    if len(data) - at >= 128 and data[-128:-125] == b"TAG":
        ends[len(data) - 128] = True
    for end, tagged in list(ends.items()):
        if end - at >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
            size = int.from_bytes(data[end - 20 : end - 16], "little") + (32 if data[end - 9] & 0x80 else 0)
            if 32 <= size <= end - at:
                ends.setdefault(end - size, tagged)
    return ends


def frames_reach(data: bytes, at: int, end: int, kind: tuple | None) -> bool:
    """Do frames of one kind follow each other from a position exactly to the end?"""
    while at < end:
        frame = header(data[at : at + 4])
        if not frame or kind and frame[:3] != kind:
            return False
        kind = frame[:3]
        at += frame[4]
    return at == end


def decode(data: bytes) -> dict:
    """All that DECODED holds for one file; bytes without any frame give zero frames."""
    tags: list[dict] = []
    at, payload_size = 0, None
    while size := tag_size(data, at):
        told = read_tag(data, at, tags)
        payload_size = told if told is not None else payload_size
        at += size
    ends = trailing_tags(data, at)
    end = min(ends)

    out = {"version": None, "layer": None, "sample_rate": None, "channels": None, "variable_bitrate": None}
    out |= {"promised_frames": None, "promised_bytes": None, "truncated": False, "tags": tags}
    seek, parts, lost, checked, bad, samples = [], [], 0, 0, 0, 0
    in_step, kind, first = False, None, True
    while True:
        if end < len(data) and (in_step or at == end):  # do frames run over the marks of a tag? Then they are sound
            crossing = header(data[at : at + 4])
            if at == end or crossing and at + crossing[4] > end:
                end = max([end, *(e for e in ends if e > end and frames_reach(data, at, e, kind))])
        if at + 4 > end:
            lost += max(0, end - at)
            break
        frame = header(data[at : at + 4])
        if frame and kind and frame[:3] != kind:
            frame = None
        if frame and not in_step:  # a header counts if another of its kind, or the end, follows
            after = at + frame[4]
            following = header(data[after : after + 4]) if after + 4 <= end else None
            if not (after in ends or following and following[:3] == frame[:3]):
                frame = None
        if frame is None:
            in_step = False
            following = data.find(b"\xff", at + 1, end)
            following = end if following < 0 else following
            lost += following - at
            at = following
            continue
        version, layer, rate, channels, size, count, protected = frame
        if at + size > end and at + size in ends:
            end = at + size
        if at + size > end:
            out["truncated"] = True
            break
        in_step, kind = True, frame[:3]
        body = at + 4 + 2 * protected + (side_bytes(version, channels) if layer == 3 else 0)
        if first:
            first = False
            out |= {"version": version, "layer": layer, "sample_rate": rate, "channels": channels}
            told = bitrate_table(data, at, body, size)
            if told:
                out |= told
                at += size
                continue
        if protected:
            covered = covered_by_checksum(data, at, frame)
            if covered is not None:
                checked += 1
                bad += checksum(data[at + 2 : at + 4] + covered) != int.from_bytes(data[at + 4 : at + 6], "big")
        seek.append(at)
        samples += count
        parts.append(data[body : at + size])
        at += size
    if end <= len(data) - 128 and ends[end]:
        for name, low, high in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[len(data) - 128 + low : len(data) - 128 + high].rstrip(b"\0 ").decode("latin-1"):
                tags.append({"name": name, "value": value})
    payload = b"".join(parts)
    out |= {"frames": len(seek), "samples": samples, "checked": checked, "bad_checksums": bad}
    out |= {"duration_s": samples / out["sample_rate"] if seek else 0.0, "unsynchronised_bytes": lost}
    out |= {"seek_offsets": seek, "payload": payload if payload_size is None else payload[:payload_size]}
    return out


def bitrate_table(data: bytes, at: int, body: int, size: int) -> dict | None:
    """A first frame that tells the number of frames and bytes instead of sound."""
    for place in (body, at + 36):
        name = data[place : place + 4]
        if name in (b"Xing", b"Info"):
            flags, place, told = int.from_bytes(data[place + 4 : place + 8], "big"), place + 8, {}
            for bit, field in ((1, "promised_frames"), (2, "promised_bytes")):
                if flags & bit:
                    told[field] = int.from_bytes(data[place : place + 4], "big")
                    place += 4
            return {"variable_bitrate": name.decode()} | told
        if name == b"VBRI" and place + 18 <= at + size:
            return {
                "variable_bitrate": "VBRI",
                "promised_bytes": int.from_bytes(data[place + 10 : place + 14], "big"),
                "promised_frames": int.from_bytes(data[place + 14 : place + 18], "big"),
            }
    return None


def size_at(index: int) -> int:
    return 144 * 1000 * BITRATES["1", 3][index - 1] // 48000


def frame_head(index: int, *, protected: bool = True) -> bytes:
    """Header, checksum and an all-zero description (silence) of a frame with the given bitrate."""
    four = bytes((0xFF, 0xFA if protected else 0xFB, index << 4 | 0x04, 0xC0))
    silence = bytes(SIDE_MONO)
    return four + (checksum(four[2:] + silence).to_bytes(2, "big") if protected else b"") + silence


HEADS = {index: frame_head(index) for index in range(1, 15)}
ROOM = {index: size_at(index) - FRAME_HEAD for index in range(1, 15)}


def encode(payload: bytes) -> bytes:
    """Bytes as an MPEG audio file: a tag, a table frame, full frames, a last one of the least bitrate that holds the rest."""
    full = ROOM[14]
    frames = []
    for at in range(0, len(payload), full):
        part = payload[at : at + full]
        index = 14 if len(part) == full else next(i for i in range(1, 15) if ROOM[i] >= len(part))
        frames.append(HEADS[index] + part + bytes(ROOM[index] - len(part)))
    table_index = 5  # the least bitrate whose frame holds the table
    total = size_at(table_index) + sum(map(len, frames))
    marks, at, step = [], size_at(table_index), max(len(frames), 1)
    for i in range(100):
        full_before = min(i * step // 100, max(0, len(frames) - 1))
        marks.append(min(255, 256 * (at + full_before * size_at(14)) // total))
    table = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + bytes(marks)
    first = frame_head(table_index, protected=False) + table
    first += bytes(size_at(table_index) - len(first))
    length = str(len(frames) * 1152 // 48).encode()
    fields = tag_field(b"TLEN", b"\3" + length) + tag_field(b"PRIV", OWNER + len(payload).to_bytes(8, "big"))
    return b"ID3\4\0\0" + to_syncsafe(len(fields)) + fields + first + b"".join(frames)


def tag_field(name: bytes, body: bytes) -> bytes:
    return name + to_syncsafe(len(body)) + b"\0\0" + body


def to_syncsafe(size: int) -> bytes:
    return bytes((size >> 21 & 0x7F, size >> 14 & 0x7F, size >> 7 & 0x7F, size & 0x7F))


@F.arrow_udf(T.BinaryType())
def mpeg_encode(payloads: pa.Array) -> pa.Array:
    """Bytes as MPEG audio; NULL stays NULL."""
    return pa.array([encode(p.as_py()) if p.is_valid else None for p in payloads], pa.binary())


@F.arrow_udf(from_arrow_type(DECODED))
def mpeg_decode(files: pa.Array) -> pa.Array:
    """What an MPEG audio file holds; NULL stays NULL, bytes without a frame give zero frames."""
    return pa.array([decode(f.as_py()) if f.is_valid else None for f in files], DECODED)
