import random

from cardmill.llm.mpeg import BITRATES, checksum, decode, encode, frame_head, header, mpeg_decode, mpeg_encode, size_at
from pyspark.sql import functions as F


def test_round_trip_of_any_bytes():
    rng = random.Random(5)
    for size in (0, 1, 64, 936, 937, 938, 1874, 5000, 200_000):
        for fill in (rng.randbytes(size), b"\xff\xfb" * (size // 2), bytes(size)):
            out = decode(encode(fill))
            assert out["payload"] == fill
            assert out["frames"] == out["promised_frames"] == -(-len(fill) // 937)
            assert out["bad_checksums"] == 0 and out["checked"] == out["frames"] and not out["truncated"]
            assert out["unsynchronised_bytes"] == 0 and out["samples"] == 1152 * out["frames"]
            assert len(out["seek_offsets"]) == out["frames"]
            if out["frames"]:
                assert out["duration_s"] == out["samples"] / 48000 and out["variable_bitrate"] == "Xing"


def test_frames_are_where_the_offsets_say():
    data = encode(bytes(range(256)) * 20)
    out = decode(data)
    assert all(header(data[at : at + 4]) for at in out["seek_offsets"])
    total = len(data) - 10 - sum(b << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
    assert out["promised_bytes"] == total


def test_damaged_files():
    payload = bytes(range(256)) * 40
    data = encode(payload)
    first = decode(data)["seek_offsets"]
    # Junk between frames is skipped, also where it looks like a header.
    junk = data[: first[3]] + b"\xff\xfb\x90\x00junk\xff" + data[first[3] :]
    out = decode(junk)
    assert out["payload"] == payload and out["unsynchronised_bytes"] == 9
    # A changed description is told by the checksum.
    broken = bytearray(data)
    broken[first[2] + 10] ^= 1
    assert decode(bytes(broken))["bad_checksums"] == 1
    cut = decode(data[:-100])
    assert cut["truncated"] and cut["frames"] == len(first) - 1
    assert decode(b"")["frames"] == 0 and decode(b"no audio \xff\xfb")["frames"] == 0


def test_other_layers_tags_and_tables():
    # Version 1, Layer I, 32 kbit/s, 32 kHz: 48 bytes a frame, 384 samples.
    one = b"\xff\xff\x18\xc0" + bytes(44)
    out = decode(one * 5 + b"TAG" + b"song".ljust(30, b"\0") + bytes(95))
    assert (out["layer"], out["frames"], out["samples"]) == (1, 5, 1920)
    assert out["tags"] == [{"name": "title", "value": "song"}] and out["checked"] == 0
    # Version 2, Layer III, 22.05 kHz.
    two = header(b"\xff\xf3\x80\xc0")
    assert two[:4] == ("2", 3, 22050, 1) and two[5] == 576 and two[4] == 72 * 64000 // 22050
    sound = frame_head(5) + bytes(size_at(5) - 23)
    table = bytearray(frame_head(5, protected=False) + bytes(size_at(5) - 21))
    table[36:54] = b"VBRI" + bytes(6) + (900).to_bytes(4, "big") + (3).to_bytes(4, "big")
    out = decode(bytes(table) + sound * 3)
    assert (out["variable_bitrate"], out["promised_frames"], out["promised_bytes"], out["frames"]) == ("VBRI", 3, 900, 3)
    assert header(b"\xff\xfb\xf0\x00") is None and header(b"\xff\xfb\x0c\x00") is None
    assert len(BITRATES["1", 3]) == 14 and checksum(b"") == 0xFFFF


def test_columns(spark, odd, empty):
    stored = odd.select("doc_id", F.col("text").cast("binary").alias("b")).withColumn("m", mpeg_encode("b"))
    rows = stored.withColumn("a", mpeg_decode("m")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.a is None) == (r.b is None) and (r.b is None or bytes(r.a.payload) == bytes(r.b))
    assert empty.select(mpeg_decode(F.col("text").cast("binary"))).count() == 0


def test_payloads_that_look_like_tags():
    song = b"TAG" + b"song".ljust(30, b"\0") + bytes(95)
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (32).to_bytes(4, "little") + bytes(16)
    for mark in (b"TAG", b"APETAGEX", ape, song, ape + song):
        for size in [*range(1, 1100), 1874, 1900, 5000]:
            payload = (mark * (size // len(mark) + 1))[-size:]
            for data in {payload, payload[:-1] + b"x", bytes(64) + payload + bytes(16)}:
                out = decode(encode(data))
                assert out["payload"] == data and not out["truncated"] and not out["tags"][1:]
                assert out["frames"] == out["promised_frames"] and out["unsynchronised_bytes"] == 0
    # Every place that a mark can take in the last frames.
    for at in range(0, 1000):
        for mark in (b"TAG", ape):
            data = bytes(at) + mark + bytes(at % 130)
            assert decode(encode(data))["payload"] == data


def test_tags_behind_the_sound_still_count():
    song = b"TAG" + b"song".ljust(30, b"\0") + bytes(95)
    item = (4).to_bytes(4, "little") + bytes(4) + b"Year\0" + b"1999"
    ape = item + b"APETAGEX" + (2000).to_bytes(4, "little") + (32 + len(item)).to_bytes(4, "little") + bytes(16)
    for payload in (b"", b"TAG" * 100, bytes(range(256)) * 20):
        data = encode(payload)
        for behind in (song, ape, ape + song):
            out = decode(data + behind)
            assert out["payload"] == payload and not out["truncated"] and out["unsynchronised_bytes"] == 0
            assert ({"name": "title", "value": "song"} in out["tags"]) == behind.endswith(song)
    cut = decode(encode(bytes(5000))[:-50] + song)
    assert cut["truncated"] and {"name": "title", "value": "song"} in cut["tags"]
