"""Secrets in texts: patterns, and encoded keys and tokens that are confirmed by their structure."""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardmill.llm.common import whole

#: The kinds in the order in which spans with the same start are listed; the first three are found by pattern alone.
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "jwt")
PATTERNS = ("assign", "access", "hex")
SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}+")
PEM = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
#: Runs that may be an encoded key; a run is taken whole, so it must not follow a character of its own kind.
BASE64_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}")
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}+")
#: An encoded JSON object begins with e and one of these. A token may begin in any part, so none is used up by a match.
SIGNED = re.compile(
    r"(?<![A-Za-z0-9_-])(?=(e[w-z0-9_-][A-Za-z0-9_-]*+\.e[w-z0-9_-][A-Za-z0-9_-]*+\.[A-Za-z0-9_-]*+))"
)
OPENSSH = b"openssh-key-v1\0"
#: Bytes of a signature by its algorithm; RSA signatures are at least as long as a 1024-bit modulus.
SIGNATURE_BYTES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EDDSA": 64}


def decoded(run: str) -> bytes | None:
    """The bytes of a base64 run in either alphabet, with or without padding."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of a length-prefixed element that must lie within `end`."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length >= 0x80:
        count = length & 0x7F
        if not 1 <= count <= 4 or at + count > end or data[at] == 0:
            return None
        length, at = int.from_bytes(data[at : at + count], "big"), at + count
        if length < 0x80:
            return None
    return (tag, at, at + length) if at + length <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a stretch exactly; None if they don't."""
    found = []
    while at < end:
        one = element(data, at, end)
        if one is None:
            return None
        found.append(one)
        at = one[2]
    return found


def nested(data: bytes, parts: list[tuple[int, int, int]], depth: int = 0) -> bool:
    """Do all constructed elements fill their lengths exactly, at every level?"""
    for tag, at, end in parts:
        if tag & 0x20:
            inner = elements(data, at, end)
            if inner is None or depth > 16 or not nested(data, inner, depth + 1):
                return False
    return True


def key_encoding(data: bytes) -> bool:
    """Is this a DER private key: RSA, DSA, elliptic curve, or wrapped with its algorithm, plain or encrypted?"""
    top = element(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = elements(data, top[1], top[2])
    if not parts or not nested(data, parts):
        return False
    tags = [tag for tag, _, _ in parts]
    number = data[parts[0][1] : parts[0][2]] if tags[0] == 0x02 else b""
    if tags in ([0x02] * 9, [0x02] * 6):  # two-prime RSA; DSA
        large = parts[1][2] - parts[1][1] >= 32
        return number == b"\0" and large
    if tags[:2] == [0x02, 0x04] and set(tags[2:]) <= {0xA0, 0xA1}:  # elliptic curve
        return number == b"\1" and 16 <= parts[1][2] - parts[1][1] <= 72
    if tags[:3] == [0x02, 0x30, 0x04] and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:  # with its algorithm
        named = elements(data, parts[1][1], parts[1][2])
        return number in (b"\0", b"\1") and bool(named) and named[0][0] == 0x06
    if tags == [0x30, 0x04]:  # encrypted
        named = elements(data, parts[0][1], parts[0][2])
        return bool(named) and named[0][0] == 0x06 and parts[1][2] - parts[1][1] >= 16
    return False


def openssh_encoding(data: bytes) -> bool:
    """Is this an OpenSSH private key: its magic, then length-prefixed strings that fill it exactly?"""
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)

    def take() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        length = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + length > len(data):
            return None
        at += 4 + length
        return data[at - length : at]

    cipher, kdf, options = take(), take(), take()
    if not cipher or not kdf or options is None or at + 4 > len(data):
        return False
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= count <= 16 or any(not take() for _ in range(count)):
        return False
    return bool(take()) and len(data) - at in (0, 16)  # some ciphers add a tag


def signed_token(run: str) -> bool:
    """Three parts: a JSON header that names an algorithm, a JSON object, and a signature of that algorithm's length."""
    header, body, signature = (decoded(part) for part in run.split("."))
    if header is None or body is None or signature is None:
        return False
    try:
        told, claims = json.loads(header), json.loads(body)
    except (ValueError, RecursionError):
        return False
    algorithm = told.get("alg") if isinstance(told, dict) else None
    if not isinstance(algorithm, str) or not isinstance(claims, dict):
        return False
    if algorithm[:2] in ("RS", "PS"):
        return len(signature) >= 128
    return len(signature) == SIGNATURE_BYTES.get(algorithm.upper(), -1)


def may_be_key(head: bytes, size: int) -> bool:
    """By its first bytes and its length: worth decoding whole? Most runs end here."""
    if head.startswith(OPENSSH[: len(head)]):
        return True
    if len(head) < 6 or head[0] != 0x30:
        return False
    if head[1] < 0x80:
        return head[1] + 2 == size
    count = head[1] & 0x7F
    return 1 <= count <= 4 and int.from_bytes(head[2 : 2 + count], "big") + 2 + count == size


def key_blocks(text: str) -> list[tuple[str, int, int]]:
    """Blocks between a BEGIN mark and an END mark of the same label, without another mark in between, that hold a key."""
    marks = list(PEM.finditer(text)) if "-----BEGIN " in text else []
    return [
        ("pem", one.start(), other.end())
        for one, other in zip(marks, marks[1:], strict=False)
        if (one[1], other[1]) == ("BEGIN", "END") and one[2] == other[2] and holds_key(text[one.end() : other.start()])
    ]


def holds_key(body: str) -> bool:
    body = body.replace("\\n", "\n").replace("\\r", "")
    if "Proc-Type:" in body:  # headers come before an empty line; the body is encrypted and has no structure to see
        body = re.split(r"\r?\n\r?\n", body, maxsplit=1)[-1]
        data = decoded("".join(body.split()))
        return bool(data) and len(data) % 8 == 0
    data = decoded("".join(body.split()))
    return bool(data) and (key_encoding(data) or openssh_encoding(data))


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start, then by kind; positions are code points."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    blocks = key_blocks(text)
    found += blocks
    inside = iter([*blocks, ("", len(text) + 1, 0)])
    block = next(inside)
    for m in BASE64_RUN.finditer(text):
        while block[1] <= m.start() and block[2] < m.end():
            block = next(inside)
        if block[1] <= m.start():
            continue  # a line of a block that is reported
        run = m[0].rstrip("=")
        head = decoded(run[:24])
        if head is None or not may_be_key(head, len(run) * 3 // 4):
            continue
        data = decoded(run)
        if data and openssh_encoding(data):
            found.append(("openssh", m.start(), m.end()))
        elif data and key_encoding(data):
            found.append(("der", m.start(), m.end()))
    for m in HEX_RUN.finditer(text):
        size = m.end() - m.start()
        if size % 2 == 0 and may_be_key(bytes.fromhex(m[0][:32]), size // 2):
            data = bytes.fromhex(m[0])
            if openssh_encoding(data):
                found.append(("openssh", m.start(), m.end()))
            elif key_encoding(data):
                found.append(("der", m.start(), m.end()))
    if ".e" in text:
        found += [("jwt", m.start(1), m.end(1)) for m in SIGNED.finditer(text) if signed_token(m[1])]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


@F.arrow_udf(SPANS)
def secret_spans(texts: pa.Array) -> pa.Array:
    """The spans of each text, as a column; a NULL or empty text has none."""
    rows = [
        [{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t.as_py() or "")] if t.is_valid else [] for t in texts
    ]
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    return pa.array(rows, pa.list_(kind))


def told(spans: Column) -> Column:
    """Spans as one text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the spans found in the whole text, one row for each row of `docs`."""
    return docs.select(F.col(doc_id).alias("doc_id"), secret_spans(whole(text)).alias("spans"))


def without_overlaps(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that touch or overlap, merged; the kind of the first stays."""
    merged: list[tuple[str, int, int]] = []
    for kind, start, end in spans:
        if merged and start < merged[-1][2]:
            merged[-1] = (merged[-1][0], merged[-1][1], max(end, merged[-1][2]))
        else:
            merged.append((kind, start, end))
    return merged


def masked(text: str) -> str:
    out, at = [], 0
    for kind, start, end in without_overlaps(spans_of(text)):
        out += [text[at:start], f"<{kind}>"]
        at = end
    return "".join([*out, text[at:]]) if out else text


@F.arrow_udf(T.StringType())
def mask_secrets(texts: pa.Array) -> pa.Array:
    """Each text with every secret replaced by its kind; NULL stays NULL."""
    return pa.array([masked(t.as_py()) if t.is_valid else None for t in texts], pa.string())
