import base64
import json
import time

from cardmill.llm.secrets import KINDS, mask_secrets, scan_secrets, spans_of


def der(tag, *parts):
    body = b"".join(parts)
    size = len(body)
    length = bytes([size]) if size < 128 else bytes([0x80 | (n := (size.bit_length() + 7) // 8)]) + size.to_bytes(n, "big")
    return bytes([tag]) + length + body


def number(value):
    return der(2, value.to_bytes(value.bit_length() // 8 + 1, "big"))


RSA = der(0x30, number(0), *(number(3**n) for n in (600, 11, 590, 300, 290, 280, 270, 260)))
EC = der(0x30, number(1), der(4, bytes(range(32))), der(0xA0, der(6, b"*\x86H\xce=\x03\x01\x07")))
WRAPPED = der(0x30, number(0), der(0x30, der(6, b"*\x86H\x86\xf7\r\x01\x01\x01"), der(5)), der(4, RSA))


def openssh():
    def held(data):
        return len(data).to_bytes(4, "big") + data

    return b"openssh-key-v1\0" + held(b"none") + held(b"none") + held(b"") + (1).to_bytes(4, "big") + held(b"pub") + held(b"private key")


def b64(data, url=False):
    return (base64.urlsafe_b64encode if url else base64.b64encode)(data).decode()


def token(header, claims, signature):
    return ".".join(b64(x, url=True).rstrip("=") for x in (header, claims, signature))


def kinds(text):
    return [k for k, _, _ in spans_of(text)]


def test_base_patterns():
    text = 'a Token = "abcdefgh" PASSWD:short secret: token: abcdefghij AKIA1234567890AB AKIA123 ' + "0a" * 16 + " " + "0a" * 15
    found = spans_of(text)
    assert [(k, text[s:e]) for k, s, e in found] == [
        ("assign", 'Token = "abcdefgh'), ("access", "AKIA1234567890AB"), ("hex", "0a" * 16)]
    assert spans_of("api_key='éabcdefghij'") == [] and spans_of("apikey\"  :  'a.b/c+d=e_f-'")[0][0] == "assign"
    # Only A-Z have another case: a long s is no s, a Kelvin sign no k.
    assert spans_of("ſecret: abcdefghij toKen: abcdefghij") == []
    assert spans_of("😀 token=12345678") == [("assign", 2, 16)]
    assert kinds("token=" + "f" * 40) == ["assign", "hex"]


def test_keys_are_confirmed_by_their_structure():
    for data in (RSA, EC, WRAPPED):
        for shown in (b64(data), b64(data, url=True).rstrip("="), data.hex(), data.hex().upper()):
            assert "der" in kinds(f"see {shown} there")
        # A byte less, a byte more, a wrong inner length: no key any more.
        for broken in (data[:-1], data + b"\0", data[:5] + bytes([data[5] ^ 1]) + data[6:]):
            assert "der" not in kinds(b64(broken))
    assert kinds(b64(openssh())) == ["openssh"] and kinds(b64(openssh()[:-3])) == []
    assert kinds(b64(bytes(range(200)))) == []


def test_key_blocks():
    body = "\n".join(b64(RSA)[i : i + 64] for i in range(0, len(b64(RSA)), 64))
    block = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    text = f"x {block} y {b64(EC)}"
    assert spans_of(text)[0] == ("pem", 2, 2 + len(block)) and kinds(text) == ["pem", "der"]
    assert kinds(block.replace("\n", "\\n")) == ["pem"]
    assert kinds("-----BEGIN RSA PRIVATE KEY-----\nnot a key\n-----END RSA PRIVATE KEY-----") == []
    assert kinds("-----BEGIN RSA PRIVATE KEY-----") == []


def test_signed_tokens():
    good = token(b'{"alg":"HS256","typ":"JWT"}', b'{"sub":"1"}', bytes(32))
    assert kinds(f"Bearer {good}.") == ["jwt"]
    for header, claims, signature in (
        (b'{"typ":"JWT"}', b'{"a":1}', bytes(32)), (b'{"alg":"HS256"}', b"[1]", bytes(32)),
        (b'{"alg":"HS256"}', b'{"a":1}', bytes(31)), (b'{"alg":"none"}', b'{"a":1}', b"")):
        assert kinds(token(header, claims, signature)) == []
    assert kinds(token(b'{"alg":"RS256"}', b'{"a":1}', bytes(256))) == ["jwt"]
    assert json.loads(b'{"alg":"HS256"}')["alg"] == "HS256"


def test_odd_documents(spark, odd, empty):
    rows = scan_secrets(odd).collect()
    assert len(rows) == odd.count() and all(r.spans == [] for r in rows)
    assert scan_secrets(empty).count() == 0
    text = "z" * 200000 + " token=12345678 " + "A" * 200000
    assert spans_of(text) == [("assign", 200001, 200015)] and list(KINDS)[0] == "assign"


def test_masking(docs_of):
    docs = docs_of("a token=12345678, b", None, "", "password: " + "ab" * 20)
    masked = [r.text for r in docs.select(mask_secrets("text").alias("text")).collect()]
    assert masked == ["a <assign>, b", None, "", "<assign>"]


def test_many_marks_take_linear_time():
    mark, end = "-----BEGIN RSA PRIVATE KEY-----\n", "-----END RSA PRIVATE KEY-----\n"
    begun = time.perf_counter()
    for text in (mark * 600_000, mark * 600_000 + end, (mark + "x" * 30) * 300_000 + end, "-----BEGIN " + "A " * 5_000_000):
        assert not [s for s in spans_of(text) if s[0] == "pem"]
    assert time.perf_counter() - begun < 60


def test_wider_encodings():
    def part(value):
        return base64.urlsafe_b64encode(value).decode().rstrip("=")

    token = f"{part(b'{\"alg\":\"HS256\"}')}.{part(b'{}')}.{part(bytes(32))}"
    assert ".e30." in token and ("jwt", 4, 4 + len(token)) in spans_of(f"see {token}.")
    # A token behind a part that looks like a beginning.
    assert ("jwt", 3, 3 + len(token)) in spans_of(f"ew.{token}")
    # A key of many parts, in hexadecimal digits of both cases.
    names = b"".join(b"\x02\x01\x05" for _ in range(100))
    inner = b"\x06\x01\x2a\x30\x82" + len(names).to_bytes(2, "big") + names
    body = b"\x02\x01\x00\x30\x82" + len(inner).to_bytes(2, "big") + inner + b"\x04\x20" + bytes(range(100, 132))
    key = b"\x30\x82" + len(body).to_bytes(2, "big") + body
    told = key.hex()
    mixed = "".join(c.upper() if i % 2 else c for i, c in enumerate(told))
    for text in (told, told.upper(), mixed):
        assert ("der", 2, 2 + len(told)) in spans_of(f"x {text} y")
    assert ("der", 0, len(base64.b64encode(key).rstrip(b"="))) in [(k, s, e - text.count("=")) for text in [base64.b64encode(key).decode()] for k, s, e in spans_of(text)]
