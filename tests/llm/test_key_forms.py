"""Every form in which a private key or a signed token is written."""

import base64
import json
import textwrap

import pytest

from sidforge.llm import secrets


def der(tag, *parts):
    body = b"".join(parts)
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x82, size >> 8, size & 255])
    return bytes([tag]) + head + body


RSA = der(0x30, *(der(2, bytes([1 + i] * (1 if i == 0 else 120))) for i in range(9)))
RSA = der(0x30, der(2, b"\0"), RSA[RSA.index(b"\x02\x78") :])
OID_RSA = der(6, bytes.fromhex("2a864886f70d010101"))
PKCS8 = der(0x30, der(2, b"\0"), der(0x30, OID_RSA, der(5)), der(4, RSA))
ENCRYPTED = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")), der(0x30, der(4, b"salt1234"), der(2, b"\x08\0"))), der(4, bytes(range(256)) * 2))
DIGEST = der(0x30, der(0x30, der(6, bytes.fromhex("608648016503040201")), der(5)), der(4, b"\x07" * 32))


def lines(data, alphabet=base64.b64encode):
    return textwrap.wrap(alphabet(data).decode(), 64)


def keys(text):
    return [text[a:b] for kind, a, b in secrets.find_spans(text) if kind == "key"]


@pytest.mark.parametrize("data", [RSA, PKCS8, ENCRYPTED])
@pytest.mark.parametrize("alphabet", [base64.b64encode, base64.urlsafe_b64encode])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\\n", "\\r\\n", "\n    ", "\n\t"])
def test_lines(data, alphabet, end):
    body = end.join(lines(data, alphabet))
    for wrapped in (body, f"-----BEGIN PRIVATE KEY-----{end}{body}{end}-----END PRIVATE KEY-----{end}", f"k = {body} and more"):
        assert [k.rstrip("=") for k in keys(f"some text {wrapped}")] == [body.rstrip("=")]


def test_json_key_file():
    pem = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(lines(PKCS8)) + "\n-----END PRIVATE KEY-----\n"
    text = json.dumps({"type": "service_account", "private_key": pem, "client": "x@y"})
    assert [k.replace("\\n", "").rstrip("=") for k in keys(text)] == [base64.b64encode(PKCS8).decode().rstrip("=")]
    assert "MII" not in secrets.redact(text, secrets.find_spans(text))


def test_no_key():
    assert keys(base64.b64encode(DIGEST).decode()) == []
    assert keys(base64.b64encode(PKCS8[:-1]).decode()) == []
    assert keys("M" + "A" * 60 + "\n" + "-" * 30) == []


@pytest.mark.parametrize("header", ['{"alg":"HS256"}', '{ "alg": "none" }', '{\n  "alg": "RS256"\n}', '{\r\n"alg":"x"}', '{\t"alg":"x"}'])
def test_tokens(header):
    def part(text):
        return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")

    token = f"{part(header)}.{part('{}')}.c2ln"
    text = f"Bearer {token}, then"
    assert [(k, text[a:b]) for k, a, b in secrets.find_spans(text) if k == "jwt"] == [("jwt", token)]
    plain = f"{part(header.replace('alg', 'typ'))}.{part('{}')}.c2ln"
    assert [s for s in secrets.find_spans(plain) if s[0] == "jwt"] == []


def test_bulk_filter_lets_every_form_through(spark):
    texts = [end.join(lines(d, a)) for d in (RSA, PKCS8, ENCRYPTED) for a in (base64.b64encode, base64.urlsafe_b64encode) for end in ("\n", "\\n")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = secrets.span_columns(secrets.scan(docs, ["doc_id"]), ["doc_id"]).collect()
    assert all("key:" in r.spans for r in found)
