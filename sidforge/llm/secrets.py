"""Secret scan with structural confirmation.

Three plain patterns are always reported (``assign``, ``access``, ``hex``). Base64 and hex
candidates are decoded as well and reported only when their structure holds:

* ``jwt``: a signed token, whose header decodes to a JSON object that names its ``alg`` and
  whose payload decodes to a JSON object;
* ``key``: a private key, either DER (PKCS#1, PKCS#8 or SEC1: a SEQUENCE whose nested
  lengths fill it exactly and whose first fields are those of the format; an encrypted PKCS#8
  key names its encryption there), in plain or URL-safe base64, over several lines too, which
  may be indented or end in escapes, or in hex; or an OpenSSH key, whose length-prefixed
  fields must add up.

Spans count code points, the end is exclusive. Null and empty texts have no spans; repeated
rows are scanned each. A redacted text puts REDACTED in place of each run of overlapping
spans.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidforge.llm.common import schema_of, text_groups

KINDS = ("assign", "access", "hex", "jwt", "key")
BASE_KINDS = KINDS[:3]
REDACTED = "[SECRET]"

# The three plain patterns and the least lengths of their matches.
_ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

# A JSON object starts with a brace and a quote or blank (ey) or another white space (ew).
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])((?:ey|ew[o0k])[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]*")
# DER starts with the byte 0x30, which base64 writes as M and a letter up to P. Lines may end in
# escapes, as in JSON, and be indented; letters are those of plain or URL-safe base64.
_KEY64 = re.compile(
    r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n))(?:M[A-P]|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/_-]{22,}"
    r"(?:(?:\r?\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9+/_-]+)*={0,2}"
)
_LETTER64 = re.compile(r"\\[rn]|[A-Za-z0-9+/_-]")
_PLAIN64 = str.maketrans("-_", "+/")
_KEY16 = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{46,}")
# Texts without any of these hold no span; checked in bulk before the patterns above.
_HINT = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
    r"|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(ey|ew[o0k])[A-Za-z0-9_-]{5}|M[A-P][A-Za-z0-9+/_-]{22}|b3BlbnNzaC1rZXktdjE"
    r"|30[0-9A-Fa-f]{46}"
)
_SSH_MAGIC = b"openssh-key-v1\0"
_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30
# How the identifiers of password-based encryption begin (PKCS#5 and PKCS#12).
_ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _header(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the element's content, None if it does not fit."""
    if at + 2 > end:
        return None
    tag, size, start = data[at], data[at + 1], at + 2
    if size & 0x80:
        more = size & 0x7F
        if not 1 <= more <= 4 or start + more > end:
            return None
        size = int.from_bytes(data[start : start + more], "big")
        start += more
    return (tag, start, start + size) if start + size <= end else None


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill ``start..end`` exactly, nested ones checked as well."""
    top: list[tuple[int, int, int]] = []
    todo = [(start, end, top)]
    while todo:
        at, stop, found = todo.pop()
        while at < stop:
            element = _header(data, at, stop)
            if element is None:
                return None
            found.append(element)
            if element[0] & 0x20:
                todo.append((element[1], element[2], []))
            at = element[2]
    return top


def der_key_size(data: bytes) -> int:
    """Bytes of the private key in DER that ``data`` starts with, 0 if there is none."""
    whole = _header(data, 0, len(data))
    if whole is None or whole[0] != _SEQUENCE:
        return 0
    fields = _children(data, whole[1], whole[2])
    if fields and [f[0] for f in fields] == [_SEQUENCE, _OCTETS]:
        scheme = _header(data, fields[0][1], fields[0][2])
        named = scheme is not None and scheme[0] == _OID and data[scheme[1] : scheme[2]].startswith(_ENCRYPTION)
        return whole[2] if named else 0
    if not fields or fields[0][0] != _INTEGER or len(fields) < 3:
        return 0
    version = int.from_bytes(data[fields[0][1] : fields[0][2]], "big")
    tags = [f[0] for f in fields]
    rsa = version in (0, 1) and len(tags) >= 6 and all(t == _INTEGER for t in tags[:6])
    inner = data[fields[1][1] : fields[1][1] + 1]
    pkcs8 = version in (0, 1) and tags[1:3] == [_SEQUENCE, _OCTETS] and inner == bytes([_OID])
    sec1 = version == 1 and tags[1] == _OCTETS and tags[2] in (0xA0, 0xA1)
    return whole[2] if rsa or pkcs8 or sec1 else 0


def ssh_key_size(data: bytes) -> int:
    """Bytes of the OpenSSH private key that ``data`` starts with, 0 if there is none."""
    if not data.startswith(_SSH_MAGIC):
        return 0

    def number(at: int) -> int:
        return int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else len(data)

    at = len(_SSH_MAGIC)
    for _ in range(3):  # cipher, key derivation, its options
        at += 4 + number(at)
    keys = number(at) if at < len(data) else 0
    at += 4
    if not 1 <= keys <= 64:
        return 0
    for _ in range(keys + 1):  # public keys, the private part
        at += 4 + number(at)
    return at if at <= len(data) else 0


def _json_object(part: str) -> dict | None:
    try:
        value = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _token_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _TOKEN.finditer(text):
        header = _json_object(m.group(1))
        if header and isinstance(header.get("alg"), str) and _json_object(m.group(2)) is not None:
            yield "jwt", m.start(), m.end()


def _key_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _KEY64.finditer(text):
        letters = [x for x in _LETTER64.finditer(text, m.start(), m.end()) if len(x.group()) == 1]
        places = [x.start() for x in letters]
        body = "".join(x.group() for x in letters).translate(_PLAIN64)
        body = body[: len(body) - (len(body) % 4 == 1)]
        data = base64.b64decode(body + "=" * (-len(body) % 4))
        size = der_key_size(data) or ssh_key_size(data)
        if size:
            last = -(-size * 8 // 6) - 1  # the letter that holds the last bit
            whole = last == len(places) - 1
            yield "key", m.start(), m.end() if whole else places[last] + 1
    for m in _KEY16.finditer(text):
        digits = m.group()
        size = der_key_size(bytes.fromhex(digits[: len(digits) // 2 * 2]))
        if size:
            yield "key", m.start(), m.start() + 2 * size


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of KINDS."""
    spans = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    for kind, pattern, least in (("access", _ACCESS, ACCESS_LEAST), ("hex", _HEX, HEX_LEAST)):
        spans += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end() - m.start() >= least]
    spans += _token_spans(text)
    spans += _key_spans(text)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def spans_of(texts: pa.Array) -> list[list[tuple[str, int, int]]]:
    """The spans of each text of a column."""
    hints = pc.fill_null(pc.match_substring_regex(texts, _HINT), False).to_pylist()
    return [find_spans(texts[i].as_py()) if hint else [] for i, hint in enumerate(hints)]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each run of overlapping spans replaced."""
    out, done = [], 0
    for _, start, end in spans:
        if start >= done:
            out += [text[done:start], REDACTED]
        done = max(done, end)
    return "".join([*out, text[done:]])


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with ``found``, an array of (kind, start_at, end_at)."""
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start_at", pa.int64()), ("end_at", pa.int64())]))

    def find(batches):
        for part in text_groups(batches):
            rows = [
                [{"kind": k, "start_at": a, "end_at": b} for k, a, b in spans]
                for spans in spans_of(part.column("text"))
            ]
            columns = [part.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, struct)], names=[*keep, "found"])

    kept = schema_of(docs.select(*keep))
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    return rows.mapInArrow(find, f"{kept}, found array<struct<kind:string,start_at:bigint,end_at:bigint>>")


def span_columns(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """Counts, digest and text form of ``found``."""
    def shown(base: bool):
        chosen = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS)) if base else F.col("found")
        lines = F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start_at"], s["end_at"]))
        return F.array_join(lines, ",")

    def number(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [number(k) for k in BASE_KINDS]
    return scanned.select(*keep, *counts, F.sha2(shown(True), 256).alias("base_sha256"), shown(False).alias("spans"))


def redact_documents(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; texts with secrets lose them, and ``n_chars``,
    if there is one, follows."""
    columns = docs.columns
    schema = docs.schema

    def clean(batches):
        for part in text_groups(batches):
            texts = part.column("text")
            found = spans_of(texts)
            changed = [redact(t.as_py(), s) if s else t.as_py() for t, s in zip(texts, found)]
            arrays = []
            for name, column in zip(columns, part.columns):
                if name == "text":
                    column = pa.array(changed, column.type)
                elif name == "n_chars":
                    counts = [len(t) if s else n for t, s, n in zip(changed, found, column.to_pylist())]
                    column = pa.array(counts, column.type)
                arrays.append(column)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return docs.mapInArrow(clean, schema)


def digest(spans: list[tuple[str, int, int]]) -> str:
    """What ``base_sha256`` holds, for checks."""
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in BASE_KINDS)
    return hashlib.sha256(base.encode()).hexdigest()
