"""Secret scans with structural confirmation.

Three patterns give the base findings: assignments of a value to a telling name, access key ids, and long hex numbers. Beside
them, candidates in base64 or hex are decoded and reported only where the decoded bytes have the structure of a secret:

* `jwt`: a signed token, of which the header and the claims are JSON objects, the header names an algorithm, and the
  signature isn't empty.
* `pem`: an armoured private key whose body decodes to a key encoding (or is an encrypted legacy body, whose
  length is a multiple of the cipher's block).
* `key`: a key encoding without armour: DER of RSA, DSA, elliptic-curve, PKCS #8 and encrypted PKCS #8 keys, every nested
  length of which fits, or the OpenSSH format, whose fields fill it exactly; and base64 or hex of a text that holds one of the
  kinds above, to a depth of NESTED.

Public keys and certificates aren't secrets. A candidate is a maximal run of its alphabet, decoded from its first character.
Everything is a linear pass over a document's bytes inside one task; nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textio import flat, free, map_text

#: Base kinds first: the order of spans that start at one place.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key")
BASE = KINDS[:3]
#: How often a decoded text is searched again.
NESTED = 2

# The patterns of the base kinds, the first on text whose A-Z are lower-cased.
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")

_TOKEN = re.compile(rb"(?<![A-Za-z0-9_-])(e[A-Za-z0-9_-]{9,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]{16,})(?![A-Za-z0-9_-])")
_ARMOUR = re.compile(rb"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_HEADER = re.compile(rb"^[A-Za-z-]+: .*$", re.MULTILINE)
#: A run that can be base64 or hex of a key: no key encoding has fewer characters.
_RUN = re.compile(rb"[A-Za-z0-9+/_-]{56,}={0,2}")
_ALL_HEX = re.compile(rb"[0-9a-f]+|[0-9A-F]+")
_URLSAFE = bytes.maketrans(b"-_", b"+/")

_SEQUENCE, _INTEGER, _BITS, _OCTETS, _OID = 0x30, 0x02, 0x03, 0x04, 0x06


def unbase64(raw: bytes) -> bytes | None:
    """The bytes behind base64 of either alphabet, padded or not; None where it isn't any."""
    body = raw.rstrip(b"=").translate(_URLSAFE)
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + b"=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def fields(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values that fill data[at:end] exactly; None where lengths don't fit or aren't minimal."""
    out = []
    while at < end:
        if end - at < 2 or data[at] & 0x1F == 0x1F:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80 or size >> (8 * (n - 1)) == 0:
                return None
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def _algorithm(data: bytes, value: tuple[int, int, int]) -> bytes | None:
    """The object id at the head of an algorithm's sequence."""
    inner = fields(data, *value[1:]) if value[0] == _SEQUENCE else None
    return data[inner[0][1] : inner[0][2]] if inner and inner[0][0] == _OID and inner[0][1] < inner[0][2] else None


def der_key(data: bytes) -> str | None:
    """Which private key a DER value is; None where it is none."""
    outer = fields(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return None
    parts = fields(data, *outer[0][1:])
    if not parts:
        return None
    tags = [p[0] for p in parts]
    if tags == [_SEQUENCE, _OCTETS]:  # an algorithm for encryption by a password, and what it encrypts
        oid = _algorithm(data, parts[0])
        return "pkcs8-encrypted" if oid and oid.startswith(bytes.fromhex("2a864886f70d01")) and parts[1][2] - parts[1][1] >= 16 else None
    if tags[0] != _INTEGER or parts[0][2] - parts[0][1] != 1:
        return None
    version = data[parts[0][1]]
    long = [p[2] - p[1] for p in parts]
    if version <= 1 and len(tags) >= 9 and set(tags[:9]) == {_INTEGER} and set(tags[9:]) <= {_SEQUENCE} and long[1] >= 64 and 4 * long[3] >= long[1]:
        return "rsa"
    if version == 0 and tags == [_INTEGER] * 6 and long[1] >= 64:
        return "dsa"
    if version <= 1 and len(tags) >= 3 and tags[1:3] == [_SEQUENCE, _OCTETS] and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
        return "pkcs8" if _algorithm(data, parts[1]) and long[2] >= 16 else None
    if version == 1 and len(tags) >= 2 and tags[1] == _OCTETS and long[1] in (28, 32, 48, 66) and set(tags[2:]) <= {0xA0, 0xA1}:
        return "ec" if all(fields(data, *p[1:]) for p in parts[2:]) else None
    return None


def openssh_key(data: bytes) -> bool:
    """Whether the bytes are a key in OpenSSH's format: cipher, derivation and its options, as many public keys as it
    says, and the private part, each after its length."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        out = data[at + 4 : at + 4 + size]
        at += 4 + size
        return out if len(out) == size else None

    if not field() or not field() or field() is None or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 16 and all(field() for _ in range(keys)) and bool(field()) and at == len(data)


def _object(raw: bytes) -> dict | None:
    data = unbase64(raw)
    if data is None:
        return None
    try:
        value = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _tokens(raw: bytes) -> list[tuple[int, int, str]]:
    out = []
    for m in _TOKEN.finditer(raw):
        head = _object(m[1])
        if head and isinstance(head.get("alg"), str) and head["alg"].lower() != "none" and _object(m[2]) is not None and unbase64(m[3]):
            out.append((m.start(), m.end(), head["alg"]))
    return out


def _armoured(raw: bytes) -> list[tuple[int, int, str]]:
    out, at, open_ = [], 0, set()
    while m := _ARMOUR.search(raw, at):
        at = m.end()
        last = b"-----END " + m[1] + b"-----"
        end = -1 if last in open_ else raw.find(last, at)
        if end < 0:
            open_.add(last)  # nor is there one further on
            continue
        if raw.find(b"-----BEGIN ", at, end) >= 0:  # the end of another
            continue
        body = raw[m.end() : end].replace(b"\\n", b"\n").replace(b"\\r", b"")
        head = _HEADER.findall(body)
        data = unbase64(b"".join(_HEADER.sub(b"", body).split()))
        what = None
        if data:
            what = der_key(data) or ("openssh" if openssh_key(data) else None)
            if not what and any(b"ENCRYPTED" in h for h in head) and len(data) % 8 == 0:
                what = "encrypted"
        if what:
            out.append((m.start(), end + len(last), what))
            at = end + len(last)
    return out


def structure(data: bytes, depth: int) -> str | None:
    """What decoded bytes are: a key, or a text with a key or token in it."""
    what = der_key(data) or ("openssh" if openssh_key(data) else None)
    if what or depth <= 0 or not data.isascii():
        return what
    inner = confirmed(data, depth - 1)
    return f"{inner[0][0]}({inner[0][3]})" if inner else None


def confirmed(raw: bytes, depth: int = NESTED) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, structure) of what decodes to a secret; bytes, by start. Runs inside a token or armour are part of it."""
    out = [("jwt", *x) for x in _tokens(raw)] if b"." in raw else []
    if b"PRIVATE KEY-----" in raw:
        out += [("pem", *x) for x in _armoured(raw)]
    inside = sorted((s, e) for _, s, e, _ in out)
    k = 0
    for m in _RUN.finditer(raw):
        while k < len(inside) and inside[k][1] <= m.start():
            k += 1
        if k < len(inside) and inside[k][0] < m.end():
            continue
        run = m[0]
        data = bytes.fromhex(run.decode()) if _ALL_HEX.fullmatch(run) and len(run) % 2 == 0 else unbase64(run)
        if data and (what := structure(data, depth)):
            out.append(("key", m.start(), m.end(), what))
    return sorted(out, key=lambda x: x[1:3])


def base(raw: bytes) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, "") of the three patterns, leftmost and without overlaps within a kind; bytes."""
    out = [("assign", m.start(), m.end(), "") for m in _ASSIGN.finditer(raw.lower()) if m.end(1) - m.start(1) >= 6]
    out += [("access", m.start(), m.end(), "") for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end(), "") for m in _HEX.finditer(raw)]


def findings(raw: bytes) -> list[tuple[str, int, int, str]]:
    """All findings of a text, by start and then kind; places in code points, ends exclusive."""
    found = sorted(base(raw) + confirmed(raw), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    if not found or raw.isascii():
        return found
    place = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=place[1:])
    return [(kind, int(place[s]), int(place[e]), what) for kind, s, e, what in found]


def scan(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `secrets`, an array of (kind, start, end, structure), to each row.

    Places are code points of the whole text, ends exclusive; base kinds have an empty structure. A null or empty text has none.
    Rows are worked on by themselves: repeated rows and ids find alike, an empty table stays empty. The columns `keep` (default: all but
    the text) are carried, of any names; where one is named `secrets`, the added one gets an underscore before its name.
    """

    def make():
        def run(part: pa.RecordBatch) -> list[pa.Array]:
            data, at = flat(part.column("body"))
            whole = data.tobytes()
            kinds, starts, ends, whats, first = [], [], [], [], [0]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                for kind, s, e, what in findings(whole[a:b]):
                    kinds.append(kind)
                    starts.append(s)
                    ends.append(e)
                    whats.append(what)
                first.append(len(kinds))
            rows = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(whats, pa.string())], names=["kind", "start", "end", "structure"])
            return [pa.ListArray.from_arrays(pa.array(first, pa.int32()), rows)]

        return run

    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    return map_text(docs, text_col, keep, "secrets array<struct<kind:string,start:int,end:int,structure:string>>", make)


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of docs with every finding in their text replaced by its kind in brackets; findings that overlap are one,
    named by the first. A null text stays null. Columns, of any names, and rows stay as they are otherwise."""

    def make():
        def run(part: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for text in part.column("body").to_pylist():
                if text:
                    done, pieces = 0, []
                    for kind, s, e, _ in findings(text.encode()):
                        if s >= done:
                            pieces += [text[done:s], f"[{kind}]"]
                        done = max(done, e)
                    text = "".join([*pieces, text[done:]])
                out.append(text)
            return [pa.array(out, pa.string())]

        return run

    new = free("redacted", docs.columns)
    out = map_text(docs, text_col, docs.columns, f"`{new}` string", make)
    return out.select(*[F.col(f"`{new}`").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    """All documents: counts of the base kinds, the digest of their spans, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = F.col("secrets")
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select(
        "doc_id", *[count(kind) for kind in BASE],
        F.sha2(_listed(F.filter(found, lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"), _listed(found).alias("spans"),
        F.array_join(F.transform(F.filter(found, lambda x: x["structure"] != ""), lambda x: x["structure"]), ",").alias("structures"),
    )
