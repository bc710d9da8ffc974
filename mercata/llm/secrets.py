"""Secret scan with structural confirmation.

Patterns alone report three kinds: assignments (``assign``), access key ids
(``access``) and long hexadecimal runs (``hex``). The rest of the kinds must
prove their structure before they are reported:

* ``pem``: a private-key block, its body decoded from base64; a DER body must
  be one of the key encodings below, an OpenSSH body its length-prefixed
  fields; an encrypted legacy body must fill whole cipher blocks;
* ``key``: a base64 or hexadecimal run that decodes to a private key: DER
  whose nested lengths fill the run exactly and whose fields are those of
  PKCS#1, PKCS#8 (plain or encrypted), SEC 1 or DSA, or the OpenSSH format;
* ``signed``: a signed token: the header decodes to a JSON object with an
  algorithm, the payload decodes, and the signature has that algorithm's
  length (or the five parts of an encrypted token with their sizes);
* ``nested``: a base64 or hexadecimal run that decodes to text which itself
  holds one of the above, an access key id or an assignment.

Texts are scanned whole, once, in Arrow batches; a candidate is decoded as a
whole, so the work grows with the text's length.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mercata.llm.streams import emit

Span = tuple[str, int, int]

#: Order in which kinds are listed at one start.
KINDS = ("assign", "access", "hex", "pem", "key", "signed", "nested")
BASE = KINDS[:3]
MOST_NESTED = 4  # runs inside runs; deeper ones are not opened

# Case counts in the rest; letters of the names are ASCII letters in either case.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
# A run's greedy match starts at its first character, so the least length may stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8

_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*?PRIVATE KEY(?: BLOCK)?)-----((?:[A-Za-z0-9+/=\s:,.()]++|-(?!----))*+)-----END \1-----", re.ASCII)
_RUN64 = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
_RUN16 = re.compile(r"(?:[0-9a-f]{2}){24,}|(?:[0-9A-F]{2}){24,}")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]*){2,4}(?![A-Za-z0-9_-])")


# ---------------------------------------------------------------- decoding

def from_base64(run: str) -> bytes | None:
    """Standard or URL-safe base64, padded or not; None if it is neither, or mixes both."""
    body = run.rstrip("=")
    if len(body) % 4 == 1 or (("-" in body or "_" in body) and ("+" in body or "/" in body)):
        return None
    if len(run) != len(body) and len(run) % 4:
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


# ---------------------------------------------------------------- key encodings

def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of DER values that fill ``data`` exactly; None if lengths do not nest or are not minimal."""
    out, at, end = [], 0, len(data)
    while at < end:
        if end - at < 2:
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if tag & 0x1F == 0x1F:  # no key encoding has long tags
            return None
        if length & 0x80:
            width = length & 0x7F
            if not 1 <= width <= 4 or end - at < width or data[at] == 0:
                return None
            length = int.from_bytes(data[at: at + width])
            if length < 0x80:
                return None
            at += width
        if length > end - at:
            return None
        out.append((tag, data[at: at + length]))
        at += length
    return out


INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def _tags(items: list[tuple[int, bytes]] | None) -> list[int]:
    return [t for t, _ in items] if items else []


def _oid(content: bytes) -> bool:
    return bool(content) and not content[-1] & 0x80


def private_key(data: bytes) -> str | None:
    """The private-key encoding of ``data``, if it is one: its fields are there and its lengths nest."""
    if data.startswith(b"openssh-key-v1\0"):
        return "openssh" if _openssh(data[15:]) else None
    if data[:1] != b"\x30":
        return None
    whole = der_items(data)
    if not whole or len(whole) != 1:
        return None
    fields = der_items(whole[0][1])
    if fields is None:
        return None
    tags = _tags(fields)
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and fields[0][1] in (b"\0", b"\1"):
        algorithm = der_items(fields[1][1])
        inside = algorithm and algorithm[0][0] == OID and _oid(algorithm[0][1]) and fields[2][1]
        return "pkcs8" if inside and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]) else None
    if tags == [SEQUENCE, OCTETS]:  # an encrypted key: its algorithm's name, and whole blocks
        algorithm = der_items(fields[0][1])
        return "pkcs8-encrypted" if algorithm and algorithm[0][0] == OID and _oid(algorithm[0][1]) and len(fields[1][1]) >= 16 \
            and len(fields[1][1]) % 8 == 0 else None
    if tags[:2] == [INTEGER, OCTETS] and fields[0][1] == b"\1":
        return "sec1" if 16 <= len(fields[1][1]) <= 72 and all(t in (0xA0, 0xA1) for t in tags[2:]) else None
    numbers = [int.from_bytes(v) for t, v in fields if t == INTEGER]
    if len(numbers) == len(fields) == 9 and numbers[0] == 0:
        return "pkcs1" if numbers[1] == numbers[4] * numbers[5] and numbers[1] > 0 else None  # n = p q
    if len(numbers) == len(fields) == 6 and numbers[0] == 0:
        _, p, q, g, y, x = numbers
        return "dsa" if 1 < g < p and 0 < x < q and (p - 1) % q == 0 and pow(g, x, p) == y else None
    return None


def _openssh(data: bytes) -> bool:
    """cipher, kdf, options, number of keys, public keys, private part: each its length and its bytes, to the end."""
    at = 0

    def take() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at: at + 4])
        if len(data) - at < 4 or n > len(data) - at - 4:
            return None
        at += 4 + n
        return data[at - n: at]

    cipher, kdf, options = take(), take(), take()
    if not cipher or not kdf or options is None:
        return False
    keys = int.from_bytes(data[at: at + 4])
    at += 4
    if not 1 <= keys <= len(data) // 4:
        return False
    for _ in range(keys):
        if not take():
            return False
    return bool(take()) and at == len(data)


# ---------------------------------------------------------------- signed tokens

#: Signature bytes by algorithm (RFC 7518, RFC 8037); RSA signatures are as long as their modulus.
_SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": (64, 114), "none": 0}
_RSA = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")


def signed_token(run: str) -> str | None:
    """``jws`` or ``jwe`` if the parts of a dotted run are a token's."""
    parts = run.split(".")
    if len(parts) not in (3, 5) or "=" in run:
        return None
    data = [from_base64(p) for p in parts]
    if any(d is None for d in data):
        return None
    try:
        header = json.loads(data[0])
    except (ValueError, RecursionError):
        return None
    if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
        return None
    alg = header["alg"]
    if len(parts) == 5:  # an encrypted token: an initialisation vector, a text, an authentication tag
        return "jwe" if isinstance(header.get("enc"), str) and len(data[2]) in (12, 16) and data[3] and len(data[4]) in (16, 24, 32) else None
    size = len(data[2])
    if alg in _RSA:
        fits = size >= 128 and size % 8 == 0
    else:
        want = _SIGNATURE.get(alg)
        fits = size in want if isinstance(want, tuple) else size == want
    return "jws" if fits and (data[1] or header.get("b64") is False) else None


# ---------------------------------------------------------------- scanning

def base_spans(text: str) -> list[Span]:
    """Spans of the three plain kinds, (kind, start, end) in code points."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def _pem_body(label: str, body: str) -> bool:
    head, blank, rest = body.partition("\n\n")
    encrypted = blank and "ENCRYPTED" in head  # legacy encryption leaves no structure but whole blocks
    data = from_base64(re.sub(r"\s", "", rest if blank and ":" in head else body))
    if not data:
        return False
    if label.endswith("BLOCK"):  # an OpenPGP block: a packet header of a secret key
        return bool(data[0] & 0x80) and ((data[0] & 0x3F) if data[0] & 0x40 else (data[0] >> 2) & 0xF) in (5, 7)
    return len(data) % 8 == 0 if encrypted else private_key(data) is not None


def confirmed_spans(text: str, depth: int = 0) -> list[Span]:
    """Spans whose structure proves a key or a token; inner runs of a reported block are not reported again."""
    out: list[Span] = []
    if "-----BEGIN " in text:
        out += [("pem", *m.span()) for m in _PEM.finditer(text) if _pem_body(m[1], m[2])]
    if "." in text:
        for m in _DOTTED.finditer(text):
            run = m[0]
            if not signed_token(run) and run.endswith("."):
                run = run[:-1]  # the stop of a sentence; an unsigned token ends in one of its own
            if signed_token(run):
                out.append(("signed", m.start(), m.start() + len(run)))
    covered = sorted((s, e) for _, s, e in out)
    runs = [(m.span(), bytes.fromhex(m[0])) for m in _RUN16.finditer(text)]
    taken = {span for span, _ in runs}
    runs += [(m.span(), from_base64(m[0])) for m in _RUN64.finditer(text) if m.span() not in taken]
    for (start, end), data in runs:
        if not data or any(s <= start and end <= e for s, e in covered):
            continue
        if private_key(data):
            out.append(("key", start, end))
        elif depth < MOST_NESTED and _holds_secret(data, depth + 1):
            out.append(("nested", start, end))
    return out


def _holds_secret(data: bytes, depth: int) -> bool:
    if not data.translate(None, _PRINTABLE) == b"":
        return False
    text = data.decode("ascii")
    return any(k != "hex" for k, _, _ in base_spans(text)) or bool(confirmed_spans(text, depth))


_PRINTABLE = bytes([9, 10, 13, *range(32, 127)])


def scan_text(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans), each by start, then kind in ``KINDS`` order."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = base_spans(text)
    return sorted(base, key=order), sorted({*base, *confirmed_spans(text)}, key=order)


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, base, spans): the secrets in every whole text, as arrays of (kind, start, end).

    Offsets count code points, the end is exclusive. ``base`` are the plain
    kinds, ``spans`` these and the confirmed ones. A null or empty text has
    none; long texts are scanned whole; repeated rows get a row each; an empty
    table gives none. Only the two columns are read, so other columns may have
    any name.
    """
    kind = docs.select(key).schema.fields[0].dataType
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("key", to_arrow_type(kind)), ("base", span), ("spans", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]

        def found():
            for b in batches:
                for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                    base, spans = scan_text(t.as_py() or "")
                    yield k, as_rows(base), as_rows(spans)
        yield from emit(found(), schema)

    one = "array<struct<kind string, start long, end long>>"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind.simpleString()}, base {one}, spans {one}").withColumnRenamed("key", key)
