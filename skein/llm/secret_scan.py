"""Secret scan with structural confirmation.

Candidates are cheap pattern hits; what only *looks* like a key (a base64 or hex run, a dotted token, a PEM block)
is decoded and its structure parsed before it is reported: DER tags with nested lengths, the OpenSSH container's
length-prefixed fields, the JSON header and payload of a signed token and the signature length its algorithm needs.
Keys in base64 count on one line, or wrapped over lines of one width with or without a heading.

Parsers look at a bounded depth of nesting and read each byte once; what a hostile text makes of lengths, tags, nested
brackets or odd types only fails the confirmation.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .shared import map_batches

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{16}")
#: Three dotted runs from the start of a run: each run is read thrice at most.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+))")
_PEM = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
#: Whole lines of base64, one or more of 40 characters at least and a last one; spaces or tabs may stand before each.
_WRAPPED = re.compile(r"(?m)^[ \t]*+[A-Za-z0-9+/]{40,}+\r?\n(?:[ \t]*+[A-Za-z0-9+/]++\r?\n)*+[ \t]*+[A-Za-z0-9+/]++={0,2}")
_B64 = re.compile(r"[A-Za-z0-9+/_-]{40,}+={0,2}")
_ANY_HEX = re.compile(r"(?:[0-9a-fA-F]{2}){32,}+")

#: Signature bytes by algorithm of a signed token (None: at least 128).
_SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64, "none": 0, "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None}
#: Object identifiers of key algorithms, as DER bytes: RSA, elliptic curves, keys that are so many octets
#: (X25519, X448, Ed25519, Ed448), keys that are one integer (DSA, Diffie-Hellman).
_RSA, _CURVE = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201")
_OCTETS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
_NUMBERS = {bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a864886f70d010301")}
#: Bytes of a block by the cipher that a sealed PEM block names.
_BLOCK = {"DES-CBC": 8, "DES-EDE3-CBC": 8, "AES-128-CBC": 16, "AES-192-CBC": 16, "AES-256-CBC": 16}


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value at ``at``; None where the length does not fit."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or at + width > end:
            return None
        size, at = int.from_bytes(data[at : at + width], "big"), at + width
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        if (x := _tlv(data, at, end)) is None:
            return None
        out.append(x)
        at = x[2]
    return out


def _integers(parts: list[tuple[int, int, int]] | None) -> bool:
    return bool(parts) and all(t == 0x02 for t, _, _ in parts)


def _key_inside(oid: bytes, data: bytes, at: int, end: int) -> bool:
    """The bytes are one value, of the form that the algorithm's keys have: RSA's integers, a curve's version and octets,
    octets of the stated length, an integer; for other algorithms a sequence of whole values."""
    top = _tlv(data, at, end)
    if top is None or top[2] != end:
        return False
    tag, size, parts = top[0], top[2] - top[1], _children(data, top[1], top[2]) if top[0] == 0x30 else None
    if oid == _RSA:
        return _integers(parts) and len(parts) == 9
    if oid == _CURVE:
        return bool(parts) and len(parts) >= 2 and parts[0][0] == 0x02 and parts[1][0] == 0x04 and 16 <= parts[1][2] - parts[1][1] <= 66
    if oid in _OCTETS:
        return tag == 0x04 and size == _OCTETS[oid]
    if oid in _NUMBERS:
        return tag == 0x02 and size >= 16
    return bool(parts)


def is_der_key(data: bytes) -> bool:
    """``data`` is one DER private key: PKCS#1, PKCS#8 (plain, with the key in it, or encrypted), SEC1 or DSA, with no byte left over."""
    top = _tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _children(data, top[1], top[2])
    if not parts:
        return False
    tags, first = [t for t, _, _ in parts], data[parts[0][1] : parts[0][2]]
    named = lambda p: data[x[0][1] : x[0][2]] if (x := _children(data, p[1], p[2])) and x[0][0] == 0x06 else None
    if tags[0] == 0x02 and len(first) == 1 and first[0] <= 1:
        if tags[1:] and all(t == 0x02 for t in tags[1:]) and len(tags) in (6, 9):
            return True
        if tags[1:3] == [0x30, 0x04]:
            return bool(oid := named(parts[1])) and _key_inside(oid, data, parts[2][1], parts[2][2])
        if first[0] == 1 and tags[1:2] == [0x04] and 16 <= parts[1][2] - parts[1][1] <= 66:
            return all(t in (0xA0, 0xA1) for t in tags[2:])
    return tags == [0x30, 0x04] and bool(named(parts[0])) and parts[1][2] - parts[1][1] >= 32


def is_ssh_key(data: bytes) -> bool:
    """``data`` is an OpenSSH private-key container: cipher, derivation, options, then 1..16 keys with a type name."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, fields = len(magic), []
    for _ in range(3):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    count = int.from_bytes(data[at : at + 4], "big")
    size = int.from_bytes(data[at + 4 : at + 8], "big")
    name = int.from_bytes(data[at + 8 : at + 12], "big")
    return bool(fields[0]) and 1 <= count <= 16 and at + 8 + size <= len(data) and 4 <= name <= 64 and data[at + 12 : at + 12 + name].isascii()


def _b64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(token: str) -> bool:
    """Three base64url parts: a JSON header that names a known algorithm, a JSON object, a signature of its length."""
    head, body, sign = token.split(".")
    raw = [_b64(head), _b64(body), _b64(sign) if sign else b""]
    if None in raw:
        return False
    try:
        header, claims = json.loads(raw[0]), json.loads(raw[1])
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(claims, dict) or not isinstance(header.get("alg"), str) or header["alg"] not in _SIGNATURE:
        return False
    want = _SIGNATURE[header["alg"]]
    return len(raw[2]) >= 128 if want is None else len(raw[2]) == want


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the three base kinds: leftmost non-overlapping matches of each, without those that are too short."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if _LONG_HEX.search(text):
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text) if m.end() - m.start() >= 16]
    return out


def _blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and body of the blocks from a BEGIN line to the first END line of its label, one after another."""
    marks = list(_PEM.finditer(text))
    after: list[re.Match | None] = [None] * len(marks)
    last: dict[str, re.Match] = {}
    for k in range(len(marks) - 1, -1, -1):  # the first END of each label behind each mark, from the end
        if marks[k][1] == "END":
            last[marks[k][2]] = marks[k]
        else:
            after[k] = last.get(marks[k][2])
    at = 0
    for m, close in zip(marks, after, strict=True):
        if close is not None and m.start() >= at:
            at = close.end()
            yield m.start(), at, text[m.end() : close.start()]


def _is_sealed(lines: list[str], size: int) -> bool:
    """The headings of a sealed block: encrypted, by a known cipher with a start value of its block; whole blocks follow."""
    heads = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}
    cipher, _, start = heads.get("DEK-Info", "").partition(",")
    block = _BLOCK.get(cipher.strip().upper())
    return "ENCRYPTED" in heads.get("Proc-Type", "") and block is not None and re.fullmatch(f"[0-9A-Fa-f]{{{2 * block}}}", start.strip()) is not None and size >= 2 * block and size % block == 0


def _is_pem_key(body: str) -> bool:
    lines = [x.strip() for x in body.replace("\\n", "\n").split("\n")]
    data = _b64("".join(x for x in lines if ":" not in x))
    return bool(data) and (is_der_key(data) or is_ssh_key(data) or _is_sealed(lines, len(data)))


def _wrapped(text: str) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and bytes of base64 that goes over lines of one width, the last of them no longer."""
    for m in _WRAPPED.finditer(text):
        at, rows = m.start(), []
        for line in m[0].split("\n"):
            rows.append((at + len(line) - len(line.lstrip(" \t")), line.strip(" \t\r")))
            at += len(line) + 1
        k = 0
        while k < len(rows):  # lines of one width and the shorter one behind them are one key
            n = k + 1
            while n < len(rows) and len(rows[n][1]) == len(rows[k][1]) and not rows[n - 1][1].endswith("="):
                n += 1
            if n < len(rows) and len(rows[n][1]) < len(rows[k][1]) and not rows[n - 1][1].endswith("="):
                n += 1
            if n > k + 1 and (data := _b64("".join(x for _, x in rows[k:n]))):
                yield rows[k][0], rows[n - 1][0] + len(rows[n - 1][1]), data
            k = n


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if data[0] == 0x30 and is_der_key(data) else "ssh" if is_ssh_key(data) else None


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans that the parsers above confirm."""
    out = []
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            if (at := m[1].find("eyJ")) >= 0 and is_signed_token(f"{m[1][at:]}.{m[2]}.{m[3]}"):
                out.append((m.start(1) + at, m.end(3), "jwt"))
    if "-----BEGIN " in text:
        out += [(a, b, "pem") for a, b, body in _blocks(text) if _is_pem_key(body)]
    found = [(a, b, kind) for a, b, data in _wrapped(text) if (kind := _key_kind(data))] if "\n" in text else []
    for pattern, decode in ((_B64, _b64), (_ANY_HEX, bytes.fromhex)):
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if (kind := _key_kind(decode(m[0])))]
    # of spans that overlap, the one that starts first, of those the longest; tokens and blocks come before both
    first, reach, k = sorted(out), -1, 0
    for start, end, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        while k < len(first) and first[k][0] <= start:
            reach, k = max(reach, first[k][1]), k + 1
        if start >= reach:
            reach = end
            out.append((start, end, kind))
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan_text(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans of a text; a null text is the empty text."""
    text = text or ""
    base = base_spans(text)
    return base, base + confirmed_spans(text)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: counts, digest and list of secret spans (code points, end exclusive).

    Returns the id, ``n_assign, n_access, n_hex, n_confirmed`` (long), ``base_sha256``, ``spans``. Map only: no
    shuffle, so hot sources and groups of copies cost what their bytes cost. A null or empty text gives zeros, the
    digest of the empty string and ``""``; a very long text costs its length; repeated rows give repeated results; an empty table gives no rows; further
    columns, whatever their names, are not read.
    """

    def make():
        def one(key, text):
            base, every = scan_text(text)
            kinds = [k for _, _, k in base]
            return (key, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), len(set(every)) - len(set(base)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every))

        return one

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string")
