"""Secret scan with structural confirmation.

Three base patterns find assigned credentials, access-key ids and long hex
strings.  The method then decodes base64 and hex candidates and reports one only
if what it decodes to has the structure of a secret:

* ``pem``: a PEM private-key block (line ends as such or escaped, header lines
  or none) whose body is DER with exactly nested lengths, the length-prefixed
  OpenSSH container, or whole cipher blocks under a ``DEK-Info`` header;
* ``der``: a base64 or hex run that decodes to such a key: PKCS#1, DSA, SEC1, or
  PKCS#8, whose octets must hold the key of its algorithm in turn, or name the
  password scheme, salt and rounds by which they are encrypted.  The run may be
  wrapped over lines, and the key may begin anywhere in it, as behind a path;
* ``jwt``: a signed token whose header is a JSON object that names ``alg``, whose
  claims are a JSON object, and whose signature has the length of that algorithm.

What decodes to text is searched in the same way, ``DEPTH`` times at most, and
the outer run is reported under the kind of what it holds.  Of nested spans of
the method the outermost is reported.

Nulls and empty texts have no spans; one row comes out for each row that goes in,
repeated rows and null ids included; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

KINDS = ("assign", "access", "hex", "pem", "der", "jwt")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([^-]*(?:-(?!----)[^-]*)*)-----END \1-----")
_DEK = re.compile(r"^DEK-Info:\s*([A-Z0-9-]+),([0-9A-Fa-f]+)\s*$", re.M)
#: Decodings within decodings.
DEPTH = 3
# Octets of signatures (least, most) by algorithm; object identifiers of key algorithms.
SIGNATURES = {
    "HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES256K": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114),
    "RS256": (128, 1024), "RS384": (128, 1024), "RS512": (128, 1024), "PS256": (128, 1024), "PS384": (128, 1024), "PS512": (128, 1024),
}
RSA, DSA, EC = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a8648ce3d0201")
EDWARDS = tuple(bytes.fromhex("2b65") + bytes([i]) for i in (0x6E, 0x6F, 0x70, 0x71))
#: Password schemes of encrypted PKCS#8 keys: the first also names a key derivation and a cipher.
PBES2 = bytes.fromhex("2a864886f70d01050d")
PBES1 = tuple(bytes.fromhex("2a864886f70d0105") + bytes([i]) for i in (1, 3, 4, 6, 10, 11)) + tuple(bytes.fromhex("2a864886f70d010c01") + bytes([i]) for i in range(1, 7))
DERIVATIONS = (bytes.fromhex("2a864886f70d01050c"), bytes.fromhex("2b06010401da47040b"))  # PBKDF2, scrypt
#: Least octets of an RSA modulus and of each of its primes.
MODULUS, PRIME = 60, 24
#: Where a base64 DER sequence can begin.
_SEQUENCE = re.compile("M[A-I]")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,100}[ \t]*\r?\n[ \t]*)+[A-Za-z0-9+/]{1,100}={0,2}")
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_HEX_BLOB = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){30,}(?![0-9A-Fa-f])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[w-z0-9_-][A-Za-z0-9_-]*)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string"
_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_assign", "n_access", "n_hex", "n_confirmed")), ("base_sha256", pa.string()), ("spans", pa.string())])


def decode_base64(text: str) -> bytes | None:
    """Bytes of a standard or URL-safe base64 string, padded or not; None if it isn't one."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first byte of the value, its end) of the DER element at ``at``."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        if size < 0x80:
            return None
        at += n
    return (tag, at, at + size) if at + size <= end else None


def der_elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Elements that fill data[at:end] exactly, or None."""
    found = []
    while at < end:
        one = _tlv(data, at, end)
        if one is None:
            return None
        found.append(one)
        at = one[2]
    return found


def is_der_key(data: bytes) -> bool:
    """Is it a private key: PKCS#1 / SEC1 / PKCS#8 (also encrypted) with exact nested lengths?"""
    outer = der_elements(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = der_elements(data, *outer[0][1:])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    inside = lambda p: der_elements(data, p[1], p[2])
    if tags[:2] == [0x30, 0x04] and len(tags) == 2:  # encrypted: algorithm, octets
        return parts[1][2] - parts[1][1] >= 16 and _is_password_scheme(data, inside(parts[0]))
    if tags[0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    version = data[parts[0][1]]
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:  # nine integers
        sizes = [p[2] - p[1] for p in parts]
        return version in (0, 1) and sizes[1] >= MODULUS and min(sizes[4:6]) >= PRIME
    if len(tags) == 6 and set(tags) == {0x02}:  # DSA: version, p, q, g, public, private
        return version == 0 and all(p[2] - p[1] >= 16 for p in parts[1:])
    if tags[1:3] == [0x30, 0x04]:  # version, algorithm, octets
        algorithm = inside(parts[1])
        if version not in (0, 1) or not algorithm or algorithm[0][0] != 0x06:
            return False
        return _holds_key(data[algorithm[0][1] : algorithm[0][2]], data[parts[2][1] : parts[2][2]])
    return version == 1 and len(tags) >= 2 and tags[1] == 0x04 and parts[1][2] - parts[1][1] >= 16 and set(tags[2:]) <= {0xA0, 0xA1}


def _is_password_scheme(data: bytes, algorithm: list[tuple[int, int, int]] | None) -> bool:
    """Is it a scheme of PKCS#5 or PKCS#12 with its salt and rounds?"""
    if not algorithm or [p[0] for p in algorithm] != [0x06, 0x30]:
        return False
    name, parameters = data[algorithm[0][1] : algorithm[0][2]], der_elements(data, *algorithm[1][1:])
    tags = [p[0] for p in parameters or ()]
    if name in PBES1:
        return tags == [0x04, 0x02]
    if name != PBES2 or tags != [0x30, 0x30]:
        return False
    steps = [der_elements(data, *p[1:]) for p in parameters]
    if not all(step and step[0][0] == 0x06 for step in steps) or len(steps[0]) != 2:
        return False
    salted = der_elements(data, *steps[0][1][1:])
    return data[steps[0][0][1] : steps[0][0][2]] in DERIVATIONS and [p[0] for p in salted or ()][:2] == [0x04, 0x02]


def _holds_key(algorithm: bytes, octets: bytes) -> bool:
    """Do the octets of a PKCS#8 key hold a key of the algorithm?"""
    if algorithm in (RSA, EC):
        return is_der_key(octets)
    inner = der_elements(octets, 0, len(octets))
    if not inner or len(inner) != 1:
        return False
    tag, lo, hi = inner[0]
    if algorithm == DSA:
        return tag == 0x02 and hi > lo
    if algorithm in EDWARDS:
        return tag == 0x04 and hi - lo in (32, 56, 57)
    return hi > lo


def is_openssh_key(data: bytes) -> bool:
    """``openssh-key-v1`` container whose length prefixes add up."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False

    def string(at: int) -> int | None:
        if at + 4 > len(data):
            return None
        to = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return to if to <= len(data) else None

    at: int | None = len(magic)
    for _ in range(3):  # cipher, kdf, kdf options
        at = string(at)
        if at is None:
            return False
    if at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 64:
        return False
    for _ in range(keys + 1):  # public keys, private blob
        at = string(at)
        if at is None:
            return False
    return at == len(data)


def is_jwt(header: str, claims: str, signature: str) -> bool:
    parts = []
    for piece in (header, claims):
        raw = decode_base64(piece)
        try:
            parts.append(json.loads(raw) if raw else None)
        except (ValueError, RecursionError):
            return False
    if not all(isinstance(p, dict) for p in parts) or not isinstance(parts[0].get("alg"), str):
        return False
    least, most = SIGNATURES.get(parts[0]["alg"], (1, 0))
    return least <= len(decode_base64(signature) or b"") <= most


def structure(data: bytes, depth: int) -> int | None:
    """Kind of the secret that decoded bytes are or, as text, hold."""
    if is_der_key(data) or is_openssh_key(data):
        return KINDS.index("der")
    if depth and data.isascii() and b"\0" not in data:
        inner = confirmed_spans(data.decode("ascii"), depth - 1)
        return inner[0][1] if inner else None
    return None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the three base patterns."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS) or not low.isascii():
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _is_encrypted_pem(body: str, raw: bytes | None) -> bool:
    """Whole blocks of the cipher that a header names, with an initial vector of its size."""
    dek = _DEK.search(body)
    block = (16 if dek and dek[1].startswith(("AES", "CAMELLIA", "SEED", "ARIA")) else 8) if dek else 0
    return bool(block and raw) and "ENCRYPTED" in body and len(dek[2]) == 2 * block and len(raw) >= 4 * block and len(raw) % block == 0


def _key_at(text: str, at: int) -> int | None:
    """Characters of base64 text from ``at`` on that are exactly a DER key."""
    head = decode_base64(text[at : at + 8])
    if not head or head[0] != 0x30 or len(head) < 6:
        return None
    long = head[1] & 0x7F if head[1] >= 0x80 else 0
    if long > 4:
        return None
    octets = 2 + long + (int.from_bytes(head[2 : 2 + long], "big") if long else head[1])
    size = -(-octets * 8 // 6)
    if octets < 40 or at + size > len(text):
        return None
    raw = decode_base64(text[at : at + size])
    return size if raw and len(raw) == octets and is_der_key(raw) else None


def _inner_keys(text: str, start: int) -> Iterator[tuple[int, int, int]]:
    """Keys that begin anywhere in a run of base64 characters at ``start``; padding belongs to them."""
    to = 0
    for m in _SEQUENCE.finditer(text):
        if m.start() >= to and (size := _key_at(text, m.start())):
            to = m.start() + size
            to += len(text[to : to + 2]) - len(text[to : to + 2].lstrip("="))
            yield start + m.start(), KINDS.index("der"), start + to


def _wrapped_keys(m: re.Match) -> Iterator[tuple[int, int, int]]:
    """Keys in lines of base64: found in the characters without the line ends, told in places of the text."""
    places = [i for i, c in enumerate(m[0]) if not c.isspace()]
    for a, kind, b in _inner_keys("".join(m[0].split()), 0):
        yield m.start() + places[a], kind, m.start() + places[b - 1] + 1


def confirmed_spans(text: str, depth: int = DEPTH) -> list[tuple[int, int, int]]:
    """Spans whose decoded content has the structure of a secret; the outermost of nested ones."""
    found = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            lines = m[2].replace("\\r", "").replace("\\n", "\n").split("\n")
            raw = decode_base64("".join(line.strip() for line in lines if ":" not in line))
            if raw and (is_der_key(raw) or is_openssh_key(raw) or _is_encrypted_pem("\n".join(lines), raw)):
                found.append((m.start(), 3, m.end()))
    for pattern, decode in ((_B64, decode_base64), (_HEX_BLOB, bytes.fromhex)):
        for m in pattern.finditer(text):
            raw = decode(m[0])
            kind = structure(raw, depth) if raw else None
            if kind is not None:
                found.append((m.start(), kind, m.end()))
            elif pattern is _B64:
                found += _inner_keys(m[0], m.start())
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            found += _wrapped_keys(m)
    if "." in text:
        found += [(m.start(), 5, m.end()) for m in _JWT.finditer(text) if is_jwt(m[1], m[2], m[3])]
    out: list[tuple[int, int, int]] = []
    for a, k, b in sorted(set(found), key=lambda x: (x[0], -x[2], x[1])):
        if not out or b > out[-1][2]:
            out.append((a, k, b))
    return out


def render(spans: list[tuple[int, int, int]], kinds=KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def _scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows = []
        for text in batch["text"]:
            value = text.as_py() or ""
            base, more = base_spans(value), confirmed_spans(value)
            counts = [sum(k == i for _, k, _ in base) for i in range(3)]
            rows.append((*counts, len(more), hashlib.sha256(render(base).encode()).hexdigest(), render(sorted(base + more))))
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t.type) for c, t in zip(columns, list(_ARROW)[1:]))], schema=_ARROW)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the counts, the digest of the base spans and all spans."""
    return common.texts(docs, id_col, text_col).mapInArrow(_scan, SCHEMA)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(common.table(spark, sf_dir, "documents"))
