"""Secrets in texts: patterns, and encoded keys and tokens that are confirmed by their structure.

The first three kinds are patterns: an assignment to a telling name, an access key, a long run of hex digits. The others
are decoded before they count. A run of base64 (over lines, too, and with escaped line ends) or of hex digits that opens
like a DER sequence is decoded as far as the declared length says, and all nested lengths must add up to a private key:
PKCS#1, DSA, SEC1, PKCS#8 in the clear or encrypted, PKCS#12. One that opens like an OpenSSH key is read string by
string. Three joined runs of base64url are a signed token if the first is a JSON header whose algorithm fits the length
of the third.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

SLICE = 4 << 20
KINDS = ("assign", "access", "hex", "key", "ssh", "jwt")
BASE = KINDS[:3]
#: The shortest run of letters, digits and + / _ - that a long pattern has, and the first line of an encoded one.
LEAST_RUN, LEAST_CODE = 20, 40
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_key long, n_ssh long, n_jwt long"

_NAMES = (b"passw", b"secret", b"token", b"key")
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_CODE = re.compile(rb"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nr]))(?:M[A-P]|b3BlbnNzaC1rZXktdjEA)[A-Za-z0-9+/_-]{20}")
_HEX_CODE = re.compile(rb"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{38,}")
_TOKEN = re.compile(rb"(?<![A-Za-z0-9_-])(e[w-z0-9_-][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{40,})(?![A-Za-z0-9_.-])")
_RUN, _GAP = re.compile(rb"[A-Za-z0-9+/_-]+"), re.compile(rb"(?:[ \t]*\r?\n[ \t]*|\\[nr])+")
_INSIDE = np.zeros(256, bool)
_INSIDE[[c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_-"]] = True

# DER tags, object identifiers by their encoded beginnings, bytes of a signature by algorithm.
INTEGER, BITS, OCTETS, OID, SEQUENCE, CONTEXT_0, CONTEXT_1 = 0x02, 0x03, 0x04, 0x06, 0x30, 0xA0, 0xA1
PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
PKCS7 = bytes.fromhex("2a864886f70d0107")
SIGNATURES = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES384": (96,), "ES512": (132,), "ES256K": (64,), "EdDSA": (64, 114)}
RSA_SIGNATURES = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")
SSH_MAGIC = b"openssh-key-v1\0"


class _Bytes:
    """What a run of base64 from a place on decodes to, decoded only as far as it is asked for."""

    def __init__(self, text: bytes, at: int):
        self.text, self.at, self.code, self.data = text, at, bytearray(), b""

    def read(self, n: int) -> bytes:
        """The first n bytes; fewer if the run ends before."""
        need = -(-n * 4 // 3)
        while len(self.code) < need:
            run = _RUN.match(self.text, self.at, self.at + need - len(self.code))
            if run:
                self.code += run[0]
                self.at = run.end()
            elif gap := _GAP.match(self.text, self.at):
                self.at = gap.end()
            else:
                break
        if len(self.data) < n:
            whole = bytes(self.code).translate(_STANDARD)
            self.data = base64.b64decode(whole[: len(whole) - (len(whole) % 4 == 1)] + b"A" * (-(len(whole) - (len(whole) % 4 == 1)) % 4))[: len(whole) * 3 // 4]
        return self.data[:n]

    def end(self, n: int) -> int | None:
        """Where the run ends, if it does so after n bytes, with padding or without."""
        self.read(n)
        if len(self.code) != -(-n * 4 // 3):
            return None
        pad = -len(self.code) % 4
        at = self.at + pad * (self.text[self.at : self.at + pad] == b"=" * pad)
        return None if _RUN.match(self.text, at) or self.text[at : at + 1] == b"=" else at


_STANDARD = bytes.maketrans(b"-_", b"+/")


def _head(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start of the content, its end) of the element at a place, in DER's shortest form."""
    if at + 2 > len(data):
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n & 0x80:
        k = n & 0x7F
        n = int.from_bytes(data[at : at + k], "big")
        if not 1 <= k <= 3 or at + k > len(data) or n < 0x80 or n >> 8 * (k - 1) == 0:
            return None
        at += k
    return tag, at, at + n


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Heads of the elements that fill data[at:end] exactly."""
    out = []
    while at < end:
        head = _head(data, at)
        if head is None or head[2] > end:
            return None
        out.append(head)
        at = head[2]
    return out


def _number(data: bytes, head: tuple[int, int, int]) -> int | None:
    """A small INTEGER's value, -1 for a large one; None for what is none in shortest form, or is negative."""
    tag, a, b = head
    if tag != INTEGER or b <= a or data[a] & 0x80 or (b - a > 1 and data[a] == 0 and not data[a + 1] & 0x80):
        return None
    return data[a] if b - a == 1 else -1


def private_key(data: bytes) -> bool:
    """Whether DER data is a private key of a known encoding, all lengths right."""
    top = _head(data, 0)
    if top is None or top[0] != SEQUENCE or top[2] != len(data):
        return False
    parts = _children(data, *top[1:])
    if not parts or len(parts) < 2:
        return False
    tags = [p[0] for p in parts]

    def algorithm(head: tuple[int, int, int]) -> bytes:
        own = _children(data, *head[1:]) if head[0] == SEQUENCE else None
        return data[own[0][1] : own[0][2]] if own and own[0][0] == OID and len(own) <= 2 else b""

    if tags == [SEQUENCE, OCTETS]:
        body = parts[1][2] - parts[1][1]
        return algorithm(parts[0]).startswith(PBE) and body >= 16 and body % 8 == 0
    version = _number(data, parts[0])
    if version is None:
        return False
    if set(tags) == {INTEGER} or (version == 1 and tags[:-1] == [INTEGER] * 9 and tags[-1] == SEQUENCE):
        numbers = [_number(data, p) for p in parts[1:9]]
        modulus = parts[1][2] - parts[1][1]
        return None not in numbers and ((version in (0, 1) and len(tags) in (9, 10) and modulus >= 48) or (version == 0 and len(tags) == 6 and modulus >= 64))
    if tags[1] == OCTETS:
        secret = parts[1][2] - parts[1][1]
        return version == 1 and 14 <= secret <= 72 and tags[2:] in ([], [CONTEXT_0], [CONTEXT_1], [CONTEXT_0, CONTEXT_1]) and all(_children(data, *p[1:]) for p in parts[2:])
    if tags[1:3] == [SEQUENCE, OCTETS]:
        return version in (0, 1) and bool(algorithm(parts[1])) and parts[2][2] - parts[2][1] >= 16 and tags[3:] in ([], [CONTEXT_0], [CONTEXT_1], [CONTEXT_0, CONTEXT_1], [0x81], [CONTEXT_0, 0x81])
    if version == 3 and tags[1:] in ([SEQUENCE], [SEQUENCE, SEQUENCE]):
        return algorithm(parts[1]).startswith(PKCS7)
    return False


def _ssh_key(source: _Bytes) -> int | None:
    """Bytes of the OpenSSH key that a source opens with."""
    at = len(SSH_MAGIC)
    if source.read(at) != SSH_MAGIC:
        return None

    def string() -> bytes | None:
        nonlocal at
        size = source.read(at + 4)[at:]
        n = int.from_bytes(size, "big")
        if len(size) < 4 or n > 1 << 20:
            return None
        own = source.read(at + 4 + n)[at + 4 :]
        at += 4 + n
        return own if len(own) == n else None

    cipher, kdf, options = string(), string(), string()
    if not cipher or not kdf or options is None or (cipher == b"none") != (kdf == b"none"):
        return None
    keys = int.from_bytes(source.read(at + 4)[at:], "big")
    at += 4
    if not 1 <= keys <= 16:
        return None
    for _ in range(keys):
        public = string()
        if not public or len(public) < 8 or not 4 <= int.from_bytes(public[:4], "big") <= len(public) - 4:
            return None
    secret = string()
    if not secret or len(secret) < 16 or (cipher == b"none" and secret[:4] != secret[4:8]):
        return None
    return at


def _signed(header: bytes, payload: bytes, signature: bytes) -> bool:
    def decoded(part: bytes) -> bytes:
        return base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))

    try:
        head, size = json.loads(decoded(header)), len(decoded(signature))
        decoded(payload)
    except (ValueError, RecursionError):  # binascii.Error and bad UTF-8 are ValueErrors
        return False
    if not isinstance(head, dict):
        return False
    kind = head.get("alg")
    return isinstance(kind, str) and (size in SIGNATURES.get(kind, ()) or (kind in RSA_SIGNATURES and size >= 128))


def confirmed(text: bytes) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes of the keys and tokens whose structure holds."""
    out = []
    for m in _CODE.finditer(text):
        source = _Bytes(text, m.start())
        if m[0].startswith(b"b3"):
            size, kind = _ssh_key(source), "ssh"
        else:
            # the opening of the first element inside goes ahead of the whole, which may be long
            top, kind = _head(source.read(5), 0), "key"
            inner = _head(source.read(top[1] + 5), top[1]) if top else None
            size = top[2] if inner and inner[0] in (INTEGER, SEQUENCE) and inner[2] <= top[2] and private_key(source.read(top[2])) else None
        end = source.end(size) if size else None
        if end is not None:
            out.append((m.start(), kind, end))
    for m in _HEX_CODE.finditer(text):
        if len(m[0]) % 2 == 0 and private_key(binascii.unhexlify(m[0])):
            out.append((m.start(), "key", m.end()))
    out += [(m.start(), "jwt", m.end()) for m in _TOKEN.finditer(text) if _signed(*m.groups())]
    return out


def spans(text: bytes, longest: int) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes of a text's secrets by start, then kind; `longest` is that of its runs."""
    low = text.lower()
    out = []
    if any(name in low for name in _NAMES):
        out += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(low) if len(m[1]) >= 6]
    if longest >= LEAST_RUN:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
        out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    if longest >= LEAST_CODE:
        out += confirmed(text)
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = pc.fill_null(batch.column("text").take(pa.array(np.arange(batch.num_rows))).cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1)
    points = np.frombuffer(data, np.uint8, int(bounds[-1])) if data else np.zeros(0, np.uint8)
    # the longest run of each text: distances of characters that are in none, and of the texts' bounds
    edges = np.union1d(np.flatnonzero(~_INSIDE[points]), bounds)
    gaps = np.diff(edges)
    long = np.flatnonzero(gaps >= LEAST_RUN)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, np.searchsorted(bounds, edges[long], "right") - 1, gaps[long])
    rows = []
    for doc_id, text, run, a, b in zip(batch.column("doc_id").to_pylist(), texts.to_pylist(), longest.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        found = spans(text, run)
        if found:
            # places count code points: bytes that go on with a character are none
            upto = np.concatenate([[0], np.cumsum((points[a:b] & 0xC0) != 0x80)])
            found = [(int(upto[i]), kind, int(upto[j])) for i, kind, j in found]
        listed = [(kind, f"{kind}:{i}:{j}") for i, kind, j in found]
        n = {k: sum(kind == k for kind, _ in listed) for k in KINDS}
        digest = hashlib.sha256(",".join(x for kind, x in listed if kind in BASE).encode()).hexdigest()
        rows.append((doc_id, *(n[k] for k in BASE), digest, ",".join(x for _, x in listed), *(n[k] for k in KINDS[3:])))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The secrets of every row: (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_key, n_ssh, n_jwt).

    `spans` lists kind:start:end of all secrets by start, then kind (KINDS), joined by commas; places count code points,
    the end is exclusive. base_sha256 is the digest of that list of the first three kinds alone. Matches of a kind do not
    overlap, those of different kinds may. Names count in any ASCII case. An assigned value has six characters at
    least, an access key 20, a run of hex 24; the first line of an encoded key or of a token's signature has 40.

    Null, empty and blank texts have none, and the digest of the empty text. Very long texts are read whole, in linear
    time. Repeated rows and null ids have a row each, other columns, whatever their names, are ignored, an empty table
    gives no rows. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(lambda batches: map(_scan, slices(batches, "text", SLICE)), SCHEMA)
