"""Operator 13: secrets, confirmed by their structure.

Three kinds are patterns: an assignment to a password-like name, an access key id
and a long lower-case hex string. The others are reported only after decoding:

- ``private_key``: base64 or hex whose bytes are a private key in DER: a sequence
  whose length and all nested lengths fit exactly, with the fields of PKCS#1, PKCS#8
  (also encrypted), SEC 1 or DSA. Base64 may be broken over lines, as in PEM, also by
  ``\\n`` as it stands in JSON, and may use ``-_``. The outer length says where the key
  ends, so neither what precedes nor what follows it has to be cut off first.
- ``openssh_key``: base64 or hex of an OpenSSH private key: its magic, then strings with
  their lengths, the last of which holds the key.
- ``signed_token``: three base64url parts between dots, the first a JSON object with
  ``alg``, the second a JSON object, the third as long as that algorithm signs.

A text is first looked through as bytes: only one with a name or a run of
``LONG`` letters that keys are made of is matched. Every key, access id, hex string
and token has such a run, so nothing is lost.

Spans are code points, end exclusive. Kinds are found each by itself and may
overlap; within one kind spans do not.

Defined cases: null and empty texts have no spans; null ids and repeated rows
give a row each; an empty table gives an empty result; only the id and the text
are read, so other columns may have any name. Texts are taken whole; work grows
with their length.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("assign", "access", "hex", "private_key", "openssh_key", "signed_token")
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

LONG = 20
NAMES = (b"passw", b"secret", b"token", b"api_key", b"apikey")
LETTERS = np.zeros(256, bool)
LETTERS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True

# base64 letters over lines; a line break may be written out, and lines may be indented
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:(?:\\[rn]|[\r\n])+[\x20\t]*[A-Za-z0-9+/_-]+)*")
PIECE = re.compile(r"\\[rn]|[A-Za-z0-9+/_-]+")
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{40,}")
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}")
# a sequence begins with 0x30, the OpenSSH magic with "open"
BASE64_START, HEX_START = re.compile("M|b3Blbn"), re.compile("30|6f70656e")
URL_LETTERS = str.maketrans("-_", "+/")

SSH_MAGIC = b"openssh-key-v1\0"
# fixed values: bytes of a signature by algorithm; RSA signatures are as long as the modulus
SIGNATURE_BYTES = {
    "HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,), "ES512": (132,),
    "EdDSA": (64, 114),
}
RSA_ALGORITHMS = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")

Span = tuple[str, int, int]


# bytes of keys


def header(data: memoryview, at: int) -> tuple[int, int, int] | None:
    """``(tag, first byte of the content, byte after it)`` of the value at ``at``, without asking whether it is there."""
    if at + 2 > len(data):
        return None
    tag, size = data[at], data[at + 1]
    at += 2
    if size >= 0x80:
        n = size - 0x80
        # short lengths are written short, and no key needs more than four bytes
        if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
            return None
        size = int.from_bytes(data[at : at + n])
        if size < 0x80:
            return None
        at += n
    return tag, at, at + size


SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06
MOST_FIELDS = 9


def values(data: memoryview) -> list[tuple[int, memoryview]]:
    """``(tag, content)`` of the values that fill ``data`` exactly, at most ``MOST_FIELDS``; else none."""
    found, at = [], 0
    while at < len(data):
        head = header(data, at)
        if head is None or head[2] > len(data) or len(found) == MOST_FIELDS:
            return []
        found.append((head[0], data[head[1] : head[2]]))
        at = head[2]
    return found


def is_private_key(content: memoryview) -> bool:
    """Whether the content of a DER sequence has the fields of a private key."""
    parts = values(content)
    tags = [tag for tag, _ in parts]
    if len(tags) < 2:
        return False
    if tags == [SEQUENCE, OCTETS]:  # encrypted PKCS#8: scheme with its parameters, data
        return [tag for tag, _ in values(parts[0][1])] == [OID, SEQUENCE] and len(parts[1][1]) >= 16
    if tags[0] != INTEGER or parts[0][1] not in (b"\0", b"\1"):
        return False
    if tags[1:3] == [SEQUENCE, OCTETS]:  # PKCS#8, attributes and the public key may follow
        scheme = values(parts[1][1])
        return scheme[:1] != [] and scheme[0][0] == OID and len(parts[2][1]) >= 16 and set(tags[3:]) <= {0xA0, 0xA1, 0x81}
    if tags[1] == OCTETS:  # SEC 1, curve and point may follow
        return parts[0][1] == b"\1" and 16 <= len(parts[1][1]) <= 66 and set(tags[2:]) <= {0xA0, 0xA1}
    # PKCS#1 has nine numbers, DSA six; the modulus comes first
    return set(tags) == {INTEGER} and len(tags) in (6, 9) and len(parts[1][1]) >= 32


def openssh_size(data: memoryview) -> int:
    """Bytes of the OpenSSH private key that ``data`` begins with, or 0."""
    at = len(SSH_MAGIC)

    def number() -> int:
        return int.from_bytes(data[at : at + 4]) if at + 4 <= len(data) else len(data)

    for _ in range(3):  # cipher, key derivation, its options
        at += 4 + number()
    n_keys = number()
    if not 1 <= n_keys <= 16:
        return 0
    at += 4
    for _ in range(n_keys + 1):  # public keys, then the private part
        at += 4 + number()
    return at if at <= len(data) else 0


def confirm(data: memoryview) -> tuple[str, int] | None:
    """The kind of key that ``data`` begins with, and its bytes."""
    if data[: len(SSH_MAGIC)] == SSH_MAGIC:
        size = openssh_size(data)
        return ("openssh_key", size) if size else None
    head = header(data, 0)
    if head and head[0] == SEQUENCE and head[1] < head[2] <= len(data) and is_private_key(data[head[1] : head[2]]):
        return "private_key", head[2]
    return None


# candidates


def keys_in(letters: str, start: re.Pattern, group: int, size: int, decode) -> Iterator[tuple[str, int, int, int]]:
    """``(kind, first letter, letter after it, bytes)`` of the keys in a run of letters, ``group`` of which hold ``size`` bytes.

    A key may begin at any letter, so the run is decoded once from each of its first ``group``.
    """
    decoded: dict[int, memoryview] = {}
    at = 0
    while found := start.search(letters, at):
        at = found.start()
        shift = at % group
        if shift not in decoded:
            decoded[shift] = memoryview(decode(letters[shift:]))
        key = confirm(decoded[shift][(at - shift) // group * size :])
        if key:
            stop = at + -(-key[1] * group // size)
            yield key[0], at, stop, key[1]
            at = stop
        else:
            at += 1


def base64_bytes(letters: str) -> bytes:
    """The bytes of all whole groups of letters and of what is left."""
    if len(letters) % 4 == 1:
        letters = letters[:-1]
    return base64.b64decode(letters + "=" * (-len(letters) % 4))


def hex_bytes(letters: str) -> bytes:
    return bytes.fromhex(letters[: len(letters) // 2 * 2])


def base64_keys(text: str) -> Iterator[Span]:
    for candidate in ENCODED.finditer(text):
        pieces = [m for m in PIECE.finditer(text, candidate.start(), candidate.end()) if not m[0].startswith("\\")]
        starts = np.cumsum([0, *(len(m[0]) for m in pieces)])

        def place(letter: int, pieces=pieces, starts=starts) -> int:
            piece = int(np.searchsorted(starts, letter, "right")) - 1
            return pieces[piece].start() + letter - int(starts[piece])

        letters = "".join(m[0] for m in pieces).translate(URL_LETTERS)
        for kind, first, stop, size in keys_in(letters, BASE64_START, 4, 3, base64_bytes):
            end = place(stop - 1) + 1
            padding = -size % 3
            if padding and text[end : end + padding] == "=" * padding:
                end += padding
            yield kind, place(first), end


def hex_keys(text: str) -> Iterator[Span]:
    for candidate in HEX_RUN.finditer(text):
        begin = candidate.start()
        for kind, first, stop, _ in keys_in(candidate[0].lower(), HEX_START, 2, 1, hex_bytes):
            yield kind, begin + first, begin + stop


def json_object(part: str) -> dict | None:
    """The object that base64url letters hold."""
    try:
        value = json.loads(base64.b64decode(part.translate(URL_LETTERS) + "=" * (-len(part) % 4), validate=True))
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def signed(header_part: str, payload: str, signature: str) -> bool:
    # an object's first byte is a brace, which leaves these first letters
    if header_part[:1] != "e" or payload[:1] != "e" or len(signature) % 4 == 1:
        return False
    algorithm = (json_object(header_part) or {}).get("alg")
    size = len(signature) * 3 // 4
    if algorithm in RSA_ALGORITHMS:
        fits = size >= 128
    else:
        fits = isinstance(algorithm, str) and size in SIGNATURE_BYTES.get(algorithm, ())
    return fits and json_object(payload) is not None


def signed_tokens(text: str) -> Iterator[Span]:
    for candidate in DOTTED.finditer(text):
        parts = candidate[0].split(".")
        places = [candidate.start()]
        for part in parts:
            places.append(places[-1] + len(part) + 1)
        at = 0
        while at + 3 <= len(parts):
            if signed(*parts[at : at + 3]):
                yield "signed_token", places[at], places[at + 3] - 1
                at += 3
            else:
                at += 1


def pattern_spans(text: str) -> Iterator[Span]:
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= MIN_VALUE:
            yield "assign", m.start(), m.end()
    for kind, pattern, least in (("access", ACCESS, MIN_ACCESS), ("hex", HEX, MIN_HEX)):
        for m in pattern.finditer(text):
            if m.end() - m.start() >= least:
                yield kind, m.start(), m.end()


def may_hold(content: bytes) -> bool:
    """Whether a text has a name or a run of ``LONG`` letters."""
    lowered = content.lower()
    if any(name in lowered for name in NAMES):
        return True
    others = np.flatnonzero(~LETTERS[np.frombuffer(content, np.uint8)])
    return bool((np.diff(others, prepend=-1, append=len(content)) > LONG).any())


def secrets_of(content: bytes) -> list[Span]:
    """``(kind, start, end)`` of all secrets, by start, then kind in the order of ``KINDS``."""
    if not may_hold(content):
        return []
    text = content.decode()
    found = [*pattern_spans(text), *base64_keys(text), *hex_keys(text), *signed_tokens(text)]
    return sorted(set(found), key=lambda span: (span[1], KINDS.index(span[0]), span[2]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, spans)``: an array of ``(kind, start, end)`` per document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [dict(zip(("kind", "start", "end"), span)) for span in secrets_of(content.as_py() or b"")]
                for content in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return read.mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")
