"""Secret scan: base patterns, and structural confirmation of base64 and hex candidates.

A linear pattern picks the texts that can hold a secret. There the base patterns run as they stand; base64 and hex candidates are decoded and reported only
when their structure holds: a signed token whose header is JSON with an algorithm and whose payload is JSON, an OpenSSH key whose length-prefixed
fields fit in their stated number, or a DER key whose nested lengths fill their parents exactly and whose fields are those of a private key (RSA,
DSA, elliptic curves, these within PKCS #8, or encrypted PKCS #8). Base64 may be wrapped, with or without armour, armour may have headers, ends of
lines may be written as escapes, and hex may mix cases. An old encrypted key is taken on its headers and whole cipher blocks.

Defined results: null text counts as empty and has no span; spans of different kinds may overlap; repeated rows are scanned each;
rows with a null doc_id keep it; an empty table gives an empty result; other columns are ignored by find_secrets and kept by mask_secrets.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import filled, text_of

#: Kinds in the order that breaks ties of a start; the first three are the base.
KINDS = ["assign", "access", "hex", "token", "pem", "key", "hexkey"]
BASE = KINDS[:3]
SPANS = "array<struct<kind:string,start:int,end:int>>"

# The base patterns: fixed values.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

POSSIBLE = r"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|eyJ|PRIVATE KEY|[A-Za-z0-9+/]{40}|[0-9A-Fa-f]{64}"
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
ARMOUR = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----((?:[^-]|-(?!----))+)-----END \1PRIVATE KEY-----")
HEX_BYTES = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")
#: Ends of lines, as they are or written as an escape.
WRAP = re.compile(r"[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*")
#: Base64, wrapped or not, and the places in it where a key can begin.
RUN = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}(?:[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*[A-Za-z0-9+/]+={0,2})*")
BEGIN = re.compile(r"(?:(?<![A-Za-z0-9+])|(?<=\\n))(?:M[A-P]|b3BlbnNzaC1rZXktdjEA)")
LETTER = re.compile(r"[A-Za-z0-9+/]")

INTEGER, OCTETS, OBJECT, SEQUENCE = 0x02, 0x04, 0x06, 0x30
#: Tags of the fields of keys: those, and numbered ones of attributes and public keys.
TAGS = (INTEGER, OCTETS, SEQUENCE, 0xA0, 0xA1, 0x81)
MAGIC = b"openssh-key-v1\0"

# Object identifiers of key algorithms and of password-based encryption: fixed values.
RSA, DSA, CURVE = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a8648ce3d0201")
ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def der_head(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """(tag, where its content begins, where that ends) of the field at a place; the end may lie beyond data. None if there is no head."""
    if at + 2 > len(data):
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or at + width > len(data):
            return None
        size, at = int.from_bytes(data[at : at + width], "big"), at + width
    return tag, at, at + size


def der_fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of fields that fill data exactly; None if a length does not fit."""
    fields, at = [], 0
    while at < len(data):
        head = der_head(data, at)
        if head is None or head[2] > len(data):
            return None
        fields.append((head[0], data[head[1] : head[2]]))
        at = head[2]
    return fields


def sequence_of(data: bytes) -> list[tuple[int, bytes]]:
    """The fields of the one SEQUENCE that data is; none if it isn't."""
    outer = der_fields(data)
    return (der_fields(outer[0][1]) or []) if outer and len(outer) == 1 and outer[0][0] == SEQUENCE else []


def is_rsa_key(fields: list[tuple[int, bytes]]) -> bool:
    """Version, modulus, exponents, primes and their coefficients; a key of more primes lists these at the end."""
    numbers = [value for tag, value in fields[:9] if tag == INTEGER and value]
    more = fields[9:]
    return len(numbers) == 9 and (not more if numbers[0] == b"\0" else len(more) == 1 and more[0][0] == SEQUENCE and bool(der_fields(more[0][1])))


def is_dsa_key(fields: list[tuple[int, bytes]]) -> bool:
    return len(fields) == 6 and all(tag == INTEGER and value for tag, value in fields) and fields[0][1] == b"\0"


def is_curve_key(fields: list[tuple[int, bytes]]) -> bool:
    """Version 1, a scalar, and no more than the tagged curve and public point."""
    if len(fields) < 2 or fields[0] != (INTEGER, b"\1") or fields[1][0] != OCTETS or not 16 <= len(fields[1][1]) <= 66:
        return False
    return [tag for tag, _ in fields[2:]] in ([], [0xA0], [0xA1], [0xA0, 0xA1]) and all(der_fields(value) for _, value in fields[2:])


def is_wrapped_key(fields: list[tuple[int, bytes]]) -> bool:
    """PKCS #8: version, algorithm, and octets that hold a key of that algorithm; attributes and a public key may follow."""
    if len(fields) < 3 or [tag for tag, _ in fields[:3]] != [INTEGER, SEQUENCE, OCTETS] or fields[0][1] not in (b"\0", b"\1"):
        return False
    algorithm, key = der_fields(fields[1][1]), fields[2][1]
    if not algorithm or algorithm[0][0] != OBJECT or any(tag not in (0xA0, 0x81, 0xA1) for tag, _ in fields[3:]):
        return False
    name = algorithm[0][1]
    if name == RSA:
        return is_rsa_key(sequence_of(key))
    if name == CURVE:
        return is_curve_key(sequence_of(key))
    inner = der_fields(key)
    # DSA keeps one number, the Edwards and Montgomery curves one string
    return bool(inner) and len(inner) == 1 and bool(inner[0][1]) and inner[0][0] == (INTEGER if name == DSA else OCTETS)


def is_encrypted_key(fields: list[tuple[int, bytes]]) -> bool:
    """Encrypted PKCS #8: a password-based algorithm with its parameters, and octets."""
    if [tag for tag, _ in fields] != [SEQUENCE, OCTETS] or len(fields[1][1]) < 16:
        return False
    algorithm = der_fields(fields[0][1])
    return bool(algorithm) and len(algorithm) == 2 and algorithm[0][0] == OBJECT and algorithm[0][1].startswith(ENCRYPTIONS) and algorithm[1][0] == SEQUENCE and bool(der_fields(algorithm[1][1]))


def is_der_key(data: bytes) -> bool:
    """True for RSA, DSA, elliptic-curve, PKCS #8 and encrypted PKCS #8 private keys, whose nested lengths fill data to the last byte."""
    fields = sequence_of(data)
    return is_rsa_key(fields) or is_dsa_key(fields) or is_curve_key(fields) or is_wrapped_key(fields) or is_encrypted_key(fields)


class Decoded:
    """The bytes of base64 letters from a place on, decoded where they are asked for."""

    def __init__(self, letters: str, first: int, last: int):
        self.letters, self.first, self.size = letters, first, (last - first) * 6 // 8

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        a, b, _ = part.indices(self.size)
        if a >= b:
            return b""
        quads = self.letters[self.first + a // 3 * 4 : min(self.first + -(-b // 3) * 4, self.first + -(-self.size * 8 // 6))]
        return unbase64(quads)[a % 3 : a % 3 + b - a]


def key_like(data: Decoded, outer: tuple[int, int, int]) -> bool:
    """Whether the fields of a SEQUENCE have tags that a private key's have and fill it; only their heads are read."""
    tags, at = [], outer[1]
    while at < outer[2] and len(tags) < 12:
        head = der_head(data[at : at + 6])
        if head is None or head[0] not in TAGS:
            return False
        tags.append(head[0])
        at += head[2]
    numbers = [INTEGER] * 6
    return at == outer[2] and (tags == numbers or tags[:9] == [INTEGER] * 9 or tags[:2] == [INTEGER, OCTETS] or tags[:3] == [INTEGER, SEQUENCE, OCTETS] or tags == [SEQUENCE, OCTETS])


def openssh_size(data: bytes | Decoded) -> int:
    """Bytes of the OpenSSH key that data begins with: the magic, cipher, derivation and its options, the number of keys, as many public keys, and the private part. 0 if a length does not fit."""
    if data[: len(MAGIC)] != MAGIC:
        return 0
    at, left = len(MAGIC), 3
    for part in ("names", "keys"):
        if part == "keys":
            keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
            if not 1 <= keys <= 16:
                return 0
            left = keys + 1
        for _ in range(left):
            size, at = int.from_bytes(data[at : at + 4], "big"), at + 4
            if at + size > len(data) or (part == "keys" and size < 16):
                return 0
            at += size
    return at


def is_key(data: bytes) -> bool:
    return is_der_key(data) or (bool(data) and openssh_size(data) == len(data))


def unbase64(text: str, url: bool = False) -> bytes:
    raw = text.rstrip("=")
    raw += "=" * (-len(raw) % 4)
    try:
        return base64.b64decode(raw, b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return b""


def is_signed_token(text: str) -> bool:
    """A JSON header that names an algorithm, and a JSON payload."""
    head, payload, _ = text.split(".")
    try:
        header, claims = json.loads(unbase64(head, url=True)), json.loads(unbase64(payload, url=True))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def is_armoured_key(body: str) -> bool:
    """Base64 of a key in lines, real or written as escapes; or, below headers that say so, of whole cipher blocks."""
    lines = [line.strip() for line in WRAP.split(body)]
    headers = dict(line.split(":", 1) for line in lines if ":" in line)
    data = unbase64("".join("".join(line.split()) for line in lines if ":" not in line))
    if headers.get("Proc-Type", "").strip() == "4,ENCRYPTED":
        return "," in headers.get("DEK-Info", "") and len(data) >= 16 and len(data) % 8 == 0
    return is_key(data)


def base64_keys(text: str) -> list[tuple[int, int]]:
    """(start, end) of the keys in base64 runs. A key says itself how long it is, so text may stand before it (a path) and on the lines after it."""
    found = []
    for run in RUN.finditer(text):
        begins = [m.start() for m in BEGIN.finditer(text, run.start(), run.end())]
        if not begins:
            continue
        places, at = [], run.start()
        for gap in WRAP.finditer(text, run.start(), run.end()):
            places.extend(range(at, gap.start()))
            at = gap.end()
        places.extend(range(at, run.end()))
        letters, end = "".join(map(text.__getitem__, places)), 0
        pads = [m.start() for m in re.finditer("=", letters)]
        for begin in begins:
            if begin < end:
                continue
            k = bisect.bisect_left(places, begin)
            head = unbase64(letters[k : k + 16])
            if head.startswith(MAGIC[:9]):
                pad = bisect.bisect_left(pads, k)
                size = openssh_size(Decoded(letters, k, pads[pad] if pad < len(pads) else len(letters)))
            else:
                outer = der_head(head)
                size = outer[2] if outer and outer[0] == SEQUENCE and head[outer[1] : outer[1] + 1] in (b"\x02", b"\x30") else 0
            last = k + (size * 8 + 5) // 6
            if not size or last > len(places):
                continue
            # a key's heads are looked at before it is decoded, which would take long where many places say that a long one begins
            if head[0] == SEQUENCE and not (key_like(Decoded(letters, k, last), outer) and is_der_key(unbase64(letters[k:last]))):
                continue
            stop = places[last - 1] + 1
            while stop < len(text) and text[stop] == "=" and stop - places[last - 1] <= -(last - k) % 4:
                stop += 1
            if LETTER.match(text, stop) is None:
                found.append((begin, stop))
                end = stop
    return found


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all secrets of a text, in order."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans += [(m.start(), 3, m.end()) for m in SIGNED.finditer(text) if is_signed_token(m[0])]
    spans += [(m.start(), 4, m.end()) for m in ARMOUR.finditer(text) if is_armoured_key(m[2])]
    spans += [(a, 5, b) for a, b in base64_keys(text)]
    spans += [(m.start(), 6, m.end()) for m in HEX_BYTES.finditer(text) if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0]))]
    return sorted(spans)


def _scanned(batches):
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        texts = filled(batch.column("text"))
        found: list[list[dict]] = [[] for _ in range(len(texts))]
        for i in np.flatnonzero(pc.match_substring_regex(texts, POSSIBLE).to_numpy(zero_copy_only=False)):
            found[i] = [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(texts[int(i)].as_py())]
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.list_(kind))], names=[*keep, "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive), by start and kind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scanned, f"doc_id long, spans {SPANS}")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_confirmed."""
    spans = F.col("spans")
    count = lambda *kinds: F.size(F.filter(spans, lambda s: s.kind.isin(*kinds))).cast("long")
    base = listed(F.filter(spans, lambda s: s.kind.isin(*BASE)))
    return find_secrets(docs).select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(base, 256).alias("base_sha256"), listed(spans).alias("spans"), count(*KINDS[3:]).alias("n_confirmed"))


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """text with the code points of spans (start, end), in order of their starts, as asterisks; its pieces are joined once."""
    pieces, at = [], 0
    for start, end in spans:
        if end > at:
            pieces += [text[at:start] if start > at else "", "*" * (end - max(at, start))]
            at = end
    return "".join(pieces) + text[at:]


def _masked(batches):
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = batch.column("text").cast(pa.string())
        hits = np.flatnonzero(pc.match_substring_regex(filled(texts), POSSIBLE).to_numpy(zero_copy_only=False))
        if len(hits):
            rows = texts.to_pylist()
            for i in hits:
                rows[i] = masked(rows[i], [(a, b) for a, _, b in spans_of(rows[i])])
            batch = batch.set_column(at, "text", pa.array(rows, pa.string()))
        yield batch


def mask_secrets(docs: DataFrame) -> DataFrame:
    """docs with every code point of a secret masked; lengths and the other columns stay."""
    return docs.mapInArrow(_masked, docs.schema)
