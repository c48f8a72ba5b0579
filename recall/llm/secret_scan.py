"""Secret scan with structural confirmation.

Base patterns report what looks like a secret. Candidates in base64 or hex are also decoded, and
reported as a key only if the bytes have the structure of one: a DER private key whose nested
lengths fit exactly, an OpenSSH key whose length-prefixed fields fit, or a signed token whose header
and claims are JSON objects. A key may begin anywhere in a run of such characters, and its base64 may be wrapped over
lines: every run is decoded once for each way of grouping its characters, and searched for headers. No shuffle; each
text is read once, whole.
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
from pyspark.sql import types as T

# Fixed patterns of the base kinds; the second element is the length that a match (assign: its
# second group) must have. The order of the kinds is the order of spans with one start.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LENGTH = 8
# A run that is too short holds no longer one, so the lengths may stand in these patterns.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token", "pem", "key64", "keyhex")

# Runs are taken whole from their first character, so a long one is looked at once.
DOTTED_RUN = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]{12,}+")
TOKEN_HEAD = "eyJ"
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]*+)-----END \1-----")
BASE64_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)*+={0,2}")
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}+")
#: Beginnings of DER keys: a sequence of some length that holds a version number or another sequence.
DER_HEAD = re.compile(rb"\x30(?:[\x20-\x7f]|\x81.|\x82..|\x83...|\x84....)(?:\x02\x01[\x00-\x03]|\x30)", re.DOTALL)

OPENSSH = b"openssh-key-v1\0"
SEQUENCE, INTEGER, OCTETS, OBJECT_ID = 0x30, 0x02, 0x04, 0x06
# Object ids of password-based encryption, PKCS 5 and PKCS 12.
PASSWORD_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def decode64(text: str) -> bytes | None:
    """Standard or URL-safe base64, with or without padding; None if it is neither."""
    body = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def der_length(data: memoryview, at: int) -> tuple[int, int] | None:
    """(start of the content, its end) of the DER value at ``at``; None if it does not fit into ``data``."""
    if at + 2 > len(data):
        return None
    length, at = data[at + 1], at + 2
    if length >= 0x80:
        width = length & 0x7F
        if not 1 <= width <= 4 or at + width > len(data):
            return None
        length, at = int.from_bytes(data[at : at + width]), at + width
    return (at, at + length) if at + length <= len(data) else None


def der_items(data: memoryview) -> list[tuple[int, memoryview]] | None:
    """Tag and content of the DER values that fill ``data`` exactly; None if they do not."""
    items, at = [], 0
    while at < len(data):
        if (found := der_length(data, at)) is None:
            return None
        items.append((data[at], data[found[0] : found[1]]))
        at = found[1]
    return items


def _nested(data: memoryview) -> bool:
    """Whether ``data`` is one or more DER values."""
    return bool(der_items(data))


def is_der_key(content: memoryview) -> bool:
    """Whether a DER sequence is a private key: RSA or DSA, EC, wrapped, or wrapped and encrypted."""
    inner = der_items(content)
    if not inner or len(inner) < 2:
        return False
    tags = [tag for tag, _ in inner]
    if tags == [SEQUENCE, OCTETS]:
        scheme = der_items(inner[0][1])
        known = bool(scheme) and scheme[0][0] == OBJECT_ID and bytes(scheme[0][1]).startswith(PASSWORD_SCHEMES)
        return known and len(inner[1][1]) >= 16
    if tags[0] != INTEGER or len(inner[0][1]) != 1:
        return False
    if all(tag == INTEGER for tag in tags):
        # Version, then a modulus; a few small numbers are no key.
        return len(inner) in (6, 9) and all(len(value) for _, value in inner) and len(inner[1][1]) >= 32
    if tags[1] == OCTETS:
        return inner[0][1][0] == 1 and len(inner[1][1]) >= 16 and all(tag in (0xA0, 0xA1) and _nested(value) for tag, value in inner[2:])
    if tags[1] == SEQUENCE and len(tags) > 2 and tags[2] == OCTETS:
        algorithm = der_items(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == OBJECT_ID and len(inner[2][1]) >= 16 and _nested(inner[2][1])
    return False


def openssh_end(data: memoryview) -> int | None:
    """End of the OpenSSH key at the start: magic, cipher, kdf and options, number of keys, public keys and the private block."""
    fields, at, left = 0, len(OPENSSH), None
    while at + 4 <= len(data):
        value, at = int.from_bytes(data[at : at + 4]), at + 4
        fields += 1
        if fields == 4:
            if not 1 <= value <= 16:
                return None
            left = value + 1
            continue
        if at + value > len(data):
            return None
        at += value
        if left is not None:
            left -= 1
            if not left:
                return at
    return None


def keys_in(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of the keys in some bytes; none begins within another."""
    view, starts, found = memoryview(data), [m.start() for m in DER_HEAD.finditer(data)], []
    at = data.find(OPENSSH)
    while at >= 0:
        starts.append(at)
        at = data.find(OPENSSH, at + 1)
    end = 0
    for start in sorted(starts):
        if start < end:
            continue
        if data.startswith(OPENSSH, start):
            size = openssh_end(view[start:])
            end = start + size if size else end
        elif (place := der_length(view, start)) and is_der_key(view[place[0] : place[1]]):
            end = place[1]
        if end > start:
            found.append((start, end))
    return found


def is_key(data: bytes | None) -> bool:
    """Whether some bytes are a key, from the first to the last."""
    return data is not None and (0, len(data)) in keys_in(data)


def keys64(run: str) -> list[tuple[int, int]]:
    """(start, end) of the keys in a run of base64 characters without white space, padding included."""
    body = run.rstrip("=")
    found = set()
    for phase in range(4):
        part = body[phase:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        for start, end in keys_in(decode64(part) or b""):
            # Bytes of a group's middle do not begin with a character.
            if start % 3 == 0:
                upto = phase + -(-end * 4 // 3)
                found.add((phase + start // 3 * 4, len(run) if upto >= len(body) else upto))
    return sorted(found)


def keys_hex(run: str) -> list[tuple[int, int]]:
    """(start, end) of the keys in a run of hex digits."""
    found = set()
    for phase in range(2):
        part = run[phase : len(run) - (len(run) - phase) % 2]
        found |= {(phase + 2 * start, phase + 2 * end) for start, end in keys_in(bytes.fromhex(part))}
    return sorted(found)


_decoder = json.JSONDecoder()


def _object(text: str, start: int = 0) -> dict | None:
    """The JSON object that ``text`` is from ``start`` on, to its end."""
    try:
        value, end = _decoder.raw_decode(text, start)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) and end == len(text) else None


def _json64(text: str) -> str:
    data = decode64(text)
    return "" if data is None else data.decode("utf-8", "replace")


def header_start(text: str) -> int | None:
    """Where the header of a signed token begins in a run of characters that ends with it."""
    for phase in range(4):
        # A header reaches to the end, so all that begin in one phase are ends of one decoded text.
        if len(text) - phase < 4 or (len(text) - phase) % 4 == 1:
            continue
        # A character a byte, so that places stay; only names in ASCII matter.
        data = (decode64(text[phase:]) or b"").decode("latin-1")
        at = text.find(TOKEN_HEAD)
        while data and at >= 0:
            if (at - phase) % 4 == 0 and at >= phase:
                header = _object(data, (at - phase) // 4 * 3)
                if header is not None and isinstance(header.get("alg"), str):
                    return at
            at = text.find(TOKEN_HEAD, at + 1)
    return None


def tokens_in(run: str) -> list[tuple[int, int]]:
    """(start, end) of the signed tokens in a run: a header naming an algorithm, claims, a signature."""
    parts, starts, at = run.split("."), [], 0
    for part in parts:
        starts.append(at)
        at += len(part) + 1
    found, i = [], 0
    while i + 2 < len(parts):
        claims = _object(_json64(parts[i + 1])) if TOKEN_HEAD in parts[i] and parts[i + 1] else None
        start = header_start(parts[i]) if claims is not None else None
        if start is None:
            i += 1
            continue
        found.append((starts[i] + start, starts[i + 2] + len(parts[i + 2])))
        i += 3
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns, unsorted."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of decoded candidates with the structure of a key or token."""
    spans = [(m.start() + a, 3, m.start() + b) for m in DOTTED_RUN.finditer(text) if TOKEN_HEAD in m[0] for a, b in tokens_in(m[0])]
    marked = [(m.start(), 4, m.end()) for m in PEM.finditer(text) if is_key(decode64(m[2]))]
    for m in BASE64_RUN.finditer(text):
        # Places of the run's characters in the text, without line ends.
        places = [m.start() + i for i, c in enumerate(m[0]) if not c.isspace()] if "\n" in m[0] else range(m.start(), m.end())
        for a, b in keys64("".join(m[0].split())):
            start, end = places[a], places[b - 1] + 1
            if not any(first <= start < last for first, _, last in marked):
                spans.append((start, 5, end))
    spans += [(m.start() + a, 6, m.start() + b) for m in HEX_RUN.finditer(text) for a, b in keys_hex(m[0])]
    return spans + marked


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found = []
        for value in batch.column(batch.num_columns - 1):
            text = value.as_py() or ""
            spans = sorted(base_spans(text) + confirmed_spans(text))
            found.append([{"kind": KINDS[k], "start": start, "end": end} for start, k, end in spans])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(found, kind)], [*batch.schema.names[:-1], "spans"]
        )


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: id and ``spans``, an array of (kind, start, end) by start, then kind.

    Offsets count code points, ends are exclusive. Kinds ``assign``, ``access`` and ``hex`` are base
    patterns; ``token``, ``pem``, ``key64`` and ``keyhex`` have been confirmed by their structure.
    A null text is an empty one and has no spans. Repeated rows and rows with a null id are scanned
    each; other columns are ignored.
    """
    rows = docs.select(F.col(id_column), F.col(text_column).alias("_text"))
    span = T.StructType().add("kind", "string").add("start", "long").add("end", "long")
    schema = T.StructType([rows.schema[0], T.StructField("spans", T.ArrayType(span))])
    return rows.mapInArrow(_spans, schema)


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans that ``scan`` found."""

    def joined(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(parts, ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        id_column,
        *(count(kind) for kind in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["kind"].isin(*BASE))).cast("long").alias("n_confirmed"),
    )
