"""Secret scan with structural confirmation.

Three base patterns are matched as stated by their rule. Beyond them, base64 and hex runs are candidates
only: a candidate is reported when its decoded bytes have the structure of a key or token.

Kinds, in the order that breaks ties between spans with one start:
  assign  a named assignment with a value of 12 or more characters
  access  an access key id
  hex     a run of 16 or more lower-case hexadecimal digits
  jwt     header.payload.signature, where the header decodes to a JSON object with a string "alg"
          and the payload decodes to a JSON object; or an encrypted token of five parts, whose header has strings
          "alg" and "enc" and whose other parts decode, none but the encrypted key being empty
  der     base64 of either alphabet (also wrapped over lines, within PEM marks or without) or hex that decodes to a *private* key in ASN.1: PKCS#8,
          encrypted PKCS#8, PKCS#1, SEC1 or DSA, its declared lengths nested exactly to the end; or a PEM block
          whose headers declare a cipher and initial vector, over whole cipher blocks
  ssh     base64 (wrapped or not), PEM or hex that decodes to an OpenSSH private key, its length-prefixed fields ending exactly at the end

Certificates and public keys, SSH ones included, are no secrets and are left alone. Null text counts as empty; rows keep their
multiplicity, null doc_id included; equal rows get equal results. Spans are code points, end exclusive. Texts of any length
are scanned whole, one at a time, and each row stands alone, so skew and ties do not arise. An empty table gives no
rows. Other columns than doc_id and text are not read, whatever their names; ``redact`` passes them through and needs both.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import mapped
from ._text import slices

KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")
BASE_KINDS = KINDS[:3]
ORDER = {kind: i for i, kind in enumerate(KINDS)}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
ENCRYPTED = re.compile(r"(?<![A-Za-z0-9_-])(e[A-Za-z0-9_-]{15,}+)\.([A-Za-z0-9_-]*+)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)")
#: Lines may end as in a JSON string, with a backslash and n or r. Headers may come before the body.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:\s|\\[nr])*+(?:[A-Za-z-]+: [^\n\\]*(?:\n|\\r\\n|\\n))*+)([A-Za-z0-9+/=\s\\]+)-----END \1-----")
CIPHER = re.compile(r"Proc-Type: 4,ENCRYPTED.*DEK-Info: [A-Z0-9-]+,[0-9A-Fa-f]{16,32}\b", re.DOTALL)
ESCAPED = re.compile(r"\\[nr]")
#: Base64 that begins with a SEQUENCE or with the mark of OpenSSH keys.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:MI|MC|MD|ME|MF|MG|MH|b3BlbnNzaC1rZXktdjEA)[A-Za-z0-9+/_-]{26,}={0,2}(?![A-Za-z0-9+/=_-])")
NEXT_LINE = re.compile(r"(?:\r?\n|\\r\\n|\\n)[ \t]*([A-Za-z0-9+/_-]+={0,2})(?![A-Za-z0-9+/=_-])")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]763100)[0-9A-Fa-f]{38,}(?![0-9A-Fa-f])")
OPENSSH = b"openssh-key-v1\0"
#: Object identifiers of password-based encryption, PKCS#5 and PKCS#12.
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
INTEGER, OCTETS, OBJECT, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def from_base64(text: str) -> bytes | None:
    raw = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(raw) % 4 == 1:
        return None
    try:
        return base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_json_object(text: str, *needs: str) -> bool:
    """Whether text decodes to a JSON object in which all names of ``needs`` are strings."""
    raw = from_base64(text)
    if raw is None or raw[:1] != b"{":
        return False
    try:
        value = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(value, dict) and all(isinstance(value.get(name), str) for name in needs)


def members(raw: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end of content) of the ASN.1 values that fill raw[at:end] exactly; None where they don't."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n, at = raw[at], raw[at + 1], at + 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            n, at = int.from_bytes(raw[at : at + width]), at + width
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def nests(raw: bytes, values: list[tuple[int, int, int]]) -> bool:
    """Whether all constructed values are filled exactly by others."""
    todo = list(values)
    while todo:
        tag, start, end = todo.pop()
        if tag & 0x20:
            inner = members(raw, start, end)
            if inner is None:
                return False
            todo += inner
    return True


def private_key(raw: bytes) -> bool:
    """Whether raw is a private key in ASN.1."""
    top = members(raw, 0, len(raw))
    if top is None or len(top) != 1 or top[0][0] != SEQUENCE or not nests(raw, top):
        return False
    inner = members(raw, *top[0][1:]) or []
    tags = [tag for tag, _, _ in inner]

    def algorithm(value: tuple[int, int, int]) -> bytes:
        first = members(raw, *value[1:])
        return raw[first[0][1] : first[0][2]] if first and first[0][0] == OBJECT else b""

    if tags == [SEQUENCE, OCTETS]:
        return algorithm(inner[0]).startswith(PASSWORD_BASED) and inner[1][2] > inner[1][1]
    if tags[:1] != [INTEGER] or inner[0][2] - inner[0][1] != 1:
        return False
    version = raw[inner[0][1]]
    filled = all(end > start for _, start, end in inner)
    if tags[1:3] == [SEQUENCE, OCTETS]:
        return version <= 1 and filled and bool(algorithm(inner[1])) and set(tags[3:]) <= {0xA0, 0xA1, 0x81}
    if tags[1:2] == [OCTETS]:
        return version == 1 and filled and set(tags[2:]) <= {0xA0, 0xA1}
    return filled and set(tags[:9]) == {INTEGER} and (len(tags) == 9 and version == 0 or len(tags) == 10 and version == 1 or len(tags) == 6 and version == 0)


def openssh_key(raw: bytes) -> bool:
    """Whether raw is an OpenSSH private key: cipher, derivation and its options, number of keys, public keys, private part."""
    if not raw.startswith(OPENSSH):
        return False
    at, left = len(OPENSSH), 3
    while left:
        if at + 4 > len(raw):
            return False
        at, left = at + 4 + int.from_bytes(raw[at : at + 4]), left - 1
    keys = int.from_bytes(raw[at : at + 4])
    at, left = at + 4, keys + 1
    while left and at + 4 <= len(raw):
        at, left = at + 4 + int.from_bytes(raw[at : at + 4]), left - 1
    return keys > 0 and left == 0 and at == len(raw)


def key_kind(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    return "ssh" if openssh_key(raw) else "der" if private_key(raw) else None


def tokens(text: str) -> list[tuple[int, int, str]]:
    """Spans of tokens; where three parts are none, the next part may be a header too."""
    found: list[tuple[int, int, str]] = []
    m = JWT.search(text)
    while m:
        good = is_json_object(m[1], "alg") and is_json_object(m[2])
        if good:
            found.append((m.start(), m.end(), "jwt"))
        m = JWT.search(text, m.end() if good else m.start(2))
    m = ENCRYPTED.search(text)
    while m:
        good = is_json_object(m[1], "alg", "enc") and all(from_base64(part) is not None for part in m.groups()[1:])
        if good:
            found.append((m.start(), m.end(), "jwt"))
        m = ENCRYPTED.search(text, m.end() if good else m.end(1))
    return found


def wrapped_key(text: str, first: re.Match[str]) -> tuple[int, str] | None:
    """(end, kind) of a key that begins in the base64 of ``first`` and goes on over lines as wide, the last of which may be narrower.

    The length that a key in ASN.1 declares says on which line it ends; an OpenSSH key ends with the narrower line, or with the lines.
    """
    line, at, parts, n = first[0], first.end(), [first[0]], len(first[0])
    head = from_base64(line[:8])
    need = None
    if head[0] == SEQUENCE:
        width = head[1] & 0x7F if head[1] & 0x80 else 0
        if width > 4:
            return None
        need = -(-8 * (2 + width + (int.from_bytes(head[2 : 2 + width]) if width else head[1])) // 6)
        if n >= need:
            return None
    while (need is None or n < need) and len(parts[-1]) == len(line) and (m := NEXT_LINE.match(text, at)) and len(m[1]) <= len(line):
        parts.append(m[1])
        at, n = m.end(), n + len(m[1])
    kind = key_kind(from_base64("".join(parts))) if len(parts) > 1 and (need is None or n >= need) else None
    return (at, kind) if kind else None


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind as listed."""
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low or not low.isascii():
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "." in text:
        found += tokens(text)
    pem: list[tuple[int, int]] = []
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            raw = from_base64("".join(ESCAPED.sub(" ", m[3]).split()))
            kind = key_kind(raw) or ("der" if raw and len(raw) % 8 == 0 and "PRIVATE KEY" in m[1] and CIPHER.search(m[2]) else None)
            pem.append(m.span())
            if kind:
                found.append((m.start(), m.end(), kind))
    begins = [a for a, _ in pem]
    for m in BASE64.finditer(text):
        i = bisect_right(begins, m.start())
        if i and m.start() < pem[i - 1][1]:
            continue
        if kind := key_kind(from_base64(m[0])):
            found.append((m.start(), m.end(), kind))
        elif over_lines := wrapped_key(text, m):
            found.append((m.start(), *over_lines))
    for m in HEX_KEY.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := key_kind(bytes.fromhex(m[0]))):
            found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]], s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by [kind]; overlapping spans become one, named after the first."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed (spans that only the method adds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            cols: list[list] = [[] for _ in range(6)]
            for text in part.column("text").to_pylist():
                spans = spans_of(text or "")
                base = [s for s in spans if s[2] in BASE_KINDS]
                for col, kind in zip(cols, BASE_KINDS):
                    col.append(sum(s[2] == kind for s in base))
                cols[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[4].append(joined(spans))
                cols[5].append(len(spans) - len(base))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns; text with its secrets replaced, n_chars (where an integer column of that name exists) brought in line."""
    counts = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            at = part.schema.get_field_index("text")
            old = part.column(at).to_pylist()
            new = [t if t is None or not (spans := spans_of(t)) else redacted(t, spans) for t in old]
            arrays = list(part.columns)
            arrays[at] = pa.array(new, part.schema.field(at).type)
            if counts:
                k = part.schema.get_field_index("n_chars")
                arrays[k] = pa.array([c if a is b or b is None else len(b) for a, b, c in zip(old, new, arrays[k].to_pylist())], part.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return mapped(docs, run, docs.schema)
