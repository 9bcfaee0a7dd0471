"""Secret scans: candidate patterns, then structural confirmation of encoded keys and tokens.

Base kinds are plain patterns. The confirmed kinds are reported only after the
candidate was decoded and its structure checked: key encodings (nested DER lengths,
length-prefixed key containers), armoured private keys, and signed-token headers.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "pem", "key64", "keyhex", "token")
N_BASE = 3
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----([^-]*+(?:-(?!----)[^-]*+)*+)-----END \1-----")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
#: Lines of base64, the ends of which may be written out as \\n or \\r\\n.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40,}+(?:(?:\r?\n|(?:\\r)?\\n)[\x20\t]*+[A-Za-z0-9+/]++={0,2})++")
LINE = re.compile(r"(?:\\[rn]|\s)*+([A-Za-z0-9+/]++={0,2})")
CUT_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----((?:[A-Za-z0-9+/=\s]|\\[rn])*+)")
COLON_HEX = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::\s*+[0-9A-Fa-f]{2}){31,}+(?![0-9A-Fa-f])")
#: What armour says of its cipher: name and initial vector.
CIPHER = re.compile(r"DEK-Info:\s*([A-Z0-9-]+),([0-9A-Fa-f]+)")
LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")
#: A header begins with a brace and a quotation mark or white space.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Object identifiers of encryption by password begin so (PKCS#5, PKCS#12).
BY_PASSWORD = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")
OPENSSH = b"openssh-key-v1\0"
REDACTED = "[REDACTED]"


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, stop) of the element at a place, or None if its length does not fit."""
    if at + 2 > end:
        return None
    tag, size, start = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or start + n > end or data[start] == 0:
            return None
        size, start = int.from_bytes(data[start : start + n], "big"), start + n
        if size < 0x80:
            return None
    return (tag, start, start + size) if start + size <= end else None


def _elements(data: bytes, start: int, stop: int) -> list[tuple[int, int, int]] | None:
    out = []
    while start < stop:
        if (one := _tlv(data, start, stop)) is None:
            return None
        out.append(one)
        start = one[2]
    return out


def is_private_der(data: bytes) -> bool:
    """A whole SEQUENCE with the members of a PKCS#1, SEC1 or PKCS#8 private key, plain or encrypted, nested lengths exact."""
    top = _tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    inner = _elements(data, top[1], top[2])
    tags = [t for t, _, _ in inner or []]
    if tags == [0x30, 0x04]:
        algorithm = _elements(data, *inner[0][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06 and data[slice(*algorithm[0][1:])].startswith(BY_PASSWORD)
    if tags[:1] != [0x02]:
        return False
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return True
    if tags[1:2] == [0x04]:
        return len(tags) > 2 and tags[2] in (0xA0, 0xA1) and _elements(data, *inner[2][1:]) is not None
    if tags[1:3] == [0x30, 0x04]:
        algorithm = _elements(data, *inner[1][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06 and _tlv(data, *inner[2][1:]) is not None
    return False


def is_openssh_key(data: bytes) -> bool:
    """The container's magic, three strings, a count, that many public keys and a private part, nothing after."""
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)

    def skip(n: int) -> bool:
        """Pass n length-prefixed strings."""
        nonlocal at
        for _ in range(n):
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at <= len(data)

    if not skip(3) or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 16 and skip(keys + 1) and at == len(data)


def is_private_key(data: bytes) -> bool:
    return is_private_der(data) or is_openssh_key(data)


def from_base64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """The header decodes to a JSON object that names an algorithm other than none, the second part decodes, and there is a signature."""
    parts = text.split(".")
    head = from_base64(parts[0])
    if head is None or not 3 <= len(parts) <= 5 or from_base64(parts[1]) is None:
        return False
    try:
        said = json.loads(head)
    except (ValueError, RecursionError):
        return False
    return isinstance(said, dict) and isinstance(said.get("alg"), str) and said["alg"].lower() != "none" and parts[2] != ""


def armour_holds_key(body: str) -> bool:
    """Line ends may be written out as \\n and \\r, as in JSON; header lines are passed over.

    What a header calls encrypted has to name a cipher, with an initial vector of one
    block, and to be of whole blocks.
    """
    body = re.sub(r"\\+[nr]", "\n", body)
    data = from_base64("".join("".join(x for x in body.split("\n") if ":" not in x).split()))
    if data is None:
        return False
    if (cipher := CIPHER.search(body)) and "Proc-Type:" in body:
        block = 8 if "DES" in cipher[1] else 16
        return len(cipher[2]) == 2 * block and len(data) >= 32 and len(data) % block == 0
    return is_private_key(data)


def begins_private_key(data: bytes) -> bool:
    """The head of a private key whose end is lost: the container's magic, or a SEQUENCE longer than what is left with a version and a fitting element after it."""
    if data.startswith(OPENSSH):
        return len(data) >= 64
    if len(data) < 32 or data[0] != 0x30 or not 0x81 <= data[1] <= 0x84:
        return False
    at = 2 + data[1] - 0x80
    return int.from_bytes(data[2:at], "big") > len(data) - at and data[at : at + 2] == b"\x02\x01" and data[at + 2] <= 1 and data[at + 3] in (0x02, 0x04, 0x30)


def cut_armour_end(text: str, m: re.Match) -> int | None:
    """Where armour without its last line ends, if its lines hold a private key or the head of one."""
    end = m.start(1) + len(re.sub(r"(?:\\[rn]|\s)++\Z", "", m[1]))
    body = re.sub(r"\\[rn]|\s", "", m[1]).rstrip("=")
    data = from_base64(body[: len(body) - (len(body) % 4 == 1)])
    return end if data is not None and (is_private_key(data) or begins_private_key(data)) else None


def keys_after_path(run: str) -> Iterator[int]:
    """Places in a run of base64, after a slash, from which an encoded key reaches exactly to the run's end."""
    body = run.rstrip("=")
    for m in re.finditer(r"/(?=M|b3BlbnNzaC1rZXktdjEA)", body):
        at = m.end()
        if body[at] == "M":
            head = base64.b64decode(body[at : at + 8].replace("-", "+").replace("_", "/").ljust(8, "A"))
            wide = head[1] - 0x80 if head[1] > 0x80 else 0
            size = 2 + wide + (int.from_bytes(head[2 : 2 + wide], "big") if wide else head[1])
            if wide > 4 or -(-size * 4 // 3) != len(body) - at:
                continue
        yield at


def wrapped_key(m: re.Match) -> tuple[int, int] | None:
    """The place of a private key in lines of one width and a last one of at most that width."""
    lines = list(LINE.finditer(m[0]))
    width = len(lines[0][1])
    n = next((k for k, x in enumerate(lines) if len(x[1]) != width), len(lines))
    longest = n + (n < len(lines) and len(lines[n][1]) < width)
    for take in sorted({n, longest}, reverse=True):
        data = from_base64("".join(x[1] for x in lines[:take]))
        if take > 1 and data is not None and is_private_key(data):
            return m.start(), m.start() + lines[take - 1].end()
    return None


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) in code points, in order."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    taken: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        taken = [m.span() for m in PEM.finditer(text) if armour_holds_key(m[2])]
        begun = {a for a, _ in taken}
        cut = ((m.start(), cut_armour_end(text, m)) for m in CUT_PEM.finditer(text) if m.start() not in begun)
        taken = sorted(taken + [(a, end) for a, end in cut if end is not None])
        found += [(a, 3, b) for a, b in taken]
    wrapped = [span for m in WRAPPED.finditer(text) if not inside(taken, m.start()) and (span := wrapped_key(m))]
    found += [(a, 4, b) for a, b in wrapped]
    taken = sorted(taken + wrapped)
    for m in BASE64.finditer(text):
        if inside(taken, m.start()):
            continue
        data = from_base64(m[0])
        if data is not None and (is_private_key(data) or (b"PRIVATE KEY-----" in data and any(armour_holds_key(x[2]) for x in PEM.finditer(data.decode("latin-1"))))):
            found.append((m.start(), 4, m.end()))
        else:
            after = (at for at in keys_after_path(m[0]) if (part := from_base64(m[0][at:])) is not None and is_private_key(part))
            found += [(m.start() + at, 4, m.end()) for at in after]
    for m in LONG_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and is_private_key(bytes.fromhex(m[0])):
            found.append((m.start(), 5, m.end()))
    found += [(m.start(), 5, m.end()) for m in COLON_HEX.finditer(text) if is_private_key(bytes.fromhex(re.sub(r"[:\s]", "", m[0])))]
    found += [(m.start(), 6, m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[0])]
    return sorted(found)


def inside(spans: list[tuple[int, int]], place: int) -> bool:
    """Whether one of disjoint spans, in order, holds a place."""
    k = bisect.bisect_right(spans, place, key=lambda s: s[0])
    return k > 0 and place < spans[k - 1][1]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each maximal run of spans replaced by a mark."""
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end:
            out += [text[at:a], REDACTED]
        at = end = max(end, b)
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs with counts by base kind, a digest of the base spans, and all spans.

    Offsets are code points, ends exclusive. A null text counts as empty (no spans,
    digest of the empty string); repeated rows are scanned as often as they occur;
    an empty table gives no rows; other columns are ignored; very long texts are scanned
    whole, in time that grows with their length, one at a time in a task's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                spans = spans_of(text.as_py() or "")
                base = [x for x in spans if x[1] < N_BASE]
                counts = [sum(k == kind for _, k, _ in base) for kind in range(N_BASE)]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans) - len(base)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by a mark and n_chars, where present, kept in step.

    Nulls in text and n_chars stay null; repeated rows stay; an empty table gives none;
    other columns, whatever their names, pass through; very long texts are treated whole.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redact(t, spans_of(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
