"""Secret scan with structural confirmation.

Base kinds are found by pattern (assign, access, hex). The method then decodes base64, base64url and hex
candidates and parses what they hold before it reports a span: DER private keys by their nested lengths
(``der``), OpenSSH private keys by their length-prefixed fields (``ssh``), and signed tokens by the JSON of
their header and payload (``jwt``). Random strings of the same alphabets are not reported by the method.

Candidates are runs in one line, PEM bodies (header fields before them are skipped), and runs wrapped over
lines without a PEM frame; a line break may also be written as backslash and letter. A wrapped run ends where
the key's own outermost length says, so that words on the next line do no harm. A PEM body whose header fields
say that it is encrypted cannot be parsed; it counts (``der``) if it is whole blocks of the named vector's size.

Scale: one pass, no shuffle; texts reach Python in Arrow batches and only spans come back. Memory follows a
batch of texts. Every text is scanned whole.

Edge cases: null text is empty (no spans); repeated rows get equal results; positions count code points, the
end is exclusive; other columns stay as they are.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapart.llm.common import text_of

#: Fixed patterns of the base kinds; letters of the keywords match in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Kinds in the order of their listing; spans with one start follow it.
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "jwt", "der", "ssh"]

#: Candidates of the method. Repeats are possessive, so that a long text is scanned in linear time.
RUN64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{48,}={0,2}")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----((?:(?:\\[rn]|\s)*+[A-Za-z-]++: [^\n\\]*+)*+)((?:[A-Za-z0-9+/=\s]++|\\[rn])++)-----END")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M|b3Bl)[A-Za-z0-9+/]{40,76}+(?:(?:\r?\n|(?:\\r)?\\n)[\x20\t]*+[A-Za-z0-9+/]++={0,2}+)++")
VECTOR = re.compile(r"DEK-Info: *[A-Z0-9-]+,([0-9A-Fa-f]{16,32})(?![0-9A-Fa-f])")
RUN16 = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{80,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)?")
BREAK = re.compile(r"\\[rn]|\s+")

SPANS = "array<struct<kind:string,start:int,end:int>>"


def decode64(run: str) -> bytes:
    """Bytes of a base64 or base64url run, padding optional; empty if it is neither."""
    body = BREAK.sub("", run).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the elements that fill data exactly; None if a length does not fit."""
    at, found = 0, []
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            width = length & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            length, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + length > len(data):
            return None
        found.append((tag, data[at : at + length]))
        at += length
    return found


INTEGER, OCTETS, OID, SEQUENCE, CURVE = 0x02, 0x04, 0x06, 0x30, 0xA0
#: The object identifiers of password-based encryption, PKCS #5 and PKCS #12.
ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def der_key(data: bytes) -> bool:
    """Whether data is a private key: RSA (nine integers), PKCS#8 plain or encrypted, or an elliptic-curve key."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != SEQUENCE:
        return False
    parts = der_items(top[0][1])
    if parts and [tag for tag, _ in parts] == [SEQUENCE, OCTETS]:
        algorithm = der_items(parts[0][1])
        return bool(algorithm) and algorithm[0][0] == OID and algorithm[0][1].startswith(ENCRYPTION)
    if not parts or parts[0][0] != INTEGER:
        return False
    tags = [tag for tag, _ in parts]
    if len(parts) >= 9 and tags[:9] == [INTEGER] * 9:
        return len(parts[1][1]) >= 32
    if tags[1:3] == [SEQUENCE, OCTETS]:
        algorithm = der_items(parts[1][1])
        return bool(algorithm) and algorithm[0][0] == OID and bool(der_items(parts[2][1]))
    if tags[1:2] == [OCTETS] and parts[0][1] == b"\x01" and len(parts[1][1]) >= 16:
        return len(parts) == 2 or (tags[2] in (CURVE, CURVE + 1) and der_items(parts[2][1]) is not None)
    return False


def der_end(data: bytes) -> int:
    """Bytes of the element data begins with, by its length field; 0 if data does not begin with a sequence."""
    if len(data) < 6 or data[0] != SEQUENCE:
        return 0
    width = data[1] & 0x7F if data[1] & 0x80 else 0
    if width > 4:
        return 0
    return 2 + width + (int.from_bytes(data[2 : 2 + width], "big") if width else data[1])


def ssh_end(data: bytes) -> int:
    """Bytes of the OpenSSH private key data begins with, 0 for none: magic, three strings, key count, public and private strings."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return 0
    at = len(magic)

    def string() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        length = int.from_bytes(data[at : at + 4], "big")
        at += 4 + length
        return data[at - length : at] if at <= len(data) else None

    if any(string() is None for _ in range(3)) or at + 4 > len(data):
        return 0
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return at if 1 <= keys <= 16 and all(string() for _ in range(keys)) and string() is not None else 0


def key_kind(data: bytes) -> int:
    """Place in KINDS of the private key that data is; 0 for none."""
    return 4 if der_key(data) else 5 if data and ssh_end(data) == len(data) else 0


def wrapped_key(run: str) -> tuple[int, int]:
    """(kind, end in run) of the key a run over several lines begins with; kind 0 for none."""
    body = BREAK.sub("", run).partition("=")[0]
    whole = len(body) // 4 * 4
    data = decode64(body[:whole]) + decode64(body[whole:])
    size = der_end(data) or ssh_end(data)
    kind = key_kind(data[:size]) if 0 < size <= len(data) else 0
    if not kind:
        return 0, 0
    left, at = (size * 4 + 2) // 3, 0
    for gap in BREAK.finditer(run):
        if gap.start() - at >= left:
            break
        left -= gap.start() - at
        at = gap.end()
    end = at + left
    while run[end : end + 1] == "=":
        end += 1
    return kind, end


def signed_token(run: str) -> bool:
    """Whether header and payload of a dotted token are JSON objects and the header names an algorithm."""
    parts = run.split(".")
    try:
        header, payload = (json.loads(decode64(p)) for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(payload, dict) and isinstance(header.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def edge(breaks: list[tuple[int, int]], at: int) -> int:
    """Where at comes to lie when the breaks that touch it, one after the other, are passed over."""
    for start, end in breaks:
        if at not in (start, end):
            break
        at = end if at == start else start
    return at


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    found = []
    if "eyJ" in text:
        found += [(m.start(), 3, m.end()) for m in TOKEN.finditer(text) if signed_token(m.group())]
    for m in PEM.finditer(text) if "PRIVATE KEY" in text else ():
        data = decode64(m.group(2))
        vector = VECTOR.search(m.group(1))
        sealed = vector and "ENCRYPTED" in m.group(1) and len(data) >= 64 and len(data) % (len(vector.group(1)) // 2) == 0
        kind = 4 if sealed else key_kind(data)
        if kind:
            inner = [b.span() for b in BREAK.finditer(m.group(2))]
            found.append((m.start(2) + edge(inner, 0), kind, m.start(2) + edge(inner[::-1], len(m.group(2)))))
    for m in RUN64.finditer(text):
        found += [(m.start(), kind, m.end()) for kind in [key_kind(decode64(m.group()))] if kind]
    for m in WRAPPED.finditer(text):
        kind, end = wrapped_key(m.group())
        found += [(m.start(), kind, m.start() + end)] if kind else []
    for m in RUN16.finditer(text):
        run = m.group()
        found += [(m.start(), kind, m.end()) for kind in [key_kind(bytes.fromhex(run[: len(run) // 2 * 2]))] if kind]
    return found


def find_secrets(text: str) -> list[dict]:
    """Spans of all kinds by start, then kind as listed; each once."""
    return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted({*base_spans(text), *confirmed_spans(text)})]


def secret_spans(text: Column) -> Column:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(SPANS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([find_secrets(t.as_py() or "") for t in batch], kind)

    return scan(text)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs with ``secrets``: array of (kind, start, end)."""
    return docs.withColumn("secrets", secret_spans(text_of()))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    spans = F.col("secrets")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )
