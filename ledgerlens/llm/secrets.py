"""Secret scans: patterns, and encodings that are decoded and parsed before they are reported."""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, steps

#: Kinds in the order in which spans of one start are listed; the first three are plain patterns.
KINDS = ("assign", "access", "hex", "jwt", "der", "openssh")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Candidates of the decoders: dotted base64url segments that open an object; base64 over one or more lines; hex.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*){2,4}")
LINES = re.compile(r"[A-Za-z0-9+/_-]{32,}(?:(?:\r?\n|\\n)[A-Za-z0-9+/_-]+)*={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
LONG_HEX = re.compile(r"[0-9A-Fa-f]{64,}")

#: What a text must hold for any span of the kind, for the engine that sees whole columns (a superset of the matches).
NEEDS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "jwt": r"ey[A-Za-z0-9_-]{8,}\.",
    "der": r"[A-Za-z0-9+/_-]{32}",
}

#: Bytes of the signatures of each algorithm; 0 where the key's size decides (fixed values).
SIGNATURES = {
    "none": 0, "HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132,
    "EdDSA": 64, "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None,
}

#: Contents of the object identifiers that are looked at (fixed values).
OIDS = {
    bytes.fromhex("2a864886f70d010101"): "rsa",
    bytes.fromhex("2a8648ce3d0201"): "ec",
    bytes.fromhex("2a8648ce380401"): "dsa",
    bytes.fromhex("2b656e"): "x25519",
    bytes.fromhex("2b656f"): "x448",
    bytes.fromhex("2b6570"): "ed25519",
    bytes.fromhex("2b6571"): "ed448",
}
SEALED = bytes.fromhex("2a864886f70d0105")
OPENSSH = b"openssh-key-v1\0"


# ---- decoders: small parsers of one candidate


def decoded(text: str) -> bytes | None:
    """Base64 in either alphabet, with or without padding; None if it is none."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def _object(segment: str) -> dict | None:
    try:
        got = json.loads((decoded(segment) or b"").decode())
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def signed_token(text: str) -> bool:
    """Header and claims are objects, the header names an algorithm, and the signature has its length.
    Five segments are an encrypted token: its header names both algorithms and its parts decode."""
    part = text.split(".")
    head = _object(part[0])
    if head is None or not isinstance(head.get("alg"), str):
        return False
    if len(part) == 5:
        return isinstance(head.get("enc"), str) and all(decoded(p) is not None for p in part[1:]) and all(part[2:])
    if len(part) != 3 or head["alg"] not in SIGNATURES or _object(part[1]) is None:
        return False
    mark, need = decoded(part[2]), SIGNATURES[head["alg"]]
    return mark is not None and (len(mark) >= 64 if need is None else len(mark) == need)


def header(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the element at ``at``; None unless its length is in shortest form and fits."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 0x80 or n >> (8 * (k - 1)) == 0:
            return None
    return (tag, at, at + n) if at + n <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, bytes]] | None:
    """Tags and contents of the elements that fill at..end exactly."""
    out = []
    while at < end:
        got = header(data, at, end)
        if got is None or len(out) == 16:
            return None
        out.append((got[0], data[got[1] : got[2]]))
        at = got[2]
    return out


def _numbers(parts: list[tuple[int, bytes]]) -> list[int] | None:
    if any(tag != 0x02 or not value for tag, value in parts):
        return None
    return [int.from_bytes(value, "big", signed=True) for _, value in parts]


def _rsa(parts) -> bool:
    """Version, modulus, exponents, primes and their remainders: the primes must make the modulus."""
    n = _numbers(parts[:9]) if len(parts) >= 9 else None
    return n is not None and n[0] in (0, 1) and n[1] > 0 and (n[0] == 1 or len(parts) == 9) and n[4] * n[5] == n[1]


def _ec(parts) -> bool:
    if len(parts) < 2 or parts[0] != (0x02, b"\x01") or parts[1][0] != 0x04 or not 16 <= len(parts[1][1]) <= 72:
        return False
    return all(tag in (0xA0, 0xA1) and elements(value, 0, len(value)) for tag, value in parts[2:])


def _wrapped(parts) -> bool:
    """Version, algorithm, and the key of that algorithm in an octet string."""
    if len(parts) < 3 or parts[0] not in ((0x02, b"\0"), (0x02, b"\x01")) or parts[1][0] != 0x30 or parts[2][0] != 0x04:
        return False
    what = elements(parts[1][1], 0, len(parts[1][1]))
    if not what or what[0][0] != 0x06 or what[0][1] not in OIDS:
        return False
    key = parts[2][1]
    inner = header(key, 0, len(key))
    if inner is None or inner[2] != len(key):
        return False
    body = key[inner[1] :]
    match OIDS[what[0][1]]:
        case "rsa":
            return inner[0] == 0x30 and _rsa(elements(body, 0, len(body)) or [])
        case "ec":
            return inner[0] == 0x30 and _ec(elements(body, 0, len(body)) or [])
        case "dsa":
            return inner[0] == 0x02 and len(body) > 0
        case _:
            return inner[0] == 0x04 and len(body) in (32, 56, 57)


def _sealed(parts) -> bool:
    """An encrypted key: a password-based scheme, then the octets."""
    if len(parts) != 2 or parts[0][0] != 0x30 or parts[1][0] != 0x04 or len(parts[1][1]) < 16:
        return False
    what = elements(parts[0][1], 0, len(parts[0][1]))
    return bool(what) and what[0][0] == 0x06 and what[0][1].startswith(SEALED)


def _dsa(parts) -> bool:
    n = _numbers(parts) if len(parts) == 6 else None
    return n is not None and n[0] == 0 and all(x > 0 for x in n[1:]) and (n[1] - 1) % n[2] == 0


def der_length(data: bytes) -> int:
    """Length of the private key that ``data`` starts with, in bytes; 0 if it starts with none."""
    top = header(data, 0, len(data))
    if top is None or top[0] != 0x30:
        return 0
    parts = elements(data, top[1], top[2])
    return top[2] if parts and (_rsa(parts) or _ec(parts) or _wrapped(parts) or _sealed(parts) or _dsa(parts)) else 0


def openssh_length(data: bytes) -> int:
    """Length of the key file: cipher, derivation, its options, public keys and the private part, each after its length."""
    if not data.startswith(OPENSSH):
        return 0
    at = len(OPENSSH)

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        got, at = data[at + 4 : at + 4 + n], at + 4 + n
        return got if at <= len(data) else None

    cipher, derivation, options = field(), field(), field()
    keys = int.from_bytes(data[at : at + 4], "big")
    if not cipher or not derivation or options is None or not 1 <= keys <= 16 or at + 4 > len(data):
        return 0
    at += 4
    for _ in range(keys):
        if not field():
            return 0
    private = field()
    if not private or len(private) % 8:
        return 0
    return at if cipher != b"none" or private[:4] == private[4:8] else 0


def keys_in(text: str, run: re.Match) -> list[tuple[str, int, int]]:
    """Keys in a run of base64 lines: every line may begin one, and the lengths in it say where it ends."""
    lines = [(m.start(), m.end()) for m in LINE.finditer(text, run.start(), run.end())]
    # the n of an escaped line break is not part of the line
    lines = [(a + 1, b) if text[a - 1 : a + 1] == "\\n" else (a, b) for a, b in lines]
    out, done = [], run.start()
    for k, (a, _) in enumerate(lines):
        if a < done or text[a] not in "Mb":  # a sequence, or the name of the format
            continue
        joined = "".join(text[p:q] for p, q in lines[k:])
        data = decoded(joined[: len(joined) // 4 * 4]) or b""
        rest = decoded(joined)
        data = rest if rest is not None else data
        for kind, n in (("der", der_length(data)), ("openssh", openssh_length(data))):
            if n:
                need = -(-n * 4 // 3)
                for p, q in lines[k:]:
                    if need <= q - p:
                        break
                    need -= q - p
                done = p + need
                while done < run.end() and text[done] == "=":
                    done += 1
                out.append((kind, a, done))
                break
    return out


def spans(text: str, kinds: frozenset[str] | set[str] = frozenset(NEEDS)) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start and kind; code points, end exclusive. ``kinds``: what the text may hold."""
    out = []
    if "assign" in kinds:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "access" in kinds:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if "hex" in kinds:
        out += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    if "jwt" in kinds:
        out += [("jwt", *m.span()) for m in TOKEN.finditer(text) if signed_token(m[0])]
    if "der" in kinds:
        for run in LINES.finditer(text):
            out += keys_in(text, run)
        for m in LONG_HEX.finditer(text):
            n = der_length(bytes.fromhex(m[0][: len(m[0]) // 2 * 2])) if m[0].startswith("30") else 0
            out += [("der", m.start(), m.start() + 2 * n)] if n else []
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ---- the operator

SPAN = T.ArrayType(T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()))


def find_secrets(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The rows with their secrets' spans (kind, start, end; code points, end exclusive) in a further column.

    Kinds ``assign``, ``access`` and ``hex`` are plain patterns. What the method adds is decoded
    and parsed before it is reported: ``jwt`` (signed or encrypted tokens), ``der`` (private keys in base64 or hex)
    and ``openssh`` (key files). A column of texts is searched for what each kind needs first; only texts
    that have it are matched one by one. No row moves: there is no shuffle.

    ``keep``: the columns to return, all by default. The new column is ``spans``, with underscores
    in front where the rows have one of that name.

    Defined cases: null and empty texts have no spans; rows without an id and repeated rows are scanned
    like any others; an empty table stays empty; further columns pass unchanged. Bytes that
    are not UTF-8 count as one code point each run, as the decoder replaces them.
    """
    keep = docs.columns if keep is None else keep
    (out,) = fresh(docs, "spans")
    (body,) = fresh(docs, "_scanned")
    rows = docs.select(*keep, F.col("text").alias(body))
    width = len(keep)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = T.StructType([*rows.schema.fields[:width], T.StructField(out, SPAN)])

    def scan(batches):
        for batch, text in steps(batches, column=body):
            may = {k: pc.match_substring_regex(text, need).to_pylist() for k, need in NEEDS.items()}
            raw = text.cast(pa.binary())
            found = [[] for _ in range(len(text))]
            for i in range(len(text)):
                kinds = {k for k, hit in may.items() if hit[i]}
                if kinds:
                    got = spans(raw[i].as_py().decode("utf-8", "replace"), kinds)
                    found[i] = [{"kind": k, "start": a, "end": b} for k, a, b in got]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(found, kind)], [*batch.schema.names[:width], out])

    return rows.mapInArrow(scan, schema)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
