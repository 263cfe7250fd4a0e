"""Secret scans with structural confirmation.

Base kinds are found by pattern: assign, access, hex. The method adds what it can confirm by structure: candidates
of base64 or hex are decoded, and reported as ``der`` (nested definite lengths that fill the candidate exactly, of the form
of a private key), ``ssh`` (the container of an OpenSSH private key) or ``jwt`` (a header that is JSON with ``alg``, a payload
that is JSON, and a third part); ``pem`` is an armoured block whose body is der or ssh. Public keys and certificates have such
structures too and are no secrets: they are not reported.
Spans are in code points, end exclusive; a confirmed span may cover a base one, which stays.

Defined results: a null text has no spans (and the digest of the empty string); repeated rows are scanned each;
an empty table gives no rows; texts are scanned whole whatever their length; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

KINDS = ("assign", "access", "hex", "jwt", "der", "ssh", "pem")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: Greedy runs from a fixed start, so asking for the least length in the pattern finds the same matches as dropping short ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
DOTTED = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,}")
#: Where a header can begin in a part: at its start or after a mark, with a character that base64 of an open brace or of white space begins with.
HEAD = re.compile(r"(?:^|(?<=[_-]))(?=[eICD][A-Za-z0-9_-]{7})")
B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/=_-])")
#: Where a structure can begin inside a run: after one of its marks, with the first characters of a sequence of definite length or of the
#: container's name. A wrapped body begins like that and has lines of one length.
INNER = re.compile(r"(?<=[+/_-])(?=M[A-I]|b3BlbnNzaC1rZXktdjE)")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?=M[A-I]|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/]{60,76}(?:\r?\n[A-Za-z0-9+/]{60,76})*\r?\n[A-Za-z0-9+/]{1,76}={0,2}(?![A-Za-z0-9+/=])")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){16,}(?![0-9A-Fa-f])")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----\s+([A-Za-z0-9+/=\s]{16,}?)\s*-----END \1-----")
ASSIGN_HINT = re.compile(r"[:=]")


def decoded(candidate: str) -> bytes | None:
    """Base64 in either alphabet, padded or not; None if it is not canonical."""
    body = candidate.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """The DER elements that fill ``data`` exactly, or None. Lengths must be definite and minimal."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data) or data[at] == 0:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
            if n < 128:
                return None
        if at + n > len(data) or tag & 0x1F == 0x1F or tag == 0:
            return None
        body = data[at : at + n]
        if tag & 0x20 and (depth > 8 or elements(body, depth + 1) is None):
            return None
        out.append((tag, body))
        at += n
    return out


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE in one of the forms of private keys: a version of 0 or 1, then at least one integer or octet string of 16 bytes or
    more (RSA, EC, DSA and PKCS 8); or an algorithm and an octet string of as many (an encrypted key)."""
    top = elements(data) if len(data) >= 16 and data[0] == 0x30 else None
    inner = elements(top[0][1]) if top and len(top) == 1 else None
    if not inner or len(inner) < 2:
        return False
    if inner[0] in ((2, b"\0"), (2, b"\1")):
        return any(tag in (2, 4) and len(x) >= 16 for tag, x in inner[1:])
    algorithm = elements(inner[0][1]) if inner[0][0] == 0x30 else None
    return len(inner) == 2 and bool(algorithm) and algorithm[0][0] == 6 and inner[1][0] == 4 and len(inner[1][1]) >= 16


def is_ssh_key(data: bytes) -> bool:
    return data.startswith(b"openssh-key-v1\0")


def der_length(head: bytes) -> int:
    """The bytes that a sequence takes whole, by its header; 0 if it is none."""
    if len(head) < 6 or head[0] != 0x30:
        return 0
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    return 2 + head[1] if not k and head[1] < 0x80 else 2 + k + int.from_bytes(head[2 : 2 + k], "big") if 1 <= k <= 4 else 0


def within(run: str) -> tuple[int, int, str] | None:
    """(start, end, kind) of a structure in a run of base64: the whole run, else what begins at an inner mark and is as long as its header says
    (the container: up to the run's end)."""
    if kind := structure(decoded(run)):
        return 0, len(run), kind
    for at in (0, *(m.end() for m in INNER.finditer(run))):
        n = der_length(decoded(run[at : at + 8]) or b"")
        if n:
            end = at + (-(-n // 3) * 4 if run[at : at + -(-n // 3) * 4].endswith("=") else -(-n * 4 // 3))
            ends_there = end >= len(run.rstrip("=")) or run[end] in "+/_-="
            if end <= len(run) and ends_there and structure(decoded(run[at:end])):
                return at, end, "der"
        elif at and (kind := structure(decoded(run[at:]))):
            return at, len(run), kind
    return None


def tokens(text: str) -> list[tuple[int, int, str]]:
    """Signed tokens: three parts between dots; a header is tried wherever one can begin, also after other parts and after a mark within one."""
    out = []
    for run in DOTTED.finditer(text):
        parts, i, at = run[0].split("."), 0, run.start()
        while i + 2 < len(parts):
            rest = f".{parts[i + 1]}.{parts[i + 2]}"
            starts = (m.start() for m in HEAD.finditer(parts[i])) if len(parts[i + 1]) > 1 else ()
            begin = next((s for s in starts if is_jwt(parts[i][s:] + rest)), None)
            if begin is None:
                at += len(parts[i]) + 1
                i += 1
                continue
            end = at + len(parts[i]) + len(rest)
            out.append((at + begin, end, "jwt"))
            at, i = end + 1, i + 3
    return out


def is_jwt(token: str) -> bool:
    head, body, _ = token.split(".")
    try:
        h, b = (json.loads(decoded(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(b, dict)


def structure(data: bytes | None) -> str:
    return "" if not data else "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else ""


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    if not text:
        return []
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] if ASSIGN_HINT.search(text) else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if text.count(".") > 1:
        out += tokens(text)
    for m in B64.finditer(text):
        if found := within(m[0]):
            out.append((m.start() + found[0], m.start() + found[1], found[2]))
    for m in HEX_ANY.finditer(text):
        if kind := structure(bytes.fromhex(m[0])):
            out.append((m.start(), m.end(), kind))
    if "-----BEGIN" in text:
        out += [(m.start(), m.end(), "pem") for m in PEM.finditer(text) if structure(decoded("".join(m[2].split())))]
    for m in WRAPPED.finditer(text):
        if (kind := structure(decoded("".join(m[0].split())))) and not any(k == "pem" and a <= m.start() < b for a, b, k in out):
            out.append((m.start(), m.end(), kind))
    return sorted(set(out), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan_column(text):
    @F.pandas_udf("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            found = spans(t)
            base = [s for s in found if s[2] in KINDS[:3]]
            joined = [",".join(f"{k}:{a}:{b}" for a, b, k in x) for x in (base, found)]
            rows.append((*(sum(s[2] == k for s in base) for k in KINDS[:3]), hashlib.sha256(joined[0].encode()).hexdigest(), joined[1]))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scan(text)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: doc_id, n_assign, n_access, n_hex, base_sha256 over the base spans, spans (all, as kind:start:end)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", scan_column(F.col("text")).alias("s")).select("doc_id", "s.*")
