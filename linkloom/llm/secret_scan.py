"""Secret scans: patterns, and structural confirmation of encoded candidates."""

from __future__ import annotations

import base64
import binascii
import json
import re
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.base import annotate, register, table

KINDS = ("assign", "access", "hex", "der", "ssh", "jwt")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Candidates: hex of either case, base64 of one alphabet (usual or for urls) where
#: a sequence or OpenSSH's magic can begin, three dotted parts.
_HEX_RUN = re.compile(r"[0-9A-Fa-f]{64,}")
_KEY_START = r"(?:M[A-P]|b3BlbnNzaC1rZXktdjEA)"
_STARTS = tuple(
    (re.compile(rf"(?:(?<![{before}])|(?<=\\[nr])){_KEY_START}"), re.compile(rf"[{inside}]+"))
    for before, inside in (("A-Za-z0-9+/", "A-Za-z0-9+/"), ("A-Za-z0-9_", "A-Za-z0-9_-"))
)
#: Between lines of base64: a line break or a written one (as in JSON), and indentation.
_BREAK = re.compile(r"(?:\r?\n|(?:\\+r)?\\+n)[ \t]*")
#: Base64 of the least and of the longest key (an SSH key of 16,384 bits has 13,000).
_LEAST_CHARS, _MOST_CHARS = 40, 65_536
_DOTTED = re.compile(r"[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_SSH_NAME = b"openssh-key-v1\0"
#: DER tags that occur in key encodings: integer, bit string, octet string, null,
#: object identifier, strings, sequence, set and the first context tags.
_TAGS = {0x02, 0x03, 0x04, 0x05, 0x06, 0x0C, 0x13, 0x16, 0x30, 0x31, 0xA0, 0xA1, 0xA2, 0xA3}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three base patterns, ends exclusive.

    A shorter value or key is a match that fails: its characters are consumed
    for ``assign``; for the other two no shorter run can hide a longer one.
    """
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= 12]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def _der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, content start and content end of the element at ``at``, if it fits before ``end``."""
    if at + 2 > end or data[at] not in _TAGS:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        if size < 0x80 or data[at] == 0:
            return None  # DER writes lengths as short as possible
        at += n
    return (tag, at, at + size) if at + size <= end else None


def _nested(data: bytes, at: int, end: int, depth: int = 0) -> int | None:
    """Integers and identifiers below, when elements fill the range exactly."""
    found = 0
    while at < end:
        item = _der_item(data, at, end)
        if item is None or depth > 12:
            return None
        tag, a, b = item
        if tag in (0x30, 0x31) or tag >= 0xA0:
            below = _nested(data, a, b, depth + 1)
            if below is None:
                return None
            found += below
        elif tag in (0x02, 0x06) and b > a:
            found += 1
        at = b
    return found


def _private(data: bytes, at: int, end: int) -> bool:
    """Whether a sequence's elements are those of a private key.

    PKCS#1, PKCS#8 and SEC1 begin with a version (0 or 1), an encrypted PKCS#8 key is
    an algorithm and an octet string. Public keys (a modulus, or an algorithm and a
    bit string) and certificates begin otherwise.
    """
    first = _der_item(data, at, end)
    if first is None:
        return False
    tag, a, b = first
    if tag == 0x02:
        return data[a:b] in (b"\0", b"\1") and b < end
    second = _der_item(data, b, end)
    return tag == 0x30 and second is not None and second[0] == 0x04 and second[2] == end


def der_key(data: bytes) -> int | None:
    """Bytes of a private key's encoding at the start of ``data``: a sequence whose nested
    lengths all fit and that holds an integer or identifier; zero padding may follow."""
    if not data or data[0] != 0x30:
        return None
    item = _der_item(data, 0, len(data))
    if item is None or item[2] < 32 or not _private(data, item[1], item[2]):
        return None
    return item[2] if _nested(data, item[1], item[2]) and not data[item[2] :].strip(b"\0") else None


def ssh_key(data: bytes) -> bool:
    """A private key file: its name, then fields with 4-byte lengths that all fit
    (cipher, derivation and its options, the public keys, the private part)."""
    at = len(_SSH_NAME)
    if not data.startswith(_SSH_NAME):
        return False
    left = 3
    counted = False
    while left:
        if at + 4 > len(data):
            return False
        at += 4 + struct.unpack(">I", data[at : at + 4])[0]
        left -= 1
        if not left and not counted:
            if at + 4 > len(data):
                return False
            keys = struct.unpack(">I", data[at : at + 4])[0]
            at, left, counted = at + 4, min(keys, len(data)) + 1, True
    return at <= len(data)


def _decode64(text: str) -> bytes | None:
    text = re.sub(r"[\r\n=]", "", text).replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _lines_from(text: str, at: int, line: re.Pattern):
    """(base64 so far, its end in the text) after each line of a run."""
    found = ""
    while m := line.match(text, at):
        found, at = found + m.group(), m.end()
        while text.startswith("=", at) and at < m.end() + 2:
            at += 1
        yield found, at
        gap = None if at > m.end() else _BREAK.match(text, at)
        if gap is None:
            return
        at = gap.end()


def _der_length(head: bytes) -> int:
    """Bytes of a sequence by its header; 0 when it begins none."""
    if len(head) < 6 or head[0] != 0x30:
        return 0
    size, n = head[1], 0
    if size & 0x80:
        n = size & 0x7F
        size = int.from_bytes(head[2 : 2 + n], "big") if 1 <= n <= 4 else -n - 2
    # What the sequence begins with has a known tag, too.
    return 2 + n + size if 2 + n >= len(head) or head[2 + n] in _TAGS else 0


def _key_at(text: str, at: int, line: re.Pattern) -> tuple[int, str] | None:
    """End and kind of a key whose base64 begins at ``at``.

    The length in a sequence's header says how many lines it has: text below a
    key may look like one more line. An SSH key ends with the line that completes it.
    """
    need = -1
    for found, end in _lines_from(text, at, line):
        if len(found) > _MOST_CHARS:
            return None
        if text[at] == "b":
            if len(found) >= _LEAST_CHARS and ssh_key(_decode64(found) or b""):
                return end, "ssh"
            continue
        if need < 0 and len(found) >= 8:
            need = -(-_der_length(_decode64(found[:8]) or b"") * 4 // 3)
        if need == 0:
            return None
        if 0 < need <= len(found):
            data = _decode64(found)
            return (end, "der") if len(found) >= _LEAST_CHARS and data and der_key(data) else None
    return None


def _base64_keys(text: str) -> list[tuple[int, int, str]]:
    """Keys in either alphabet; a key that both spell the same counts once."""
    out: dict[int, tuple[int, int, str]] = {}
    for start, line in _STARTS:
        done = 0
        for m in start.finditer(text):
            if m.start() < done or m.start() in out:
                continue
            found = _key_at(text, m.start(), line)
            if found:
                done = found[0]
                out[m.start()] = (m.start(), *found)
    return list(out.values())


def signed_token(text: str) -> bool:
    """Header and payload are JSON objects; the header names an algorithm."""
    header, payload, signature = text.split(".")
    try:
        head = json.loads(_decode64(header) or b"")
        body = json.loads(_decode64(payload) or b"")
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict):
        return False
    return isinstance(head.get("alg"), str) and (bool(signature) or head["alg"].lower() == "none")


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates whose decoded bytes have the structure of a key or token."""
    out = []
    for m in _HEX_RUN.finditer(text):
        run = m.group()
        data = bytes.fromhex(run[: len(run) // 2 * 2])
        if der_key(data):
            out.append((m.start(), m.end(), "der"))
        elif ssh_key(data):
            out.append((m.start(), m.end(), "ssh"))
    out += _base64_keys(text)
    out += [(m.start(), m.end(), "jwt") for m in _DOTTED.finditer(text) if signed_token(m.group())]
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def _scan(texts: list) -> list[list]:
    base, spans = [], []
    for text in texts:
        own = base_spans(text or "")
        base.append(_joined(own))
        spans.append(_joined(own + confirmed_spans(text or "")))
    return [base, spans]


def secret_spans(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``row`` (the carried columns), ``base`` and ``spans``: ``kind:start:end`` in
    code points, comma-joined, by start and then kind.

    Null text counts as empty; a text without secrets has empty strings. Each row
    is scanned by itself and whole, so ids, repeats and other columns don't matter.
    """
    return annotate(docs, "text", carry, _scan, "base string, spans string")


@register("op9_secret_scans")
def secret_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of the secrets of every document."""
    found = secret_spans(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [F.regexp_count("base", F.lit(rf"(^|,){k}:")).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("row.doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")
