"""Operator 6: secrets, by pattern and by structure of what base64 or hex runs decode to."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import id_and_text, slices

# The base patterns.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
BASE_KINDS = ("assign", "access", "hex")
#: The method's kinds: signed tokens, keys in text armour, keys as bare base64, keys as hex, and base64 or hex that any of
#: these stands in.
MORE_KINDS = ("jwt", "pem", "key64", "keyhex", "coded")
ORDER = {k: i for i, k in enumerate(BASE_KINDS + MORE_KINDS)}
#: How often what was decoded is decoded again.
DEPTH = 3

#: Three runs between dots; what the first two decode to decides.
JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,}+)\.([eICD][A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*)")
#: Header and payload are JSON objects, perhaps behind white space, so their base64 begins with one of four letters; in
#: the middle of a run only the usual beginnings of an object with a key count.
JWT_START = re.compile(r"(?<![A-Za-z0-9])[eICD]|eyJ|eyAi|ew[ok0]")
BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----")
END = re.compile(r"-----END ([A-Z0-9 ]*)PRIVATE KEY-----")
#: A run may be broken over lines, as wrapped base64 is, the ends of which may be escaped and the lines indented.
BREAK = r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*"
RUN64 = re.compile(rf"[A-Za-z0-9+/_-]{{40,}}(?:{BREAK}[A-Za-z0-9+/_-]+)*={{0,2}}")
RUNHEX = re.compile(rf"[0-9A-Fa-f]{{32,}}(?:{BREAK}[0-9A-Fa-f]+)*")
ESCAPED = re.compile(r"\\[rn]")
#: How a key may begin in base64 and in hex: a DER sequence, or OpenSSH's name.
KEY_START = re.compile(r"M[A-P]|b3BlbnNzaC1rZXktdjEA")
HEX_START = re.compile(r"30(?=[0-7]|8[1-4])|6[fF]70656[eE]7373682[dD]6[bB]65792[dD]7631(?=00)")

_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HEX = bytes(104 if chr(b) in "0123456789abcdef" else 46 for b in range(256))
_RUN = bytes(104 if b < 128 and (chr(b).isalnum() or chr(b) in "+/_-") else 46 for b in range(256))
RUN_BYTES = b"h" * 32
_WORDS = (b"passw", b"secret", b"token", b"api")


def unbase64(text: str) -> bytes | None:
    """The bytes of standard or URL-safe base64, padded or not, line ends escaped or not; None if it isn't base64."""
    text = re.sub(r"\s", "", ESCAPED.sub("", text)).rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER value at `at`, which must lie within `end`."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(data[at : at + k]), at + k
    return (tag, at, at + n) if at + n <= end else None


def children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill data[at:end] exactly; None if lengths don't nest."""
    out = []
    while at < end:
        x = der(data, at, end)
        if x is None:
            return None
        out.append(x)
        at = x[2]
    return out


MAGIC = b"openssh-key-v1\0"
# How the object identifiers of PKCS#5 and PKCS#12 schemes begin.
SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c"))


def is_private_key(data: bytes) -> bool:
    """Whether data is, to the last byte, an OpenSSH, PKCS#1, DSA, SEC1 or PKCS#8 private key, the latter encrypted or not."""
    if data.startswith(MAGIC):
        at, fields = len(MAGIC), 0
        while at + 4 <= len(data) and fields < 3:  # cipher, derivation, its options
            n = int.from_bytes(data[at : at + 4])
            at, fields = at + 4 + n, fields + 1
        if fields < 3 or at + 4 > len(data):
            return False
        keys, at = int.from_bytes(data[at : at + 4]), at + 4
        for _ in range(keys + 1):  # public keys, then the private block
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4])
        return keys > 0 and at == len(data)
    top = der(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = children(data, top[1], top[2])
    if parts and [p[0] for p in parts] == [0x30, 0x04]:  # encrypted PKCS#8: a scheme of PKCS#5 or PKCS#12, key octets
        inner = children(data, parts[0][1], parts[0][2])
        return bool(inner) and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]].startswith(SCHEMES)
    if not parts or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    version, tags = data[parts[0][1]], [p[0] for p in parts]
    if version in (0, 1) and len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return True  # PKCS#1: version and eight integers
    if version == 0 and tags == [0x02] * 6:
        return True  # DSA: version, p, q, g, y, x
    if version in (0, 1) and tags[1:3] == [0x30, 0x04]:
        inner = children(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06  # PKCS#8: algorithm's object identifier, key octets
    return version == 1 and tags[1:2] == [0x04] and parts[1][2] - parts[1][1] in (28, 32, 48, 66)  # SEC1


def own_length(read, size: int) -> int:
    """How many bytes the key says it has that begins what read(place, bytes) reads of `size` bytes; 0 if none begins."""
    if read(0, len(MAGIC)) == MAGIC:
        at = len(MAGIC)
        for _ in range(3):
            at += 4 + int.from_bytes(read(at, 4))
        keys, at = int.from_bytes(read(at, 4)), at + 4
        while keys >= 0 and at < size:  # public keys, then the private block
            at, keys = at + 4 + int.from_bytes(read(at, 4)), keys - 1
        return at if keys < 0 else 0
    head = read(0, 8)
    top = der(head, 0, 1 << 40) if len(head) == 8 else None
    inner = read(top[1], 1) if top and top[0] == 0x30 else b""
    return top[2] if inner in (b"\x02", b"\x30") else 0


def _letters(run: str) -> tuple[str, np.ndarray | range]:
    """The letters of a run without line ends, blanks and padding, and each one's place."""
    if run.isalnum():
        return run, range(len(run))
    plain = ESCAPED.sub("\n\n", run)  # places stay
    raw = np.frombuffer(plain.encode("latin-1"), np.uint8)
    place = np.flatnonzero(~np.isin(raw, np.frombuffer(b"\r\n =\t", np.uint8)))
    return raw[place].tobytes().decode("latin-1"), place


def key_spans(run: str) -> list[tuple[int, int]]:
    """Where private keys stand in a base64 run with line ends and padding: each from its first letter to its last or its padding."""
    letters, place = _letters(run)
    plain, out, after = ESCAPED.sub("\n\n", run), [], 0
    for m in KEY_START.finditer(letters):
        a = m.start()
        if a < after:
            continue

        def read(at, n, a=a):
            i = at // 3
            return (unbase64(letters[a + 4 * i : a + 4 * ((at + n + 2) // 3)]) or b"")[at - 3 * i :][:n]

        size = own_length(read, (len(letters) - a) * 3 // 4)
        n = (size * 4 + 2) // 3
        if not 0 < n <= len(letters) - a:
            continue
        data = unbase64(letters[a : a + n])
        if data is None or len(data) < size or not is_private_key(data[:size]):
            continue
        last = int(place[a + n - 1]) + 1
        last += len(plain[last : last + 2]) - len(plain[last : last + 2].lstrip("="))
        out.append((int(place[a]), last))
        after = a + n
    return out


def hex_spans(run: str) -> list[tuple[int, int]]:
    """Where private keys stand in a hex run with line ends: each from its first digit to its last."""
    letters, place = _letters(run)
    out, after = [], 0
    for m in HEX_START.finditer(letters):
        a = m.start()
        if a < after:
            continue
        size = own_length(lambda at, n, a=a: bytes.fromhex(letters[a + 2 * at : min(a + 2 * (at + n), a + (len(letters) - a) // 2 * 2)]), (len(letters) - a) // 2)
        if 0 < 2 * size <= len(letters) - a and is_private_key(bytes.fromhex(letters[a : a + 2 * size])):
            out.append((int(place[a]), int(place[a + 2 * size - 1]) + 1))
            after = a + 2 * size
    return out


def coded_spans(run: str, depth: int) -> list[tuple[int, int]]:
    """Where in a base64 or hex run the letters stand that decode to structures which are secrets themselves."""
    letters, place = _letters(run)
    out = []
    hexed = letters[:64].strip("0123456789abcdefABCDEF") == "" and letters.strip("0123456789abcdefABCDEF") == ""
    for shift in range(2 if hexed else 4):  # a run may have letters before the first that was coded
        part = letters[shift:]
        data = bytes.fromhex(part[: len(part) // 2 * 2]) if hexed else unbase64(part[: len(part) - (len(part) % 4 == 1)])
        if not data or not (b"PRIVATE KEY-----" in data or data.count(b".") > 1 or RUN_BYTES in data.translate(_RUN)):
            continue
        for _, i, j in structures(data.decode("latin-1"), depth - 1):
            a, b = (shift + 2 * i, shift + 2 * j) if hexed else (shift + i * 4 // 3, shift + -(-j * 4 // 3))
            out.append((int(place[a]), int(place[min(b, len(letters)) - 1]) + 1))
    done: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if done and a < done[-1][1]:
            done[-1] = (done[-1][0], max(b, done[-1][1]))
        else:
            done.append((a, b))
    return done


def armoured(text: str) -> list[tuple[int, int]]:
    """From the last BEGIN line before an END line of its kind to that line, where a key stands between."""
    out, open_ = [], None
    for at, m in sorted([(m.start(), m) for m in BEGIN.finditer(text)] + [(m.start(), m) for m in END.finditer(text)], key=lambda x: x[0]):
        if m.re is BEGIN:
            open_ = m
        elif open_ is not None and open_[1] == m[1]:
            if is_armoured(text[open_.end() : at]):
                out.append((open_.start(), m.end()))
            open_ = None
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """Signed tokens: from the first place of the run before the first dot at which a header begins."""
    out = []
    for m in JWT.finditer(text):
        for start in JWT_START.finditer(m[1]):
            if is_signed_token(m[1][start.start() :], m[2]):
                out.append((m.start() + start.start(), m.end()))
                break
    return out


def is_armoured(body: str) -> bool:
    """Whether what stands between armour lines is a private key, or says by its headers that it is encrypted."""
    lines = [x for x in re.split(r"\s*(?:\n|\\n)\s*", ESCAPED.sub("\n", body)) if x]
    headers = [x for x in lines if ":" in x]
    data = unbase64("".join(x for x in lines if ":" not in x))
    if not data:
        return False
    if any("ENCRYPTED" in x for x in headers) and any(x.startswith("DEK-Info") for x in headers):
        return len(data) % 8 == 0
    return is_private_key(data)


def is_signed_token(header: str, payload: str) -> bool:
    """Whether header and payload decode to JSON objects and the header names its algorithm."""
    try:
        head, body = (json.loads(unbase64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def structures(text: str, depth: int = DEPTH) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what parses as a key or a signed token, in the text or in what its runs decode to."""
    raw, found = text.encode("utf-8", "surrogatepass"), []
    armour = armoured(text) if b"PRIVATE KEY-----" in raw else []
    found += [("pem", *x) for x in armour]
    signed = tokens(text) if raw.count(b".") > 1 else []
    found += [("jwt", *x) for x in signed]
    if RUN_BYTES in raw.translate(_RUN):
        taken = armour + signed
        for kind, pattern, keys in (("keyhex", RUNHEX, hex_spans), ("key64", RUN64, key_spans)):
            for m in pattern.finditer(text):
                if any(a <= m.start() < b for a, b in taken):
                    continue
                own = [(m.start() + a, m.start() + b) for a, b in keys(m[0])]
                if own:
                    found += [(kind, *x) for x in own]
                elif depth > 0:
                    found += [("coded", m.start() + a, m.start() + b) for a, b in coded_spans(m[0], depth)]
    return found


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, in code points, by start, then kind as listed."""
    raw, found = text.encode("utf-8", "surrogatepass"), []
    low = raw.translate(_LOW)
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if b"h" * HEX_LEAST in raw.translate(_HEX):
        found += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= HEX_LEAST]
    return sorted({*found, *structures(text)}, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def redacted(text: str, found: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """text with every secret, overlapping ones as one, replaced by a mark."""
    out, done, i = [], 0, 0
    while i < len(found):
        start, end = found[i][1:]
        while i < len(found) and found[i][1] < max(end, start + 1):
            end, i = max(end, found[i][2]), i + 1
        out += [text[done:start], mark]
        done = end
    return "".join([*out, text[done:]])


def joined(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans[, redacted]) for each document; one narrow pass.

    A null or empty text has no spans, the digest of '' and, redacted, the text ''. Spans of different kinds may
    overlap. Repeated rows are scanned one by one; other columns are not read.
    """

    def run(batches):
        for part in slices(batches, "text"):
            texts = part.column(1).to_pylist()
            found = [spans(t) for t in texts]
            base = [[s for s in f if s[0] in BASE_KINDS] for f in found]
            counts = [pa.array(np.array([sum(s[0] == k for s in b) for b in base], np.int64)) for k in BASE_KINDS]
            sha = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
            more = [pa.array([redacted(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string())] if redact else []
            yield pa.record_batch([part.column(0), *counts, pa.array(sha, pa.string()), pa.array([joined(f) for f in found], pa.string()), *more], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", *["redacted"] * redact])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", redacted string" * redact)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with their secrets marked out of the text and n_chars set anew; all other columns and rows stay.

    A null text stays null.
    """

    def run(batches):
        for part in slices(batches, "text"):
            i = part.schema.get_field_index("text")
            texts = part.column(i).to_pylist()
            clean = [t if t is None or not (f := spans(t)) else redacted(t, f) for t in texts]
            part = part.set_column(i, part.schema.field(i), pa.array(clean, pa.string()))
            yield part

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
