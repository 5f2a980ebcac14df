"""Secret scans: pattern hits over whole texts, and structural confirmation that decodes what looks encoded.

Base kinds (assign, access, hex) follow their patterns alone. The method then decodes runs of base64 and hex letters and
parses what they hold; a run is reported only if its structure holds from end to end:
der (ASN.1 private keys: a sequence whose nested lengths fill it exactly, of a version and more, or of an algorithm and an
enciphered key), jwt (a signed-token header: JSON object with "alg", then a payload object and a signature), ssh
("openssh-key-v1", whose cipher, key count, public and private parts fill it exactly). Public keys are no secrets.
A run is decoded once for each of the four places where base64 letters may start, so work goes with its length.
"""

from __future__ import annotations

import base64
import binascii
import functools
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import lower_ascii, text_chunks

# The three base patterns and the order of kinds at equal starts.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "der", "jwt", "ssh")

#: Letters of a run worth decoding. A run shorter than this holds no key.
RUN = 32
_RUN = re.compile(rb"[A-Za-z0-9+/_=.-]{%d,}" % RUN)
_CODED = np.zeros(256, bool)
_CODED[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-")] = True
_KEYWORDS = (b"passw", b"secret", b"token", b"api", b"akia")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, in code points, end exclusive."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def der_items(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """Tags and contents of DER items that fill data exactly, constructed ones checked in turn; else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        body, at = data[at : at + size], at + size
        if tag & 0x20 and (depth > 16 or der_items(body, depth + 1) is None):
            return None
        out.append((tag, body))
    return out


def is_der_key(data: bytes) -> bool:
    """One sequence: of a version and more, or of an algorithm sequence that names an object identifier and an enciphered key."""
    if len(data) < 16 or data[0] != 0x30 or not (top := der_items(data)) or len(top) != 1:
        return False
    inner = der_items(top[0][1])
    if not inner or len(inner) < 2:
        return False
    if inner[0][0] == 0x02 and len(inner[0][1]) == 1 and inner[0][1][0] <= 3:
        return inner[1][0] in (0x02, 0x04, 0x30)
    if inner[0][0] == 0x30 and inner[1][0] == 0x04:
        return bool((algorithm := der_items(inner[0][1])) and algorithm[0][0] == 0x06)
    return False


_SSH = b"openssh-key-v1\0"


def ssh_size(data: bytes) -> int:
    """Bytes of the private-key container that data starts with, by its nested lengths; 0 if they don't hold."""
    if not data.startswith(_SSH):
        return 0
    at = len(_SSH)

    def number() -> int:
        nonlocal at
        at += 4
        return int.from_bytes(data[at - 4 : at], "big") if at <= len(data) else 1 << 32

    def text() -> bytes | None:
        nonlocal at
        n = number()
        at += n
        return data[at - n : at] if at <= len(data) else None

    if not text() or not text() or text() is None or not 1 <= (keys := number()) <= 64:  # cipher, derivation, its options
        return 0
    for _ in range(keys):
        public = text()
        if not public or len(public) < 8 or 4 + int.from_bytes(public[:4], "big") > len(public):
            return 0
    return at if text() else 0


def is_ssh_key(data: bytes) -> bool:
    return 0 < ssh_size(data) == len(data)


def _base64(text: bytes) -> bytes | None:
    text = text.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + b"=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(part: bytes) -> dict | None:
    try:
        found = json.loads(_base64(part) or b"")
    except (ValueError, UnicodeDecodeError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


_BASE64_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="


class _Aligned:
    """Decodings of a piece of base64 letters from any of its places, of which there are four up to a shift."""

    def __init__(self, letters: bytes):
        self.letters, self.held = letters.translate(bytes.maketrans(b"-_", b"+/")), {}

    def __call__(self, at: int) -> tuple[bytes, int]:
        """(bytes, place in them) of what the letters from `at` on stand for."""
        r = at % 4
        if r not in self.held:
            part = self.letters[r:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            self.held[r] = base64.b64decode(part + b"=" * (-len(part) % 4))
        return self.held[r], at // 4 * 3


def _der_size(head: bytes) -> int:
    """Bytes of the DER item that starts with head, its tag and length included; 0 where the length has no such form."""
    if len(head) < 2 or head[1] < 0x80:
        return 2 + head[1] if len(head) > 1 else 0
    n = head[1] & 0x7F
    return 2 + n + int.from_bytes(head[2 : 2 + n], "big") if 1 <= n <= 4 and len(head) >= 2 + n else 0


_HEX_RUN = re.compile(rb"(?:[0-9a-f]{2}){16,}|(?:[0-9A-F]{2}){16,}")
_URL_LETTERS = re.compile(rb"[A-Za-z0-9_-]+")
_URL_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
_PIECE = re.compile(rb"[A-Za-z0-9+/_-]{%d,}={0,2}" % RUN)
_KEY_START = re.compile(rb"(?:^|(?<=[-_/+]))(?:M|b3BlbnNzaC1rZXktdjEA)")
_DECODER = json.JSONDecoder()


def _token_head(part: bytes) -> int:
    """Where the header of a signed token starts that ends with part; -1 if none does.

    An object that is open at the end of its decoding holds none that closes there, so its alignment is done with.
    """
    aligned, at = _Aligned(part), part.find(b"eyJ")
    texts: dict[int, str] = {}
    done = {(len(part) - 1) % 4}  # letters from there on can't be a whole decoding
    while at >= 0 and len(done) < 4:
        if at % 4 not in done:
            data, place = aligned(at)
            text = texts.setdefault(at % 4, data.decode("latin-1"))  # one letter a byte, so places agree
            try:
                found, end = _DECODER.raw_decode(text, place)
                if isinstance(found, dict) and not text[end:].strip() and (head := _json_object(part[at:])) and isinstance(head.get("alg"), str):
                    return at
            except json.JSONDecodeError as e:
                if e.pos >= len(text) or e.msg.startswith("Unterminated"):
                    done.add(at % 4)
            except RecursionError:
                done.add(at % 4)
        at = part.find(b"eyJ", at + 1)
    return -1


def structures(run: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all structures within a run of coded letters, by start. None overlap: tokens go first, then hex, then base64."""
    starts, taken = [], []  # in order

    def add(kind: str, start: int, end: int) -> None:
        k = bisect_left(starts, start)
        if (k == 0 or taken[k - 1][2] <= start) and (k == len(taken) or end <= starts[k]):
            starts.insert(k, start)
            taken.insert(k, (kind, start, end))

    if b"eyJ" in run and b"." in run:
        parts = run.split(b".")
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        payload = functools.cache(lambda k: _URL_LETTERS.fullmatch(parts[k]) is not None and _json_object(parts[k]) is not None)
        k = 0
        while k + 2 < len(parts):
            signature = _URL_LETTERS.match(parts[k + 2])
            tail = parts[k][len(parts[k].rstrip(_URL_ALPHABET)) :]
            if signature and b"eyJ" in tail and payload(k + 1) and (at := _token_head(tail)) >= 0:
                add("jwt", int(ends[k]) - len(tail) + at, int(ends[k + 1]) + 1 + signature.end())
                k += 1  # its payload begins no other token
            k += 1
    for m in _HEX_RUN.finditer(run):
        if m[0][:2].lower() == b"30" and is_der_key(bytes.fromhex(m[0].decode())):
            add("der", m.start(), m.end())
    for m in _PIECE.finditer(run):
        data = _base64(m[0])
        if data and (is_der_key(data) or is_ssh_key(data)):
            add("der" if is_der_key(data) else "ssh", m.start(), m.end())
            continue
        # several joined by letters of the alphabet: a structure says its own length, so its end is known
        end, aligned = 0, _Aligned(m[0].rstrip(b"="))
        for start in _KEY_START.finditer(m[0]):
            at = start.start()
            if at < end:
                continue
            data, place = aligned(at)
            head = data[place : place + 8]
            if start[0] == b"M":
                # the first item inside is a version or an algorithm: told by its tag, before anything is copied
                inner = 2 + (head[1] & 0x7F if len(head) > 1 and head[1] >= 0x80 else 0)
                size = _der_size(head) if len(head) > inner and head[0] == 0x30 and head[inner] in (0x02, 0x30) else 0
                found = bool(size) and place + size <= len(data) and is_der_key(data[place : place + size])
            else:
                size = ssh_size(data[place:])
                found = bool(size)
            if found:
                end = at + -(-size * 4 // 3)
                add("der" if start[0] == b"M" else "ssh", m.start() + at, m.start() + end)
    return taken


def confirm(run: bytes) -> tuple[str, int, int] | None:
    """The first of a run's structures."""
    return next(iter(structures(run)), None)


_ARMOUR = re.compile(r"-----BEGIN [A-Z0-9 ]+-----")
_ARMOUR_END = re.compile(r"-----END [A-Z0-9 ]+-----")
_HEADERS = re.compile(r"\s*((?:[A-Za-z0-9-]+:[^\n]*\n(?:[ \t]+\S[^\n]*\n)*)*)")


def _armoured(text: str) -> list[tuple[int, str, int]]:
    """Keys that are split over the lines of an armour: the lines are joined, behind header lines, and decoded whole."""
    out, begin = [], _ARMOUR.search(text)
    while begin:
        dashes = text.find("-----", begin.end())
        if dashes < 0:
            break
        end, after = _ARMOUR_END.match(text, dashes), dashes
        if end:
            after = end.end()
            headers = _HEADERS.match(text, begin.end(), dashes)
            body = text[headers.end() : dashes]
            letters = "".join(body.split()).encode("ascii", "replace")
            data = _base64(letters) if letters and not letters.translate(None, _BASE64_LETTERS) else None
            if data and (is_der_key(data) or is_ssh_key(data)):
                out.append((begin.start(), "der" if is_der_key(data) else "ssh", after))
            elif data and re.search(r"(?m)^Proc-Type:[^\n]*ENCRYPTED", headers[1]) and len(data) >= 16 and len(data) % 8 == 0:
                out.append((begin.start(), "der", after))  # enciphered in whole blocks, so nothing more can be parsed
        begin = _ARMOUR.search(text, after)
    return out


def method_spans(text: str) -> list[tuple[int, str, int]]:
    """Confirmed spans. Coded letters are ASCII, so each byte of a run is one code point."""
    raw, out = text.encode(), []
    before = at = 0
    for m in _RUN.finditer(raw):
        if found := structures(m[0]):
            before, at = before + len(raw[at : m.start()].decode()), m.start()
            out += [(before + start, kind, before + end) for kind, start, end in found]
    return list(dict.fromkeys(out + _armoured(text)))


def find_spans(text: str) -> list[tuple[int, str, int]]:
    """All spans by start, then kind as listed, then end."""
    return sorted(dict.fromkeys(base_spans(text) + method_spans(text)), key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def _suspects(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may hold a span: a keyword, or a run of RUN coded letters. Cheap, and never misses one."""
    rows = np.zeros(len(offsets) - 1, bool)
    low = lower_ascii(raw).tobytes()
    for word in _KEYWORDS:
        at = low.find(word)
        while at >= 0:
            rows[np.searchsorted(offsets, at, "right") - 1] = True
            at = low.find(word, at + 1)
    coded = np.flatnonzero(~_CODED[raw])
    edges = np.concatenate(([-1], coded, [len(raw)]))
    for k in np.flatnonzero(np.diff(edges) > RUN):
        first, last = np.searchsorted(offsets, (edges[k] + 1, edges[k + 1] - 1), "right") - 1
        rows[first : last + 1] = True
    for m in re.finditer(rb"-----BEGIN ", raw.tobytes()):
        rows[np.searchsorted(offsets, m.start(), "right") - 1] = True
    return rows


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        spans: list[list] = [[] for _ in range(batch.num_rows)]
        for lo, hi, raw, offsets in text_chunks(column):
            for r in np.flatnonzero(_suspects(raw, offsets)):
                text = raw[offsets[r] : offsets[r + 1]].tobytes().decode()
                spans[lo + r] = [{"kind": k, "start": s, "end": e} for s, k, e in find_spans(text)]
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, _SPAN)], [*batch.schema.names[:-1], "spans"])


def scan_secrets(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns of `keep` and spans array<struct<kind,start,end>> for every row: no span, null or empty text: an empty array.

    Each text is scanned whole, row by row; rows stay where they are (no shuffle). Repeated rows and null ids pass through.
    """
    slim = docs.select(*keep, F.col(text_col).alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]]
    return slim.mapInArrow(_scan, ", ".join([*kinds, "spans array<struct<kind:string,start:bigint,end:bigint>>"]))


def redacted(text: str, mark: str = "[secret]") -> str:
    """text with every span replaced by mark; overlapping spans become one."""
    out, end = [], 0
    for s, _, e in find_spans(text):
        if s >= end:
            out += [text[end:s], mark]
        end = max(end, e)
    return "".join([*out, text[end:]])


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        texts: dict[int, str] = {}
        for lo, _, raw, offsets in text_chunks(column):
            for r in np.flatnonzero(_suspects(raw, offsets)):
                text = raw[offsets[r] : offsets[r + 1]].tobytes().decode()
                if (new := redacted(text)) != text:
                    texts[lo + int(r)] = new
        if texts:
            column = pa.array([texts.get(i, x) for i, x in enumerate(column.to_pylist())], column.type)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=batch.schema.names)


def redact_secrets(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """docs with every span of its texts replaced by a mark and size_col set to the new length where the text changed; no row is dropped."""
    order, rest = docs.columns, [c for c in docs.columns if c != text_col]
    fields = [docs.schema[c] for c in (*rest, text_col)]
    out = docs.select(*[F.col(f"`{c}`") for c in (*rest, text_col)])
    if size_col in rest:
        out = out.withColumn(size_col, F.when(F.char_length(text_col) == F.col(size_col), F.lit(-1).cast(docs.schema[size_col].dataType)).otherwise(F.col(size_col)))
    out = out.mapInArrow(_redact, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))
    if size_col in rest:
        out = out.withColumn(size_col, F.when(F.col(size_col) == -1, F.char_length(text_col).cast(docs.schema[size_col].dataType)).otherwise(F.col(size_col)))
    return out.select(*[F.col(f"`{c}`") for c in order])


def joined(spans: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def base_digest(spans: list[dict]) -> str:
    return hashlib.sha256(joined([s for s in spans if s["kind"] in KINDS[:3]]).encode()).hexdigest()
