"""Secret scans: pattern spans, and spans confirmed by decoding and parsing."""

from __future__ import annotations

import base64
import json
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The base kinds, in order, and their patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE_KINDS = ("assign", "access", "hex")

#: Kinds that the structural pass adds.
FOUND_KINDS = ("signed_token", "key_b64", "key_hex", "ssh_key")
KINDS = BASE_KINDS + FOUND_KINDS

_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
# a run is tried from its start alone and never given back, so a long one costs its length once
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]*+")
_OBJECT = re.compile(r'\{\s*"')
#: The object ids (DER) below which the password-based encryptions of keys lie.
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
SSH_MAGIC = b"openssh-key-v1\0"
#: No private key has more parts on a level: ten of RSA with more than two primes.
MOST_PARTS = 10
#: Keys in one SSH container; its only writer makes one.
MOST_SSH_KEYS = 16

# what stands between two lines of a wrapped key: what closes the first (quotes, blanks, signs, an escaped
# line end), a line end, and what opens the second; or an escaped line end alone.  Base64's own signs open a
# line if another sign follows them.
_CLOSES = r"(?:\\++[rn]?+|[^A-Za-z0-9\r\n=\\])*+\r?\n"
_ESCAPED = r"[ \t]*+(?:\\++r)?\\++n[ \t]*+"
_OPENS = r"(?:[^A-Za-z0-9+/_\r\n-]|[+/_-]++(?=[^A-Za-z0-9+/_\r\n-]))*+"
_RUN = r"(?:[A-Za-z0-9+/_]++|-{1,4}+(?!-))++"
_HEX_RUN = r"[0-9A-Fa-f]++"
#: Ways to go on from line to line: base64 as it stands, behind the signs of a diff, and hexadecimal digits.
_WRAPPED = {
    "plain": (re.compile(_RUN), re.compile(rf"(?:{_CLOSES}{_OPENS}|{_ESCAPED})({_RUN})")),
    "added": (re.compile(_RUN), re.compile(rf"{_CLOSES}{_OPENS}\+({_RUN})")),
    "removed": (re.compile(_RUN), re.compile(rf"{_CLOSES}{_OPENS}-({_RUN})")),
    "hex": (re.compile(_HEX_RUN), re.compile(rf"(?:{_CLOSES}[^A-Za-z0-9\r\n]*+|{_ESCAPED})({_HEX_RUN})")),
}
# where a key may begin: a sequence's header with its length, or the magic of a container
_STARTS = re.compile(r"M(?=(?:I[E-T]|[A-H][A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{5})|b3BlbnNzaC1rZXktdjE")
_HEX_STARTS = re.compile(r"(?i:30(?=(?:[0-7][0-9a-f]|81[0-9a-f]{2}|82[0-9a-f]{4}|83[0-9a-f]{6}|84[0-9a-f]{8})(?:0201|30))|6f70656e7373682d6b65792d763100)")

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that are long enough."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a maximal run of the class begins where a run of 24 or more begins
    found += [("hex", m.start(), m.end()) for m in _LONG_HEX.finditer(text)]
    return found


class Chain:
    """Lines of an encoding from one place of a text on, as one string without what wraps them.

    Bytes are decoded where they are asked for, so looking at a few lengths costs
    the same however long the chain is.
    """

    def __init__(self, text: str, at: int, way: str):
        first, more = _WRAPPED[way]
        self.hex = way == "hex"
        m, group = first.match(text, at), 0
        self.starts, self.offsets, pieces, n = [], [], [], 0
        while m:
            self.starts.append(m.start(group))
            self.offsets.append(n)
            pieces.append(m[group])
            n += len(m[group])
            self.end = m.end()
            m, group = more.match(text, self.end), 1
        self.body = "".join(pieces).replace("-", "+").replace("_", "/")
        self.cuts = set(self.offsets[1:]) | {n}
        self.last = {cut % 4: cut for cut in sorted(self.cuts)}  # the last cut of each remainder

    def offset(self, at: int) -> int:
        k = bisect_right(self.starts, at) - 1
        return self.offsets[k] + at - self.starts[k]

    def place(self, cut: int) -> int:
        """Where in the text the line ends that ends at this cut."""
        k = bisect_left(self.offsets, cut) - 1
        return self.starts[k] + cut - self.offsets[k]

    def size(self, offset: int) -> int:
        """How many bytes the rest from this offset holds."""
        rest = len(self.body) - offset
        return rest // 2 if self.hex else rest * 3 // 4

    def read(self, offset: int, at: int, n: int) -> bytes:
        """Bytes at to at + n of what begins at this offset; fewer at the chain's end."""
        if self.hex:
            digits = self.body[offset + 2 * at : offset + 2 * (at + n)]
            return bytes.fromhex(digits[: len(digits) // 2 * 2])
        groups = self.body[offset + at // 3 * 4 : offset + (at + n + 2) // 3 * 4]
        if len(groups) % 4 == 1:
            groups = groups[:-1]
        return base64.b64decode(groups + "=" * (-len(groups) % 4))[at % 3 : at % 3 + n]

    def digits(self, size: int) -> int:
        return 2 * size if self.hex else -(-4 * size // 3)


def der_head(read, at: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the element whose header is at this byte; None if it has no proper length."""
    head = read(at, 6)
    if len(head) < 2:
        return None
    if not head[1] & 0x80:
        return head[0], at + 2, at + 2 + head[1]
    n = head[1] & 0x7F
    if not 1 <= n <= 4 or len(head) < 2 + n or head[2] == 0:
        return None
    return head[0], at + 2 + n, at + 2 + n + int.from_bytes(head[2 : 2 + n], "big")


def der_items(read, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill these bytes exactly; None if lengths don't nest or there are more than MOST_PARTS."""
    items = []
    while at < end:
        item = der_head(read, at)
        if not item or item[2] > end or len(items) == MOST_PARTS:
            return None
        items.append(item)
        at = item[2]
    return items


def private_key_size(read, available: int) -> int | None:
    """Bytes of the DER private key that begins here: nine or six integers, a version with algorithm and octets, a version with octets, or a password-based algorithm with octets."""
    top = der_head(read, 0)
    if not top or top[0] != 0x30 or top[2] > available or read(top[1], 1) not in (b"\x02", b"\x30"):
        return None
    parts = der_items(read, top[1], top[2])
    if not parts:
        return None
    tags = [tag for tag, _, _ in parts]
    length = lambda k: parts[k][2] - parts[k][1]

    def algorithm() -> bytes:
        inner = der_items(read, *parts[tags.index(0x30)][1:])
        return read(inner[0][1], min(inner[0][2] - inner[0][1], 16)) if inner and inner[0][0] == 0x06 else b""

    if tags == [0x30, 0x04]:
        return top[2] if algorithm().startswith(PASSWORD_BASED) and length(1) >= 16 else None
    if tags[0] != 0x02 or length(0) != 1 or read(parts[0][1], 1) > b"\x01":
        return None
    if tags[:9] == [0x02] * 9 or tags == [0x02] * 6 and length(1) >= 64:
        return top[2]
    if tags[:3] == [0x02, 0x30, 0x04]:
        return top[2] if algorithm() else None
    return top[2] if tags[:2] == [0x02, 0x04] and length(1) >= 16 else None


def ssh_key_size(read, available: int) -> int | None:
    """Bytes of the container of a private key that begins here: magic, cipher, kdf, options, and as many keys as it says.

    0 if only the lengths of the first three nest; None if it isn't one.
    """

    def after(at: int, parts: int) -> int | None:
        for _ in range(parts):
            head = read(at, 4)
            at += 4 + int.from_bytes(head, "big")
            if len(head) < 4 or at > available:
                return None
        return at

    if read(0, len(SSH_MAGIC)) != SSH_MAGIC:
        return None
    at = after(len(SSH_MAGIC), 3)
    if at is None or at + 4 > available:
        return None
    keys = int.from_bytes(read(at, 4), "big")
    return (after(at + 4, keys + 1) if keys <= MOST_SSH_KEYS else None) or 0


def key_at(text: str, at: int, chain: Chain) -> tuple[bool, str, int] | None:
    """The key that begins at this place of a chain: whether its own lengths end it where a line or the chain ends, its kind and its end."""
    offset = chain.offset(at)
    read = lambda start, n: chain.read(offset, start, n)
    ssh = text.startswith("b" if not chain.hex else "6", at)
    size = (ssh_key_size if ssh else private_key_size)(read, chain.size(offset))
    if size is None:
        return None
    cut = offset + chain.digits(size)
    exact = cut in chain.cuts and size > 0
    if ssh and not exact:
        # a container whose lengths don't nest: all lines that can be decoded
        cut = max((c for c in chain.last.values() if (c - offset) % (2 if chain.hex else 4) != 1), default=0)
    if cut not in chain.cuts or cut - offset < 32:
        return None
    end = chain.place(cut)
    if not chain.hex:
        room = -(cut - offset) % 4
        end += len(text[end : end + room]) - len(text[end : end + room].lstrip("="))
    return exact, "ssh_key" if ssh else "key_hex" if chain.hex else "key_b64", end


def keys(text: str, starts: re.Pattern, ways: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """Keys that begin anywhere in a run of an encoding, on one line or wrapped in one of these ways.

    Of several ways the first by which the lengths fit counts, else the one that
    goes furthest.  Places inside a key already found are passed over.  A chain of lines is
    joined once for all places in it, and each of these reads a bounded number of lengths.
    """
    found, free, chains = [], 0, {}
    for m in starts.finditer(text):
        at = m.start()
        if at < free or m[0] == "M" and not _may_begin(text[at : at + 8]):
            continue
        best = None
        for way in ways:
            if way not in chains or chains[way].end <= at:
                chains[way] = Chain(text, at, way)
            key = key_at(text, at, chains[way])
            if key and (not best or key[0] > best[0] or not best[0] and key[2] > best[2]):
                best = key
        if best:
            found.append((best[1], at, free := best[2]))
    return found


def _may_begin(eight: str) -> bool:
    """Whether a sequence's header, in base64, is followed by a version or another sequence."""
    head = base64.b64decode(eight.replace("-", "+").replace("_", "/"))
    after = 2 + (head[1] & 0x7F if head[1] & 0x80 else 0)
    return after >= len(head) or head[after] in (0x02, 0x30)


def header_start(part: str) -> int | None:
    """Where in a run the header of a signed token begins: base64, up to the run's end, of a JSON object that names its algorithm.

    The run is decoded once for each of four alignments.
    """
    plain, found = part.replace("-", "+").replace("_", "/"), []
    for shift in range(min(4, len(part))):
        own = plain[shift:]
        if len(own) % 4 == 1:
            continue
        data = base64.b64decode(own + "=" * (-len(own) % 4)).decode("latin-1")
        if not data.rstrip().endswith("}"):
            continue
        for m in _OBJECT.finditer(data):
            if m.start() % 3:
                continue
            try:
                header, end = _JSON.raw_decode(data, m.start())
            except (ValueError, RecursionError):  # the latter for brackets nested without end
                continue
            if not data[end:].strip() and isinstance(header.get("alg"), str):
                found.append(shift + m.start() // 3 * 4)
                break
    return min(found, default=None)


_JSON = json.JSONDecoder()


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates whose decoded form has the structure of a key or a signed token."""
    found = []
    for m in _TOKEN.finditer(text) if "." in text else ():
        at = header_start(m[0].split(".", 1)[0])
        if at is not None:
            found.append(("signed_token", m.start() + at, m.end()))
    return found + keys(text, _STARTS, ("added", "removed", "plain")) + keys(text, _HEX_STARTS, ("hex",))


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start, then kind as listed in KINDS, then end."""
    if not text:
        return []
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and spans, an array of (kind, start, end).

    A null or empty text has no spans.  Every whole text is read; rows with
    equal ids, and repeated rows, are scanned each by itself; other columns are
    ignored and an empty table gives an empty result.  No shuffle: one pass,
    batch by batch, in time proportional to the text.  A key may be indented,
    quoted, escaped, marked as mail or a diff, or stand behind other characters
    of its encoding; its span reaches from its first to its last character in
    the text as it is.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN))], ["doc_id", "spans"])

    return own.mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
