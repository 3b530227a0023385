"""Secret scans: patterns find candidates, and decoding their structure confirms keys and signed tokens."""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from busline.llm.common import append_from_text

#: The base patterns: kind, pattern, group whose length counts, its least length. Kinds in the order of ties.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: Kinds that structure confirms, after the base kinds: private keys in DER and in the OpenSSH format, signed tokens.
CONFIRMED = ("der", "ssh", "jwt")
_ORDER = {k: i for i, k in enumerate([*(b[0] for b in BASE), *CONFIRMED])}
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: The body of a dotted token, from the dot before it; its header ends and its signature begins at a dot.
_BODY = re.compile(r"\.(?=([A-Za-z0-9_-]+)\.)")
_URL_RUN = re.compile(r"[A-Za-z0-9_-]*")
_URL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
#: What may part the digits of a key: line ends, also as a backslash and a letter, with blanks around them.
_WRAP = r"[ \t]*+(?:(?:[\r\n]|\\++[rn])[ \t]*+)++"
_WRAPS = re.compile(_WRAP)
_PADS = [re.compile(rf"(?:{_WRAP})?+={{1,{k}}}") for k in (1, 2)]
_SSH = b"openssh-key-v1\0"


Read = Callable[[int, int], bytes]


def der_item(read: Read, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER item at byte `at`, None if it doesn't end by `end`; its contents are not read."""
    head = read(at, min(at + 6, end))
    if len(head) < 2:
        return None
    tag, size, begin = head[0], head[1], at + 2
    if size & 0x80:
        k = size & 0x7F
        if not 1 <= k <= 4 or len(head) < 2 + k:
            return None
        size, begin = int.from_bytes(head[2 : 2 + k], "big"), begin + k
    return (tag, begin, begin + size) if begin + size <= end else None


def der_items(read: Read, at: int, end: int, most: int) -> list[tuple[int, int, int]] | None:
    """The DER items that fill the bytes from `at` to `end` exactly, None if lengths don't nest or there are more than `most`."""
    items = []
    while at < end:
        item = der_item(read, at, end) if len(items) < most else None
        if not item:
            return None
        items.append(item)
        at = item[2]
    return items


def der_size(read: Read, end: int) -> int | None:
    """Length of the DER private key that the bytes begin with, of `end` at most, or None: a sequence of a version number of 0 or 1 and
    the integers of a key (8 of RSA, 5 of DSA), an octet string and what may follow in an EC key, or an algorithm and an octet string (PKCS #8), every
    length nested exactly. No kind of key has more than nine items, so only as many heads are read, however long the key says that it is."""
    outer = der_item(read, 0, end)
    if not outer or outer[0] != 0x30 or read(outer[1], outer[1] + 3) not in (b"\x02\x01\x00", b"\x02\x01\x01"):
        return None
    inner = der_items(read, outer[1] + 3, outer[2], 8)
    tags = [t for t, _, _ in inner or []]
    if not tags:
        return None
    if tags[0] == 0x02:
        good = len(tags) in (5, 8) and all(t == 0x02 for t in tags)
    elif tags[0] == 0x04:
        good = inner[0][2] - inner[0][1] >= 16 and len(tags) <= 3
    else:
        good = tags[0] == 0x30 and tags[1:2] == [0x04] and len(tags) <= 4 and bool(der_items(read, inner[0][1], inner[0][2], 8))
    return outer[2] if good else None


def ssh_size(read: Read, end: int) -> int | None:
    """Length of the OpenSSH private key that the bytes begin with, of `end` at most, or None: its magic, then cipher, KDF and options as
    length-prefixed strings, a key count, and as many public keys as it says followed by the private part."""
    if read(0, len(_SSH)) != _SSH:
        return None
    at = len(_SSH)

    def take() -> int | None:
        nonlocal at
        n = int.from_bytes(read(at, at + 4), "big") if at + 4 <= end else end
        if at + 4 + n > end:
            return None
        at += 4 + n
        return n

    cipher, kdf, options = take(), take(), take()
    if not cipher or not kdf or options is None or at + 4 > end:
        return None
    count = int.from_bytes(read(at, at + 4), "big")
    at += 4
    return at if 1 <= count <= 16 and all(take() for _ in range(count + 1)) else None


def _json(raw: bytes) -> object:
    try:
        return json.loads(raw)
    except (ValueError, RecursionError):
        return None


def _from_url(part: str) -> bytes:
    return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)) if len(part) % 4 != 1 else b""


def object_start(raw: bytes) -> int | None:
    """Where the JSON object begins that raw ends with, if it ends with one: the brace that its last one closes, read backwards.

    A quote ends a string that begins at the quote before which an even number of backslashes stands.
    """
    at, depth = len(raw.rstrip(b" \t\r\n")) - 1, 0
    if at < 0 or raw[at] != 0x7D:
        return None
    while at >= 0:
        if raw[at] == 0x22:
            at = raw.rfind(b'"', 0, at)
            while at > 0 and _escaped(raw, at):
                at = raw.rfind(b'"', 0, at)
        elif raw[at] == 0x7D:
            depth += 1
        elif raw[at] == 0x7B:
            depth -= 1
            if not depth:
                return at
        at -= 1
    return None


def _escaped(raw: bytes, at: int) -> bool:
    k = at
    while k and raw[k - 1] == 0x5C:
        k -= 1
    return (at - k) % 2 == 1


def header_start(run: str) -> int | None:
    """Where in a run of base64url letters the JSON header of a signed token begins that the run ends with: an object that names an algorithm.

    In each of four ways to part the run into groups of letters one place can begin an object that ends with the run, so four are parsed.
    """
    found = []
    for phase in range(min(4, len(run))):
        raw = _from_url(run[phase:])
        at = object_start(raw)
        if at is not None and at % 3 == 0:
            head = _json(raw[at:])
            if isinstance(head, dict) and isinstance(head.get("alg"), str):
                found.append(phase + at // 3 * 4)
    return min(found, default=None)


def find_tokens(text: str) -> Iterator[tuple[int, str, int]]:
    """(start, "jwt", end) of signed tokens, leftmost and non-overlapping: a base64url JSON header with a signature algorithm, a JSON object as body,
    and a signature, which may be empty. Runs between dots are taken apart, so a token may follow letters or dotted parts that belong to none."""
    end = 0
    for m in _BODY.finditer(text):
        dot = m.start()
        if dot <= end or text[dot - 1] not in _URL_LETTERS or len(m[1]) % 4 == 1 or _from_url(m[1][:4])[:1] not in (b"{", b" ", b"\t", b"\r", b"\n"):
            continue
        if not isinstance(_json(_from_url(m[1])), dict):
            continue
        begin = dot
        while begin > end and text[begin - 1] in _URL_LETTERS:
            begin -= 1
        at = header_start(text[begin:dot])
        if at is not None:
            yield begin + at, "jwt", (end := _URL_RUN.match(text, m.end(1) + 1).end())


class Code(NamedTuple):
    """Digits that bytes are written in: bits of a digit, decoding, where a key of `least` bytes or more may start in a text, and in digits alone."""

    bits: int
    least: int
    digits: re.Pattern
    decode: Callable[[str], bytes]
    starts: re.Pattern
    inner: re.Pattern


def _code(bits: int, least: int, digit: str, decode: Callable[[str], bytes], *firsts: list[str]) -> Code:
    first = "|".join(f"(?:{_WRAP})?+".join(x) for x in firsts)
    more = -(-least * 8 // bits) - min(map(len, firsts))
    return Code(bits, least, re.compile(f"{digit}+"), decode, re.compile(f"(?:{first})(?=(?:(?:{_WRAP})?+{digit}){{{more}}})"), re.compile("|".join(map("".join, firsts))))


_URL = str.maketrans("-_", "+/")


def _from_base64(raw: str) -> bytes:
    raw = raw[: len(raw) - (len(raw) % 4 == 1)].translate(_URL)
    return base64.b64decode(raw + "=" * (-len(raw) % 4))


#: A DER key starts with byte 0x30 and a length below 0x80 or of 0x81 to 0x84, an OpenSSH key with "openssh-key".
CODES = (
    # Both alphabets of base64; five dashes are no digits but the mark that ends a key.
    _code(6, 29, "(?:[A-Za-z0-9+/_]|-(?!----))", _from_base64, ["M", "[A-I]"], list("b3Blbn")),
    _code(4, 32, "[0-9a-fA-F]", lambda raw: bytes.fromhex(raw[: len(raw) // 2 * 2]), ["3", "0"], ["6", "[fF]", "7", "0"]),
)


class Digits:
    """The digits from text[at] on without what parts them, and where each stands in the text."""

    def __init__(self, text: str, at: int, code: Code):
        self.code, self.begin, self.place, parts, n = code, [], [], [], 0
        while m := code.digits.match(text, at):
            self.begin.append(n)
            self.place.append(at)
            parts.append(m[0])
            n, at = n + len(m[0]), m.end()
            if not (wrap := _WRAPS.match(text, at)):
                break
            at = wrap.end()
        self.plain, self.end = "".join(parts), self.place[-1] + len(parts[-1])

    def offset(self, i: int) -> int:
        """The place of digit i in the text."""
        k = bisect.bisect_right(self.begin, i) - 1
        return self.place[k] + i - self.begin[k]

    def reader(self, i: int) -> Read:
        """Reads bytes a to b of what is written from digit i on."""
        def read(a: int, b: int) -> bytes:
            if self.code.bits == 4:
                return self.code.decode(self.plain[i + 2 * a : i + 2 * b])
            lead = a // 3
            return self.code.decode(self.plain[i + 4 * lead : i - (-b // 3) * 4])[a - 3 * lead : b - 3 * lead]

        return read


def find_keys(text: str, code: Code) -> Iterator[tuple[int, str, int]]:
    """(start, kind, end) of the private keys written in code, leftmost and non-overlapping, whatever stands around them.

    Every digit that a key may start with is tried; its own lengths say where it ends, of which only a few bytes are read, so time grows with the text alone.
    """
    done = 0
    for start in code.starts.finditer(text):
        if start.start() < done:
            continue
        digits, after = Digits(text, start.start(), code), 0
        done = digits.end
        for m in code.inner.finditer(digits.plain):
            i = m.start()
            held = (len(digits.plain) - i) * code.bits // 8
            if i < after or held < code.least:
                continue
            read = digits.reader(i)
            kind, size = "der", der_size(read, held)
            if not size:
                kind, size = "ssh", ssh_size(read, held)
            if not size or size < code.least:
                continue
            after = i - (-size * 8 // code.bits)
            end = digits.offset(after - 1) + 1
            pad = _PADS[2 - size % 3].match(text, end) if code.bits == 6 and size % 3 else None
            yield digits.offset(i), kind, pad.end() if pad else end


def find_secrets(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(start, kind, end) of the base matches and of the confirmed candidates, offsets in code points, end exclusive."""
    text = text or ""
    base: list[tuple[int, str, int]] = []
    low = text.lower()
    for kind, pattern, group, least in BASE:
        # Cheap necessary conditions first; the pattern decides.
        if kind == "assign" and not any(w in low for w in _ASSIGN_WORDS) or kind == "access" and "AKIA" not in text or kind == "hex" and not _LONG_HEX.search(text):
            continue
        base += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    more: list[tuple[int, str, int]] = []
    more += find_tokens(text)
    for code in CODES:
        more += find_keys(text, code)
    order = lambda s: (s[0], _ORDER[s[1]], s[2])
    return sorted(base, key=order), sorted(more, key=order)


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


FIELDS = T.StructType([
    T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()),
    T.StructField("n_confirmed", T.LongType()), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs with n_assign, n_access, n_hex, n_confirmed, base_sha256 and spans (kind:start:end, comma-joined).

    Base matches are leftmost and non-overlapping per kind and stay whatever structure says; base64 and hex candidates
    and dotted tokens are added as der, ssh or jwt when they decode to a private key or a signed token. Keys may start at
    any digit and be wrapped by line ends, indentation or a literal backslash-n. Whole texts; null
    counts as empty and gives no span. Extra columns pass, except those named like a result; repeated rows are
    scanned one by one, an empty table gives no rows. No shuffle.
    """
    def start():
        def run(texts: list) -> list[list]:
            out: list[list] = [[] for _ in FIELDS]
            for text in texts:
                base, more = find_secrets(text)
                row = [sum(k == kind for _, k, _ in base) for kind in ("assign", "access", "hex")]
                every = sorted(base + more, key=lambda s: (s[0], _ORDER[s[1]], s[2]))
                row += [len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)]
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return run

    return append_from_text(docs, start, FIELDS)
