"""Column functions of the packet engine: header fields, hex guards and bit distances, as built-in expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from busline.schema import CLASSES, DISCOVERY_SERVICE, HEADER_BYTES, KEPT_PAYLOAD_BYTES, MESSAGE_TYPES, PROTOCOL_VERSION, VALID_MESSAGE_TYPES


def uint_at(raw: Column, at: int, size: int) -> Column:
    """The big-endian unsigned integer of `size` bytes at byte `at` of a BINARY column; null beyond its end."""
    return F.conv(F.hex(F.substring(raw, at + 1, size)), 16, 10).cast("bigint")


#: Header fields: name, first byte, bytes.
HEADER = [
    ("service_id", 0, 2), ("method_id", 2, 2), ("someip_len", 4, 4), ("client_id", 8, 2), ("session_id", 10, 2),
    ("proto_ver", 12, 1), ("iface_ver", 13, 1), ("msg_type", 14, 1), ("return_code", 15, 1),
]


def header_fields(raw: Column, valid: Column | None = None) -> list[Column]:
    """The header fields of raw, null where valid (default: long enough) does not hold."""
    ok = F.length(raw) >= HEADER_BYTES if valid is None else valid
    return [F.when(ok, uint_at(raw, at, n).cast("bigint" if n == 4 else "int")).alias(name) for name, at, n in HEADER]


def message_type_name(code: Column) -> Column:
    """The name of a message type, or 0x and two hex digits."""
    name = F.concat(F.lit("0x"), F.lpad(F.hex(code), 2, "0"))
    for k, v in MESSAGE_TYPES.items():
        name = F.when(code == k, v).otherwise(name)
    return F.when(code.isNotNull(), name)


def is_valid_message(raw: Column) -> Column:
    """Whether raw begins with a plausible message: whole header, known version and type, length of 8 or more."""
    ok = (F.length(raw) >= HEADER_BYTES) & (uint_at(raw, 12, 1) == PROTOCOL_VERSION) & uint_at(raw, 14, 1).isin(VALID_MESSAGE_TYPES) & (uint_at(raw, 4, 4) >= 8)
    return F.coalesce(ok, F.lit(False))


def is_discovery(service_id: Column) -> Column:
    return service_id == DISCOVERY_SERVICE


def kept_hex(raw: Column, first: int = 1, size: int = KEPT_PAYLOAD_BYTES) -> Column:
    """Lower-case hex of `size` bytes of raw from the 1-based byte `first` on."""
    return F.lower(F.hex(F.substring(raw, first, size)))


def is_hex(text: Column) -> Column:
    """Whether text is whole bytes in hex; unhex() alone would pad an odd digit."""
    return F.coalesce(text.rlike("^([0-9a-fA-F]{2})+$"), F.lit(False))


_DIGIT = np.full(256, 255, np.uint8)
for _i, _c in enumerate(b"0123456789abcdef"):
    _DIGIT[_c] = _i
for _i, _c in enumerate(b"ABCDEF", 10):
    _DIGIT[_c] = _i
#: Digits that bits_apart() looks at together, or one text if it is longer.
_DIGITS_AT_ONCE = 1 << 22


def hex_digits(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts their characters as digits (255: none), where each begins, its length, and whether it is whole bytes in hex; null is as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    digit = _DIGIT[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offset[0] : offset[-1]]]
    offset = offset - offset[0]
    length = np.diff(offset)
    good = (length > 0) & (length % 2 == 0)
    good[np.searchsorted(offset, np.flatnonzero(digit == 255), side="right") - 1] = False
    return digit, offset[:-1], length, good


def bits_apart(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Share of differing bits over the shorter of two hex texts, by row; 0 if a side is null, empty or no hex."""
    (x, x_at, x_size, x_good), (y, y_at, y_size, y_good) = hex_digits(a), hex_digits(b)
    size = np.where(x_good & y_good, np.minimum(x_size, y_size), 0)
    end, out = np.cumsum(size), np.zeros(len(size))
    first = 0
    while first < len(size):
        done = end[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(end, done + _DIGITS_AT_ONCE, side="right")))
        n, ends = size[first:stop], end[first:stop] - done
        place = np.arange(ends[-1]) - np.repeat(ends - n, n)
        bits = np.bitwise_count(x[np.repeat(x_at[first:stop], n) + place] ^ y[np.repeat(y_at[first:stop], n) + place])
        upto = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        out[first:stop] = np.where(n > 0, (upto[ends] - upto[ends - n]) / np.maximum(4 * n, 1), 0.0)
        first = stop
    return out


def bit_distance(a: Column, b: Column) -> Column:
    """Share of differing bits over the shorter of two hex payloads; 0 if a side is null, empty or no hex.

    Batches are compared in numpy, in time that grows with the digits: built-in functions would convert each piece of a payload to a number in text and back.
    """

    @F.arrow_udf("double")
    def apart(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(bits_apart(x, y))

    return apart(a, b)


def class_index(attack_type: Column) -> Column:
    """Position of the class, 0 for anything unknown."""
    out = F.lit(0)
    for i, name in enumerate(CLASSES):
        out = F.when(attack_type == name, i).otherwise(out)
    return out


def gap(now: Column, before: Column) -> Column:
    """Absolute difference, 0 if a side is missing."""
    return F.coalesce(F.abs(now - before).cast("double"), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 if b is 0 or a side is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def bar(share: Column, width: int = 40) -> Column:
    """A text bar of share times width."""
    return F.repeat(F.lit("#"), (share * width).cast("int"))
