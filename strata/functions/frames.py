"""Binary frames of log records.

A frame is CRC-32 over all after itself, milliseconds, key length, value length,
key, value, numbers big-endian; the value length of a delete is 0xFFFFFFFF.
"""

import struct
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# The frame's header and limits.
HEADER_BYTES, MAX_KEY_BYTES, MAX_VALUE_BYTES, NO_VALUE = 20, 65536, 1 << 30, 0xFFFFFFFF


class FrameError(ValueError):
    pass


class TornFrame(FrameError):
    """The bytes end inside a frame."""


def encode(key: bytes, value: bytes | None, ts: int) -> bytes:
    if len(key) > MAX_KEY_BYTES or len(value or b"") > MAX_VALUE_BYTES:
        raise FrameError("key or value too long")
    body = struct.pack(">QII", ts, len(key), NO_VALUE if value is None else len(value)) + key + (value or b"")
    return struct.pack(">I", zlib.crc32(body)) + body


def decode(data: bytes, at: int = 0) -> tuple[bytes, bytes | None, int, int]:
    """key, value (None: deleted), milliseconds, and where the next frame begins."""
    if len(data) - at < HEADER_BYTES:
        raise TornFrame(f"{len(data) - at} bytes are no header")
    crc, ts, n_key, n_value = struct.unpack_from(">IQII", data, at)
    held = 0 if n_value == NO_VALUE else n_value
    if n_key > MAX_KEY_BYTES or held > MAX_VALUE_BYTES:
        raise FrameError("implausible lengths")
    end = at + HEADER_BYTES + n_key + held
    if end > len(data):
        raise TornFrame(f"{end - len(data)} bytes are missing")
    if zlib.crc32(data[at + 4 : end]) != crc:
        raise FrameError("checksum differs")
    body = data[at + HEADER_BYTES : end]
    return body[:n_key], None if n_value == NO_VALUE else body[n_key:], ts, end


def decode_all(data: bytes, sealed: bool) -> tuple[list[tuple[bytes, bytes | None, int]], int]:
    """Records and the length of the whole ones. A torn end is an error only in a sealed segment."""
    out, at = [], 0
    while at < len(data):
        try:
            key, value, ts, end = decode(data, at)
        except TornFrame:
            if sealed:
                raise
            break
        out.append((key, value, ts))
        at = end
    return out, at


def _number(n: Column, digits: int) -> Column:
    return F.lpad(F.hex(n), digits, "0")


def frame(key: Column, value: Column, ts: Column) -> Column:
    """The frame as a binary column, by built-in functions; a null value is a delete."""
    key, value = key.cast("binary"), value.cast("binary")
    size = F.when(value.isNull(), F.lit("FFFFFFFF")).otherwise(_number(F.octet_length(value), 8))
    body = F.unhex(F.concat(_number(ts, 16), _number(F.octet_length(key), 8), size, F.hex(key), F.coalesce(F.hex(value), F.lit(""))))
    return F.concat(F.unhex(_number(F.crc32(body), 8)), body)
