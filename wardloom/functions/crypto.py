"""Hashes and message authentication codes as Spark columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pads(key: bytes) -> tuple[bytes, bytes]:
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(key: bytes, message: Column, hex_digits: int = 64) -> Column:
    """HMAC-SHA256 of the UTF-8 text, as the first ``hex_digits`` hexadecimal digits."""
    return hmac_sha256_of(key, F.encode(message, "utf-8"), hex_digits)


def hmac_sha256_of(key: bytes, message: Column, hex_digits: int = 64) -> Column:
    """HMAC-SHA256 of bytes."""
    inner_pad, outer_pad = _pads(key)
    inner = F.sha2(F.concat(F.lit(bytearray(inner_pad)), message), 256)
    return F.substring(F.sha2(F.concat(F.lit(bytearray(outer_pad)), F.unhex(inner)), 256), 1, hex_digits)


def stable_uuid(*parts: Column) -> Column:
    """A uuid that depends on the parts only, so that retries and reruns give the same one."""
    h = F.sha2(F.concat_ws(":", *parts), 256)
    return F.concat_ws("-", *[F.substring(h, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def decoded_base64(token: Column) -> Column:
    """UTF-8 text of a strictly padded base64 token, else null."""
    raw = F.when(F.length(token) % 4 == 0, F.try_to_binary(token, F.lit("base64")))
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text)
