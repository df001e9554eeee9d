"""Measures that Spark has no function for, as Arrow-batched UDFs.  Null gives null."""

from __future__ import annotations

import math
import re
import struct
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as Y


def entropy_of(items, size: int | None = None) -> float:
    """Shannon entropy in bits; ``size`` is the denominator of the shares if it is not the number of items."""
    counts = Counter(items)
    n = sum(counts.values()) if size is None else size
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


_TYPES = {"double": Y.DoubleType(), "string": Y.StringType(), "boolean": Y.BooleanType(), "binary": Y.BinaryType()}


def _struct(kind: Y.DataType, *names: str) -> Y.StructType:
    return Y.StructType([Y.StructField(n, kind) for n in names])


def _mapped(kind: str, f):
    @F.pandas_udf(_TYPES[kind])
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f(v))

    return run


char_entropy = _mapped("double", entropy_of)
char_entropy_by_bytes = _mapped("double", lambda t: entropy_of(t, len(t.encode())))
byte_entropy = _mapped("double", lambda t: entropy_of(t.encode() if isinstance(t, str) else bytes(t)))
nfc = _mapped("string", lambda t: unicodedata.normalize("NFC", t))
nfkc = _mapped("string", lambda t: unicodedata.normalize("NFKC", t))


def compression(text: str, piece: int = 65_536) -> float:
    """Compressed over plain bytes of the whole text, at most 1; it is fed in pieces, and what comes out is only counted."""
    packer, data = zlib.compressobj(1), memoryview(text.encode())
    size = sum(len(packer.compress(data[i : i + piece])) for i in range(0, len(data), piece)) + len(packer.flush())
    return min(1.0, size / len(data)) if len(data) else 1.0


zlib_ratio = _mapped("double", compression)


def _to_idna(host: str) -> str | None:
    try:
        return host.encode("idna").decode()
    except UnicodeError:
        return None


idna = _mapped("string", _to_idna)


def repetition(text: str) -> float:
    """Mix of the best periodic agreement (periods up to 64) and the longest run of one character."""
    n = len(text)
    if n < 4:
        return 0.0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    best = 0.0
    for p in range(1, min(n // 2, 64) + 1):
        best = max(best, min(1.0, np.count_nonzero(codes[p:] == codes[:-p]) / (n - p) * (1 + 1 / p)))
    breaks = np.flatnonzero(codes[1:] != codes[:-1])
    longest = int(np.diff(np.r_[-1, breaks, n - 1]).max())
    return min(1.0, 0.55 * best + 0.45 * longest / n)


repetition_score = _mapped("double", repetition)


_SIGN = re.compile(r"[^\w\s]|_").finditer


def dense_signs(text: str, window: int = 50, limit: float = 0.3) -> bool:
    """Whether some window of characters has a share of signs (no letter, digit or blank) above ``limit``."""
    size = min(window, len(text.encode()))
    if size == 0 or len(text) < size:
        return False
    need = int(limit * size) + 1
    # the least number of signs whose share is above the limit, in whole numbers
    while (need - 1) / size > limit:
        need -= 1
    at = np.array([m.start() for m in _SIGN(text)])
    return len(at) >= need and bool((at[need - 1 :] - at[: len(at) - need + 1] < size).any())


sign_density = _mapped("boolean", dense_signs)


def integrity(text: str, tail: int = 160) -> tuple[float, float, float]:
    """Entropy of the head and of the last ``tail`` characters of the text without blanks, and the tail's repetition."""
    plain = "".join(text.split())
    head, end = (plain[:-tail], plain[-tail:]) if len(plain) > tail else ("", plain)
    return entropy_of(head), entropy_of(end), repetition(end)


@F.pandas_udf(_struct(Y.DoubleType(), "head_entropy", "tail_entropy", "tail_repetition"))
def integrity_report(values: pd.Series) -> pd.DataFrame:
    rows = [integrity(v) if v is not None else (None, None, None) for v in values]
    return pd.DataFrame(rows, columns=["head_entropy", "tail_entropy", "tail_repetition"])


def bands(text: str, lookback: int = 640, window: int = 96, step: int = 24, entropy: float = 5.05, repeated: float = 0.82) -> tuple[int, int]:
    """Windows over the last ``lookback`` characters without blanks that are noise or repetition: count, longest run."""
    plain = "".join(text.split())[-lookback:]
    size = min(window, len(plain))
    if not size:
        return 0, 0
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rows = np.lib.stride_tricks.sliding_window_view(codes, size)[::step]
    best = np.zeros(len(rows))
    for p in range(1, min(size // 2, 64) + 1):
        best = np.maximum(best, np.minimum(1.0, (rows[:, p:] == rows[:, :-p]).sum(axis=1) / (size - p) * (1 + 1 / p)))
    odd = longest = run = 0
    for row, periodic in zip(rows, best, strict=True):
        breaks = np.flatnonzero(row[1:] != row[:-1])
        streak = int(np.diff(np.r_[-1, breaks, size - 1]).max())
        again = min(1.0, 0.55 * periodic + 0.45 * streak / size) if size >= 4 else 0.0
        counts = np.unique(row, return_counts=True)[1] / size
        if -(counts * np.log2(counts)).sum() > entropy or again >= repeated:
            odd += 1
            run += 1
            longest = max(longest, run)
        else:
            run = 0
    return odd, longest


@F.pandas_udf(_struct(Y.IntegerType(), "odd", "longest"))
def rolling_bands(values: pd.Series) -> pd.DataFrame:
    rows = [bands(v) if v is not None else (None, None) for v in values]
    return pd.DataFrame(rows, columns=["odd", "longest"]).astype("Int32")


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity raised by a common prefix of up to four characters."""
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(Y.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def windows(n: int):
    """UDF: all windows of ``n`` characters of a text, in order (slices cost the same wherever they lie)."""

    @F.pandas_udf(Y.ArrayType(Y.StringType()))
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else [t[i : i + n] for i in range(len(t) - n + 1)])

    return run


def window_ids(codes: np.ndarray, n: int, base: int = 2) -> np.ndarray:
    """A number for each window of ``n`` codes (from 0), equal exactly where the windows are equal.

    As many codes as fit are the digits of one number; longer windows are pairs of shorter ones by rank.
    With a ``base`` above all codes numbers that need no rank are the same for all calls.
    """
    base, m = max(base, int(codes.max()) + 1), 1
    while m < n and base ** (m + 1) < 2**63:
        m += 1
    out = codes[: len(codes) - m + 1].astype(np.int64)
    for j in range(1, m):
        out *= base
        out += codes[j : j + len(out)]
    while m < n:
        step = min(m, n - m)
        rank = np.unique(out, return_inverse=True)[1]
        out = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        m += step
    return out


def window_repetition(n: int):
    """UDF: 1 - distinct / all windows of ``n`` characters; 0 for texts of at most ``n``."""

    def run(text: str) -> float:
        if len(text) <= n:
            return 0.0
        letters = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_inverse=True)[1]
        return 1 - len(np.unique(window_ids(letters, n))) / (len(text) - n + 1)

    return _mapped("double", run)


_SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARABIC", "HEBREW", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "DEVANAGARI", "THAI", "ARMENIAN")


def script_of(c: str) -> str | None:
    """Script of a letter by its name; None for signs that all scripts share."""
    if not c.isalpha():
        return None
    head = unicodedata.name(c, "").split(" ")[0]
    return head if head in _SCRIPTS else "OTHER"


mixed_script_label = _mapped("boolean", lambda host: any(len({s for s in map(script_of, label) if s}) > 1 for label in host.split(".")))


def strip_image(data: bytes) -> bytes | None:
    """A JPEG without APP1, APP13 and comment segments, a PNG without text and EXIF chunks; None if damaged or neither."""
    data = bytes(data)
    if data[:2] == b"\xff\xd8":
        out, at = bytearray(data[:2]), 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                return None
            kind = data[at + 1]
            if kind == 0xDA:
                return bytes(out + data[at:])
            if kind == 0xD9:
                return bytes(out + data[at : at + 2])
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            if size < 2 or at + 2 + size > len(data):
                return None
            if kind not in (0xE1, 0xED, 0xFE):
                out += data[at : at + 2 + size]
            at += 2 + size
        return bytes(out + data[at:]) if data[at:] == b"\xff\xd9" else None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        out, at = bytearray(data[:8]), 8
        while at + 12 <= len(data):
            size = struct.unpack(">I", data[at : at + 4])[0]
            chunk = data[at : at + 12 + size]
            if len(chunk) < 12 + size or struct.unpack(">I", chunk[-4:])[0] != zlib.crc32(chunk[4:-4]):
                return None
            if chunk[4:8] not in (b"tEXt", b"zTXt", b"iTXt", b"eXIf"):
                out += chunk
            if chunk[4:8] == b"IEND":
                return bytes(out)
            at += 12 + size
    return None


image_without_metadata = _mapped("binary", strip_image)
