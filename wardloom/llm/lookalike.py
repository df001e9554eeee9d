"""One form for texts that look the same and consist of other characters.

1.  Compatibility normalisation and deletion of ignorable characters: width variants, ligatures and
    no-break forms become their plain letters, every blank becomes a space, signs that cannot be seen go,
    accents take one encoding.  What can be seen stays: case, accents, digits (also raised ones),
    punctuation, line breaks, the number of blanks.
2.  Look-alike letters of Latin, Cyrillic and Greek fall into classes.  The text's *skeleton* has a class
    in place of each such letter.  Some letters look like letters of two classes, or like another letter
    only in its company (:data:`AMBIGUOUS`, :data:`WEAK`); they stay open.
3.  Each token of the skeleton is a lattice of readings: one letter of a class per script, every reading of
    an open letter.  A Viterbi search over the tokens takes the best reading under script-consistent
    character bigrams, with a price for each change of script between and inside tokens and for each weak
    reading.  A text whose single-script letters are all Latin and that has no open letter is read in Latin
    throughout; that is decided without a search.

The form is the best reading.  It depends on the lattice only, so texts that differ by letters of one class
have equal forms; whether an open letter belongs to the one class or the other is decided by the search.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.session import cut

# Letters that look the same, class by class, in the order Latin, Cyrillic, Greek.
# A dot stands where a script has no such letter.
LOOK_ALIKES = """
aа. cсϲ dԁ. eе. hһ. iі. jјϳ oоο pр. qԛ. sѕ. vѵ. wԝ. xх. yу.
AАΑ BВΒ CСϹ EЕΕ GԌ. HНΗ IІΙ JЈͿ KКΚ MМΜ N.Ν OОΟ PРΡ QԚ. SЅ. TТΤ VѴ. WԜ. XХΧ Y.Υ Z.Ζ
"""
# Further letters that look like a plain Latin one.
MORE_LATIN = {"\u0261": "g", "\u0251": "a"}
# Letters that look like letters of several classes, likeliest first.
AMBIGUOUS = {"\u04c0": "Il", "\u04cf": "lI", "\u01c0": "lI"}
# Letters that pass for another script's letter among its letters, but have a look of their own elsewhere.
WEAK = {"\u03bd": "v", "\u03c5": "u", "\u03c1": "p", "\u03ba": "\u043a"}

SCRIPTS = "LCG"
_READ: dict[str, tuple[str, str, str]] = {}
_SKELETON: dict[int, str] = {ord(k): v for k, v in MORE_LATIN.items()}
for _entry in LOOK_ALIKES.split():
    _READ[_entry[0]] = (_entry[0], _entry[1], _entry[2])
    for _letter in _entry[1:]:
        if _letter != ".":
            _SKELETON[ord(_letter)] = _entry[0]

_SHARED = "".join(_READ)
_LATIN_ONLY = "".join(c for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in _READ)
_HAS_LATIN_ONLY = re.compile(f"[{_LATIN_ONLY}]").search
_HAS_SHARED = re.compile(f"[{_SHARED}]").search
_HAS_OPEN = re.compile("[" + "".join([*AMBIGUOUS, *WEAK]) + "]").search
_HAS_OTHER = re.compile("[\u01c0\u0370-\u052f\u1c80-\u1c8f\u1f00-\u1fff\u2de0-\u2dff\ua640-\ua69f]").search
_TOKEN = re.compile("[A-Za-z\u01c0\u0370-\u052f\u1c80-\u1c8f\u1f00-\u1fff\u0300-\u036f\u1ab0-\u1aff]+")
_MARK = re.compile("[\u0300-\u036f\u1ab0-\u1aff]+")

# ---- step 1

_ZWJ = "\u200d"
_WIDTH_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<font>")


def _plain(code: int) -> str | None:
    """What the character becomes in step 1, "" if it cannot be seen, None if it stays."""
    c = chr(code)
    kind = unicodedata.category(c)
    if c in "\t\n":
        return None
    if c in "\r\x0b\x0c\x85\u2028\u2029":
        return "\n"
    if kind == "Zs":
        return None if c == " " else " "
    if kind in ("Cc", "Cf") or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0):
        return ""
    if code in (0x2010, 0x2011):
        return "-"
    if 0xFB00 <= code <= 0xFB06 or 0x2160 <= code <= 0x217F or 0x01C4 <= code <= 0x01CC or 0x01F1 <= code <= 0x01F3 or code == 0xB5:
        return unicodedata.normalize("NFKC", c)
    if unicodedata.decomposition(c).startswith(_WIDTH_TAGS):
        return unicodedata.normalize("NFKC", c)
    return None


class _Table(dict):
    """Character table for str.translate that works out its entries as they are met: steps 1 and 2 at once."""

    def __missing__(self, code: int) -> str:
        plain = chr(code) if (p := _plain(code)) is None else p
        self[code] = value = unicodedata.normalize("NFD", plain).translate(_SKELETON)
        return value


_TABLE = _Table()
_CONTROL = re.compile("[\x00-\x08\x0b-\x1f\x7f]").search
_PICTOGRAPH = "[\u2190-\u2bff\U0001f000-\U0001faff]"
_JOINER = re.compile(f"{_PICTOGRAPH}[\ufe00-\ufe0f\U0001f3fb-\U0001f3ff]*\u200d(?={_PICTOGRAPH})")


def skeleton(text: str) -> str:
    """Steps 1 and 2, in decomposed form (NFD), classes written as their Latin letter."""
    if text.isascii() and not _CONTROL(text):
        return text
    text = text.replace("\r\n", "\n")
    if _ZWJ in text:
        # the joiner between pictographs can be seen: it makes one sign of two
        parts, at = [], 0
        for m in _JOINER.finditer(text):
            parts.append(text[at : m.end() - 1].translate(_TABLE))
            at = m.end()
        parts.append(text[at:].translate(_TABLE))
        return unicodedata.normalize("NFD", _ZWJ.join(parts))
    return unicodedata.normalize("NFD", text.translate(_TABLE))


# ---- step 3

BETWEEN, INSIDE, UNSEEN = 4.0, 12.0, -9.0


def _is_greek(c: str) -> bool:
    return "\u0370" <= c <= "\u03ff" or "\u1f00" <= c <= "\u1fff"


@cache
def readings(c: str) -> tuple[tuple[tuple[str, float], ...], ...]:
    """Per script, the letters that a letter of the skeleton can be read as, each with its price."""
    if c in AMBIGUOUS:
        return tuple((r, 0.0) for r in AMBIGUOUS[c]), (), ()
    if c in _READ:
        return tuple(((r, 0.0),) if r != "." else () for r in _READ[c])
    own = 0 if c.isascii() else 2 if _is_greek(c) else 1
    out: list[tuple[tuple[str, float], ...]] = [(), (), ()]
    out[own] = ((c, 0.0),)
    if c in WEAK:
        out[0 if WEAK[c].isascii() else 1] = ((WEAK[c], INSIDE),)
    return tuple(out)


def _scripts_of(c: str) -> tuple[bool, bool, bool]:
    """Which scripts can read the skeleton's letter."""
    return tuple(bool(r) for r in readings(c))


def _letter(c: str, s: int) -> str:
    return _READ[c][s] if c in _READ else c


def certain_script(token: str) -> int | None:
    """The one script that can read a skeleton token, None if there is none or more than one, or if it has an open letter."""
    if _HAS_OPEN(token) and not all(_is_greek(c) or c in _READ and _READ[c][2] != "." for c in token):
        return None
    able = [True, True, True]
    for c in token:
        able = [a and any(price == 0 for _, price in r) for a, r in zip(able, readings(c), strict=True)]
    return able.index(True) if sum(able) == 1 else None


class Bigrams:
    """Script-consistent character bigram scores: mean log probability of a token's letters."""

    def __init__(self, counts: dict[tuple[int, str], int]):
        totals: Counter = Counter()
        for (s, pair), n in counts.items():
            totals[s, pair[0]] += n
        weight = sum(counts.values()) or 1
        share: Counter = Counter()
        for (s, _), n in counts.items():
            share[s] += n
        self.prior = [math.log((share[s] + 1) / (weight + 3)) for s in range(3)]
        self.logs = {k: math.log(n / totals[k[0], k[1][0]]) for k, n in counts.items()}

    def read(self, token: str, s: int) -> tuple[float, str]:
        """Score and letters of a token's best reading in a script that can read it; unseen pairs count as :data:`UNSEEN`."""
        if not _HAS_OPEN(token):
            said = "".join(_letter(c, s) for c in token)
            text = f"^{said}$"
            return sum(self.logs.get((s, text[i : i + 2]), UNSEEN) for i in range(len(text) - 1)) / (len(token) + 1), said
        paths = [(0.0, 0.0, "^")]
        for c in token:
            step = []
            for letter, price in readings(c)[s]:
                step.append(max(((gain + self.logs.get((s, said[-1] + letter), UNSEEN), cost + price, said + letter) for gain, cost, said in paths), key=lambda p: (p[0], -p[1])))
            paths = step
        gain, cost, said = max(((gain + self.logs.get((s, said[-1] + "$"), UNSEEN), cost, said) for gain, cost, said in paths), key=lambda p: p[0])
        return gain / (len(token) + 1) - cost, said[1:]


def _mixed(token: str, bigrams: Bigrams) -> str:
    """Viterbi over the letters of a token that no single script can read."""
    paths: list[tuple[float, str, int]] = [(0.0, "", s) for s in range(3)]
    for i, c in enumerate(token):
        step = []
        for s, options in enumerate(readings(c)):
            for letter, price in options:
                best = None
                for score, said, before in paths:
                    gain = bigrams.logs.get((s, (said[-1] if said else "^") + letter), UNSEEN) if before == s else UNSEEN - INSIDE * (i > 0)
                    if best is None or score + gain - price > best[0]:
                        best = (score + gain - price, said + letter, s)
                step.append(best)
        paths = step
    return max(paths, key=lambda p: p[0])[1]


def read_tokens(tokens: list[str], bigrams: Bigrams) -> list[str]:
    """The best readings of a text's skeleton tokens (without accents), by Viterbi over their scripts."""
    scores = [0.0, 0.0, 0.0]
    back: list[list[int]] = []
    said_in = []
    for token in tokens:
        able = [True, True, True]
        for c in token:
            able = [a and b for a, b in zip(able, _scripts_of(c), strict=True)]
        read = [bigrams.read(token, s) if able[s] else (-INSIDE * 3, None) for s in range(3)]
        said_in.append([r[1] for r in read])
        own = [r[0] + 0.1 * bigrams.prior[s] if able[s] else r[0] for s, r in enumerate(read)]
        step, arrows = [], []
        for s in range(3):
            came = max(range(3), key=lambda b: (scores[b] - BETWEEN * (b != s), -b))  # noqa: B023
            step.append(scores[came] - BETWEEN * (came != s) + own[s])
            arrows.append(came)
        scores = step
        back.append(arrows)
    s = max(range(3), key=lambda b: (scores[b], -b))
    out: list[str] = []
    for token, arrows, said in zip(reversed(tokens), reversed(back), reversed(said_in), strict=True):
        out.append(said[s] if said[s] is not None else _mixed(token, bigrams))
        s = arrows[s]
    return out[::-1]


def canonical(text: str, bigrams: Bigrams) -> str:
    """The one form of a text."""
    bones = skeleton(text)
    if (_HAS_LATIN_ONLY(bones) and not _HAS_OTHER(bones)) or not (_HAS_SHARED(bones) or _HAS_OPEN(bones)):
        return bones if bones.isascii() else unicodedata.normalize("NFC", bones)
    found = list(_TOKEN.finditer(bones))
    bare = [_MARK.sub("", m.group()) for m in found]
    read = iter(read_tokens([b for b in bare if b], bigrams))
    parts, at = [], 0
    for m, b in zip(found, bare, strict=True):
        parts.append(bones[at : m.start()])
        at = m.end()
        if not b:
            parts.append(m.group())
            continue
        letters = iter(next(read))
        parts.append("".join(c if _MARK.match(c) else next(letters) for c in m.group()))
    parts.append(bones[at:])
    return unicodedata.normalize("NFC", "".join(parts))


# ---- Spark

_WORDS_HELD = 200_000


def bigram_counts(texts: DataFrame, column: str) -> dict[tuple[int, str], int]:
    """Character bigram counts by script over all texts, from tokens that only one script can read.

    Counted per partition and summed over the cluster; what reaches the driver is bounded by the square
    of the three alphabets (a few ten thousand numbers), whatever the size of the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        pairs: Counter = Counter()

        def flush() -> None:
            for token, n in words.items():
                bare = _MARK.sub("", token)
                s = certain_script(bare) if bare else None
                if s is not None:
                    text = "^" + "".join(_letter(c, s) for c in bare) + "$"
                    for i in range(len(text) - 1):
                        pairs[s, text[i : i + 2]] += n
            words.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    words.update(_TOKEN.findall(skeleton(text)))
            if len(words) > _WORDS_HELD:
                flush()
        flush()
        keys = list(pairs)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([pairs[k] for k in keys], pa.int64())],
            names=["script", "pair", "n"],
        )

    found = texts.select(column).mapInArrow(count, "script int, pair string, n long")
    return {(r.script, r.pair): r.n for r in found.groupBy("script", "pair").agg(F.sum("n").alias("n")).collect()}


def with_form(df: DataFrame, column: str, form: str = "form", bigrams: Bigrams | None = None) -> DataFrame:
    """``df`` with the canonical form of a text column; null stays null, empty text stays empty."""
    bigrams = bigrams or Bigrams(bigram_counts(df, column))

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: None if t is None else canonical(t, bigrams))

    return df.withColumn(form, run(F.col(column)))


def same_look_pairs(df: DataFrame, key: str, raw: str, form: str, rows_per_task: int = 20_000) -> DataFrame:
    """(``key``_a, ``key``_b), a < b: rows whose forms are equal and whose raw texts are not.

    Works on digests.  Rows are first counted per (form, raw) spelling; only forms with two spellings or
    more go on, as pairs of spellings, and each pair of spellings then meets its rows.  Rows of one
    spelling never meet each other, so the copies of a common text cost nothing by themselves.  A spelling
    with very many rows is spread over salts of ``rows_per_task`` rows.  Rows with null text pair with none.
    """
    e = df.where(F.col(raw).isNotNull()).select(F.col(key).alias("k"), F.unhex(F.md5(F.col(form).cast("binary"))).alias("f"), F.unhex(F.md5(F.col(raw).cast("binary"))).alias("r"))
    e = cut(e)
    spellings = e.groupBy("f", "r").agg(F.count(F.lit(1)).alias("n"))
    several = spellings.groupBy("f").agg(F.count(F.lit(1)).alias("s")).where("s > 1").select("f")
    few = cut(spellings.join(several, "f", "left_semi").withColumn("salts", F.ceil(F.col("n") / rows_per_task).cast("int")))
    a = few.select("f", F.col("r").alias("ra"), F.col("salts").alias("sa"))
    b = few.select("f", F.col("r").alias("rb"), F.col("salts").alias("sb"))
    pairs = a.join(b, "f").where("ra < rb")
    rows = e.join(few.select("f", "r", "salts"), ["f", "r"]).withColumn("salt", F.pmod(F.xxhash64("k"), F.col("salts").cast("long")).cast("int"))
    left = rows.select("f", F.col("r").alias("ra"), F.col("salt").alias("ta"), F.col("k").alias("ka"))
    right = rows.select("f", F.col("r").alias("rb"), F.col("salt").alias("tb"), F.col("k").alias("kb"))
    spread = pairs.withColumn("ta", F.explode(F.sequence(F.lit(0), F.col("sa") - 1))).withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("sb") - 1)))
    met = spread.join(left, ["f", "ra", "ta"]).join(right, ["f", "rb", "tb"])
    return met.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b"))


def look_classes(df: DataFrame, key: str, raw: str, form: str) -> DataFrame:
    """(``key``, class_id, spellings, links): the class of each row whose form is not its alone.

    ``class_id`` is the least key of the form, ``spellings`` the number of different raw texts in the class,
    ``links`` the number of its rows whose raw text is another one.  Rows with null text are in no class.
    One row per row: nothing is paired.
    """
    e = df.where(F.col(raw).isNotNull()).select(F.col(key), F.unhex(F.md5(F.col(form).cast("binary"))).alias("f"), F.unhex(F.md5(F.col(raw).cast("binary"))).alias("r"))
    e = cut(e)
    spelled = e.groupBy("f", "r").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least"))
    classes = spelled.groupBy("f").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("rows")).where("rows > 1")
    own = spelled.select("f", "r", "n").join(classes, "f").withColumn("links", F.col("rows") - F.col("n")).drop("rows", "n")
    return e.join(own, ["f", "r"]).select(key, "class_id", "spellings", "links")
