"""Personal information in free text: found, scored, and replaced with typed placeholders.

1.  Regular expressions and a name model propose spans of seven kinds.  They look at a view of the text of
    the same length in which wide letters, odd blanks and hyphens have their plain form, so every span is
    also a span of the raw text.
2.  Validators confirm or reject: mod-97 (French social insurance numbers, bank accounts), the mod-23 letter
    (Spanish identity cards), Luhn (payment cards), numbering plans.  Bank accounts and cards must pass theirs.
    An identity number that fails its own stays below the threshold unless its context lifts it.
3.  Words before and after a span raise or lower the score, and so does other personal information next to
    it (a signature, a line of a list).  Spans below the threshold go; of overlapping ones the kind whose
    shape says most wins, then the longer.

Placeholders are ``[KIND_n]``; one value has the same number all through a text.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.llm.lookalike import skeleton

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "STREET_ADDRESS", "PERSON")
#: Kinds that only their checksum confirms.
MONEY_KINDS = ("CARD", "ACCOUNT")
THRESHOLD = 0.5
#: What other personal information next to a number adds to its score.
COMPANY = 0.2
#: Names in a lexicon that goes to every task; a larger one is refused.
MOST_NAMES = 1_000_000


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


# ---- the view


class _View(dict):
    """One plain character for each character of the text."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        if 0xFF01 <= code <= 0xFF5E:
            value = code - 0xFEE0
        elif unicodedata.category(c) == "Zs":
            value = 32
        elif c in "‐‑‒﹣":
            value = 45
        elif c == "﹫":
            value = 64
        else:
            value = code
        self[code] = value
        return value


_VIEW = _View()


def view(text: str) -> str:
    return text if text.isascii() else text.translate(_VIEW)


# ---- validators


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97_key(digits: str) -> bool:
    """The last two of fifteen digits are 97 minus the rest modulo 97."""
    return len(digits) == 15 and int(digits[13:]) == 97 - int(digits[:13]) % 97


def mod23_letter(digits: str, letter: str) -> bool:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == letter.upper()


def mod97_account(text: str) -> bool:
    """Whether an account number's check digits are right: its first four signs moved to the end, letters as 10 to 35, it is 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


# ---- context

_WINDOW = 32
_PHONE_WORDS = re.compile(r"(?i)\b(?:tel|phone|fax|mobil\w*|cell|call|ring|dial\w*|text|whatsapp|sms|caller|llám\w*|anruf\w*|appel\w*|reach|number)\b")
_ID_WORDS = re.compile(r"(?i)\b(?:ssn|social|security|insurance|passport|identity|identidad|id|tax|ausweis\w*|national|nir|dni|nino|applicant|person_id|versicherung\w*|steuer\w*)\b")
_NUMBER_WORDS = re.compile(r"(?i)(?:\b(?:order|invoice|inv|ticket|case|ref|reference|re|version|build|hash|tracking|parcel|batch|sku|serial|matter|commit|row|page|section|item|account no|bestell\w*|rechnung\w*|pedido|facture|commande)\b[\s:#]*(?:(?:no|nr|n)\b[.°º]*)?\s*|#\s*)$")


def _near(v: str, start: int) -> str:
    """The text before a span, look-alikes and invisible signs put right."""
    before = v[max(0, start - _WINDOW) : start]
    return before if before.isascii() else unicodedata.normalize("NFC", skeleton(before))


def _after(v: str, end: int) -> str:
    """The text after a span up to the end of its sentence."""
    after = re.split(r"[.!?\n]", v[end : end + _WINDOW], maxsplit=1)[0]
    return after if after.isascii() else unicodedata.normalize("NFC", skeleton(after))


# ---- e-mail

_AT = r"(?: ?\(at\) ?| ?\[at\] ?| ?\{at\} ?|@| at )"
_DOT = r"(?: ?\(dot\) ?| ?\[dot\] ?| ?\{dot\} ?|\.| dot )"
_MAIL = re.compile(
    rf"(?<![\w.+\-])(?P<local>[\w+\-]++(?:(?:\.| dot )[\w+\-]++)*)(?P<at>{_AT})(?P<host>[\w\-]+(?:{_DOT}[\w\-]++)+)(?! at |@|\w)",
    re.IGNORECASE,
)


def _mails(v: str) -> Iterable[Span]:
    for m in _MAIL.finditer(v):
        host, end = m["host"], m.end()
        last = re.split(_DOT, host, flags=re.IGNORECASE)[-1]
        if not (last.isalpha() and 2 <= len(last) <= 24):
            continue
        spoken = m["at"].lower() == " at "
        if spoken and not re.search(r"\bdot\b", host, re.IGNORECASE):
            continue
        yield Span(m.start(), end, "EMAIL", 0.9)


# ---- numbers

_PHONE_SHAPES = [
    (re.compile(r"\+\d{1,3}(?:[ .\-]?\(0?\d{1,4}\))?(?:[ .\-/]?\d{1,6}){2,7}"), 0.8),
    (re.compile(r"00[1-9]\d{0,2}(?:[ .\-/]?\d{1,5}){3,7}"), 0.75),
    (re.compile(r"\(\d{3}\) ?\d{3}[ .\-]\d{4}"), 0.8),
    (re.compile(r"0\d{2,5}[ /\-]\d{3,8}(?:[ \-]\d{2,6}){0,2}"), 0.7),
    (re.compile(r"0\d(?:[ .\-]\d\d){4}"), 0.7),
    (re.compile(r"[2-9]\d\d([ .\-])[2-9]\d\d\1\d{4}"), 0.7),
    (re.compile(r"[2-9]\d\d[2-9]\d{6}"), 0.5),
    (re.compile(r"[6-9]\d{2}[ .]\d{3}[ .]\d{3}"), 0.45),
]
_PHONE_START = re.compile(r"(?<![\w.@/+\-])(?:\+\d|\(\d{3}\)|\d)")
_ID_SHAPES = re.compile(
    r"(?<![\w.@/+\-])(?:"
    r"(?P<ssn>\d{3}([- ])\d{2}\2\d{4})"
    r"|(?P<nir>[12][ .]?\d{2}[ .]?\d{2}[ .]?(?:\d{2}|2[AB])[ .]?\d{3}[ .]?\d{3}[ .]?\d{2})"
    r"|(?P<dni>\d{8}[- ]?[A-Za-z])"
    r"|(?P<nie>[XYZ][- ]?\d{7}[- ]?[A-Za-z])"
    r"|(?P<nino>[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d])"
    r"|(?P<pass>[A-Z]{1,2}\d{7})"
    r"|(?P<nine>\d{9})"
    r")(?![\w@]|[-/.]\w)"
)


def _phones(v: str) -> Iterable[Span]:
    at = 0
    while m := _PHONE_START.search(v, at):
        start = m.start()
        best = None
        for shape, score in _PHONE_SHAPES:
            p = shape.match(v, start)
            if not p:
                continue
            end = p.end()
            # a whole number only: no digit, letter or further group may follow
            if re.match(r"[\w@]|[-/.]\d", v[end : end + 2]):
                continue
            digits = sum(c.isdigit() for c in p.group())
            if not 9 <= digits <= 15:
                continue
            if best is None or (score, end) > (best[1], best[0]):
                best = (end, score)
        if best is None:
            at = start + 1
            while at < len(v) and v[at].isdigit():
                at += 1
            continue
        end, score = best
        before = _near(v, start)
        if _PHONE_WORDS.search(before):
            score += 0.2
        if _NUMBER_WORDS.search(before):
            score -= 0.2 if v[start] in "+(" else 0.4  # a country code outweighs the word
        if _ID_WORDS.search(before) and not _PHONE_WORDS.search(before):
            score -= 0.1
        yield Span(start, end, "PHONE", score)
        at = end


def _ids(v: str) -> Iterable[Span]:
    for m in _ID_SHAPES.finditer(v):
        kind, text = m.lastgroup, m.group()
        for name in ("ssn", "nir", "dni", "nie", "nino", "pass", "nine"):
            if m[name]:
                kind = name
                break
        plain = re.sub(r"[ .\-]", "", text)
        if kind == "ssn":
            score = 0.7 if plain[:3] not in ("000", "666") else 0.3
        elif kind == "nir":
            score = 0.9 if plain.isdigit() and mod97_key(plain) else 0.35
        elif kind == "dni":
            score = 0.8 if mod23_letter(plain[:8], plain[8]) else 0.35
        elif kind == "nie":
            score = 0.8 if mod23_letter(str("XYZ".index(plain[0])) + plain[1:8], plain[8]) else 0.3
        elif kind == "nino":
            score = 0.7
        elif kind == "pass":
            score = 0.6
        else:
            score = 0.5 if plain[:3] not in ("000", "666") else 0.3
        before = _near(v, m.start())
        if _ID_WORDS.search(before) or score < THRESHOLD and _ID_WORDS.search(_after(v, m.end())):
            score += 0.25
        if _NUMBER_WORDS.search(before) and not _ID_WORDS.search(before):
            score -= 0.4 if kind in ("nine", "pass") else 0.2
        yield Span(m.start(), m.end(), "ID_NUMBER", score)


_ACCOUNT = re.compile(r"(?<![\w@/+\-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w@])")
_CARD = re.compile(r"(?<![\w.@/+\-])(?:[3-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{2}([ -]?)\d{6}\2\d{5})(?![\w@]|[-/.]\d)")


def _money(v: str) -> Iterable[Span]:
    """Bank accounts and payment cards: only those whose checksum is right."""
    for m in _ACCOUNT.finditer(v):
        text, end = m.group(), m.end()
        while len(text) >= 12:
            if mod97_account(text.replace(" ", "")):
                yield Span(m.start(), end, "ACCOUNT", 0.95)
                break
            # the last group may be a word of the text
            text = text[: max(text.rfind(" "), 0)]
            end = m.start() + len(text)
    for m in _CARD.finditer(v):
        if luhn(re.sub(r"\D", "", m.group())):
            yield Span(m.start(), m.end(), "CARD", 0.95)


# ---- street addresses

# Words that end an English street's name, and those usually written short with a stop.
_STREET = "street|road|lane|close|court|drive|way|crescent|terrace|avenue|boulevard|place|square|hill|row|gardens|grove|mews|walk|parade|highway|parkway|rise|view|green|park|circus|quay|wharf|alley|circle|trail|loop|st|rd|ln|dr|ct|cres|ter|pl|sq|hwy|ave|blvd"
_STOPPED = "ave|blvd|st|rd|ln|dr|ct|cres|ter|pl|sq|hwy"
_UNIT = r"(?:flat|unit|apt\.?|apartment|suite|floor|door|room|apartamento|piso)"
_NO_NAME = r"(?!(?:and|or|of|the|to|in|on|at|by|for|from|with|are|is|was|were|more|than|rows?|entries|percent|pages?|calls|days?|times|per)\b)"
_ANGLO = re.compile(
    rf"(?<![\w.@/\-])(?:{_UNIT} \d+[a-z]?, )?\d{{1,5}}[a-z]?(?:-\d{{1,5}}[a-z]?)? (?:(?:[NSEW]\.|(?:north|south|east|west)\b) )?"
    rf"(?P<name>(?:{_NO_NAME}[^\W\d_][^\W\d_'’\-]* ){{1,4}}?)(?P<kind>{_STREET})\b(?:(?<=ave)\.|(?<=blvd)\.)?"
    rf"(?P<more> (?:{_STREET})\b(?:(?<=ave)\.|(?<=blvd)\.)?)?(?:, {_UNIT} \d+[a-z]?\b)?",
    re.IGNORECASE,
)
_FRENCH = re.compile(
    r"(?<![\w.@/\-])\d{1,4}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|boulevard|chemin|impasse|place|allée|quai|route|cours|passage|square)"
    r"(?: (?:de la|de l['’]|du|des|de|d['’]))? ?[^\W\d_][\w'’\-]*(?: (?-i:[A-ZÀ-Þ])[\w'’\-]*){0,3}",
    re.IGNORECASE,
)
_SPANISH = re.compile(
    r"(?<!\w)(?:calle|avenida|avda\.|plaza|paseo|camino|ronda|travesía|carretera)(?: (?:de las|de los|de la|del|de))?(?: [^\W\d_][\w'’\-]*){1,4},? (?:n\.?º ?)?\d{1,4}[a-z]?"
    r"(?:, (?:\d{1,2}\.?[ºª°] ?(?:[A-Z]|izq\.?|dcha\.?)?|piso \d+|bajo(?: [A-Z])?)(?!\w))?",
    re.IGNORECASE,
)
_GERMAN = re.compile(
    r"(?<!\w)(?:(?:Alte[rs]?|Neue[rs]?|Große[rs]?|Kleine[rs]?|Lange|Kurze|Obere|Untere|Hohe|Am|An der|Auf der|Im|Zum|Zur|Hinter der) )?[^\W\d_][\w\-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring) \d{1,4}(?: ?[a-z])?(?!\w)",
    re.IGNORECASE,
)
_ANGLO_WORDS = frozenset(_STREET.split("|"))
_FRENCH_WORDS = frozenset("rue avenue boulevard chemin impasse place allée quai route cours passage square".split())
_SPANISH_WORDS = frozenset("calle avenida avda plaza paseo camino ronda travesía carretera".split())
_GERMAN_HINT = re.compile(r"(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring) \d").search
_SIGN_WORDS = re.compile(r"(?i)\b(?:section|chapter|page|row|rows|version|percent|between|more than|question|line|step)\s*$")


def _addresses(v: str, low: str, words: set[str]) -> Iterable[Span]:
    if not words.isdisjoint(_ANGLO_WORDS):
        for m in _ANGLO.finditer(v):
            name = m["name"].split()
            cased = sum(w[0].isupper() for w in name)
            score = 0.75 if cased == len(name) else 0.6 if not cased and len(name) <= 2 and m["kind"][0].islower() else 0.2
            if _SIGN_WORDS.search(_near(v, m.start())):
                score -= 0.4
            yield Span(m.start(), m.end(), "STREET_ADDRESS", score)
    for seen, shape in ((not words.isdisjoint(_FRENCH_WORDS), _FRENCH), (not words.isdisjoint(_SPANISH_WORDS), _SPANISH), (_GERMAN_HINT(low), _GERMAN)):
        if seen:
            for m in shape.finditer(v):
                yield Span(m.start(), m.end(), "STREET_ADDRESS", 0.8)


# ---- persons

_NAME_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
# Particles of family names, and words before a name that are no given name.
_PARTICLE = r"(?:van der|van den|von der|van|von|de la|de los|de|del|della|di|da|dos|du|le|la|ter|ten|zu|bin|ben|el|af|av)"
_NO_GIVEN = frozenset(
    w.casefold()
    for w in "project the and or herr frau mr mrs ms miss dr prof sir madam monsieur madame señor señora ask both by with is whether row to an from for in on of at as patient author regards cordialement name sent signature contact witness case reference re typed handled heiße my our i we you he she it that this spoke according deliver ship north south east west flat unit apt street road lane company firm team contract partners sons messrs then also just kindly very cc bitte der die das de von van le la les el und et y".split()
)
_FIRM_AFTER = re.compile(r"(?:\s*&|\s+(?:and|und|et|y)\s+(?:sons|co|söhne|fils|hijos)\b|\s+(?:Ltd|GmbH|Inc|LLC|AG|SA|Partners|Holdings|Group|Rail|Foods|Paper|Labs|Media|Energy|Systems|Textiles|Optics|Shipping|Logistics|Aviation|Clinics|Robotics|Company|Bank|Hotel|Airport|Station)\b)", re.IGNORECASE)


def _fold(word: str) -> str:
    return word.casefold()


class Names:
    """Known given and family names, and the families that their parts make up.

    Family names are often a stem and an ending; stems that the lexicon has with several endings, and
    endings that it has with several stems, also make names that it does not hold.  Stems and endings are
    kept apart and tried on the words of a text, so what is held is no larger than the lexicon.
    """

    def __init__(self, given: Iterable[str], family: Iterable[str]):
        self.given = frozenset(_fold(g) for g in given if g)
        known = {_fold(f) for f in family if f}
        by_end: dict[str, set[str]] = defaultdict(set)
        for f in known:
            for i in range(3, len(f) - 1):
                by_end[f[i:]].add(f[:i])
        ends = sorted((e for e, stems in by_end.items() if len(stems) >= 6), key=len, reverse=True)
        stems: dict[str, int] = defaultdict(int)
        for f in known:
            for e in ends:
                if f.endswith(e) and len(f) - len(e) >= 3:
                    stems[f[: -len(e)]] += 1
                    break
        self.known = frozenset(known)
        self.stems = frozenset(s for s, n in stems.items() if n >= 4)
        self.ends = frozenset(e for e in ends if sum(s in self.stems for s in by_end[e]) >= 4)
        self.sizes = tuple(sorted({len(e) for e in self.ends}))
        self.met: dict[str, bool] = {}

    def is_family(self, word: str) -> bool:
        """Whether a folded word is a family name."""
        found = self.met.get(word)
        if found is None:
            if len(self.met) > 200_000:
                self.met.clear()
            found = self.met[word] = word in self.known or any(word[-n:] in self.ends and word[:-n] in self.stems for n in self.sizes if n < len(word))
        return found


def _style(word: str) -> str:
    if word.islower():
        return "lower"
    if word.isupper() and len(word) > 1:
        return "upper"
    return "title" if word[:1].isupper() else "other"


_BEFORE = re.compile(
    rf"(?:(?P<first>(?<![\w.@+\-])(?:[^\W\d_]\.|[^\W\d_]+(?:-[^\W\d_]+)?)) )?(?P<mid>(?:(?<!\w)[^\W\d_]\. ){{0,3}})(?P<part>(?:{_PARTICLE} |al-)?)$",
    re.IGNORECASE,
)
_AFTER_COMMA = re.compile(r", (?P<given>[^\W\d_]+(?:-[^\W\d_]+)?)(?: [^\W\d_]\.)?(?![\w@])")


def _persons(v: str, names: Names) -> Iterable[Span]:
    words = list(_NAME_WORD.finditer(v))
    i, taken = 0, 0
    while i < len(words):
        w = words[i]
        low = _fold(w.group())
        i += 1
        if not names.is_family(low):
            continue
        start, end = w.start(), w.end()
        # double names: Family-Family
        while i < len(words) and words[i].start() == end + 1 and v[end] == "-" and names.is_family(_fold(words[i].group())):
            end = words[i].end()
            i += 1
        if start > 0 and v[start - 1] in "@._+/\\" or v[end : end + 1] in ("@", "_", "+", "\\"):
            continue
        if v[end : end + 1] in (".", "-") and v[end + 1 : end + 2].isalnum():
            continue
        if start > 0 and v[start - 1] == "-" and not v[max(0, start - 3) : start].lower().endswith("al-"):
            continue
        style = _style(w.group())
        m = _BEFORE.search(v[max(taken, start - 60) : start])
        shift = max(taken, start - 60)
        part = m["part"] if m else ""
        own = start - len(part)
        first = m["first"] if m else None
        mid = m["mid"] if m else ""
        if first and first.endswith(".") and len(first) == 2:
            yield Span(shift + m.start("first"), end, "PERSON", 0.8)
            taken = end
            continue
        if first is None and mid:
            yield Span(shift + m.start("mid"), end, "PERSON", 0.8)
            taken = end
            continue
        firm = bool(_FIRM_AFTER.match(v, end))
        if first:
            known = _fold(first) in names.given
            fits = _style(first) == style or mid or part
            if known or (fits and _fold(first) not in _NO_GIVEN and len(first) > 2 and not firm and _style(first) != "other"):
                at = shift + m.start("first")
                # a second given name before a known or unknown one
                yield Span(at, end, "PERSON", 0.9 if known else 0.6)
                taken = end
                continue
            if mid:
                yield Span(shift + m.start("mid"), end, "PERSON", 0.8)
                taken = end
                continue
        a = _AFTER_COMMA.match(v, end)
        if a and not firm:
            g = a["given"]
            known = _fold(g) in names.given
            if known or (_style(g) == "title" and style == "upper" and _fold(g) not in _NO_GIVEN):
                yield Span(own, a.end("given") if not a.group().endswith(".") else a.end(), "PERSON", 0.85)
                taken = a.end()


# ---- all kinds

_LETTERS = re.compile(r"[^\W\d_]+").findall
_DIGIT = re.compile(r"\d").search
#: Enough digits for a number of a person: six with at most three other signs between two of them.
_LONG_NUMBER = re.compile(r"(?<!\d)\d(?:[ .\-()/]{0,3}\d){5}").search

_RANK = {"EMAIL": 4, "STREET_ADDRESS": 3, "CARD": 2, "ACCOUNT": 2, "ID_NUMBER": 1.5, "PHONE": 1.5, "PERSON": 0}
_ONLY_SEPARATORS = re.compile(r"[\s,;|/*\-–—·]{1,6}").fullmatch


def _lifted(v: str, found: list[Span]) -> list[Span]:
    """Numbers just below the threshold gain by an accepted span of another kind that only separators part from them."""
    if all(s.score >= THRESHOLD for s in found):
        return found
    begins = {s.start: s.kind for s in found if s.score >= THRESHOLD}
    ends = {s.end: s.kind for s in found if s.score >= THRESHOLD}
    out = []
    for s in found:
        if s.kind == "ID_NUMBER" and THRESHOLD - COMPANY <= s.score < THRESHOLD:
            near = [begins[s.end + n] for n in range(1, 7) if s.end + n in begins and _ONLY_SEPARATORS(v[s.end : s.end + n])]
            near += [ends[s.start - n] for n in range(1, 7) if s.start - n in ends and _ONLY_SEPARATORS(v[s.start - n : s.start])]
            if any(kind != "ID_NUMBER" for kind in near):
                s = s._replace(score=s.score + COMPANY)
        out.append(s)
    return out


def find_spans(text: str | None, names: Names) -> list[Span]:
    """Accepted spans of a text in order, none overlapping.  Null, empty and blank texts have none."""
    if not text:
        return []
    v = view(text)
    low = v.lower()
    words = set(_LETTERS(low))
    found: list[Span] = []
    if "@" in v or "at)" in low or "at]" in low or "at}" in low or ("dot" in words and "at" in words):
        found += _mails(v)
    if _LONG_NUMBER(v):
        found += _phones(v)
        found += _ids(v)
        found += _money(v)
    if _DIGIT(v):
        found += _addresses(v, low, words)
    if any(names.is_family(_fold(w)) for w in _NAME_WORD.findall(v)):
        found += _persons(v, names)
    found = [s for s in _lifted(v, found) if s.score >= THRESHOLD]
    if len(found) > 1:
        found.sort(key=lambda s: (-_RANK[s.kind], -s.score, s.start - s.end, s.start))
        kept: list[Span] = []
        ends: dict[int, int] = {}
        for s in found:
            # spans are few per text; long texts are cut into cells so that the test stays local
            cells = range(s.start >> 8, (s.end >> 8) + 1)
            if any(s.start < kept[k].end and kept[k].start < s.end for c in cells for k in ends.get(c, ())):
                continue
            for c in cells:
                ends.setdefault(c, []).append(len(kept))
            kept.append(s)
        found = sorted(kept)
    return found


def placeholder_text(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by ``[KIND_n]``."""
    numbers: dict[tuple[str, str], int] = {}
    counts: dict[str, int] = defaultdict(int)
    parts, at = [], 0
    for s in spans:
        key = (s.kind, text[s.start : s.end])
        if key not in numbers:
            counts[s.kind] += 1
            numbers[key] = counts[s.kind]
        parts += [text[at : s.start], f"[{s.kind}_{numbers[key]}]"]
        at = s.end
    return "".join([*parts, text[at:]])


# ---- Spark


def names_of(spark: SparkSession, lexicon: DataFrame) -> Names:
    """The name model of a lexicon (entry, entry_kind) of at most :data:`MOST_NAMES` entries."""
    rows = lexicon.select("entry", "entry_kind").distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"the name lexicon has more than {MOST_NAMES} entries")
    return Names((r.entry for r in rows if r.entry_kind == "given"), (r.entry for r in rows if r.entry_kind == "family"))


def find_pii(df: DataFrame, column: str, names: Names) -> DataFrame:
    """``df`` with ``pii``: array of (pii_kind, pii_text, start, stop, score), offsets in characters."""
    kind = "array<struct<pii_kind:string,pii_text:string,start:int,stop:int,score:double>>"
    shared = df.sparkSession.sparkContext.broadcast(names)

    @F.pandas_udf(kind)
    def run(texts):
        own = shared.value
        return texts.map(lambda t: [(s.kind, t[s.start : s.end], s.start, s.end, s.score) for s in find_spans(t, own)])

    return df.withColumn("pii", run(F.col(column)))


def redact_pii(df: DataFrame, column: str, names: Names, out: str = "redacted") -> DataFrame:
    """``df`` with the text in which typed placeholders stand for what was found; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(names)

    @F.pandas_udf("string")
    def run(texts):
        own = shared.value
        return texts.map(lambda t: None if t is None else placeholder_text(t, find_spans(t, own)))

    return df.withColumn(out, run(F.col(column)))
