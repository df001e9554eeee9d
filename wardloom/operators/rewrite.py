"""Rewriting text: normal forms, irreversible scrubbing, and reversible redaction with a token store."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from wardloom.functions import arrow, crypto
from wardloom.functions import text as T

# ---- normal forms


def without_tags(text: Column) -> Column:
    """Without Unicode tag characters and five zero-width signs."""
    return F.regexp_replace(text, "[\\x{E0000}-\\x{E007F}​-‍⁠﻿]", "")


def without_controls(text: Column) -> Column:
    """NFC without control characters other than ASCII white space."""
    return F.regexp_replace(arrow.nfc(text), r"[\p{Cc}&&[^\t\n\f\r]]", "")


def compatible(text: Column) -> Column:
    """NFKC without invisible signs."""
    return F.regexp_replace(arrow.nfkc(text), f"[{T.ZERO_WIDTH}‎‏⁡-⁤᠎͏]", "")


def plain(text: Column, max_bytes: int = 10_000, max_hidden: int = 5) -> Column:
    """(text, error): NFKC, hidden and format signs dropped, look-alikes mapped, blanks collapsed.

    Null text with an error for more than ``max_hidden`` hidden signs, a direction override, or a result
    of more than ``max_bytes`` bytes.
    """
    hidden = "​-‏⁠-⁤﻿᠎͏"
    out = F.regexp_replace(arrow.nfkc(text), f"[{hidden}‪-‮⁦-⁩­؜ᅟᅠ឴឵᠋-᠍]", "")
    # fixed values: capitals and small letters that look alike
    out = F.translate(out, "АВЕКМНОРСТХаеорсухΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEKMHOPCTXaeopcyxABEZHIKMNOPTYX")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    error = F.when(T.count_of(text, f"[{hidden}]") > max_hidden, "HIDDEN").when(text.rlike("[‭‮]"), "BIDI").when(F.octet_length(out) > max_bytes, "TOO_LONG")
    return F.struct(F.when(error.isNull(), out).alias("text"), error.alias("error"))


def fingerprint_form(text: Column) -> Column:
    """Lower-case ASCII letters and digits, single blanks for all else."""
    shown = F.regexp_replace(text, f"[{T.ZERO_WIDTH}]", "")
    return F.trim(F.regexp_replace(T.ascii_lower(shown), "[^a-z0-9]+", " "))


def query_form(text: Column) -> Column:
    """ASCII lower case, blanks collapsed and trimmed."""
    return F.trim(F.regexp_replace(T.ascii_lower(text), r"\s+", " "))


def query_shape(text: Column) -> Column:
    """The query's template: hexadecimal ids become h, digit runs become #."""
    out = F.regexp_replace(query_form(text), "0x[0-9a-fA-F]{4,}|[0-9a-fA-F]{16,}", "\u0001")
    return F.replace(F.regexp_replace(out, "[0-9]+", "#"), F.lit("\u0001"), F.lit("h"))


def flat_markdown(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^#+\s+(.*)$", "$1"), r"\*\*(.*?)\*\*", "$1")


def flat_salience(text: Column) -> Column:
    out = F.regexp_replace(text, "^#+", "")
    for tag in ("<IMPORTANT>", "</IMPORTANT>", "<SYSTEM>", "</SYSTEM>"):
        out = F.replace(out, F.lit(tag), F.lit(""))
    return out


def wrapped(text: Column, tag: str = "user_data") -> Column:
    return F.concat(F.lit(f"<{tag}>"), F.regexp_replace(arrow.nfkc(text), f"[{T.ZERO_WIDTH}᠎]", ""), F.lit(f"</{tag}>"))


def padded(text: Column, block: int) -> Column:
    """Padded with blanks to a multiple of ``block`` bytes."""
    return F.concat(text, F.repeat(F.lit(" "), F.pmod(-F.octet_length(text), F.lit(block)).cast("int")))


def blurred_digits(text: Column) -> Column:
    """From the fifth digit of a run on, # for each digit."""
    return F.regexp_replace(text, r"(?<=[0-9]{4})[0-9]", "#")


def escaped_html(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def without_rag_injection(text: Column) -> Column:
    for p in (r"(?i)ignore\s+previous\s+instructions", r"(?i)system\s+override", r"(?i)important:\s+forget\s+all\s+settings"):
        text = F.regexp_replace(text, p, "[REDACTED_RAG_INJECTION]")
    return text


def leet_read(text: Column) -> Column:
    return F.translate(text, "4310@$57", "aeioasst")


def blinded(text: Column, most: int = 8_000) -> Column:
    """Model output for show: no control signs, trimmed, at most ``most`` characters."""
    return F.left(F.trim(F.regexp_replace(text, r"[\p{Cc}&&[^\n\t]]", "")), F.lit(most))


def unit_score(value: Column) -> Column:
    """A score brought into 0..1; null and not-a-number become 1."""
    return F.when(value.isNull() | F.isnan(value), 1.0).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def fenced_json(text: Column) -> Column:
    """JSON without byte order mark and code fences."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))


# ---- scrubbing

# Patterns of personal data, in the order in which they are applied.
SCRUB = {
    "Ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "Email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "Phone": r"\b(?:\+?1[\s\-\.]?)?(?:\(?\d{3}\)?)[\s\-\.]?\d{3}[\s\-\.]?\d{4}\b",
    "IpAddress": r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    "CreditCard": r"\b(?:\d[ -]*?){13,16}\b",
    "CryptoWallet": r"\b(0x[a-fA-F0-9]{40}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b",
    "Iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b",
    "NhiToken": r"\bzt_nhi_[a-zA-Z0-9]{32}\b",
    "BarNumber": r"(?i)Bar\s*(?:No|#)?\s*:?\s*(\d{5,7})",
    "DeviceId": r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
    "ApiKey": r"""(?i)\b(api_key|access_token|secret)[\s=:'"]+([a-zA-Z0-9_\-]{20,})\b""",
    "MacAddress": r"(?i)\b([0-9a-f]{2}[:-]){5}[0-9a-f]{2}\b",
    "CaseId": r"(?i)\b(CASE|MATTER)-[0-9]{4}-[0-9]{6}\b",
}


def scrubbed(text: Column, strategy: str = "token", kinds: list[str] | None = None) -> Column:
    """Every kind's matches replaced on the running text.  Strategies: token, remove, synthetic, hash, partial."""
    if strategy in ("hash", "partial"):
        return _hashed(strategy, tuple(kinds or SCRUB))(text)
    for kind in kinds or SCRUB:
        put = {"token": f"[REDACTED_{kind}]", "remove": "", "synthetic": f"[SYNTHETIC_{kind}]"}[strategy]
        text = F.regexp_replace(text, SCRUB[kind], put)
    return text


def _hashed(strategy: str, kinds: tuple[str, ...]):
    """UDF of the two strategies that need the matched value's digest."""

    @F.pandas_udf(Y.StringType())
    def run(texts: pd.Series) -> pd.Series:
        patterns = [re.compile(SCRUB[k], re.ASCII) for k in kinds]

        def put(m: re.Match) -> str:
            digest = hashlib.sha256(m.group().encode()).hexdigest()
            return f"[HASH:{digest[:8]}]" if strategy == "hash" else f"{m.group()[:2]}-{digest[:4]}"

        def one(t: str | None) -> str | None:
            if t is not None:
                for p in patterns:
                    t = p.sub(put, t)
            return t

        return texts.map(one)

    return run


def scrubbed_legal(text: Column) -> Column:
    for name, kind in (("SSN", "Ssn"), ("EMAIL", "Email"), ("PHONE", "Phone")):
        text = F.regexp_replace(text, SCRUB[kind], f"<{name}_REDACTED>")
    return text


EGRESS_MAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,4}"


def masked_egress(text: Column) -> Column:
    """(text, code): output with addresses and numbers masked, or the code of what must not leave."""
    code = (
        F.when(T.contains_any(text, ["CTX-9982-SECRET", "ZTX-CANARY-01"]), "SYSTEM_PROMPT_LEAK")
        .when(T.contains_any(text, ["sk-prod-12345", "CONFIDENTIAL_PROJECT_X", "INTERNAL_ONLY_CODE"]), "PROPRIETARY")
        .when(T.contains_any(text, ["Project Chimera", "The secret ingredient is"]), "SEMANTIC")
    )
    masked = F.regexp_replace(F.regexp_replace(text, EGRESS_MAIL, "[REDACTED_EMAIL]"), SCRUB["Ssn"], "[REDACTED_SSN]")
    return F.struct(F.when(code.isNull(), masked).alias("text"), code.alias("code"))


# ---- reversible redaction

# Kinds of personal data, their patterns, and which wins where they overlap.
KINDS = {
    "SECRET_KEY": (100, r"(?i)\b(?:sk-[a-zA-Z0-9]{20,}|ghp_[a-zA-Z0-9]{20,})\b"),
    "SSN": (90, r"\b\d{3}-\d{2}-\d{4}\b"),
    "EMAIL": (80, r"(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b"),
    "PHONE": (70, r"\b(?:\+?1[\s\-\.]?)?(?:\(?\d{3}\)?)[\s\-\.]?\d{3}[\s\-\.]?\d{4}\b"),
    "IPV4": (60, r"\b\d{1,3}(?:\.\d{1,3}){3}\b"),
    "DATE": (50, r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
}
TOKEN = r"\[PII:v1:([A-Z_0-9]+):KID:([0-9]{2}):UUID:([a-f0-9-]{36}):MAC:([a-f0-9]{24,64})\]"
#: Limits of one text: bytes and findings; beyond them it is refused as a whole.
MAX_BYTES, MAX_FINDINGS = 1_000_000, 10_000

_COMPILED = {kind: (rank, re.compile(pattern, re.ASCII)) for kind, (rank, pattern) in KINDS.items()}
_TOKEN = re.compile(TOKEN)


def spans_of(text: str) -> list[tuple[int, int, str]] | None:
    """Accepted spans in order; of each chain of overlapping ones the best by (rank, length).  None beyond the limits."""
    if len(text.encode()) > MAX_BYTES:
        return None
    held = [m.span() for m in _TOKEN.finditer(text)]
    found = []
    for kind, (rank, pattern) in _COMPILED.items():
        for m in pattern.finditer(text):
            a, b = m.span()
            if any(a < y and x < b for x, y in held):
                continue
            if kind == "IPV4" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            found.append((a, b, rank, kind))
    found.sort(key=lambda s: (s[0], s[1]))
    out: list[tuple[int, int, str]] = []
    best, end = None, -1
    for s in found:
        if best is not None and s[0] < end:
            end = max(end, s[1])
            if (s[2], s[1] - s[0]) > (best[2], best[1] - best[0]):
                best = s
        else:
            if best is not None:
                out.append((best[0], best[1], best[3]))
            best, end = s, s[1]
    if best is not None:
        out.append((best[0], best[1], best[3]))
    return out if len(out) <= MAX_FINDINGS else None


def find_sensitive(text: Column) -> Column:
    """array<struct<start, stop, kind, value>> of a text; null for null text and beyond the limits."""

    @F.pandas_udf("array<struct<start:int,stop:int,kind:string,value:string>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            spans = None if t is None else spans_of(t)
            return None if spans is None else [(a, b, k, t[a:b]) for a, b, k in spans]

        return texts.map(one)

    return run(text)


def token_of(kind: Column, value: Column, key: bytes, key_id: str) -> Column:
    """The token of a value: same kind and value, same token, in every text and run."""
    uuid = crypto.stable_uuid(kind, value, F.lit(key_id))
    head = F.concat(F.lit("PII:v1:"), kind, F.lit(f":KID:{key_id}:UUID:"), uuid)
    return F.concat(F.lit("["), head, F.lit(":MAC:"), crypto.hmac_sha256(key, head, 24), F.lit("]"))


def redact(df: DataFrame, text: str, key: bytes, key_id: str = "01") -> tuple[DataFrame, DataFrame]:
    """(redacted, store).

    ``redacted`` is ``df`` with ``text`` replaced, and ``redaction_error`` set (and the text null) where a
    text is beyond the limits.  ``store`` has token, kind, value, each once.  Tokens already in a text are
    left alone, so redacting twice changes nothing.
    """
    found = df.withColumn("_f", find_sensitive(F.col(text)))
    shift = F.aggregate(
        "_f",
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, f: F.struct(
            F.concat(acc["out"], F.substring(F.col(text), acc["at"], f["start"] + 1 - acc["at"]), token_of(f["kind"], f["value"], key, key_id)).alias("out"),
            (f["stop"] + 1).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"], F.length(F.col(text)))),
    )
    error = F.when(F.col(text).isNotNull() & F.col("_f").isNull(), F.lit("REDACTION_FAILED"))
    redacted = found.withColumn("redaction_error", error).withColumn(text, F.when(F.size("_f") > 0, shift).when(error.isNull(), F.col(text))).drop("_f")
    values = found.select(F.explode("_f").alias("f")).select("f.kind", "f.value").distinct()
    return redacted, values.select(token_of(F.col("kind"), F.col("value"), key, key_id).alias("token"), "kind", "value")


def rehydrate(df: DataFrame, key_column: str, text: str, store: DataFrame, keys: dict[str, bytes]) -> DataFrame:
    """``df`` with known tokens replaced by their values.

    Codes are checked before any look-up: forged tokens, unknown key ids and unknown tokens stay as they
    are.  Only the distinct tokens of each row are joined, and rows without tokens take no part.
    """
    tokens = df.select(key_column, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"({TOKEN})"), F.lit(1)))).alias("token"))
    head = F.regexp_extract("token", r"^\[(PII:v1:.*):MAC:[a-f0-9]+\]$", 1)
    kid, mac = F.regexp_extract("token", TOKEN, 2), F.regexp_extract("token", TOKEN, 4)
    genuine = F.coalesce(*[F.when(kid == k, crypto.hmac_sha256(v, head, 64).startswith(mac)) for k, v in keys.items()], F.lit(False))
    known = tokens.where(genuine).join(store.select("token", "value"), "token").groupBy(key_column).agg(F.collect_list(F.struct("token", "value")).alias("_t"))
    back = F.aggregate("_t", F.col(text), lambda t, x: F.replace(t, x["token"], x["value"]))
    return df.join(known, key_column, "left").withColumn(text, F.coalesce(back, F.col(text))).drop("_t")
