"""Queries of the content detectors and rewriting operators over documents and prompts, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions import arrow, crypto
from wardloom.functions import text as T
from wardloom.operators import detectors as D
from wardloom.operators import rewrite as R
from wardloom.sources.tables import audit_events, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Prompts with one row per event, in SQL.
PROMPTS = "(select event_id, any_value(user_id) as user_id, any_value(session_id) as session_id, any_value(logged_at) as logged_at, any_value(input_prompt) as text from audit_events group by event_id)"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    return audit_events(spark, folder, ["user_id", "session_id", "logged_at", "input_prompt"]).withColumnRenamed("input_prompt", "text")


def over(source: Callable[[SparkSession, str], DataFrame], key: str, columns: Callable[[Column], dict[str, Column]]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that computes columns of ``text`` for every row of a source."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return source(spark, folder).select(key, *[c.alias(n) for n, c in columns(F.col("text")).items()])

    return query


def add(name: str, columns: Callable[[Column], dict[str, Column]], sql: str | None = None, on: str = "documents") -> None:
    """Registers a query over documents or prompts; ``sql`` is its select list over ``text``."""
    source, key = (documents, "doc_id") if on == "documents" else (prompts, "event_id")
    QUERIES[name] = over(source, key, columns)
    if sql:
        SQL[name] = f"select {key}, {sql} from {'documents' if on == 'documents' else PROMPTS + ' p'}"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(value: str, needles: list[str]) -> str:
    return "(" + " or ".join(f"contains({value}, {lit(n)})" for n in needles) + ")"


def first_of(value: str, needles: dict[str, str]) -> str:
    return "case " + " ".join(f"when contains({value}, {lit(n)}) then {lit(label)}" for n, label in needles.items()) + " end"


def patterns(value: str, items: list[str]) -> str:
    return "case " + " ".join(f"when regexp_matches({value}, {lit(p)}) then {i}" for i, p in enumerate(items)) + " end"


def flag(test: str) -> str:
    return f"coalesce({test}, false) as tripped"


def tripped(c: Column) -> dict[str, Column]:
    return {"tripped": c["tripped"]}


def with_detail(c: Column) -> dict[str, Column]:
    return {"tripped": c["tripped"], "detail": c["detail"]}


def with_code(c: Column) -> dict[str, Column]:
    return {"tripped": c["tripped"], "code": c["code"]}


TOKENS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
COUNT = lambda p: f"len(regexp_extract_all(text, {lit(p)}))"

# ---- detectors

add("detect_length", lambda t: with_detail(D.too_long(t)), f"{flag('strlen(text) > 10000')}, cast(strlen(text) as varchar) as detail")
_SIGNED = ", ".join(f"{{'e': instr(lower(text), {lit(p)}) + {len(p)}, 's': instr(lower(text), {lit(p)}), 'p': {lit(p)}}}" for p in D.SIGNATURES)
for _on in ("documents", "prompts"):
    add(
        f"detect_signature_{_on}",
        lambda t: with_detail(D.signature(t)),
        f"{flag(any_of('lower(text)', D.SIGNATURES))}, case when {any_of('lower(text)', D.SIGNATURES)} then list_sort(list_filter([{_SIGNED}], lambda x: x.s > 0))[1].p end as detail",
        _on,
    )
    add(f"detect_pattern_{_on}", lambda t: with_detail(D.injection_pattern(t)), f"{flag(patterns('text', D.INJECTION_PATTERNS) + ' is not null')}, cast({patterns('text', D.INJECTION_PATTERNS)} as varchar) as detail", _on)
_LONG = rf"len(list_filter({TOKENS}, lambda w: strlen(w) > 30 and regexp_matches(w, '^[\p{{L}}\p{{N}}]+$'))) > 0"
_ENCODED = f"case when (contains(text, 'base64') or contains(text, 'b64')) and {_LONG} then 'Base64' when regexp_matches(text, '0x[0-9a-fA-F]{{10,}}') then 'Hexadecimal' when {COUNT('%')} > 5 then 'URL encoding' end"
add("detect_encoding", lambda t: with_detail(D.encoding_attack(t)), f"{flag(_ENCODED + ' is not null')}, {_ENCODED} as detail")
_SIGNS = r"list_filter(range(1, length(text) + 1), lambda i: regexp_matches(string_split(text, '')[i], '[^\p{L}\p{N}\s\p{Z}\x0b\x1c-\x1f\x{85}]'))"
add(
    "detect_sign_density",
    lambda t: tripped(D.sign_density(t)),
    f"""coalesce(case when length(text) >= 50 then len(list_filter(range(1, len(s) - 14), lambda i: s[i + 15] - s[i] < 50)) > 0
    when length(text) < strlen(text) or text = '' then false else len(s) / length(text) > 0.3 end, false) as tripped from (select *, case when text <> '' then {_SIGNS} end as s from documents) d --""",
)
add("detect_delimiter", lambda t: with_detail(D.delimiter(t)), f"{flag(first_of('text', D.DELIMITERS) + ' is not null')}, {first_of('text', D.DELIMITERS)} as detail")
_IND = first_of("upper(text)", {i: i for i in D.INDICATORS})
add("detect_indicator", lambda t: with_detail(D.jailbreak_indicator(t)), f"{flag(_IND + ' is not null')}, {_IND} as detail", "prompts")
add("detect_quick", lambda t: with_code(D.quick_check(t)), f"{flag('strlen(text) > 10000 or ' + any_of('lower(text)', D.SIGNATURES))}, case when strlen(text) > 10000 then 'TOO_LONG' when {any_of('lower(text)', D.SIGNATURES)} then 'SIGNATURE' end as code")
add("detect_system_leak", lambda t: tripped(D.system_leak(t)), flag(any_of("lower(text)", ["system_role", "ignore previous instructions"])), "prompts")
_ENTROPY = "list_sum([-(p) * log2(p) for p in [(length(w) - length(replace(w, c, ''))) / strlen(w) for c in list_distinct(string_split(w, ''))]])"
_SECRET = f"case when regexp_matches(text, 'AKIA[0-9A-Z]{{16}}') then 'AWS_ACCESS_KEY' when regexp_matches(text, 'sk-[a-zA-Z0-9]{{20,}}') then 'OPENAI_KEY' when len(list_filter(list_filter({TOKENS}, lambda w: strlen(w) > 20), lambda w: {_ENTROPY} > 3.5)) > 0 then 'HIGH_ENTROPY' end"
add("detect_secret", lambda t: with_code(D.secrets(t, threshold=3.5)), f"{flag(_SECRET + ' is not null')}, {_SECRET} as code")
_TRIM = f"""[regexp_replace(w, '^["'',;()]+|["'',;()]+$', '', 'g') for w in {TOKENS}]"""
_BLOB = f"[case when len(regexp_extract_all(w, '[0-9A-Fa-f]')) / strlen(w) >= 0.95 then 'HEX' when len(regexp_extract_all(w, '[0-9A-Za-z+/=_-]')) / strlen(w) >= 0.97 then 'BASE64' end for w in {_TRIM} if strlen(w) >= 40]"
add("detect_blob", lambda t: with_detail(D.encoded_blob(t, 40)), f"{flag(f'len(list_filter({_BLOB}, lambda k: k is not null)) > 0')}, list_filter({_BLOB}, lambda k: k is not null)[1] as detail")
add("detect_suffix", lambda t: with_code(D.adversarial_suffix(t)))
add("detect_bands", lambda t: {"odd": arrow.rolling_bands(t)["odd"], "longest": arrow.rolling_bands(t)["longest"]})
add("measure_repetition", lambda t: {"score": F.round(arrow.repetition_score(t), 6)})
add("detect_many_shot", lambda t: tripped(D.many_shot(t, 5_000, 6_000)))
_GRAMS = "case when length(text) <= 12 then 0.0 when text is not null then round(1 - len(list_distinct([substr(text, i, 12) for i in range(1, length(text) - 10)])) / (length(text) - 11), 6) end"
add("measure_ngram_repetition", lambda t: {"score": F.round(arrow.window_repetition(12)(t), 6)}, f"{_GRAMS} as score", "prompts")
_RATIO = lambda p: f"case when length(text) = 0 then 0.0 else {COUNT(p)} / length(text) end"
_CTRL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]"
_POISON = (
    f"(case when {COUNT('[' + T.ZERO_WIDTH + ']')} > 0 then 30.0 else 0.0 end + case when {COUNT('[' + T.BIDI + ']')} > 0 then 35.0 else 0.0 end"
    f" + case when {_RATIO(_CTRL)} > 0.001 then 10 * least({_RATIO(_CTRL)} / 0.001, 20.0) else 0.0 end"
    f" + case when {any_of(ASCII_LOWER, D.POISON_PHRASES)} then 25.0 else 0.0 end"
    f" + case when len({TOKENS}) >= 8 and {COUNT('[A-Za-z]')} / greatest(length(text), 1) >= 0.25 and {_RATIO('[^A-Za-z0-9[:space:]]')} > 0.38 then 20.0 else 0.0 end)"
)
for _on in ("documents", "prompts"):
    add(f"score_poison_{_on}", lambda t: {"score": F.round(F.when(t.isNotNull(), D.poison_score(t)), 6)}, f"case when text is not null then round({_POISON}, 6) end as score", _on)
add("detect_poison", lambda t: tripped(D.poisoned(t)), flag(f"{_POISON} >= 50"), "prompts")
_PLAIN = f"lower(try(decode(from_base64(w))))"
_SMUGGLED = f"list_filter([case when length(w) % 4 = 0 then {first_of(_PLAIN, {x: x for x in D.SMUGGLED})} end for w in {TOKENS} if regexp_matches(w, '^[A-Za-z0-9+/]{{8,}}={{0,2}}$')], lambda x: x is not null)"
add("detect_smuggled", lambda t: with_detail(D.smuggled_token(t)), f"{flag(f'len({_SMUGGLED}) > 0')}, {_SMUGGLED}[1] as detail")
add("detect_hidden_payload", lambda t: tripped(D.hidden_payload(t)), None, "prompts")
_BYTES = "case when text = '' then 0.0 else list_aggregate(regexp_extract_all(hex(encode(text)), '..'), 'entropy') end"
add("detect_noisy_bytes", lambda t: tripped(D.noisy_bytes(t, 4.5)), flag(f"{_BYTES} > 4.5"))
add("detect_media_text", lambda t: with_code(D.media_text(t, F.lit("image/png"))), f"{flag(any_of('lower(trim(text))', D.MEDIA_PHRASES))}, case when {any_of('lower(trim(text))', D.MEDIA_PHRASES)} then 'INJECTION' end as code")
add("detect_backdoor", lambda t: with_detail(D.code_backdoor(t)), f"{flag(any_of('text', D.BACKDOORS))}, {first_of('text', {b: b for b in D.BACKDOORS})} as detail")
add("detect_script_operation", lambda t: with_detail(D.script_operation(t)), f"{flag(any_of('text', D.SCRIPT_OPERATIONS))}, {first_of('text', {b: b for b in D.SCRIPT_OPERATIONS})} as detail")
_EXT = "case " + " ".join(f"when {' or '.join(f'regexp_matches(text, {lit(p)})' for p in ps)} then {lit(k)}" for k, ps in D.EXTRACTION_PATTERNS.items()) + " end"
add("detect_extraction", lambda t: with_detail(D.extraction(t)), f"{flag(_EXT + ' is not null')}, {_EXT} as detail", "prompts")
add("detect_extraction_short", lambda t: tripped(D.extraction_short(t)), flag(patterns("text", D.EXTRACTION_SHORT) + " is not null"), "prompts")
add("detect_output_payload", lambda t: with_detail(D.output_payload(t)), f"{flag(any_of(ASCII_LOWER, list(D.PAYLOADS)))}, {first_of(ASCII_LOWER, D.PAYLOADS)} as detail")
_INTENT = f"case when {any_of(ASCII_LOWER, D.INTENT_PHRASES)} then 'JAILBREAK' when strlen(text) > 4096 then 'RESOURCE_EXHAUSTION' end"
add("assess_intent", lambda t: {"intent": D.quick_intent(t, 4096)["intent"], "score": D.quick_intent(t, 4096)["score"]}, f"{_INTENT} as intent, cast(case {_INTENT} when 'JAILBREAK' then 0.95 when 'RESOURCE_EXHAUSTION' then 0.8 end as double) as score")
_STAGE = f"case when {any_of('text', D.CANARIES)} then 'CANARY' when regexp_matches(text, '(?i)base64') or regexp_matches(text, '(?i)eval\\(') then 'EXPLOIT' end"
add("detect_stage_one", lambda t: with_code(D.stage_one(t)), f"{flag(_STAGE + ' is not null')}, {_STAGE} as code")
_KIND = {k: any_of(ASCII_LOWER, ws) for k, (_, ws) in D.HEAT_WORDS.items()}
_HEAT = (
    "case when strlen(text) > 8000 then 2 when strlen(text) > 2000 then 1 else 0 end"
    + "".join(f" + case when {_KIND[k]} then {n} else 0 end" for k, (n, _) in D.HEAT_WORDS.items())
    + " + case when "
    + " + ".join(f"cast({_KIND[k]} as int)" for k in D.HEAT_WORDS)
    + " >= 3 then 2 else 0 end"
)
for _on in ("documents", "prompts"):
    add(f"score_heat_{_on}", lambda t: {"heat": F.when(t.isNotNull(), D.heat(t))}, f"case when text is not null then {_HEAT} end as heat", _on)
add(
    "measure_shape",
    lambda t: {k: c.cast("long") for k, c in T.shape(t).items()} | {"language": T.looks_like_language(t)},
    f"length(text) as total, {COUNT('[A-Za-z]')} as alpha, {COUNT('[0-9]')} as digit, {COUNT('[ \\t\\n\\x0b\\f\\r]')} as space, length(text) - {COUNT('[A-Za-z]')} - {COUNT('[0-9]')} - {COUNT('[ \\t\\n\\x0b\\f\\r]')} as symbol, len({TOKENS}) as words, "
    f"len({TOKENS}) >= 4 and {_RATIO('[A-Za-z]')} >= 0.35 and {_RATIO('[ \\t\\n\\x0b\\f\\r]')} >= 0.08 and 1 - {_RATIO('[A-Za-z]')} - {_RATIO('[0-9]')} - {_RATIO('[ \\t\\n\\x0b\\f\\r]')} <= 0.4500000001 as language",
)
add("measure_entropy", lambda t: {"entropy": F.round(arrow.char_entropy(t), 6)}, "round(case when text = '' then 0.0 else list_aggregate(string_split(text, ''), 'entropy') end, 6) as entropy")
add("measure_entropy_bytes", lambda t: {"by_bytes": F.round(arrow.char_entropy_by_bytes(t), 6), "of_bytes": F.round(arrow.byte_entropy(t), 6)}, f"round(case when text = '' then 0.0 else list_sum([-(k / strlen(text)) * log2(k / strlen(text)) for k in map_values(list_histogram(string_split(text, '')))]) end, 6) as by_bytes, round({_BYTES}, 6) as of_bytes")
add("measure_compression", lambda t: {"ratio": F.round(arrow.zlib_ratio(t), 2)})

# ---- rewriting

add("rewrite_tags", lambda t: {"text": R.without_tags(t)}, "regexp_replace(text, '[\U000e0000-\U000e007f​-‍⁠﻿]', '', 'g') as text")
add("rewrite_controls", lambda t: {"text": R.without_controls(t)}, "regexp_replace(nfc_normalize(text), '[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f-\\x{9f}]', '', 'g') as text")
add("rewrite_compatible", lambda t: {"text": R.compatible(t)}, None, "prompts")
add("rewrite_plain", lambda t: {"text": R.plain(t)["text"], "error": R.plain(t)["error"]}, None, "prompts")
add("rewrite_fingerprint", lambda t: {"text": R.fingerprint_form(t)}, f"trim(regexp_replace(translate(regexp_replace(text, '[{T.ZERO_WIDTH}]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) as text")
_FORM = rf"trim(regexp_replace({ASCII_LOWER}, '[ \t\n\x0b\f\r]+', ' ', 'g'))"
add("rewrite_query_form", lambda t: {"text": R.query_form(t), "shape": R.query_shape(t)}, rf"{_FORM} as text, replace(regexp_replace(regexp_replace({_FORM}, '0x[0-9a-fA-F]{{4,}}|[0-9a-fA-F]{{16,}}', chr(1), 'g'), '[0-9]+', '#', 'g'), chr(1), 'h') as shape", "prompts")
add("rewrite_markdown", lambda t: {"text": R.flat_markdown(t)}, r"regexp_replace(regexp_replace(text, '(?m)^#+\s+(.*)$', '\1', 'g'), '\*\*(.*?)\*\*', '\1', 'g') as text")
add("rewrite_salience", lambda t: {"text": R.flat_salience(t)}, "replace(replace(replace(replace(regexp_replace(text, '^#+', ''), '<IMPORTANT>', ''), '</IMPORTANT>', ''), '<SYSTEM>', ''), '</SYSTEM>', '') as text")
add("rewrite_wrapped", lambda t: {"text": R.wrapped(t)}, None, "prompts")
add("rewrite_padded", lambda t: {"text": R.padded(t, 16), "size": F.octet_length(R.padded(t, 16))}, "text || repeat(' ', (16 - strlen(text) % 16) % 16) as text, strlen(text) + (16 - strlen(text) % 16) % 16 as size")
add("rewrite_digits", lambda t: {"text": R.blurred_digits(t)}, "array_to_string([case when regexp_matches(x, '^[0-9]{5}') then left(x, 4) || repeat('#', length(x) - 4) else x end for x in regexp_extract_all(text, '[0-9]+|[^0-9]+')], '') as text", "prompts")
add("rewrite_html", lambda t: {"text": R.escaped_html(t)}, "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') as text")
add("rewrite_rag", lambda t: {"text": R.without_rag_injection(t)}, r"regexp_replace(regexp_replace(regexp_replace(text, '(?i)ignore\s+previous\s+instructions', '[REDACTED_RAG_INJECTION]', 'g'), '(?i)system\s+override', '[REDACTED_RAG_INJECTION]', 'g'), '(?i)important:\s+forget\s+all\s+settings', '[REDACTED_RAG_INJECTION]', 'g') as text")
add("rewrite_leet", lambda t: {"text": R.leet_read(t)}, "translate(text, '4310@$57', 'aeioasst') as text")
add("rewrite_fenced_json", lambda t: {"text": R.fenced_json(t)}, r"trim(regexp_replace(regexp_replace(text, '^\x{FEFF}', ''), '(?s)^\s*```(?:json)?\s*|\s*```\s*$', '', 'g'), ' ') as text")
_SCRUB = "text"
_HASH = "text"
for _k in R.SCRUB:
    _SCRUB = f"regexp_replace({_SCRUB}, {lit(R.SCRUB[_k])}, {lit(f'[REDACTED_{_k}]')}, 'g')"
    # pieces: a match, or one character; a match is always longer
    _HASH = f"(select case when not regexp_matches(t, {lit(R.SCRUB[_k])}) then t else array_to_string([case when length(x) > 1 then '[HASH:' || left(sha256(x), 8) || ']' else x end for x in regexp_extract_all(t, {lit(R.SCRUB[_k] + '|(?s:.)')})], '') end from (select {_HASH} as t))"
for _on in ("documents", "prompts"):
    add(f"scrub_token_{_on}", lambda t: {"text": R.scrubbed(t, "token")}, f"{_SCRUB} as text", _on)
    add(f"scrub_hash_{_on}", lambda t: {"text": R.scrubbed(t, "hash")}, f"{_HASH} as text", _on)
add("scrub_cards", lambda t: {"text": R.scrubbed(t, "remove", ["CreditCard"])}, f"regexp_replace(text, {lit(R.SCRUB['CreditCard'])}, '', 'g') as text")
_LEGAL = "text"
for _n, _k in (("SSN", "Ssn"), ("EMAIL", "Email"), ("PHONE", "Phone")):
    _LEGAL = f"regexp_replace({_LEGAL}, {lit(R.SCRUB[_k])}, {lit(f'<{_n}_REDACTED>')}, 'g')"
add("scrub_legal", lambda t: {"text": R.scrubbed_legal(t)}, f"{_LEGAL} as text")
_EGRESS = f"case when {any_of('text', ['CTX-9982-SECRET', 'ZTX-CANARY-01'])} then 'SYSTEM_PROMPT_LEAK' when {any_of('text', ['sk-prod-12345', 'CONFIDENTIAL_PROJECT_X', 'INTERNAL_ONLY_CODE'])} then 'PROPRIETARY' when {any_of('text', ['Project Chimera', 'The secret ingredient is'])} then 'SEMANTIC' end"
_MASKED = f"regexp_replace(regexp_replace(text, {lit(R.EGRESS_MAIL)}, '[REDACTED_EMAIL]', 'g'), {lit(R.SCRUB['Ssn'])}, '[REDACTED_SSN]', 'g')"
add("scrub_egress", lambda t: {"text": R.masked_egress(t)["text"], "code": R.masked_egress(t)["code"]}, f"case when {_EGRESS} is null then {_MASKED} end as text, {_EGRESS} as code", "prompts")

_KEY = b"test key of the redaction queries"


def redact_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Findings and distinct values per kind."""
    found = prompts(spark, folder).select("event_id", F.explode(R.find_sensitive(F.col("text"))).alias("f"))
    return found.groupBy("f.kind").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("f.value").alias("distinct_values"))


def redact_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that do not come back exactly after redaction and rehydration: none."""
    rows = prompts(spark, folder).select("event_id", "text")
    redacted, store = R.redact(rows, "text", _KEY)
    again, _ = R.redact(redacted.drop("redaction_error"), "text", _KEY)
    back = R.rehydrate(redacted, "event_id", "text", store, {"01": _KEY})
    both = rows.join(back.select("event_id", F.col("text").alias("back")), "event_id").join(again.select("event_id", F.col("text").alias("twice")), "event_id").join(redacted.select("event_id", F.col("text").alias("once")), "event_id")
    wrong = ~F.col("text").eqNullSafe(F.col("back")) | ~F.col("once").eqNullSafe(F.col("twice"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum(wrong.cast("int")).alias("wrong"))


def hash_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Digests and a message authentication code of every document."""
    t = F.col("text")
    return documents(spark, folder).select("doc_id", F.sha2(t, 256).alias("sha256"), F.md5(t).alias("md5"), crypto.hmac_sha256(b"k" * 16, t).alias("hmac"))


QUERIES |= {"redact_counts": redact_counts, "redact_roundtrip": redact_roundtrip, "hash_functions": hash_functions}
SQL["redact_roundtrip"] = f"select count(*) as n, cast(0 as bigint) as wrong from {PROMPTS} p"
_PAD = lambda b: "".join(f"\\x{x:02X}" for x in b)
_IN, _OUT = crypto._pads(b"k" * 16)
SQL["hash_functions"] = f"select doc_id, sha256(text) as sha256, md5(text) as md5, sha256('{_PAD(_OUT)}'::blob || unhex(sha256('{_PAD(_IN)}'::blob || encode(text)))) as hmac from documents"
