"""Content detectors: each gives a verdict column for a text column.

A verdict is a struct (tripped boolean, code string, detail string); tripped is false for null text.
Lists, patterns and limits are parameters whose defaults are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardloom.functions import arrow, crypto
from wardloom.functions import text as T

# ---- fixed values: phrases and patterns that the detectors look for

SIGNATURES = [
    "ignore all previous", "ignore previous instructions", "disregard all above", "disregard previous instructions",
    "forget all instructions", "forget everything above", "ignore the above", "disregard the above", "nevermind the previous",
    "system prompt:", "system:", "you are now", "you are a", "act as if", "pretend you are", "simulate being", "roleplay as",
    "from now on you are", "developer mode", "admin mode", "god mode", "debug mode", "root access", "enable developer", "sudo mode",
    "ignroe all prevoius", "ignor all previos", "disreguard all abov", "fogret all instructons", "</user_data>", "<system>",
    "</system>", "<!--", "-->", "base64:", "rot13:", "hex:", "decode this:", "eval(", "end of instructions", "new instructions:",
    "updated prompt:", "revised system message:", "override default behavior", "do anything now", "dan mode", "jailbreak mode",
    "uncensored mode", "repeat the above", "what were your instructions", "show me your prompt", "reveal your system message",
    "print your instructions",
]
INJECTION_PATTERNS = [
    r"(?i)(step\s+1|first|then|next|finally).*(ignore|disregard|forget)",
    r"(?i)in\s+this\s+scenario.*(you\s+are|you're|youre)",
    r"(?i)(what\s+if|imagine|suppose|hypothetically).*(you\s+were|you\s+are)",
    r"(?i)(opposite|reverse|contrary|ignore).*(instruction|rule|guideline)",
    r"(?i)(<\|.*?\|>|\[INST\]|\[/INST\])",
    "[​-‍﻿]{3,}",
    r"(?i)(base64|b64|decode)\s*[:\(]\s*[A-Za-z0-9+/=]{20,}",
    r"(<|>|\{|\}|\[|\]){5,}",
    r"(?i)(new\s+task|new\s+objective|new\s+goal|override\s+task)",
]
# the two with small letters never stand in a text in capitals
INDICATORS = ["DAN", "STAN", "DUDE", "AIM", "evil confidant", "SWITCH", "AlphaBreak"]
DELIMITERS = {"</user_data>": "</user_data>", "<system>": "<system>", "</system>": "</system>", "<admin>": "<admin>", "<root>": "<root>", "<!--": "HTML comment", "-->": "HTML comment"}
POISON_PHRASES = ["ignore previous instructions", "system prompt", "developer message", "you are an ai", "tool call", "reveal your rules", "print your instructions"]
INTENT_PHRASES = ["ignore previous instructions", "system prompt", "developer message", "reveal your instructions"]
SMUGGLED = ["ignore previous instructions", "system prompt override", "drop table", "format c:"]
MEDIA_TYPES = ["application/pdf", "image/jpeg", "image/png", "audio/mpeg", "audio/wav"]
MEDIA_PHRASES = ["ignore all previous instructions", "system override", "new directives"]
BACKDOORS = ['if user == "backdoor"', "if date >", "exec(base64_decode", 'system("rm -rf']
SCRIPT_OPERATIONS = ["eval(", "process::exit", "fs::remove_dir_all", "rm -rf", "sudo"]
PAYLOADS = {
    "<script": "script tag", "</script": "script tag", "javascript:": "javascript url", "vbscript:": "vbscript url", "data:text/html": "data url html",
    "onerror=": "event handler", "onload=": "event handler", "onclick=": "event handler", "<iframe": "iframe tag", "<object": "object tag",
    "<embed": "embed tag", "<svg": "svg tag",
}
EXTRACTION_PATTERNS = {
    "distillation": [
        r"(?i)generate\s+(\d+|many|all|thousands?|hundreds?)\s+(examples?|samples?|rows?|records?)",
        r"(?i)(create|produce)\s+(\d+|many)\s+synthetic\s+(examples?|data)",
        r"(?i)(distill|clone|replicate)\s+(your|the)\s+model",
        r"(?i)give\s+me\s+(all|many|\d+)\s+(training|test)\s+(data|examples?)",
    ],
    "prompt-leak": [
        r"(?i)(print|reveal|show|dump)\s+(your|the|all)\s+(system\s+)?(instructions?|prompt|rules?|guidelines?)",
        r"(?i)repeat\s+(the|your)\s+(above|previous|initial)\s+(instructions?|prompt)",
    ],
    "adversarial": [r"(?i)give\s+me\s+adversarial\s+examples?", r"(?i)(inputs?|queries?)\s+that\s+(confuse|trick|fool)\s+you"],
}
EXTRACTION_SHORT = [
    r"(?i)generate\s+(\d+|many|all)\s+(examples|samples|rows|records)",
    r"(?i)(print|reveal|show|dump)\s+(your|system)\s+(instructions|prompt|rules)",
    r"(?i)give\s+me\s+adversarial\s+examples",
]
CANARIES, EXPLOITS = ["CANARY_TOKEN_123", "SECRET_KEY_XYZ"], [r"(?i)base64", r"(?i)eval\("]
HEAT_WORDS = {
    "override": (3, ["ignore", "bypass", "override", "jailbreak", "do anything now"]),
    "system": (3, ["system", "admin", "root", "sudo", "developer message"]),
    "exec": (4, ["shell", "exec", "powershell", "cmd.exe", "bash", "terminal"]),
    "secret": (3, ["credential", "api key", "token", "private key", "vault", "secret"]),
    "exfil": (2, ["exfil", "leak", "pastebin", "upload", "curl ", "wget ", "http://", "https://"]),
    "encoding": (2, ["base64", "rot13", "obfusc", "encode", "decode"]),
}
TOOL_ARGUMENTS = [".ssh/id_rsa", ".ssh/known_hosts", ".aws/credentials", "/etc/shadow", "/etc/passwd", "../", "..\\"]
CRITICAL_TOOLS = ["System_Execute", "Credential_Access", "Admin_DeleteUser"]
HIGH_RISK_TOOLS = ["Email_Send", "File_Export", "SQL_Write", "Calendar_CreateEvent", "Slack_PostMessage", "HTTP_POST"]
HANDOFF_VERBS = ["delete", "grant", "update", "send", "export", "exec"]
DEVIATIONS = ["delete", "transfer", "exfiltrate", "shutdown"]


def verdict(code: Column, detail: Column | None = None) -> Column:
    """A verdict that is tripped where ``code`` is not null."""
    return F.struct(code.isNotNull().alias("tripped"), code.alias("code"), (F.lit(None).cast("string") if detail is None else detail.cast("string")).alias("detail"))


def _code(test: Column, code: str) -> Column:
    return F.when(test, F.lit(code))


def too_long(text: Column, limit: int = 10_000) -> Column:
    """More than ``limit`` bytes."""
    return verdict(_code(F.octet_length(text) > limit, "TOO_LONG"), F.octet_length(text))


def signature(text: Column, phrases: list[str] = SIGNATURES) -> Column:
    """A known phrase in the lower-case text; detail is the one that ends first, then starts first."""

    def look(low: Column) -> Column:
        found = F.filter(
            F.array(*[F.struct((F.instr(low, p) + len(p)).alias("end"), F.instr(low, p).alias("start"), F.lit(p).alias("phrase")) for p in phrases]),
            lambda x: x["start"] > 0,
        )
        return F.when(T.contains_any(low, phrases), F.array_min(found)["phrase"])

    phrase = T.once(F.lower(text), look)
    return verdict(_code(phrase.isNotNull(), "SIGNATURE"), phrase)


def injection_pattern(text: Column, patterns: list[str] = INJECTION_PATTERNS) -> Column:
    """A pattern; detail is the number of the first in list order."""
    first = T.first_match(text, patterns)
    return verdict(_code(first.isNotNull(), "PATTERN"), first)


def encoding_attack(text: Column) -> Column:
    """base64 talk with a long plain token, a long hexadecimal number, or more than five percent signs."""
    long_token = F.exists(T.words(text), lambda w: (F.octet_length(w) > 30) & w.rlike(r"^[\p{L}\p{N}]+$"))
    kind = (
        F.when(T.contains_any(text, ["base64", "b64"]) & long_token, "Base64")
        .when(text.rlike("0x[0-9a-fA-F]{10,}"), "Hexadecimal")
        .when(T.count_of(text, "%") > 5, "URL encoding")
    )
    return verdict(_code(kind.isNotNull(), "ENCODING"), kind)


def sign_density(text: Column) -> Column:
    """Some window of 50 characters has more than 30 % signs."""
    return verdict(_code(arrow.sign_density(text), "SIGN_DENSITY"))


def delimiter(text: Column) -> Column:
    """A tag or comment that closes or opens a frame."""
    found = T.first_of(text, DELIMITERS)
    return verdict(_code(found.isNotNull(), "DELIMITER"), found)


def jailbreak_indicator(text: Column, indicators: list[str] = INDICATORS, whole_words: bool = False) -> Column:
    """An indicator in the upper-case text, as part of a word too unless ``whole_words``."""
    up = F.upper(text)
    if whole_words:
        found = F.coalesce(*[F.when(up.rlike(rf"\b{T.quoted(i)}\b"), F.lit(i)) for i in indicators])
    else:
        found = T.first_of(up, indicators)
    return verdict(_code(found.isNotNull(), "JAILBREAK"), found)


def quick_check(text: Column) -> Column:
    """Length, then signature."""
    a, b = too_long(text), signature(text)
    return F.when(a["tripped"], a).otherwise(b)


def system_leak(text: Column) -> Column:
    return verdict(_code(T.contains_any(F.lower(text), ["system_role", "ignore previous instructions"]), "SYSTEM_LEAK"))


def secrets(text: Column, min_bytes: int = 20, threshold: float = 4.5) -> Column:
    """Known key shapes, or a token of more than ``min_bytes`` bytes with entropy above ``threshold``.

    The entropy takes character counts over the byte length.  Tokens are few, so their character counts
    stay in the JVM.
    """
    tokens = F.array_distinct(F.filter(T.words(text), lambda w: F.octet_length(w) > min_bytes))
    entropies = F.transform(tokens, char_byte_entropy)
    code = F.when(text.rlike("AKIA[0-9A-Z]{16}"), "AWS_ACCESS_KEY").when(text.rlike("sk-[a-zA-Z0-9]{20,}"), "OPENAI_KEY").when(F.exists(entropies, lambda e: e > threshold), "HIGH_ENTROPY")
    return verdict(code)


def char_byte_entropy(token: Column) -> Column:
    """Entropy of a short text in the JVM: character counts over the byte length."""
    size = F.octet_length(token)
    letters = F.array_distinct(F.filter(F.split(token, ""), lambda c: c != ""))
    share = F.transform(letters, lambda c: (F.length(token) - F.length(F.replace(token, c, F.lit("")))) / F.length(c) / size)
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def encoded_blob(text: Column, min_bytes: int = 80) -> Column:
    """The first token of at least ``min_bytes`` bytes that is nearly all hexadecimal or base64 signs."""
    trimmed = F.transform(T.words(text), lambda w: F.regexp_replace(w, r"""^["',;()]+|["',;()]+$""", ""))
    size = lambda w: F.octet_length(w).cast("double")
    kinds = F.transform(
        F.filter(trimmed, lambda w: F.octet_length(w) >= min_bytes),
        lambda w: F.when(T.count_of(w, "[0-9A-Fa-f]") / size(w) >= 0.95, "HEX").when(T.count_of(w, "[0-9A-Za-z+/=_-]") / size(w) >= 0.97, "BASE64"),
    )
    first = F.element_at(F.filter(kinds, lambda k: k.isNotNull()), 1)
    return verdict(_code(F.size(F.filter(kinds, lambda k: k.isNotNull())) > 0, "ENCODED_BLOB"), F.when(F.size(F.filter(kinds, lambda k: k.isNotNull())) > 0, first))


def adversarial_suffix(text: Column, min_chars: int = 64, high: float = 5.05, spike: float = 1.10, repeated: float = 0.82, signs: float = 0.38) -> Column:
    """Signs of a machine-made suffix, in order of precedence; texts under ``min_chars`` without blanks pass."""
    size = F.length(F.regexp_replace(text, r"\s+", ""))
    r, b = arrow.integrity_report(text), arrow.rolling_bands(text)
    hidden = T.count_of(text, f"{T.CONTROL}|[{T.ZERO_WIDTH}{T.BIDI}]") > 0
    delta = F.greatest(r["tail_entropy"] - r["head_entropy"], F.lit(0.0))
    code = (
        F.when(size < min_chars, F.lit(None))
        .when(hidden, "CONTROL")
        .when(encoded_blob(text)["tripped"], "BLOB")
        .when((b["odd"] >= 3) | (b["longest"] >= 2), "MULTIBAND")
        .when((r["tail_entropy"] > high) & (delta >= spike), "SPIKE")
        .when(r["tail_entropy"] > high, "HIGH_ENTROPY")
        .when(r["tail_repetition"] >= repeated, "REPETITION")
        .when(T.looks_like_language(text) & (T.symbol_ratio(text) > signs), "SIGNS")
    )
    return verdict(code)


def many_shot(text: Column, min_bytes: int = 25_000, window_bytes: int = 32_768, min_fill: float = 0.80, squeeze: float = 0.35, repeated: float = 0.30) -> Column:
    """A text that fills most of a context and is padding: it compresses well or repeats its n-grams."""
    size = F.octet_length(text)
    big = (size >= min_bytes) & (size / window_bytes >= min_fill)
    whole = F.when(big, text)  # null, and so not measured, for the others
    return verdict(_code(big & ((arrow.zlib_ratio(whole) <= squeeze) | (arrow.window_repetition(12)(whole) >= repeated)), "MANY_SHOT"))


def poison_score(text: Column, max_control: float = 0.001, max_signs: float = 0.38) -> Column:
    """Score of hidden signs, control density, instructing phrases and sign-heavy prose."""
    size = F.length(text)
    control = T.ratio(T.control_count(text), size)
    signs = T.ratio(T.count_of(text, r"[^A-Za-z0-9\s]"), size)
    prose = (F.size(T.words(text)) >= 8) & (T.ratio(T.count_of(text, "[A-Za-z]"), F.greatest(size, F.lit(1))) >= 0.25)
    part = lambda test, n: F.when(test, F.lit(float(n))).otherwise(F.lit(0.0))
    return (
        part(T.zero_width_count(text) > 0, 30)
        + part(T.bidi_count(text) > 0, 35)
        + F.when(control > max_control, 10 * F.least(control / max_control, F.lit(20.0))).otherwise(F.lit(0.0))
        + part(T.once(T.ascii_lower(text), lambda low: T.contains_any(low, POISON_PHRASES)), 25)
        + part(prose & (signs > max_signs), 20)
    )


def poisoned(text: Column, limit: float = 50.0) -> Column:
    return verdict(_code(poison_score(text) >= limit, "POISON"), poison_score(text))


def smuggled_token(text: Column) -> Column:
    """A base64 token whose text holds a forbidden phrase; detail is the phrase."""
    tokens = F.filter(T.words(text), lambda w: w.rlike(r"^[A-Za-z0-9+/]{8,}={0,2}$"))
    phrases = F.transform(tokens, lambda w: T.first_of(F.lower(crypto.decoded_base64(w)), SMUGGLED))
    found = F.filter(phrases, lambda p: p.isNotNull())
    return verdict(_code(F.size(found) > 0, "SMUGGLED"), F.when(F.size(found) > 0, F.element_at(found, 1)))


def hidden_payload(text: Column) -> Column:
    """Less than half of the bytes are left without the signs that cannot be seen."""
    left = F.octet_length(F.regexp_replace(arrow.nfkc(text), "[​-‍﻿‪-‮]", ""))
    return verdict(_code(left * 2 < F.octet_length(text), "HIDDEN_PAYLOAD"))


def noisy_bytes(data: Column, limit: float = 7.9) -> Column:
    return verdict(_code(arrow.byte_entropy(data) > limit, "BYTE_ENTROPY"))


def media_text(text: Column, mime: Column) -> Column:
    bad = ~F.coalesce(mime.isin(MEDIA_TYPES), F.lit(False))
    return verdict(F.when(bad, "MIME").when(T.contains_any(F.lower(F.trim(text)), MEDIA_PHRASES), "INJECTION"))


def code_backdoor(text: Column) -> Column:
    found = T.first_of(text, BACKDOORS)
    return verdict(_code(found.isNotNull(), "BACKDOOR"), found)


def script_operation(text: Column) -> Column:
    found = T.first_of(text, SCRIPT_OPERATIONS)
    return verdict(_code(found.isNotNull(), "OPERATION"), found)


def extraction(text: Column) -> Column:
    """Asking for data sets, hidden instructions or adversarial inputs; detail is the category."""
    kind = F.coalesce(*[F.when(F.coalesce(*[F.when(text.rlike(p), True) for p in patterns], F.lit(False)), F.lit(name)) for name, patterns in EXTRACTION_PATTERNS.items()])
    return verdict(_code(kind.isNotNull(), "EXTRACTION"), kind)


def extraction_short(text: Column) -> Column:
    return verdict(_code(T.first_match(text, EXTRACTION_SHORT).isNotNull(), "EXTRACTION"))


def output_payload(text: Column) -> Column:
    """Active web content, whatever its case."""
    found = T.once(T.ascii_lower(text), lambda low: T.first_of(low, PAYLOADS))
    return verdict(_code(found.isNotNull(), "PAYLOAD"), found)


def quick_intent(text: Column, max_bytes: int = 16_384) -> Column:
    """(intent, score) by phrases, size and long base64 runs; null intent if nothing shows."""
    low = T.ascii_lower(text)
    intent = (
        F.when(T.contains_any(low, INTENT_PHRASES), "JAILBREAK")
        .when(F.octet_length(text) > max_bytes, "RESOURCE_EXHAUSTION")
        .when(text.rlike("[A-Za-z0-9+/=\\n]{2049,}"), "OBFUSCATION")
    )
    score = F.when(intent == "JAILBREAK", 0.95).when(intent == "RESOURCE_EXHAUSTION", 0.80).when(intent == "OBFUSCATION", 0.85)
    return F.struct(intent.alias("intent"), score.alias("score"))


def stage_one(text: Column) -> Column:
    """Canary leak, then known exploit."""
    return verdict(F.when(T.contains_any(text, CANARIES), "CANARY").when(T.first_match(text, EXPLOITS).isNotNull(), "EXPLOIT"))


def heat(text: Column, soft_bytes: int = 8_000, lexicon: dict[str, tuple[int, list[str]]] = HEAT_WORDS) -> Column:
    """Points of one prompt: size, one amount per category of words, and 2 for three categories or more."""
    size = F.octet_length(text)

    def points(low: Column) -> Column:
        hits = {k: T.contains_any(low, words) for k, (_, words) in lexicon.items()}
        total = F.when(size > soft_bytes, 2).when(size > 2_000, 1).otherwise(0)
        kinds = F.lit(0)
        for k, (n, _) in lexicon.items():
            total = total + F.when(hits[k], n).otherwise(0)
            kinds = kinds + hits[k].cast("int")
        return total + F.when(kinds >= 3, 2).otherwise(0)

    return T.once(T.ascii_lower(text), points)


def goal_deviation(goal: Column, step: Column, depth: Column, max_depth: int = 10) -> Column:
    """A step that does what the goal does not name, takes rights, or is too deep."""
    stray = F.coalesce(*[F.when(step.contains(w) & ~goal.contains(w), F.lit(w)) for w in DEVIATIONS])
    return verdict(F.when(stray.isNotNull(), "GOAL").when(T.contains_any(step, ["sudo", "chmod"]), "PRIVILEGE").when(depth > max_depth, "DEPTH"), stray)


def step_intent(goal: Column, step: Column, steps: Column, max_steps: int = 20) -> Column:
    return verdict(F.when(steps > max_steps, "STEPS").when(F.octet_length(step) > 5 * F.octet_length(goal), "LENGTH"))


def tool_call(tool: Column, args: Column, root: str = "/app/media/", gateways: tuple[str, ...] = ("wss://api.example.io", "wss://127.0.0.1")) -> Column:
    """Media paths outside ``root`` (resolved by their text), foreign gateways, shells, credentials, traversal."""
    path = F.regexp_replace(args, "^(MEDIA:)+", "")
    media = (tool == "MediaTool") & args.startswith("MEDIA:") & (~path.startswith(root) | path.rlike(r"(^|/)\.\.(/|$)"))
    url = F.regexp_extract(args, r"(?i)(wss?://\S*)", 1)
    foreign = (tool == "GatewayTool") & (url != "") & ~F.coalesce(*[F.when(url.startswith(g), True) for g in gateways], F.lit(False))
    code = F.when(media, "MEDIA_PATH").when(foreign, "GATEWAY").when(args.contains("base64 -d") & args.contains("| sh"), "SHELL").when(T.contains_any(args, TOOL_ARGUMENTS), "SENSITIVE_PATH")
    return verdict(code)


def tool_gate(tool: Column, tainted: Column) -> Column:
    """Tool names must be letters, digits and underscores; with tainted data only safe tools may run."""
    risk = F.when(tool.isin(CRITICAL_TOOLS), "Critical").when(tool.isin(HIGH_RISK_TOOLS), "HighRisk").otherwise("Safe")
    name = F.coalesce(tool.rlike(r"^[\p{L}\p{N}_]+$"), F.lit(False))
    return verdict(F.when(~name, "NAME").when(tainted & (risk != "Safe"), "TAINTED"), risk)


def agent_message(sender: Column, message: Column) -> Column:
    return verdict(F.when(~F.coalesce(sender.startswith("authorized_"), F.lit(False)), "SENDER").when(T.contains_any(F.lower(message), ["delete", "export"]), "INTENT"))


def canonical_permissions(permissions: Column) -> Column:
    """Permissions of a manifest that reach critical files."""
    path = lambda p: F.regexp_replace(p, "^fs[.](write|read):", "")
    return F.filter(permissions, lambda p: p.rlike("^fs[.](write|read):") & (path(p).contains("..") | path(p).isin("/etc/shadow", "/etc/passwd", "/etc/hosts")))


def content_intact(text: Column, digest: Column) -> Column:
    """Metadata holds 64 hexadecimal digits that are the text's SHA-256."""
    return verdict(F.when(digest.isNull(), "MISSING").when(~digest.rlike("^[0-9a-fA-F]{64}$"), "FORMAT").when(F.lower(digest) != F.sha2(text, 256), "MISMATCH"))


def valid_id(value: Column, most: int = 64) -> Column:
    return F.coalesce(value.rlike(rf"^[A-Za-z0-9_.:@-]{{1,{most}}}$"), F.lit(False))


def magnitude_above(vector: Column, threshold: float) -> Column:
    """Euclidean length above ``threshold``."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))) > threshold
