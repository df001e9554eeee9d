"""Gates over records: permissions, proposals, plug-in input, addresses, authority, signed tokens, budgets.

Each gives a code column, null where the record passes.  Null inputs never pass a gate that needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.functions import crypto
from wardloom.functions import text as T
from wardloom.operators import folds
from wardloom.operators.vectors import cosine

# Words of an action that set its risk (0 low, 1 medium, 2 high, 3 critical), first match first.
ACTION_RISKS = ((2, ("fs.write", "shell.exec", "payment")), (3, ("keychain", ".env")), (1, ("email.send", "calendar")))
# Actions that may never be proposed, that only read, and that change something.
FORBIDDEN = ("SEND_EMAIL", "DELETE_FILE", "EXECUTE_SHELL", "COMMIT_CODE")
READ_ONLY = ("SEARCH_KNOWLEDGE_GRAPH", "GET_CASE_STATUS", "FETCH_DOCUMENT", "LOOKUP_PRECEDENT")
MUTATING = ("UPDATE_CASE", "CREATE_TICKET", "ADD_NOTE", "WRITE_SUMMARY")
RESERVED = "PROPOSE_"
# Charset and greatest length of each kind of id.
ID_SHAPES = {"request": (r"^[A-Za-z0-9_.-]+$", 64), "subject": (r"^[A-Za-z0-9_-]+$", 96), "user": (r"^[A-Za-z0-9_:.@-]+$", 256), "agent": (r"^[A-Za-z0-9_.-]+$", 128), "secret": (r"^[A-Za-z0-9_./:-]+$", 256)}
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def action_risk(action: Column) -> Column:
    """0 to 3 by the words in an action."""
    return F.coalesce(*[F.when(T.contains_any(action, list(words)), F.lit(risk)) for risk, words in ACTION_RISKS], F.lit(0))


def agency(action: Column, most: Column) -> Column:
    """DENIED above the user's greatest risk (low if unknown), APPROVAL for a high risk within it."""
    risk = action_risk(action)
    return F.when(risk > F.coalesce(most, F.lit(0)), "DENIED").when(risk >= 2, "APPROVAL")


def proposal(action: Column, payload: Column, allowed: tuple[str, ...] | None = None, most_bytes: int = 65_536) -> Column:
    """(code, action, risk) of a proposed action and its JSON payload, first failure first."""
    name = F.upper(F.trim(action))
    is_object = F.coalesce(F.get_json_object(payload, "$").startswith("{"), F.lit(False))
    code = (
        F.when(F.coalesce(name == "", F.lit(True)), "EMPTY")
        .when(F.octet_length(name) > 64, "LENGTH")
        .when(~name.rlike("^[A-Z0-9_]+$"), "CHARSET")
        .when(name.startswith(RESERVED), "RESERVED")
        .when(~name.isin(*allowed) if allowed else F.lit(False), "NOT_ALLOWED")
        .when(name.isin(*FORBIDDEN), "FORBIDDEN")
        .when(~is_object, "PAYLOAD_TYPE")
        .when(F.octet_length(payload) > most_bytes, "PAYLOAD_SIZE")
    )
    risk = F.when(name.isin(*MUTATING), "Mutating").when(name.isin(*READ_ONLY), "ReadOnly").otherwise("Unknown")
    return F.struct(code.alias("code"), F.when(code.isNull(), name).alias("action"), F.when(code.isNull(), risk).alias("risk"))


def plugin_input(raw: Column, most_bytes: int = 8_192) -> Column:
    """(code, case_id, query_type) of a search tool's JSON input: exactly a uuid and a kind of query."""
    keys = F.array_sort(F.json_object_keys(raw))
    parsed = F.from_json(raw, "case_id string, query_type string")
    case, kind = F.trim(parsed["case_id"]), F.lower(F.trim(parsed["query_type"]))
    named = F.when(kind == "summary", "Summary").when(kind == "status", "Status").when(kind.isin("riskassessment", "risk_assessment", "risk-assessment"), "RiskAssessment")
    code = (
        F.when(F.octet_length(raw) > most_bytes, "SIZE")
        .when(keys.isNull() | (keys != F.array(F.lit("case_id"), F.lit("query_type"))), "JSON")
        .when(~F.coalesce(case.rlike(UUID), F.lit(False)), "CASE_ID")
        .when(named.isNull(), "QUERY_TYPE")
    )
    return F.struct(code.alias("code"), F.when(code.isNull(), F.lower(case)).alias("case_id"), F.when(code.isNull(), named).alias("query_type"))


def outbound(df: DataFrame, url: str, blocked: DataFrame, approved: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``host``, ``code`` and ``matched``: URLs that do not parse, other schemes than http(s), and hosts at or below a blocked domain.

    Approved hosts pass before the blocked ones are asked.
    """
    from wardloom.operators.lookups import blocked_hosts

    scheme = F.lower(F.try_parse_url(F.col(url), F.lit("PROTOCOL")))
    seen = df.withColumn("_scheme", scheme).withColumn("host", T.url_host(F.col(url)))
    found = blocked_hosts(seen, "host", blocked, approved)
    code = F.when(F.col("_scheme").isNull(), "URL").when(~F.col("_scheme").isin("http", "https"), "SCHEME").when(F.col("host").isNull(), "HOST").when(F.col("matched").isNotNull(), "BLOCKED")
    return found.withColumn("code", code).withColumn("matched", F.when(F.col("code") == "BLOCKED", F.col("matched"))).drop("_scheme")


def authority(level: Column, consensus: Column) -> Column:
    """Firms pass, partners with consensus, unverified sources never; an unknown source (null level) is NOT_FOUND."""
    return F.when(level.isNull(), "NOT_FOUND").when(level == "Firm", None).when((level == "Partner") & F.coalesce(consensus, F.lit(False)), None).when(level == "Partner", "CONSENSUS").otherwise("LOW_AUTHORITY")


def export_gate(cited: Column, verified: Column) -> Column:
    """(code, missing) of two lists of citations: every cited one must be verified, and no more can be verified than cited."""
    total, good = F.array_distinct(cited), F.array_distinct(verified)
    missing = F.size(F.array_except(total, good))
    code = F.when(F.size(good) > F.size(total), "INVARIANT").when(missing > 0, "MISSING")
    return F.struct(code.alias("code"), missing.alias("missing"))


def confidence_lock(score: Column, threshold: float) -> Column:
    """LOCKED for no or low confidence, INVALID outside 0..1 or not a number."""
    return F.when(score.isNull(), "LOCKED").when(F.isnan(score) | ~score.between(0.0, 1.0), "INVALID").when(score < threshold, "LOCKED")


def valid_shape(value: Column, kind: str) -> Column:
    """Whether an id has the charset and length of its kind (:data:`ID_SHAPES`); users are trimmed first."""
    pattern, most = ID_SHAPES[kind]
    v = F.trim(value) if kind == "user" else value
    return F.coalesce(v.rlike(pattern) & (F.octet_length(v) <= most), F.lit(False))


def liveness(verified: Column, device: Column, trusted: tuple[str, ...]) -> Column:
    """UV without user verification, HARDWARE for a device that is not trusted."""
    return F.when(~F.coalesce(verified, F.lit(False)), "UV").when(~F.coalesce(device.isin(*trusted), F.lit(False)), "HARDWARE")


def granted(df: DataFrame, grants: DataFrame) -> DataFrame:
    """``df`` with ``granted``: its subject, action and resource stand in ``grants`` together."""
    keys = ["subject", "action", "resource"]
    return df.join(grants.select(*keys).distinct().withColumn("_g", F.lit(True)), keys, "left").withColumn("granted", F.coalesce("_g", F.lit(False))).drop("_g")


def provenance_payload(origin: Column, fetched_at: Column, digest: Column, length: Column, pinset: Column) -> Column:
    """The text that a source signs; missing parts are empty."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (origin, fetched_at, digest, length, pinset)])


def model_output(raw: Column, most: int = 8_000, newlines: bool = True) -> Column:
    """(text, truncated, warnings, code) of a model's JSON {text, tokens, logits, logprobs}.

    Only the text goes on; the lists must be of equal length and the numbers finite.  Control signs go, line
    breaks become blanks unless ``newlines``, the text is trimmed and cut to ``most`` characters.
    """
    parsed = F.from_json(raw, "text string, tokens array<int>, logits array<double>, logprobs array<double>")
    keys = F.array_sort(F.json_object_keys(raw))
    finite = lambda xs: F.forall(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    flat = parsed["text"] if newlines else F.replace(parsed["text"], F.lit("\n"), F.lit(" "))
    shown = F.regexp_replace(flat, r"[\p{Cc}&&[^\n\t]]", "")
    clean = F.regexp_replace(shown, r"^\s+|\s+$", "")
    sizes = (F.size(parsed["tokens"]) == F.size(parsed["logits"])) & (F.size(parsed["tokens"]) == F.size(parsed["logprobs"]))
    code = (
        F.when(keys.isNull() | (keys != F.array(*map(F.lit, ("logits", "logprobs", "text", "tokens")))) | parsed["text"].isNull(), "FORMAT")
        .when(~F.coalesce(sizes & finite(parsed["logits"]) & finite(parsed["logprobs"]), F.lit(False)), "LOGITS")
        .when(clean == "", "EMPTY")
    )
    warnings = F.array_compact(F.array(F.when(shown != parsed["text"], "NORMALIZED"), F.when(clean != shown, "TRIMMED")))
    return F.struct(F.when(code.isNull(), F.left(clean, F.lit(most))).alias("text"), (code.isNull() & (F.length(clean) > most)).alias("truncated"), warnings.alias("warnings"), code.alias("code"))


def shown_text(text: Column, most: int) -> Column:
    """Trimmed text without control signs other than line feeds and tabs, at most ``most`` characters; null if blank."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(t != "", F.left(F.regexp_replace(t, r"[\p{Cc}&&[^\n\t]]", ""), F.lit(most)))


def assessment(score: Column, reasoning: Column, intent: Column, escalate: Column) -> Column:
    """(code, score, reasoning, intent, escalate): scores clamped to 0..1 (and escalated if outside), texts cleaned."""
    name = F.left(F.regexp_replace(F.upper(F.trim(intent)), "[^A-Z0-9]", "_"), F.lit(64))
    why = shown_text(reasoning, 2_000)
    code = F.when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), "SCORE").when(why.isNull(), "REASONING").when(F.coalesce(~name.rlike("[A-Z0-9]"), F.lit(True)), "INTENT")
    ok = code.isNull()
    return F.struct(code.alias("code"), F.when(ok, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).alias("score"), F.when(ok, why).alias("reasoning"), F.when(ok, name).alias("intent"), (ok & (F.coalesce(escalate, F.lit(False)) | ~score.between(0.0, 1.0))).alias("escalate"))


def research_result(confidence: Column, risk: Column, analysis: Column, most: int = 4_000) -> Column:
    """(confidence, risk, analysis, fallback): clamped and cleaned; a result that is not usable becomes the cautious one."""
    text = shown_text(analysis, most)
    good = F.coalesce(~F.isnan(confidence) & ~F.isnan(risk) & (F.abs(confidence) < float("inf")) & (F.abs(risk) < float("inf")) & text.isNotNull(), F.lit(False))
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return F.struct(F.when(good, unit(confidence)).otherwise(0.0).alias("confidence"), F.when(good, unit(risk)).otherwise(1.0).alias("risk"), F.when(good, text).otherwise("UNAVAILABLE").alias("analysis"), (~good).alias("fallback"))


def candidate_json(response: Column) -> Column:
    """The JSON text in a model response's first candidate, without byte order mark and code fences."""
    from wardloom.operators.rewrite import fenced_json

    return fenced_json(F.get_json_object(response, "$.candidates[0].content.parts[0].text"))


# ---- tokens


def signed_canary(prefix: str, session: Column, salt: Column, key: bytes) -> Column:
    """A canary token whose uuid holds the session (8 hexadecimal digits), a salt (8) and their code (16)."""
    body = F.concat(F.lpad(F.lower(F.hex(session.cast("long"))), 8, "0"), salt)
    digits = F.concat(body, crypto.hmac_sha256_of(key, F.unhex(body), 16))
    return F.concat_ws("-", F.lit(prefix), *[F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def canary_session(token: Column, key: bytes) -> Column:
    """The session of a signed canary whose code is right, else null."""
    digits = F.replace(F.right(token, F.lit(36)), F.lit("-"), F.lit(""))
    body = F.substring(digits, 1, 16)
    right = digits.rlike("^[0-9a-f]{32}$") & (crypto.hmac_sha256_of(key, F.unhex(body), 16) == F.substring(digits, 17, 16))
    return F.when(right, F.conv(F.substring(body, 1, 8), 16, 10).cast("long"))


def _tag(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 16)


def vault_token(agent: Column, secret: Column, uuid: Column, expires_ms: Column, key: bytes, kid: str = "01") -> Column:
    """A scoped token: its agent, secret and expiry, under a code."""
    head = F.concat_ws(":", F.lit(f"ZT:v1:KID:{kid}:AG"), _tag(agent), F.lit("SC"), _tag(secret), F.lit("UUID"), uuid, F.lit("EXP"), expires_ms.cast("string"))
    return F.concat(head, F.lit(":MAC:"), crypto.hmac_sha256(key, head, 32))


def resolve_tokens(calls: DataFrame, records: DataFrame, key: bytes) -> DataFrame:
    """``calls`` (call_id, agent, token, at_ms) with ``code`` and ``secret_name``.

    Checked in this order: format, code, expiry, record, agent, scope, one use.  ``records`` has unique
    token, secret_name and one_time.  Only a call that passes all other checks uses a one-time token up;
    the first such call by time and id does.  Forged tokens meet no record.
    """
    part = lambda i: F.element_at(F.split("token", ":"), i)
    shape = F.col("token").rlike(r"^ZT:v1:KID:\d{2}:AG:[0-9a-f]{16}:SC:[0-9a-f]{16}:UUID:[0-9a-f-]{36}:EXP:\d{1,18}:MAC:[0-9a-f]{32}$")
    head = F.regexp_extract("token", r"^(.*):MAC:[0-9a-f]{32}$", 1)
    early = (
        F.when(~F.coalesce(shape, F.lit(False)), "FORMAT")
        .when(crypto.hmac_sha256(key, head, 32) != part(14), "MAC")
        .when(F.col("at_ms") >= part(12).cast("long"), "EXPIRED")
    )
    checked = calls.withColumn("_early", early)
    kept = records.select(F.col("token").alias("_t"), F.col("secret_name").alias("_s"), "one_time")
    met = checked.join(kept, (F.col("token") == F.col("_t")) & F.col("_early").isNull(), "left")
    code = F.coalesce(
        F.col("_early"),
        F.when(F.col("_t").isNull(), "NOT_FOUND").when(F.coalesce(_tag(F.col("agent")) != part(6), F.lit(True)), "AGENT").when(_tag(F.col("_s")) != part(8), "SCOPE"),
    )
    coded = met.withColumn("_code", code)
    first = coded.where("_code is null and one_time").groupBy("token").agg(F.min(F.struct("at_ms", "call_id")).alias("_first")).withColumnRenamed("token", "_tok")
    out = coded.join(first, F.col("token") == F.col("_tok"), "left")
    used = F.col("one_time") & (F.struct("at_ms", "call_id") != F.col("_first"))
    last = F.coalesce(F.col("_code"), F.when(used, "USED"))
    return out.select("call_id", "agent", "token", "at_ms", last.alias("code"), F.when(last.isNull(), F.col("_s")).alias("secret_name"))


# ---- budgets, alerts, rules


def privacy_budget(df: DataFrame, key: str, time: str, id_: str, epsilon: str, total: float) -> DataFrame:
    """(key, id, consumed, allowed): a query runs if its epsilon still fits the key's budget; a refused one costs nothing.

    The budget never starts anew, so a key's queries are one piece; they stream through a task with one
    number of state.  Rows with null key, time or epsilon are left out.  Epsilons count in millionths.
    """
    limit = round(total * 1e6)

    def step(spent, row):
        ok = spent + row[0] <= limit
        spent = spent + row[0] if ok else spent
        return spent, (spent / 1e6, ok)

    rows = df.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(epsilon).isNotNull())
    rows = rows.withColumn("_us", F.unix_micros(time)).withColumn("_e", F.round(F.col(epsilon) * 1_000_000).cast("long"))
    return folds.fold(rows, [key], ["_us", id_], ["_e"], "consumed double, allowed boolean", int, step).drop("_us")


def alert_runs(df: DataFrame, time: str, minutes: int, limit: float, hold_minutes: int) -> DataFrame:
    """(minute, n, rate, firing): events per second over the last ``minutes``, by the minute.

    An alert fires once the rate has stood above ``limit`` for ``hold_minutes`` minutes on end.  Each event
    counts in the minutes that still see it, and a busy minute is one number before that.
    """
    per = df.where(F.col(time).isNotNull()).groupBy(F.floor(F.unix_seconds(time) / 60).alias("m")).agg(F.count(F.lit(1)).alias("c"))
    seen = per.withColumn("minute", F.explode(F.sequence(F.col("m"), F.col("m") + minutes - 1))).groupBy("minute").agg(F.sum("c").alias("n"))
    high = seen.withColumn("rate", F.col("n") / (60.0 * minutes)).withColumn("high", F.col("n") / (60.0 * minutes) > limit)
    # a minute fires if it and the minutes before it that it must have held are all high
    held = high.where("high").select(F.explode(F.sequence("minute", F.col("minute") + hold_minutes)).alias("minute")).groupBy("minute").agg(F.count(F.lit(1)).alias("_h"))
    return high.join(held, "minute", "left").select("minute", "n", "rate", F.coalesce(F.col("_h") == hold_minutes + 1, F.lit(False)).alias("firing"))


def rule_state(state: Column, triggers: Column, hits: Column, misses: Column) -> Column:
    """(precision, next_state): promoted from STAGING at 10 triggers and over 0.95, demoted to REVIEW under 0.80 at 5."""
    total = hits + misses
    precision = F.when(total > 0, hits / total)
    up = (state == "STAGING") & (triggers >= 10) & F.coalesce(precision > 0.95, F.lit(False))
    down = (triggers >= 5) & F.coalesce(precision < 0.80, F.lit(False))
    return F.struct(precision.alias("precision"), F.when(down, "REVIEW").when(up, "ACTIVE").otherwise(state).alias("next_state"))


def synergy(uses: DataFrame) -> DataFrame:
    """(agent, score, frozen): reading files with mail or network is 0.95, searching with network 0.60, else 0.10; over 0.85 freezes."""
    has = lambda *tools: F.coalesce(F.bool_or(F.col("tool").isin(*tools)), F.lit(False))
    net = has("curl", "fetch")
    score = F.when(has("read_file") & (has("email") | net), 0.95).when(has("search") & net, 0.60).otherwise(0.10)
    return uses.groupBy("agent").agg(score.alias("score"), (score > 0.85).alias("frozen"))


def drift(df: DataFrame, golden: DataFrame, topic: str, key: str, vector: str, least: float = 0.75) -> DataFrame:
    """(topic, key, golden, similarity): steps less similar than ``least`` to a golden trace of their topic.

    ``golden`` has topic, golden (id) and vector; each step meets its topic's golden traces only.
    """
    g = golden.select(topic, F.col("golden"), F.col(vector).alias("_v"))
    return df.select(topic, key, vector).join(g, topic).withColumn("similarity", cosine(F.col(vector), F.col("_v"))).where(F.col("similarity") < least).select(topic, key, "golden", "similarity")


def log_graph(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of an audit log: users, sessions, agents and risks, and what ties them.

    Vertices have id, label, first_seen, last_seen, compromised; edges src, dst, rel and their count n.
    """
    e = events.select("user_id", "session_id", "agent_id", "risk_code", "logged_at")
    parts = [(c, label) for c, label in (("user_id", "User"), ("session_id", "Session"), ("agent_id", "Agent"))]
    worm = F.coalesce(F.col("risk_code") == "EMG27", F.lit(False))
    seen = [e.where(F.col(c).isNotNull()).select(F.col(c).alias("id"), F.lit(label).alias("label"), "logged_at", (worm if label == "Agent" else F.lit(False)).alias("w")) for c, label in parts]
    vertices = seen[0].unionByName(seen[1]).unionByName(seen[2]).groupBy("id", "label").agg(F.min("logged_at").alias("first_seen"), F.max("logged_at").alias("last_seen"), F.max("w").alias("compromised"))
    ties = [("user_id", "session_id", "INITIATED", F.lit(True)), ("session_id", "agent_id", "CALLED_AGENT", F.lit(True)), ("agent_id", "risk_code", "EXHIBITED_BEHAVIOR", worm)]
    made = [e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & test).select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(rel).alias("rel")) for a, b, rel, test in ties]
    return vertices, made[0].unionByName(made[1]).unionByName(made[2]).groupBy("src", "dst", "rel").agg(F.count(F.lit(1)).alias("n"))
