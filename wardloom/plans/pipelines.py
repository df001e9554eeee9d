"""Composite pipelines: several guards over one text, the first that trips decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.functions import text as T
from wardloom.operators import detectors as D
from wardloom.operators import folds, lookups, rewrite
from wardloom.session import cut


def intent_route(text: Column, drift: Column | None = None) -> Column:
    """A for small talk, B for questions (C if they drift by more than 0.7), C for actions; words inside words count."""
    low = F.lower(text)
    drifting = F.lit(False) if drift is None else F.coalesce(drift > 0.7, F.lit(False))
    asks = F.when(drifting, "C").otherwise("B")
    return (
        F.when(T.contains_any(low, ["hello", "hey", "weather"]), "A")
        .when(T.contains_any(low, ["legal", "contract", "finance", "research"]), asks)
        .when(T.contains_any(low, ["code", "deploy", "agent"]), "C")
        .otherwise(asks)
    )


def speculative_route(text: Column) -> Column:
    """BLOCK on stage one, else the path of the intent."""
    path = {"A": "FAST", "B": "SHIELDED", "C": "AIRLOCK"}
    route = intent_route(text)
    return F.when(D.stage_one(text)["tripped"], "BLOCK").otherwise(F.coalesce(*[F.when(route == k, v) for k, v in path.items()]))


def mesh(text: Column) -> Column:
    """(outcome, stream): a block or drift beats the route; the streamed text has its secrets masked."""
    stopped = D.stage_one(text)["tripped"] | F.lower(text).contains("poison")
    outcome = F.when(text.isNull(), None).when(stopped, "BLOCK").otherwise(intent_route(text))
    return F.struct(outcome.alias("outcome"), F.replace(text, F.lit("SECRET"), F.lit("******")).alias("stream"))


def anomalies(df: DataFrame, key: str, text: str, protected: DataFrame, most_bytes: int = 65_536) -> DataFrame:
    """(key, kind, detail): oversize texts, which are looked at no further, imitated domains, and injection phrases."""
    size = F.octet_length(text)
    large = df.where(size > most_bytes).select(key, F.lit("INPUT_TOO_LARGE").alias("kind"), F.lit(None).cast("string").alias("detail"))
    rest = df.where(size <= most_bytes)
    domains = lookups.domain_findings(rest, key, text, protected).select(key, F.when(F.col("kind") == "TYPOSQUAT", "TYPOSQUAT_DETECTED").otherwise("HOMOGRAPH_SUSPECTED").alias("kind"), F.col("domain").alias("detail"))
    phrase = rest.where(F.lower(text).contains("ignore previous instructions")).select(key, F.lit("JAILBREAK_ATTEMPT").alias("kind"), F.lit(None).cast("string").alias("detail"))
    return large.unionByName(domains).unionByName(phrase)


def guard_prompts(df: DataFrame, key: str, user: str, time: str, text: str, secret: bytes, heat_limit: int = 10, verified: DataFrame | None = None) -> DataFrame:
    """(key, code, redacted): the universal guard over prompts.

    Order: input rules, padding flood, injection, redaction failure, packages, system leak, escalation.  All
    but packages and escalation are one pass over the text.  Packages that the redacted text asks to install
    must be in ``verified`` (package); without it none is.  Escalation is the per-user heat over time of the
    prompts that got as far.  The redacted text is given where no code is.
    """
    if verified is None:
        verified = df.sparkSession.createDataFrame([], "package string")
    t = F.col(text)
    bad_input = F.col(user).isNull() | (F.octet_length(user) > 256) | t.isNull() | (F.octet_length(t) > 2_000_000)
    wrapped = rewrite.compatible(t)
    redacted, _ = rewrite.redact(df.select(key, user, time, text, wrapped.alias("_plain")), "_plain", secret)
    injected = D.too_long(t)["tripped"] | D.signature(F.col("_n"))["tripped"] | D.injection_pattern(F.col("_n"))["tripped"] | D.encoding_attack(F.col("_n"))["tripped"] | D.sign_density(F.col("_n"))["tripped"] | D.delimiter(F.col("_n"))["tripped"] | D.jailbreak_indicator(F.col("_n"))["tripped"]
    checked = redacted.withColumn("_n", wrapped).select(
        key, user, time, "_plain",
        F.when(bad_input, "INPUT")
        .when(D.many_shot(t)["tripped"], "EMG26")
        .when(injected, "LLM01")
        .when(F.col("redaction_error").isNotNull(), "REDACTION_FAILED").alias("_code"),
        F.when(D.system_leak(F.col("_n"))["tripped"], "LLM06").alias("_leak"),
        F.coalesce(D.heat(t), F.lit(0)).alias("_points"),
    )
    checked = cut(checked)  # the packages, the fold and the join read it
    risky = lookups.package_findings(checked.where("_code is null"), key, "_plain", verified).select(key).distinct().withColumn("_risky", F.lit(True))
    held = checked.join(risky, key, "left").withColumn("_code", F.coalesce("_code", F.when(F.col("_risky"), "EMG28"), "_leak"))
    # a prompt that is blocked before does not heat its user up
    hot = folds.heat(held.where("_code is null"), user, time, key, "_points", limit=heat_limit).select(key, F.col("tripped").alias("_hot"))
    joined = held.join(hot, key, "left")
    code = F.coalesce("_code", F.when(F.col("_hot"), "EMG29"))
    return joined.select(key, code.alias("code"), F.when(code.isNull(), F.col("_plain")).alias("redacted"))


def secure_ingest(df: DataFrame, key: str, origin: str, text: str, digest: str, hosts: tuple[str, ...]) -> DataFrame:
    """(key, code, text): origin on https in the allowed hosts or below, intact content, hidden signs dropped, poison score."""
    host = T.url_host(F.col(origin))
    known = F.exists(T.domain_suffixes(host), lambda d: d.isin(*hosts))
    secure = F.lower(F.try_parse_url(F.col(origin), F.lit("PROTOCOL"))) == "https"
    port = F.regexp_extract(F.try_parse_url(F.col(origin), F.lit("AUTHORITY")), r":(\d+)$", 1).isin("", "443")
    shown = F.regexp_replace(F.col(text), f"[{T.ZERO_WIDTH}{T.BIDI}]", "")
    code = (
        F.when(~F.coalesce(secure & known & port, F.lit(False)), "ORIGIN")
        .when(D.content_intact(F.col(text), F.col(digest))["tripped"], D.content_intact(F.col(text), F.col(digest))["code"])
        .when(D.poisoned(shown)["tripped"], "POISON")
    )
    return df.select(key, code.alias("code"), F.when(code.isNull(), shown).alias(text))


def edge_response(df: DataFrame, key: str, code: str, text: str) -> DataFrame:
    """(key, body): the JSON answer for each prompt, blocked or not."""
    blocked = F.to_json(F.struct(F.lit("blocked").alias("status"), F.col(code).alias("reason")))
    passed = F.to_json(F.struct(F.lit("authorized").alias("status"), F.col(text).alias("response")))
    return df.select(key, F.when(F.col(code).isNotNull(), blocked).otherwise(passed).alias("body"))


def validated_output(raw: Column, most_bytes: int = 1_000_000, most_chars: int = 200_000) -> Column:
    """(text, code): strict JSON {"title", "body"} with printable fields, free of active content, HTML-escaped."""
    parsed = F.from_json(raw, "title string, body string")
    keys = F.array_sort(F.json_object_keys(raw))
    body, title = parsed["body"], parsed["title"]
    code = (
        F.when(F.octet_length(raw) > most_bytes, "SIZE")
        .when(keys.isNull() | (keys != F.array(F.lit("body"), F.lit("title"))) | title.isNull() | body.isNull(), "FORMAT")
        .when((title == "") | (body == "") | (F.length(title) > 256) | (F.length(body) > most_chars), "LENGTH")
        .when(title.rlike(r"\p{Cc}") | body.rlike(T.CONTROL), "CONTROL")
        .when(D.output_payload(body)["tripped"] | D.output_payload(title)["tripped"], "PAYLOAD")
    )
    return F.struct(F.when(code.isNull(), rewrite.escaped_html(body)).alias("text"), code.alias("code"))
