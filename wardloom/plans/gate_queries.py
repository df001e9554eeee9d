"""Queries of the record gates, pipelines and graph loads over the audit tables, and their SQL twins.

Where the tables have no column for what a gate reads (a tool call, a URL, a JSON answer), each event is given
one of a few cases by its id; both the query and its SQL do so over all events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions import arrow, crypto
from wardloom.functions import text as T
from wardloom.operators import detectors as D
from wardloom.operators import folds, gates, graph, lookups, rewrite
from wardloom.plans import pipelines
from wardloom.plans.text_queries import PROMPTS, any_of, first_of, lit, prompts
from wardloom.sources import sinks
from wardloom.sources.tables import audit_events, audit_ledger, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEY = b"key of the gate queries"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


EVENTS = "(select event_id, any_value(logged_at) as logged_at, any_value(risk_code) as risk_code, any_value(severity) as severity, any_value(user_id) as user_id, any_value(agent_id) as agent_id, any_value(session_id) as session_id, any_value(rule_id) as rule_id, any_value(intervention_type) as intervention_type, any_value(cognitive_score) as cognitive_score from audit_events group by event_id)"
IDS = "(select distinct event_id from audit_events)"


def ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "audit_events").select("event_id").distinct()


def case(values: list, shift: int = 0) -> Column:
    """The event's case of a list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col("event_id") + shift, F.lit(len(values))) + 1).cast("int"))


def sql_case(values: list[str], shift: int = 0) -> str:
    return f"([{', '.join('null' if v is None else lit(v) for v in values)}])[((event_id + {shift}) % {len(values)}) + 1]"


# ---- permissions and proposals

ACTIONS = ["fs.write:/srv/x", "shell.exec ls", "send payment 3", "read keychain", "open .env", "email.send a", "calendar.add b", "search docs"]
_RISK = "case when contains(a, 'fs.write') or contains(a, 'shell.exec') or contains(a, 'payment') then 2 when contains(a, 'keychain') or contains(a, '.env') then 3 when contains(a, 'email.send') or contains(a, 'calendar') then 1 else 0 end"


@query(f"""
select event_id, risk, case when risk > coalesce(most, 0) then 'DENIED' when risk >= 2 then 'APPROVAL' end as code from (
  select event_id, user_id, {_RISK.replace('a,', sql_case(ACTIONS) + ',')} as risk from {EVENTS} e)
left join (select id as user_id, max(length(email) % 4) as most from users group by id) using (user_id)""")
def agency_gate(spark, folder):
    levels = table(spark, folder, "users").groupBy(F.col("id").alias("user_id")).agg(F.max(F.length("email") % 4).alias("most"))
    e = audit_events(spark, folder, ["user_id"]).join(levels, "user_id", "left")
    return e.select("event_id", gates.action_risk(case(ACTIONS)).alias("risk"), gates.agency(case(ACTIONS), F.col("most")).alias("code"))


PROPOSED = ["send_email", " update_case ", "GET_CASE_STATUS", "propose_x", "do it", "", "ADD_NOTE", "custom_1", "A" * 65]
PAYLOADS = ['{"a":1}', "[1]", '{"b":{"c":2}}', "7"]


@query(f"""
select event_id, code, case when code is null then n end as action,
  case when code is null then case when n in ('UPDATE_CASE','CREATE_TICKET','ADD_NOTE','WRITE_SUMMARY') then 'Mutating' when n in ('SEARCH_KNOWLEDGE_GRAPH','GET_CASE_STATUS','FETCH_DOCUMENT','LOOKUP_PRECEDENT') then 'ReadOnly' else 'Unknown' end end as risk
from (select event_id, n, case when n = '' then 'EMPTY' when strlen(n) > 64 then 'LENGTH' when not regexp_matches(n, '^[A-Z0-9_]+$') then 'CHARSET'
    when starts_with(n, 'PROPOSE_') then 'RESERVED' when n in ('SEND_EMAIL','DELETE_FILE','EXECUTE_SHELL','COMMIT_CODE') then 'FORBIDDEN' when json_type(p) <> 'OBJECT' then 'PAYLOAD_TYPE' end as code
  from (select event_id, upper(trim({sql_case(PROPOSED)})) as n, {sql_case(PAYLOADS, 1)} as p from {IDS} i))""")
def action_proposal(spark, folder):
    return ids(spark, folder).select("event_id", gates.proposal(case(PROPOSED), case(PAYLOADS, 1)).alias("p")).select("event_id", "p.*")


PLUGIN = ['{"case_id":"3f2504e0-4f89-11d3-9a0c-0305e82c3301","query_type":"summary"}', '{"case_id":"x","query_type":"Status"}', '{"case_id":"3F2504E0-4F89-11D3-9A0C-0305E82C3301","query_type":"Risk_Assessment"}', '{"case_id":"3f2504e0-4f89-11d3-9a0c-0305e82c3301","query_type":"drop"}', '{"case_id":"a","query_type":"b","x":1}', "[]"]


@query(f"""
select event_id, code, case when code is null then lower(c) end as case_id,
  case when code is null then case k when 'summary' then 'Summary' when 'status' then 'Status' else 'RiskAssessment' end end as query_type from (
  select event_id, c, k, case when ks is null or list_sort(ks) <> ['case_id', 'query_type'] then 'JSON'
    when not coalesce(regexp_matches(c, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$'), false) then 'CASE_ID'
    when k not in ('summary', 'status', 'riskassessment', 'risk_assessment', 'risk-assessment') then 'QUERY_TYPE' end as code
  from (select event_id, case when json_type(r) = 'OBJECT' then json_keys(r) end as ks, json_extract_string(r, '$.case_id') as c, lower(json_extract_string(r, '$.query_type')) as k from (select event_id, {sql_case(PLUGIN)} as r from {IDS} i)))""")
def plugin_input(spark, folder):
    return ids(spark, folder).select("event_id", gates.plugin_input(case(PLUGIN)).alias("p")).select("event_id", "p.*")


URLS = ["https://chat.shadow.example/x", "http://shadow.example.", "ftp://a.example", "https://gateway.shadow.example/y", "https://fine.example", "not a url", "https://notshadow.example"]


@query(f"""
select event_id, code, case when code = 'BLOCKED' then 'shadow.example' end as matched from (select event_id, case
  when not regexp_matches(u, '^[a-z]+://') then 'URL' when not regexp_matches(u, '^https?://') then 'SCHEME'
  when h <> 'gateway.shadow.example' and (h = 'shadow.example' or ends_with(h, '.shadow.example')) then 'BLOCKED' end as code
  from (select event_id, u, rtrim(regexp_extract(u, '^[a-z]+://([^/]*)', 1), '.') as h from (select event_id, {sql_case(URLS)} as u from {IDS} i)))""")
def outbound_urls(spark, folder):
    blocked = spark.createDataFrame([("shadow.example",)], "domain string")
    return gates.outbound(ids(spark, folder).withColumn("url", case(URLS)), "url", blocked, ("gateway.shadow.example",)).select("event_id", "code", "matched")


@query(f"""
select event_id, case when l is null then 'NOT_FOUND' when l = 'Firm' then null when l = 'Partner' and severity <= 2 then null when l = 'Partner' then 'CONSENSUS' else 'LOW_AUTHORITY' end as code
from (select event_id, severity, case when v.tier = 'fast' then 'Firm' when v.tier = 'airlock' then 'Unverified' when v.tier is not null then 'Partner' end as l from {EVENTS} e left join security_vectors v on upper(e.risk_code) = v.vector_id)""")
def authority_gate(spark, folder):
    v = table(spark, folder, "security_vectors").select(F.col("vector_id").alias("code"), "tier")
    e = audit_events(spark, folder, ["risk_code", "severity"]).withColumn("code", F.upper("risk_code")).join(v, "code", "left")
    level = F.when(F.col("tier") == "fast", "Firm").when(F.col("tier") == "airlock", "Unverified").when(F.col("tier").isNotNull(), "Partner")
    return e.select("event_id", gates.authority(level, F.col("severity") <= 2).alias("code"))


@query(f"""
select event_id, score_code, export_code, missing from (select event_id, case when s is null then 'LOCKED' when not s between 0 and 1 then 'INVALID' when s < 0.4 then 'LOCKED' end as score_code,
  len(list_filter(['a', 'b', 'c'], lambda x: x not in v)) as missing, case when len(v) > 3 then 'INVARIANT' when len(list_filter(['a', 'b', 'c'], lambda x: not list_contains(v, x))) > 0 then 'MISSING' end as export_code
  from (select event_id, cast(cognitive_score as double) as s, ([['a', 'b', 'c'], ['a'], ['a', 'b', 'c', 'd'], ['b', 'c']])[(event_id % 4) + 1] as v from {EVENTS} e))""".replace("lambda x: x not in v", "lambda x: not list_contains(v, x)"))
def reliance_gates(spark, folder):
    e = audit_events(spark, folder, ["cognitive_score"])
    verified = F.split(case(["a b c", "a", "a b c d", "b c"]), " ")
    g = gates.export_gate(F.array(*map(F.lit, "abc")), verified)
    return e.select("event_id", gates.confidence_lock(F.col("cognitive_score").cast("double"), 0.4).alias("score_code"), g["code"].alias("export_code"), g["missing"].cast("long").alias("missing"))


_SHAPE = lambda v, p, n: f"coalesce(regexp_matches({v}, '{p}') and strlen({v}) <= {n}, false)"


@query(f"select event_id, {_SHAPE('rule_id', '^[A-Za-z0-9_.-]+$', 64)} as request, {_SHAPE('session_id', '^[A-Za-z0-9_-]+$', 96)} as subject, {_SHAPE('trim(user_id)', '^[A-Za-z0-9_:.@-]+$', 256)} as actor, {_SHAPE('agent_id', '^[A-Za-z0-9_.-]+$', 128)} as agent, {_SHAPE('intervention_type', '^[A-Za-z0-9_./:-]+$', 256)} as secret from {EVENTS} e")
def id_shapes(spark, folder):
    e = audit_events(spark, folder, ["rule_id", "session_id", "user_id", "agent_id", "intervention_type"])
    shapes = {"request": ("rule_id", "request"), "subject": ("session_id", "subject"), "actor": ("user_id", "user"), "agent": ("agent_id", "agent"), "secret": ("intervention_type", "secret")}
    return e.select("event_id", *[gates.valid_shape(F.col(c), kind).alias(n) for n, (c, kind) in shapes.items()])


DEVICES = ["aa-1", "bb-2", "cc-3"]


@query(f"""
select event_id, case when not coalesce(severity >= 2, false) then 'UV' when {sql_case(DEVICES)} not in ('aa-1', 'cc-3') then 'HARDWARE' end as live_code,
  coalesce((user_id, risk_code) in (select actor_id, vector_id from audit_ledger where actor_id is not null and vector_id is not null), false) as granted from {EVENTS} e""")
def access_grants(spark, folder):
    e = audit_events(spark, folder, ["user_id", "risk_code", "severity"])
    asked = e.select("event_id", "severity", F.col("user_id").alias("subject"), F.lit("read").alias("action"), F.col("risk_code").alias("resource"))
    grants = table(spark, folder, "audit_ledger").select(F.col("actor_id").alias("subject"), F.lit("read").alias("action"), F.col("vector_id").alias("resource"))
    live = gates.liveness(F.col("severity") >= 2, case(DEVICES), ("aa-1", "cc-3"))
    return gates.granted(asked, grants).select("event_id", live.alias("live_code"), "granted")


# ---- tools and agents

TOOLS = ["MediaTool", "GatewayTool", "Shell", "Email_Send", "System_Execute", "bad name"]
ARGS = ["MEDIA:/app/media/a.png", "MEDIA:/app/media/../x", "open wss://evil.example/x", "open wss://127.0.0.1/x", "echo x | base64 -d | sh", "cat /etc/passwd", "plain"]
_ARG, _TOOL = sql_case(ARGS, 2), sql_case(TOOLS)


@query(f"""
select event_id, case when t = 'MediaTool' and starts_with(a, 'MEDIA:') and (not starts_with(substr(a, 7), '/app/media/') or contains(a, '/../')) then 'MEDIA_PATH'
    when t = 'GatewayTool' and contains(a, 'wss://') and not contains(a, 'wss://127.0.0.1') then 'GATEWAY'
    when contains(a, 'base64 -d') and contains(a, '| sh') then 'SHELL' when contains(a, '../') or contains(a, '/etc/passwd') then 'SENSITIVE_PATH' end as call_code,
  case when t = 'bad name' then 'NAME' when severity >= 3 and t in ('Email_Send', 'System_Execute') then 'TAINTED' end as gate_code,
  case when t = 'System_Execute' then 'Critical' when t = 'Email_Send' then 'HighRisk' else 'Safe' end as risk
from (select event_id, severity, {_TOOL} as t, {_ARG} as a from {EVENTS} e)""")
def tool_calls(spark, folder):
    e = audit_events(spark, folder, ["severity"])
    gate = D.tool_gate(case(TOOLS), F.coalesce(F.col("severity") >= 3, F.lit(False)))
    return e.select("event_id", D.tool_call(case(TOOLS), case(ARGS, 2))["code"].alias("call_code"), gate["code"].alias("gate_code"), gate["detail"].alias("risk"))


GOALS = ["summarise mail", "delete old drafts", "transfer the file"]
STEPS = ["delete drafts", "read mail", "sudo ls", "transfer money to x", "shutdown"]


@query(f"""
select event_id, case when w is not null then 'GOAL' when contains(s, 'sudo') or contains(s, 'chmod') then 'PRIVILEGE' when severity > 3 then 'DEPTH' end as code, w as detail,
  case when severity > 4 then 'STEPS' when strlen(s) > 5 * strlen(g) then 'LENGTH' end as intent_code from (
  select *, case when contains(s, 'delete') and not contains(g, 'delete') then 'delete' when contains(s, 'transfer') and not contains(g, 'transfer') then 'transfer' when contains(s, 'shutdown') then 'shutdown' end as w
  from (select event_id, severity, {sql_case(GOALS)} as g, {sql_case(STEPS)} as s from {EVENTS} e))""")
def goal_steps(spark, folder):
    e = audit_events(spark, folder, ["severity"])
    v = D.goal_deviation(case(GOALS), case(STEPS), F.col("severity"), 3)
    return e.select("event_id", v["code"].alias("code"), v["detail"].alias("detail"), D.step_intent(case(GOALS), case(STEPS), F.col("severity"), 4)["code"].alias("intent_code"))


_LEVELS = "(select agent_id, max(length(org_id) + cast(right(org_id, 1) as int)) as level from nhi_tokens where agent_id is not null group by agent_id)"


@query(f"""
select event_id, coalesce(s.level, 0) < coalesce(r.level, 0) and ({any_of('lower(coalesce(text, $$$$))', D.HANDOFF_VERBS)}) as blocked,
  case when not coalesce(starts_with(p.agent_id, 'planner'), false) then 'SENDER' end as sender_code
from (select event_id, any_value(agent_id) as agent_id, any_value(risk_code) as risk_code, any_value(input_prompt) as text from audit_events group by event_id) p
left join {_LEVELS} s on s.agent_id = p.agent_id left join {_LEVELS} r on r.agent_id = 'planner-0000000'""")
def agent_handoffs(spark, folder):
    levels = table(spark, folder, "nhi_tokens").where("agent_id is not null").groupBy(F.col("agent_id").alias("agent")).agg(F.max(F.length("org_id") + F.right("org_id", F.lit(1)).cast("int")).alias("level"))
    e = audit_events(spark, folder, ["agent_id", "input_prompt"]).select("event_id", F.col("agent_id").alias("sender"), F.lit("planner-0000000").alias("receiver"), F.col("input_prompt").alias("payload"))
    sender = F.when(~F.coalesce(F.col("sender").startswith("planner"), F.lit(False)), "SENDER")
    return lookups.handoffs(e, levels).select("event_id", "blocked", sender.alias("sender_code"))


@query(f"select event_id, case when not coalesce(starts_with(s, 'authorized_'), false) then 'SENDER' when {any_of('lower(text)', ['delete', 'export'])} then 'INTENT' end as code from (select event_id, {sql_case(['authorized_a', 'b', 'authorized_c'])} as s, text from {PROMPTS} p)")
def agent_messages(spark, folder):
    return prompts(spark, folder).select("event_id", D.agent_message(case(["authorized_a", "b", "authorized_c"]), F.col("text"))["code"].alias("code"))


GRANTS = ["fs.read:/etc/passwd", "fs.write:/srv/../etc", "fs.read:/srv/ok", "net.open", "fs.write:/etc/hosts"]


@query(f"select event_id, len(list_filter([{sql_case(GRANTS)}, {sql_case(GRANTS, 3)}], lambda p: p in ('fs.read:/etc/passwd', 'fs.write:/srv/../etc', 'fs.write:/etc/hosts'))) as critical from {IDS} i")
def skill_permissions(spark, folder):
    return ids(spark, folder).select("event_id", F.size(D.canonical_permissions(F.array(case(GRANTS), case(GRANTS, 3)))).cast("long").alias("critical"))


# ---- content, ingest, output


@query("select doc_id, case when doc_id % 4 = 0 then 'MISSING' when doc_id % 4 = 1 then 'FORMAT' when doc_id % 4 = 2 and text is not null then 'MISMATCH' end as code from documents")
def content_integrity(spark, folder):
    n = F.col("doc_id") % 4
    digest = F.when(n == 1, "zz").when(n == 2, F.sha2(F.concat("text", F.lit("x")), 256)).when(n == 3, F.upper(F.sha2("text", 256)))
    digest = F.when(n.isin(2, 3), F.coalesce(digest, F.sha2(F.lit(""), 256))).otherwise(digest)
    return table(spark, folder, "documents").select("doc_id", D.content_intact(F.col("text"), digest)["code"].alias("code"))


ORIGINS = ["https://vault.example/a", "http://vault.example/a", "https://sub.vault.example:443/b", "https://vault.example.evil.test/", "https://vault.example:8443/"]
_ZW = "[" + T.ZERO_WIDTH + T.BIDI + "]"


@query(f"""
select doc_id, case when not ok then 'ORIGIN' when text is null then null when poison then 'POISON' end as code, case when ok and text is not null and not poison then shown end as text from (
  select doc_id, text, doc_id % 5 in (0, 2) as ok, regexp_replace(text, '{_ZW}', '', 'g') as shown, false as poison from documents)""")
def ingest_documents(spark, folder):
    origin = F.element_at(F.array(*map(F.lit, ORIGINS)), (F.col("doc_id") % 5 + 1).cast("int"))
    d = table(spark, folder, "documents").select("doc_id", "text", origin.alias("origin"), F.sha2("text", 256).alias("digest"))
    d = d.withColumn("digest", F.coalesce("digest", F.sha2(F.lit(""), 256)))
    return pipelines.secure_ingest(d, "doc_id", "origin", "text", "digest", ("vault.example",))


@query("select doc_id, coalesce(source, '') || '|' || coalesce(lang, '') || '|' || sha256(coalesce(text, '')) || '|' || coalesce(cast(n_chars as varchar), '') || '|' as payload from documents")
def provenance_payloads(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", gates.provenance_payload(F.col("source"), F.col("lang"), F.sha2(F.coalesce("text", F.lit("")), 256), F.col("n_chars"), F.lit(None)).alias("payload"))


_ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""
select doc_id, code, case when code is null then {_ESCAPED} end as text from (select doc_id, text, case when text is null then 'FORMAT' when text = '' then 'LENGTH'
  when regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]') then 'CONTROL' when {any_of(_LOW, list(D.PAYLOADS))} then 'PAYLOAD' end as code from documents)""")
def output_validation(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.to_json(F.struct(F.lit("a title").alias("title"), F.col("text").alias("body"))).alias("raw"))
    return d.select("doc_id", pipelines.validated_output(F.col("raw")).alias("v")).select("doc_id", "v.code", "v.text")


OUTPUTS = ['{"text":" a\\u0007b\\nc ","tokens":[1,2],"logits":[0.5,1.5],"logprobs":[-1.0,-2.0]}', '{"text":"ok","tokens":[1],"logits":[0.5],"logprobs":[]}', '{"text":"ok","tokens":[],"logits":[],"logprobs":[],"x":1}', '{"text":" ","tokens":[],"logits":[],"logprobs":[]}', '{"text":"abcdefghij","tokens":[],"logits":[],"logprobs":[]}']


@query(f"""
select event_id, ([null, 'LOGITS', 'FORMAT', 'EMPTY', null])[(event_id % 5) + 1] as code, ([concat('ab', chr(10), 'c'), null, null, null, 'abcdefgh'])[(event_id % 5) + 1] as text,
  event_id % 5 = 4 as truncated from {IDS} i""")
def output_blinding(spark, folder):
    return ids(spark, folder).select("event_id", gates.model_output(case(OUTPUTS), 8).alias("o")).select("event_id", "o.code", "o.text", "o.truncated")


@query(f"""
select event_id, case when s is null then 'SCORE' end as code, case when s is not null then least(greatest(s, 0), 1) end as score,
  case when s is not null then regexp_replace(upper(trim({sql_case(['prompt leak ', 'role-swap'])})), '[^A-Z0-9]', '_', 'g') end as intent, coalesce(not s between 0 and 1, false) as escalate
from (select event_id, round(cast(cognitive_score as double) * 3 - 1, 6) as s from {EVENTS} e)""")
def assessments(spark, folder):
    e = audit_events(spark, folder, ["cognitive_score"])
    a = gates.assessment(F.round(F.col("cognitive_score").cast("double") * 3 - 1, 6), F.lit(" some reason "), case(["prompt leak ", "role-swap"]), F.lit(False))
    return e.select("event_id", a["code"].alias("code"), a["score"].alias("score"), a["intent"].alias("intent"), a["escalate"].alias("escalate"))


@query(f"""
select event_id, case when good then least(greatest(s, 0), 1) else 0 end as confidence, case when good then 0.5 else 1 end as risk, case when good then left(text, 40) else 'UNAVAILABLE' end as analysis, not good as fallback
from (select event_id, s, regexp_replace(regexp_replace(text, '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g'), '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{{9f}}]', '', 'g') as text,
    s is not null and coalesce(regexp_replace(text, '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g'), '') <> '' as good
  from (select event_id, cast(any_value(cognitive_score) as double) as s, any_value(input_prompt) as text from audit_events group by event_id))""")
def research_results(spark, folder):
    e = audit_events(spark, folder, ["cognitive_score", "input_prompt"])
    return e.select("event_id", gates.research_result(F.col("cognitive_score").cast("double"), F.lit(0.5).cast("double"), F.col("input_prompt"), 40).alias("r")).select("event_id", "r.*")


RESPONSES = ['{"candidates":[{"content":{"parts":[{"text":"```json\\n{\\"a\\":1}\\n```"}]}}]}', '{"candidates":[]}', '{"candidates":[{"content":{"parts":[{"text":"{\\"b\\":2}"}]}}]}']


@query(f"select event_id, (['{{\"a\":1}}', null, '{{\"b\":2}}'])[(event_id % 3) + 1] as json from {IDS} i")
def candidate_texts(spark, folder):
    return ids(spark, folder).select("event_id", gates.candidate_json(case(RESPONSES)).alias("json"))


@query(f"select event_id, case when risk_code is not null then '{{\"status\":\"blocked\",\"reason\":\"' || risk_code || '\"}}' else '{{\"status\":\"authorized\",\"response\":\"r' || cast(event_id as varchar) || '\"}}' end as body from {EVENTS} e")
def edge_responses(spark, folder):
    e = audit_events(spark, folder, ["risk_code"]).withColumn("r", F.concat(F.lit("r"), F.col("event_id").cast("string")))
    return pipelines.edge_response(e, "event_id", "risk_code", "r")


@query(f"select event_id, case when text is not null then c.response end as cached from {PROMPTS} p left join (select text as t, min(event_id) as response from {PROMPTS} q where text is not null group by text having count(*) > 1) c on c.t = p.text")
def cache_hits(spark, folder):
    p = prompts(spark, folder).select("event_id", "text")
    cache = p.where("text is not null").groupBy(F.sha2("text", 256).alias("prompt_hash")).agg(F.min("event_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return sinks.cache_get(p, "text", cache).select("event_id", "cached")


@query("select id, agent_id from nhi_tokens where org_id = 'org-002' and (expires_at is null or expires_at > timestamp '2025-02-01')")
def tenant_live_tokens(spark, folder):
    scoped = sinks.tenant_scope(table(spark, folder, "nhi_tokens"), "org_id", "org-002")
    return sinks.live(scoped, "expires_at", F.lit("2025-02-01").cast("timestamp")).select("id", "agent_id")


@query(f"select event_id, severity between 1 and 5 and risk_code is not null and logged_at is not null as kept, 'trace ' || coalesce(user_id, '') || ' ' || coalesce(intervention_type, '') as line from {EVENTS} e".replace("severity between", "coalesce(severity between").replace(" and risk_code", ", false) and risk_code"))
def audit_rows(spark, folder):
    e = audit_events(spark, folder, ["severity", "risk_code", "logged_at", "user_id", "intervention_type"])
    good, bad = sinks.rejected(e)
    line = F.concat(F.lit("trace "), F.coalesce("user_id", F.lit("")), F.lit(" "), F.coalesce("intervention_type", F.lit("")))
    return good.withColumn("kept", F.lit(True)).unionByName(bad.withColumn("kept", F.lit(False))).select("event_id", "kept", line.alias("line"))


@query("select id, sha256(coalesce(action, '') || '|' || strftime(received_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z') as entry_hash from (select id, any_value(action) as action, min(received_at) as received_at from audit_ledger group by id)")
def ledger_hashes(spark, folder):
    rows = audit_ledger(spark, folder, ["action", "received_at"])
    return sinks.ledger_entries(rows, "action", "received_at").select("id", "entry_hash")


# ---- tokens

_IN, _OUT = ("".join(f"\\x{x:02X}" for x in p) for p in crypto._pads(KEY))


def sql_hmac(message: str) -> str:
    """HMAC of a blob expression."""
    return f"sha256('{_OUT}'::blob || unhex(sha256('{_IN}'::blob || {message})))"


@query(f"""
select event_id, 'zt-' || substr(b, 1, 8) || '-' || substr(b, 9, 4) || '-' || substr(b, 13, 4) || '-' || substr(m, 1, 4) || '-' || substr(m, 5, 12) as token, case when event_id % 3 <> 0 then event_id end as session
from (select event_id, b, {sql_hmac('unhex(b)')} as m from (select event_id, lpad(lower(hex(event_id)), 8, '0') || substr(md5(cast(event_id as varchar)), 1, 8) as b from {IDS} i))""".replace("lower(hex(event_id))", "lower(to_hex(event_id))"))
def signed_canaries(spark, folder):
    t = ids(spark, folder).withColumn("token", gates.signed_canary("zt", F.col("event_id"), F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), KEY))
    # every third one is read with another key
    session = F.when(F.col("event_id") % 3 == 0, gates.canary_session(F.col("token"), b"another key")).otherwise(gates.canary_session(F.col("token"), KEY))
    return t.select("event_id", "token", session.alias("session"))


@query("""
with t as (select distinct id, agent_id, expires_at, revoked from nhi_tokens where agent_id is not null and expires_at is not null),
c as (select id, agent_id, revoked, n, case when n < 2 then epoch_ms(expires_at) - 1000 * (2 - n) when n = 2 then epoch_ms(expires_at) when n = 3 then epoch_ms(expires_at) - 1 else 0 end as at_ms, expires_at from t, range(0, 5) r(n))
select id || '-' || cast(n as varchar) as call_id, case when n = 3 then 'MAC' when n = 2 then 'EXPIRED' when revoked then 'NOT_FOUND' when n = 4 then 'AGENT' when n = 1 then 'USED' end as code from c""")
def vault_tokens(spark, folder):
    t = table(spark, folder, "nhi_tokens").where("agent_id is not null and expires_at is not null").select("id", "agent_id", "expires_at", "revoked").distinct()
    exp = F.unix_millis("expires_at")
    made = t.withColumn("secret_name", F.concat(F.lit("db/"), F.col("id"))).withColumn("exp", exp).withColumn("token", gates.vault_token(F.col("agent_id"), F.col("secret_name"), F.col("id"), F.col("exp"), KEY))
    records = made.where("not revoked").select("token", "secret_name", F.lit(True).alias("one_time"))
    # a first and a second use, one too late, a forged one, one by another agent
    calls = made.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(4))))
    at = F.when(F.col("n") < 2, F.col("exp") - 1000 * (2 - F.col("n"))).when(F.col("n") == 2, F.col("exp")).when(F.col("n") == 3, F.col("exp") - 1).otherwise(F.lit(0).cast("long"))
    forged = F.when(F.col("n") == 3, F.concat(F.expr("left(token, length(token) - 32)"), F.lit("0" * 32))).otherwise(F.col("token"))
    agent = F.when(F.col("n") == 4, F.lit("nobody")).otherwise(F.col("agent_id"))
    asked = calls.select(F.concat_ws("-", "id", F.col("n").cast("string")).alias("call_id"), agent.alias("agent"), forged.alias("token"), at.alias("at_ms"))
    return gates.resolve_tokens(asked, records, KEY).select("call_id", "code")


@query(f"select event_id, length(t) = 1 and contains(coalesce(session_id, ''), 'a') as dripped from (select event_id, session_id, {sql_case(['x', 'token', 'y', 'zz'])} as t from {EVENTS} e)")
def token_drip(spark, folder):
    e = audit_events(spark, folder, ["session_id"])
    single = (F.length(case(["x", "token", "y", "zz"])) == 1) & (D.char_byte_entropy(case(["x", "token", "y", "zz"])) < 1.0)
    return e.select("event_id", (single & F.coalesce(F.col("session_id").contains("a"), F.lit(False))).alias("dripped"))


# ---- state


@query("""
with recursive e as (select event_id, user_id, cast(round(value / 50, 2) * 1000000 as bigint) as c, row_number() over (partition by user_id order by ts, event_id) as n from events),
b as (select event_id, user_id, n, case when c <= 3000000 then c else 0 end as s, c <= 3000000 as allowed from e where n = 1
  union all select e.event_id, e.user_id, e.n, case when b.s + e.c <= 3000000 then b.s + e.c else b.s end, b.s + e.c <= 3000000 from b join e on e.user_id = b.user_id and e.n = b.n + 1)
select event_id, round(s / 1000000, 6) as consumed, allowed from b""")
def privacy_budget(spark, folder):
    e = table(spark, folder, "events").withColumn("eps", F.round(F.col("value") / 50, 2))
    return gates.privacy_budget(e, "user_id", "ts", "event_id", "eps", 3.0).select("event_id", F.round("consumed", 6).alias("consumed"), "allowed")


@query("""
select event_id, count(*) over w as total, len(list_distinct(list(event_type) over w)) as distinct, len(list_distinct(list(event_type) over w)) > 3 as tripped
from events window w as (partition by user_id order by epoch_us(ts) range between 21599999999 preceding and current row)""")
def rolling_exclusive(spark, folder):
    out = folds.rolling_distinct(table(spark, folder, "events"), "user_id", "ts", "event_id", F.col("event_type"), 6 * 3600, exclusive=True)
    return out.select("event_id", "total", "distinct", (F.col("distinct") > 3).alias("tripped"))


@query(f"select event_id, round(abs(0.5 - cast(cognitive_score as double)), 6) as drift, abs(0.5 - cast(cognitive_score as double)) > 0.3 as drifted, cast(cognitive_score as double) < 0.85 as unstable from {EVENTS} e where cognitive_score is not null")
def logic_drift(spark, folder):
    s = F.col("cognitive_score").cast("double")
    e = audit_events(spark, folder, ["cognitive_score"]).where("cognitive_score is not null")
    return e.select("event_id", F.round(F.abs(0.5 - s), 6).alias("drift"), (F.abs(0.5 - s) > 0.3).alias("drifted"), (s < 0.85).alias("unstable"))


@query("""
with per as (select epoch_us(ts) // 60000000 as m, count(*) as c from events group by 1),
seen as (select m + i as minute, sum(c) as n from per, range(0, 10) t(i) group by 1),
high as (select minute, n, n / 600.0 as rate, n / 600.0 > 0.008 as hi from seen)
select h.minute, cast(h.n as bigint) as n, round(h.rate, 9) as rate, (select count(*) from high x where x.hi and x.minute between h.minute - 2 and h.minute) = 3 as firing from high h""")
def alert_rates(spark, folder):
    out = gates.alert_runs(table(spark, folder, "events"), "ts", 10, 0.008, 2)
    return out.select("minute", "n", F.round("rate", 9).alias("rate"), "firing")


@query(f"""
select rule_id, triggers, round(case when triggers > 0 then hits / triggers end, 9) as precision, case when triggers >= 5 and hits / triggers < 0.8 then 'REVIEW' when triggers >= 10 and hits / triggers > 0.95 then 'ACTIVE' else 'STAGING' end as next_state
from (select rule_id, count(*) as triggers, count(case when severity >= 2 then 1 end) as hits from {EVENTS} e where rule_id is not null group by rule_id)""")
def rule_lifecycle(spark, folder):
    r = audit_events(spark, folder, ["rule_id", "severity"]).where("rule_id is not null").groupBy("rule_id").agg(F.count(F.lit(1)).alias("triggers"), F.count_if(F.coalesce(F.col("severity") >= 2, F.lit(False))).alias("hits"))
    s = gates.rule_state(F.lit("STAGING"), F.col("triggers"), F.col("hits"), F.col("triggers") - F.col("hits"))
    return r.select("rule_id", "triggers", F.round(s["precision"], 9).alias("precision"), s["next_state"].alias("next_state"))


_TOOLS = "case event_type when 'view' then 'read_file' when 'click' then 'search' when 'purchase' then 'email' when 'signup' then 'curl' else 'other' end"


@query(f"""
select agent, score, score > 0.85 as frozen from (select user_id || '/' || strftime(ts, '%Y-%m-%d') as agent, case when bool_or(t = 'read_file') and (bool_or(t = 'email') or bool_or(t = 'curl')) then 0.95 when bool_or(t = 'search') and bool_or(t = 'curl') then 0.6 else 0.1 end::double as score
  from (select *, {_TOOLS} as t from events) group by 1)""")
def tool_synergy_scores(spark, folder):
    tool = F.when(F.col("event_type") == "view", "read_file").when(F.col("event_type") == "click", "search").when(F.col("event_type") == "purchase", "email").when(F.col("event_type") == "signup", "curl").otherwise("other")
    agent = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd"))
    return gates.synergy(table(spark, folder, "events").select(agent.alias("agent"), tool.alias("tool")))


@query("""
select event_id, n, n > 5 as airlock from (select event_id, count(*) over (order by epoch_us(ts) range between 3600000000 - 1 preceding and current row) as n from events where event_type = 'error')""")
def airlock_triggers(spark, folder):
    e = table(spark, folder, "events").where("event_type = 'error'").withColumn("all", F.lit(1))
    out = folds.rolling_distinct(e, "all", "ts", "event_id", F.lit(1), 3600, exclusive=True)
    return out.select("event_id", F.col("total").alias("n"), (F.col("total") > 5).alias("airlock"))


@query(f"select coalesce(agent_id, 'none') as org, upper(risk_code) as vector, count(*) as mitigations, round(sum(cast(cognitive_score as double)), 6) as latency_sum, count(case when cognitive_score <= 0.25 then 1 end) as le_25, count(case when cognitive_score <= 0.5 then 1 end) as le_50 from {EVENTS} e where risk_code is not null group by 1, 2")
def telemetry(spark, folder):
    e = audit_events(spark, folder, ["agent_id", "risk_code", "cognitive_score"]).where("risk_code is not null")
    s = F.col("cognitive_score")
    return e.groupBy(F.coalesce("agent_id", F.lit("none")).alias("org"), F.upper("risk_code").alias("vector")).agg(F.count(F.lit(1)).alias("mitigations"), F.round(F.sum(s.cast("double")), 6).alias("latency_sum"), F.count_if(s <= 0.25).alias("le_25"), F.count_if(s <= 0.5).alias("le_50"))


# ---- graph


@query(f"""
select label, count(*) as vertices, count(case when compromised then 1 end) as compromised, min(first_seen) as first_seen from (
  select id, label, min(logged_at) as first_seen, bool_or(w) as compromised from (
    select user_id as id, 'User' as label, logged_at, false as w from {EVENTS} a union all select session_id, 'Session', logged_at, false from {EVENTS} b
    union all select agent_id, 'Agent', logged_at, coalesce(risk_code = 'EMG27', false) from {EVENTS} c) where id is not null group by 1, 2) group by label""")
def graph_vertices(spark, folder):
    e = audit_events(spark, folder, ["user_id", "session_id", "agent_id", "risk_code", "logged_at"])
    v, _ = gates.log_graph(e)
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("vertices"), F.count_if("compromised").alias("compromised"), F.min("first_seen").cast("timestamp_ntz").alias("first_seen"))


@query(f"""
select user_id as src, session_id as dst, 'INITIATED' as rel, count(*) as n from {EVENTS} a where user_id is not null and session_id is not null group by 1, 2
union all select session_id, agent_id, 'CALLED_AGENT', count(*) from {EVENTS} b where session_id is not null and agent_id is not null group by 1, 2
union all select agent_id, risk_code, 'EXHIBITED_BEHAVIOR', count(*) from {EVENTS} c where agent_id is not null and risk_code = 'EMG27' group by 1, 2""")
def graph_edges(spark, folder):
    return gates.log_graph(audit_events(spark, folder, ["user_id", "session_id", "agent_id", "risk_code", "logged_at"]))[1]


@query(f"select distinct user_id, session_id, agent_id from {EVENTS} e where user_id is not null and session_id is not null and agent_id is not null and cognitive_score > 0.8")
def cognitive_paths(spark, folder):
    e = audit_events(spark, folder, ["user_id", "session_id", "agent_id", "cognitive_score"])
    return e.where("cognitive_score > 0.8 and user_id is not null and session_id is not null and agent_id is not null").select("user_id", "session_id", "agent_id").distinct()


@query(f"select agent_id as agent, rule_id as skill, count(*) as uses, max(logged_at) as last_used from {EVENTS} e where agent_id is not null and rule_id is not null group by 1, 2")
def skill_usage(spark, folder):
    e = audit_events(spark, folder, ["agent_id", "rule_id", "logged_at"]).where("agent_id is not null and rule_id is not null")
    return e.groupBy(F.col("agent_id").alias("agent"), F.col("rule_id").alias("skill")).agg(F.count(F.lit(1)).alias("uses"), F.max("logged_at").cast("timestamp_ntz").alias("last_used"))


@query("""
select label, vec_id, golden, round(similarity, 6) as similarity from (select a.label, a.vec_id, g.vec_id as golden, list_cosine_similarity(a.embedding::double[], g.embedding::double[]) as similarity
  from embeddings a join (select label, min(vec_id) as vec_id, arg_min(embedding, vec_id) as embedding from embeddings group by label) g using (label)) where similarity < 0.75""")
def golden_drift(spark, folder):
    e = table(spark, folder, "embeddings").select("label", "vec_id", "embedding")
    golden = e.groupBy("label").agg(F.min("vec_id").alias("golden"), F.min_by("embedding", "vec_id").alias("embedding"))
    return gates.drift(e, golden, "label", "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))


_TIES = f"(select distinct user_id as src, agent_id as dst from {EVENTS} a where user_id is not null and agent_id is not null union select agent_id, user_id from {EVENTS} b where user_id is not null and agent_id is not null)"


@query(f"""
with recursive risky as (select user_id as id from {EVENTS} a where user_id is not null group by 1 having max(cognitive_score) > 0.5 union select agent_id from {EVENTS} b where agent_id is not null group by 1 having max(cognitive_score) > 0.5),
t as (select src, dst from {_TIES} x where src in (select id from risky) and dst in (select id from risky)),
r as (select id as seed, id, 0 as hops from risky where left(id, 1) in ('0', '1') union select r.seed, t.dst, r.hops + 1 from r join t on t.src = r.id where r.hops < 3)
select seed, id, min(hops) as hops from r where id <> seed group by 1, 2""")
def infection_chain(spark, folder):
    e = audit_events(spark, folder, ["user_id", "agent_id", "cognitive_score"])
    ends = e.select(F.explode(F.array("user_id", "agent_id")).alias("id"), "cognitive_score").where("id is not null")
    risky = ends.groupBy("id").agg(F.max("cognitive_score").alias("m")).where("m > 0.5").select("id")
    ties = e.where("user_id is not null and agent_id is not null").select(F.col("user_id").alias("src"), F.col("agent_id").alias("dst"))
    ties = ties.unionByName(ties.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seeds = risky.where(F.left("id", F.lit(1)).isin("0", "1"))
    return graph.reach(ties, seeds, 3, risky).where("seed <> id")


# ---- routing and small functions

_ROUTE = f"case when {any_of('lower(text)', ['hello', 'hey', 'weather'])} then 'A' when {any_of('lower(text)', ['legal', 'contract', 'finance', 'research'])} then 'B' when {any_of('lower(text)', ['code', 'deploy', 'agent'])} then 'C' else 'B' end"
_BLOCK = f"({any_of('text', D.CANARIES)} or regexp_matches(text, '(?i)base64') or regexp_matches(text, '(?i)eval\\('))"


@query(f"select event_id, case when text is null then null when {_BLOCK} or contains(lower(text), 'poison') then 'BLOCK' else {_ROUTE} end as outcome, replace(text, 'SECRET', '******') as stream from {PROMPTS} p")
def mesh_outcomes(spark, folder):
    return prompts(spark, folder).select("event_id", pipelines.mesh(F.col("text")).alias("m")).select("event_id", "m.outcome", "m.stream")


@query(f"select event_id, cast(count(*) as bigint) as findings, list_sort(list(distinct kind)) as kinds from (select event_id, 'INPUT_TOO_LARGE' as kind from {PROMPTS} p where strlen(text) > 400 union all select event_id, 'JAILBREAK_ATTEMPT' from {PROMPTS} q where strlen(text) <= 400 and contains(lower(text), 'ignore previous instructions')) group by 1".replace("list_sort(list(distinct kind))", "array_to_string(list_sort(list(distinct kind)), ',')"))
def anomaly_facade(spark, folder):
    found = pipelines.anomalies(prompts(spark, folder), "event_id", "text", spark.createDataFrame([("zzzzzzzz.example",)], "domain string"), 400)
    return found.groupBy("event_id").agg(F.count(F.lit(1)).alias("findings"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query("""
with f as (select distinct lower(entry) as name from name_lexicon)
select a.name, b.name as target, case when regexp_matches(a.name || b.name, '^[ -~]*$') then round(jaro_winkler_similarity(a.name, b.name), 6) end as jw, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) as similarity
from f a join f b on levenshtein(a.name, b.name) between 1 and 2 and levenshtein(a.name, b.name) / length(a.name) <= 0.34 and length(a.name) >= 5""")
def name_similarities(spark, folder):
    f = table(spark, folder, "name_lexicon").select(F.lower("entry").alias("name")).distinct()
    near = lookups.near_names(f, "name", f.select(F.col("name").alias("target")), "target")
    # the SQL compares bytes, so only ASCII names are put side by side
    jw = F.when(F.concat("name", "target").rlike("^[ -~]*$"), F.round(arrow.jaro_winkler(F.col("name"), F.col("target")), 6))
    return near.select("name", "target", jw.alias("jw"), F.round(T.string_similarity(F.col("name"), F.col("target")), 6).alias("similarity"))


@query("select id, regexp_extract(lower(email), '@(.*)$', 1) as host, 'https://' || email as url, regexp_matches(email, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') as control from (select distinct id, email from users where email is not null)")
def url_hosts(spark, folder):
    u = table(spark, folder, "users").where("email is not null").select("id", "email").distinct()
    url = F.concat(F.lit("https://"), F.col("email"))
    return u.select("id", T.url_host(url).alias("host"), url.alias("url"), F.col("email").rlike(T.CONTROL).alias("control"))


@query()
def idna_hosts(spark, folder):
    """Hosts of the users' mail with their Unicode and ASCII forms; tested against the codec."""
    u = table(spark, folder, "users").where("email is not null").select(F.element_at(F.split(F.lower("email"), "@"), 2).alias("host")).distinct()
    return u.select("host", arrow.idna(F.concat(F.lit("ü"), F.col("host"))).alias("ascii"))


@query(f"select event_id, heat from (select event_id, cast({first_of('text', {'system': '1'})} as int) as h, length(text) as heat from {PROMPTS} p where text is not null) order by heat desc, event_id limit 5")
def longest_prompts(spark, folder):
    return prompts(spark, folder).where("text is not null").select("event_id", F.length("text").alias("heat")).orderBy(F.desc("heat"), "event_id").limit(5)


@query("select distinct agent_id from nhi_tokens except select distinct agent_id from audit_events where risk_code = 'V30'")
def unseen_agents(spark, folder):
    known = table(spark, folder, "nhi_tokens").select("agent_id").distinct()
    return known.exceptAll(table(spark, folder, "audit_events").where("risk_code = 'V30'").select("agent_id").distinct())
