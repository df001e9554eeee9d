"""Queries of the stateful, lookup, aggregate, graph and vector operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.operators import detectors as D
from wardloom.operators import folds, graph, lookups, noise, rewrite, vectors
from wardloom.plans import pipelines
from wardloom.plans.text_queries import _HEAT, PROMPTS, any_of, prompts
from wardloom.sources import sinks
from wardloom.sources.tables import audit_events, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


# ---- state over events (an error is 3 points, a purchase 1)


def _points(df: DataFrame) -> DataFrame:
    return df.withColumn("points", F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 1).otherwise(0).cast("long")).withColumn("cents", F.round(F.col("value") * 100).cast("long"))


@query("""
with recursive e as (
  select event_id, user_id, epoch_us(ts) as us, case event_type when 'error' then 3 when 'purchase' then 1 else 0 end as add,
    row_number() over (partition by user_id order by ts, event_id) as n from events),
h as (
  select event_id, user_id, us, n, cast(greatest(case when add > 0 then add else -1 end, 0) as bigint) as heat from e where n = 1
  union all
  select e.event_id, e.user_id, e.us, e.n,
    cast(case when e.add > 0 then (case when e.us - h.us > 21600000000 then 0 else h.heat end * 9) // 10 + e.add
      else greatest((case when e.us - h.us > 21600000000 then 0 else h.heat end * 9) // 10 - 1, 0) end as bigint)
  from h join e on e.user_id = h.user_id and e.n = h.n + 1)
select user_id, event_id, heat, heat >= 4 as tripped from h""")
def heat_fold(spark, folder):
    return folds.heat(_points(events(spark, folder)), "user_id", "ts", "event_id", "points", 6 * 3600, 4)


@query("""
with recursive e as (select event_id, user_id, epoch_us(ts) as us, value, row_number() over (partition by user_id order by ts, event_id) as n from events),
v as (select event_id, user_id, n, us as began, value as s, false as tripped from e where n = 1
  union all select e.event_id, e.user_id, e.n, case when e.us - v.began >= 21600000000 then e.us else v.began end, case when e.us - v.began >= 21600000000 then e.value else v.s + e.value end,
    e.us - v.began < 21600000000 and v.s + e.value > 100 from v join e on e.user_id = v.user_id and e.n = v.n + 1)
select event_id, user_id, round(s, 4) as window_sum, tripped from v""")
def velocity_fold(spark, folder):
    return folds.velocity(events(spark, folder), "user_id", "ts", "event_id", "value", 100.0, 6 * 3600).withColumn("window_sum", F.round("window_sum", 4))


@query("""
with recursive e as (
  select event_id, user_id, cast(ts as date) as d, cast(round(value * 100) as bigint) as cost,
    row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) as n from events),
b as (
  select event_id, user_id, d, n, case when cost <= 10000 then cost else 0 end as spent, cost <= 10000 as allowed from e where n = 1
  union all
  select e.event_id, e.user_id, e.d, e.n, case when b.spent + e.cost <= 10000 then b.spent + e.cost else b.spent end, b.spent + e.cost <= 10000
  from b join e on e.user_id = b.user_id and e.d = b.d and e.n = b.n + 1)
select user_id, event_id, cast(spent as bigint) as spent, allowed from b""")
def budget_fold(spark, folder):
    return folds.daily_budget(_points(events(spark, folder)), "user_id", "ts", "event_id", "cents", 10_000)


@query("""
with recursive e as (select event_id, user_id, epoch_us(ts) // 3600 as us, row_number() over (partition by user_id order by epoch_us(ts) // 3600, event_id) as n from events),
b as (select event_id, user_id, n, us as last, 2::bigint as tokens, 2::bigint as left_, true as allowed from e where n = 1
  union all select e.event_id, e.user_id, e.n, case when (e.us - b.last) // 1000000 > 0 then e.us else b.last end,
    case when (e.us - b.last) // 1000000 > 0 then least(3, b.tokens + (e.us - b.last) // 1000000) else b.tokens end - case when (case when (e.us - b.last) // 1000000 > 0 then least(3, b.tokens + (e.us - b.last) // 1000000) else b.tokens end) > 0 then 1 else 0 end,
    0, (case when (e.us - b.last) // 1000000 > 0 then least(3, b.tokens + (e.us - b.last) // 1000000) else b.tokens end) > 0
  from b join e on e.user_id = b.user_id and e.n = b.n + 1)
select event_id, user_id, tokens as "left", allowed from b""")
def bucket_fold(spark, folder):
    slow = events(spark, folder).withColumn("ts", F.timestamp_micros((F.unix_micros("ts") / 3600).cast("long")))
    return folds.token_bucket(slow, "user_id", "ts", "event_id", 3, 1)


@query("select event_id, user_id, cast(sum(cast(round(value * 100) as bigint)) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as running from events")
def quota_running(spark, folder):
    return folds.running_total(_points(events(spark, folder)), "user_id", "ts", "event_id", "cents").select("event_id", "user_id", "running")


@query("""
select event_id, user_id, count(*) over w as total, len(list_distinct(list(event_type) over w)) as distinct
from events window w as (partition by user_id order by ts range between interval 1 hour preceding and current row)""")
def rolling_distinct_1h(spark, folder):
    return folds.rolling_distinct(events(spark, folder), "user_id", "ts", "event_id", F.col("event_type")).select("event_id", "user_id", "total", "distinct")


@query(f"""
select event_id, count(*) over w as total,
  len(list_distinct(list(regexp_replace(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), '0x[0-9a-f]{{4,}}|[0-9a-f]{{16,}}|[0-9]+', '#', 'g')) over w)) as distinct
from {PROMPTS} p where text is not null and user_id is not null and logged_at is not null
window w as (partition by user_id order by logged_at range between interval 1 day preceding and current row)""")
def extraction_window(spark, folder):
    rows = prompts(spark, folder).where("text is not null")
    shape = F.regexp_replace(rewrite.query_form(F.col("text")), "0x[0-9a-f]{4,}|[0-9a-f]{16,}|[0-9]+", "#")
    return folds.rolling_distinct(rows, "user_id", "logged_at", "event_id", shape, 86_400).select("event_id", "total", "distinct")


@query()
def exposure_running(spark, folder):
    rows = prompts(spark, folder).where("text is not null")
    return folds.exposure(rows, "session_id", "event_id", "text", 8, 2.5, 2.8, 3.0, 5, 2000)


@query("select id, agent_id, case when revoked or expires_at < timestamp '2025-03-01' then true else revoked end as revoked, case when not revoked and expires_at < timestamp '2025-03-01' then 'expired' else revocation_reason end as revocation_reason from nhi_tokens")
def lifecycle_sweep(spark, folder):
    t = table(spark, folder, "nhi_tokens")
    old = ~F.col("revoked") & (F.col("expires_at") < F.lit("2025-03-01").cast("timestamp"))
    return t.select("id", "agent_id", F.when(old, True).otherwise(F.col("revoked")).alias("revoked"), F.when(old, "expired").otherwise(F.col("revocation_reason")).alias("revocation_reason"))


@query("""
select window_start, event_type, count(*) as n from (
  select event_type, unnest([time_bucket(interval 10 minute, ts) - i * interval 10 minute for i in range(0, 6)]) as window_start, ts from events)
group by 1, 2 having count(*) > 3""")
def alert_windows(spark, folder):
    w = F.window("ts", "1 hour", "10 minutes")
    counts = events(spark, folder).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).where("n > 3")
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("select event_type, cast(floor(quantile_disc(value, 0.99)) as bigint) as p99, count(*) as n from events group by event_type")
def latency_p99(spark, folder):
    return events(spark, folder).groupBy("event_type").agg(F.floor(F.expr("percentile_approx(value, 0.99, 1000000)")).alias("p99"), F.count(F.lit(1)).alias("n"))


# ---- lookups


_EVENTS = "(select event_id, any_value(logged_at) as logged_at, any_value(risk_code) as risk_code, any_value(severity) as severity, any_value(user_id) as user_id, any_value(agent_id) as agent_id, any_value(session_id) as session_id, any_value(client_ip) as client_ip, any_value(cognitive_score) as cognitive_score from audit_events group by event_id)"


@query(f"select event_id, case when v.vector_id is null then 'UNKNOWN' when v.response_action is null then 'UNKNOWN' when e.act is distinct from v.response_action then 'MISMATCH' end as registry_code from (select *, case when severity >= 3 then 'block' else 'redact' end as act from {_EVENTS} z) e left join security_vectors v on upper(e.risk_code) = v.vector_id")
def registry_codes(spark, folder):
    e = audit_events(spark, folder, ["risk_code", "severity"]).withColumn("risk_code", F.upper("risk_code"))
    e = e.withColumn("act", F.when(F.col("severity") >= 3, "block").otherwise("redact"))
    v = table(spark, folder, "security_vectors").select(F.col("vector_id").alias("risk_code"), F.col("response_action").alias("pinned"))
    return lookups.registry_check(e, "risk_code", "act", v).select("event_id", "registry_code")


@query(f"select event_id, agent_id from {_EVENTS} e where agent_id is not null and agent_id not in (select agent_id from nhi_tokens where revoked and agent_id is not null)")
def unrevoked_agents(spark, folder):
    e = audit_events(spark, folder, ["agent_id"]).where("agent_id is not null")
    revoked = table(spark, folder, "nhi_tokens").where("revoked")
    return lookups.members(e, "agent_id", revoked, present=False).select("event_id", "agent_id")


@query(f"""
select e.event_id, f.client_ip as pinned, coalesce(e.client_ip <> f.client_ip, false) as collision
from {_EVENTS} e left join (
  select session_id, client_ip from (select session_id, client_ip, row_number() over (partition by session_id order by logged_at nulls first, event_id, client_ip) as n from {_EVENTS} x where client_ip is not null and session_id is not null) where n = 1) f
using (session_id)""")
def session_pinning(spark, folder):
    e = audit_events(spark, folder, ["session_id", "logged_at", "client_ip"])
    return lookups.pinned_sessions(e, "session_id", "logged_at", "event_id", "client_ip").select("event_id", "pinned", "collision")


@query(f"select event_id, lag(event_id) over (partition by agent_id order by logged_at, event_id) as previous_id from {_EVENTS} e where agent_id is not null and logged_at is not null")
def next_in_sequence(spark, folder):
    e = audit_events(spark, folder, ["agent_id", "logged_at"]).where("agent_id is not null and logged_at is not null")
    return lookups.previous(e, "agent_id", "logged_at", "event_id").select("event_id", "previous_id")


_BLOCKED = ["example", "zepulon.test", "tarvex.example"]


@query("""
with h as (select distinct id, split_part(lower(email), '@', 2) as host from users where email is not null),
s as (select distinct host, array_to_string(list_slice(string_split(host, '.'), i, 99), '.') as domain from h, range(1, 9) t(i) where i <= len(string_split(host, '.')))
select h.id, h.host, m.matched from h left join (
  select host, arg_max(domain, length(domain)) as matched from s where domain in ('example', 'zepulon.test', 'tarvex.example') group by host) m using (host)""")
def host_block(spark, folder):
    u = table(spark, folder, "users").where("email is not null").select("id", F.element_at(F.split(F.lower("email"), "@"), 2).alias("host")).distinct()
    blocked = spark.createDataFrame([(d,) for d in _BLOCKED], "domain string")
    return lookups.blocked_hosts(u, "host", blocked).select("id", "host", "matched")


@query("""
with f as (select distinct lower(entry) as name from name_lexicon)
select a.name, b.name as target, levenshtein(a.name, b.name) as distance from f a join f b
on levenshtein(a.name, b.name) between 1 and 2 and levenshtein(a.name, b.name) / length(a.name) <= 0.34 and length(a.name) >= 5""")
def near_name_pairs(spark, folder):
    f = table(spark, folder, "name_lexicon").select(F.lower("entry").alias("name")).distinct()
    return lookups.near_names(f, "name", f.select(F.col("name").alias("target")), "target").withColumn("distance", F.col("distance").cast("long"))


_IMITATED = ["inbax.example", "example.orb", "bryn-hold.example"]


@query(f"""
with d as (select distinct event_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}-]+(?:\\.[\\p{{L}}\\p{{N}}-]+)+')) as domain from {PROMPTS} x where text is not null),
n as (select distinct domain, array_to_string(list_slice(string_split(domain, '.'), -2, -1), '.') as base from d),
p as (select unnest({_IMITATED}) as target)
select event_id, domain, base, 'TYPOSQUAT' as kind, target, levenshtein(base, target) as distance from d join n using (domain) join p on levenshtein(base, target) between 1 and 2
where length(base) >= 5 and levenshtein(base, target) / length(base) <= 0.34 and domain not in (select target from p) and not exists (select 1 from p q where ends_with(domain, '.' || q.target))
union all
select event_id, domain, base, 'MIXED_SCRIPT', null, null from d join n using (domain) where length(base) >= 5 and domain not in (select target from p) and not exists (select 1 from p q where ends_with(domain, '.' || q.target))
  and len(list_filter(string_split(domain, '.'), lambda l: cast(regexp_matches(l, '\\p{{Latin}}') as int) + cast(regexp_matches(l, '\\p{{Cyrillic}}') as int) + cast(regexp_matches(l, '\\p{{Greek}}') as int) + cast(regexp_matches(l, '[\\p{{Arabic}}\\p{{Hebrew}}\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}]') as int) > 1)) > 0""")
def domain_typos(spark, folder):
    protected = spark.createDataFrame([(d,) for d in _IMITATED], "domain string")
    found = lookups.domain_findings(prompts(spark, folder).select("event_id", "text"), "event_id", "text", protected)
    return found.withColumn("distance", F.col("distance").cast("long"))


#: A text that names its event's canary, by the event's id; every seventh has one that nobody planted.
_NAMED = "case when event_id % 7 = 0 then 'zz-' else 'zt-' end || user_id"


@query(f"""
select event_id, token, cast(2 as int) as hits from (select event_id, {_NAMED} as token from {PROMPTS} p where user_id is not null and text is not null) where token in (select 'zt-' || id from users)""")
def canary_scan(spark, folder):
    canaries = table(spark, folder, "users").select(F.concat(F.lit("zt-"), "id").alias("token")).distinct()
    named = F.concat(F.when(F.col("event_id") % 7 == 0, "zz-").otherwise("zt-"), F.col("user_id"))
    texts = prompts(spark, folder).where("user_id is not null").select("event_id", F.concat("text", F.lit(" "), named, F.lit(" / "), named).alias("text"))
    return lookups.canary_hits(texts, "event_id", "text", canaries).select("event_id", "token", "hits")


@query(f"select count(*) as total, count(case when not coalesce(strlen(text) > 300, false) then 1 end) as passed, count(case when strlen(text) > 300 then 1 end) as failed, 'TOO_LONG:' || cast(count(case when strlen(text) > 300 then 1 end) as varchar) as by_code from {PROMPTS} p")
def batch_result(spark, folder):
    v = prompts(spark, folder).select(D.too_long(F.col("text"), 300).alias("v")).select("v.*")
    return graph.batch_result(v).select("total", "passed", "failed", F.array_join(F.array_sort(F.transform(F.map_entries("by_code"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))), ",").alias("by_code"))


@query(f"select event_id, n as turn, case when n % 3 = 0 then 'GOAL: ' || risk_domain end as anchor from (select event_id, risk_domain, row_number() over (partition by session_id order by logged_at nulls first, event_id) as n from (select event_id, any_value(risk_domain) as risk_domain, any_value(session_id) as session_id, any_value(logged_at) as logged_at from audit_events group by event_id) where session_id is not null)")
def session_anchors(spark, folder):
    e = audit_events(spark, folder, ["session_id", "logged_at", "risk_domain"]).where("session_id is not null")
    return graph.anchored(e, "session_id", ["logged_at", "event_id"], "risk_domain").select("event_id", "turn", "anchor")


def _verified(spark):
    return spark.createDataFrame([(p,) for p in ("requests", "numpy", "express", "serde")], "package string")


#: What an event's text asks to install, by the event's id.
_INSTALLS = ["pip install requests==2.1", "npm i expres", "cargo add --features x serde", "pip install git+https://a.example/b", "yarn add left-pad && ls", "python3 -m pip install -r r.txt nunpy", "no package"]


@query(f"""
select event_id, x.tool, x.raw, x.name, x.finding, x.similar_to from (select event_id, ([null, {{'tool': 'npm', 'raw': 'expres', 'name': 'expres', 'finding': 'TYPOSQUAT', 'similar_to': 'express'}}, null,
  {{'tool': 'pip', 'raw': 'git+https://a.example/b', 'name': 'git+https://a.example/b', 'finding': 'SUSPICIOUS', 'similar_to': null}}, {{'tool': 'yarn', 'raw': 'left-pad', 'name': 'left-pad', 'finding': 'UNVERIFIED', 'similar_to': null}},
  {{'tool': 'pip', 'raw': 'nunpy', 'name': 'nunpy', 'finding': 'UNVERIFIED', 'similar_to': null}}, null])[event_id % 7 + 1] as x from {PROMPTS} p where text is not null) where x is not null""")
def package_scan(spark, folder):
    asks = F.element_at(F.array(*map(F.lit, _INSTALLS)), (F.col("event_id") % 7 + 1).cast("int"))
    texts = prompts(spark, folder).select("event_id", F.concat("text", F.lit(" "), asks).alias("text"))
    return lookups.package_findings(texts, "event_id", "text", _verified(spark))


@query("""
with g as (
  select doc_id, doc_type, trim(regexp_replace(translate(regexp_replace(text, '[​‌‍⁠﻿]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) as form from documents where text is not null),
f as (select doc_id as fragment, unnest(list_distinct([substr(form, i, 10) for i in range(1, length(form) - 8)])) as gram from g where doc_type = 'policy' and length(form) >= 10),
z as (select fragment, count(*) as windows from f group by fragment),
o as (select doc_id, gram, count(*) as times from (select doc_id, unnest([substr(form, i, 10) for i in range(1, length(form) - 8)]) as gram from g where doc_type = 'response' and length(form) >= 10) group by 1, 2),
h as (select doc_id, fragment, cast(sum(times) as bigint) as hits from o join f using (gram) group by 1, 2),
r as (select doc_id, fragment, hits, hits / windows as coverage from h join z using (fragment) where hits >= 8 and hits / windows >= 0.2)
select doc_id, fragment, hits, round(coverage, 9) as coverage from (select *, row_number() over (partition by doc_id order by coverage desc, hits desc, fragment desc) as n from r) where n = 1""")
def leak_coverage(spark, folder):
    d = table(spark, folder, "documents")
    fragments = d.where("doc_type = 'policy'").select(F.col("doc_id").alias("fragment"), "text")
    out = lookups.leak_coverage(d.where("doc_type = 'response'"), "doc_id", "text", fragments, n=10)
    return out.withColumn("coverage", F.round("coverage", 9))


@query("""
with c as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '\\bPMID:\\s*\\d{6,8}|DOI:\\s*10\\.\\d{4,}/\\S+\\b'))) as citation from documents where text is not null),
k as (select distinct citation from c join documents using (doc_id) where doc_type = 'policy'),
n as (select doc_id, count(*) as citations, count(k.citation) as verified from c left join k using (citation) where strlen(c.citation) >= 5 group by doc_id)
select doc_id, coalesce(citations, 0) as citations, coalesce(verified, 0) as verified, case when coalesce(citations, 0) = 0 then 0.0 else 1 - verified / citations end as missing_rate,
  case when coalesce(citations, 0) = 0 then false else 1 - verified / citations > 0.1 end as high_risk, case when coalesce(citations, 0) = 0 then false else 1 - verified / citations > 0.5 end as rejected
from documents left join n using (doc_id) where text is not null""")
def citation_metrics(spark, folder):
    d = table(spark, folder, "documents").where("text is not null")
    checked = lookups.citations(d, "doc_id", "text", d.where("doc_type = 'policy'"), "medical")
    return lookups.verification_metrics(checked, "doc_id", d)


# ---- aggregates


@query("select coalesce(upper(vector_id), 'ALL') as vector, coalesce(action, 'ALL') as action, count(*) as n from (select id, any_value(vector_id) as vector_id, any_value(action) as action from audit_ledger group by id) where vector_id is not null group by cube(upper(vector_id), action)")
def threat_heatmap_cube(spark, folder):
    from wardloom.sources.tables import audit_ledger

    rows = audit_ledger(spark, folder, ["vector_id", "action"]).where("vector_id is not null").withColumn("vector", F.upper("vector_id"))
    cubed = rows.cube("vector", "action").agg(F.count(F.lit(1)).alias("n"))
    return cubed.select(F.coalesce("vector", F.lit("ALL")).alias("vector"), F.coalesce("action", F.lit("ALL")).alias("action"), "n")


@query(f"select session_id, round(sum(cast(cognitive_score as double)), 6) as risk, count(*) as turns, sum(cognitive_score) > 1 as tripped from {_EVENTS} e where session_id is not null and cognitive_score is not null group by session_id")
def session_risk(spark, folder):
    e = audit_events(spark, folder, ["session_id", "cognitive_score"]).where("session_id is not null and cognitive_score is not null")
    return e.groupBy("session_id").agg(F.round(F.sum("cognitive_score").cast("double"), 6).alias("risk"), F.count(F.lit(1)).alias("turns"), (F.sum("cognitive_score") > 1).alias("tripped"))


@query(f"""
with c as (select session_id, unnest(string_split(text, '')) as ch from {PROMPTS} p where session_id is not null and text <> ''),
n as (select session_id, ch, count(*) as k from c where ch <> '' group by 1, 2)
select session_id, cast(sum(k) as bigint) as chars, round(entropy, 6) as entropy from (select session_id, k, sum(k) over (partition by session_id) as t from n) join (select session_id, -sum(p * log2(p)) as entropy from (select session_id, k / sum(k) over (partition by session_id) as p from n) group by session_id) using (session_id) group by session_id, entropy""")
def session_entropy(spark, folder):
    rows = prompts(spark, folder).where("session_id is not null and text <> ''")
    letters = rows.select("session_id", F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("session_id", "c").agg(F.count(F.lit(1)).alias("k"))
    # entropy from sums that combine on the map side: log2(n) - sum(k log2 k) / n
    sums = letters.groupBy("session_id").agg(F.sum("k").alias("chars"), F.sum(F.col("k") * F.log2("k")).alias("s"))
    return sums.select("session_id", "chars", F.round(F.log2("chars") - F.col("s") / F.col("chars"), 6).alias("entropy"))


@query(f"""
select risk_code, count(*) as n, count(case when severity >= 4 then 1 end) as severe, round(count(case when severity >= 4 then 1 end) / count(*), 9) as share
from {_EVENTS} e where risk_code is not null group by risk_code""")
def rule_precision(spark, folder):
    e = audit_events(spark, folder, ["risk_code", "severity"]).where("risk_code is not null")
    severe = F.count_if(F.col("severity") >= 4)
    return e.groupBy("risk_code").agg(F.count(F.lit(1)).alias("n"), severe.alias("severe"), F.round(severe / F.count(F.lit(1)), 9).alias("share"))


@query("select user_id, bool_or(event_type = 'view') and (bool_or(event_type = 'purchase') or bool_or(event_type = 'click')) as exfiltration, count(*) as n from events group by user_id")
def tool_synergy(spark, folder):
    has = lambda t: F.bool_or(F.col("event_type") == t)
    return events(spark, folder).groupBy("user_id").agg((has("view") & (has("purchase") | has("click"))).alias("exfiltration"), F.count(F.lit(1)).alias("n"))


@query("select time_bucket(interval 1 minute, ts) as minute, event_type, count(*) as n from events group by 1, 2 having count(*) > 1")
def kill_switch(spark, folder):
    return events(spark, folder).groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"), "event_type").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"select severity, count(*) as n from {_EVENTS} e where severity >= 4 and agent_id is not null group by severity")
def high_severity(spark, folder):
    return sinks.alerts(audit_events(spark, folder, ["severity", "agent_id"])).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("select actor_id, max(id) as id from (select actor_id, id, occurred_at, max(occurred_at) over (partition by actor_id) as m from audit_ledger where occurred_at is not null and actor_id is not null) where occurred_at = m group by actor_id")
def ledger_last(spark, folder):
    rows = table(spark, folder, "audit_ledger").where("occurred_at is not null and actor_id is not null")
    return sinks.last_entry(rows, "actor_id", "occurred_at", "id")


@query(f"select event_id, case when {any_of('lower(text)', ['hello', 'hey', 'weather'])} then 'A' when {any_of('lower(text)', ['legal', 'contract', 'finance', 'research'])} then 'B' when {any_of('lower(text)', ['code', 'deploy', 'agent'])} then 'C' else 'B' end as route from {PROMPTS} p")
def intent_route(spark, folder):
    return prompts(spark, folder).select("event_id", pipelines.intent_route(F.col("text")).alias("route"))


@query(f"select event_id, case when {any_of('text', D.CANARIES)} or regexp_matches(text, '(?i)base64') or regexp_matches(text, '(?i)eval\\(') then 'BLOCK' when {any_of('lower(text)', ['hello', 'hey', 'weather'])} then 'FAST' when {any_of('lower(text)', ['legal', 'contract', 'finance', 'research'])} then 'SHIELDED' when {any_of('lower(text)', ['code', 'deploy', 'agent'])} then 'AIRLOCK' else 'SHIELDED' end as path from {PROMPTS} p")
def speculative_route(spark, folder):
    return prompts(spark, folder).select("event_id", pipelines.speculative_route(F.col("text")).alias("path"))


@query()
def universal_verdict(spark, folder):
    return pipelines.guard_prompts(prompts(spark, folder), "event_id", "user_id", "logged_at", "text", b"key of the guard query", verified=_verified(spark))


@query(f"""
with recursive e as (
  select event_id, user_id, epoch_us(logged_at) as us, {_HEAT} as add, row_number() over (partition by user_id order by logged_at, event_id) as n
  from {PROMPTS} p where text is not null and user_id is not null and logged_at is not null),
h as (
  select event_id, user_id, us, n, cast(case when add > 0 then add else 0 end as bigint) as heat from e where n = 1
  union all
  select e.event_id, e.user_id, e.us, e.n,
    cast(case when e.add > 0 then (case when e.us - h.us > 86400000000 then 0 else h.heat end * 9) // 10 + e.add
      else greatest((case when e.us - h.us > 86400000000 then 0 else h.heat end * 9) // 10 - 1, 0) end as bigint)
  from h join e on e.user_id = h.user_id and e.n = h.n + 1)
select user_id, event_id, heat, heat >= 10 as tripped from h""")
def prompt_heat(spark, folder):
    rows = prompts(spark, folder).where("text is not null").withColumn("points", D.heat(F.col("text")).cast("long"))
    return folds.heat(rows, "user_id", "logged_at", "event_id", "points", 86_400, 10)


# ---- graph: who acts next on the same kind of event within the hour

_EDGES = "(select user_id as src, dst, event_type as rel, ts from (select *, lead(user_id) over (partition by event_type, date_trunc('hour', ts) order by ts, event_id) as dst from events) where dst is not null and dst <> user_id)"


def edges(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("event_type", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    e = events(spark, folder).withColumn("dst", F.lead("user_id").over(w))
    return e.where("dst is not null and dst <> user_id").select(F.col("user_id").alias("src"), "dst", F.col("event_type").alias("rel"), "ts")


@query(f"""
with recursive e as (select distinct src, dst from {_EDGES} x),
r as (
  select distinct src as seed, src as id, 0 as hops from e where src % 100 = 0
  union
  select r.seed, e.dst, r.hops + 1 from r join e on r.id = e.src where r.hops < 3)
select seed, id, min(hops) as hops from r where id <> seed group by 1, 2""")
def blast_radius(spark, folder):
    e = edges(spark, folder)
    return graph.reach(e, e.where("src % 100 = 0").select(F.col("src").alias("id")), 3)


@query(f"""
with recursive e as (select distinct src, dst from {_EDGES} x),
r as (select src as start, dst as here, 1 as n from e union select r.start, e.dst, r.n + 1 from r join e on r.here = e.src where r.n < 5 and r.here <> r.start)
select start, min(n) as length from r where here = start group by start""")
def worm_cycles(spark, folder):
    return graph.cycles(edges(spark, folder), 5)


_RANK = f"e as materialized (select src, dst, count(*) / sum(count(*)) over (partition by src) as p from {_EDGES} x group by src, dst), v as materialized (select src as id from e union select dst from e), r0 as materialized (select id, 1.0::double / (select count(*) from v) as rank from v)"
for _i in range(1, 21):
    _RANK += f", r{_i} as materialized (select v.id, 0.15 / (select count(*) from v) + 0.85 * coalesce((select sum(rank) from r{_i - 1} where id not in (select src from e)), 0) / (select count(*) from v) + 0.85 * coalesce(f.r, 0) as rank from v left join (select dst, sum(rank * p) as r from e join r{_i - 1} on id = src group by dst) f on f.dst = v.id)"


@query(f"with {_RANK} select id, round(rank, 9) as rank from r20")
def user_graph_pagerank(spark, folder):
    return graph.page_rank(edges(spark, folder)).select("id", F.round("rank", 9).alias("rank"))


@query(f"select rel as signature, src as agent, ts from (select *, row_number() over (partition by rel order by ts, src) as n from {_EDGES} x) where n = 1")
def patient_zero(spark, folder):
    uses = edges(spark, folder).select(F.col("rel").alias("signature"), F.col("src").alias("agent"), "ts")
    return graph.patient_zero(uses).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"select id, peer, count(*) as interactions from (select src as id, dst as peer from {_EDGES} x union all select dst, src from {_EDGES} y) group by 1, 2")
def infection_radius(spark, folder):
    return graph.peers(edges(spark, folder))


@query(f"select distinct a.src as a, a.dst as b, a.ts as out_ts, b.ts as back_ts from {_EDGES} a join {_EDGES} b on a.src = b.dst and a.dst = b.src and b.ts > a.ts and b.ts <= a.ts + interval 30 minute")
def worm_bounces(spark, folder):
    b = graph.bounces(edges(spark, folder), 30)
    return b.select("a", "b", F.col("out_ts").cast("timestamp_ntz").alias("out_ts"), F.col("back_ts").cast("timestamp_ntz").alias("back_ts"))


@query("""
with u as (select distinct user_id as agent, event_type as tool from events)
select x.agent, x.tool as a, y.tool as b from u x join u y using (agent) where (x.tool, y.tool) in (('view', 'purchase'), ('click', 'signup'))""")
def toxic_pairs(spark, folder):
    uses = events(spark, folder).select(F.col("user_id").alias("agent"), F.col("event_type").alias("tool"))
    tools = spark.createDataFrame([("view", 1.0), ("purchase", 2.0), ("click", 1.0), ("signup", 1.5), ("error", 4.5)], "tool string, risk double")
    toxic = spark.createDataFrame([("view", "purchase"), ("click", "signup"), ("error", "view")], "a string, b string")
    return graph.toxic_pairs(uses, tools, toxic)


@query("select id, cast(null as varchar) as email, created_at from users where id is not null")
def masked_users(spark, folder):
    u = table(spark, folder, "users").select("id", "email", F.col("created_at").cast("timestamp_ntz").alias("created_at"))
    return graph.masked(u, "analyst", {"analyst": {"email"}})


@query("select event_id, count(*) as n from audit_events group by event_id having count(*) > 1")
def duplicate_events(spark, folder):
    return graph.duplicated_keys(table(spark, folder, "audit_events"), "event_id")


# ---- vectors


@query("""
select query, vec_id, round(similarity, 6) as similarity, rank from (
  select q.vec_id as query, e.vec_id, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) as similarity,
    row_number() over (partition by q.vec_id order by list_cosine_similarity(q.embedding::double[], e.embedding::double[]) desc, e.vec_id) as rank
  from embeddings q join embeddings e on q.vec_id % 100 = 0 and q.vec_id <> e.vec_id) where rank <= 10""")
def cosine_topk(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    found = vectors.top_k(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10)
    return found.select("query", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("""
with s as (select vec_id, label, embedding::double[] as v, row_number() over (partition by label order by vec_id) as n from embeddings),
p as (select a.label, a.vec_id, a.n, min(b.vec_id) as loop_turn from s a left join s b on a.label = b.label and b.n between a.n - 10 and a.n - 1 and list_cosine_similarity(a.v, b.v) > 0.3 group by 1, 2, 3)
select label, vec_id, n > 10 as depth_error, loop_turn from p""")
def reasoning_loops(spark, folder):
    e = table(spark, folder, "embeddings")
    return folds.last_turns(e, "label", "vec_id", "embedding", 0.3, 10).withColumnRenamed("loop_turn", "loop_turn")


@query("select vec_id, round(sqrt(list_sum([x::double * x::double for x in embedding])), 6) as magnitude from embeddings")
def vector_magnitude(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.round(F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding"))), 6).alias("magnitude"))


# ---- noise, relational


_UNIFORM = lambda seed, key: f"cast(('0x' || substr(sha256('{seed}:' || cast({key} as varchar)), 1, 13)) as bigint) / 4503599627370496.0"


@query(f"select event_type, n - sign(u) * ln(greatest(1 - 2 * greatest(abs(u), 1e-10), 1e-12)) as noisy from (select event_type, count(*) as n, {_UNIFORM(7, 'event_type')} - 0.5 as u from events group by event_type)")
def laplace_counts(spark, folder):
    return events(spark, folder).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", noise.laplace(F.col("n").cast("double"), F.col("event_type"), 1.0, 1.0, 7).alias("noisy"))


@query(f"select event_id, case when {_UNIFORM(7, 'event_id')} < exp(1) / (1 + exp(1)) then event_type = 'error' else event_type <> 'error' end as answer from events")
def randomised_response(spark, folder):
    return events(spark, folder).select("event_id", noise.randomised_response(F.col("event_type") == "error", F.col("event_id"), 1.0, 7).alias("answer"))


@query("select r_name, n_name, count(*) as orders, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2")
def org_spend_joins(spark, folder):
    t = lambda n: table(spark, folder, n)
    lines = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    buyers = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    # sums per order first: fewer rows meet the dimensions
    per_order = lines.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"), F.count(F.lit(1)).alias("c"))
    joined = per_order.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "n_name").agg(F.sum("c").alias("orders"), F.round(F.sum("v"), 2).alias("revenue"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 450000)")
def customers_without_orders(spark, folder):
    large = table(spark, folder, "orders").where("o_totalprice > 450000")
    return table(spark, folder, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
