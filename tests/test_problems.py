"""Problems 1, 2 and 5 against brute force."""

import json
from datetime import date, datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardloom.operators import nested, rolling, sessions
from wardloom.plans.problems import LIST_FIELDS, SHAPE

RECORD = "origin string, record_key string, metadata string"


def brute_paths(text):
    """Paths of the objects that stand in a list, written without the operator."""
    out = []

    def load(v):
        while isinstance(v, str):
            try:
                w = json.loads(v)
            except ValueError:
                return v
            if not isinstance(w, (dict, list, str)):
                return v
            v = w
        return v

    def go(v, path, name):
        v = load(v)
        if isinstance(v, list):
            for i, x in enumerate(v):
                x = load(x)
                if isinstance(x, dict):
                    out.append(f"{path}[{i}]")
                    fields(x, f"{path}[{i}]")
                elif isinstance(x, list):
                    go(x, f"{path}[{i}]", name)
        elif isinstance(v, dict):
            if name in LIST_FIELDS:
                path += "[0]"
                out.append(path)
            fields(v, path)

    def fields(obj, path):
        for k, v in obj.items():
            go(v, f"{path}.{k}" if path else k, k)

    try:
        go(json.loads(text), "", "")
    except (ValueError, TypeError):
        pass
    return sorted(out)


METADATA = [
    None,
    "",
    "null",
    "7",
    '"text"',
    '{"a": NaN}',
    '{"guards": [',
    '{"guards":[null,{"findings":[{"spans":{"begin":1}},{"related":[{"related":{"n":1}}]}]}],"labels":["x"]}',
    '[{"guards":{"verdict":{"detail":{"ms":3}}}},[[{"begin":1}]]]',
    json.dumps({"guards": json.dumps([{"findings": json.dumps({"x": 1})}]), "quote": "[sic] odd", "v": "[1, 2]"}),
    json.dumps(json.dumps({"hops": {"calls": {"args": [{"k": 1}, {"k": 2}]}}})),
    '{"batches":[[{"b":1},{"b":2}],[]],"request":{"tools_available":[{"scopes":{"s":1}}]},"node_path":"x","origin":{"z":1}}',
]


def test_shared_inlining_matches_brute_force(spark):
    df = spark.createDataFrame([("t", str(i), m) for i, m in enumerate(METADATA)], RECORD)
    plan = nested.analyse(df, SHAPE)
    rows = nested.shred(df, plan, SHAPE).collect()
    for i, m in enumerate(METADATA):
        got = sorted(r.node_path for r in rows if r.record_key == str(i) and r.in_list and r.is_object)
        assert got == (brute_paths(m) if m else []), m
    keys = {(r.record_key, r.node_path) for r in rows}
    assert len(keys) == len(rows)
    assert all((r.record_key, r.parent_path) in keys for r in rows if r.parent_path is not None)


def test_plan_inlines_only_singletons(spark):
    df = spark.createDataFrame([("t", "1", METADATA[7]), ("t", "2", METADATA[11])], RECORD)
    plan = nested.analyse(df, SHAPE)
    assert {"guards", "findings", "related", "spans", "scopes", nested.ROOT} <= plan.tables
    assert "request" not in plan.tables and "origin" not in plan.tables
    assert "origin.z" in plan.columns[nested.ROOT]
    table = nested.flat_table(nested.shred(df, plan, SHAPE), plan, nested.ROOT)
    row = table.where("record_key = '2'").first()
    assert row["v_node_path"] == "x" and row["origin.z"] == "1"


def test_no_inlining_beyond_the_edge_limit(spark):
    df = spark.createDataFrame([("t", "1", METADATA[7])], RECORD)
    plan = nested.analyse(df, SHAPE, max_edges=1)
    assert plan.tables is None
    found = nested.shred(df, plan, SHAPE).where("in_list and is_object").count()
    assert found == len(brute_paths(METADATA[7]))


def test_flat_table_keeps_values_beyond_the_edge_limit(spark):
    df = spark.createDataFrame([("t", "1", '{"a":1,"b":"x","guards":[{"n":2,"v":"y"}],"labels":["z"]}')], RECORD)
    plan = nested.analyse(df, SHAPE, max_edges=1)
    table = lambda element: nested.flat_table(nested.shred(df, plan, SHAPE), plan, element).collect()
    assert [r["values"] for r in table(nested.ROOT)] == [{"a": "1", "b": "x"}]
    assert [r["values"] for r in table("guards")] == [{"n": "2", "v": "y"}]
    assert [r["value"] for r in table("labels")] == ["z"]


def test_nested_empty_and_very_deep(spark):
    assert nested.shred(spark.createDataFrame([], RECORD), nested.Plan(frozenset({"$"})), SHAPE).count() == 0
    deep = '{"a":' * 2000 + "[{}]" + "}" * 2000
    df = spark.createDataFrame([("t", "1", deep)], RECORD)
    rows = nested.shred(df, nested.Plan(None), SHAPE, values=False).where("in_list and is_object").collect()
    assert len(rows) == 1 and rows[0].node_path == ".".join(["a"] * 2000) + "[0]"


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20))
@settings(max_examples=200, deadline=None)
def test_iterative_reader_reads_like_json(value):
    for text in (json.dumps(value), json.dumps(value, indent=1)):
        assert nested._iterative_decode(text) == value


def test_iterative_reader_reads_any_depth():
    value = nested.read_json("[" * 200_000 + "]" * 200_000)
    depth = 0
    while value:
        value, depth = value[0], depth + 1
    assert depth == 199_999


def test_iterative_reader_refuses_what_json_refuses():
    for bad in ("", "{", "[1,]", '{"a" 1}', "[1 2]", '{"a":1,}', "[1]]", "{]", '{"a":[}', "nul", '{"a":NaN}'):
        try:
            nested._iterative_decode(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def brute_trailing(rows, windows=(7, 30)):
    out = {}
    for key in {k for k, _, _ in rows}:
        mine = [(d, v) for k, d, v in rows if k == key]
        lo, hi = min(d for d, _ in mine), max(d for d, _ in mine)
        for i in range((hi - lo).days + max(windows)):
            day = lo + timedelta(i)
            out[key, day] = tuple(sum(v for d, v in mine if 0 <= (day - d).days < w) for w in windows)
    return out


@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 50), st.integers(-5, 300)), max_size=30))
@settings(max_examples=8, deadline=None)
def test_trailing_totals_match_brute_force(spark, raw):
    rows = [(k, date(2024, 1, 1) + timedelta(d), v) for k, d, v in raw]
    df = spark.createDataFrame([(k, datetime(d.year, d.month, d.day, 5), v / 100) for k, d, v in rows], "k string, t timestamp, v double")
    daily = rolling.daily_totals(df, "k", "t", rolling.hundredths(F.col("v")))
    got = {(r.k, r.day): (r.total_7, r.total_30) for r in rolling.trailing_totals(daily, "k").collect()}
    assert got == brute_trailing(rows)


def test_rolling_ignores_what_is_no_number(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", t, 1.0), ("a", t, float("nan")), ("a", t, None), ("a", t, float("inf")), (None, t, 1.0), ("a", None, 1.0)]
    daily = rolling.daily_totals(spark.createDataFrame(rows, "k string, t timestamp, v double"), "k", "t", rolling.hundredths(F.col("v")))
    assert [(r.k, r.rows, r.total) for r in daily.collect()] == [("a", 4, 100)]


def brute_sessions(rows, gap):
    out = []
    for key in {k for k, _ in rows}:
        run = []
        for t in sorted(t for k, t in rows if k == key):
            if run and t - run[-1] > gap:
                out.append((key, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        out.append((key, run[0], run[-1], len(run)))
    return sorted(out)


@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-9, 40)), max_size=40), st.integers(0, 4))
@settings(max_examples=8, deadline=None)
def test_sessions_match_brute_force(spark, rows, gap):
    base = 1_700_000_000
    df = spark.createDataFrame([(k, base + t) for k, t in rows], "k string, s long").withColumn("t", F.timestamp_seconds("s"))
    got = sessions.sessions(df, ["k"], "t", gap).collect()
    want = brute_sessions([(k, (base + t) * 1_000_000) for k, t in rows], gap * 1_000_000)
    assert sorted((r.k, r.start_us, r.end_us, r.events) for r in got) == want
    assert all(r.duration_us == r.end_us - r.start_us for r in got)


def test_late_events_merge_into_closed_sessions(spark):
    closed = spark.createDataFrame([("a", 0, 10, 2), ("a", 40, 50, 3)], "k string, start_us long, end_us long, events long")
    late = spark.createDataFrame([("a", 25, 25, 1)], closed.schema)
    got = sessions.merge_intervals(closed.unionByName(late), ["k"], 15).collect()
    assert [(r.start_us, r.end_us, r.events) for r in got] == [(0, 50, 6)]


def test_sessions_leave_out_null_keys_and_times(spark):
    rows = [("a", datetime(2024, 1, 1)), (None, datetime(2024, 1, 1)), ("a", None)]
    got = sessions.sessions(spark.createDataFrame(rows, "k string, t timestamp"), ["k"], "t").collect()
    assert [(r.k, r.events) for r in got] == [("a", 1)]


def test_keys_columns_and_empty_members(spark):
    df = spark.createDataFrame([("t", str(i), m) for i, m in enumerate(METADATA)] + [("t", "e", '{"guards":[{}],"tags":[],"one":{},"x":{"y":[]}}')], RECORD)
    plan = nested.analyse(df, SHAPE)
    rows = nested.shred(df, plan, SHAPE)
    checked = {r.element: (r.n_rows, r.repeated_keys, r.orphans) for r in nested.check_keys(rows).collect()}
    counts = {r.element: r["count"] for r in rows.groupBy("element").count().collect()}
    assert checked == {e: (n, 0, 0) for e, n in counts.items()}
    broken = rows.where("element <> 'guards'")
    assert sum(r.orphans for r in nested.check_keys(broken).collect()) == rows.where("parent_element = 'guards'").count() > 0
    assert {r.element: r.repeated_keys for r in nested.check_keys(rows.unionByName(rows.where("element = 'hops'"))).collect()}["hops"] == 2 * counts["hops"]
    root = nested.flat_table(rows, plan, nested.ROOT).where("record_key = 'e'").first()
    assert (root["tags"], root["one"], root["x.y"]) == ("[]", "{}", "[]")
    named = {(r.element, r.name) for r in nested.table_columns(rows).collect()}
    assert ("$", "tags") in named and named >= {(e, c) for e in ("args",) for c in plan.columns[e]}
