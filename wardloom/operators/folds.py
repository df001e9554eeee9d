"""State per key over ordered events: decaying heat, velocities, budgets, buckets, running and rolling measures.

A fold is sequential by nature.  Its events are cut where the state is known to start anew (after a gap that
resets it, or at a new day), and each piece is folded by itself, in the order of time and event id.  Pieces
are found from slot intervals.  A key that is never idle is one piece: it streams through one task, which
holds one state, but its rows are sorted there.  Running totals are prefix sums over days plus a running
sum inside the day.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def islands(df: DataFrame, key: str, time: str, gap_us: int) -> DataFrame:
    """``df`` with ``island``: the microsecond at which the run of events with gaps of at most ``gap_us`` began.

    Rows with null key or time are left out.
    """
    us = F.unix_micros(F.col(time))
    slotted = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("_us", us).withColumn("_slot", us - F.pmod(us, F.lit(gap_us + 1)))
    slots = slotted.groupBy(key, "_slot").agg(F.min("_us").alias("_a"), F.max("_us").alias("_b"))
    w = Window.partitionBy(key).orderBy("_slot")
    opens = F.when(F.col("_a") - F.lag("_b").over(w) <= gap_us, F.lit(None)).otherwise(F.col("_a"))
    starts = slots.withColumn("_open", opens).withColumn("island", F.last("_open", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return slotted.join(starts.select(key, "_slot", "island"), [key, "_slot"]).drop("_slot")


def fold(df: DataFrame, keys: list[str], order: list[str], carry: list[str], schema: str, start: Callable[[], object], step: Callable[[object, tuple], tuple[object, tuple]]) -> DataFrame:
    """Each row's results of ``step(state, values of carry)`` in ``order`` within ``keys``.

    The result has keys, order and the columns of ``schema``.  Pieces stream through a task one row at a
    time; only one state is held.
    """
    columns = [*keys, *order]
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            ids = list(zip(*(pdf[k] for k in keys), strict=True))
            rows = zip(*(pdf[c] for c in carry), strict=True)
            out = []
            for key, row in zip(ids, rows, strict=True):
                if key != last:
                    last, state = key, start()
                state, result = step(state, row)
                out.append(result)
            yield pd.concat([pdf[columns].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    wanted = df.select(*dict.fromkeys([*columns, *carry]))
    placed = wanted.repartition(*keys).sortWithinPartitions(*columns)
    return placed.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), schema]))


def heat(df: DataFrame, key: str, time: str, id_: str, points: str, ttl_seconds: int = 3600, limit: int = 10) -> DataFrame:
    """Heat after each event: floor(nine tenths) plus points, one less for a clean event, never below 0.

    An idle time of more than ``ttl_seconds`` resets it.
    """

    def step(h, row):
        h = h * 9 // 10 + row[0] if row[0] else max(h * 9 // 10 - 1, 0)
        return h, (h, h >= limit)

    pieces = islands(df, key, time, ttl_seconds * 1_000_000)
    return fold(pieces, [key, "island"], ["_us", id_], [points], "heat long, tripped boolean", int, step).drop("island", "_us")


def velocity(df: DataFrame, key: str, time: str, id_: str, amount: str, limit: float, window_seconds: int = 60) -> DataFrame:
    """Spend in windows that start at the first event after the last window's end.

    The first amount of a window is not held against the limit; a rejected one stays counted.
    """
    width = window_seconds * 1_000_000

    def step(state, row):
        at, v = row
        if state is None or at - state[0] >= width:
            return (at, v), (v, False)
        total = state[1] + v
        return (state[0], total), (total, total > limit)

    pieces = islands(df, key, time, width - 1)
    return fold(pieces, [key, "island"], ["_us", id_], ["_us", amount], "window_sum double, tripped boolean", lambda: None, step).drop("island", "_us")


def daily_budget(df: DataFrame, key: str, time: str, id_: str, cost: str, limit: float) -> DataFrame:
    """Whether each cost still fits the key's budget of the day; a rejected one leaves the total as it was."""

    def step(total, row):
        ok = total + row[0] <= limit
        total = total + row[0] if ok else total
        return total, (total, ok)

    dated = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("_us", F.unix_micros(time)).withColumn("_day", F.to_date(time))
    return fold(dated, [key, "_day"], ["_us", id_], [cost], "spent long, allowed boolean", int, step).drop("_day", "_us")


def token_bucket(df: DataFrame, key: str, time: str, id_: str, burst: int = 100, per_second: int = 10) -> DataFrame:
    """A bucket that refills in whole seconds; an event takes one token if there is one."""

    def step(state, row):
        at = row[0]
        tokens, last = state if state else (burst, at)
        seconds = (at - last) // 1_000_000
        if seconds > 0:
            tokens, last = min(burst, tokens + seconds * per_second), at
        ok = tokens > 0
        return (tokens - ok, last), (int(tokens - ok), ok)

    full_again = (-(-burst // per_second) + 1) * 1_000_000
    pieces = islands(df, key, time, full_again)
    return fold(pieces, [key, "island"], ["_us", id_], ["_us"], "left long, allowed boolean", lambda: None, step).drop("island", "_us")


def running_total(df: DataFrame, key: str, time: str, id_: str, value: str) -> DataFrame:
    """``df`` (key, time, id, value) with ``running``: the key's total up to and with each event.

    Totals of whole days come first (combined on the map side), then the running sum inside the day, so
    that no task holds more than a key's day.
    """
    dated = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time, id_, value).withColumn("_day", F.to_date(time))
    days = dated.groupBy(key, "_day").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(key, "_day").orderBy(time, id_).rowsBetween(Window.unboundedPreceding, 0)
    return dated.withColumn("_in", F.sum(value).over(inside)).join(days, [key, "_day"]).withColumn("running", F.col("_in") + F.col("_before")).drop("_day", "_in", "_before")


def rolling_distinct(df: DataFrame, key: str, time: str, id_: str, value: Column, window_seconds: int = 3600, exclusive: bool = False) -> DataFrame:
    """(key, id, total, distinct): events and distinct values in the trailing window of each event.

    Events go to the slot of their window length and, as history only, to the next one; each slot is
    then a small group of its own.  A value counts from one of its events until its next one or until that
    event leaves the window, so distinct values are a running sum of beginnings and ends, and no set of
    values is held.  ``exclusive`` leaves out an event exactly the window's length old.  Null values are no value.
    """
    width = window_seconds * 1_000_000
    us = F.unix_micros(F.col(time))
    rows = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, id_, us.alias("_us"), value.alias("_v"))
    slot = F.floor(F.col("_us") / width)
    both = rows.withColumn("_slot", F.explode(F.array(slot, slot + 1))).withColumn("_own", F.col("_slot") == slot).repartition(F.col(key), F.col("_slot"))
    again = F.lead("_us").over(Window.partitionBy(key, "_slot", "_v").orderBy("_us"))
    leaves = F.col("_us") + width + (0 if exclusive else 1)
    counts = F.col("_v").isNotNull().cast("int")
    marks = F.array(
        F.struct(F.col("_us").alias("at"), counts.alias("d"), F.lit(1).alias("n"), F.col("_own").alias("own"), F.col(id_).alias("i")),
        F.struct(F.least("_end", leaves).alias("at"), (-counts).alias("d"), F.lit(0).alias("n"), F.lit(False).alias("own"), F.lit(None).cast(df.schema[id_].dataType).alias("i")),
    )
    steps = both.withColumn("_end", again).select(key, "_slot", F.explode(marks).alias("m")).select(key, "_slot", "m.*")
    w = Window.partitionBy(key, "_slot").orderBy("at")
    measured = steps.withColumn("distinct", F.sum("d").over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w.rangeBetween(-width + (1 if exclusive else 0), 0)))
    return measured.where("own").select(key, F.col("i").alias(id_), F.col("total").cast("long"), F.col("distinct").cast("long"))


def last_turns(df: DataFrame, session: str, turn: str, vector: str, threshold: float, max_depth: int) -> DataFrame:
    """(session, turn, depth_error, loop_turn): the first of the last ``max_depth`` turns whose vector is closer
    than ``threshold`` to the turn's own; depth_error where the session is at its greatest depth."""
    from wardloom.operators.vectors import cosine

    w = Window.partitionBy(session).orderBy(turn)
    seen = df.withColumn("_d", F.row_number().over(w)).withColumn("_h", F.collect_list(F.struct(F.col(turn).alias("t"), F.col(vector).alias("v"))).over(w.rowsBetween(-max_depth, -1)))
    close = F.filter("_h", lambda h: cosine(h["v"], F.col(vector)) > threshold)
    return seen.select(session, turn, (F.col("_d") > max_depth).alias("depth_error"), F.when(F.size(close) > 0, F.element_at(close, 1)["t"]).alias("loop_turn"))


def exposure(df: DataFrame, session: str, turn: str, text: str, min_bytes: int = 10, hexish: float = 3.0, base64ish: float = 4.2, other: float = 4.6, max_unique: int = 25, max_score: int = 4000) -> DataFrame:
    """What each turn newly reveals in its session, and the running exposure.

    Tokens of at least ``min_bytes`` bytes that look like ids, keys, paths or random blobs count once per
    session.  The result has session, turn, new_tokens, unique_tokens, score, tripped.
    """
    from wardloom.functions.text import ascii_lower, words
    from wardloom.operators.detectors import char_byte_entropy

    t = F.col("token")
    low = ascii_lower(t)
    slashes = F.regexp_count(t, F.lit(r"[/\\]"))
    entropy = F.col("_e")
    path = (slashes > 0) & ~t.rlike("^https?://") & (low.rlike(r"private|secret|key|\.ssh|id_rsa") | (slashes >= 2))
    blob = F.when(t.rlike("^[0-9a-fA-F]+$"), "hex").when(t.rlike("^[A-Za-z0-9+/=_-]+$"), "base64").otherwise("other")
    kind = (
        F.when(t.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"), "uuid")
        .when(t.rlike(r"^[A-Za-z0-9_=-]{8,}\.[A-Za-z0-9_=-]{8,}\.[A-Za-z0-9_=-]{8,}$"), "jwt")
        .when(path, "path")
        .when((low.rlike("^(sk-|ghp_)") & (F.octet_length(t) >= 24)) | (t.contains("BEGIN") & t.contains("KEY")), "key")
        .when(t.rlike(r"^\p{ASCII}+$") & (entropy >= F.when(blob == "hex", hexish).when(blob == "base64", base64ish).otherwise(other)), blob)
    )
    weight = F.when(F.col("kind") == "key", 900).when(F.col("kind") == "jwt", 750).when(F.col("kind") == "path", 450).when(F.col("kind") == "uuid", 350).when(F.col("kind") == "other", 200).otherwise(300)
    score = weight + F.least(3 * F.octet_length(t), F.lit(300)) + F.least(F.floor(F.round(entropy * 100) / 10), F.lit(500)).cast("int")
    turns = df.where(F.col(session).isNotNull()).select(session, turn, text)
    found = (
        turns.select(session, turn, F.explode(F.array_distinct(words(F.col(text)))).alias("_raw"))
        .select(session, turn, F.regexp_replace("_raw", r"^[\p{Punct}&&[^/]]+|\p{Punct}+$", "").alias("token"))
        .where(F.octet_length("token") >= min_bytes)
        .withColumn("_e", char_byte_entropy(t))
        .withColumn("kind", kind)
        .where("kind is not null")
        .groupBy(session, "token", "kind", "_e")
        .agg(F.min(turn).alias(turn))
    )
    per_turn = found.withColumn("_s", score).groupBy(session, turn).agg(F.count(F.lit(1)).alias("new_tokens"), F.sum("_s").alias("_new"))
    w = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    out = per_turn.withColumn("unique_tokens", F.sum("new_tokens").over(w)).withColumn("score", F.sum("_new").over(w))
    code = F.when(F.col("unique_tokens") > max_unique, "UNIQUE").when(F.col("score") > max_score, "SCORE")
    return out.select(session, turn, "new_tokens", "unique_tokens", "score", code.alias("tripped"))
