"""Graphs as edge tables (src, dst, ts): sequences, reachability, cycles, ranking, toxic pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from wardloom.session import cut


def reach(edges: DataFrame, seeds: DataFrame, hops: int, allowed: DataFrame | None = None) -> DataFrame:
    """(seed, id, hops): what each seed reaches within so many directed hops, with the least number.

    With ``allowed`` (id) every vertex on the way, the seed too, must be one of them.  A level is a join of
    the newly reached vertices only.
    """
    e = edges.select("src", "dst").distinct()
    level = seeds.select(F.col("id").alias("seed"), "id").distinct()
    if allowed is not None:
        e = e.join(allowed.select(F.col("id").alias("dst")), "dst", "left_semi")
        level = level.join(allowed.select("id"), "id", "left_semi")
    level = level.select("seed", "id", F.lit(0).alias("hops"))
    seen = level
    for h in range(1, hops + 1):
        step = level.join(e, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id")).distinct()
        level = cut(step.join(seen, ["seed", "id"], "left_anti").withColumn("hops", F.lit(h)))
        seen = seen.unionByName(level)
    return seen.where("hops > 0")


def cycles(edges: DataFrame, longest: int = 4, block: int = 8_000_000) -> DataFrame:
    """(start, length): vertices on a closed walk of 2 to ``longest`` distinct edges, with its least length.

    A walk is looked for from both ends: what a start reaches in half the steps, one edge, and what reaches the
    start in the other half.  Neighbours are lists; starts and middle vertices are cut into blocks of at most
    ``block`` edges or so, and each pair of blocks is one task that stops at a start's first closed walk.  So no
    list of paths is made, and a start whose least length is known goes no further.
    """
    up, down = F.col("src") < F.col("dst"), F.col("src") > F.col("dst")
    pairs = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(up).alias("up"), F.max(down).alias("down"))
    ways = F.array(F.when(F.col("up"), F.struct(F.col("a").alias("src"), F.col("b").alias("dst"))), F.when(F.col("down"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    e = cut(pairs.select(F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("w"), (F.col("up") & F.col("down")).alias("both")).select("w.*", "both"))
    outs = cut(e.groupBy(F.col("src").alias("k")).agg(F.collect_list("dst").alias("vs")))
    ins = cut(e.groupBy(F.col("dst").alias("k")).agg(F.collect_list("src").alias("vs")))
    found = cut(e.where("both").select(F.col("src").alias("start")).distinct().withColumn("length", F.lit(2)))
    slots = e.sparkSession.sparkContext.defaultParallelism
    many = e.count()
    across = max(-(-many // block), min(math.isqrt(slots - 1) + 1, many // 100_000 + 1))
    open_ = outs.join(ins, "k", "left_semi").select(F.col("k").alias("start"))
    for n in range(3, longest + 1):
        open_ = cut(open_.join(found, "start", "left_anti"))
        if open_.isEmpty():
            break
        ahead = (n - 1) // 2
        closed = _closing(_within(open_, outs, ahead), outs, _within(open_, ins, n - 1 - ahead), across)
        found = found.unionByName(cut(closed.withColumn("length", F.lit(n))))
    return found


def _within(starts: DataFrame, lists: DataFrame, steps: int) -> DataFrame:
    """(start, vs): what each start comes to in so many steps along ``lists`` (k, vs)."""
    level = lists.join(starts, F.col("k") == F.col("start"), "left_semi").select(F.col("k").alias("start"), "vs")
    for _ in range(steps - 1):
        step = level.select("start", F.explode("vs").alias("k")).join(lists, "k").select("start", F.explode("vs").alias("v")).where("v <> start")
        level = step.repartition("start").groupBy("start").agg(F.collect_set("v").alias("vs"))
    return level


def _closing(ahead: DataFrame, outs: DataFrame, behind: DataFrame, across: int) -> DataFrame:
    """(start): those with an edge from ``ahead`` (start, vs) to ``behind`` (start, vs); ``outs`` (k, vs) are the edges."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(across))
    every = F.explode(F.sequence(F.lit(0), F.lit(across - 1)).cast("array<long>"))
    split = F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda j: F.struct(j.cast("long").alias("_j"), F.filter("vs", lambda v: place(v) == j).alias("vs")))
    x = ahead.select(F.lit(0).alias("kind"), F.col("start").alias("k"), place("start").alias("_i"), F.explode(split).alias("p")).select("kind", "k", "_i", "p.*").where(F.size("vs") > 0)
    e = outs.select(F.lit(1).alias("kind"), "k", place("k").alias("_j"), "vs").withColumn("_i", every)
    y = behind.select(F.lit(2).alias("kind"), F.col("start").alias("k"), place("start").alias("_i"), "vs").withColumn("_j", every)
    parts = x.unionByName(e).unionByName(y).select((F.col("_i") * across + F.col("_j")).alias("_c"), "kind", "k", "vs")
    # a number of partitions, so that adaptive execution does not merge what is small in bytes but long in work
    parts = parts.repartition(min(across * across, 10_000), "_c")
    shape = Y.StructType([Y.StructField("start", outs.schema["k"].dataType)])
    return parts.groupBy("_c").applyInPandas(_closed, shape).distinct()


def _closed(part: pd.DataFrame) -> pd.DataFrame:
    x, e, y = (part[part["kind"] == kind] for kind in range(3))
    starts = []
    if len(x) and len(e) and len(y):
        bounds = lambda lists: np.r_[0, np.cumsum([len(v) for v in lists])]
        after, before = bounds(e["vs"]), bounds(y["vs"])
        ids, names = pd.factorize(np.concatenate([*e["vs"], *y["vs"]]))
        heads, tails = ids[: after[-1]], ids[after[-1] :]
        lists = np.split(heads, after[1:-1])
        at = {k: i for i, k in enumerate(y["k"])}
        middles = pd.Index(e["k"])
        marked = np.zeros(len(names), dtype=bool)
        for start, vs in zip(x["k"], x["vs"]):
            if (i := at.get(start)) is None:
                continue
            own = tails[before[i] : before[i + 1]]
            marked[own] = True
            mids = middles.get_indexer(vs)
            mids = mids[mids >= 0].tolist()
            if any(marked[np.concatenate([lists[m] for m in mids[j : j + 64]])].any() for j in range(0, len(mids), 64)):
                starts.append(start)
            marked[own] = False
    return pd.DataFrame({"start": pd.Series(starts, dtype=part["k"].dtype)})


def page_rank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """(id, rank) over weighted directed edges; the ranks of vertices without way out are spread evenly."""
    e = cut(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w")))
    total = e.groupBy("src").agg(F.sum("w").alias("t"))
    e = cut(e.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p")))
    ids = cut(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(1.0))
    sinks = cut(ids.join(e.select(F.col("src").alias("id")).distinct(), "id", "left_anti"))
    loses = not sinks.isEmpty()
    rank = ids.withColumn("rank", F.lit(1.0 / n))
    for i in range(1, rounds + 1):
        flow = rank.join(e, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("r")).withColumnRenamed("dst", "id")
        # where every vertex has a way out no rank is lost, and no round needs a job of its own
        lost = rank.join(sinks, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0] if loses else 0.0
        base = (1 - damping) / n + damping * lost / n
        rank = ids.join(flow, "id", "left").select("id", (F.lit(base) + damping * F.coalesce("r", F.lit(0.0))).alias("rank"))
        if i % cut_every == 0:
            rank = cut(rank)
    return rank


def toxic_pairs(uses: DataFrame, tools: DataFrame, toxic: DataFrame, limit: float = 5.0) -> DataFrame:
    """(agent, a, b): two tools of one agent that are harmless alone (risks add up to less than ``limit``) and
    declared toxic together.  The declared pairs lead the join, so an agent's tools never all meet."""
    u = uses.select("agent", "tool").distinct()
    risk = tools.select("tool", "risk")
    pairs = toxic.select("a", "b").where("a <> b").distinct()
    mild = pairs.join(risk.select(F.col("tool").alias("a"), F.col("risk").alias("ra")), "a").join(risk.select(F.col("tool").alias("b"), F.col("risk").alias("rb")), "b").where(F.col("ra") + F.col("rb") < limit)
    return mild.join(u.withColumnRenamed("tool", "a"), "a").join(u.withColumnRenamed("tool", "b"), ["agent", "b"]).select("agent", "a", "b")


def patient_zero(uses: DataFrame) -> DataFrame:
    """(signature, agent, ts): who used each signature first; ties by agent."""
    first = uses.groupBy("signature").agg(F.min(F.struct("ts", "agent")).alias("m"))
    return first.select("signature", "m.agent", "m.ts")


def peers(edges: DataFrame) -> DataFrame:
    """(id, peer, interactions), both directions together."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("peer")).unionAll(edges.select("dst", "src"))
    return both.groupBy("id", "peer").agg(F.count(F.lit(1)).alias("interactions"))


def bounces(edges: DataFrame, minutes: int = 5) -> DataFrame:
    """(a, b, out_ts, back_ts): a calls b and b calls a back within ``minutes``.

    Edges meet on the pair and a time slot of that length (the call back looks at its own and the slot
    before), so a busy pair is split by time.
    """
    width = minutes * 60
    t = F.col("ts").cast("double")
    slot = F.floor(t / width)
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("ts").alias("out_ts"), slot.alias("slot"))
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("ts").alias("back_ts"), F.explode(F.array(slot, slot - 1)).alias("slot"))
    met = out.join(back, ["a", "b", "slot"])
    gap = F.col("back_ts").cast("double") - F.col("out_ts").cast("double")
    return met.where((gap > 0) & (gap <= width)).select("a", "b", "out_ts", "back_ts").distinct()


def duplicated_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n): keys that are not unique."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def masked(df: DataFrame, role: str, hidden: dict[str, set[str]], locked: bool = False) -> DataFrame:
    """``df`` as a role may see it: hidden columns are null, and nothing is seen in lockdown but by ``auditor``."""
    if locked and role != "auditor":
        return df.where("false")
    return df.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name in hidden.get(role, set()) else F.col(f"`{f.name}`") for f in df.schema])


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with ``turn``: the place of a row within its key."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def anchored(df: DataFrame, session: str, order: list[str], goal: str, every: int = 3) -> DataFrame:
    """``df`` with ``turn`` and ``anchor``: every so many turns of a session its goal is said again."""
    turns = numbered(df, session, order)
    return turns.withColumn("anchor", F.when(F.col("turn") % every == 0, F.concat(F.lit("GOAL: "), F.col(goal))))


def batch_result(verdicts: DataFrame, tripped: str = "tripped", code: str = "code") -> DataFrame:
    """(total, passed, failed) and the failures per code as a map, of a batch of verdicts."""
    per = verdicts.groupBy(F.coalesce(F.when(F.col(tripped), F.col(code)), F.lit("OK")).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    failed = F.coalesce(F.sum(F.when(F.col("c") != "OK", F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return per.agg(total.alias("total"), (total - failed).alias("passed"), failed.alias("failed"), F.map_from_entries(F.collect_list(F.when(F.col("c") != "OK", F.struct("c", "n")))).alias("by_code"))
