"""Filling windows of fixed capacity with documents, never splitting one that fits.

Method: sum-of-squares packing.  An item goes where the sum, over all residual gaps, of the squared number
of open bins with that gap becomes smallest.  The state is one counter per possible gap, so an item costs
one vector operation of the capacity's length, however many bins are open.

The items are dealt to groups by a hash, each group is packed by itself, and what each group leaves in
poorly filled bins is packed again in a second round over far fewer items.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.session import cut

#: Items dealt to one packing group on average.
GROUP_ITEMS = 20_000
#: Kinds of window at most; their table goes into the plan.
MOST_WINDOWS = 1_000


class SumOfSquares:
    """Open bins of one capacity, by residual gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, deque[int]] = defaultdict(deque)
        self.bins = 0

    def place(self, size: int) -> int:
        """The bin an item of ``size`` (1 to capacity) goes to; ties go to the smallest gap left."""
        c, n = self.capacity, self.count
        # taking a bin of gap g to gap h = g - size changes the sum by 2 * (n[h] - n[g]) + 2; h = 0 is not counted
        after = n[: c - size + 1].copy()
        change = 2 * (after - n[size:]) + 2
        change[0] = 1 - 2 * n[size]
        usable = n[size:] > 0
        fresh = 2 * n[c - size] + 1 if size < c else 0
        change = np.where(usable, change, np.iinfo(np.int64).max)
        h = int(change.argmin())
        if change[h] <= fresh and usable[h]:
            gap = h + size
            b = self.open[gap].popleft()
            n[gap] -= 1
        else:
            h, b = c - size, self.bins
            self.bins += 1
        if h:
            n[h] += 1
            self.open[h].append(b)
        return b

    def gaps(self) -> dict[int, int]:
        """Gap of each bin that is not full."""
        return {b: g for g, bins in self.open.items() for b in bins}


def pack_items(sizes: list[int], capacity: int) -> tuple[list[int], dict[int, int]]:
    """Bin of each item, and the gaps of the bins that are not full."""
    packer = SumOfSquares(capacity)
    placed = [packer.place(s) for s in sizes]
    return placed, packer.gaps()


def pieces_of(sizes: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """(window_id, capacity, key, piece, first_token, n): each document whole, or cut to the capacity if longer.

    ``windows`` has window_id and capacity_tokens, a few rows.
    """
    kinds = windows.select("window_id", "capacity_tokens").where("capacity_tokens > 0").distinct().limit(MOST_WINDOWS + 1).collect()
    if len(kinds) > MOST_WINDOWS:
        raise ValueError(f"more than {MOST_WINDOWS} kinds of window")
    each = F.array(*[F.struct(F.lit(r[0]).cast("int").alias("window_id"), F.lit(r[1]).cast("int").alias("capacity")) for r in sorted(kinds)])
    if not kinds:
        each = each.cast("array<struct<window_id:int,capacity:int>>")
    crossed = sizes.withColumn("w", F.explode(each)).select("*", "w.*").drop("w")
    count = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")), F.lit(1)).cast("int")
    cut_ = crossed.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    first = F.col("piece") * F.col("capacity").cast("long")
    return cut_.select("window_id", "capacity", key, "piece", first.alias("first_token"), F.least(F.col("capacity").cast("long"), F.col("n_tokens") - first).alias("n"))


def pack(sizes: DataFrame, windows: DataFrame, key: str, group_items: int = GROUP_ITEMS, well_filled: float = 0.98) -> DataFrame:
    """(window_id, bin, key, piece, first_token, n_tokens): each document's place in each kind of window.

    ``sizes`` has ``key`` and n_tokens.  A document longer than the window is split into full windows and
    a rest; no other is split.  A document of 0 tokens takes no space and lies in the first bin of its
    group.  Bins are numbered over all groups by a text ``round-group-number``.  An empty input gives an
    empty result.
    """
    total = sizes.count()
    groups = max(1, -(-total // group_items))
    items = pieces_of(sizes, windows, key)
    kind = sizes.schema[key].dataType.simpleString()
    full = items.where("n = capacity").select("window_id", F.concat_ws("-", F.lit("f"), F.col(key), F.col("piece")).alias("bin"), key, "piece", "first_token", F.col("n").alias("n_tokens"))
    rest = items.where("n < capacity").withColumn("grp", F.pmod(F.xxhash64(key, "piece"), F.lit(groups)).cast("int"))
    schema = f"window_id int, capacity int, `{key}` {kind}, piece int, first_token long, n long, bin string, again boolean"

    def run(round_: str, last: bool):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            capacity = int(pdf["capacity"].iloc[0])
            pdf = pdf.sort_values(["spread", key, "piece"], kind="stable")
            sizes_ = pdf["n"].to_numpy()
            bins = np.zeros(len(pdf), dtype=np.int64)
            real = np.flatnonzero(sizes_ > 0)
            placed, gaps = pack_items(sizes_[real].tolist(), capacity)
            bins[real] = placed
            poor = {b for b, g in gaps.items() if g > (1 - well_filled) * capacity} if not last else set()
            name = f"{round_}-{pdf['grp'].iloc[0]}-"
            out = pdf[["window_id", "capacity", key, "piece", "first_token", "n"]].copy()
            out["bin"] = [name + str(b) for b in bins]
            out["again"] = [n > 0 and b in poor for n, b in zip(sizes_, bins, strict=True)]
            return out

        return one

    mixed = F.xxhash64(F.lit(7), F.col(key), F.col("piece"))
    first = cut(rest.withColumn("spread", mixed).groupBy("window_id", "grp").applyInPandas(run("a", False), schema))
    again = first.where("again")
    fewer = max(1, groups // 16)
    # the larger leftovers first: the second round has no stream of items to come
    again = again.withColumn("grp", F.pmod(F.xxhash64(F.lit(1), F.col(key), F.col("piece")), F.lit(fewer)).cast("int")).withColumn("spread", -F.col("n"))
    second = again.groupBy("window_id", "grp").applyInPandas(run("b", True), schema)
    return full.unionByName(_named(first.where("not again"), key)).unionByName(_named(second, key))


def fill(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, bins, least_bins, filled): windows used, the least number that could hold the tokens, and the share of space used."""
    used = packed.groupBy("window_id", "bin").agg(F.sum("n_tokens").alias("n")).where("n > 0").groupBy("window_id").agg(F.count(F.lit(1)).alias("bins"), F.sum("n").alias("tokens"))
    both = used.join(windows.select("window_id", "capacity_tokens").distinct(), "window_id")
    return both.select("window_id", "bins", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_bins"), (F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("filled"))


def _named(packed: DataFrame, key: str) -> DataFrame:
    return packed.select("window_id", "bin", key, "piece", "first_token", F.col("n").alias("n_tokens"))
