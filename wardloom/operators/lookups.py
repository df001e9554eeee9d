"""Lookups in registries, allow-lists and protected names: equi-joins on keys made for them, no nested loops."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from wardloom.functions import arrow
from wardloom.functions import text as T
from wardloom.session import cut

# A registry that is joined by key needs no hint: Spark sends it to all tasks only if its size allows it.


def registry_check(df: DataFrame, key: str, value: str, registry: DataFrame) -> DataFrame:
    """``df`` with ``registry_code``: null if the pinned value of its key is the row's, else UNKNOWN or MISMATCH.

    ``registry`` has unique ``key`` and ``pinned``.  A row without key is unknown.
    """
    pins = registry.select(F.col(key).alias("_k"), F.col("pinned").alias("_p"))
    joined = df.join(pins, F.col(key) == F.col("_k"), "left")
    code = F.when(F.col("_p").isNull(), "UNKNOWN").when(~F.col(value).eqNullSafe(F.col("_p")), "MISMATCH")
    return joined.withColumn("registry_code", code).drop("_k", "_p")


def members(df: DataFrame, key: str, listed: DataFrame, present: bool = True) -> DataFrame:
    """Rows whose key is (or is not) in ``listed``."""
    return df.join(listed.select(key), key, "left_semi" if present else "left_anti")


def handoffs(df: DataFrame, levels: DataFrame) -> DataFrame:
    """``df`` (sender, receiver, payload) with ``blocked``: a lower level hands a higher one something to do.

    ``levels`` has unique agent and level; unknown agents have level 0.
    """
    from wardloom.operators.detectors import HANDOFF_VERBS

    s = levels.select(F.col("agent").alias("sender"), F.col("level").alias("_s"))
    r = levels.select(F.col("agent").alias("receiver"), F.col("level").alias("_r"))
    lower = F.coalesce("_s", F.lit(0)) < F.coalesce("_r", F.lit(0))
    verbs = F.coalesce(T.contains_any(F.lower("payload"), HANDOFF_VERBS), F.lit(False))
    return df.join(s, "sender", "left").join(r, "receiver", "left").withColumn("blocked", lower & verbs).drop("_s", "_r")


def pinned_sessions(df: DataFrame, token: str, time: str, id_: str, address: str) -> DataFrame:
    """``df`` with ``pinned`` (the token's first address) and ``collision``."""
    first = df.where(F.col(address).isNotNull()).groupBy(token).agg(F.min(F.struct(F.col(time), F.col(id_), F.col(address).alias("a"))).alias("_f")).select(token, F.col("_f.a").alias("pinned"))
    return df.join(first, token, "left").withColumn("collision", F.coalesce(F.col(address) != F.col("pinned"), F.lit(False)))


def previous(df: DataFrame, key: str, time: str, id_: str, bucket: str = "day") -> DataFrame:
    """``df`` with ``previous_id``: the key's event before each one.

    Inside a bucket by lag; the first event of a bucket takes the last one of the key's bucket before it,
    so no task orders more than a key's bucket.
    """
    cut = df.withColumn("_b", F.date_trunc(bucket, F.col(time)))
    w = Window.partitionBy(key, "_b").orderBy(time, id_)
    ends = cut.groupBy(key, "_b").agg(F.max(F.struct(F.col(time), F.col(id_).alias("_last"))).alias("_e"))
    before = ends.withColumn("_prev", F.lag("_e._last").over(Window.partitionBy(key).orderBy("_b"))).select(key, "_b", "_prev")
    return cut.withColumn("_lag", F.lag(id_).over(w)).join(before, [key, "_b"]).withColumn("previous_id", F.coalesce("_lag", "_prev")).drop("_b", "_lag", "_prev")


def blocked_hosts(df: DataFrame, host: str, blocked: DataFrame, approved: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``matched``: the longest blocked domain that the host is or lies under; null if none.

    Every domain above a host is an equi-join key.  Approved hosts match nothing.
    """
    hosts = df.select(host).where(F.col(host).isNotNull()).distinct()
    above = hosts.where(~F.col(host).isin(*approved)) if approved else hosts
    hit = above.select(host, F.explode(T.domain_suffixes(F.col(host))).alias("domain")).join(blocked.select("domain"), "domain")
    best = hit.groupBy(host).agg(F.max(F.struct(F.length("domain"), "domain")).alias("_m")).select(host, F.col("_m.domain").alias("matched"))
    return df.join(best, host, "left")


def near_names(candidates: DataFrame, name: str, protected: DataFrame, target: str, most: int = 2, share: float = 0.34, least: int = 5) -> DataFrame:
    """(name, target, distance): candidates within 1 to ``most`` edits of a protected name.

    Names that are that close share a piece: a target is cut into ``most`` + 1 pieces, at least one of which
    stands unchanged in the candidate at most ``most`` places away.  Pieces with place and length are the
    join key, so unlike names never meet.
    """
    pieces = most + 1

    def cuts(value: Column) -> list[tuple[Column, Column]]:
        n = F.length(value)
        return [(F.floor(n * i / pieces).cast("int"), F.floor(n * (i + 1) / pieces).cast("int")) for i in range(pieces)]

    t = protected.select(F.col(target)).where(F.length(target) >= 1).distinct()
    parts = F.array(*[F.struct(F.lit(i).alias("i"), a.alias("at"), F.substring(F.col(target), a + 1, b - a).alias("part")) for i, (a, b) in enumerate(cuts(F.col(target)))])
    keyed = t.select(target, F.length(target).alias("tl"), F.explode(parts).alias("x")).select(target, "tl", "x.i", "x.at", "x.part")
    c = candidates.select(F.col(name)).where(F.length(name) >= least).distinct().withColumn("tl", F.explode(F.sequence(F.length(name) - most, F.length(name) + most))).where("tl > 0")
    probes = F.array(*[
        F.struct(F.lit(i).alias("i"), F.floor(F.col("tl") * i / pieces).cast("int").alias("at"), F.substring(F.col(name), F.floor(F.col("tl") * i / pieces).cast("int") + 1 + d, F.floor(F.col("tl") * (i + 1) / pieces).cast("int") - F.floor(F.col("tl") * i / pieces).cast("int")).alias("part"))
        for i in range(pieces) for d in range(-most, most + 1)
    ])
    probed = c.select(name, "tl", F.explode(F.array_distinct(probes)).alias("x")).select(name, "tl", "x.i", "x.at", "x.part")
    met = probed.join(keyed, ["tl", "i", "at", "part"]).select(name, target).distinct()
    d = F.levenshtein(F.col(name), F.col(target))
    return met.withColumn("distance", d).where((d >= 1) & (d <= most) & (d / F.length(name) <= share))


# How packages are installed, by tool, and options that take a value.
_INSTALLERS = {("pip", "install"): "pip", ("pip3", "install"): "pip", ("npm", "install"): "npm", ("npm", "i"): "npm", ("yarn", "add"): "yarn", ("pnpm", "add"): "pnpm", ("bun", "add"): "bun", ("cargo", "add"): "cargo"}
_WITH_VALUE = {
    "pip": set("-r --requirement -c --constraint --index-url --extra-index-url --trusted-host --find-links --platform --python-version --implementation --abi".split()),
    "cargo": {"--features", "--git", "--path"},
}
_JS_VALUE = {"--registry", "--userconfig"}


def package_name(raw: str) -> str:
    """The bare lower-case name of a package specifier."""
    s = raw.strip("\"'").strip(",;:)]}.").split(";")[0].strip().split("[")[0]
    for op in ("==", ">=", "<=", "~=", "!=", ">", "<", "="):
        if op in s:
            s = s[: s.index(op)]
            break
    at = s.rfind("@")
    if at > 0 and (not s.startswith("@") or "/" in s[:at]):
        s = s[:at]
    return s.strip().lower()


def install_requests(prompt: str) -> list[tuple[str, str, str, bool]]:
    """(tool, specifier, name, is a URL or repository) of each package that a text asks to install."""
    words, out, i = prompt.split(), [], 0
    while i < len(words):
        tool, step = None, 1
        if words[i] in ("python", "python3") and words[i + 1 : i + 4] == ["-m", "pip", "install"]:
            tool, step = "pip", 4
        elif (t := _INSTALLERS.get((words[i], words[i + 1] if i + 1 < len(words) else ""))) is not None:
            tool, step = t, 2
        i += step
        if tool is None:
            continue
        valued = _WITH_VALUE.get(tool, _JS_VALUE)
        while i < len(words) and words[i] not in ("&&", ";", "|"):
            w = words[i]
            i += 1
            if w.startswith("-"):
                i += w in valued
                continue
            name = package_name(w)
            if name:
                low = w.lower()
                out.append((tool, w, name, "://" in low or low.startswith(("git+", "git@", "ssh://"))))
    return out


_REQUEST = Y.ArrayType(Y.StructType([Y.StructField("tool", Y.StringType()), Y.StructField("raw", Y.StringType()), Y.StructField("name", Y.StringType()), Y.StructField("is_url", Y.BooleanType())]))
_ASKS = r"(?:pip3?|npm|yarn|pnpm|bun|cargo)\s+(?:install|i|add)\b"


@F.pandas_udf(_REQUEST)
def requested_packages(prompts: pd.Series) -> pd.Series:
    asks = re.compile(_ASKS)
    return prompts.map(lambda p: install_requests(p) if p is not None and asks.search(p) else [])


def package_findings(df: DataFrame, key: str, text: str, verified: DataFrame, strict: bool = True, least: int = 4, most: int = 2, similar: float = 0.92) -> DataFrame:
    """(key, tool, raw, name, finding, similar_to): packages that are not verified.

    ``verified`` has unique package.  Findings: SUSPICIOUS for URLs and repositories, TYPOSQUAT with the
    nearest verified name (fewest edits, then Jaro-Winkler), UNVERIFIED for the others if ``strict``.
    """
    asked = df.where(F.col(text).rlike(_ASKS)).select(key, F.explode(requested_packages(F.col(text))).alias("p")).select(key, "p.*")
    known = verified.select(F.col("package"))
    odd = asked.join(known, asked["name"] == known["package"], "left_anti").where("not is_url").select("name").distinct()
    close = near_names(odd, "name", known, "package", most, 1.0, least)
    allowed = F.when(F.length("name") <= 4, 1).when(F.length("name") <= 8, min(most, 2)).otherwise(most)
    scored = close.where(F.col("distance") <= allowed).withColumn("jw", arrow.jaro_winkler(F.col("name"), F.col("package"))).where(F.col("jw") >= similar)
    best = scored.groupBy("name").agg(F.min(F.struct(F.col("distance"), -F.col("jw"), F.col("package").alias("p"))).alias("b")).select("name", F.col("b.p").alias("similar_to"))
    out = asked.join(known.withColumnRenamed("package", "_v"), F.col("name") == F.col("_v"), "left").join(best, "name", "left")
    finding = F.when(F.col("is_url"), "SUSPICIOUS").when(F.col("_v").isNotNull(), None).when(F.col("similar_to").isNotNull(), "TYPOSQUAT").when(F.lit(strict), "UNVERIFIED")
    return out.withColumn("finding", finding).where("finding is not null").select(key, "tool", "raw", "name", "finding", F.when(F.col("finding") == "TYPOSQUAT", F.col("similar_to")).alias("similar_to"))


def leak_coverage(outputs: DataFrame, key: str, text: str, fragments: DataFrame, n: int = 8, min_hits: int = 8, min_coverage: float = 0.20, block_bytes: int = 4_000_000) -> DataFrame:
    """(key, fragment, hits, coverage): the protected fragment that an output covers most.

    Texts are compared in fingerprint form by windows of ``n`` characters; hits count the output's windows,
    coverage is hits over the fragment's distinct windows.  ``fragments`` has unique fragment and text.

    Common windows lie in most texts, so a join on windows makes a row for nearly every output and fragment.
    Instead fragments are put into blocks of about ``block_bytes``, shortest first, and outputs are counted
    against a whole block in one task.  A fragment of w windows is covered at most by the output's w most
    frequent windows over w, which falls with w: the best of the shortest block therefore bounds how long a
    better fragment can be, and only blocks of fragments that short are looked at then.  No pair is left out
    whose coverage could be as high.
    """
    from wardloom.operators.rewrite import fingerprint_form

    form = lambda c: fingerprint_form(F.col(c)).alias("_t")
    o = cut(outputs.select(F.col(key), form(text)).where(F.length("_t") >= n))
    f = fragments.select("fragment", form("text")).where(F.length("_t") >= n)
    f = cut(f.withColumn("_w", _distinct_windows(n)(F.col("_t"))).withColumn("_b", F.floor(F.log("_w") * 8).cast("int")))
    least, place = _length_blocks(f.groupBy("_b").agg(F.sum(F.length("_t")).alias("bytes"), F.min("_w").alias("least")).orderBy("_b").collect(), block_bytes)
    if not least:
        return o.select(key, *[F.lit(None).cast(t).alias(c) for c, t in (("fragment", f.schema["fragment"].dataType), ("hits", "long"), ("coverage", "double"))]).where("false")
    within = lambda i: F.element_at(F.create_map(*[F.lit(x) for b, p in place.items() for x in (b, p[i])]), F.col("_b"))
    f = f.withColumn("_f", within(0) + F.pmod(F.xxhash64("fragment"), within(1)))
    total = o.agg(F.sum(F.length("_t"))).first()[0] or 0
    across = max(total // (4 * block_bytes), min(2 * o.sparkSession.sparkContext.defaultParallelism, total * 8 // block_bytes)) + 1

    def counted(outputs: DataFrame, cells: dict[int, int]) -> DataFrame:
        """``outputs`` (with their block ``_f``) against that block, the outputs of block b in ``cells[b]`` tasks."""
        starts, at = {}, 0
        for b, k in cells.items():
            starts[b], at = at, at + k
        of = lambda d: F.element_at(F.create_map(*[F.lit(x) for b in d for x in (b, d[b])]), F.col("_f").cast("int"))
        a = outputs.withColumn("_c", of(starts) + F.pmod(F.xxhash64(key), of(cells)))
        b = f.where(F.col("_f").isin(list(cells))).withColumn("_c", F.explode(F.sequence(of(starts).cast("long"), (of(starts) + of(cells) - 1).cast("long"))))
        # a number of partitions, so that adaptive execution does not merge what is small in bytes but long in work
        a, b = (df.select(*columns, "_t", F.col("_c").cast("long")).repartition(min(at, 10_000), "_c") for df, columns in ((a, [key, "coverage"]), (b, ["fragment", "_w"])))
        shape = Y.StructType([o.schema[key], o.schema["_t"], f.schema["fragment"], Y.StructField("hits", Y.LongType()), Y.StructField("coverage", Y.DoubleType()), Y.StructField("longest", Y.LongType())])
        return a.groupBy("_c").cogroup(b.groupBy("_c")).applyInPandas(lambda x, y: _covered(x, y, key, n, min_hits, min_coverage), shape)

    found = counted(o.withColumn("coverage", F.lit(None).cast("double")).withColumn("_f", F.lit(0)), {0: across})
    if len(least) > 1:
        found = cut(found)
        reached = F.size(F.filter(F.array(*map(F.lit, least)), lambda x: x <= F.col("longest")))
        again = found.where(F.col("longest") >= least[1]).withColumn("_f", F.explode(F.sequence(F.lit(1), reached - 1)))
        cells = {r["_f"]: r["bytes"] // (4 * block_bytes) + 1 for r in again.groupBy("_f").agg(F.sum(F.length("_t")).alias("bytes")).collect()}
        if cells:
            found = found.drop("_t").unionByName(counted(again, cells).drop("_t"))
    best = found.where("fragment is not null").groupBy(key).agg(F.max(F.struct("coverage", "hits", "fragment")).alias("b"))
    return best.select(key, "b.fragment", "b.hits", "b.coverage")


def _length_blocks(levels: list, block_bytes: int) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """The least windows of each block, and each level's first block and number of blocks; ``levels`` (_b, bytes, least) are ascending."""
    least, place, room = [], {}, -1
    for r in levels:
        parts = r["bytes"] // block_bytes + 1
        if r["bytes"] <= room:
            place[r["_b"]] = (len(least) - 1, 1)
            room -= r["bytes"]
        else:
            place[r["_b"]] = (len(least), parts)
            least += [r["least"]] * parts
            room = block_bytes - r["bytes"] if parts == 1 else -1
    return least, place


def _codes(text: bytes | np.ndarray) -> np.ndarray:
    """1 to 37 for digits, letters and the blank of a fingerprint form, 0 for line feeds."""
    raw = np.frombuffer(text, dtype=np.uint8)
    return np.where(raw >= 97, raw - 86, np.where(raw >= 48, raw - 47, np.where(raw == 32, 37, 0)))


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers; by sorting, as numpy's hashing takes ten times as long on these."""
    numbers = np.sort(numbers)
    return numbers[np.r_[True, numbers[1:] != numbers[:-1]]]


def _windows(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows of texts in fingerprint form, and of each window its place among them and its text."""
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("ascii"), dtype=np.uint8)
    codes = _codes(raw)
    ids = arrow.window_ids(codes, n, 38)
    # no window has a line feed, which stands between texts
    feeds = np.cumsum(codes == 0)
    at = np.flatnonzero(feeds[n - 1 :] == np.r_[0, feeds[: len(ids) - 1]])
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[at]
    names, first, place = np.unique(ids[at], return_index=True, return_inverse=True)
    if 38**n >= 2**63:  # numbers of long windows are ranks among these texts only
        names = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, n)[at[first]]).view(f"S{n}").ravel()
    return names, place, owner


def _distinct_windows(n: int):
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(_distinct(arrow.window_ids(_codes(t.encode("ascii")), n, 38))))

    return run


def _longest(tops: np.ndarray, least: float) -> int:
    """Windows that a fragment has at most if its coverage is ``least``; ``tops`` are sums of an output's most frequent windows."""
    if least <= 0:
        return 2**62
    fit = int(np.count_nonzero(tops / np.arange(1, len(tops) + 1) >= least))
    return fit if fit < len(tops) else int(tops[-1] / least) + 1


def _covered(outputs: pd.DataFrame, fragments: pd.DataFrame, key: str, n: int, min_hits: int, min_coverage: float, chunk: int = 1_000_000) -> pd.DataFrame:
    """For each output of a block its text, the block's best fragment and the windows that a better one has at most.

    Ties by hits, then by the greater fragment: that is the last one, as fragments are sorted by windows.  An
    output with ``coverage`` looks for a fragment that is as good only.
    """
    columns = [key, "_t", "fragment", "hits", "coverage", "longest"]
    if not len(outputs):
        return pd.DataFrame([], columns=columns)
    if outputs[key].duplicated().any():
        outputs = outputs.groupby(key, dropna=False, sort=False).agg({"_t": "\n".join, "coverage": "first"}).reset_index()
    index = _Postings(fragments.sort_values(["_w", "fragment"]), n) if len(fragments) else None
    rows: list[tuple] = []
    part = (outputs["_t"].str.len().cumsum() // chunk).to_numpy()
    for _, some in outputs.groupby(part):
        names, place, owner = _windows([*some["_t"]], n)
        pairs, times = np.unique(owner * len(names) + place, return_counts=True)
        who, what = np.divmod(pairs, len(names))
        own = np.searchsorted(who, np.arange(len(some) + 1))
        met, weight, ends = index.met(names, who, what, times, len(some)) if index else (None, None, None)
        for i, (k, text, known) in enumerate(zip(some[key], some["_t"], some["coverage"], strict=True)):
            tops = np.cumsum(np.sort(times[own[i] : own[i + 1]])[::-1])
            least, best = max(min_coverage, 0.0 if pd.isna(known) else known), None
            if tops[-1] < min_hits:
                rows.append((k, text, None, None, None, 0))
                continue
            if index:
                own_met = slice(ends[i], ends[i + 1])
                best, least = index.best(met[own_met], weight[own_met], tops, least, min_hits, pd.isna(known))
            name, hits, coverage = best or (None, None, None)
            rows.append((k, text, name, hits, coverage, min(_longest(tops, least), 2**62)))
    out = pd.DataFrame(rows, columns=columns)
    out["hits"] = out["hits"].astype("Int64")
    return out


class _Postings:
    """Fragments by window.  Windows that lie in the same fragments are one class with one list of them."""

    def __init__(self, fragments: pd.DataFrame, n: int):
        self.names = fragments["fragment"].to_numpy()
        most = self.most = len(fragments)
        names, place, owner = _windows([*fragments["_t"]], n)
        self.known, rank = np.unique(names, return_inverse=True)
        window, self.posted = np.divmod(_distinct(rank[place] * most + owner), most)
        self.windows = np.bincount(self.posted, minlength=most)
        sizes = np.bincount(window, minlength=len(self.known))
        starts = np.cumsum(sizes) - sizes
        # lists of equal sums are compared in full, what differs is a class of its own
        sums = np.add.reduceat(np.random.default_rng(0).integers(0, 2**62, most)[self.posted], starts)
        _, first, self.kind = np.unique(sums, return_index=True, return_inverse=True)
        like = first[self.kind]
        there = np.minimum(np.arange(len(window)) + (starts[like] - starts)[window], len(window) - 1)
        odd = np.flatnonzero((sizes != sizes[like]) | (np.bincount(window, self.posted[there] != self.posted, minlength=len(sizes)) > 0))
        self.kind[odd] = len(first) + np.arange(len(odd))
        self.first = np.r_[first, odd]
        # where each list has come to at some sixteen numbers of fragments
        self.stops = np.unique(np.linspace(0, most, 17).astype(int)[1:])
        upto = np.bincount(window * len(self.stops) + np.searchsorted(self.stops, self.posted, "right"), minlength=len(sizes) * len(self.stops))
        self.ends = starts[self.first][:, None] + np.cumsum(upto.reshape(len(sizes), -1)[self.first], axis=1)
        self.starts = starts[self.first]

    def met(self, names: np.ndarray, who: np.ndarray, what: np.ndarray, times: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes that outputs have, how often, and where the next output's begin."""
        at = np.minimum(np.searchsorted(self.known, names), len(self.known) - 1)
        kind = np.where(self.known[at] == names, self.kind[at], -1)[what]
        hit = kind >= 0
        both, place = np.unique(who[hit] * len(self.first) + kind[hit], return_inverse=True)
        weight = np.bincount(place, times[hit], minlength=len(both))
        return both % len(self.first), weight, np.searchsorted(both, np.arange(texts + 1) * len(self.first))

    def best(self, met: np.ndarray, weight: np.ndarray, tops: np.ndarray, least: float, min_hits: int, new: bool) -> tuple[tuple | None, float]:
        """(fragment, hits, coverage) of the best fragment with that coverage, if any, and what a better one must have."""
        found, done, begin = None, 0, self.starts[met]
        while (stop := int(np.searchsorted(self.windows, _longest(tops, least), "right"))) > done and len(met):
            if new and not done:  # the shortest ones say how far to go on
                stop = min(stop, max(64, self.most // 8))
            at = int(np.searchsorted(self.stops, stop))
            stop, end = int(self.stops[at]), self.ends[met, at]
            some = np.flatnonzero(end > begin)
            if len(some):
                lists = [self.posted[a:b] for a, b in zip(begin[some].tolist(), end[some].tolist())]
                hits = np.bincount(np.concatenate(lists), np.repeat(weight[some], (end - begin)[some]), minlength=stop)[done:]
                coverage = np.where(hits >= min_hits, hits / self.windows[done:stop], -1.0)
                if (top := float(coverage.max())) >= least:
                    j = int(np.flatnonzero(coverage == top)[-1])
                    found, least = (self.names[done + j], int(hits[j]), top), top
            done, begin = stop, end
        return found, least


# Shapes of citations.
CITATIONS = {
    "legal": r"\b\d{1,4}\s+(?:F\.\d*d?|U\.S\.|S\.Ct\.|L\.Ed\.\d*d?|[A-Z][a-z]*\.App\.\d*[a-z]*|[A-Z]\.E\.\d*d?|[A-Z]\.\d*d?)\s+\d{1,5}\b",
    "medical": r"\bPMID:\s*\d{6,8}|DOI:\s*10\.\d{4,}/\S+\b",
}


def citations(df: DataFrame, key: str, text: str, corpus: DataFrame, kind: str = "legal") -> DataFrame:
    """(key, citation, status): each citation of a text, VERIFIED if some corpus text has it, else NOT_FOUND.

    ``corpus`` has a column text.  Citations of both sides are extracted and joined on equality.
    """
    take = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({CITATIONS[kind]})"), F.lit(1))))
    known = corpus.select(take(F.col("text")).alias("citation")).distinct().withColumn("_known", F.lit(True))
    cited = df.select(key, take(F.col(text)).alias("citation")).where(F.octet_length("citation") >= 5)
    return cited.join(known, "citation", "left").select(key, "citation", F.when(F.col("_known"), "VERIFIED").otherwise("NOT_FOUND").alias("status"))


def verification_metrics(checked: DataFrame, key: str, texts: DataFrame) -> DataFrame:
    """Per text: citations, verified, rate (1 without citations), and whether it is high risk or rejected."""
    counts = checked.groupBy(key).agg(F.count(F.lit(1)).alias("citations"), F.count_if(F.col("status") == "VERIFIED").alias("verified"))
    out = texts.select(key).join(counts, key, "left").na.fill(0, ["citations", "verified"])
    missing = F.when(F.col("citations") == 0, 0.0).otherwise(1 - F.col("verified") / F.col("citations"))
    return out.withColumn("missing_rate", missing).withColumn("high_risk", missing > 0.1).withColumn("rejected", missing > 0.5)


_HOST = r"([\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+)"


def domain_findings(df: DataFrame, key: str, text: str, protected: DataFrame, least: int = 5, most: int = 2, share: float = 0.34) -> DataFrame:
    """(key, domain, base, kind, target, distance): domains in a text that imitate a protected one.

    ``protected`` has unique domain.  Protected domains and what lies under them are fine.  Of the others
    the last two labels are compared: TYPOSQUAT within 1 to ``most`` edits, MIXED_SCRIPT where a label
    mixes scripts.
    """
    known = protected.select(F.lower("domain").alias("domain"))
    found = df.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_HOST), F.lit(1)))).alias("domain"))
    names = found.select("domain").distinct()
    under = names.select("domain", F.explode(T.domain_suffixes(F.col("domain"))).alias("_s")).join(known.withColumnRenamed("domain", "_s"), "_s").select("domain")
    labels = F.split("domain", r"\.")
    odd = names.join(under, "domain", "left_anti").withColumn("base", F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).where(F.length("base") >= least)
    bases = known.withColumn("target", F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1)))
    near = near_names(odd, "base", bases, "target", most, share, least)
    typo = odd.join(near, "base").select("domain", "base", F.lit("TYPOSQUAT").alias("kind"), "target", "distance")
    mixed = odd.where(~F.col("domain").rlike(r"^\p{ASCII}+$")).where(arrow.mixed_script_label(F.col("domain")))
    mixed = mixed.select("domain", "base", F.lit("MIXED_SCRIPT").alias("kind"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("int").alias("distance"))
    return found.join(typo.unionByName(mixed), "domain").select(key, "domain", "base", "kind", "target", "distance")


_CANARY = r"([a-z]+-[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"


@F.pandas_udf(Y.ArrayType(Y.IntegerType()))
def byte_positions(texts: pd.Series, tokens: pd.Series) -> pd.Series:
    """Where a token stands in a text, in bytes."""

    def one(text, token):
        data, part, out, at = text.encode(), token.encode(), [], -1
        while (at := data.find(part, at + 1)) >= 0:
            out.append(at)
        return out

    return pd.Series([one(t, k) for t, k in zip(texts, tokens, strict=True)])


def canary_hits(df: DataFrame, key: str, text: str, canaries: DataFrame) -> DataFrame:
    """(key, token, hits, positions): known canary tokens in a text, with byte positions.

    ``canaries`` has unique token (a prefix and a uuid).  Whole texts are searched, whatever their length.
    """
    seen = df.where(F.col(text).isNotNull()).select(key, text, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(_CANARY), F.lit(1)))).alias("token"))
    hits = seen.join(canaries.select("token"), "token").withColumn("positions", byte_positions(F.col(text), F.col("token")))
    return hits.select(key, "token", F.size("positions").alias("hits"), "positions")


_MARKS = {"inline": "{} [UNVERIFIED]", "strike": "~~{}~~", "remove": "", "footnote": "{}[^unverified]"}


def mark_parts(text: str, parts: list[str], style: str) -> str:
    """``text`` with each part marked where it stands as a whole, set in from right to left; of overlapping ones the longest."""
    held: list[tuple[int, int]] = []
    for part in sorted(set(parts), key=lambda p: (-len(p), p)):
        for m in re.finditer(rf"(?<!\w){re.escape(part)}(?!\w)", text):
            if all(m.end() <= a or b <= m.start() for a, b in held):
                held.append(m.span())
    for a, b in sorted(held, reverse=True):
        text = text[:a] + _MARKS[style].format(text[a:b]) + text[b:]
    return text


def annotate_citations(df: DataFrame, key: str, text: str, checked: DataFrame, style: str = "inline") -> DataFrame:
    """``df`` with citations that were not found marked in the text: inline, strike, remove, footnote."""
    if style not in _MARKS:
        raise ValueError(f"unknown style {style}")

    @F.pandas_udf("string")
    def marked(texts: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or p is None else mark_parts(t, list(p), style) for t, p in zip(texts, parts, strict=True)])

    missing = checked.where("status = 'NOT_FOUND'").groupBy(key).agg(F.collect_set("citation").alias("_c"))
    return df.join(missing, key, "left").withColumn(text, marked(F.col(text), F.col("_c"))).drop("_c")
