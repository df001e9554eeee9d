"""Near-duplicate texts: all pairs above a similarity, and their groups, without comparing all pairs.

Method: a MinHash LSH forest.

1.  Each distinct text gets a label of ``depth`` MinHash values in each of ``trees`` trees (:func:`labels`).
2.  A tree is the prefix trie of its labels, held as a sorted table: rows are placed by the shortest prefix
    that can ever be asked for and sorted by the rest of the label (:func:`trie_pairs`).  A walk over the
    sorted rows gives each pair of texts that share such a prefix, with the length of the prefix they share.
3.  :func:`near_duplicates` asks for the full depth first, verifies what shares it on the texts' word
    sequences, and shortens the prefix until the target recall is measured: a link of similarity ``s`` is
    found at depth ``d`` with probability ``p = 1 - (1 - s ** d) ** trees``, so the links found stand for
    the sum of ``1 / p`` links.  The shortest prefix is the one that gives a pair right at the threshold the
    target recall; there it ends in any case.

Exact copies are one node throughout; they are opened again only where pairs of rows are asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.llm.lookalike import Bigrams, bigram_counts, canonical
from wardloom.session import cut, drop

_WORD = re.compile(r"[^\W_]+").findall

TREES, DEPTH, RECALL = 50, 8, 0.999
#: Levels of a trie below the shortest prefix; each has 16 bits of a MinHash value in a label's rest.
LEVELS = 4
#: Rows of a prefix that one task pairs among themselves; a prefix with more is cut into blocks of so many.
BLOCK = 256
#: Rows of one text that meet in one task when pairs of rows are opened.
ROWS_PER_SALT = 2_000
_M64 = (1 << 64) - 1


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _WORD(text.lower())


def found_at(similarity: float, depth: int, trees: int = TREES) -> float:
    """Probability that two texts share a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def forest_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix (``depth`` at most) at which a pair right at the threshold is found with the target recall."""
    d = depth
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


class Forest:
    """Prefix keys of the signature's trees for batches of texts."""

    def __init__(self, n_words: int, trees: int, depth: int, seed: int = 20240229):
        rng = np.random.default_rng(seed)
        odd = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.n_words, self.trees, self.depth = n_words, trees, depth
        self.place = odd(n_words)
        self.a, self.b = (odd(trees * depth) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), odd(trees * depth).astype(np.uint32)
        self.join, self.tree = odd(depth), odd(trees)
        self.hashes: dict[str, int] = {}

    def _word(self, w: str) -> int:
        h = self.hashes.get(w)
        if h is None:
            if len(self.hashes) > 500_000:
                self.hashes.clear()
            h = self.hashes[w] = xxhash.xxh64_intdigest(w)
        return h

    def shingles(self, words: list[str]) -> np.ndarray:
        """64-bit hashes of the distinct word sequences (the whole text as one if it is shorter)."""
        h = np.array([self._word(w) for w in words], dtype=np.uint64)
        n = len(h) - self.n_words + 1
        if n < 1:
            h = np.concatenate([h, np.zeros(1 - n, dtype=np.uint64)])
            n = 1
        s = np.zeros(n, dtype=np.uint64)
        for i in range(self.n_words):
            s += h[i : i + n] * self.place[i]
        s ^= s >> np.uint64(29)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(32)
        return s

    def label(self, words: list[str]) -> np.ndarray:
        """The least hash of the word sequences under each of trees x depth functions."""
        s = (self.shingles(words) >> np.uint64(32)).astype(np.uint32)
        least = None
        for at in range(0, len(s), 4096):  # memory stays bounded for very long texts
            part = (s[at : at + 4096, None] * self.a + self.b).min(axis=0)
            least = part if least is None else np.minimum(least, part)
        return least

    def split(self, values: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Of labels (texts x trees x depth): a 64-bit hash of tree and first ``floor`` values, and 16 bits of each further one."""
        v = values.astype(np.uint64)
        key = (v[:, :, :floor] * self.join[:floor]).sum(axis=2, dtype=np.uint64) + self.tree
        key ^= key >> np.uint64(31)
        key *= np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(29)
        rest = np.zeros(key.shape, dtype=np.uint64)
        for level in range(floor, self.depth):
            rest = (rest << np.uint64(16)) | ((v[:, :, level] * np.uint64(0x9E3779B1) >> np.uint64(16)) & np.uint64(0xFFFF))
        return key, rest


def word_table(df: DataFrame, key: str, text: str, extra: list[str], least_words: int, bigrams: Bigrams | None = None) -> DataFrame:
    """(key, extra, words): the words of each text's canonical form, of texts with at least ``least_words``."""
    bigrams = bigrams or Bigrams(bigram_counts(df, text))

    @F.pandas_udf("string")
    def run(texts):
        def one(t):
            if t is None or len(t) < 2 * least_words - 1:
                return None
            words = words_of(canonical(t, bigrams))
            return " ".join(words) if len(words) >= least_words else None

        return texts.map(one)

    return df.select(key, *extra, run(F.col(text)).alias("words")).where(F.col("words").isNotNull())


def labels(nodes: DataFrame, n_words: int, trees: int, floor: int) -> DataFrame:
    """(k, rest, id): one row per node and tree, the label split after ``floor`` values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(n_words, trees, floor + LEVELS)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for at in range(0, len(ids), 1000):
                values = [forest.label(t.split(" ")) for t in texts[at : at + 1000]]
                key, rest = forest.split(np.stack(values).reshape(len(values), trees, floor + LEVELS), floor)
                columns = [key.ravel().view(np.int64), rest.ravel().view(np.int64), np.repeat(ids[at : at + 1000], trees)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "rest", "id"])

    return nodes.select("id", "words").mapInArrow(run, "k long, rest long, id long")


def _shared(x: np.ndarray, y: np.ndarray, floor: int) -> np.ndarray:
    """Length of the prefix that labels of one key share, from their rests."""
    odd = (x ^ y).view(np.uint64)
    return (floor + sum((odd < np.uint64(1 << 16 * level)).astype(np.int8) for level in range(1, LEVELS)) + (odd == 0)).astype(np.int8)


def _pairs(x: np.ndarray, y: np.ndarray, rest: np.ndarray, ids: np.ndarray, floor: int) -> pa.RecordBatch:
    a, b = ids[x], ids[y]
    nothing = pa.nulls(len(a), pa.int64())
    columns = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(_shared(rest[x], rest[y], floor)), nothing, nothing.cast(pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "depth", "k", "block"])


def _walk(k: np.ndarray, rest: np.ndarray, ids: np.ndarray, floor: int, block: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the rows of each key, which stand together and are at most ``block`` each."""
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    size = np.diff(np.r_[first, len(k)])
    for n in np.unique(size[size > 1]):
        x, y = np.triu_indices(int(n), 1)
        runs = first[size == n]
        step = max(1, 500_000 // len(x))
        for at in range(0, len(runs), step):
            base = runs[at : at + step, None]
            yield _pairs((base + x).ravel(), (base + y).ravel(), rest, ids, floor)


def trie_pairs(rows: DataFrame, floor: int, block: int = BLOCK) -> DataFrame:
    """(a, b, depth), a < b: nodes that share at least ``floor`` values in a tree, and how many at most.

    ``rows`` is of :func:`labels`.  They are shuffled once, by the shortest prefix, and sorted by the label:
    each task holds whole tries as sorted rows and reads them as a stream.  The rows of a prefix that more
    than ``block`` nodes have are not paired there: they go on as blocks of sorted rows, and each two blocks
    of a prefix are paired by a task of their own.  No pair is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        hot, count = None, 0

        def spill(part: list[np.ndarray], start: int) -> pa.RecordBatch:
            at = (start + np.arange(len(part[0]))) // block
            return pa.RecordBatch.from_arrays([pa.array(part[2]), pa.array(part[1]), pa.nulls(len(at), pa.int8()), pa.array(part[0]), pa.array(at.astype(np.int32))], names=["a", "b", "depth", "k", "block"])

        for batch in batches:
            now = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
            if not len(now[0]):
                continue
            first = np.flatnonzero(np.r_[True, now[0][1:] != now[0][:-1]])
            size = np.diff(np.r_[first, len(now[0])])
            small = np.ones(len(now[0]), bool)
            for at, n in zip(first[(size > block) | (now[0][first] == hot)], size[(size > block) | (now[0][first] == hot)], strict=True):
                part = [c[at : at + n] for c in now]
                count = count if part[0][0] == hot else 0
                yield spill(part, count)
                hot, count = part[0][0], count + n
                small[at : at + n] = False
            # the last key may go on in the next batch
            tail = first[-1] if small[-1] else len(now[0])
            held = [c[tail:] for c in now]
            small[tail:] = False
            yield from _walk(*(c[small] for c in now), floor, block)
        yield from _walk(*held, floor, block)

    sorted_ = rows.repartition("k").sortWithinPartitions("k", "rest", "id")
    found = cut(sorted_.mapInArrow(run, "a long, b long, depth tinyint, k long, block int"))
    blocks = found.where("block is not null").select("k", "block", F.col("a").alias("id"), F.col("b").alias("rest"))
    most = blocks.groupBy("k").agg((F.max("block") + 1).alias("n"))
    cells = blocks.join(most, "k").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cells = cells.select("k", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "rest")

    def cell(key: tuple, part: pa.Table) -> pa.Table:
        _, i, j = (x.as_py() for x in key)
        own, ids, rest = (part.column(c).to_numpy() for c in ("block", "id", "rest"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if i == j:
            x, y = (left[t] for t in np.triu_indices(len(left), 1))
        else:
            x, y = np.repeat(left, len(right)), np.tile(right, len(left))
        return pa.Table.from_batches([_pairs(x, y, rest, ids, floor)]).select(["a", "b", "depth"])

    crowded = cells.groupBy("k", "i", "j").applyInArrow(cell, "a long, b long, depth tinyint")
    all_ = found.where("block is null").select("a", "b", "depth").unionByName(crowded)
    return all_.groupBy("a", "b").agg(F.max("depth").alias("depth"))


def verify(pairs: DataFrame, nodes: DataFrame, n_words: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose distinct word sequences overlap by at least ``threshold``, exactly counted."""

    def grams(text: str) -> set:
        w = text.split(" ")
        return set(zip(*(w[i:] for i in range(n_words)), strict=False)) or {tuple(w)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            shares, last, held = [], None, set()
            for i in range(len(a)):
                if a[i] != last:
                    last, held = a[i], grams(ta[i])
                other = grams(tb[i])
                both = len(held & other)
                shares.append(both / (len(held) + len(other) - both))
            similarity = np.array(shares)
            mask = pa.array(similarity >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(similarity).filter(mask)], names=["a", "b", "similarity"])

    texts_b = nodes.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    texts_a = nodes.select(F.col("id").alias("a"), F.col("words").alias("wa"))
    return pairs.join(texts_b, "b").join(texts_a, "a").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long, similarity double")


def recall_at(counts: dict[float, int], seen: int, depth: int, trees: int, threshold: float) -> float:
    """Share of all links that prefixes of ``depth`` values find, measured on the links that those of ``seen`` values found.

    ``counts`` has the number of links per similarity.  Each link found stands for as many as its chance to
    be found makes likely.  One link right at the threshold is added, so that few links do not count as proof.
    """
    all_ = {s: n / found_at(s, seen, trees) for s, n in counts.items()}
    all_[threshold] = all_.get(threshold, 0.0) + 1
    return sum(n * found_at(s, depth, trees) for s, n in all_.items()) / sum(all_.values())


def near_duplicates(table: DataFrame, key: str, n_words: int = 5, threshold: float = 0.8, trees: int = TREES, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(members, links) of a :func:`word_table` whose ``key`` is a unique long.

    ``members`` has key and ``node``: equal word sequences share the node, the least key among them.
    ``links`` has (a, b, similarity), a < b: the pairs of nodes that share at least ``threshold`` of their
    distinct sequences of ``n_words`` words.  No partner, bucket or candidate is capped.
    """
    floor = forest_depth(threshold, trees, 64, recall)
    digest = F.unhex(F.md5(F.col("words").cast("binary")))
    table = table.withColumn("d", digest)
    node = table.groupBy("d").agg(F.min(key).alias("node"))
    members = cut(table.select(key, "d").join(node, "d").select(key, "node"))
    nodes = cut(table.join(members.where(F.col(key) == F.col("node")).select(key), key, "left_semi").select(F.col(key).alias("id"), "words"))
    pairs = cut(trie_pairs(labels(nodes, n_words, trees, floor), floor))
    depth, asked, links = floor + LEVELS, 127, None
    while True:
        new = cut(verify(pairs.where((F.col("depth") >= depth) & (F.col("depth") < asked)).select("a", "b"), nodes, n_words, threshold))
        links = new if links is None else links.unionByName(new)
        counts = {r.s: r.n for r in links.groupBy(F.round("similarity", 2).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
        if depth == floor or recall_at(counts, depth, depth, trees, threshold) >= recall:
            return members, links
        asked = depth
        depth = next((d for d in range(depth - 1, floor, -1) if recall_at(counts, depth, d, trees, threshold) >= recall), floor)


def row_pairs(members: DataFrame, links: DataFrame, key: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(``key``_a, ``key``_b), a < b: the links opened to all pairs of rows, exact copies included.

    The rows of a node are dealt to salts of about ``rows_per_salt`` rows; two salts meet in a task of their own.
    """
    m = members.select(F.col(key).alias("k"), "node")
    salts = m.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / rows_per_salt).cast("int").alias("salts"), F.count(F.lit(1)).alias("n"))
    rows = m.join(salts, "node").withColumn("salt", F.pmod(F.xxhash64("k"), F.col("salts").cast("long")).cast("int"))
    within = salts.where("n > 1").select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("salts").alias("sa"), F.col("salts").alias("sb"))
    across = links.select("a", "b").join(salts.select(F.col("node").alias("a"), F.col("salts").alias("sa")), "a").join(salts.select(F.col("node").alias("b"), F.col("salts").alias("sb")), "b")
    cells = across.select("a", "b", "sa", "sb").unionByName(within)
    cells = cells.withColumn("ta", F.explode(F.sequence(F.lit(0), F.col("sa") - 1))).withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("sb") - 1)))
    left = rows.select(F.col("node").alias("a"), F.col("salt").alias("ta"), F.col("k").alias("ka"))
    right = rows.select(F.col("node").alias("b"), F.col("salt").alias("tb"), F.col("k").alias("kb"))
    met = cells.join(left, ["a", "ta"]).join(right, ["b", "tb"]).where("a <> b or ka < kb")
    return met.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b"))


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, root): connected components of undirected links, the root being the least id.

    Large-star and small-star rounds over tables in the shared folder until a round changes nothing; a
    hub's neighbours meet it by a grouped minimum, never as one list.  Ids without a link do not appear.
    """
    edges = cut(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(least, "u")
        if large:
            moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    mark = None
    for _ in range(most_rounds):
        before, edges = edges, cut(star(star(edges, True), False))
        drop(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def groups(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(key, group, copies, links): the group of each row that has a near duplicate or an exact copy.

    The group is the least key in it; ``copies`` are the rows of the same text, ``links`` the other rows that
    the row is linked to, exact copies included.
    """
    root = components(links)
    sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    both = links.select(F.col("a").alias("node"), F.col("b").alias("peer")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("peer")))
    linked = both.join(sizes.select(F.col("node").alias("peer"), F.col("copies").alias("c")), "peer").groupBy("node").agg(F.sum("c").alias("linked"))
    all_ = members.join(sizes.join(linked, "node", "left"), "node").join(root.withColumnRenamed("id", "node"), "node", "left")
    count = F.coalesce("linked", F.lit(0)) + F.col("copies") - 1
    return all_.where("copies > 1 or root is not null").select(key, F.coalesce("root", "node").alias("group"), "copies", count.alias("links"))
