"""Near-duplicate groups against brute force."""

import random

import numpy as np

from wardloom.llm import neardup as N
from wardloom.llm.lookalike import Bigrams


def grams(words, n):
    return set(zip(*(words[i:] for i in range(n)), strict=False)) or {tuple(words)}


def corpus(seed=5, families=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.randint(45, 80))
        for _ in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            k += 1
            rows.append((k, " ".join(words)))
    return rows


def test_all_pairs_above_the_threshold(spark):
    rows = corpus() + [(900, None), (901, ""), (902, "too short")]
    df = spark.createDataFrame(rows, "event_id long, p string")
    table = N.word_table(df, "event_id", "p", [], 40, Bigrams({}))
    members, links = N.near_duplicates(table, "event_id", 3, 0.6)
    got = sorted(map(tuple, N.row_pairs(members, links, "event_id").collect()))
    sets = {k: grams(t.split(), 3) for k, t in rows if t and len(t.split()) >= 40}
    want = sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]))
    assert got == want and len(want) > 20
    groups = {r.event_id: r.group for r in N.groups(members, links, "event_id").collect()}
    assert set(groups) == {x for p in want for x in p}
    assert all(groups[a] == groups[b] for a, b in want)


def test_components_of_a_path_a_hub_and_a_pair(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 499), (7, 7)]
    got = {r.id: r.root for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{100 + i: 100 for i in range(30)}, 499: 499, 500: 499}


def test_depth_keeps_the_recall():
    for s in (0.5, 0.6, 0.8, 0.95):
        d = N.forest_depth(s)
        assert d == 1 or 1 - (1 - s**d) ** N.TREES >= N.RECALL
        assert d == N.DEPTH or 1 - (1 - s ** (d + 1)) ** N.TREES < N.RECALL


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "event_id long, p string")
    table = N.word_table(empty, "event_id", "p", [], 40, Bigrams({}))
    members, links = N.near_duplicates(table, "event_id", 3, 0.6)
    assert N.row_pairs(members, links, "event_id").count() == 0
    copies = spark.createDataFrame([(i, "a b c d e f") for i in range(5)], "event_id long, p string")
    members, links = N.near_duplicates(N.word_table(copies, "event_id", "p", [], 1, Bigrams({})), "event_id")
    assert N.row_pairs(members, links, "event_id").count() == 10 and links.count() == 0


def test_a_crowded_prefix_loses_no_pair(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        words[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(words)))
    nodes = spark.createDataFrame(rows, "id long, words string")
    floor = N.forest_depth(0.6, 20, 64)
    labels = N.labels(nodes, 3, 20, floor)
    want = {tuple(r) for r in N.trie_pairs(labels, floor).collect()}
    assert {tuple(r) for r in N.trie_pairs(labels, floor, block=7).collect()} == want and len(want) > 1000


def test_pairs_share_the_prefix_that_is_said(spark):
    rows = corpus(seed=8)
    nodes = spark.createDataFrame(rows, "id long, words string")
    floor, forest = 2, N.Forest(3, 10, 2 + N.LEVELS)
    label = {i: forest.label(t.split()).reshape(10, -1) for i, t in rows}
    want = {}
    for a in label:
        for b in label:
            shared = max(int((np.cumprod(x == y)).sum()) for x, y in zip(label[a], label[b], strict=True))
            if a < b and shared >= floor:
                want[a, b] = shared
    assert {(r.a, r.b): r.depth for r in N.trie_pairs(N.labels(nodes, 3, 10, floor), floor).collect()} == want


def test_the_prefix_is_shortened_until_the_recall_is_measured():
    assert N.recall_at({1.0: 10_000}, 8, 8, 50, 0.6) > 0.999  # nothing but close copies: the full depth finds them
    assert N.recall_at({0.6: 1000}, 8, 8, 50, 0.6) < 0.6 < 0.999 < N.recall_at({0.6: 1000}, 8, 4, 50, 0.6)
    assert N.recall_at({}, 8, 8, 50, 0.6) < 0.6  # no link yet is no proof of recall


def test_at_the_full_depth_alone_links_are_missing(spark):
    """Without the shortening the result differs: most links here lie right above the threshold."""
    rng, rows = random.Random(3), []
    for family in range(60):
        base = [f"v{family}x{i}" for i in range(60)]
        other = list(base)
        for i in range(5):
            other[6 + 11 * i] = f"y{family}x{i}"
        rows += [(2 * family, " ".join(base)), (2 * family + 1, " ".join(other))]
    table = spark.createDataFrame(rows, "event_id long, words string")
    _, links = N.near_duplicates(table, "event_id", 3, 0.58)
    assert {(r.a, r.b) for r in links.collect()} == {(2 * f, 2 * f + 1) for f in range(60)}
    floor = N.forest_depth(0.58, N.TREES, 64)
    pairs = N.trie_pairs(N.labels(table.withColumnRenamed("event_id", "id"), 3, N.TREES, floor), floor)
    assert pairs.where(f"depth >= {floor + N.LEVELS}").count() < 55


def test_copies_of_one_text_are_paired_in_salts(spark):
    copies = spark.createDataFrame([(i, 0 if i < 9 else i) for i in range(12)], "event_id long, node long")
    links = spark.createDataFrame([(0, 9, 0.7)], "a long, b long, similarity double")
    got = sorted(map(tuple, N.row_pairs(copies, links, "event_id", rows_per_salt=2).collect()))
    assert got == sorted([(a, b) for a in range(9) for b in range(a + 1, 9)] + [(a, 9) for a in range(9)])
    rows = {r.event_id: (r.copies, r.links) for r in N.groups(copies, links, "event_id").collect()}
    assert rows == {**{i: (9, 9) for i in range(9)}, 9: (1, 9)}
