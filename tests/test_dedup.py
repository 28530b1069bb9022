"""Dedup against a plain walk over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from civiltext.functions.hashing import PRIME, permutations
from civiltext.operators import components, dedup, joins
from civiltext.session import cut_lineage

# Threshold -> bands and rows per band at 128 permutations.
BANDS = {
    0.20: (28, 2), 0.25: (42, 3), 0.30: (37, 3), 0.35: (32, 4), 0.40: (32, 4), 0.45: (25, 5), 0.50: (25, 5),
    0.55: (21, 6), 0.60: (18, 7), 0.65: (16, 8), 0.70: (14, 9), 0.75: (11, 11), 0.80: (9, 13), 0.85: (8, 16),
    0.90: (5, 25), 0.95: (3, 42),
}


def walk(keys: dict[int, list]) -> tuple[set[int], dict[int, int]]:
    """Kept ids and, per dropped id, the row that dropped it."""
    kept, keeper = set(), {}
    for i in sorted(keys):
        if i in keeper:
            continue
        kept.add(i)
        for j in keys:
            if j > i and j not in keeper and set(keys[i]) & set(keys[j]):
                keeper[j] = i
    return kept, keeper


def surviving(spark, keys: dict[int, list[str]]) -> set[int]:
    rows = spark.createDataFrame(list(keys.items()), "row_id BIGINT, keys ARRAY<STRING>")
    rows = cut_lineage(rows.select("row_id", F.transform("keys", lambda k: k.cast("binary")).alias("keys")))
    return {r.row_id for r in dedup.surviving(rows).collect()}


SHAPES = {
    "chain": ({1: ["x"], 2: ["x", "y"], 3: ["y"]}, {1, 3}),
    "star, centre first": ({1: ["a", "b", "c"], 2: ["a"], 3: ["b"], 4: ["c"]}, {1}),
    "star, centre last": ({9: ["a", "b", "c"], 2: ["a"], 3: ["b"], 4: ["c"]}, {2, 3, 4}),
    "ten copies": ({i: ["a", "b"] for i in range(10)}, {0}),
    "alone": ({5: ["a"], 6: ["b"]}, {5, 6}),
    "long chain": ({i: [f"{i}", f"{i + 1}"] for i in range(9)}, {0, 2, 4, 6, 8}),
}


def test_known_shapes(spark):
    keys, expected = {}, set()
    for n, (shape, kept) in enumerate(SHAPES.values()):
        keys |= {i + 100 * n: [f"{n}:{k}" for k in ks] for i, ks in shape.items()}
        expected |= {i + 100 * n for i in kept}
    assert surviving(spark, keys) == expected


@pytest.mark.parametrize("hot", [False, True])
def test_random_graphs_equal_the_walk(spark, monkeypatch, hot):
    """Many small graphs side by side; with `hot`, every shared bucket of more than two rows takes the broadcast path."""
    if hot:
        monkeypatch.setattr(joins, "ROWS_PER_TASK", 2)
    rng, keys = random.Random(1), {}
    for graph in range(60):
        n, buckets = rng.randint(2, 14), rng.randint(1, 10)
        for i in range(n):
            keys[graph * 100 + i] = [f"{graph}:{b}:{rng.randrange(buckets)}" for b in range(3)]
    assert surviving(spark, keys) == walk(keys)[0]


def test_one_bucket_with_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 50)
    rng = random.Random(2)
    keys = {i: [f"a{i % 3 and i}", f"b{rng.randrange(400)}"] for i in range(600)}
    assert surviving(spark, keys) == walk(keys)[0]


def contested(spark, keys):
    rows = spark.createDataFrame(list(keys.items()), "row_id BIGINT, keys ARRAY<STRING>")
    return cut_lineage(rows.select("row_id", F.transform("keys", lambda k: k.cast("binary")).alias("keys")))


def kept_in_parts(spark, keys, most):
    kept, rounds = dedup.greedy_kept(contested(spark, keys), most)
    return {r.row_id for r in kept.collect()}, rounds


@pytest.mark.parametrize("most, rounds", [(30_000, 1), (6_000, 6)])
def test_chain_of_ten_thousand_revisions(spark, most, rounds):
    """Each revision collides with the next: whole in one task, or in slices, never one round for two rows."""
    keys = {i: [f"{i}", f"{i + 1}"] for i in range(10_000)}
    kept, taken = kept_in_parts(spark, keys, most)
    assert kept == set(range(0, 10_000, 2)) and taken <= rounds


def test_parts_and_slices_equal_the_walk(spark):
    rng, keys = random.Random(4), {}
    for graph, n in enumerate([40, 3, 2, 25, 12, 2, 60]):
        for _ in range(n):
            keys[len(keys) * 7 % 997] = [f"{graph}:{b}:{rng.randrange(8)}" for b in range(3)]
    for most in (20, 100):
        kept, rounds = kept_in_parts(spark, keys, most)
        assert kept == walk(keys)[0] and rounds <= 2 * 3 * len(keys) / most + 2


def test_hot_bucket_takes_few_slices(spark):
    keys = {i: [f"a{i % 3 and i}", f"b{i}"] for i in range(900)}
    kept, rounds = kept_in_parts(spark, keys, 50)
    assert kept == walk(keys)[0] and rounds <= 2


@pytest.mark.parametrize("hot", [False, True])
def test_connected_parts(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(joins, "ROWS_PER_TASK", 2)
    edges = [(i, i + 1) for i in range(2000)] + [(5000, 5000 + i) for i in range(200)] + [(7001, 7000), (7000, 7002), (3, 3)]
    found, rounds = components.connected_parts(spark.createDataFrame(edges, "a bigint, b bigint"))
    parts = {r.node: r.part for r in found.collect()}
    assert parts == {**dict.fromkeys(range(2001), 0), **dict.fromkeys(range(5000, 5200), 5000), **dict.fromkeys((7000, 7001, 7002), 7000)}
    assert rounds <= 16


def test_band_plans():
    assert {t: dedup.band_plan(t) for t in BANDS} == BANDS


TEXTS = [
    "the cat sat on the mat today", "The cat sat on the mat today", "today the mat on sat cat the the", "a b c d e f g h i j",
    "a b c d e f g h i k", "a b c d e f g h k l", "", " ", "completely different words here", None,
    "a b c d e f g h i j", "the cat sat on the mat yesterday", "words here completely different",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "row_id BIGINT, text STRING")


@pytest.fixture(scope="module")
def signatures(texts):
    return {r.row_id: r.signature for r in dedup.minhash_signature(texts).collect()}


def test_signatures(signatures):
    import hashlib

    assert set(signatures) == {i for i, t in enumerate(TEXTS) if t is not None}
    for i, signature in signatures.items():
        xs = [int(hashlib.md5(t.encode()).hexdigest()[:15], 16) % PRIME for t in set(TEXTS[i].lower().split())]
        assert signature == [min([(a * x + b) % PRIME for x in xs], default=PRIME) for a, b in permutations()]


def keys_of(signatures, threshold):
    bands, rows = dedup.band_plan(threshold)
    return {i: [(b, tuple(s[b * rows:(b + 1) * rows])) for b in range(bands)] for i, s in signatures.items()}


def test_deduplicate_equals_the_walk(texts, signatures):
    for threshold in (0.5, 0.8):
        kept = walk(keys_of(signatures, threshold))[0] | {9}
        assert {r.row_id for r in dedup.deduplicate(texts, threshold).collect()} == kept


def test_sweep_equals_the_walk(texts, signatures):
    thresholds = (0.3, 0.5, 0.8, 0.95)
    for row in dedup.dedup_sweep(texts, thresholds).collect():
        kept, keeper = walk(keys_of(signatures, row.threshold))
        assert (row.dropped, row.remaining) == (len(keeper), len(TEXTS) - len(keeper))
        sims = {
            (i, j): float(np.mean(np.array(signatures[i]) == np.array(signatures[j]))) for j, i in keeper.items()
        }
        gap, i, j = min((abs(s - row.threshold), i, j) for (i, j), s in sims.items())
        assert (row.keeper, row.dropped_row) == (i, j)
        assert row.gap == pytest.approx(gap) and row.sim == pytest.approx(sims[i, j])


def test_sample_signatures_caps_at_the_population(texts):
    assert dedup.sample_signatures(texts, 4).count() <= 4
    assert dedup.sample_signatures(texts, 500).count() == len(TEXTS) - 1


@pytest.mark.parametrize("hot", [False, True])
def test_leaders_and_similarity(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(joins, "ROWS_PER_TASK", 2)
    rng = random.Random(3)
    keys = {i: [(b, f"{b}:{rng.randrange(6)}") for b in range(2)] for i in range(40)}
    table = [(i, b, k) for i, ks in keys.items() for b, k in ks]
    buckets = spark.createDataFrame(table, "row_id BIGINT, band INT, bucket STRING")
    leader = {k: min(i for i, _, other in table if other == k) for _, _, k in table}
    expected = {}
    for i, _, k in table:
        if leader[k] != i:
            expected[i, leader[k]] = expected.get((i, leader[k]), 0) + 1
    pairs = dedup.collision_leaders(buckets)
    assert {(r.row_id, r.leader): r.n_buckets for r in pairs.collect()} == expected
    values = {i: [rng.randrange(3) for _ in range(8)] for i in keys}
    signatures = spark.createDataFrame(list(values.items()), "row_id BIGINT, signature ARRAY<BIGINT>")
    for r in dedup.jaccard_estimate(pairs, signatures, 8).collect():
        assert r.sim == sum(a == b for a, b in zip(values[r.row_id], values[r.leader])) / 8


def test_signature_blocks_do_not_change_the_result(spark, monkeypatch, texts, signatures):
    monkeypatch.setattr(dedup, "BLOCK_TOKENS", 5)
    assert {r.row_id: r.signature for r in dedup.minhash_signature(texts).collect()} == signatures
