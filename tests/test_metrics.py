import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from civiltext.operators import compare, evaluation, metrics, profile

# Published counts with precision, recall and F1.
PUBLISHED = [
    ((68_041, 5_553, 3_116, 15_351), (0.7343570608495982, 0.8312665836356744, 0.7798125523862741)),
    ((72_428, 1_166, 6_650, 11_817), (0.9102, 0.6399, 0.7515)),
    ((70_453, 3_141, 5_092, 13_375), (0.8098, 0.7243, 0.7647)),
    ((72_494, 1_100, 1_415, 17_052), (0.9394, 0.9234, 0.9313)),
    ((72_567, 1_027, 1_462, 17_005), (0.9430, 0.9208, 0.9318)),
]


def scored(spark, pairs):
    rows = [(i, int(y), float(p)) for i, (y, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "row_id BIGINT, y INT, p_toxic DOUBLE")


def random_scores(n, seed, levels=None):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = np.clip(rng.random(n) * 0.7 + 0.3 * y, 0, 1)
    return list(zip(y, np.round(p * levels) / levels if levels else p))


def average_precision(pairs):
    y, p = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
    area = 0.0
    for score in sorted(set(p), reverse=True):
        said = p >= score
        area += (y[p == score].sum() / y.sum()) * (y[said].sum() / said.sum())
    return area


def test_published_counts(spark):
    counts = spark.createDataFrame([c for c, _ in PUBLISHED], "tn BIGINT, fp BIGINT, fn BIGINT, tp BIGINT")
    for row, (c, expected) in zip(metrics.with_quality(counts).collect(), PUBLISHED):
        assert sum(c) == 92_061 and c[2] + c[3] == 18_467
        assert (row.precision, row.recall, row.f1_score) == pytest.approx(expected, abs=5e-5)


def test_degenerate_counts(spark):
    only_safe = scored(spark, [(0, 0.1), (0, 0.2)]).withColumn("pred", metrics.predict_default())
    row = metrics.quality(only_safe).first()
    assert row.asDict() == {"tn": 2, "fp": 0, "fn": 0, "tp": 0, "precision": 0.0, "recall": 0.0, "f1_score": 0.0}
    assert metrics.pr_auc(scored(spark, [(0, 0.4)])).first()[0] == 0.0


def test_strict_default_and_inclusive_tuned_threshold(spark):
    row = scored(spark, [(1, 0.5)]).select(
        metrics.predict_default().alias("a"), metrics.predict_at(0.5).alias("b")
    ).first()
    assert (row.a, row.b) == (0, 1)


@pytest.mark.parametrize("levels", [None, 10, 1])
def test_average_precision(spark, levels):
    pairs = random_scores(700, 3, levels)
    got = metrics.pr_auc(scored(spark, pairs), scores_per_slice=20).first()[0]
    assert got == pytest.approx(average_precision(pairs), abs=1e-12)


def test_average_precision_of_equal_scores_is_the_positive_share(spark):
    assert metrics.pr_auc(scored(spark, [(1, 0.3), (0, 0.3), (0, 0.3), (1, 0.3)])).first()[0] == 0.5


def test_threshold_sweep(spark):
    grid = np.arange(0.10, 0.91, 0.01)
    pairs = random_scores(300, 5, 100) + [(i % 2, t) for i, t in enumerate(grid)]
    rows = metrics.threshold_sweep(scored(spark, pairs)).orderBy("threshold").collect()
    assert [r.threshold for r in rows] == list(grid)
    y, p = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
    for row in rows:
        said = p >= row.threshold
        assert (row.tp, row.fp) == ((said & (y == 1)).sum(), (said & (y == 0)).sum())
        assert (row.tn, row.fn) == ((~said & (y == 0)).sum(), (~said & (y == 1)).sum())
    best = metrics.best_threshold(metrics.threshold_sweep(scored(spark, pairs))).first()
    assert best.threshold == min(r.threshold for r in rows if r.f1_score == max(r.f1_score for r in rows))


def test_tuned_metrics_equal_quality_at_the_threshold(spark):
    val, test = scored(spark, random_scores(200, 7, 50)), scored(spark, random_scores(200, 8, 50))
    tuned = metrics.tuned_metrics(val, test).first()
    plain = metrics.quality(test.withColumn("pred", metrics.predict_at(tuned.threshold))).first()
    assert (tuned.tp, tuned.fp, tuned.f1_score) == (plain.tp, plain.fp, plain.f1_score)
    block = evaluation.evaluate_scores(val, test).first()
    assert block.best_threshold == tuned.threshold
    assert block.confusion_matrix_tuned == [[tuned.tn, tuned.fp], [tuned.fn, tuned.tp]]


def test_compare_keeps_missing_sides_as_null(spark):
    rows = [("base", "f1_score", 0.75), ("new", "f1_score", 0.80), ("base", "pr_auc", 0.9)]
    table = compare.compare(spark.createDataFrame(rows, "variant STRING, metric STRING, value DOUBLE"), "base", "new")
    got = {r.metric: (r.base, r.new, r.new_delta) for r in table.collect()}
    assert got["f1_score"] == (0.75, 0.80, pytest.approx(0.05)) and got["pr_auc"] == (0.9, None, None)


def test_pareto_front(spark):
    rows = [("fast", 0.76, 0.009), ("slow", 0.93, 3.58), ("middle", 0.75, 3.27), ("twin", 0.76, 0.009), ("worse", 0.76, 0.01)]
    models = spark.createDataFrame(rows, "model STRING, f1_score DOUBLE, ms_per_sample DOUBLE")
    assert {r.model for r in compare.pareto_front(models).collect()} == {"fast", "slow", "twin"}


def test_front_of_many_costs_in_ranges(spark):
    rng = random.Random(3)
    rows = [(str(i), rng.choice([None, rng.randrange(40) / 4 + k / 40, 5.0]), None if i == 7 else float(k)) for i in range(300) for k in [rng.randrange(60)]]
    models = spark.createDataFrame(rows, "model STRING, f1_score DOUBLE, ms_per_sample DOUBLE")
    there = [r for r in rows if r[1] is not None and r[2] is not None]
    lowest = max((q for _, q, c in rows if c is None and q is not None), default=float("-inf"))
    expected = {m for m, q, c in there if q > lowest and not any(q2 >= q and c2 <= c and (q2 > q or c2 < c) for _, q2, c2 in there)}
    front = compare.pareto_front(models)
    assert {r.model for r in front.collect()} == expected
    assert "SinglePartition" not in compare._running_records(models.groupBy("ms_per_sample").agg(F.max("f1_score").alias("top")), "ms_per_sample")\
        ._jdf.queryExecution().executedPlan().toString().split("Window")[1].split("BroadcastExchange")[0]


def test_cached_experiment_runs_once(spark):
    calls, done = [], []
    for _ in range(2):
        compare.cached_experiment(lambda: bool(done), lambda: spark.range(1), lambda: (calls.append(1), done.append(1)))
    assert calls == [1]


def test_histogram_like_numpy(spark):
    values = [0.0, 1, 1, 2, 3, 3, 3, 10, 10, 7.5]
    df = spark.createDataFrame([(float(v),) for v in values], "x DOUBLE")
    counts, edges = np.histogram(values, bins=7)
    rows = profile.histogram(df, F.col("x"), 7).orderBy("bin").collect()
    assert [r.n for r in rows] == list(counts)
    assert [r.lower for r in rows] + [rows[-1].upper] == pytest.approx(list(edges))
    flat = spark.createDataFrame([(4.0,), (4.0,)], "x DOUBLE")
    assert [r.n for r in profile.histogram(flat, F.col("x"), 4).orderBy("bin").collect()] == list(np.histogram([4, 4], 4)[0])


def test_rule_impact_without_matches_has_no_example(spark):
    df = spark.createDataFrame([(1, "plain"), (2, "a  b"), (3, "c  d")], "row_id BIGINT, text STRING")
    rows = {r.rule: r for r in profile.rule_impact(df).collect()}
    assert (rows["html"].n_probe, rows["html"].n_changed, rows["html"].example_before) == (0, 0, None)
    assert (rows["whitespace"].n_changed, rows["whitespace"].example_before) == (2, "a  b")
