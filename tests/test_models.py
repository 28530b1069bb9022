import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import CountVectorizerModel, PCAModel
from pyspark.sql import functions as F

from civiltext.operators import classifiers, cleaning, compare, evaluation, features
from civiltext.operators.sampling import make_splits
from civiltext.plans import models
from civiltext.sources import artifacts
from civiltext.streaming.screening import screen

SF_DIR = "/root/testdata/sf0.001"
WORDS = "calm sunny happy river garden awful stupid hate idiot trash some other common words here".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        toxic = int(i % 3 == 0)
        pool = WORDS[5:] if toxic else WORDS[:5] + WORDS[10:]
        rows.append((i, " ".join(rng.choice(pool, 8)), toxic))
    return spark.createDataFrame(rows, "row_id BIGINT, text STRING, y INT").cache()


@pytest.fixture(scope="module")
def splits(corpus):
    return make_splits(corpus).cache()


@pytest.fixture(scope="module")
def model(splits):
    return classifiers.logreg_fit(splits.filter("split = 'train'"), min_df=2, max_df=0.9)


def test_tfidf_equals_a_plain_computation(corpus):
    texts = {r.row_id: r.text for r in corpus.collect()}
    docs = {}
    for i, text in texts.items():
        words = text.lower().split()
        docs[i] = Counter(words + [" ".join(p) for p in zip(words, words[1:])])
    df, tf = Counter(), Counter()
    for counts in docs.values():
        df.update(counts.keys())
        tf.update(counts)
    kept = [t for t in tf if 5 <= df[t] <= 0.8 * len(docs)]
    vocab = sorted(kept, key=lambda t: (-tf[t], t))[:40]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in vocab}
    expected = {}
    for i, counts in docs.items():
        weights = {t: n * idf[t] for t, n in counts.items() if t in idf}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        expected |= {(i, t): w / norm for t, w in weights.items()}
    fitted = features.fit_tfidf(corpus, max_features=40)
    assert next(s for s in fitted.stages if isinstance(s, CountVectorizerModel)).vocabulary == vocab
    got = {(r.row_id, r.term): r.weight for r in features.tfidf_rows(corpus, fitted).collect()}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k]) for k in got)


def test_empty_vocabulary_is_an_error(corpus):
    with pytest.raises(ValueError):
        features.fit_tfidf(corpus, min_df=10_000)


def test_untrained_model_is_an_error(corpus):
    with pytest.raises(ValueError):
        classifiers.predict(None, corpus)
    with pytest.raises(ValueError):
        classifiers.fit("unknown", corpus)


def test_logreg_reaches_its_optimum(splits):
    """The gradient of 0.5 |w|^2 + C sum(loss) vanishes at the fitted weights."""
    train = splits.filter("split = 'train'")
    fitted = classifiers.logreg_fit(train, min_df=2, max_df=0.9, tol=1e-10)
    regression = next(s for s in fitted.stages if hasattr(s, "coefficients"))
    vectors = features.fit_tfidf(train, min_df=2, max_df=0.9).transform(train).select("y", "features").collect()
    x, y = np.array([r.features.toArray() for r in vectors]), np.array([r.y for r in vectors])
    w = regression.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + regression.intercept)))
    assert np.abs(w + x.T @ (p - y)).max() < 1e-3 and abs((p - y).sum()) < 1e-3


def test_a_fit_stopped_early_is_not_flat(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are not here")
    for weighted in (False, True):
        assert [r.flat for r in models._gradient(spark, SF_DIR, weighted, max_iter=15).collect()] == [False]


def test_directions_are_those_of_the_term_matrix(splits):
    train = splits.filter("split = 'train'")
    model = classifiers.dense_fit(train, vector_size=3, max_iter=3, min_df=2, max_df=0.9)
    x = np.array([r.features.toArray() for r in features.fit_tfidf(train, max_features=2000, min_df=2, max_df=0.9).transform(train).collect()])
    _, _, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    pc = next(s for s in model.stages if isinstance(s, PCAModel)).pc.toArray()
    assert np.abs(np.abs((pc * v[:3].T).sum(axis=0)) - 1).max() < 1e-6


@pytest.mark.parametrize("kind", ["dense", "dense_subset"])
def test_dense_models_separate_and_are_saved(kind, splits, path):
    model = classifiers.fit(kind, splits.filter("split = 'train'"), vector_size=8, hidden=6, min_df=2, max_df=0.9)
    rows = classifiers.predict_proba(model, splits).collect()
    assert np.mean([(r.p_toxic > 0.5) == r.y for r in rows]) > 0.9
    artifacts.save_model(model, path(kind))
    again = {r.row_id: r.p_toxic for r in classifiers.predict_proba(artifacts.load_model(path(kind)), splits).collect()}
    assert again == {r.row_id: r.p_toxic for r in rows}


def test_throughput_counts_what_it_scores(model, splits):
    runs = evaluation.timed_runs(model, splits.filter("split = 'test'"), 3, "m")
    [row] = evaluation.throughput(runs).collect()
    assert (row.rows, row.passes) == (3 * splits.filter("split = 'test'").count(), 3) and row.rows_per_second > 0


def test_scores_and_strict_label(model, splits):
    rows = classifiers.predict_proba(model, splits).collect()
    assert all(r.p_safe + r.p_toxic == pytest.approx(1) for r in rows)
    labels = {r.row_id: r.pred for r in classifiers.predict(model, splits).collect()}
    assert labels == {r.row_id: int(r.p_toxic > 0.5) for r in rows}
    assert np.mean([labels[r.row_id] == r.y for r in rows]) > 0.9


def test_array_scores_equal_the_stages(spark, model, corpus):
    odd = [(500, "", 0), (501, "no term of it", 0), (502, "Awful awful STUPID, awful", 1), (503, "calm\nsunny x calm sunny", 0)]
    rows = corpus.unionByName(spark.createDataFrame(odd, corpus.schema)).repartition(3)
    staged = {r.row_id: r.probability[1] for r in model.transform(rows).select("row_id", "probability").collect()}
    own = {r.row_id: r.p_toxic for r in classifiers.predict_proba(model, rows).collect()}
    assert own.keys() == staged.keys() and all(own[i] == pytest.approx(staged[i], abs=1e-9) for i in own)
    missing = rows.select("row_id", F.lit(None).cast("string").alias("text"))
    assert {r.p_toxic for r in classifiers.predict_proba(model, missing).collect()} == {None}


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan_and_models_run_once(spark, model, corpus, path):
    corpus.withColumn("source", F.lit("web")).write.parquet(path("rows"))
    rows = spark.read.parquet(path("rows"))
    assert "EqualTo(source,web)" in executed(classifiers.predict_proba(model, rows).filter("source = 'web' AND p_toxic > 0.5"))
    assert "EqualTo(source,web)" in executed(cleaning.clean_text(rows).filter("source = 'web'"))
    for scored in (classifiers.predict(model, rows), classifiers.score_batches(rows, lambda: lambda texts: np.zeros((len(texts), 2), "float32"))):
        assert executed(scored.filter("pred = 1")).count("EvalPython") == 1


def test_external_linear_scorer_equals_the_model(model, splits):
    vocab = next(s for s in model.stages if isinstance(s, CountVectorizerModel)).vocabulary
    idf = next(s for s in model.stages if hasattr(s, "getScalingVec")).getScalingVec().toArray()
    regression = next(s for s in model.stages if hasattr(s, "coefficients"))
    weights, bias = regression.coefficients.toArray(), float(regression.intercept)

    def load():
        position = {t: i for i, t in enumerate(vocab)}

        def score(texts):
            out = []
            for text in texts.ravel():
                words = text.lower().split()
                v = np.zeros(len(vocab))
                for term in words + [" ".join(p) for p in zip(words, words[1:])]:
                    if term in position:
                        v[position[term]] += 1
                v *= idf
                v /= max(np.linalg.norm(v), 1e-300)
                out.append([0.0, v @ weights + bias])
            return np.array(out, dtype="float32")

        return score

    external = {r.row_id: r.p_toxic for r in classifiers.score_batches(splits, load).collect()}
    own = {r.row_id: r.p_toxic for r in classifiers.predict_proba(model, splits).collect()}
    assert all(external[i] == pytest.approx(own[i], abs=1e-5) for i in own)


def test_evaluate_model_has_every_block(spark, model, splits, path):
    assert not artifacts.has_results(spark, path("results"))
    artifacts.write_results(evaluation.evaluate_model(spark, model, splits, runs=2), path("results"))
    assert artifacts.has_results(spark, path("results"))
    row = artifacts.read_results(spark, path("results")).first()
    assert sum(map(sum, row.confusion_matrix)) == splits.filter("split = 'test'").count()
    assert row.throughput_samples_per_sec > 0 and row.latency.latency_min_ms <= row.latency.latency_max_ms
    assert 0.1 <= row.best_threshold <= 0.9


def test_class_weights_favour_the_rare_class(corpus):
    weights = {r.y: r.weight for r in classifiers.class_weights(corpus).collect()}
    assert weights == {0: pytest.approx(120 / (2 * 80)), 1: pytest.approx(120 / (2 * 40))}
    rows = classifiers.with_class_weights(corpus).groupBy("y").agg(F.first("weight").alias("w")).collect()
    assert {r.y: r.w for r in rows} == weights


def test_routing_scores_only_unsure_rows_again(model, splits):
    routed = classifiers.route_ensemble(splits, model, model, 0.4, 0.6).collect()
    assert len(routed) == 120
    assert all((r.scored_by == "costly") == (0.4 <= r.p_toxic <= 0.6) for r in routed)


def test_stress_variants_and_metrics(model, splits):
    test = splits.filter("split = 'test'")
    rows = {r.variant: r for r in evaluation.clean_vs_stress(model, compare.stress_variants(test)).collect()}
    assert set(rows) == {"clean", "obfuscated", "deobfuscated"}
    assert rows["clean"].f1_score >= rows["obfuscated"].f1_score


def test_screening_a_stream_equals_the_batch(spark, model, corpus, path):
    texts = corpus.select("row_id", F.concat(F.lit("<b>"), "text", F.lit("</b>")).alias("text"))
    texts.write.parquet(path("in"))
    stream = screen(spark.readStream.schema(texts.schema).parquet(path("in")), model, 0.5)
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", path("state"))
        .trigger(availableNow=True).start(path("out"))
    )
    assert query.awaitTermination(60)
    got = {r.row_id: r.pred for r in spark.read.parquet(path("out")).collect()}
    assert got == {r.row_id: r.pred for r in screen(texts, model, 0.5).collect()} and len(got) == 120
