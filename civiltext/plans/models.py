"""Features, training, scoring and model files."""

from __future__ import annotations

import hashlib

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel, MultilayerPerceptronClassificationModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import CountVectorizerModel, PCAModel
from pyspark.ml.linalg import Matrices, Vectors
from pyspark.sql import functions as F

from civiltext.functions import text as rules
from civiltext.operators import classifiers, compare, dedup, evaluation, features, metrics, sampling
from civiltext.operators.joins import sifted
from civiltext.plans import cleaning, inputs
from civiltext.plans import metrics as scores_sql
from civiltext.plans.inputs import hash_sql, with_ctes
from civiltext.plans.sampling import BALANCED_CTES
from civiltext.session import scratch_path
from civiltext.sources import artifacts

FIXED_BIAS = 0.25
DENSE, HIDDEN, DENSE_SUBSET = 4, 3, 150
DENSE_WEIGHTS = [(j * 37 % 41 - 20) / 10 for j in range((DENSE + 1) * HIDDEN + (HIDDEN + 1) * 2)]  # of the fixed perceptron
TIGHT = 1e-7  # tolerance of the fits whose gradient is looked at
FLAT = 5e-5  # largest entry of the gradient per row at which a fit counts as converged
MIN_DF = 2  # the labelled part of the small tables has few rows


def _train(spark, sf_dir):
    return inputs.splits(spark, sf_dir).filter("split = 'train'")


def _held_out(spark, sf_dir):
    return inputs.splits(spark, sf_dir).filter("split <> 'train'")


def tfidf_terms(spark, sf_dir):
    """Per row the number of words and pairs, and a digest of them in order."""
    terms = features.tfidf_tokens(inputs.documents(spark, sf_dir))
    return terms.select(
        "row_id", F.size("terms").cast("bigint").alias("n_terms"), F.md5(F.array_join("terms", "|")).alias("terms_md5")
    )


def vocabulary(spark, sf_dir):
    vocab = features.vocabulary(features.tfidf_tokens(inputs.documents(spark, sf_dir)))
    return vocab.select("term", "df", "tf", F.round("idf", 6).alias("idf"))


def tfidf_weights(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir)
    return features.tfidf_rows(docs, features.fit_tfidf(docs)).select("row_id", "term", F.round("weight", 6).alias("weight"))


def _term_weight(salt: str, term: str) -> float:
    digest = int(hashlib.md5(f"{salt}:{term}".encode()).hexdigest()[:15], 16)
    return (digest % 2001 - 1000) / 100


def _fixed_model(spark, sf_dir, salt: str) -> PipelineModel:
    """TF-IDF of the documents and a regression whose weights are hashes of the terms, so that SQL can score the same."""
    fitted = features.fit_tfidf(inputs.documents(spark, sf_dir))
    terms = next(s for s in fitted.stages if isinstance(s, CountVectorizerModel)).vocabulary
    weights = _py2java(spark.sparkContext, Vectors.dense([_term_weight(salt, t) for t in terms]))
    regression = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(f"fixed-{salt}", weights, FIXED_BIAS)
    return PipelineModel([*fitted.stages, LogisticRegressionModel(regression)])


def logreg_scores(spark, sf_dir):
    scored = classifiers.predict_proba(_fixed_model(spark, sf_dir, "first"), _held_out(spark, sf_dir))
    return scored.select("row_id", "y", "split", F.round("p_toxic", 6).alias("p_toxic"), metrics.predict_default().alias("pred"))


def _gradient(spark, sf_dir, weighted: bool, **options):
    """Rows and terms of a fit, and whether the loss per row is flat at its weights, in each direction, within a bound."""
    train = dedup.cut_lineage(_train(spark, sf_dir))
    model = classifiers.logreg_fit(train, weighted=weighted, min_df=MIN_DF, tol=TIGHT, **options)
    regression = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    rows = classifiers.with_class_weights(train) if weighted else train.withColumn("weight", F.lit(1.0))
    tfidf = features.tfidf_rows(train, PipelineModel(model.stages[: model.stages.index(regression)]))
    errors = classifiers.predict_proba(model, rows).select("row_id", ((F.col("p_toxic") - F.col("y")) * F.col("weight")).alias("error"))
    terms = next(s for s in model.stages if isinstance(s, CountVectorizerModel)).vocabulary
    weights = spark.createDataFrame(list(zip(terms, regression.coefficients.toArray().tolist())), "term STRING, w DOUBLE")
    slopes = tfidf.join(errors, "row_id").groupBy("term").agg(F.sum(F.col("weight") * F.col("error")).alias("slope"))
    n = rows.count()
    steepest = slopes.join(weights, "term").agg(F.max(F.abs(F.col("slope") + F.col("w"))).alias("g"), F.count("*").alias("n_terms"))
    return steepest.select(F.lit(n).cast("bigint").alias("n_rows"), "n_terms", (F.col("g") / n <= FLAT).alias("flat"))


def logreg_gradient(spark, sf_dir):
    return _gradient(spark, sf_dir, False)


def weighted_logreg_gradient(spark, sf_dir):
    return _gradient(spark, sf_dir, True)


def weighted_logreg_scores(spark, sf_dir):
    model = classifiers.logreg_fit(_train(spark, sf_dir), weighted=True, min_df=MIN_DF)
    return classifiers.predict(model, _held_out(spark, sf_dir)).select("row_id", "y", "pred")


def class_weights(spark, sf_dir):
    weights = classifiers.class_weights(inputs.labels(spark, sf_dir))
    return weights.select("y", "n", F.round("weight", 6).alias("weight"))


def _fixed_dense(spark, train) -> PipelineModel:
    """TF-IDF of the rows, directions whose entries are hashes of the terms, and a perceptron of fixed weights."""
    fitted = features.fit_tfidf(train, max_features=classifiers.DENSE_TERMS, min_df=MIN_DF)
    terms = next(s for s in fitted.stages if isinstance(s, CountVectorizerModel)).vocabulary
    entries = [_term_weight(f"direction{k}", t) for k in range(DENSE) for t in terms]  # column by column
    jvm, context = spark._jvm.org.apache.spark.ml, spark.sparkContext
    matrix = _py2java(context, Matrices.dense(len(terms), DENSE, entries))
    directions = jvm.feature.PCAModel("fixed-directions", matrix, _py2java(context, Vectors.dense([0.0] * DENSE)))
    directions.set(directions.k(), DENSE)
    network = jvm.classification.MultilayerPerceptronClassificationModel("fixed-network", _py2java(context, Vectors.dense(DENSE_WEIGHTS)))
    layers = context._gateway.new_array(context._jvm.int, 3)
    layers[0], layers[1], layers[2] = DENSE, HIDDEN, 2
    network.set(network.layers(), layers)
    directions = PCAModel(directions).setInputCol("features").setOutputCol("dense")
    return classifiers.dense_model(fitted, directions, MultilayerPerceptronClassificationModel(network).setFeaturesCol("dense"))


def _dense_rows(model, rows):
    scored = classifiers.predict_proba(model, rows)
    return scored.select("row_id", "y", F.round("p_toxic", 6).alias("p_toxic"), metrics.predict_default().alias("pred"))


def dense_scores(spark, sf_dir):
    """Held-out rows through directions and perceptron of fixed weights, over the vocabulary of the train part."""
    return _dense_rows(_fixed_dense(spark, _train(spark, sf_dir)), _held_out(spark, sf_dir))


def dense_subset_scores(spark, sf_dir):
    """The same over the vocabulary of a stratified subset of the train part."""
    subset = sampling.train_subset(_train(spark, sf_dir), DENSE_SUBSET)
    return _dense_rows(_fixed_dense(spark, subset), _held_out(spark, sf_dir))


def _length_model():
    """A stand-in for an external model: logits from the text length."""
    import numpy as np

    def score(texts):
        lengths = np.array([len(t) for t in texts.ravel()])
        toxic = (lengths % 100) / 50.0 - 1.0
        return np.stack([np.zeros_like(toxic), toxic], axis=1).astype("float32")

    return score


def external_model_scores(spark, sf_dir):
    """Assistant turns through a batched external model, as a filter after generation would run it."""
    turns = inputs.table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    scored = classifiers.score_batches(turns, _length_model)
    return scored.select("conv_id", "turn", "pred", F.round("p_toxic", 4).alias("p_toxic"))


def saved_model_scores(spark, sf_dir):
    """The held-out rows scored by a model of fixed weights after saving and loading it.

    `same` says whether a model trained on the train part, saved and loaded too, scores the row like the original.
    """
    path = scratch_path(spark, "model")
    trained = classifiers.logreg_fit(_train(spark, sf_dir), min_df=MIN_DF)
    artifacts.save_model(trained, f"{path}/trained")
    artifacts.save_model(_fixed_model(spark, sf_dir, "second"), f"{path}/fixed")
    before = classifiers.predict_proba(trained, _held_out(spark, sf_dir)).drop("p_safe").withColumnRenamed("p_toxic", "before")
    after = classifiers.predict_proba(artifacts.load_model(f"{path}/trained"), before).drop("p_safe").withColumnRenamed("p_toxic", "after")
    scored = classifiers.predict_proba(artifacts.load_model(f"{path}/fixed"), after)
    return scored.select(
        "row_id", "y", "split", F.round("p_toxic", 6).alias("p_toxic"), metrics.predict_default().alias("pred"),
        F.col("before").eqNullSafe(F.col("after")).alias("same"),
    )


def _with_texts(spark, sf_dir, splits):
    """The same rows, chosen by ids and labels first, so that texts of other documents stay where they are.

    Whether a row of the corpus is taken, and its split, follow from its id and label.
    """
    chosen = dedup.cut_lineage(splits.select("row_id", "y", "split").distinct())
    labels = inputs.labels(spark, sf_dir).join(chosen, ["row_id", "y"])
    return sifted(inputs.documents(spark, sf_dir), chosen, "row_id").join(labels, "row_id")


def promoted_checkpoint(spark, sf_dir):
    """Promote an ablation on balanced rows; then its splits, its size, and what the promoted model gives them."""
    src, dst = scratch_path(spark, "ablation"), scratch_path(spark, "checkpoint")
    artifacts.save_model(_fixed_model(spark, sf_dir, "first"), f"{src}/model")
    artifacts.write_splits(_with_texts(spark, sf_dir, sampling.balance_train_only(inputs.splits(spark, sf_dir))), f"{src}/splits")
    artifacts.promote(spark, src, dst)
    size = artifacts.model_size(spark, f"{dst}/model").scalar()
    scored = classifiers.predict_proba(artifacts.load_model(f"{dst}/model"), artifacts.read_splits(spark, f"{dst}/splits"))
    return scored.groupBy("split").agg(
        F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("toxic_rate"), F.round(F.avg("p_toxic"), 6).alias("mean_p")
    ).select("split", "n", "toxic_rate", "mean_p", (size > 0).alias("has_model"))


def scoring_throughput(spark, sf_dir):
    """Rows scored in the timed passes over the held-out texts; of the speed only that it agrees with rows and seconds."""
    runs = evaluation.timed_runs(_fixed_model(spark, sf_dir, "first"), _held_out(spark, sf_dir), 2, "first")
    seconds = runs.groupBy("model").agg(F.sum("seconds").alias("seconds"))
    agrees = F.abs(F.col("rows_per_second") * F.col("seconds") - F.col("rows")) < 1e-6 * F.col("rows")
    return evaluation.throughput(runs).join(seconds, "model").select("model", "rows", "passes", agrees.alias("agrees"))


def model_evaluation(spark, sf_dir):
    """The nested result block of a model of fixed weights, flattened; timings are part of it, but not of this query."""
    parts = inputs.splits(spark, sf_dir)
    results = evaluation.evaluate_model(spark, _fixed_model(spark, sf_dir, "first"), parts, runs=2)
    return results.select(
        *[F.round(f"quality.{c}", 6).alias(c) for c in ("precision", "recall", "f1_score", "pr_auc")],
        F.round("quality_tuned.f1_score", 6).alias("f1_tuned"), F.round("best_threshold", 6).alias("best_threshold"),
    )


def clean_against_stress(spark, sf_dir):
    parts = inputs.splits(spark, sf_dir)
    rows = evaluation.clean_vs_stress(_fixed_model(spark, sf_dir, "first"), compare.stress_variants(parts.filter("split = 'test'")))
    return rows.select("variant", "tn", "fp", "fn", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")])


def routed_models(spark, sf_dir):
    cheap, costly = (_fixed_model(spark, sf_dir, salt) for salt in ("first", "second"))
    routed = classifiers.route_ensemble(_held_out(spark, sf_dir), cheap, costly)
    return routed.select("row_id", "y", "scored_by", F.round("p_toxic", 6).alias("p_toxic"))


def _fixed_sql(source: str, name: str, salt: str, key: str = "row_id") -> str:
    """CTEs that score `source (row_id, text, ...)` with a model of fixed weights; needs `vocab`."""
    weight = f"({hash_sql(f"'{salt}:' || term")} % 2001 - 1000)::DOUBLE / 100.0::DOUBLE"
    return f"""
{name}_words AS (SELECT {key}, regexp_extract_all(lower(text), '{rules.WORD}{{2,}}') AS w FROM {source}),
{name}_terms AS (SELECT {key}, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM {name}_words),
{name}_hits AS (SELECT {key}, t.term, count(*) * any_value(v.idf) AS x FROM {name}_terms t JOIN vocab v ON v.term = t.term GROUP BY ALL),
{name}_sums AS (SELECT {key}, sum(x * {weight}) / sqrt(sum(x * x)) AS margin FROM {name}_hits GROUP BY {key}),
{name} AS (SELECT s.*, 1 / (1 + exp(-(coalesce(m.margin, 0) + {FIXED_BIAS}))) AS p_toxic FROM {source} s LEFT JOIN {name}_sums m USING ({key}))"""


QUERIES = {
    "tfidf_terms": tfidf_terms,
    "vocabulary": vocabulary,
    "tfidf_weights": tfidf_weights,
    "class_weights": class_weights,
    "external_model_scores": external_model_scores,
    "logreg_scores": logreg_scores,
    "logreg_gradient": logreg_gradient,
    "weighted_logreg_gradient": weighted_logreg_gradient,
    "weighted_logreg_scores": weighted_logreg_scores,
    "dense_scores": dense_scores,
    "dense_subset_scores": dense_subset_scores,
    "saved_model_scores": saved_model_scores,
    "promoted_checkpoint": promoted_checkpoint,
    "scoring_throughput": scoring_throughput,
    "model_evaluation": model_evaluation,
    "clean_against_stress": clean_against_stress,
    "routed_models": routed_models,
}

def _normal(text: str) -> str:
    return f"trim({inputs.replace_all(f'lower({text})', inputs.SPACE, ' ')})"


def _dense_sql(chosen: str) -> str:
    """The forward pass over the vocabulary of `chosen (row_id, text)`."""
    inner = (DENSE + 1) * HIDDEN
    def weighed(name: str, n: int, outputs: int, o: int, start: int) -> str:
        terms = [f"({DENSE_WEIGHTS[start + o + outputs * i]}) * {name}{i}" for i in range(n)]
        return " + ".join([*terms, f"({DENSE_WEIGHTS[start + outputs * n + o]})"])
    def entry(k: int) -> str:
        return f"({hash_sql(f"'direction{k}:' || t.term")} % 2001 - 1000)::DOUBLE / 100.0::DOUBLE"
    hidden = ", ".join(f"1 / (1 + exp(-({weighed('z', DENSE, HIDDEN, o, 0)}))) AS h{o}" for o in range(HIDDEN))
    return f"""dense_words AS (SELECT row_id, regexp_extract_all(lower(text), '{rules.WORD}{{2,}}') AS w FROM {chosen}),
dense_terms AS (SELECT row_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM dense_words),
dense_counts AS (SELECT term, count(DISTINCT row_id) AS df, count(*) AS tf FROM dense_terms GROUP BY term),
dense_n AS (SELECT count(*) AS n FROM dense_words),
dense_vocab AS (SELECT term, ln((1 + n)::DOUBLE / (1 + df)::DOUBLE) + 1 AS idf FROM dense_counts, dense_n
  WHERE df >= {MIN_DF} AND df <= 0.8::DOUBLE * n ORDER BY tf DESC, term LIMIT {classifiers.DENSE_TERMS}),
held_words AS (SELECT row_id, regexp_extract_all(lower(text), '{rules.WORD}{{2,}}') AS w FROM held),
held_terms AS (SELECT row_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM held_words),
held_hits AS (SELECT row_id, t.term, count(*) * any_value(v.idf) AS x FROM held_terms t JOIN dense_vocab v ON v.term = t.term GROUP BY ALL),
directed AS (SELECT row_id, {", ".join(f"sum(x * {entry(k)}) / sqrt(sum(x * x)) AS z{k}" for k in range(DENSE))} FROM held_hits t GROUP BY row_id),
filled AS (SELECT h.row_id, h.y, {", ".join(f"coalesce(z{k}, 0) AS z{k}" for k in range(DENSE))} FROM held h LEFT JOIN directed d ON d.row_id = h.row_id),
inner_layer AS (SELECT row_id, y, {hidden} FROM filled),
outer_layer AS (SELECT row_id, y, 1 / (1 + exp(({weighed('h', HIDDEN, 2, 0, inner)}) - ({weighed('h', HIDDEN, 2, 1, inner)}))) AS p FROM inner_layer)
SELECT row_id, y, round(p, 6) AS p_toxic, (p > 0.5)::INTEGER AS pred FROM outer_layer"""


_held = ", held AS (SELECT * FROM splits WHERE split <> 'train'),"
_train_terms = f""", words_train AS (SELECT row_id, regexp_extract_all(lower(text), '{rules.WORD}{{2,}}') AS w FROM splits WHERE split = 'train'),
terms_train AS (SELECT row_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM words_train),
counts_train AS (SELECT term, count(DISTINCT row_id) AS df FROM terms_train GROUP BY term)
SELECT (SELECT count(*) FROM words_train) AS n_rows, least(count(*), 10000) AS n_terms, true AS flat
FROM counts_train WHERE df >= {MIN_DF} AND df <= 0.8::DOUBLE * (SELECT count(*) FROM words_train)"""

_subset = f"""train_rows AS (SELECT * FROM splits WHERE split = 'train'),
train_counts AS (SELECT y, count(*) AS n FROM train_rows GROUP BY y),
train_shares AS (SELECT y, n::DOUBLE / (SELECT sum(n) FROM train_counts)::DOUBLE * {DENSE_SUBSET} AS exact FROM train_counts),
train_quota AS (SELECT y, floor(exact)::BIGINT + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, y)
    <= {DENSE_SUBSET} - (SELECT sum(floor(exact)) FROM train_shares) THEN 1 ELSE 0 END AS quota FROM train_shares),
train_ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('subset:42:' || row_id), row_id) AS k FROM train_rows),
chosen AS (SELECT r.row_id, r.text FROM train_ranked r JOIN train_quota q ON r.y = q.y
  WHERE k <= quota OR (SELECT sum(n) FROM train_counts) <= {DENSE_SUBSET}),"""

SQL = {
    "dense_scores": with_ctes(("splits",), f"{_held} chosen AS (SELECT row_id, text FROM splits WHERE split = 'train'), {_dense_sql('chosen')}"),
    "dense_subset_scores": with_ctes(("splits",), f"{_held} {_subset} {_dense_sql('chosen')}"),
    "logreg_scores": with_ctes(("splits", "vocab"), f"""{_held}{_fixed_sql("held", "fixed", "first")}
SELECT row_id, y, split, round(p_toxic, 6) AS p_toxic, (p_toxic > 0.5)::INTEGER AS pred FROM fixed"""),
    "logreg_gradient": with_ctes(("splits",), _train_terms),
    "weighted_logreg_gradient": with_ctes(("splits",), _train_terms),
    "model_evaluation": with_ctes(("splits", "vocab"), f"""{_held}{_fixed_sql("held", "fixed", "first")},
val AS (SELECT * FROM fixed WHERE split = 'val'), test AS (SELECT * FROM fixed WHERE split = 'test'){scores_sql.sweep_ctes("val")},
plain AS ({scores_sql.counts_sql('test')}), tuned AS ({scores_sql.counts_sql('test', 'p_toxic >= (SELECT t FROM best)')})
SELECT {scores_sql.QUALITY}, round({scores_sql.area_sql('test')}, 6) AS pr_auc,
  round((SELECT {scores_sql.F1} FROM tuned), 6) AS f1_tuned, round((SELECT t FROM best), 6) AS best_threshold FROM plain"""),
    "clean_against_stress": with_ctes(("splits", "vocab"), f""", test_rows AS (SELECT row_id, y, text FROM splits WHERE split = 'test'),
spelled AS (SELECT row_id, y, {cleaning.STRESSED} AS text FROM test_rows),
{cleaning.DEOBFUSCATE_CTES},
versions AS (
  SELECT row_id * 3 AS row_id, y, 'clean' AS variant, {_normal('text')} AS text FROM test_rows
  UNION ALL SELECT row_id * 3 + 1, y, 'obfuscated', {_normal('text')} FROM spelled
  UNION ALL SELECT row_id * 3 + 2, y, 'deobfuscated', {_normal(cleaning.DEOBFUSCATED)} FROM squeezed),
{_fixed_sql("versions", "fixed", "first")}
SELECT variant, tn, fp, fn, tp, {scores_sql.QUALITY} FROM ({scores_sql.counts_sql('fixed', by='variant')})"""),
    "routed_models": with_ctes(("splits", "vocab"), f"""{_held}{_fixed_sql("held", "cheap", "first")},{_fixed_sql("held", "costly", "second")}
SELECT a.row_id, a.y, CASE WHEN a.p_toxic BETWEEN 0.3 AND 0.7 THEN 'costly' ELSE 'cheap' END AS scored_by,
  round(CASE WHEN a.p_toxic BETWEEN 0.3 AND 0.7 THEN b.p_toxic ELSE a.p_toxic END, 6) AS p_toxic
FROM cheap a JOIN costly b ON a.row_id = b.row_id"""),
    "scoring_throughput": with_ctes(
        ("splits",), "SELECT 'first' AS model, 2 * count(*) AS rows, 2 AS passes, true AS agrees FROM splits WHERE split <> 'train'"
    ),
    "tfidf_terms": with_ctes(
        ("terms",), "SELECT row_id, len(terms) AS n_terms, md5(array_to_string(terms, '|')) AS terms_md5 FROM terms"
    ),
    "vocabulary": with_ctes(("vocab",), "SELECT term, df, tf, round(idf, 6) AS idf FROM vocab"),
    "tfidf_weights": with_ctes(("vocab",), """, weighted AS (
  SELECT o.row_id, o.term, count(*) * any_value(v.idf) AS w FROM occurrences o JOIN vocab v ON v.term = o.term GROUP BY 1, 2),
norms AS (SELECT row_id, sqrt(sum(w * w)) AS norm FROM weighted GROUP BY row_id)
SELECT w.row_id, w.term, round(w.w / n.norm, 6) AS weight FROM weighted w JOIN norms n ON n.row_id = w.row_id"""),
    "class_weights": with_ctes(("rows",), """SELECT y, count(*) AS n,
  round((SELECT count(*) FROM rows)::DOUBLE / ((SELECT count(DISTINCT y) FROM rows) * count(*)), 6) AS weight FROM rows GROUP BY y"""),
    "external_model_scores": """SELECT conv_id, turn, CASE WHEN z > 0 THEN 1 ELSE 0 END AS pred, round(1 / (1 + exp(-z)), 4) AS p_toxic
FROM (SELECT conv_id, turn, ((length(text) % 100)::DOUBLE / 50 - 1)::FLOAT::DOUBLE AS z FROM conversations WHERE role = 'assistant')""",
    "promoted_checkpoint": with_ctes(("splits", "vocab"), f"""{BALANCED_CTES},
whole AS (SELECT s.* FROM splits s JOIN balanced b ON b.row_id = s.row_id),{_fixed_sql("whole", "fixed", "first")}
SELECT split, count(*) AS n, round(avg(y), 6) AS toxic_rate, round(avg(p_toxic), 6) AS mean_p, true AS has_model FROM fixed GROUP BY split"""),
    "saved_model_scores": with_ctes(("splits", "vocab"), f"""{_held}{_fixed_sql("held", "fixed", "second")}
SELECT row_id, y, split, round(p_toxic, 6) AS p_toxic, (p_toxic > 0.5)::INTEGER AS pred, true AS same FROM fixed"""),
}
