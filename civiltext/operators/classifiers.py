"""Training and scoring.

A model is a fitted `PipelineModel` from text to `probability`; scored tables carry
`p_toxic`. Externally trained models enter through `score_batches`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, CountVectorizerModel, PCAModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiltext.functions.hashing import SEED
from civiltext.functions.once import evaluated_once
from civiltext.operators.features import fit_tfidf, tidy_stage
from civiltext.operators.linear import linear_model, toxic_probability
from civiltext.operators.metrics import predict_default
from civiltext.operators.sampling import class_counts, train_subset
from civiltext.session import bound_batches, cut_lineage

# Training settings of the studied models.
C, MAX_ITER = 1.0, 1000
BATCH_SIZE = 64
SUBSET_SIZE = 100_000

TOLERANCE = 1e-5
DENSE_TERMS = 2_000  # of the vocabulary whose directions are sought


def class_weights(df: DataFrame) -> DataFrame:
    """`(y, n, weight)` with weight n / (classes * n_class)."""
    counts = df.groupBy("y").agg(F.count("*").alias("n"))
    total, classes = counts.agg(F.sum("n")).scalar(), counts.agg(F.count("*")).scalar()
    return counts.withColumn("weight", total / (classes * F.col("n")))


def with_class_weights(df: DataFrame) -> DataFrame:
    counts = class_counts(df)
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col("y") == value, sum(counts.values()) / (len(counts) * n)).otherwise(weight)
    return df.withColumn("weight", weight)


def logreg_fit(
    train: DataFrame, c: float = C, max_iter: int = MAX_ITER, weighted: bool = False, tol: float = TOLERANCE,
    **tfidf,
) -> PipelineModel:
    """TF-IDF and L2 logistic regression.

    The penalty 1 / (C n) belongs to a mean loss and equals C times a summed loss. Every
    iteration is a pass over the cached vectors.
    """
    features = fit_tfidf(train, **tfidf)
    rows = with_class_weights(train) if weighted else train
    n = train.count()
    vectors = features.transform(rows).select("y", "features", *(["weight"] if weighted else []))
    regression = LogisticRegression(
        featuresCol="features", labelCol="y", maxIter=max_iter, regParam=1 / (c * n),
        elasticNetParam=0.0, standardization=False, tol=tol, **({"weightCol": "weight"} if weighted else {}),
    )
    fitted = regression.fit(vectors)
    return PipelineModel([*features.stages, fitted, tidy_stage("features", "rawPrediction")])


def dense_model(terms: PipelineModel, directions: PCAModel, network) -> PipelineModel:
    """Weighted terms, their shares along the directions, and a perceptron over these."""
    return PipelineModel([*terms.stages, directions, network, tidy_stage("features", "dense", "rawPrediction")])


def dense_fit(
    train: DataFrame, vector_size: int = 32, hidden: int = 16, max_iter: int = 50, max_terms: int = DENSE_TERMS,
    seed: int = SEED, **tfidf,
) -> PipelineModel:
    """Directions of the vocabulary and a small perceptron: the high-capacity end of the study on MLlib stages.

    The covariances of the most frequent terms are summed in the tasks and reduced in a tree; their matrix has a fixed
    size, 32 MB for `DENSE_TERMS` terms, and its leading directions make a text a short dense vector.
    """
    terms = fit_tfidf(train, max_features=max_terms, **tfidf)
    vectors = cut_lineage(terms.transform(train).select("y", "features"))
    size = min(vector_size, len(next(s for s in terms.stages if isinstance(s, CountVectorizerModel)).vocabulary))
    directions = PCA(k=size, inputCol="features", outputCol="dense").fit(vectors)
    network = MultilayerPerceptronClassifier(
        featuresCol="dense", labelCol="y", layers=[size, hidden, 2], maxIter=max_iter, seed=seed
    ).fit(cut_lineage(directions.transform(vectors).select("y", "dense")))
    return dense_model(terms, directions, network)


def dense_subset_fit(train: DataFrame, subset: int = SUBSET_SIZE, **options) -> PipelineModel:
    part = train_subset(train.withColumn("split", F.lit("train")), subset).drop("split")
    return dense_fit(part, **options)


MODELS: dict[str, Callable[..., PipelineModel]] = {
    "tfidf_logreg": logreg_fit,
    "dense": dense_fit,
    "dense_subset": dense_subset_fit,
}


def fit(kind: str, train: DataFrame, **options) -> PipelineModel:
    if kind not in MODELS:
        raise ValueError(f"unknown model {kind!r}; one of {', '.join(MODELS)}")
    return MODELS[kind](train, **options)


def predict_proba(model: PipelineModel | None, df: DataFrame) -> DataFrame:
    """Adds `p_safe` and `p_toxic`. TF-IDF with logistic regression is scored in arrays, other pipelines by their stages."""
    if model is None:
        raise ValueError("model is neither fitted nor loaded")
    if (arrays := linear_model(model)) is not None:
        bound_batches(df.sparkSession)
        scored = df.withColumn("p_toxic", evaluated_once(toxic_probability(arrays, F.col("text"))))
        return scored.select(*df.columns, (1 - F.col("p_toxic")).alias("p_safe"), "p_toxic")
    scored = model.transform(df).withColumn("p", evaluated_once(vector_to_array("probability")))
    return scored.select(*df.columns, F.col("p")[0].alias("p_safe"), F.col("p")[1].alias("p_toxic"))


def predict(model: PipelineModel | None, df: DataFrame) -> DataFrame:
    """Adds `pred`, 1 when p_toxic > 0.5."""
    return predict_proba(model, df).withColumn("pred", predict_default()).drop("p_safe", "p_toxic")


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by the largest for stability."""
    logits = F.transform(logits, lambda x: x.cast("double"))
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)
    return F.transform(powers, lambda x: x / total)


def score_batches(
    df: DataFrame, make_predict_fn: Callable[[], Callable], text_col: str = "text", batch_size: int = BATCH_SIZE
) -> DataFrame:
    """Adds `pred` and `p_toxic` from a model that maps a batch of texts to two logits each.

    `make_predict_fn` runs once per Python worker and loads the model there.
    """
    logits = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    scored = df.withColumn("logits", evaluated_once(logits(F.col(text_col))))
    return scored.withColumn("p_toxic", softmax(F.col("logits"))[1]).withColumn(
        "pred", (F.col("logits")[1] > F.col("logits")[0]).cast("int")
    ).drop("logits")


def unsure(p: Column, low: float, high: float) -> Column:
    return p.between(low, high)


def route(cheap: Column, costly: Column, low: float = 0.3, high: float = 0.7) -> Column:
    """The cheap score when it is confident, otherwise the costly one."""
    return F.when(unsure(cheap, low, high), costly).otherwise(cheap)


def route_ensemble(
    df: DataFrame, cheap: PipelineModel, costly: PipelineModel, low: float = 0.3, high: float = 0.7
) -> DataFrame:
    """Score everything with the cheap model, only its unsure rows with the costly one."""
    first = predict_proba(cheap, df)
    doubt = unsure(F.col("p_toxic"), low, high)
    sure = first.filter(~doubt).withColumn("scored_by", F.lit("cheap"))
    again = predict_proba(costly, first.filter(doubt).select(df.columns)).withColumn("scored_by", F.lit("costly"))
    return sure.unionByName(again)
