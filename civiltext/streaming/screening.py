"""The same cleaning and scoring on a stream of texts.

Both are row-wise, so a streaming frame passes through without state. Dedup, splits and
metrics need whole tables and stay batch.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from civiltext.operators.classifiers import predict_proba
from civiltext.operators.cleaning import clean_text
from civiltext.operators.metrics import predict_at


def screen(texts: DataFrame, model: PipelineModel, threshold: float) -> DataFrame:
    """Cleaned texts with `p_toxic` and `pred`; works on batch and streaming frames alike."""
    scored = predict_proba(model, clean_text(texts))
    return scored.withColumn("pred", predict_at(threshold))
