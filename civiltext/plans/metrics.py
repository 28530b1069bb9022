"""Metrics, threshold tuning and comparisons on pseudo-scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from civiltext.functions.text import detect_language
from civiltext.operators import classifiers, compare, evaluation, metrics
from civiltext.plans import inputs
from civiltext.plans.inputs import VARIANTS, SCORERS, score_sql, with_ctes
from civiltext.session import scratch_path
from civiltext.sources import artifacts

COUNTS = ("tn", "fp", "fn", "tp")
RATES = ("precision", "recall", "f1_score")


def _rounded(df, keys, names):
    return df.select(*keys, *[F.round(n, 6).alias(n) for n in names])


def _predicted(df):
    return df.withColumn("pred", metrics.predict_default())


def _val_and_test(spark, sf_dir, scorer="fair"):
    parts = inputs.splits(spark, sf_dir).select("row_id", "y", "split")
    scored = inputs.scored_by(parts, scorer)
    return scored.filter("split = 'val'"), scored.filter("split = 'test'")


def confusion_counts(spark, sf_dir):
    return metrics.confusion(_predicted(inputs.scored(spark, sf_dir)))


def quality_at_default(spark, sf_dir):
    return _rounded(metrics.quality(_predicted(inputs.scored(spark, sf_dir))), COUNTS, RATES)


def average_precision(spark, sf_dir):
    return _rounded(metrics.pr_auc(inputs.scored(spark, sf_dir)), (), ("pr_auc",))


def threshold_sweep(spark, sf_dir):
    return _rounded(metrics.threshold_sweep(inputs.scored(spark, sf_dir)), COUNTS, ("threshold", *RATES))


def best_threshold(spark, sf_dir):
    best = metrics.best_threshold(metrics.threshold_sweep(inputs.scored(spark, sf_dir)))
    return _rounded(best, (), ("threshold", "f1_score"))


def tuned_metrics(spark, sf_dir):
    return _rounded(metrics.tuned_metrics(*_val_and_test(spark, sf_dir)), COUNTS, ("threshold", *RATES, "pr_auc"))


def evaluated_and_stored(spark, sf_dir):
    """Evaluate unless results are stored, store them as nested JSON, read them back."""
    path = scratch_path(spark, "results")

    def run():
        artifacts.write_results(evaluation.evaluate_scores(*_val_and_test(spark, sf_dir)), path)

    results = compare.cached_experiment(
        lambda: artifacts.has_results(spark, path), lambda: artifacts.read_results(spark, path), run
    )
    flat = results.select(
        F.col("quality.f1_score").alias("f1_default"),
        F.col("quality.pr_auc").alias("pr_auc"),
        F.col("quality_tuned.f1_score").alias("f1_tuned"),
        F.col("best_threshold").alias("threshold"),
        F.col("confusion_matrix")[1][1].alias("tp_default"),
        F.col("confusion_matrix_tuned")[1][1].alias("tp_tuned"),
        F.col("confusion_matrix_tuned")[0][1].alias("fp_tuned"),
    )
    return _rounded(flat, ("tp_default", "tp_tuned", "fp_tuned"), ("f1_default", "pr_auc", "f1_tuned", "threshold"))


def error_rates(spark, sf_dir):
    rates = metrics.error_rates(_predicted(inputs.scored_models(spark, sf_dir)), by=("model",))
    return _rounded(rates, ("model",), ("fp_rate", "fn_rate"))


def quality_by_language(spark, sf_dir):
    """Every labelled text and its Cyrillic transcription, sliced by detected language."""
    texts = inputs.multilingual(spark, sf_dir).withColumn("doc_id", F.floor(F.col("row_id") / VARIANTS))
    labels = inputs.labels(spark, sf_dir).withColumnRenamed("row_id", "doc_id")
    tagged = texts.withColumn("language", detect_language(F.col("text"))).drop("text").join(labels, "doc_id")
    sliced = metrics.metrics_by(_predicted(inputs.scored_by(tagged, "fair")), "language")
    return _rounded(sliced, ("language", *COUNTS), (*RATES, "fp_rate", "fn_rate"))


def run_statistics(spark, sf_dir):
    turns = inputs.table(spark, sf_dir, "conversations")
    # a power of two as divisor: sums are then exact in any order
    runs = turns.select(F.col("role").alias("model"), (F.length("text") / F.lit(1024.0)).alias("ms_per_sample"))
    names = ("latency_mean_ms", "latency_std_ms", "latency_min_ms", "latency_max_ms")
    return _rounded(metrics.run_stats(runs), ("model",), names)


def _long(spark, sf_dir):
    quality = metrics.quality(_predicted(inputs.scored_models(spark, sf_dir)), by=("model",))
    return compare.to_long(quality, "model", metrics=RATES)


def variant_comparison(spark, sf_dir):
    variants = _long(spark, sf_dir).withColumnRenamed("model", "variant")
    table = compare.compare(variants, "blind", "fair", "sharp")
    return _rounded(table, ("metric",), ("blind", "fair", "sharp", "fair_delta", "sharp_delta"))


def _blocks(spark, sf_dir):
    rows = inputs.scored_models(spark, sf_dir)
    default = metrics.quality(_predicted(rows), by=("model",)).withColumn("variant", F.lit("default"))
    tuned = rows.withColumn("pred", metrics.predict_at(0.4))
    return default.unionByName(metrics.quality(tuned, by=("model",)).withColumn("variant", F.lit("tuned")))


def default_against_tuned(spark, sf_dir):
    table = compare.default_vs_tuned(_blocks(spark, sf_dir))
    return _rounded(table, ("model", "extra_tp", "extra_fp"), ("precision_delta", "recall_delta", "f1_score_delta"))


def cross_model_table(spark, sf_dir):
    return _rounded(compare.cross_model_table(_long(spark, sf_dir), list(SCORERS)), ("metric",), tuple(SCORERS))


def relative_to_blind(spark, sf_dir):
    table = compare.relative_to(_long(spark, sf_dir), "blind")
    return _rounded(table, ("model", "metric"), ("value", "relative"))


def _source_models(spark, sf_dir):
    """Each document source taken as a model: F1 of its rows against their mean length."""
    docs = inputs.corpus(spark, sf_dir).withColumn("n_chars", F.length("text")).drop("text")
    rows = _predicted(inputs.scored_by(docs, "fair"))
    quality = metrics.quality(rows, by=("source",)).select("source", F.round("f1_score", 6).alias("f1_score"))
    cost = rows.groupBy("source").agg(F.round(F.avg("n_chars"), 6).alias("ms_per_sample"))
    return quality.join(cost, "source").withColumnRenamed("source", "model")


def pareto_front(spark, sf_dir):
    return compare.pareto_front(_source_models(spark, sf_dir)).select("model", "f1_score", "ms_per_sample")


def disagreements(spark, sf_dir):
    rows = compare.disagreements(inputs.scored(spark, sf_dir, "blind"), inputs.scored(spark, sf_dir, "sharp"))
    return _rounded(rows, ("row_id", "y"), ("p_first", "p_second", "spread"))


def routed_scores(spark, sf_dir):
    first = inputs.scored(spark, sf_dir, "fair").withColumnRenamed("p_toxic", "cheap")
    second = inputs.scored(spark, sf_dir, "sharp").select("row_id", F.col("p_toxic").alias("costly"))
    routed = first.join(second, "row_id").withColumn("p_toxic", classifiers.route(F.col("cheap"), F.col("costly")))
    return _rounded(routed, ("row_id", "y"), ("p_toxic",))


QUERIES = {
    "confusion_counts": confusion_counts,
    "quality_at_default": quality_at_default,
    "average_precision": average_precision,
    "threshold_sweep": threshold_sweep,
    "best_threshold": best_threshold,
    "tuned_metrics": tuned_metrics,
    "evaluated_and_stored": evaluated_and_stored,
    "error_rates": error_rates,
    "quality_by_language": quality_by_language,
    "run_statistics": run_statistics,
    "variant_comparison": variant_comparison,
    "default_against_tuned": default_against_tuned,
    "cross_model_table": cross_model_table,
    "relative_to_blind": relative_to_blind,
    "pareto_front": pareto_front,
    "disagreements": disagreements,
    "routed_scores": routed_scores,
}


def counts_sql(source: str, test: str = "p_toxic > 0.5", by: str = "") -> str:
    keys, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""SELECT {keys}count(*) FILTER (y = 0 AND NOT {test}) AS tn, count(*) FILTER (y = 0 AND {test}) AS fp,
  count(*) FILTER (y = 1 AND NOT {test}) AS fn, count(*) FILTER (y = 1 AND {test}) AS tp FROM {source}{group}"""


def _div(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0::DOUBLE ELSE ({part})::DOUBLE / ({whole})::DOUBLE END"


PRECISION, RECALL, F1 = _div("tp", "tp + fp"), _div("tp", "tp + fn"), _div("2 * tp", "2 * tp + fp + fn")
FP_RATE, FN_RATE = _div("fp", "fp + tn"), _div("fn", "fn + tp")
QUALITY = f"round({PRECISION}, 6) AS precision, round({RECALL}, 6) AS recall, round({F1}, 6) AS f1_score"


def area_sql(source: str) -> str:
    return f"""(SELECT sum(pos * hits::DOUBLE / seen) / sum(pos) FROM (
  SELECT pos, sum(pos) OVER w AS hits, sum(n) OVER w AS seen FROM (
    SELECT p_toxic, count(*) AS n, sum(y) AS pos FROM {source} GROUP BY p_toxic)
  WINDOW w AS (ORDER BY p_toxic DESC)))"""


def sweep_ctes(source: str, name: str = "sweep") -> str:
    start, step = metrics.FIRST_THRESHOLD, metrics.THRESHOLD_STEP
    return f""", grid AS (SELECT i, {start!r}::DOUBLE + i * {step!r}::DOUBLE AS t FROM range(81) g(i)),
{name}_counts AS (
  SELECT t, count(*) FILTER (y = 0 AND p_toxic < t) AS tn, count(*) FILTER (y = 0 AND p_toxic >= t) AS fp,
    count(*) FILTER (y = 1 AND p_toxic < t) AS fn, count(*) FILTER (y = 1 AND p_toxic >= t) AS tp
  FROM grid, {source} GROUP BY t),
{name} AS (SELECT *, {F1} AS f1 FROM {name}_counts),
best AS (SELECT t, f1 FROM {name} ORDER BY f1 DESC, t LIMIT 1)"""


_parts = f"""SELECT *, {score_sql('fair')} AS p_toxic FROM splits"""
_split_scores = f", val AS ({_parts} WHERE split = 'val'), test AS ({_parts} WHERE split = 'test')"
_tuned = _split_scores + sweep_ctes("val")
_model_quality = f""", q AS (
  SELECT model, {PRECISION} AS precision, {RECALL} AS recall, {F1} AS f1_score FROM ({counts_sql('scored_models', by='model')})),
long AS (UNPIVOT q ON precision, recall, f1_score INTO NAME metric VALUE value)"""
_case = {s: f"max(CASE WHEN model = '{s}' THEN value END)" for s in SCORERS}
_at = {
    v: f"SELECT model, tp, fp, {PRECISION} AS p, {RECALL} AS r, {F1} AS f FROM ({counts_sql('scored_models', t, 'model')})"
    for v, t in (("d", "p_toxic > 0.5"), ("t", "p_toxic >= 0.4"))
}
_language_rows = f""", tagged AS (
  SELECT m.row_id, {inputs.language_sql('m.text')} AS language, l.toxic AS y
  FROM multilingual m JOIN labels l ON l.doc_id = m.row_id // {VARIANTS}),
sliced AS (SELECT language, y, {score_sql('fair')} AS p_toxic FROM tagged)"""
_source_sql = f""", by_doc AS (SELECT source, y, length(text) AS n_chars, {score_sql('fair')} AS p_toxic FROM corpus),
per_model AS (
  SELECT q.source AS model, round({F1}, 6) AS f1_score, ms AS ms_per_sample
  FROM ({counts_sql('by_doc', by='source')}) q
  JOIN (SELECT source, round(avg(n_chars), 6) AS ms FROM by_doc GROUP BY source) c ON c.source = q.source)"""

SQL = {
    "confusion_counts": with_ctes(("scored",), counts_sql("scored")),
    "quality_at_default": with_ctes(("scored",), f"SELECT tn, fp, fn, tp, {QUALITY} FROM ({counts_sql('scored')})"),
    "average_precision": with_ctes(("scored",), f"SELECT round({area_sql('scored')}, 6) AS pr_auc"),
    "threshold_sweep": with_ctes(
        ("scored",), f"{sweep_ctes('scored')} SELECT round(t, 6) AS threshold, tn, fp, fn, tp, {QUALITY} FROM sweep"
    ),
    "best_threshold": with_ctes(
        ("scored",), f"{sweep_ctes('scored')} SELECT round(t, 6) AS threshold, round(f1, 6) AS f1_score FROM best"
    ),
    "tuned_metrics": with_ctes(("splits",), f"""{_tuned}
SELECT round((SELECT t FROM best), 6) AS threshold, tn, fp, fn, tp, {QUALITY}, round({area_sql('test')}, 6) AS pr_auc
FROM ({counts_sql('test', 'p_toxic >= (SELECT t FROM best)')})"""),
    "evaluated_and_stored": with_ctes(("splits",), f"""{_tuned},
plain AS ({counts_sql('test')}), tuned AS ({counts_sql('test', 'p_toxic >= (SELECT t FROM best)')})
SELECT (SELECT tp FROM plain) AS tp_default, (SELECT tp FROM tuned) AS tp_tuned, (SELECT fp FROM tuned) AS fp_tuned,
  round((SELECT {F1} FROM plain), 6) AS f1_default, round({area_sql('test')}, 6) AS pr_auc,
  round((SELECT {F1} FROM tuned), 6) AS f1_tuned, round((SELECT t FROM best), 6) AS threshold"""),
    "error_rates": with_ctes(("scored_models",), f"""SELECT model, round({FP_RATE}, 6) AS fp_rate, round({FN_RATE}, 6) AS fn_rate
FROM ({counts_sql('scored_models', by='model')})"""),
    "quality_by_language": with_ctes(("multilingual",), f"""{_language_rows}
SELECT language, tn, fp, fn, tp, {QUALITY}, round({FP_RATE}, 6) AS fp_rate, round({FN_RATE}, 6) AS fn_rate
FROM ({counts_sql('sliced', by='language')})"""),
    "run_statistics": """SELECT role AS model, round(avg(ms), 6) AS latency_mean_ms, round(stddev_pop(ms), 6) AS latency_std_ms,
  round(min(ms), 6) AS latency_min_ms, round(max(ms), 6) AS latency_max_ms
FROM (SELECT role, length(text)::DOUBLE / 1024.0::DOUBLE AS ms FROM conversations) GROUP BY role""",
    "variant_comparison": with_ctes(("scored_models",), f"""{_model_quality}
SELECT metric, round({_case['blind']}, 6) AS blind, round({_case['fair']}, 6) AS fair, round({_case['sharp']}, 6) AS sharp,
  round({_case['fair']} - {_case['blind']}, 6) AS fair_delta, round({_case['sharp']} - {_case['blind']}, 6) AS sharp_delta
FROM long GROUP BY metric"""),
    "default_against_tuned": with_ctes(("scored_models",), f"""SELECT d.model, t.tp - d.tp AS extra_tp, t.fp - d.fp AS extra_fp,
  round(t.p - d.p, 6) AS precision_delta, round(t.r - d.r, 6) AS recall_delta, round(t.f - d.f, 6) AS f1_score_delta
FROM ({_at['d']}) d JOIN ({_at['t']}) t ON d.model = t.model"""),
    "cross_model_table": with_ctes(("scored_models",), f"""{_model_quality} SELECT metric, """ + ", ".join(
        f"round({c}, 6) AS {s}" for s, c in _case.items()) + " FROM long GROUP BY metric"),
    "relative_to_blind": with_ctes(("scored_models",), f"""{_model_quality}
SELECT l.model, l.metric, round(l.value, 6) AS value, round(l.value / nullif(b.value, 0), 6) AS relative
FROM long l JOIN long b ON b.metric = l.metric AND b.model = 'blind'"""),
    "pareto_front": with_ctes(("corpus",), f"""{_source_sql}
SELECT model, f1_score, ms_per_sample FROM per_model a WHERE NOT EXISTS (
  SELECT 1 FROM per_model b WHERE b.f1_score >= a.f1_score AND b.ms_per_sample <= a.ms_per_sample
    AND (b.f1_score > a.f1_score OR b.ms_per_sample < a.ms_per_sample))"""),
    "disagreements": with_ctes(("rows",), f""", paired AS (
  SELECT row_id, y, {score_sql('blind')} AS a, {score_sql('sharp')} AS b FROM rows)
SELECT row_id, y, round(a, 6) AS p_first, round(b, 6) AS p_second, round(abs(a - b), 6) AS spread
FROM paired WHERE (a > 0.5) <> (b > 0.5)"""),
    "routed_scores": with_ctes(("rows",), f""", paired AS (
  SELECT row_id, y, {score_sql('fair')} AS a, {score_sql('sharp')} AS b FROM rows)
SELECT row_id, y, round(CASE WHEN a BETWEEN 0.3 AND 0.7 THEN b ELSE a END, 6) AS p_toxic FROM paired"""),
}
