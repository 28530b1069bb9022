"""Sources, sinks, unification and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiltext.operators import profile
from civiltext.operators.cleaning import apply_rules, drop_missing
from civiltext.operators.sampling import make_splits
from civiltext.plans import inputs
from civiltext.functions.hashing import text_hash
from civiltext.plans.inputs import hash_sql, with_ctes
from civiltext.session import scratch_path
from civiltext.sources import artifacts, corpus as sources

STRIDE = sources.SOURCE_STRIDE
FLAG_BITS = {name: bit for bit, name in enumerate(sources.TOXICITY_FLAGS)}
LABEL_NAMES = ("NORMAL", "INSULT", "THREAT,__label__INSULT", "NORMAL", "OBSCENITY")
LINE_BREAKS = r"[\n\r]"


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six flags from the bits of doc_id; the last one is sometimes missing."""
    flags = []
    for name, bit in FLAG_BITS.items():
        flag = F.shiftright("row_id", bit + 1).bitwiseAND(F.shiftright("row_id", bit + 2)).bitwiseAND(F.lit(1)).cast("int")
        flags.append((F.when(F.col("row_id") % 5 != 0, flag) if name == "identity_hate" else flag).alias(name))
    return inputs.documents(spark, sf_dir).select("row_id", F.col("text").alias("comment_text"), *flags)


def any_of_flags(spark, sf_dir):
    return _flags(spark, sf_dir).select("row_id", sources.any_of(*sources.TOXICITY_FLAGS).alias("y"))


def csv_multilabel_round_trip(spark, sf_dir):
    path = scratch_path(spark, "multilabel")
    rows = _flags(spark, sf_dir).orderBy("row_id").withColumnRenamed("row_id", "id")
    rows.write.options(**sources.CSV_WRITE_OPTIONS).csv(path)
    return sources.read_multilabel_csv(spark, path, source="flags")


def csv_binary_round_trip(spark, sf_dir):
    path = scratch_path(spark, "binary")
    rows = inputs.corpus(spark, sf_dir).orderBy("row_id").select(
        F.col("row_id").alias("id"), F.col("y").cast("double").alias("toxic"), F.col("text").alias("comment")
    )
    rows.write.options(**sources.CSV_WRITE_OPTIONS).csv(path)
    return sources.read_binary_csv(spark, path, "comment", "toxic", "binary")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label line per document; every ninth lacks the mark and every eleventh the text."""
    name = F.element_at(F.array(*[F.lit(n) for n in LABEL_NAMES]), (F.col("row_id") % len(LABEL_NAMES) + 1).cast("int"))
    text = F.regexp_replace("text", LINE_BREAKS, " ")
    value = (
        F.when(F.col("row_id") % 9 == 0, text)
        .when(F.col("row_id") % 11 == 0, F.concat(F.lit("__label__"), name))
        .otherwise(F.concat(F.lit("  __label__"), name, F.lit(" "), text, F.lit(" ")))
    )
    return inputs.documents(spark, sf_dir).select("row_id", value.alias("value"))


def fasttext_lines(spark, sf_dir):
    return sources.parse_label_lines(_lines(spark, sf_dir), "lines", F.col("row_id"))


def fasttext_round_trip(spark, sf_dir):
    path = scratch_path(spark, "lines")
    _lines(spark, sf_dir).orderBy("row_id").select("value").write.text(path)
    return sources.read_fasttext(spark, path, "lines")


def label_mapping(spark, sf_dir):
    rows = inputs.documents(spark, sf_dir)
    name = F.element_at(F.array(*[F.lit(n) for n in LABEL_NAMES]), (F.col("row_id") % len(LABEL_NAMES) + 1).cast("int"))
    return rows.select("row_id", sources.label_map(name).alias("y"))


def _four_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Documents, turns of the assistant and of all others, and pages in the unified schema."""
    docs = inputs.table(spark, sf_dir, "documents").join(inputs.table(spark, sf_dir, "labels"), "doc_id", "left")
    turns = inputs.table(spark, sf_dir, "conversations")
    turn_id = text_hash(F.concat_ws(":", "conv_id", "turn")) % STRIDE
    said, answered = turns.filter("role <> 'assistant' OR role IS NULL"), turns.filter("role = 'assistant'")
    return [
        sources.to_unified(docs, "documents", F.col("text"), F.col("toxic"), F.col("doc_id")),
        sources.to_unified(said, "conversations", F.col("text"), F.lit(0.0), turn_id),
        sources.to_unified(answered, "assistant", F.col("text"), F.lit(1.0), turn_id),
        sources.to_unified(
            inputs.table(spark, sf_dir, "pages"), "pages", F.col("html"), (F.col("page_id") % 2), F.col("page_id")
        ),
    ]


def unified_union(spark, sf_dir):
    union = sources.union_corpora(*_four_sources(spark, sf_dir))
    return union.select("row_id", "source", F.md5("text").alias("text_md5"), F.coalesce("y", F.lit(-1)).alias("y"))


def missing_labels_dropped(spark, sf_dir):
    union = sources.union_corpora(*_four_sources(spark, sf_dir))
    return profile.stats_by(drop_missing(union, "text", "y"), "source").select(
        "source", "n", F.round("toxic_rate", 6).alias("toxic_rate")
    )


def _round_trip(fmt: str):
    def query(spark, sf_dir):
        path = scratch_path(spark, f"corpus-{fmt}")
        sources.write_corpus(inputs.noisy_corpus(spark, sf_dir), path, fmt)
        schema = sources.CORPUS_SCHEMA if fmt != "csv" else "row_id BIGINT, source STRING, text STRING, y INT"
        return sources.read_corpus(spark, path, fmt, schema)
    return query


def splits_round_trip(spark, sf_dir):
    path = scratch_path(spark, "splits")
    artifacts.write_splits(make_splits(inputs.corpus(spark, sf_dir)), path)
    read = artifacts.read_splits(spark, path + "-missing", path)
    return read.select("row_id", "y", "split", F.md5("text").alias("text_md5"))


def corpus_overall(spark, sf_dir):
    stats = profile.overall_stats(inputs.corpus(spark, sf_dir))
    return stats.select("n", F.round("toxic_rate", 6).alias("toxic_rate"))


def corpus_by_source(spark, sf_dir):
    stats = profile.stats_by(inputs.corpus(spark, sf_dir), "source")
    return stats.select("source", "n", F.round("toxic_rate", 6).alias("toxic_rate"))


def source_value_counts(spark, sf_dir):
    return profile.value_counts(inputs.documents(spark, sf_dir), "source")


def source_counts_by_name(spark, sf_dir):
    return profile.value_counts(inputs.documents(spark, sf_dir), "source", by_value=True)


def class_value_counts(spark, sf_dir):
    return profile.value_counts(inputs.labels(spark, sf_dir), "y")


def length_by_class(spark, sf_dir):
    stats = profile.length_stats(inputs.corpus(spark, sf_dir), "y")
    return stats.select("y", F.round("mean_length", 6).alias("mean_length"), "median_length", "min_length", "max_length")


def length_histogram(spark, sf_dir):
    bins = profile.histogram(inputs.documents(spark, sf_dir), F.length("text"))
    return bins.select("bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n")


def truncated_texts(spark, sf_dir):
    share = profile.truncation_share(inputs.corpus(spark, sf_dir))
    return share.select("y", "n", "n_over", F.round("share_over", 6).alias("share_over"))


def quote_artifacts(spark, sf_dir):
    quoted = inputs.noisy(spark, sf_dir).withColumn(
        "text", F.when(F.col("row_id") % 3 == 0, F.concat(F.lit('"'), "text", F.lit('"'))).otherwise(F.col("text"))
    )
    return profile.quote_artifacts(quoted)


def quote_samples(spark, sf_dir):
    return profile.quote_samples(inputs.noisy(spark, sf_dir), '""', 3)


def inner_quote_samples(spark, sf_dir):
    """Whole texts with two quotes between word characters, a trace of doubled quoting."""
    return profile.quote_samples(_doubled(inputs.documents(spark, sf_dir)), profile.INNER_QUOTES, 3, None)


def _doubled(docs: DataFrame) -> DataFrame:
    """Every seventh document with two quotes for each quote and blank, as a second CSV quoting leaves them."""
    return docs.withColumn("text", F.when(F.col("row_id") % 7 == 3, F.regexp_replace("text", '["\']| ', '""')).otherwise(F.col("text")))


def short_text_top(spark, sf_dir):
    return profile.short_texts(apply_rules(inputs.noisy(spark, sf_dir)))


def short_text_count(spark, sf_dir):
    return profile.short_count(apply_rules(inputs.noisy(spark, sf_dir)))


_flag_sql = {
    n: f"((row_id >> {b + 1}) & (row_id >> {b + 2}) & 1)::INTEGER" for n, b in FLAG_BITS.items()
}
_flag_sql["identity_hate"] = f"CASE WHEN row_id % 5 <> 0 THEN {_flag_sql['identity_hate']} END"
_any_sql = "CASE WHEN " + " + ".join(f"coalesce({f}, 0)" for f in _flag_sql.values()) + " > 0 THEN 1 ELSE 0 END"
_name_sql = "CASE row_id % 5 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(LABEL_NAMES)) + " END"
_mapped_sql = f"CASE WHEN {_name_sql} = 'NORMAL' THEN 0 ELSE 1 END"
_line_text = f"trim(regexp_replace(text, '{LINE_BREAKS}', ' ', 'g') || ' ')"
_lines_sql = f"SELECT row_id, 'lines' AS source, rtrim({_line_text}) AS text, {_mapped_sql} AS y FROM docs WHERE row_id % 9 <> 0 AND row_id % 11 <> 0"
_turn_sql = f"""{hash_sql("concat_ws(':', conv_id, turn)")} % {STRIDE}"""
_union_sql = f"""
SELECT d.doc_id AS row_id, 'documents' AS source, d.text, l.toxic AS y FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
UNION ALL SELECT {STRIDE} + {_turn_sql}, 'conversations', text, 0 FROM conversations WHERE role <> 'assistant' OR role IS NULL
UNION ALL SELECT {2 * STRIDE} + {_turn_sql}, 'assistant', text, 1 FROM conversations WHERE role = 'assistant'
UNION ALL SELECT {3 * STRIDE} + page_id, 'pages', html, (page_id % 2)::INTEGER FROM pages"""

QUERIES = {
    "any_of_flags": any_of_flags,
    "csv_multilabel_round_trip": csv_multilabel_round_trip,
    "csv_binary_round_trip": csv_binary_round_trip,
    "fasttext_lines": fasttext_lines,
    "fasttext_round_trip": fasttext_round_trip,
    "label_mapping": label_mapping,
    "unified_union": unified_union,
    "missing_labels_dropped": missing_labels_dropped,
    "corpus_parquet_round_trip": _round_trip("parquet"),
    "corpus_csv_round_trip": _round_trip("csv"),
    "splits_round_trip": splits_round_trip,
    "corpus_overall": corpus_overall,
    "corpus_by_source": corpus_by_source,
    "source_value_counts": source_value_counts,
    "class_value_counts": class_value_counts,
    "source_counts_by_name": source_counts_by_name,
    "length_by_class": length_by_class,
    "length_histogram": length_histogram,
    "truncated_texts": truncated_texts,
    "quote_artifacts": quote_artifacts,
    "quote_samples": quote_samples,
    "inner_quote_samples": inner_quote_samples,
    "short_text_top": short_text_top,
    "short_text_count": short_text_count,
}

SQL = {
    "any_of_flags": with_ctes(("docs",), f"SELECT row_id, {_any_sql} AS y FROM docs"),
    "csv_multilabel_round_trip": with_ctes(
        ("docs",), f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, 'flags' AS source, text, {_any_sql} AS y FROM docs"
    ),
    "csv_binary_round_trip": with_ctes(
        ("corpus",), "SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, 'binary' AS source, text, y FROM corpus"
    ),
    "fasttext_lines": with_ctes(("docs",), _lines_sql),
    "fasttext_round_trip": with_ctes(
        ("docs",), f"""SELECT n.place AS row_id, source, text, y FROM ({_lines_sql}) l
JOIN (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS place FROM docs) n ON n.row_id = l.row_id"""
    ),
    "label_mapping": with_ctes(("docs",), f"SELECT row_id, {_mapped_sql} AS y FROM docs"),
    "unified_union": f"SELECT row_id, source, md5(text) AS text_md5, coalesce(y, -1) AS y FROM ({_union_sql})",
    "missing_labels_dropped": f"""SELECT source, count(*) AS n, round(avg(y), 6) AS toxic_rate
FROM ({_union_sql}) WHERE text IS NOT NULL AND y IS NOT NULL GROUP BY source""",
    "corpus_parquet_round_trip": with_ctes(("noisy_corpus",), "SELECT row_id, source, text, y FROM noisy_corpus"),
    "corpus_csv_round_trip": with_ctes(("noisy_corpus",), "SELECT row_id, source, text, y FROM noisy_corpus"),
    "splits_round_trip": with_ctes(
        ("splits",), "SELECT row_id, y, split, md5(text) AS text_md5 FROM splits"
    ),
    "corpus_overall": with_ctes(("corpus",), "SELECT count(*) AS n, round(avg(y), 6) AS toxic_rate FROM corpus"),
    "corpus_by_source": with_ctes(
        ("corpus",), "SELECT source, count(y) AS n, round(avg(y), 6) AS toxic_rate FROM corpus GROUP BY source"
    ),
    "source_value_counts": with_ctes(("docs",), """SELECT source, count(*) AS n,
  round(count(*)::DOUBLE * 100 / (SELECT count(source) FROM docs), 1) AS percent FROM docs WHERE source IS NOT NULL GROUP BY source"""),
    "source_counts_by_name": with_ctes(("docs",), """SELECT source, count(*) AS n,
  round(count(*)::DOUBLE * 100 / (SELECT count(source) FROM docs), 1) AS percent FROM docs WHERE source IS NOT NULL GROUP BY source"""),
    "class_value_counts": with_ctes(("rows",), """SELECT y, count(*) AS n,
  round(count(*)::DOUBLE * 100 / (SELECT count(y) FROM rows), 1) AS percent FROM rows WHERE y IS NOT NULL GROUP BY y"""),
    "length_by_class": with_ctes(("corpus",), """SELECT y, round(avg(length(text)), 6) AS mean_length,
  median(length(text)) AS median_length, min(length(text))::INTEGER AS min_length, max(length(text))::INTEGER AS max_length
FROM corpus GROUP BY y"""),
    "length_histogram": with_ctes(("docs",), """, lens AS (SELECT length(text)::DOUBLE AS x FROM docs),
edges AS (
  SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS a,
         CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS b FROM lens),
counts AS (SELECT least(floor((x - a) * 50 / (b - a))::BIGINT, 49) AS bin, count(*) AS n FROM lens, edges GROUP BY 1)
SELECT t.bin, round(a + t.bin * ((b - a) / 50), 6) AS lower, round(a + (t.bin + 1) * ((b - a) / 50), 6) AS upper,
  coalesce(c.n, 0) AS n
FROM range(50) t(bin) CROSS JOIN edges LEFT JOIN counts c ON c.bin = t.bin""".lstrip()),
    "truncated_texts": with_ctes(("corpus",), f"""SELECT y, count(*) AS n, count(*) FILTER (k > 128) AS n_over,
  round(count(*) FILTER (k > 128)::DOUBLE / count(*), 6) AS share_over
FROM (SELECT y, len({inputs.lower_tokens("text")}) AS k FROM corpus) GROUP BY y"""),
    "quote_artifacts": with_ctes(("noisy",), """SELECT
  count(*) FILTER (starts_with(t, '"')) AS n_starts, count(*) FILTER (ends_with(t, '"')) AS n_ends,
  count(*) FILTER (starts_with(t, '"') AND ends_with(t, '"')) AS n_both,
  count(*) FILTER (regexp_matches(t, '[\\p{L}\\p{N}_]""[\\p{L}\\p{N}_]')) AS n_inner
FROM (SELECT CASE WHEN row_id % 3 = 0 THEN '"' || text || '"' ELSE text END AS t FROM noisy)"""),
    "quote_samples": with_ctes(("noisy",), """SELECT row_id, substr(text, 1, 100) AS sample FROM noisy
WHERE contains(text, '""') ORDER BY row_id LIMIT 3"""),
    "inner_quote_samples": with_ctes(("docs",), f"""SELECT row_id, text AS sample FROM (
  SELECT row_id, CASE WHEN row_id % 7 = 3 THEN {inputs.replace_all('text', '["'']| ', '""')} ELSE text END AS text FROM docs)
WHERE regexp_matches(text, '{profile.INNER_QUOTES}') ORDER BY row_id LIMIT 3"""),
    "short_text_top": with_ctes(("traced",), """SELECT after_final_whitespace AS text, count(*) AS n FROM traced11
WHERE length(after_final_whitespace) <= 5 GROUP BY 1 ORDER BY n DESC, text LIMIT 10"""),
    "short_text_count": with_ctes(
        ("traced",), "SELECT count(*) FILTER (length(after_final_whitespace) <= 2) AS n_short FROM traced11"
    ),
}
