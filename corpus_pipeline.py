"""From `documents` to token files: language, near-duplicates, benchmark passages, mixture, tokens.

A stage takes (spark, docs, sf_dir), with the rows its predecessor kept, and returns what it keeps; all but the last
return the columns they were given. `run` writes each result as Parquet in the shared folder and reads it again.

Rows count as they are: equal ids, null ids, null texts and further columns may occur. The near-duplicate stage keeps
one row of each group, also of rows equal in everything; the mixture repeats rows; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiltext.llm import decontaminate, languages, mixing, simhash, tokens
from civiltext.llm.common import documents, free_name, stored
from civiltext.session import scratch_path


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or far from every language learned from the labelled ones, go."""
    model = languages.train(docs, "doc_id", "lang")
    return languages.speaks_a_known_language(docs, model).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by their fingerprints the one with the smallest id stays (a null id comes first)."""
    key = F.struct("doc_id", F.xxhash64("text").alias("of_text"))
    prints = stored(simhash.fingerprints(docs.select(key.alias("key"), "text"), "key"), "fingerprints")
    kept = stored(simhash.near_duplicates(prints).filter("id = component").select("id.*").distinct(), "kept")
    name = free_name(docs, "of_text")
    rows = docs.withColumn(name, F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows[name] == kept["of_text"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", name]).select(docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go whose text has a benchmark item in it; others of the same id, or without one, stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    key = F.struct("doc_id", F.xxhash64("text").alias("of_text"))
    found = decontaminate.contaminated(docs.select(key.alias("doc_id"), "text"), items)
    found = stored(found.select("doc_id.*").distinct(), "contaminated")
    name = free_name(docs, "of_text")
    rows = docs.withColumn(name, F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows[name] == found["of_text"])
    return rows.join(found, same, "left_anti").select(docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: not at all, once, or twice.

    Documents are told apart by id and text; those equal in both are decided one by one too, by a stored number.
    """
    row, n = free_name(docs, "row"), free_name(docs, "copies")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    key = F.struct("doc_id", F.xxhash64("text").alias("of_text"))
    sizes = stored(rows.select(F.col(row).alias("row"), key.alias("id"), "source", mixing.words_in(F.col("text")).alias("size")), "sizes")
    copies = mixing.mix(sizes).filter("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(n))
    taken = rows.join(copies, row)
    times = F.explode(F.sequence(F.lit(1), F.col(n))).alias(free_name(taken, "copy"))
    return taken.select(*[taken[c] for c in docs.columns], times).select(docs.columns)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of ids; returns what is read back from them per document."""
    manifest = tokens.write_tokens(docs, "doc_id", scratch_path(spark, "tokens"), tokens.tokenizer_path())
    return tokens.read_tokens(manifest)


STAGES = [
    ("language", keep_known_languages),
    ("near-duplicates", keep_one_of_each_group),
    ("decontamination", drop_benchmark_passages),
    ("mixture", mix_to_targets),
    ("tokens", write_token_files),
]
# fingerprints, tiling and tokens cannot be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
