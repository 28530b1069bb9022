"""Quality rules per document, and verdicts on hosts.

Each text is measured within its row. Rule failures are then counted per host, and the
rate of each host is shrunk towards that of all hosts: with a beta prior fitted to the
hosts' rates by its moments, a host with few documents is judged by the corpus, one with
many by itself. Verdicts are joined back to the documents. Native expressions only.

A null or empty text has no words and fails. Documents without a host (null) belong to no
host and are judged alone. Repeated rows are separate documents. An empty table gives no
rows. One host may hold any share of the rows: its counts are summed before the shuffle,
and the join back moves no texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiltext.llm.common import SPACE, WORD, documents, let, stored, text_or_empty

WINDOW = 8
LEAST_WORDS = 20
REPEATED_PERCENT = 30
# A host goes if its documents surely fail several times as often as the corpus, or, where many fail anyway, more often
# than half-way from the corpus to all. Sure is what still holds two posterior deviations lower: a few bad documents are
# no evidence against a host.
HOST_MULTIPLE = 3.0
DEVIATIONS = 2.0
SYMBOLS = "[#*$%&|<>]"


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words inside windows of `window` words that occur at least twice in the text."""

    def from_hashes(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def covered(ordered: Column) -> Column:
            def again(x: Column, i: Column) -> Column:
                before = F.get(ordered, i - 1)["h"]
                after = F.get(ordered, i + 1)["h"]
                return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

            places = F.array_sort(F.transform(F.filter(ordered, again), lambda x: x["i"]))
            # each window adds the words up to the next window, the last one all of its words
            return let(
                places,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(window)), F.lit(window))),
                    F.lit(0), lambda a, b: a + b,
                ),
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.sort_array(pairs), covered))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) <= window, 0).otherwise(let(hashes, from_hashes)).cast("bigint")


def text_measures(text: Column) -> Column:
    """A struct of counts of the text (not null)."""

    def from_words(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            F.size(F.regexp_extract_all(text, F.lit(SYMBOLS), F.lit(0))).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
        )

    # an empty piece can only stand before or after the words
    words = let(F.split(text, f"{SPACE}+", -1), lambda pieces: F.array_remove(pieces, F.lit("")))
    return let(words, from_words)


def failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (n_repeat_words * 100 > n_words * REPEATED_PERCENT)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Pseudo-counts of failures and passes, from mean and variance of the rates of `hosts (n, fails)`.

    Hosts weigh by their documents. The variance that sampling alone explains is taken off; if nothing
    is left, or there is no second host, the prior is the rate of all documents with the weight of a
    hundred of them.
    """
    rate = F.col("fails") / F.col("n")
    row = hosts.agg(
        F.sum("n").alias("n"), F.sum("fails").alias("fails"), F.count("*").alias("hosts"),
        F.sum(F.col("n") * rate * rate).alias("squares"),
    ).first()
    if not row.n:
        return 1.0, 1.0
    mean = row.fails / row.n
    if mean in (0.0, 1.0):
        return 100 * mean, 100 * (1 - mean)
    spread = mean * (1 - mean)
    between = (row.squares / row.n - mean**2 - spread * row.hosts / row.n) if row.hosts > 1 else 0.0
    weight = spread / between - 1 if 0 < between < spread else 100.0
    weight = min(max(weight, 1.0), 1e6)
    return mean * weight, (1 - mean) * weight


def host_verdicts(judged: DataFrame, host: str, base_failed: str = "base_failed", multiple: float = HOST_MULTIPLE) -> DataFrame:
    """`(host, host_docs, host_failures, host_rate, host_low, host_ok)`, one row per host: shrunk failure rates and their lower bounds."""
    hosts = judged.filter(F.col(host).isNotNull()).groupBy(host).agg(
        F.count("*").alias("n"), F.sum(F.col(base_failed).cast("bigint")).alias("fails")
    )
    hosts = stored(hosts, "hosts")
    a, b = beta_prior(hosts)
    mean = a / (a + b)
    limit = min(multiple * mean, (1 + mean) / 2)
    shrunk = (F.col("fails") + a) / (F.col("n") + (a + b))
    low = shrunk - F.lit(DEVIATIONS) * F.sqrt(shrunk * (F.lit(1.0) - shrunk) / (F.col("n") + (a + b + 1)))
    return hosts.select(
        host, F.col("n").alias("host_docs"), F.col("fails").alias("host_failures"), shrunk.alias("host_rate"), low.alias("host_low"),
        (low <= limit).alias("host_ok"),
    )


def judge(docs: DataFrame, id_column: str, host: str, multiple: float = HOST_MULTIPLE) -> DataFrame:
    """Counts of every text, whether its own rules reject it, and whether it is kept given its host."""
    # explode keeps the measures from being computed again for each of their fields
    measured = docs.select(id_column, host, F.explode(F.array(text_measures(text_or_empty("text")))).alias("m"))
    judged = stored(
        measured.select(id_column, host, "m.*").withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words"))),
        "judged",
    )
    verdicts = host_verdicts(judged, host, multiple=multiple)
    kept = ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))
    return judged.join(verdicts, host, "left").withColumn("kept", kept)


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources. Documents that pass on their own go with a host whose documents surely fail too often."""
    return judge(documents(spark, sf_dir).select("doc_id", "source", "text"), "doc_id", "source").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


# The SQL computes the same prior, rates and bounds.
SQL = {
    "op4_host_quality": rf"""WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, source, text, regexp_extract_all(text, '{WORD}') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM texts),
windows AS (SELECT doc_id, i, list_aggregate(w[i : i + {WINDOW - 1}], 'string_agg', ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words WHERE len(w) >= {WINDOW})),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, sum(least({WINDOW}, coalesce(following - i, {WINDOW})))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM twice) GROUP BY doc_id),
counts AS (SELECT words.doc_id, source, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(covered.n, 0)::BIGINT AS n_repeat_words FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed FROM counts),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::BIGINT)::DOUBLE AS fails FROM judged WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT sum(fails) / sum(n) AS mean, count(*) AS k, sum(n) AS n, sum(fails * fails / n) / sum(n) AS squares FROM hosts),
variance AS (SELECT mean, mean * (1 - mean) AS spread,
  CASE WHEN k > 1 THEN squares - mean * mean - mean * (1 - mean) * k / n ELSE 0 END AS "between" FROM moments),
prior AS (SELECT mean, CASE WHEN spread = 0 THEN 100 WHEN "between" > 0 AND "between" < spread
  THEN least(greatest(spread / "between" - 1, 1), 1000000) ELSE 100 END AS weight FROM variance),
rates AS (SELECT source, n, weight, mean, (fails + mean * weight) / (n + weight) AS rate FROM hosts, prior),
verdicts AS (SELECT source, rate - {DEVIATIONS} * sqrt(rate * (1 - rate) / (n + weight + 1)) <= least({HOST_MULTIPLE} * mean, (1 + mean) / 2) AS ok
  FROM rates)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, true) AS kept
FROM judged LEFT JOIN verdicts ON judged.source = verdicts.source"""
}
QUERIES = {"op4_host_quality": op4_host_quality}
