"""Secret scans over a ledger of blobs.

Every version of a text is a blob, named by the SHA-256 of its bytes. The ledger, a Parquet
folder, has one row per blob and rule version with the spans found. A scan keeps one copy
per blob (copies collapse before the shuffle), matches only the rules whose present version
the ledger lacks for that blob, appends those rows, and joins the spans back to all paths.
A later run joins the ids of its blobs with the ledger first. Texts of blobs with nothing
unseen are read, to name them, but go nowhere: up to half a million unseen blobs are
picked out where they are, by a broadcast of their ids; more are worth a shuffle of all.
Native expressions only.

A null text is the empty blob. Rows with equal paths stay separate rows. An empty table
gives no rows and an empty ledger. Columns of the input other than `text` and the path are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiltext.llm.common import documents, let, stored, text_or_empty
from civiltext.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """A match counts if its `group` has at least `least` characters; others are dropped, without retry."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORD = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
# three character classes that every keyword passes; few places of a text do, and only those try the alternatives
KEYWORD_START = "(?=[PpSsTtAa][AaEeOoPp][SsCcKkIi])"
# `access` and `hex` state their least length in the pattern, which finds the same runs as a test afterwards:
# a greedy match of one character class always takes a whole run.
BASE = (
    Rule("assign", 1, f"{KEYWORD_START}({KEYWORD})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, "AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, "[0-9a-f]{32,}"),
)
# Public token formats, in addition to the base kinds. No group is repeated, since Java matches that by recursion, and what
# may fail after a long run has a bound: neither long texts nor repetitive ones are a danger.
MORE = (
    Rule("forge", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", 1, "xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("maps", 1, "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", 2, r"eyJ[A-Za-z0-9_-]{10,500}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", 2, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE
MOST_UNSEEN = 500_000  # blob ids of 32 bytes in a broadcast
LEDGER_SCHEMA = "blob binary, rule string, spans array<struct<start: bigint, stop: bigint>>"


def blob_id(text: Column | str) -> Column:
    return F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256))


def rule_spans(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches as (start, stop) in code points.

    The pieces between the matches, from the same pattern, tell where each match starts.
    """
    pattern = F.lit(rule.pattern)
    nothing = F.expr("CAST(array() AS array<struct<start: bigint, stop: bigint>>)")

    def located(hits: Column) -> Column:
        rows = F.arrays_zip(
            F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("bigint")).alias("gap"),
            F.transform(hits, lambda x: F.length(x).cast("bigint")).alias("width"),
            F.transform(F.regexp_extract_all(text, pattern, rule.group), F.length).alias("checked"),
        )
        begin = F.struct(F.lit(0).cast("bigint").alias("at"), nothing.alias("found"))

        def step(state: Column, row: Column) -> Column:
            start = state["at"] + row["gap"]
            stop = start + row["width"]
            span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
            return F.struct(
                stop.alias("at"),
                F.when(row["checked"] >= rule.least, F.concat(state["found"], span)).otherwise(state["found"]).alias("found"),
            )

        # the piece after the last match has no width
        return F.aggregate(F.slice(rows, F.lit(1), F.size(hits)), begin, step, lambda state: state["found"])

    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    return let(matches, lambda hits: F.when(F.size(hits) > 0, located(hits)).otherwise(nothing))


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at `path`, created if there is none."""
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the unseen pairs of blob and rule version of `versions.text`, append them, and return the ledger."""
    spark = versions.sparkSession
    ledger = open_ledger(spark, path)
    current = [r.key for r in rules]
    seen = ledger.filter(F.col("rule").isin(current)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    text = text_or_empty("text")
    named = versions.select(blob_id("text").alias("blob"), text.alias("text"))
    if not ledger.filter(F.col("rule").isin(current)).isEmpty():
        ids = named.select("blob").distinct().join(seen, "blob", "left")
        unseen = stored(ids.filter(F.coalesce(F.size("seen"), F.lit(0)) < len(current)).select("blob"), "unseen-blobs")
        if unseen.count() <= MOST_UNSEEN:
            named = named.join(F.broadcast(unseen), "blob", "left_semi")
    blobs = named.groupBy("blob").agg(F.first("text").alias("text"))
    pending = blobs.join(seen, "blob", "left")
    known = F.coalesce(F.col("seen"), F.expr("CAST(array() AS array<string>)"))
    scans = [
        F.when(~F.array_contains(known, r.key), F.struct(F.lit(r.key).alias("rule"), rule_spans(F.col("text"), r).alias("spans")))
        for r in rules
    ]
    # a plain array(...) under explode: Spark would evaluate any other array a second time to test its size
    pairs = pending.select("blob", F.explode(F.array(*scans)).alias("pair")).filter("pair IS NOT NULL")
    pairs.select("blob", "pair.rule", "pair.spans").write.mode("append").parquet(path)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def findings(versions: DataFrame, ledger: DataFrame, path_column: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`(path, found)` for every row: spans of the current rules, by start, then in the order of `rules`."""
    order = {r.key: i for i, r in enumerate(rules)}
    kinds = F.create_map(*[x for r in rules for x in (F.lit(r.key), F.lit(r.kind))])
    ranks = F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))])
    spans = ledger.filter(F.col("rule").isin(list(order)) & (F.size("spans") > 0)).select(
        "blob",
        F.transform(
            "spans",
            lambda s: F.struct(s["start"].alias("start"), ranks[F.col("rule")].alias("rank"), s["stop"].alias("stop"), kinds[F.col("rule")].alias("kind")),
        ).alias("spans"),
    )
    # a set: a scan repeated by a second writer leaves equal rows
    per_blob = spans.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("found"))
    paths = versions.select(F.col(path_column).alias("path"), blob_id("text").alias("blob"))
    none = F.expr("CAST(array() AS array<struct<start: bigint, rank: int, stop: bigint, kind: string>>)")
    return paths.join(per_blob, "blob", "left").select("path", F.coalesce("found", none).alias("found"))


def joined(found: Column) -> Column:
    """Spans as `kind:start:stop`, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ledger = update_ledger(docs, scratch_path(spark, "secret-ledger"))
    base = [r.kind for r in BASE]

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return findings(docs, ledger, "doc_id").select(
        F.col("path").alias("doc_id"),
        *[count(kind) for kind in base],
        F.sha2(joined(F.filter("found", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def _sql() -> str:
    parts = []
    for rank, r in enumerate(RULES):
        pattern = r.pattern.removeprefix(KEYWORD_START).replace("'", "''")
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, i, gap, width, {r.least} AS least, checked FROM (
  SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, unnest(list_transform(pieces[1 : len(hits)], lambda x: length(x))) AS gap,
    unnest(list_transform(hits, lambda x: length(x))) AS width, unnest(list_transform(checked, lambda x: length(x))) AS checked
  FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS pieces, regexp_extract_all(text, '{pattern}', 0) AS hits,
    regexp_extract_all(text, '{pattern}', {r.group}) AS checked FROM texts))""")
    union = "\nUNION ALL ".join(parts)
    base = len(BASE)
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop)"
    counts = ", ".join(f"coalesce(f.n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({union}),
located AS (SELECT *, (sum(gap + width) OVER (PARTITION BY doc_id, rank ORDER BY i))::BIGINT AS stop FROM raw),
spans AS (SELECT doc_id, rank, kind, stop - width AS start, stop FROM located WHERE checked >= least),
found AS (SELECT doc_id, {", ".join(f"count(*) FILTER (rank = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))},
  {listed} FILTER (rank < {base}) AS base, {listed} AS spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, {counts}, sha256(coalesce(f.base, '')) AS base_sha256, coalesce(f.spans, '') AS spans
FROM texts t LEFT JOIN found f ON t.doc_id = f.doc_id"""


QUERIES = {"op1_secrets": op1_secrets}
SQL = {"op1_secrets": _sql()}
