"""Corpus statistics and quality probes, each one pass over the table."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from civiltext.functions import text as rules
from civiltext.operators.cleaning import MIN_LENGTH, traced_clean
from civiltext.session import cut_lineage

# What the reports count, which is not always what a rule rewrites.
PROBES = {
    "repeated_punct": r"[!?]{3,}",
    "double_quotes": r'"{2,}',
    "wiki_timestamps": (
        rf"{rules.DIGIT}{{2}}:{rules.DIGIT}{{2}},{rules.SPACE}+{rules.WORD}+{rules.SPACE}+{rules.DIGIT}+,"
        rf"{rules.SPACE}+{rules.DIGIT}{{4}}{rules.SPACE}+\(UTC\)"
    ),
    "ip_addresses": rules.IP,
    "unicode_replacement": rules.REPLACEMENT_CHAR,
    "email": rf"{rules.NOT_SPACE}+@{rules.NOT_SPACE}+\.{rules.NOT_SPACE}+",
}


def _mail_pattern() -> str:
    inner = f"[^{rules.SPACE_CHARS}.@]"
    return rf"{rules.NOT_SPACE}@{rules.NOT_SPACE}{inner}*@?\.{rules.NOT_SPACE}"


RULE_PROBES = {
    "html": rf"<[^>]+>|&{rules.WORD}+;|&#{rules.DIGIT}+;",
    "urls": rules.URL,
    "control": rules.CONTROL,
    "whitespace": rf"{rules.SPACE}{{2,}}",
    "quotes": rules.QUOTES,
    "wiki_meta": rf"\(talk\)|{PROBES['wiki_timestamps']}",
    "ips": rules.IP,
    "emails": rules.EMAIL,
    "replacement_char": rules.REPLACEMENT_CHAR,
}
# pattern -> a literal that each of its matches contains, and a pattern that occurs in the same texts but is found faster
FOUND_BY = {
    PROBES["double_quotes"]: ('""', '""'),
    PROBES["wiki_timestamps"]: ("(UTC)", f"(?={rules.DIGIT}){PROBES['wiki_timestamps']}"),
    PROBES["ip_addresses"]: (".", f"(?={rules.DIGIT}){rules.IP}"),
    PROBES["unicode_replacement"]: (rules.REPLACEMENT_CHAR, rules.REPLACEMENT_CHAR),
    # from an @ no further than the next one or the first dot after the next character
    PROBES["email"]: ("@", _mail_pattern()),
}
RULE_STEPS = {
    "html": ("text", "after_html_entities"),
    "urls": ("after_html_entities", "after_urls"),
    "control": ("after_urls", "after_control"),
    "whitespace": ("after_control", "after_whitespace"),
    "quotes": ("after_whitespace", "after_quotes"),
    "wiki_meta": ("after_quotes", "after_wiki_meta"),
    "ips": ("after_wiki_meta", "after_ips"),
    "emails": ("after_ips", "after_emails"),
    "replacement_char": ("after_emails", "after_replacement_char"),
}


def overall_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg("y").alias("toxic_rate"))


def stats_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("y").alias("n"), F.avg("y").alias("toxic_rate"))


def value_counts(df: DataFrame, column: str, by_value: bool = False) -> DataFrame:
    """Counts and percentages, largest first and equal counts by value, or all by value."""
    counts = cut_lineage(df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")))
    shares = counts.withColumn("percent", F.round(F.col("n") * 100 / counts.agg(F.sum("n")).scalar(), 1))
    return shares.orderBy(column) if by_value else shares.orderBy(F.desc("n"), column)


def length_stats(df: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """Mean, exact median, smallest and largest length."""
    length = F.length(text_col)
    return df.groupBy(*keys).agg(
        F.avg(length).alias("mean_length"),
        F.median(length).alias("median_length"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
    )


def histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last closed on the right; empty bins included.

    A constant column gets the range value - 0.5 .. value + 0.5.
    """
    values = df.select(value.cast("double").alias("x"))
    low, high = values.agg(F.min("x")).scalar(), values.agg(F.max("x")).scalar()
    flat = low == high
    start, stop = F.when(flat, low - 0.5).otherwise(low), F.when(flat, high + 0.5).otherwise(high)
    ranged = values.filter(F.col("x").isNotNull()).withColumn("start", start).withColumn("stop", stop)
    index = F.floor((F.col("x") - F.col("start")) * bins / (F.col("stop") - F.col("start")))
    counts = ranged.groupBy(F.least(index, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    edges = grid.withColumn("start", start).withColumn("width", (stop - start) / bins)
    return edges.join(counts, "bin", "left").select(
        "bin",
        (F.col("start") + F.col("bin") * F.col("width")).alias("lower"),
        (F.col("start") + (F.col("bin") + 1) * F.col("width")).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _long_form(wide: DataFrame, names: list[str], fields: list[str], label: str) -> DataFrame:
    """One row per name from columns `<name>__<field>` of a one-row frame."""
    structs = [
        F.struct(F.lit(n).alias(label), *[F.col(f"{n}__{f}").alias(f) for f in fields]) for n in names
    ]
    return wide.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def rule_impact(df: DataFrame) -> DataFrame:
    """Per cleaning rule: rows its probe matches, rows its rewrite changes, and the first change.

    Both counts are given because probe and rewrite patterns differ for markup and time stamps.
    """
    traced = traced_clean(df)
    aggregates = []
    for name, (before, after) in RULE_STEPS.items():
        changed = F.col(before) != F.col(after)
        first = F.min_by(F.struct(before, after), F.when(changed, F.col("row_id")))
        aggregates += [
            F.count_if(F.col(before).rlike(RULE_PROBES[name])).alias(f"{name}__n_probe"),
            F.count_if(changed).alias(f"{name}__n_changed"),
            first[before].alias(f"{name}__example_before"),
            first[after].alias(f"{name}__example_after"),
        ]
    fields = ["n_probe", "n_changed", "example_before", "example_after"]
    return _long_form(traced.agg(*aggregates), list(RULE_STEPS), fields, "rule")


def occurs(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs in the text. A text without the literal of a known pattern skips the regex."""
    if pattern not in FOUND_BY:
        return text.rlike(pattern)
    literal, quick = FOUND_BY[pattern]
    return text.contains(literal) if literal == quick else text.contains(literal) & text.rlike(quick)


def probe_patterns(df: DataFrame, patterns: dict[str, str] = PROBES, width: int = 100) -> DataFrame:
    """Per pattern the number of matching rows and the start of the first one.

    Each row is probed once per pattern, below the aggregates that read the outcome twice.
    """
    hits = [occurs(F.col("text"), pattern).alias(f"{name}__hit") for name, pattern in patterns.items()]
    probed = df.select("row_id", F.substring("text", 1, width).alias("start"), *hits)
    aggregates = []
    for name in patterns:
        aggregates += [
            F.count_if(f"{name}__hit").alias(f"{name}__n"),
            F.min_by("start", F.when(F.col(f"{name}__hit"), F.col("row_id"))).alias(f"{name}__example"),
        ]
    return _long_form(probed.agg(*aggregates), list(patterns), ["n", "example"], "probe")


def quote_artifacts(df: DataFrame) -> DataFrame:
    """Texts that start, end, or both start and end with a double quote."""
    text = F.col("text")
    starts, ends = text.startswith('"'), text.endswith('"')
    return df.agg(
        F.count_if(starts).alias("n_starts"),
        F.count_if(ends).alias("n_ends"),
        F.count_if(starts & ends).alias("n_both"),
        F.count_if(text.rlike(INNER_QUOTES)).alias("n_inner"),
    )


INNER_QUOTES = rf'{rules.WORD}""{rules.WORD}'


def quote_samples(df: DataFrame, pattern: str = '^"', n: int = 3, width: int | None = 100) -> DataFrame:
    """The first rows that match, cut for reading, or whole if `width` is None."""
    sample = F.col("text") if width is None else F.substring("text", 1, width)
    return (
        df.filter(F.col("text").rlike(pattern))
        .select("row_id", sample.alias("sample"))
        .orderBy("row_id").limit(n)
    )


def short_texts(df: DataFrame, max_len: int = 5, top: int = 10) -> DataFrame:
    """The most frequent texts of at most `max_len` characters."""
    return (
        df.filter(F.length("text") <= max_len)
        .groupBy("text").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "text").limit(top)
    )


def short_count(df: DataFrame, max_len: int = MIN_LENGTH) -> DataFrame:
    return df.agg(F.count_if(F.length("text") <= max_len).alias("n_short"))


def dropped_counts(df: DataFrame) -> DataFrame:
    """Rows before and after the two length filters of the cleaning chain."""
    traced = traced_clean(df).select(
        (F.length("after_whitespace") > 0).alias("filled"),
        (F.length("after_final_whitespace") > MIN_LENGTH).alias("long"),
    )
    counts = traced.agg(
        F.count("*").alias("total"), F.count_if("filled").alias("filled"), F.count_if("long").alias("long")
    )
    stages = F.array(
        F.struct(F.lit("empty").alias("stage"), F.col("total").alias("before"), F.col("filled").alias("after")),
        F.struct(F.lit("short").alias("stage"), F.col("filled").alias("before"), F.col("long").alias("after")),
    )
    return with_dropped(counts.select(F.explode(stages).alias("s")).select("s.*"))


def with_dropped(stages: DataFrame) -> DataFrame:
    """Adds dropped rows and their percentage to `before` and `after`."""
    dropped = F.col("before") - F.col("after")
    share = F.coalesce(F.try_divide(dropped * 100.0, F.col("before").cast("double")), F.lit(0.0))
    return stages.withColumn("dropped", dropped).withColumn("percent", share)


def truncation_share(df: DataFrame, max_len: int = 128) -> DataFrame:
    """Share of texts over the token limit per class, by white-space tokens."""
    too_long = F.size(rules.tokens(F.col("text"))) > max_len
    return df.groupBy("y").agg(
        F.count("*").alias("n"),
        F.count_if(too_long).alias("n_over"),
        (F.count_if(too_long) / F.count("*")).alias("share_over"),
    )
