"""The cleaning chain and its row filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiltext.functions import text as rules
from civiltext.functions.entities import unescape_html
from civiltext.functions.once import evaluated_once

Rule = Callable[[Column], Column]

# Fixed order: a later rule may expose a match for an earlier one, and that is kept.
RULES: dict[str, Rule] = {
    "html_tags": rules.strip_html_tags,
    "html_entities": unescape_html,
    "urls": rules.strip_urls,
    "control": rules.strip_control,
    "whitespace": rules.normalize_ws,
    "quotes": rules.collapse_quotes,
    "wiki_meta": rules.strip_wiki_meta,
    "ips": rules.strip_ips,
    "emails": rules.strip_emails,
    "replacement_char": rules.strip_replacement_char,
    "final_whitespace": rules.normalize_ws,
}
MIN_LENGTH = 2

# Texts that a CSV re-read by pandas would turn into missing values.
NA_LITERALS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns))


def drop_short(df: DataFrame, min_len: int, text_col: str = "text") -> DataFrame:
    """Keep texts longer than `min_len` code points."""
    return df.filter(F.length(text_col) > min_len)


def drop_na_literals(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Parity with a CSV round trip that reads `NA`, `null`, ... as missing."""
    return df.filter(~F.col(text_col).isin(*NA_LITERALS))


def apply_rules(df: DataFrame, text_col: str = "text", names: list[str] | None = None) -> DataFrame:
    """Rewrite `text_col` by the rules, one projection per rule, no row dropped."""
    for name in names or RULES:
        df = df.withColumn(text_col, RULES[name](F.col(text_col)))
    return df.withColumn(text_col, evaluated_once(F.col(text_col)))


def clean_text(df: DataFrame, text_col: str = "text", na_literals: str = "keep") -> DataFrame:
    """All rules, then drop what is left with two characters or fewer.

    A text that is empty half-way stays empty, so the last filter covers both drops.
    """
    if na_literals == "drop":
        df = drop_na_literals(df, text_col)
    return drop_short(apply_rules(df, text_col), MIN_LENGTH, text_col)


def traced_clean(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Every intermediate text of the chain as its own column `after_<rule>`, nothing dropped."""
    last = text_col
    for name, rule in RULES.items():
        df = df.withColumn(f"after_{name}", rule(F.col(last)))
        last = f"after_{name}"
    return df
