"""Cleaning rules one by one, the whole chain, language detection and the (de)obfuscation rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from civiltext.functions import text as rules
from civiltext.operators import cleaning, compare, profile
from civiltext.plans import inputs
from civiltext.plans.inputs import clean_step, replace_all, with_ctes

def _rule(name: str, source):
    def query(spark, sf_dir):
        return source(spark, sf_dir).select("row_id", cleaning.RULES[name](F.col("text")).alias("text"))
    return query


def text_lengths(spark, sf_dir):
    return inputs.multilingual(spark, sf_dir).select("row_id", F.coalesce(rules.text_length(F.col("text")), F.lit(-1)).alias("length"))


def languages(spark, sf_dir):
    return inputs.multilingual(spark, sf_dir).select("row_id", rules.detect_language(F.col("text")).alias("language"))


def language_counts(spark, sf_dir):
    tagged = inputs.multilingual(spark, sf_dir).withColumn("language", rules.detect_language(F.col("text")))
    return profile.value_counts(tagged, "language")


def cleaned_documents(spark, sf_dir):
    return cleaning.clean_text(inputs.noisy(spark, sf_dir))


def cleaned_pages(spark, sf_dir):
    return cleaning.clean_text(inputs.pages(spark, sf_dir))


def toxicity_after_cleaning(spark, sf_dir):
    """Toxicity rate by language and source of the cleaned corpus."""
    cleaned = cleaning.clean_text(inputs.noisy_corpus(spark, sf_dir))
    stats = profile.stats_by(cleaned.withColumn("language", rules.detect_language(F.col("text"))), "language", "source")
    return stats.select("language", "source", "n", F.round("toxic_rate", 6).alias("toxic_rate"))


def rule_impact(spark, sf_dir):
    return profile.rule_impact(inputs.noisy(spark, sf_dir))


def probe_counts(spark, sf_dir):
    return profile.probe_patterns(inputs.noisy(spark, sf_dir))


def dropped_by_stage(spark, sf_dir):
    stages = profile.dropped_counts(inputs.noisy(spark, sf_dir))
    return stages.select("stage", "before", "after", "dropped", F.round("percent", 6).alias("percent"))


def long_texts(spark, sf_dir):
    return cleaning.drop_short(inputs.noisy(spark, sf_dir), 7).select("row_id", F.length("text").alias("length"))


def token_sets(spark, sf_dir):
    tokens = F.array_sort(rules.token_set(F.col("text")))
    return inputs.documents(spark, sf_dir).select(
        "row_id", F.size(tokens).cast("bigint").alias("n_tokens"), F.array_join(tokens, " ").alias("tokens")
    )


def basic_normalized(spark, sf_dir):
    return inputs.noisy(spark, sf_dir).select("row_id", rules.basic_normalize(F.col("text")).alias("text"))


# evasions of each kind, for every text
SPELLED = " 1 y-o-u a.r.e aaan 1d10000t i d i o t; соrе ｉｄｉｏｔ 𝓲𝓭𝓲𝓸𝓽 𝟙𝔻𝟙𝟘𝕥 ⓘⓓⓘⓞⓣ 🅸🅳🅸🅾🆃 🇮🇩🇮🇴🇹 i\u0336d\u0336i\u0301o\u0308t й и\u0306 и\u0306\u0336 id\u200bi\u00adot"


def deobfuscated(spark, sf_dir):
    spelled = F.concat(F.col("text"), F.lit(SPELLED))
    return inputs.documents(spark, sf_dir).select("row_id", rules.deobfuscate(spelled).alias("text"))


def stress_texts(spark, sf_dir):
    return compare.stress_set(inputs.documents(spark, sf_dir)).select("row_id", "text")


def _rule_sql(name: str, source: str) -> str:
    return with_ctes((source,), f"SELECT row_id, {clean_step(name, 'text')} AS text FROM {source}")


def _page_sql(name: str) -> str:
    return f"SELECT page_id AS row_id, {clean_step(name, 'html')} AS text FROM pages"


_impact_parts = []
for _name, (_before, _after) in profile.RULE_STEPS.items():
    _probe = {
        "ips": rf"(^|[^{rules.WORD_CHARS}]){rules.ADDRESS}($|[^{rules.WORD_CHARS}])",
        "emails": rf"(^|[^{rules.WORD_CHARS}]){inputs.EMAIL_CORE}($|[^{rules.WORD_CHARS}])",
    }.get(_name, profile.RULE_PROBES[_name])
    _impact_parts.append(f"""SELECT '{_name}' AS rule, count(*) FILTER (regexp_matches({_before}, '{_probe}')) AS n_probe,
  count(*) FILTER ({_before} <> {_after}) AS n_changed,
  (SELECT {_before} FROM traced11 WHERE {_before} <> {_after} ORDER BY row_id LIMIT 1) AS example_before,
  (SELECT {_after} FROM traced11 WHERE {_before} <> {_after} ORDER BY row_id LIMIT 1) AS example_after
FROM traced11""")

_probe_parts = []
for _name, _pattern in profile.PROBES.items():
    _pattern = {"ip_addresses": rf"(^|[^{rules.WORD_CHARS}]){rules.ADDRESS}($|[^{rules.WORD_CHARS}])"}.get(_name, _pattern)
    _probe_parts.append(f"""SELECT '{_name}' AS probe, count(*) FILTER (regexp_matches(text, '{_pattern}')) AS n,
  (SELECT substr(text, 1, 100) FROM noisy WHERE regexp_matches(text, '{_pattern}') ORDER BY row_id LIMIT 1) AS example
FROM noisy""")

_dropped_sql = """, counts AS (
  SELECT count(*) AS total, count(*) FILTER (length(after_whitespace) > 0) AS filled,
         count(*) FILTER (length(after_final_whitespace) > 2) AS long FROM traced11),
stages AS (
  SELECT 'empty' AS stage, total AS before, filled AS after FROM counts
  UNION ALL SELECT 'short', filled, long FROM counts)
SELECT stage, before, after, before - after AS dropped, round((before - after) * 100.0::DOUBLE / before, 6) AS percent FROM stages"""

# Runs of lone letters are put between marks (U+0001); separators go only inside the marks.
_spaced = rf"(^|[^{rules.WORD_CHARS}])((?:\p{{L}}[ .*-]){{2,}}\p{{L}})($|[^{rules.WORD_CHARS}])"
_folded = replace_all(replace_all(replace_all(
    "translate(text, '" + rules.FORMS.replace("'", "''") + "', '" + rules.FORM_LETTERS.replace("'", "''") + "')",
    rules.PARTED, r"\1"), rules.MARKED, r"\1"), rules.PILED, "")
DEOBFUSCATE_CTES = f"""folded AS (SELECT * REPLACE ({_folded} AS text) FROM spelled),
marked AS (SELECT *, string_split(regexp_replace(text, '{_spaced}', '\\1\x01\\2\x01\\3', 'g'), '\x01') AS parts FROM folded),
joined AS (
  SELECT *, array_to_string(list_transform(parts, lambda p, i:
    CASE WHEN i % 2 = 0 THEN regexp_replace(p, '[ .*-]', '', 'g') ELSE p END), '') AS j FROM marked),
lettered AS (SELECT *, string_split(translate(j, '{rules.LEET_CHARS}', '{rules.LEET_LETTERS}'), '') AS c FROM joined),
squeezed AS (
  SELECT *, array_to_string(list_filter(c, lambda x, i: NOT (regexp_matches(x, '\\p{{L}}') AND i > 1 AND c[i - 1] = x AND (
    (i > 2 AND c[i - 2] = x) OR (i < len(c) AND c[i + 1] = x)))), '') AS s FROM lettered)"""
# of `squeezed`, the last of them
DEOBFUSCATED = f"""CASE WHEN {inputs.language_sql("text")} = 'English'
  THEN translate(s, '{rules.LOOKALIKE_CYRILLIC}', '{rules.LOOKALIKE_LATIN}') ELSE s END"""
_deobfuscate_ctes = f""", spelled AS (SELECT row_id, text || '{SPELLED}' AS text FROM docs),
{DEOBFUSCATE_CTES}
SELECT row_id, {DEOBFUSCATED} AS text FROM squeezed"""

STRESSED = f"""CASE ('0x' || substr(md5('stress:42:' || row_id), 1, 4))::BIGINT % 4
  WHEN 0 THEN {replace_all('text', r'(\p{L})', r'\1 ')}
  WHEN 1 THEN {replace_all('text', f'([{rules.VOWELS}])', r'\1\1\1')}
  WHEN 2 THEN translate(text, 'oieast', '013457')
  ELSE translate(text, '{rules.LOOKALIKE_LATIN}', '{rules.LOOKALIKE_CYRILLIC}') END"""
_stress_sql = f"SELECT row_id, {STRESSED} AS text FROM docs"

_on_pages = ("html_tags", "html_entities", "urls")
_on_noisy = ("html_tags", "urls", "control", "whitespace", "quotes", "wiki_meta", "ips", "emails", "replacement_char")

QUERIES = {
    "text_lengths": text_lengths,
    "languages": languages,
    "language_counts": language_counts,
    **{f"pages_strip_{n}": _rule(n, inputs.pages) for n in _on_pages},
    **{f"rule_{n}": _rule(n, inputs.noisy) for n in _on_noisy},
    "long_texts": long_texts,
    "cleaned_documents": cleaned_documents,
    "cleaned_pages": cleaned_pages,
    "toxicity_after_cleaning": toxicity_after_cleaning,
    "rule_impact": rule_impact,
    "probe_counts": probe_counts,
    "dropped_by_stage": dropped_by_stage,
    "token_sets": token_sets,
    "basic_normalized": basic_normalized,
    "deobfuscated": deobfuscated,
    "stress_texts": stress_texts,
}

SQL = {
    "text_lengths": with_ctes(("multilingual",), "SELECT row_id, coalesce(length(text), -1)::INTEGER AS length FROM multilingual"),
    "languages": with_ctes(
        ("multilingual",), f"SELECT row_id, {inputs.language_sql('text')} AS language FROM multilingual"
    ),
    "language_counts": with_ctes(("multilingual",), f"""SELECT language, count(*) AS n,
  round(count(*)::DOUBLE * 100 / (SELECT count(*) FROM multilingual), 1) AS percent
FROM (SELECT {inputs.language_sql('text')} AS language FROM multilingual) GROUP BY language"""),
    **{f"pages_strip_{n}": _page_sql(n) for n in _on_pages},
    **{f"rule_{n}": _rule_sql(n, "noisy") for n in _on_noisy},
    "long_texts": with_ctes(
        ("noisy",), "SELECT row_id, length(text)::INTEGER AS length FROM noisy WHERE length(text) > 7"
    ),
    "cleaned_documents": with_ctes(
        ("traced",), "SELECT row_id, after_final_whitespace AS text FROM traced11 WHERE length(after_final_whitespace) > 2"
    ),
    "cleaned_pages": f"""WITH source AS (SELECT page_id AS row_id, html AS text FROM pages), {inputs.traced_ctes("source", "p")}
SELECT row_id, after_final_whitespace AS text FROM p11 WHERE length(after_final_whitespace) > 2""",
    "toxicity_after_cleaning": with_ctes(
        ("traced_corpus",), f"""SELECT {inputs.language_sql('after_final_whitespace')} AS language, source, count(y) AS n,
  round(avg(y), 6) AS toxic_rate FROM traced_corpus11 WHERE length(after_final_whitespace) > 2 GROUP BY 1, 2"""
    ),
    "rule_impact": with_ctes(("traced",), " UNION ALL ".join(_impact_parts)),
    "probe_counts": with_ctes(("noisy",), " UNION ALL ".join(_probe_parts)),
    "dropped_by_stage": with_ctes(("traced",), _dropped_sql),
    "token_sets": with_ctes(("docs",), f"""SELECT row_id, len(t) AS n_tokens, array_to_string(list_sort(t), ' ') AS tokens
FROM (SELECT row_id, list_distinct({inputs.lower_tokens("text")}) AS t FROM docs)"""),
    "basic_normalized": with_ctes(
        ("noisy",), f"SELECT row_id, trim({replace_all('lower(text)', inputs.SPACE, ' ')}) AS text FROM noisy"
    ),
    "deobfuscated": with_ctes(("docs",), _deobfuscate_ctes),
    "stress_texts": with_ctes(("docs",), _stress_sql),
}
