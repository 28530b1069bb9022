"""The given tables seen as corpora, in Spark and, under the same name, as SQL.

`documents` hold none of the markup the cleaning rules look for, so `noisy` appends some to
each whole text, by expression, and adds very short texts made of the other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiltext.functions import text as rules
from civiltext.functions.hashing import NUM_PERM, PRIME, text_hash
from civiltext.operators.dedup import THRESHOLD, band_plan
from civiltext.operators.sampling import make_splits

VARIANTS = 4  # rows derived from one document get the ids 4 * doc_id and on

# Appended to text number doc_id modulo the length of the list.
NOISE = (
    " (talk) 12:34, May 5, 2006 (UTC)",
    " see <b>bold</b> &amp; https://ex.org/a?b=1 now",
    ' said ""hi"" to a.b+c@mail.org.',
    " 10.0.0.1 x\x07y� z",
    "  \t tab!!! ",
    " привет &quot;мир&quot; www.ya.ru/путь конец",
    "",
)
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстуввхыз"
# Pseudo-scores: salt -> how much of the score the label decides, in thousandths.
SCORERS = {"blind": 0, "fair": 300, "sharp": 900}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "source", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("row_id"), F.col("html").alias("text"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("y"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).join(labels(spark, sf_dir), "row_id").select("row_id", "source", "text", "y")


def _with_noise(df: DataFrame) -> DataFrame:
    choice = F.array(*[F.lit(n) for n in NOISE])
    noise = F.element_at(choice, (F.col("row_id") % len(NOISE) + 1).cast("int"))
    return df.withColumn("text", F.concat("text", noise))


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    first = F.col("doc_id") * VARIANTS
    whole = _with_noise(documents(spark, sf_dir)).select((F.col("row_id") * VARIANTS).alias("row_id"), "text")
    only_tag = docs.select((first + 1).alias("row_id"), F.concat(F.lit("<"), "source", F.lit(">")).alias("text"))
    tiny = docs.select((first + 2).alias("row_id"), F.concat(F.lit("<i>"), "lang", F.lit("</i>")).alias("text"))
    return whole.unionByName(only_tag).unionByName(tiny)


def noisy_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_noise(corpus(spark, sf_dir))


def multilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, their Cyrillic transcriptions, digits only, and missing texts."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text", "n_chars")
    variants = F.array(
        F.col("text"), F.translate(F.lower("text"), LATIN, CYRILLIC), F.col("n_chars").cast("string"),
        F.lit(None).cast("string"),
    )
    return docs.select("row_id", F.posexplode(variants).alias("variant", "text")).select(
        (F.col("row_id") * VARIANTS + F.col("variant")).alias("row_id"), "text"
    )


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make_splits(corpus(spark, sf_dir))


def scored_by(rows: DataFrame, scorer: str) -> DataFrame:
    """`(row_id, y, p_toxic)` with a score in thousandths from a hash and the label; it has ties."""
    signal = SCORERS[scorer]
    points = text_hash(F.concat(F.lit(f"{scorer}:"), F.col("row_id").cast("string"))) % 1000 + F.col("y") * signal
    return rows.withColumn("p_toxic", points.cast("double") / F.lit(1000.0 + signal))


def scored(spark: SparkSession, sf_dir: str, scorer: str = "fair") -> DataFrame:
    return scored_by(labels(spark, sf_dir), scorer)


def scored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels(spark, sf_dir)
    first, *others = [scored_by(rows, s).withColumn("model", F.lit(s)) for s in SCORERS]
    for other in others:
        first = first.unionByName(other)
    return first


# --- the same in SQL -------------------------------------------------------------------

SPACE = f"{rules.SPACE}+"
TIMES = {"ips", "emails"}  # rules whose neighbours are captured, hence applied twice


def replace_all(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"


def _between(text: str, core: str) -> str:
    """Remove `core` where no word character touches it, without lookaround."""
    pattern = rf"(^|[^{rules.WORD_CHARS}]){core}($|[^{rules.WORD_CHARS}])"
    return replace_all(replace_all(text, pattern, r"\1\2"), pattern, r"\1\2")


EMAIL_CORE = rf"{rules.WORD}[\p{{L}}\p{{N}}_.+-]*@[\p{{L}}\p{{N}}_-]+\.[a-zA-Z]{{2,}}"


def clean_step(rule: str, text: str) -> str:
    """A cleaning rule as SQL. The entities are those that occur in the tables; `&amp;` comes last."""
    if rule == "html_tags":
        return replace_all(text, rules.TAG, " ")
    if rule == "html_entities":
        for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
            text = f"replace({text}, '&{name};', '{char}')"
        return text
    if rule == "urls":
        return replace_all(text, rules.URL)
    if rule == "control":
        return replace_all(text, rules.CONTROL)
    if rule in ("whitespace", "final_whitespace"):
        return f"trim({replace_all(text, SPACE, ' ')})"
    if rule == "quotes":
        return replace_all(text, rules.QUOTES, '"')
    if rule == "wiki_meta":
        return replace_all(f"replace({text}, '(talk)', '')", rules.SIGNATURE)
    if rule == "ips":
        return _between(text, rules.ADDRESS)
    if rule == "emails":
        return _between(text, EMAIL_CORE)
    if rule == "replacement_char":
        return f"replace({text}, '{rules.REPLACEMENT_CHAR}', '')"
    raise KeyError(rule)


CLEAN_ORDER = (
    "html_tags", "html_entities", "urls", "control", "whitespace", "quotes", "wiki_meta", "ips", "emails",
    "replacement_char", "final_whitespace",
)


def traced_ctes(source: str, prefix: str) -> str:
    """CTEs `<prefix>0 .. <prefix>11`, one per rule; the last has every intermediate text."""
    parts, last = [], "text"
    parts.append(f"{prefix}0 AS (SELECT * FROM {source})")
    for i, rule in enumerate(CLEAN_ORDER):
        parts.append(f"{prefix}{i + 1} AS (SELECT *, {clean_step(rule, last)} AS after_{rule} FROM {prefix}{i})")
        last = f"after_{rule}"
    return ",\n".join(parts)


_noise_case = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NOISE))
_noise_text = f"text || CASE doc_id % {len(NOISE)} {_noise_case} END"


def hash_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def score_sql(scorer: str, row_id: str = "row_id", y: str = "y") -> str:
    signal = SCORERS[scorer]
    key = f"'{scorer}:' || {row_id}"
    return f"({hash_sql(key)} % 1000 + {y} * {signal})::DOUBLE / {1000.0 + signal}::DOUBLE"


def lower_tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{SPACE}'), lambda t: t <> '')"


def language_sql(text: str) -> str:
    cyrillic = f"length(regexp_replace({text}, '[^{rules.CYRILLIC}]', '', 'g'))"
    latin = f"length(regexp_replace({text}, '[^{rules.LATIN}]', '', 'g'))"
    return (
        f"CASE WHEN {text} IS NULL THEN 'unknown' WHEN {cyrillic} > {latin} THEN 'Russian' "
        f"WHEN {latin} > 0 THEN 'English' ELSE 'Other' END"
    )


def _stratified(source: str, name: str, salt: str, fraction: float, keep: str) -> str:
    """CTEs that rank `source` per class and give each class its share by largest remainder."""
    return f"""
{name}_classes AS (SELECT y, count(*) AS n FROM {source} GROUP BY y),
{name}_size AS (SELECT ceil({fraction}::DOUBLE * sum(n))::BIGINT AS size, sum(n) AS total FROM {name}_classes),
{name}_shares AS (
  SELECT y, n::DOUBLE / total::DOUBLE * size AS exact, floor(n::DOUBLE / total::DOUBLE * size)::BIGINT AS base, size
  FROM {name}_classes, {name}_size),
{name}_quota AS (
  SELECT y, base + CASE WHEN row_number() OVER (ORDER BY exact - base DESC, y) <= size - (SELECT sum(base) FROM {name}_shares)
    THEN 1 ELSE 0 END AS quota FROM {name}_shares),
{name}_ranked AS (
  SELECT {keep}, row_number() OVER (PARTITION BY y ORDER BY md5('{salt}:42:' || row_id), row_id) AS rank_{name}
  FROM {source})"""


def buckets_cte(threshold: float, name: str = "") -> str:
    bands, rows = band_plan(threshold)
    return f"""buckets{name} AS (
  SELECT row_id, band::INTEGER AS band,
    md5(band || ',' || array_to_string(signature[band * {rows} + 1 : band * {rows} + {rows}], ',')) AS bucket
  FROM signatures, range({bands}) t(band))"""


def walk_ctes(name: str = "") -> str:
    """The first-row-wins walk as a recursion over the rows that have an earlier neighbour."""
    return f"""pairs{name} AS (
  SELECT DISTINCT a.row_id AS i, b.row_id AS j
  FROM buckets{name} a JOIN buckets{name} b ON a.bucket = b.bucket AND a.row_id < b.row_id),
nodes{name} AS (
  SELECT j AS id, earlier, row_number() OVER (ORDER BY j) AS rn
  FROM (SELECT j, list(i) AS earlier FROM pairs{name} GROUP BY j)),
walk{name} AS (
  SELECT 0::BIGINT AS rn, CAST([] AS BIGINT[]) AS gone
  UNION ALL
  SELECT n.rn, CASE WHEN len(list_filter(n.earlier, lambda e: NOT list_contains(w.gone, e))) > 0
    THEN list_append(w.gone, n.id) ELSE w.gone END
  FROM walk{name} w JOIN nodes{name} n ON n.rn = w.rn + 1),
dropped{name} AS (SELECT unnest(gone) AS row_id FROM walk{name} WHERE rn = (SELECT max(rn) FROM walk{name}))"""


# name -> (CTEs it needs, its own text); composed by `with_ctes`
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": ((), "docs AS (SELECT doc_id AS row_id, source, text FROM documents)"),
    "corpus": ((), """corpus AS (
  SELECT d.doc_id AS row_id, d.source, d.text, l.toxic AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""),
    "noisy": ((), f"""noisy AS (
  SELECT doc_id * {VARIANTS} AS row_id, {_noise_text} AS text FROM documents
  UNION ALL SELECT doc_id * {VARIANTS} + 1, '<' || source || '>' FROM documents
  UNION ALL SELECT doc_id * {VARIANTS} + 2, '<i>' || lang || '</i>' FROM documents)"""),
    "noisy_corpus": ((), f"""noisy_corpus AS (
  SELECT d.doc_id AS row_id, d.source, {_noise_text.replace("text", "d.text").replace("doc_id", "d.doc_id")} AS text, l.toxic AS y
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""),
    "multilingual": ((), f"""multilingual AS (
  SELECT doc_id * {VARIANTS} AS row_id, text FROM documents
  UNION ALL SELECT doc_id * {VARIANTS} + 1, translate(lower(text), '{LATIN}', '{CYRILLIC}') FROM documents
  UNION ALL SELECT doc_id * {VARIANTS} + 2, n_chars::VARCHAR FROM documents
  UNION ALL SELECT doc_id * {VARIANTS} + 3, NULL FROM documents)"""),
    "traced": (("noisy",), traced_ctes("noisy", "traced")),
    "traced_corpus": (("noisy_corpus",), traced_ctes("noisy_corpus", "traced_corpus")),
    "rows": ((), "rows AS (SELECT doc_id AS row_id, toxic AS y FROM labels)"),
    "scored": (("rows",), f"scored AS (SELECT row_id, y, {score_sql('fair')} AS p_toxic FROM rows)"),
    "scored_models": (("rows",), "scored_models AS (" + " UNION ALL ".join(
        f"SELECT '{s}' AS model, row_id, y, {score_sql(s)} AS p_toxic FROM rows" for s in SCORERS) + ")"),
    "splits": (("corpus",), f"""{_stratified("corpus", "test", "test", 0.2, "*")},
after_test AS (
  SELECT r.row_id, r.source, r.text, r.y, CASE WHEN rank_test <= quota THEN 'test' ELSE 'train' END AS split
  FROM test_ranked r JOIN test_quota q ON r.y = q.y),
pool AS (SELECT * FROM after_test WHERE split = 'train'),
{_stratified("pool", "val", "val", 0.1, "*")},
splits AS (
  SELECT row_id, source, text, y, split FROM after_test WHERE split = 'test'
  UNION ALL
  SELECT r.row_id, r.source, r.text, r.y, CASE WHEN rank_val <= quota THEN 'val' ELSE 'train' END
  FROM val_ranked r JOIN val_quota q ON r.y = q.y)"""),
    "signatures": (("docs",), f"""hashes AS (
  SELECT row_id, {hash_sql("token")} % {PRIME} AS x
  FROM (SELECT row_id, unnest(list_distinct({lower_tokens("text")})) AS token FROM docs)),
perms AS (
  SELECT s, 1 + {hash_sql("'multiplier:' || s")} % {PRIME - 1} AS a, {hash_sql("'offset:' || s")} % {PRIME} AS b
  FROM range({NUM_PERM}) t(s)),
minima AS (SELECT row_id, s, min((a * x + b) % {PRIME}) AS v FROM hashes, perms GROUP BY row_id, s),
signatures AS (
  SELECT d.row_id, CASE WHEN m.sig IS NULL THEN list_transform(range({NUM_PERM}), lambda i: {PRIME}::BIGINT) ELSE m.sig END AS signature
  FROM docs d LEFT JOIN (SELECT row_id, list(v ORDER BY s) AS sig FROM minima GROUP BY row_id) m ON d.row_id = m.row_id)"""),
    "buckets": (("signatures",), buckets_cte(THRESHOLD)),
    "dropped": (("buckets",), walk_ctes()),
    "terms": (("docs",), f"""words AS (
  SELECT row_id, regexp_extract_all(lower(text), '{rules.WORD}{{2,}}') AS w FROM docs),
terms AS (
  SELECT row_id, w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS terms FROM words)"""),
    "vocab": (("terms",), """occurrences AS (SELECT row_id, unnest(terms) AS term FROM terms),
term_counts AS (SELECT term, count(DISTINCT row_id) AS df, count(*) AS tf FROM occurrences GROUP BY term),
n_rows AS (SELECT count(*) AS n FROM terms),
vocab AS (
  SELECT term, df, tf, ln((1 + n)::DOUBLE / (1 + df)::DOUBLE) + 1 AS idf FROM term_counts, n_rows
  WHERE df >= 5 AND df <= 0.8::DOUBLE * n ORDER BY tf DESC, term LIMIT 10000)"""),
}


def with_ctes(names: tuple[str, ...], body: str, recursive: bool = False) -> str:
    """`WITH ... body`, with everything the named CTEs depend on, once and in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    keyword = "WITH RECURSIVE " if recursive or "dropped" in order else "WITH "
    return keyword + ",\n".join(CTES[n][1] for n in order) + f"\n{body}"
