"""Edge rows per cleaning rule; expected values are what Python's `re` and `html` give."""

import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from civiltext.functions import text as rules
from civiltext.functions.entities import unescape_html
from civiltext.operators import cleaning

# Input and expected output per rule.
CASES = {
    rules.strip_html_tags: [("a<b\nc>d", "a d"), ("1 < 2", "1 < 2"), ("<>", "<>"), (None, None)],
    unescape_html: [
        ("&amp;lt;", "&lt;"), ("&ampx", "&x"), ("&#0;", "�"), ("&nosuch;", "&nosuch;"), ("plain", "plain"),
        ("&#x41;&eacute;", "Aé"), (None, None),
    ],
    rules.strip_urls: [("see https://a.b/c,d e", "see  e"), ("awww.x y", "a y"), ("http: no", "http: no"), (None, None)],
    rules.strip_control: [("a\x00b\x85c\td\x7f\xa0", "abc\td\xa0"), (None, None)],
    rules.normalize_ws: [(" a \n b ", "a b"), ("a b", "a b"), ("a  b", "a b"), ("　a\xa0 b\x1c", "a b"), (None, None)],
    rules.collapse_quotes: [('a""b"""c"d', 'a"b"c"d'), (None, None)],
    rules.strip_wiki_meta: [("x (talk) 9:05, May 5, 2006 (UTC)", "x  "), ("12:34, мая 5, 2006 (UTC)", ""), (None, None)],
    rules.strip_ips: [
        ("1.1.1.1 2.2.2.2 3.3.3.3", "  "), ("é1.2.3.4", "é1.2.3.4"), ("1.2.3.4é", "1.2.3.4é"), ("a_1.2.3.4", "a_1.2.3.4"),
        ("1.2.3.4567", "1.2.3.4567"), ("(10.0.0.1)", "()"), ("1.2.3.4.5", ".5"), ("999.999.999.999", ""), (None, None),
    ],
    rules.strip_emails: [
        ("a@b.co.uk x", ".uk x"), (".foo@bar.com", "."), ("a@b.c", "a@b.c"), ("a@b.comé", "a@b.comé"),
        ("aa@bb.cc dd@ee.ff", " "), ("é.foo@bar.com", ""), ("x@y.org.x@y.org", ""), (None, None),
    ],
    rules.strip_replacement_char: [("a�b", "ab"), (None, None)],
    rules.detect_language: [
        (None, "unknown"), ("123", "Other"), ("аa", "English"), ("ааа", "Russian"), ("İ", "English"), ("été", "English"),
    ],
    rules.basic_normalize: [("  A \t B", "a b")],
    rules.deobfuscate: [
        ("i d i o t", "idiot"), ("f.o.o", "foo"), ("a b", "a b"), ("ab c d", "ab c d"), ("1d10t", "idiot"),
        ("cooool", "col"), ("соrе text", "core text"), ("соrе x", "соrе x"), ("ооо рука", "о рука"), (None, None),
    ],
}


@pytest.mark.parametrize("rule", list(CASES), ids=lambda r: getattr(r, "__name__", "unescape_html"))
def test_edge_rows(spark, rule):
    rows = [(i, before) for i, (before, _) in enumerate(CASES[rule])]
    out = spark.createDataFrame(rows, "i INT, text STRING").select("i", rule(F.col("text")).alias("out"))
    assert [r["out"] for r in out.orderBy("i").collect()] == [after for _, after in CASES[rule]]


PY_RULES = {
    "html_tags": lambda s: re.sub(r"<[^>]+>", " ", s),
    "html_entities": html.unescape,
    "urls": lambda s: re.sub(r"https?://\S+|www\.\S+", "", s),
    "control": lambda s: re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", s),
    "whitespace": lambda s: re.sub(r"\s+", " ", s).strip(),
    "ips": lambda s: re.sub(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "", s),
    "emails": lambda s: re.sub(r"\b[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}\b", "", s),
}
PIECES = st.lists(
    st.sampled_from([
        "a", "é", "я", "_", "1", "12", "٣", ".", ".", "@", "-", "+", " ", "\n", "\xa0", "\x85", "\x1c", "<", ">", "&amp;",
        "&#65;", "&copy", "http://", "www.", "b.com", "10.0.0.1", "x@y.org", "\x00",
    ]),
    max_size=14,
).map("".join)


def test_rules_equal_python_on_random_texts(spark):
    texts = []

    @settings(max_examples=400, database=None, derandomize=True)
    @given(PIECES)
    def collect(text):
        texts.append(text)

    collect()
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, text STRING")
    columns = [cleaning.RULES[n](F.col("text")).alias(n) for n in PY_RULES]
    for row in df.select("i", *columns).collect():
        for name, rule in PY_RULES.items():
            assert row[name] == rule(texts[row["i"]]), (name, texts[row["i"]])


def test_clean_text_order_and_short_texts(spark):
    rows = [(1, "&lt;b&gt;hello"), (2, "<p>ok</p>"), (3, ""), (4, "abc"), (5, None), (6, "NA\x00\x00"), (7, "null")]
    df = spark.createDataFrame(rows, "row_id INT, text STRING")
    assert {r.row_id: r.text for r in cleaning.clean_text(df).collect()} == {1: "<b>hello", 4: "abc", 7: "null"}
    assert {r.row_id for r in cleaning.clean_text(df, na_literals="drop").collect()} == {1, 4}


def test_cleaning_runs_python_once_and_filters_after_it(spark):
    df = spark.createDataFrame([(1, "a &amp; b")], "row_id INT, text STRING")
    plan = cleaning.clean_text(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_word_tokens_and_pairs(spark):
    df = spark.createDataFrame([("Ты Bad a bad_x été I",), ("x",), ("one",)], "text STRING")
    out = [r[0] for r in df.select(rules.with_bigrams(rules.word_tokens(F.col("text")))).collect()]
    assert out == [["ты", "bad", "bad_x", "été", "ты bad", "bad bad_x", "bad_x été"], [], ["one"]]
