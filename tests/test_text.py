from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.plans import query as Q


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: T.tokens(F.lit("Über-Café 12 x")), ["uber", "cafe", "12", "x"]),
        (lambda: T.content_terms(F.lit("Where are the für invoices, and INVOICES?")), ["für", "invoices"]),
        (lambda: T.stems(F.lit("queries")), ["query", "querie", "queri"]),
        (lambda: T.stems(F.lit("was")), []),
        (lambda: T.text_title(F.lit("\n  \n  Hello there \nmore")), "Hello there"),
        (lambda: T.text_title(F.lit(None).cast("string")), "Text"),
        (lambda: T.text_title(F.lit("é" * 50)), "é" * 40),
        (lambda: T.skip_words(F.lit("a b\nc d"), 2), "\nc d"),
        (lambda: T.skip_words(F.lit("a b"), 2), ""),
        (lambda: T.skip_words(F.lit("a b"), 0), ""),
        (lambda: T.is_code_name(F.lit("a/b.RS")), True),
        (lambda: T.is_code_name(F.lit(".rs")), False),
        (lambda: T.url_last(F.lit("https://h.org/a/b/?q=1")), "b"),
        (lambda: T.url_last(F.lit("https://h.org/")), "h.org"),
        (lambda: T.age(F.lit(0), F.lit(3700)), "1 h ago"),
        (lambda: T.tag_set(F.lit("#a a, B b c a")), ["a", "b", "c", "a"]),
        (lambda: T.is_bare_url(F.lit(" https://a.b/c ")), True),
        (lambda: T.is_bare_url(F.lit("https://a.b/c d")), False),
        (lambda: T.asks_for_document(F.lit("Which file has it")), True),
        (lambda: T.asks_for_document(F.lit("which one")), False),
        (lambda: T.asks_for_time(F.lit("what came FIRST?")), True),
    ],
)
def test_column(spark, column, want):
    assert value(spark, column()) == want


def test_url_parts(spark):
    got = value(spark, T.url_parts(F.lit("https://me:pw@h.org:8080?x=1")))
    assert got.asDict() == {"scheme": "https", "host": "h.org", "port": 8080, "path": "?x=1"}
    assert value(spark, T.url_parts(F.lit("ftp://h.org/"))) is None


def test_match_text():
    assert Q.match_text("a b") == '"a" OR "b"*'
    assert Q.match_text('  " ') is None
    assert Q.phrases({1: "Corvane-225 x"}) == [(1, 0, 2, 0, "corvane", False), (1, 0, 2, 1, "225", False), (1, 1, 1, 0, "x", True)]


def test_filters():
    now = 1_700_000_000
    f, rest = Q.parse_filters("kind:docs is:code since:7d after:2h from:A from:b kind:banana hello", now)
    assert f.kinds == ["pdf", "file", "docx", "xlsx", "pptx"] and f.code and f.since == now - 7200 and f.source == "b"
    assert rest == "kind:banana hello"
    assert f.describe() == "kind:docs · kind:code · since:7d · since:2h · source:a · source:b"
    assert Q.parse_since("2026-02-31", now) == Q.civil_seconds("2026-03-03")
    assert Q.parse_since("2026-13-01", now) is None
    assert Q.parse_since("today", now) % 86_400 == 0
    assert Q.split_tags("#Work # rest") == (["work"], "# rest")
    assert Q.strip_question(" ?why") == (True, "why")


def test_expand():
    assert Q.expand("the boat invoice".split()) == ["vessel", "voyage", "carrier", "ship", "total", "paid", "amount", "payment"]
    assert Q.expand("boat invoice".split()) == []
    assert Q.expand("the boat total invoice".split(), known={"ship", "total"}) == ["ship"]


def test_clean_rewrites():
    said = 'Here are three search queries:\n1. "git clone url"\n- git clone url\n* where is it\none two three four five six seven eight nine ten eleven\nlast'
    assert Q.clean_rewrites(said, "Where is it") == ["git clone url", "last"]
