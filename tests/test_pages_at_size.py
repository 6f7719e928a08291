"""Pages at size: no glyph is a row of a shuffle, and reading takes its glyphs in one pass each."""

from __future__ import annotations

from granary.plans.catalog import QUERIES
from granary.sources import layout, pdf

GLYPHS = "doc long, page int, x double, y double, end double, size double, text string"
RULES = "doc long, page int, x0 double, y0 double, x1 double, y1 double"


def shuffled_rows(df) -> list[int]:
    """Rows that each shuffle of a plan wrote."""
    found = []

    def walk(p):
        name = p.nodeName()
        if name == "Exchange":
            found.append(p.metrics().apply("shuffleRecordsWritten").value())
        inner = [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if name.endswith("QueryStage") else [p.children().apply(i) for i in range(p.children().size())]
        for q in inner:
            walk(q)

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_placed_pages_shuffle_no_glyphs(spark):
    d = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{d}/documents.parquet").count()
    pages = QUERIES["placed_pages"](spark, d)
    written = shuffled_rows(pages)
    assert written and max(written) <= max(documents, pages.agg({"pages": "sum"}).first()[0])


def test_glyph_rows_are_packed_before_they_are_shuffled(spark):
    word = lambda d, p, text: [(d, p, 6.0 * j, 10.0, 6.0 * j + 5.4, 10.0, c) for j, c in enumerate(text)]
    rows = [g for d in (1, 2, None) for p in range(10) for g in word(d, p, f"page{p}")]
    g = spark.createDataFrame(rows, GLYPHS).coalesce(2)
    found = layout.lay_out_pages(g, spark.createDataFrame([], RULES))
    assert max(shuffled_rows(found)) < len(rows) // 2
    assert {(r.doc, r.page, r.text) for r in found.collect()} == {(d, p, f"page{p}") for d in (1, 2, None) for p in range(10)}


def test_a_page_in_many_parts_is_laid_out_whole(spark):
    rows = [(1, 0, 6.0 * j, 10.0 + 15 * k, 6.0 * j + 5.4, 10.0, c) for k in range(4) for j, c in enumerate("abcd")]
    g = spark.createDataFrame(rows, GLYPHS).repartition(8)
    assert [r.text for r in layout.lay_out_pages(g, spark.createDataFrame([], RULES)).collect()] == ["abcd\nabcd\nabcd\nabcd"]


def test_glyphs_are_handed_on_only_if_asked_for(spark):
    from granary.plans.catalog import _pdf

    files = spark.createDataFrame([(1, bytearray(_pdf(1, ["one line", "and more"])))], "id long, content binary")
    pages = pdf.drawn(files, "id", placed=False)
    assert "glyphs" not in pages.columns and [r.text for r in pages.collect()] == ["one line\nand more"]
    assert pdf.glyphs(pdf.drawn(files, "id")).count() == len("onelineandmore")
