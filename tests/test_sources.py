from __future__ import annotations

import io
import zipfile
from collections import namedtuple

import pandas as pd
import pytest

from granary.sources import files, html, layout, markup, office

Glyph = namedtuple("Glyph", "x y end size text")
Rule = namedtuple("Rule", "x0 y0 x1 y1")
Box = namedtuple("Box", "x0 y0 x1 y1 text")


def packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_decode():
    assert markup.decode("a &amp; b &#65;&#x42; &nope; &toolongforanentity; &") == "a & b AB &nope; &toolongforanentity; &"
    assert markup.attribute(' a="1" b=\'x>y\' c=3 d="4"', "b") == "x>y"
    assert markup.attribute(' c=3 d="4"', "d") is None


def test_events():
    got = list(markup.events('<a t="x>y">1<b/><!-- <c> --><![CDATA[<d>]]></a><e'))
    assert got == [("open", "a", ' t="x>y"'), ("text", "1", ""), ("empty", "b", ""), ("text", "<d>", ""), ("close", "a", "")]


def test_readable_page():
    prose = "word " * 60
    page = f"<html><head><title>A &amp; B</title></head><body><nav>menu</nav><article><h2>Head</h2><p>{prose}</p><ul><li>one<li>two</ul><table><tr><td>a</td><td>b</td></tr></table><script>x<y</script></article><footer>foot</footer></body></html>"
    title, text = html.read_page(page)
    assert title == "A & B"
    assert text.split("\n")[:2] == ["## Head", prose.strip()]
    assert "- one\n- two\n" in text and "a | b" in text and "menu" not in text and "foot" not in text and "x<y" not in text


def test_unclosed_script_ends_page():
    assert html.read_page("<p>before</p><script>var a = '<p>after</p>'")[1] == "before\n"
    assert html.read_page(None) == (None, "")


def test_docx():
    xml = "<w:document><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>you</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:document>"
    assert office.extract("docx", packed({"word/document.xml": xml})) == "Hello\tyou\na | b"
    with pytest.raises(ValueError, match="not a readable"):
        office.extract("docx", b"nothing")


def test_xlsx():
    parts = {
        "xl/workbook.xml": '<workbook><sheet name="S1" r:id="r1"/></workbook>',
        "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>',
        "xl/sharedStrings.xml": "<sst><si><t>na</t><t>me</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<s><row><c t="s"><v>0</v></c><c/><c><v>1.5</v></c><c/></row></s>',
    }
    assert office.extract("xlsx", packed(parts)) == "## S1\nname |  | 1.5"


def test_pptx():
    slide = "<s><a:p><a:t>Title</a:t></a:p></s>"
    parts = {"ppt/slides/slide10.xml": slide.replace("Title", "Ten"), "ppt/slides/slide2.xml": slide, "ppt/notesSlides/notesSlide2.xml": "<s><a:p><a:t>say</a:t></a:p><a:p><a:t>2</a:t></a:p></s>"}
    assert office.extract("pptx", packed(parts)) == "Slide 1\nTitle\nNotes: say\n\nSlide 2\nTen"


def page(glyphs, rules=()):
    return layout.page_text(pd.DataFrame(glyphs, columns=Glyph._fields), pd.DataFrame(rules, columns=Rule._fields))


def test_page_layout():
    word = lambda x, y, text, size=10: [Glyph(x + 5 * i, y, x + 5 * i + 5, size, c) for i, c in enumerate(text)]
    glyphs = word(0, 10, "left") + word(100, 10, "right") + word(0, 22, "next") + word(0, 80, "far")
    assert page(glyphs + word(0, 10, "l")) == "left | right\nnext\n\nfar"
    assert page([]) == ""


def test_form_cells():
    flat = [Rule(0, y, 300, y) for y in (0, 40, 80)] * 2
    tall = [Rule(x, 0, x, 80) for x in (0, 100, 200)] * 2
    word = lambda x, y, text: [Glyph(x + 5 * i, y, x + 5 * i + 5, 8, c) for i, c in enumerate(text)]
    glyphs = [g for x in (10, 110) for y in (10, 50) for g in word(x, y, "NAME") + word(x, y + 20, "bob")]
    assert page(glyphs, flat + tall) == "NAME: bob | NAME: bob\nNAME: bob | NAME: bob"


def test_pages_and_images_as_tables(spark):
    word = lambda d, p, x, y, text: [(d, p, float(x + 5 * i), float(y), float(x + 5 * i + 5), 10.0, c) for i, c in enumerate(text)]
    glyphs = word("a", 2, 0, 10, "second") + word("a", 1, 0, 10, "ab") + word("a", 1, 12, 10, "cd") + word("a", 1, 0, 40, "--") + word("b", 1, 0, 10, "12")
    g = spark.createDataFrame(glyphs, "doc string, page int, x double, y double, end double, size double, text string")
    rules = spark.createDataFrame([("c", 1, 0.0, 0.0, 1.0, 1.0)], "doc string, page int, x0 double, y0 double, x1 double, y1 double")
    found = layout.lay_out_pages(g, rules)
    assert {(r.doc, r.text) for r in layout.join_pages(found).collect()} == {("a", "ab cd\n\nsecond"), ("b", "12")}


def test_image_layout(spark):
    boxes = [Box(0, 0, 40, 10, "a"), Box(100, 1, 140, 11, "b"), Box(0, 14, 30, 24, "c"), Box(0, 60, 30, 70, "d")]
    rows = [(i, *(float(v) for v in b[:4]), b.text) for i in (1, 2) for b in boxes] + [(3, 0.0, 0.0, 9.0, 9.0, " alone ")]
    found = layout.lay_out_images(spark.createDataFrame(rows, "img int, x0 double, y0 double, x1 double, y1 double, text string"))
    assert {r.img: r.text for r in found.collect()} == {1: "a | b\nc\n\nd", 2: "a | b\nc\n\nd", 3: "alone"}
    assert layout.ctc_collapse([0, 1, 1, 0, 1, 2, 2]) == [1, 1, 2]


def test_files():
    assert files.read_file("a.py", b"x = 1") == ("a.py", "file", "x = 1", None)
    assert files.read_file("a.gif", b"GIF")[:3] == ("a.gif", "image", "a.gif")
    assert files.read_file("blob", b"\0\1")[2] == "blob (2 bytes)"
    assert files.read_file("s.url", b"[InternetShortcut]\nURL=https://a.b/c\n")[2] == "https://a.b/c"
    assert files.read_file("p.pdf", b"%PDF")[3] == "p.pdf: no text in this PDF"
    assert files.read_file("p.html", b"<title>T</title>hi")[:2] == ("T", "web")
    assert files.decode_body(b"caf\xe9", "text/html; charset=windows-1252") == "café"


def test_read_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.docx").write_bytes(b"broken")
    got = {r.title: r for r in files.extract(files.read_folder(spark, str(tmp_path))).collect()}
    assert got["a.txt"].content == "hello" and got["a.txt"].error is None
    assert got["b.docx"].error.startswith("b.docx: not a readable")


def test_fetched_pages(spark):
    def fetch(url):
        if "bad" in url:
            raise ValueError("no answer")
        if "pic" in url:
            return url, "image/png", b"\x89PNG"
        return url.replace("http:", "https:"), "text/html; charset=utf-8" if "page" in url else "application/json", b"<title>T</title><p>hi</p>" if "page" in url else b"{}"

    texts = [(1, " http://a.b/page "), (2, "http://bad.c/x"), (3, "see http://a.b/page"), (4, "http://a.b/data"), (5, "http://a.b/pic")]
    got = {r.id: tuple(r)[1:] for r in files.text_items(spark.createDataFrame(texts, "id long, text string"), fetch).collect()}
    assert got[1] == ("T", "web", "https://a.b/page", "https://a.b/page\n\nhi\n")
    assert got[2] == ("http://bad.c/x", "text", None, "http://bad.c/x")
    assert got[3][1] == "text" and got[4] == ("https://a.b/data", "web", "https://a.b/data", "https://a.b/data\n\n{}") and got[5][1] == "text"


def test_text_extensions_and_page_bytes():
    for name in ("a.bib", "a.cmd", "a.m", "a.markdown", "a.srt", "a.vtt"):
        assert files.read_file(name, b"said")[2] == "said"
    assert files.read_file("a.env", b"said")[2] == "a.env (4 bytes)"
    assert files.capped("éé", 3) == "é"


def test_copies_and_names(spark):
    made = spark.createDataFrame([("d/a.PDF", bytearray(b"x")), ("d/b.txt", bytearray(b"y" * 40))], "path string, content binary")
    kept = files.kept_copies(made, "always").collect()
    assert all(r.stored.startswith("files/") and len(r.stored.split("/")[1].split(".")[0]) == 24 for r in kept) and kept[0].stored.endswith(".pdf")
    assert files.kept_copies(made, "never").count() == 0 and files.kept_copies(made, "small").count() == 2
    names = spark.createDataFrame([(1, "shot", "png"), (2, "shot", "png"), (3, "new", "png")], "id long, stem string, extension string")
    taken = spark.createDataFrame([("shot.png",), ("shot (4).png",)], "name string")
    assert {r.id: r.name for r in files.free_names(names, taken).collect()} == {1: "shot (5).png", 2: "shot (6).png", 3: "new.png"}
