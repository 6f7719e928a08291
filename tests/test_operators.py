from __future__ import annotations

import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.operators import chunks as C
from granary.operators import context as X
from granary.operators import index as I
from granary.operators import ingest as G
from granary.operators import nearest as K
from granary.operators import search as S
from granary.operators import snippets as N

ITEM = "id long, title string, kind string, source string, content string, hash string, added_at long, tags array<string>"


def items(spark, *rows):
    return spark.createDataFrame([(i, t, "text", None, c, f"h{i}", i, []) for i, t, c in rows], ITEM)


def test_bm25_by_hand(spark):
    v = items(spark, (1, "invoice", "total due"), (2, "note", "invoice invoice paid"), (3, "other", "nothing here at all"))
    parts = S.phrase_table(spark, {1: "invoice x"})
    got = {r.item_id: r.score for r in S.keyword(I.of(v), parts, 10, digits=12).collect()}
    idf = max(math.log((3 - 2 + 0.5) / 2.5), 1e-6)
    mean = (3 + 4 + 5) / 3
    want = lambda tf, n: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    assert got == pytest.approx({1: want(3, 3), 2: want(2, 4)})


def test_phrases_must_adjoin(spark):
    v = items(spark, (1, "x", "corvane 225 here"), (2, "x", "225 corvane"), (3, "x", "corvane a 225"))
    parts = S.phrase_table(spark, {1: "Corvane-22"})
    assert {r.item_id for r in S.keyword(I.of(v), parts, 10).collect()} == {1}


def axis(i, dim=8):
    return [1.0 if k == i else 0.0 for k in range(dim)]


def near(i, c, dim=8):
    v = [0.0] * dim
    v[i], v[-1] = c, math.sqrt(1 - c * c)
    return v


def test_semantic_floor_and_window(spark):
    rows = [(1, 1, 0, near(0, 0.95)), (2, 2, 0, near(0, 0.5)), (3, 3, 0, near(0, 0.3)), (4, 4, 0, near(0, 0.9))]
    vectors = spark.createDataFrame(rows, "chunk_id long, item_id long, ord int, vec array<double>")
    q = spark.createDataFrame([(1, axis(0))], "query_id long, vec array<double>")
    assert [r.item_id for r in S.semantic(K.all_pairs(vectors, q), 10).orderBy("rank").collect()] == [1, 4]


def test_absent_gate(spark):
    v = items(spark, (1, "Invoice", "total 5"), (2, "Resume", "engineer"))
    asked = spark.createDataFrame([(1, "invoices totals"), (2, "zebra crossing"), (3, "zebra"), (4, "zebra crossing")], "query_id long, text string")
    best = spark.createDataFrame([(4, 0.8)], "query_id long, cos double")
    got = {r.query_id: r.absent for r in S.absent(asked, I.of(v).vocabulary, best).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}


def sizes(text):
    return [len(c.split()) for c in C.chunk_text(text)]


def test_chunk_sizes():
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    assert sizes(words(100)) == [100]
    assert sizes(words(250)) == [100, 100, 90]
    assert sizes(words(105)) == [100, 25]
    assert sizes(f"{words(100)}\n\n{words(90)}") == [100, 20, 100, 30]
    assert len(sizes("\n\n".join([words(60)] * 700))) == 700
    assert sizes("") == []


@given(st.lists(st.sampled_from(["a", "bb", "\n", "c  d"]), max_size=400))
def test_chunks_cover_all_words(parts):
    text = " ".join(parts)
    cut = C.chunk_text(text)
    words = [w for k, c in enumerate(cut) for w in c.split()[C.OVERLAP if k else 0 :]]
    assert words == text.split()


def test_chunks_by_headings():
    body = " ".join(f"w{i}" for i in range(60))
    assert C.chunk_by_headings(f"# One\n{body}\nTWO PARTS\n{body}") == [f"# One {body}", f"TWO PARTS {body}"]
    assert C.is_heading("Work Experience 2019") and not C.is_heading("He went home.") and not C.is_heading("")


def test_closed_form_is_the_rule(spark):
    texts = ["", " a\n\tb  c ", " ".join(f"w{i}" for i in range(333)), "x\n" * 181]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    got = {(r.item_id, r.ord): r.text for r in C.chunks(rows).collect()}
    assert got == {(i, k): c for i, t in enumerate(texts) for k, c in enumerate(C.chunk_text(t))}


def test_merge_runs(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = spark.createDataFrame([(1, text)], "id long, content string")
    assert C.merge_runs(C.chunks(rows)).first().text == text


def test_upsert_actions(spark):
    batch = spark.createDataFrame([(1, "a", "x", None), (2, "a", "x", None), (3, "b", "new", None), (4, "c", "same", None), (5, "d", None, "bad"), (6, "e", "1", None), (7, "e", "2", None)], "id long, hash string, content string, error string")
    vault = spark.createDataFrame([(9, "b", "old"), (8, "c", "same")], "id long, hash string, content string")
    got = {r.id: r.action for r in G.actions(batch, vault).collect()}
    assert got == {1: "added", 2: "duplicate", 3: "updated", 4: "duplicate", 5: "failed", 6: "added", 7: "updated"}


def test_failures(spark):
    bad = spark.createDataFrame([(1, "p", 5), (2, "p", 9), (3, "", 1), (4, "", 2), (5, "q", 3)], "id long, path string, at long")
    ok = spark.createDataFrame([("p", 7), ("q", 4)], "path string, at long")
    assert {r.id for r in G.latest_failures(bad).collect()} == {2, 3, 4, 5}
    assert {r.id for r in G.still_failed(bad, ok).collect()} == {2, 3, 4}


def test_pins(spark):
    c = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "query_id long, item_id long")
    pin = lambda *rows: spark.createDataFrame(list(rows), "query_id long, term string, item_id long")
    kept = lambda p: sorted(r.item_id for r in X.apply_pins(c, p).collect())
    assert kept(pin((1, "22", 1), (1, "33", 1), (1, "33", 2))) == [1]
    assert kept(pin((1, "22", 1), (1, "33", 2))) == [1, 2]
    assert kept(pin((1, "22", 9))) == [1, 2, 3]


def test_greedy_fill_skips_and_goes_on():
    import pandas as pd

    rows = [(1, 1, 0, 1, "a", 50, -1, 1), (1, 2, 0, 2, "b", 60, -1, 1), (1, 3, 0, 3, "c", 30, -1, 1), (1, 1, 1, 0, "d", 10, -1, 1)]
    pdf = pd.DataFrame(rows, columns=["query_id", "item_id", "ord", "place", "text", "n", "whole", "top_item"])
    assert sorted(X.fill(pdf, 100).text) == ["a", "c", "d"]


def test_context_blocks(spark):
    v = items(spark, (1, "Letter", " ".join(f"w{i}" for i in range(150))), (2, "Other", "w5 elsewhere " * 20))
    cut = C.chunks(v)
    scored = cut.withColumn("query_id", F.lit(1).cast("long")).withColumn("chunk_id", F.col("item_id") * 10 + F.col("ord")).withColumn("score", 1.0 / F.col("chunk_id"))
    top = spark.createDataFrame([(1, 1)], "query_id long, top_item long")
    got = X.blocks(scored, cut, v, top).orderBy("place").collect()
    assert [(r.title, len(r.text.split())) for r in got] == [("Letter", 150), ("Other", 40)]


def test_snippets():
    lines = N.block("intro\n\n```\ncode hit\n\n```\nend", ["hit"], False)
    assert [r["runs"] for r in lines] == [[{"text": "code ", "ink": "text"}, {"text": "hit", "ink": "lit"}]]
    assert N.plain("## a_b *c* _d_") == ("a_b c d", True, False)
    assert N.plain("- x") == ("x", False, True)
    assert N.marked("aXaxa", ["axa", "xa"], "dim") == [{"text": "aXaxa", "ink": "lit"}]


def test_stream_equals_batch(spark, tmp_path):
    from granary.streaming.ingest import current, start

    rows = items(spark, (1, "a", "x"), (2, "b", "y")).unionByName(items(spark, (3, "c", "x")).withColumn("hash", F.lit("h1")))
    rows.write.parquet(str(tmp_path / "inbox"))
    q = start(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "inbox")), str(tmp_path / "vault"))
    q.awaitTermination()
    got = current(spark, str(tmp_path / "vault"))
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in G.first_of_batch(rows).collect()) == [1, 2]


def test_index_reads_what_a_query_asks(spark, tmp_path):
    v = items(spark, (1, "invoice", "total due"), (2, "note", "invoices paid"), (3, "other", "nothing here"), (4, "", ""))
    I.write(v, str(tmp_path / "index"))
    index = I.read(spark, str(tmp_path / "index"))
    parts = S.phrase_table(spark, {1: "paid invo"})
    hits = S.phrase_hits(index.postings, S.typed_forms(parts, index.vocabulary))
    assert {(r.pos, r.item_id) for r in hits.collect()} == {(0, 2), (1, 1), (1, 2)}
    plan = hits._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan
    columns = hits.columns
    made = I.of(v)
    assert sorted(tuple(r) for r in hits.collect()) == sorted(tuple(r) for r in S.phrase_hits(made.postings, S.typed_forms(parts, made.vocabulary)).select(columns).collect())
    assert {r.item_id: r.length for r in index.postings.collect()} == {1: 3, 2: 3, 3: 3}
    assert tuple(index.totals.first()) == tuple(made.totals.first()) == (4, 9 / 4)


def test_short_terms_count_once_under_long_prefixes(spark):
    """A term that is shorter than another typed prefix is no match of its own beginning twice."""
    v = items(spark, (1, "a", "pub public publican"), (2, "b", "license lic"), (3, "c", "lice licensed publ pub"))
    texts = {1: "lic", 2: "x publ", 3: "y license", 4: "pub"}
    forms = S.typed_forms(S.phrase_table(spark, texts), I.of(v).vocabulary).collect()
    assert len(forms) == len(set(forms))
    assert {q: sorted(r.term for r in forms if r.query_id == q) for q in texts} == {1: ["lic", "lice", "license", "licensed"], 2: ["publ", "public", "publican"], 3: ["license", "licensed"], 4: ["pub", "publ", "public", "publican"]}


@pytest.fixture(scope="module")
def many(spark):
    """Items of many lengths with words of all frequencies; some words stand in titles, many items tie."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(1500):
        body = [words[min(int(rng.expovariate(0.12)), 59)] for _ in range(rng.choice([2, 5, 20, 20, 90, 400]))]
        rows.append((i, " ".join(rng.choices(words[:6], k=rng.choice([0, 0, 1]))), " ".join(body)))
    return items(spark, *rows, *[(2000 + i, "", "w1 w2 w3") for i in range(200)])


@pytest.mark.parametrize("limit", [1, 8, 5000])
def test_pruned_search_equals_scoring_all(spark, many, monkeypatch, limit):
    monkeypatch.setattr(I, "FREQUENT", 100)
    monkeypatch.setattr(I, "BLOCK_ITEMS", 8)
    index = I.of(many)
    texts = {1: "w1 ", 2: "w1 w2 w3 ", 3: "w0 w59 ", 4: "w1-w2 w0 ", 5: "w4 w1", 6: "w1 w1 w5 ", 7: "absent w2 ", 8: "absent ", 9: "w3 w2 w1 w0 w7 w9 "}
    parts = S.phrase_table(spark, texts)
    whole = S.bm25(S.phrase_hits(index.postings, S.typed_forms(parts, index.vocabulary)), index.totals)
    want = S.top(whole.withColumn("score", F.round("score", 9)), limit)
    rows = lambda df: sorted((r.query_id, r["rank"], r.item_id, round(r.score, 6)) for r in df.collect())
    assert rows(S.keyword(index, parts, limit)) == rows(want)
    reading = {r.query_id: r for r in S.pruned(index, S.typed_forms(parts, index.vocabulary), limit).reading().collect()}
    assert all(r.needed <= r.held for r in reading.values())
    if limit == 1:
        assert sum(r.needed for r in reading.values()) < 0.3 * sum(r.held for r in reading.values())
    if limit == 5000:
        assert all(r.needed == r.held for r in reading.values())


def test_match_snippets(spark):
    words = [f"w{i}" for i in range(40)]
    words[20], words[25], words[38] = "Corvane-225", "ünïts", "corvane"
    v = items(spark, (1, "a", " ".join(words)), (2, "corvane", "short text."), (3, "a", "x corvane, 225 units!"))
    parts = S.phrase_table(spark, {1: "corvane-22 units"})
    index = I.of(v)
    whole = S.whole_phrases(S.matched_terms(index.postings, S.typed_forms(S.phrase_table(spark, {1: "corvane uni"}), index.vocabulary)))
    got = {r.item_id: r.snippet for r in S.match_snippets(spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "query_id long, item_id long"), v, whole).collect()}
    assert got[1] == " … \x01Corvane\x02-225 w21 w22 w23 w24 \x01ünïts\x02 w26 w27 w28 w29 w30 w31 w32 … "
    assert got[2] == "short text"
    assert got[3] == " … \x01corvane\x02, 225 \x01units\x02"
    assert parts.count() == 3


def test_note_edits(spark):
    from granary.operators import edits as D

    v = items(spark, (1, "one", "a"), (2, "two", "b"))
    named = D.name_notes(v, spark.createDataFrame([(1, " Mine ")], "id long, title string"))
    done = D.update_notes(named, spark.createDataFrame([(1, "auto", "a2", 9), (2, "auto", "b2", 9)], "id long, title string, content string, at long"))
    assert {(r.id, r.title, r.content, r.added_at) for r in done.collect()} == {(1, "Mine", "a2", 9), (2, "auto", "b2", 9)}
    again = D.update_notes(D.name_notes(done, spark.createDataFrame([(1, " ")], "id long, title string")), spark.createDataFrame([(1, "auto", "a3", 10)], "id long, title string, content string, at long"))
    assert again.where("id = 1").first().title == "auto"
    made = D.new_notes(v, spark.createDataFrame([(7, 5), (8, 5)], "id long, at long"))
    assert made.count() == 4 and made.select("hash").distinct().count() == 4
    bad = spark.createDataFrame([("3,4",), ("x",), (None,)], "c string").select(D.cursor_of(F.col("c")).alias("at")).collect()
    assert [r["at"] and tuple(r["at"]) for r in bad] == [(3, 4), None, None]


def test_unit_bm25_by_hand(spark):
    from granary.functions import text as T

    rows = [(1, "gnu", "public licence"), (2, "x", "gnu public licences and more"), (3, "y", "gnu only")]
    units = items(spark, *rows).select(F.col("id").alias("chunk_id"), F.col("id").alias("item_id"), T.ascii_tokens(F.col("content")).alias("tokens"), T.ascii_tokens(F.col("title")).alias("title_tokens"))
    asks = spark.createDataFrame([(1, ["the", "gnu", "licen"])], "query_id long, terms array<string>")
    got = {r.item_id: r.score for r in S.unit_bm25(units, asks, every=True, prefix=True, stopwords=["the"], extra=spark.createDataFrame([(1, "more")], "query_id long, term string")).collect()}
    size = {1: 3 + 2, 2: 3 + 5, 3: 3 + 2}
    mean = sum(size.values()) / 3
    part = lambda f, df, n: math.log(1 + (3 - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / mean))
    assert got == pytest.approx({1: part(3, 3, 5) + part(1, 0, 5), 2: part(1, 3, 8) + part(1, 0, 8) + part(0.5, 1, 8)})
