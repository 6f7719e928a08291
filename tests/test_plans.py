from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import chunks as C
from granary.operators import nearest as K
from granary.operators import search as S
from granary.plans import evaluate as E
from granary.plans import models as M
from granary.plans.api import MISSING, Vault

ITEM = "id long, title string, kind string, source string, content string, hash string, added_at long, tags array<string>"
LETTERS = [
    (1, "Boat trip", "The vessel Morning Star leaves the harbour of Lenmoor at nine."),
    (2, "Rent invoice", "Invoice 48213: total paid 940 crowns for the flat in Hill Street."),
    (3, "Recipe", "Plum cake: flour, butter, plums, one hour in the oven."),
]


@pytest.fixture(scope="module")
def vault(spark):
    rows = [(i, t, "text", None, c, f"h{i}", 100 + i, ["a"] if i == 2 else []) for i, t, c in LETTERS]
    return Vault(spark, spark.createDataFrame(rows, ITEM), lambda: M.HashingEmbedder(64))


def test_search_and_calls(vault):
    assert vault.search("plum cake").first().item_id == 3
    assert [r.item_id for r in vault.search("#a").collect()] == [2]
    assert [r.item_id for r in vault.search("since:1970-01-01", now=200).collect()] == [3, 2, 1]
    assert [r["id"] for r in vault.retrieve("invoice total", tags="a")] == [2]
    assert vault.get("1")["title"] == "Boat trip" and vault.get(9) is None
    assert [r["id"] for r in vault.list_recent(2)] == [3, 2]
    assert vault.forget(3).items.count() == 2
    more, done = vault.put("# Garden\nsow peas", now=500, tags="#Spring work")
    assert done == "added" and more.get(4)["title"] == "Garden" and more.get(4)["tags"] == ["spring", "work"]
    assert more.put("# Garden\nsow peas", now=600)[1] == "duplicate"
    assert len(vault.resources()) == 3


def test_self_check(vault):
    assert vault.self_check([("when does the vessel leave the harbour", ["nine"]), ("what is the number of the rent invoice", ["48213"])]) == [True, True]
    assert vault.ask("quantum blorptastic zzyzx") == (MISSING, [])
    assert vault.live("quantum blorptastic zzyzx").count() == 0


def test_evaluation(spark):
    items, questions = E.synthetic_vault(spark, 60)
    make = lambda: M.HashingEmbedder(64)
    cut = C.chunks(items).withColumn("chunk_id", F.xxhash64("item_id", "ord"))
    dense = K.all_pairs(M.embed_chunks(items, cut.drop("chunk_id"), make).drop("text").withColumn("chunk_id", F.xxhash64("item_id", "ord")), questions.select("query_id", M.embed(F.col("text"), make).alias("vec")))
    units = cut.join(items.select(F.col("id").alias("item_id"), "title"), "item_id").select("chunk_id", "item_id", T.ascii_tokens(F.col("text")).alias("tokens"), T.ascii_tokens(F.col("title")).alias("title_tokens"))
    for fusion in ("score", "rrf_units", "rrf_docs"):
        got = E.report(E.run(E.Config.of(fusion=fusion, absent_metric="bm25_zero"), questions, units, dense), questions).first()
        assert got.questions == got.answerable == 6 and got.hit3 >= 5 and got.false_absent == 0
    with pytest.raises(ValueError, match="unknown settings: nothing"):
        E.Config.of(nothing=1)


def test_models():
    assert M.basic_words("Über-Maß 東京x") == ["uber", "-", "maß", "東", "京", "x"]
    pieces = M.WordPieces(["[UNK]", "[CLS]", "[SEP]", "un", "##able", "able"])
    assert pieces.encode("unable able xyz") == [1, 3, 4, 5, 0, 2]
    assert [M.head_size(c) for c in (2, 8)] == [10, 10] and M.head_size(2, budget_ms=200) == 7


def test_pooled_embedder_and_cache(spark):
    import numpy as np

    from granary.plans import models as M

    table = np.random.default_rng(0).normal(size=(50, 4))
    seen = []

    def model(ids, mask):
        seen.append(ids.shape)
        return table[ids]

    encode = lambda t: [1 + len(w) for w in t.split()] or [0]
    texts = ["a bb", "ccc " * 40, ""]
    mean = M.Pooled("m", 4, encode, model, "mean").embed(texts)
    want = np.stack([table[encode(t)].mean(axis=0) for t in texts])
    assert np.allclose(mean, want / np.linalg.norm(want, axis=1, keepdims=True))
    assert {s[1] for s in seen} == {32, 64}
    make = lambda: M.HashingEmbedder(8)
    none = spark.createDataFrame([], "key string, vec array<float>")
    asked = spark.createDataFrame([(1, "x y"), (2, "z"), (3, "z")], "id long, text string")
    made, fresh = M.embed_cached(asked, none, make)
    assert made.count() == 3 and fresh.count() == 2
    kept = spark.createDataFrame(fresh.collect(), fresh.schema)
    assert M.embed_cached(asked, kept, make)[1].count() == 0
    back = made.select(F.col("vec"), M.from_blob(M.to_blob(F.col("vec"))).alias("same")).collect()
    assert all(r.vec == r.same for r in back)


def test_vault_adds_and_answers(spark, tmp_path):
    from granary.plans import api as A

    vault, asked = A.sanity_vault(spark)
    passed = vault.self_check(asked)
    assert A.summary(passed, "built-in questions", 1.0) == f"Self-check: {sum(passed)}/3 — built-in questions (retrieval only, 1.0s)" and sum(passed) >= 2
    (tmp_path / "n.txt").write_text("a note of Orla")
    more, done = vault.add(5, path=str(tmp_path / "n.txt"), tags="#Mine")
    assert done == {"action": "added", "title": "n.txt", "kind": "file", "words": 4}
    assert more.add(6, path=str(tmp_path / "n.txt"))[1]["action"] == "duplicate"
    (tmp_path / "b.docx").write_bytes(b"broken")
    assert vault.add(5, path=str(tmp_path / "b.docx"))[1]["title"] == "b.docx"
    page, done = vault.add(5, url="http://a.b", fetch=lambda u: (u, "text/html", b"<title>T</title>page"))
    assert done["kind"] == "web" and page.read_resource(f"item:{3}").startswith("http://a.b")
    assert vault.ask_about(2, "how hot?")[1] == "Quillon oven card" and vault.ask_about(99, "x")[0] == A.MISSING
    (tmp_path / "q.json").write_text('[{"q": "a?", "expect": ["b"]}, {"q": " ", "expect": ["b"]}, {"q": "c"}]')
    assert A.load_questions(spark, str(tmp_path / "q.json")) == [("a?", ["b"])]
    assert vault.templates()[0]["uriTemplate"] == "item:{id}"


def test_evaluation_knobs(spark):
    from granary.operators import search as S
    from granary.plans import evaluate as E
    from granary.plans import models as M

    items, asked = E.synthetic_vault(spark, 40)
    cfg = E.Config.of(doc_units=True, doc_unit_text="title_opening", rerank=True, rerank_fusion="docs", query_expansion="keyword", kw_stopwords=True, chunk_mode="para_heading")
    units = E.units_of(cfg, items).withColumn("tokens", E.T.ascii_tokens(F.col("text"))).withColumn("title_tokens", E.T.ascii_tokens(F.col("title"))).cache()
    assert units.where("ord = -1").count() == 40
    make = lambda: M.HashingEmbedder(32)
    vectors = units.select("chunk_id", "item_id", "ord", M.embed(F.concat_ws(" ", "title", "text"), make).alias("vec"))
    dense = K.all_pairs(vectors, asked.select("query_id", M.embed(F.col("text"), make).alias("vec")))
    found = E.run(cfg, asked.select("query_id", "text"), units, dense, M.lexical_reranker)
    rates = E.report(found, asked.select("query_id", "items")).first()
    assert rates.questions == 4 and rates.hit1 == 4
    kw = S.unit_bm25(units, asked.select("query_id", E.T.ascii_tokens(F.col("text")).alias("terms")))
    assert E.feedback(cfg, kw, units).count() == 4
