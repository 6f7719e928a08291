"""Vaults of planted facts: their names, lengths and questions, and how search answers them; item and question files; the absent report."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from granary.plans import scale as A
from granary.plans.api import Vault


def test_vaults_do_not_depend_on_their_size(spark):
    few, more = A.vault(spark, 20, "s").collect(), A.vault(spark, 30, "s").where("id < 20").collect()
    assert sorted(few) == sorted(more) and sorted(few) != sorted(A.vault(spark, 20, "t").collect())
    for r in few:
        words = len(r.content.split()) - len(" ".join(r.content.split("\n\n")[k] for k in range(r.content.count("\n\n") + 1) if r.facts.name in r.content.split("\n\n")[k]).split())
        _, least, most = A.BANDS[0 if r.id % 10 < 4 else 1 if r.id % 10 < 8 else 2]
        assert least <= words <= most
        assert r.title.startswith(r.facts.name) and all(v in r.content for v in (r.facts.code, r.facts.leader, r.facts.office, r.facts.budget, r.facts.day))
    assert spark.range(200_000).select(F.regexp_extract(A.name(F.col("id")), "^([A-Z][a-z]+)-", 1).alias("n")).where("n <> ''").distinct().count() == 200_000


def test_search_finds_the_planted_facts(spark):
    made = A.vault(spark, 40).checkpoint()
    vault = Vault(spark, made.drop("facts"))
    asked = A.one_each(A.questions(made))
    rows = asked.collect()
    assert len(rows) == 40 and {r["shape"] for r in rows} == {0, 1, 2, 3}
    ranked = vault.keyword({r.query_id: r.text for r in rows}, 3)
    assert A.rates(ranked, asked, made).first().asDict() == {"questions": 40, "hit1": 40, "hit3": 40, "answered": 40}
    assert A.rates(ranked.limit(0), asked, made).first().asDict() == {"questions": 40, "hit1": 0, "hit3": 0, "answered": 0}


def test_question_and_item_files(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps([{"title": "b", "text": "two 22", "tags": ["x"]}, {"title": "a", "kind": "note", "text": "one"}, {"title": "b", "text": None}]))
    (tmp_path / "q.json").write_text(json.dumps([{"q": "x?", "expect_title": "b"}, {"q": "y?", "expect_pattern": "[0-9]+"}, {"q": "z?", "expect_ids": [7], "expect_title": "a"}, {"q": "none?"}, {"q": " "}, {"q": None}]))
    items, asked = A.read_items(spark, str(tmp_path / "i.json")), A.read_questions(spark, str(tmp_path / "q.json"))
    assert [(r.id, r.title, r.kind, r.content, r.tags) for r in items.orderBy("id").collect()] == [(0, "a", "note", "one", []), (1, "b", "text", "", []), (2, "b", "text", "two 22", ["x"])]
    assert {r.text: r["items"] for r in asked.join(A.expected_items(asked, items), "query_id").collect()} == {"x?": [1, 2], "y?": [2], "z?": [0, 7], "none?": []}


def test_absent_report(spark):
    made = A.vault(spark, 12)
    vault = Vault(spark, made.drop("facts"))
    texts = {1: "what is the access code", 2: "  qwertzuiop zzyzx blorptastic  "}
    got = A.absent_report(spark.createDataFrame(list(texts.items()), "query_id long, text string"), vault.absent(texts)).checkpoint()
    assert {(r.query_id, r.words, r.absent) for r in got.collect()} == {(1, 5, False), (2, 3, True)}
    assert A.refused(got).first() == (2, 1)
