"""Settings of evaluation runs that read files: synonyms, descriptions, contexts, stored chunks and kept vectors."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import context as X
from granary.plans import evaluate as E
from granary.plans import models as M

ITEMS = [(1, "one", "a b c d"), (2, "two", "e f"), (3, "three", None)]
STORED = [(1, 4, "late"), (1, 2, "early"), (2, 0, "only"), (2, -1, "title"), (9, 0, "of no item")]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "id long, title string, content string")


def rows(df):
    return sorted((r.item_id, r.ord, r.text, r.embed_text) for r in df.collect())


def test_stored_chunks_with_contexts_and_descriptions(spark, items, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"1:0": "of A", "2:0": "", "7:7": "x"}))
    (tmp_path / "d.json").write_text(json.dumps({"1": "about one", "3": "about three"}))
    cfg = E.Config.of(rechunk=False, chunk_contexts=str(tmp_path / "c.json"), doc_units=True, doc_unit_text="description", doc_descriptions=str(tmp_path / "d.json"), unit_text="chunk")
    stored = spark.createDataFrame(STORED, "item_id long, ord int, text string")
    assert rows(E.units_of(cfg, items, stored)) == [
        (1, -1, "about one", "one\nabout one"), (1, 0, "early", "of A\nearly"), (1, 1, "late", "late"),
        (2, -1, "", "two\n"), (2, 0, "only", "only"), (3, -1, "about three", "three\nabout three"),
    ]
    with pytest.raises(ValueError, match="stored chunks"):
        E.units_of(cfg, items)
    plain = E.Config.of(chunk_words=3, chunk_overlap=1, doc_units=True)
    assert rows(E.units_of(plain, items)) == [(1, -1, "", "one"), (1, 0, "a b c", "one\na b c"), (1, 1, "c d", "one\nc d"), (2, -1, "", "two"), (2, 0, "e f", "two\ne f"), (3, -1, "", "three")]


def test_synonyms_of_a_file(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"Car": ["Motor Vehicle", "auto"], "red": []}))
    asked = spark.createDataFrame([(1, "the car is auto"), (2, "red")], "query_id long, text string")
    got = X.expansions(asked, terms=1, table=E.synonyms(spark, str(tmp_path / "s.json"))).collect()
    assert [(r.query_id, r.synonym, r.place) for r in got] == [(1, "motor vehicle", 1)]


def test_vectors_are_kept(spark, tmp_path):
    made = []

    def make(cfg, prefix):
        return M.Pooled(cfg.embed_model, 2, lambda t: [len(w) for w in t.split()] or [0], lambda ids, mask: np.stack([ids, ids * 0 + 1], axis=-1).astype(float), cfg.pooling, prefix, cfg.max_len, cfg.batch_size)

    cfg = E.Config.of(embed_model="m", cache_dir=str(tmp_path / "kept"), passage_prefix="pp ", query_prefix="q ", query_instruction="find: ")
    passages, questions = E.embedders(cfg, make)
    assert (passages().prefix, questions().prefix) == ("pp ", "q find: ")
    texts = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    for _ in range(2):
        got = {r.id: r.vec for r in E.embedded(cfg, texts, passages).collect()}
        assert got[1] == got[2] and len(got) == 3
        made.append(spark.read.parquet(str(tmp_path / "kept" / "passages")).count())
    assert made == [2, 2]
    assert E.embedded(E.Config.of(embed_model="m", query_cache=False, cache_dir=str(tmp_path / "none")), texts, questions, "questions").count() == 3
    assert not (tmp_path / "none").exists()


def test_batches_and_lengths_of_models():
    seen = []

    def model(ids, mask):
        seen.append(ids.shape)
        return np.ones((*ids.shape, 3)) * ids[:, :, None]

    m = M.Pooled("m", 3, lambda t: [1] * int(t), model, most=400, batch=2)
    assert np.allclose(m.embed(["5", "6", "7", "600", "300"]), 1 / np.sqrt(3))
    assert sorted(seen) == [(1, 32), (2, 32), (2, 512)]
