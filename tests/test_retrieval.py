"""Trigram search and blocked products against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import context as X
from granary.operators import grams as R
from granary.operators import nearest as K
from granary.operators import search as S

CHUNK = "item_id long, ord int, text string"


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(8)
    parts = ["inVoice", "über", "Straße ", "𝄞𝄞x", "a", " ", "\n", "lic", "license", "ense", "日本語", "77"]
    rows = [(i // 3, i % 3, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))) for i in range(400)]
    return spark.createDataFrame([*rows, (900, 0, None), (901, 0, ""), (902, 0, "ab")], CHUNK), rows


@pytest.mark.parametrize("written", [True, False])
def test_literal_search_equals_contains(spark, chunks, tmp_path, written):
    df, rows = chunks
    if written:
        R.write(df, str(tmp_path / "grams"))
    index = R.read(spark, str(tmp_path / "grams")) if written else R.of(df)
    terms = ["license", "invoice", "licinvoice", "über", "𝄞𝄞x", "日本語日", "7", "ab", "77", "nowhere", "a\n", "Upper", "", "sss"]
    asked = spark.createDataFrame([(t,) for t in [*terms, "license"]], "term string")
    found = R.containing(index, df, asked)
    got = [(r.term, r.item_id, r.ord) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(t, i, o) for i, o, text in [*rows, (902, 0, "ab")] for t in terms if t and t in text.lower()}
    assert sorted((r.term, r.item_id, r.ord) for r in R.scanned(df, asked).collect()) == sorted(got)
    long = R.containing(index, df, asked.where(F.length("term") >= 3))
    assert "NestedLoop" not in long._jdf.queryExecution().executedPlan().toString()
    if written:
        assert "PartitionFilters: [bucket" in long._jdf.queryExecution().toString()


def test_literal_search_of_nothing(spark, chunks):
    df, _ = chunks
    assert R.containing(R.of(df), df, spark.createDataFrame([], "term string")).count() == 0
    assert R.containing(R.of(df), df, spark.createDataFrame([("qqqq",)], "term string")).count() == 0
    assert R.containing(R.of(df.limit(0)), df.limit(0), spark.createDataFrame([("license",), ("a",)], "term string")).count() == 0


def vectors(rng, n, dim):
    x = rng.integers(-3, 4, (n, dim)).astype(float)  # small integers: many ties
    x[x.any(axis=1) == 0] = 1
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("limit", [1, 7, 10_000])
def test_nearest_equals_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(K, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(2)
    x, q = vectors(rng, 300, 4), vectors(rng, 5, 4)
    rows = [(1000 - i, i % 37, i % 5 - 1, [float(c) for c in v]) for i, v in enumerate(x)] + [(5000, 1, 0, [1.0, 0.0]), (5001, 2, 0, None), (5002, 99, 0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "chunk_id long, item_id long, ord int, vec array<double>").repartition(7)
    asked = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(q)] + [(8, [1.0, 0.0]), (9, None), (10, [1.0] * 9)], "query_id int, vec array<double>")
    pairs = [(k, c, i, o, round(float(np.dot(v, w)), 9)) for k, v in [*enumerate(q), (8, [1.0, 0.0])] for c, i, o, w in rows if w is not None and len(w) == len(v)]
    assert sorted(tuple(r) for r in K.all_pairs(df, asked).collect()) == sorted(pairs)

    def ranked(found, key):
        out = []
        for k in {p[0] for p in found}:
            mine = sorted((p for p in found if p[0] == k), key=lambda p: (-p[4], p[key]))[:limit]
            out += [(*p, n) for n, p in enumerate(mine)]
        return sorted(out)

    assert sorted(tuple(r) for r in K.nearest(df, asked, limit).collect()) == ranked(pairs, 1)
    best = {}
    for p in sorted(pairs, key=lambda p: (-p[4], p[1])):
        best.setdefault((p[0], p[2]), p)
    assert sorted((r.query_id, r.chunk_id, r.item_id, r.ord, r.cos, r["rank"]) for r in K.nearest_items(df, asked, limit).collect()) == ranked(best.values(), 2)
    floor = [p for p in best.values() if p[4] >= 0.45]
    top = {k: max(p[4] for p in floor if p[0] == k) for k in {p[0] for p in floor}}
    near = [p for p in ranked(floor, 2) if p[4] >= top[p[0]] - 0.12]
    assert sorted((r.query_id, r.chunk_id, r.item_id, r.ord, r.cos, r["rank"]) for r in S.semantic_nearest(df, asked, limit).collect()) == near
    plan = K.nearest(df, asked, limit)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id long, item_id long, ord int, vec array<double>")
    q = spark.createDataFrame([(1, [1.0])], "query_id long, vec array<double>")
    assert K.nearest(none, q, 5).count() == K.nearest_items(none, q, 5).count() == K.all_pairs(none, q).count() == 0
    assert K.nearest(spark.createDataFrame([(1, 1, 0, [1.0])], none.schema), q.limit(0), 5).count() == 0


def test_candidates_are_the_pool_and_all_literal_ones(spark, chunks):
    df, rows = chunks
    rng = np.random.default_rng(6)
    x, q = vectors(rng, len(rows), 6), vectors(rng, 2, 6)
    vecs = spark.createDataFrame([(7000 - n, i, o, [float(c) for c in x[n]]) for n, (i, o, _) in enumerate(rows)], "chunk_id long, item_id long, ord int, vec array<double>")
    queries = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(q)], "query_id long, vec array<double>")
    terms = spark.createDataFrame([(0, "licinvoice", 0.08, 2, True), (1, "nowhere", 0.08, 0, True)], "query_id long, term string, weight double, df long, own boolean")
    pins = spark.createDataFrame([], "query_id long, term string, item_id long")
    got = {(r.query_id, r.chunk_id): round(r.score, 9) for r in X.candidates(vecs, queries, df, terms, pins, pool=5).collect()}
    want = {}
    for k in range(2):
        cos = [round(float(np.dot(q[k], v)), 9) for v in x]
        pool = sorted(range(len(rows)), key=lambda n: (-cos[n], 7000 - n))[:5]
        literal = [n for n, r in enumerate(rows) if k == 0 and "licinvoice" in r[2].lower()]
        want |= {(k, 7000 - n): round(cos[n] + 0.08 * (n in literal), 9) for n in {*pool, *literal}}
    assert got == want
