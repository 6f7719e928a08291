"""The stages one after the other, each against what it should have done to its input."""

from __future__ import annotations

import collections

from pyspark.sql import functions as F

import corpus_pipeline as P

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = P.quality(spark, docs, DATA).cache()
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    known = [i for i in quality if i in {r.doc_id for r in docs.collect()}]
    assert sum((i in kept) == (quality[i] == 1) for i in known) / len(known) > 0.95

    one = P.near_duplicates(spark, good, DATA).cache()
    assert one.columns == docs.columns
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in one.collect() if (w := r.text.lower().split())}
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert not near

    cut = P.repeats(spark, one, DATA).cache()
    assert cut.columns == docs.columns
    windows = collections.defaultdict(set)
    for r in cut.collect():
        w = r.text.split()
        for i in range(len(w) - 49):
            windows[tuple(w[i : i + 50])].add(r.doc_id)
    before = {r.doc_id: r.text for r in one.collect()}
    changed = [r for r in cut.collect() if r.text != before[r.doc_id]]
    assert all(len(d) == 1 or any(r.doc_id in d for r in changed) for d in windows.values())

    mixed = P.mixture(spark, cut, DATA).cache()
    assert mixed.columns == docs.columns
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= {r.doc_id for r in cut.collect()} and max(copies.values()) <= 2

    packed = P.packing(spark, mixed, DATA).cache()
    whole = packed.groupBy("doc_id").sum("length").collect()
    tokens = {r.doc_id: r.doc_tokens for r in packed.collect()}
    assert all(r["sum(length)"] == tokens[r.doc_id] * copies[r.doc_id] for r in whole) and len(whole) == len(copies)


def test_mixture_keeps_rows_without_an_id(spark):
    rows = [(None if k % 4 == 0 else k // 2, f"{'word ' * (k % 7)}text {k}", "en", f"s{k % 3}" if k % 5 else None, 9) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = P.mixture(spark, docs, DATA)
    assert mixed.columns == docs.columns
    got = [tuple(r) for r in mixed.collect()]
    assert set(got) <= set(rows) and any(r[0] is None for r in got)
    words = collections.Counter()
    for r in got:
        words[r[3]] += len(r[1].split())
    want = {r.source: r.taken for r in P.mix_sources(docs).groupBy("source").sum("taken").withColumnRenamed("sum(taken)", "taken").collect()}
    assert dict(words) == want


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, tag string, shard long, score double, size string, _copy int"


def odd_documents(spark):
    passage = " ".join(f"p{k}" for k in range(70))
    prose = " ".join(f"w{k * 7 % 61}" for k in range(90))
    rows = [(1, prose, "en", "a", 9), (2, prose + " more", "en", "a", 9), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \n", None, "b", None), (None, prose, "en", None, 9), (None, None, None, None, None)]
    rows += [(10 + k, f"{' '.join(f'x{k}{j}' for j in range(40))} {passage}", "de", "c", 5) for k in range(4)]
    rows += [(20, "same text here", "en", "a", 3), (20, "same text here", "en", "a", 3), (21, "tie", "en", "b", 3), (21, "another", "en", "b", 3), (30, " ".join(f"long{k % 997}" for k in range(60_000)), "en", "c", None)]
    return spark.createDataFrame([(*r, 1, "t", 2, 0.5, "s", 3) for r in rows], SCHEMA), rows


def test_stages_take_any_rows(spark):
    docs, rows = odd_documents(spark)
    as_rows = lambda df: collections.Counter(tuple(r) for r in df.collect())
    every = collections.Counter(rows)
    assert as_rows(P.quality(spark, docs, DATA)) <= every
    one = as_rows(P.near_duplicates(spark, docs, DATA))
    assert one == every - collections.Counter([rows[1], rows[-4]])
    cut = {(r.doc_id, r.text) for r in P.repeats(spark, docs, DATA).collect()}
    assert {r[:2] for r in rows if r[0] not in (2, 11, 12, 13)} <= cut and len(cut) == len({r[:2] for r in rows})
    assert {t for i, t in cut if i in (2, 11, 12, 13)} == {"more", *(" ".join(f"x{k}{j}" for j in range(40)) for k in (1, 2, 3))}
    assert set(as_rows(P.mixture(spark, docs, DATA))) <= set(rows)
    packed = P.packing(spark, docs, DATA).groupBy("doc_id").sum("length").collect()
    tokens = {r.doc_id: r[1] for r in packed}
    assert set(tokens) == {r[0] for r in rows} and tokens[3] == tokens[4] == 1
    assert sum(tokens.values()) == P.packing(spark, docs, DATA).agg({"length": "sum"}).first()[0]


def test_stages_of_an_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in P.STAGES:
        assert stage(spark, none, DATA).count() == 0, name


def test_run(spark):
    assert P.run(spark, DATA).count() > 0


def test_near_duplicates_keep_unlike_texts_of_one_id(spark):
    rows = [(1, "a b c d e f g h"), (1, "totally other words stand in this one"), (2, "x y z"), (3, "totally other words stand in this one"), (0, "A b c d e f g h"), (1, "x y z"), (5, None), (5, ""), (5, None), (2, "x y z")]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for s in ("b", "a") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.orderBy(F.desc("source")).repartition(3)):
        got = sorted((r.doc_id, r.text, r.source) for r in P.near_duplicates(spark, df, DATA).collect() if r.text)
        assert got == [(0, "A b c d e f g h", "a"), (1, "totally other words stand in this one", "a"), (1, "x y z", "a")]
        assert sorted(str(r.text) for r in P.near_duplicates(spark, df, DATA).where("doc_id = 5").collect()) == ["", "None"]
