"""What queries do at size: rows that follow the input, one pass where one is enough, nothing whole through one process."""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql import functions as F

from granary.operators import grams as R
from granary.operators import index as I

SF = "/root/testdata/sf0.001"


def test_grams_are_packed(spark):
    """The index has a row for a gram and some thousands of chunks, not for each occurrence, and holds each item that has the gram."""
    rows = [(i, o, f"chunk {o} of item {i} says little") for i in range(300) for o in range(3)]
    df = spark.createDataFrame([*rows, (None, 0, "chunk"), (7, 9, None)], "item_id long, ord int, text string").coalesce(2)
    pairs = {(i, t[k : k + 3]) for i, _, t in rows for k in range(len(t) - 2)}
    got = R.of(df).postings.collect()
    assert {(i, r.gram) for r in got for i in r["items"]} == pairs and all(r.n == len(r["items"]) for r in got)
    assert len(got) < len(pairs) // 10
    assert {r.gram: r.n for r in R.of(df.coalesce(1)).counts.collect()}["chu"] == 300


def test_grams_of_a_large_alphabet(spark, monkeypatch):
    text = "".join(map(chr, range(0x4E00, 0x4E40)))
    df = spark.createDataFrame([(k, 0, text) for k in range(3)], "item_id long, ord int, text string").coalesce(1)
    assert {r.gram: sorted(r["items"]) for r in R.of(df).postings.collect()} == {text[k : k + 3]: [0, 1, 2] for k in range(62)}


def test_frequencies_by_one_pass_equal_the_vocabulary(spark):
    items = spark.createDataFrame([(1, "One two", "two three"), (2, "", "ONE öne"), (2, "one", ""), (3, "x", None)], "id long, title string, content string").withColumn("content", F.coalesce("content", F.lit("")))
    terms = spark.createDataFrame([("one",), ("two",), ("nothing",)], "term string")
    want = {(r.term, r.df) for r in I.of(items).vocabulary.collect() if r.term in ("one", "two")}
    assert {(r.term, r.df) for r in I.frequencies(I.holding(items, terms)).collect()} == want


def test_no_list_of_files_reaches_the_driver(spark, tmp_path, monkeypatch):
    """The sink's messages do not grow with the files of a task, and the driver moves and lists none of them."""
    import pickle

    from granary.sources import copies, files, folder

    writer = copies.CopiesWriter(str(tmp_path / "own"))
    staged = [writer.write(iter([Row(name=f"x/{k}.txt", content=b"1") for k in range(n)])) for n in (1, 500)]
    sizes = [len(pickle.dumps(m)) for m in staged]
    assert sizes[0] == sizes[1]
    writer.commit(staged)
    assert len(list((tmp_path / "own" / "x").iterdir())) == 500 and len(list((tmp_path / "own").iterdir())) == 1
    names = [f"in{k % 2}/deep/{k}\nx.txt" if k == 3 else f"in{k % 2}/deep/{k}.txt" for k in range(60)]
    made = spark.createDataFrame([(n, n.encode()) for n in names], "name string, content binary").repartition(3)
    copies.write(made, str(tmp_path / "all"))
    assert not list((tmp_path / "all").glob("_*"))
    (tmp_path / "all" / "_hidden").mkdir()
    (tmp_path / "all" / "_hidden" / "a.txt").write_bytes(b"no")
    (tmp_path / "all" / ".b.txt").write_bytes(b"no")
    monkeypatch.setattr(folder.FolderReader, "listed", lambda *_: 1 / 0)
    want = {n: n.encode() for n in names}
    assert {r.path.removeprefix(f"file:{tmp_path}/all/"): bytes(r.content) for r in files.read_folder(spark, str(tmp_path / "all")).collect()} == want
    assert {r.path for r in files.read_folder(spark, f"file://{tmp_path}/all").select("path").collect()} == {f"file://{tmp_path}/all/{n}" for n in names}
    assert {r.path.removeprefix(f"{tmp_path}/all/") for r in folder.read(spark, str(tmp_path / "all")).collect()} == set(want)


def test_many_small_files_are_few_tasks(spark, tmp_path):
    from granary.sources import files

    for k in range(400):
        (tmp_path / f"{k}.txt").write_bytes(b"some words")
    assert files.read_folder(spark, str(tmp_path)).rdd.getNumPartitions() == 1


def test_word_accuracy_shuffles_texts_not_words(spark):
    from test_pages_at_size import shuffled_rows

    from granary.sources import layout

    truth = spark.createDataFrame([(1, "a b  B c"), (1, "a"), (2, "x " * 300), (3, None), (4, " "), (None, "n m")], "file long, text string")
    read = spark.createDataFrame([(1, "a A b"), (2, "x y " * 200), (5, "z"), (None, "n m")], "file long, text string")
    found = layout.word_accuracy(truth, read)
    assert {(r.file, round(r.accuracy, 6)) for r in found.collect()} == {(1, 0.6), (2, round(200 / 300, 6)), (None, 0.0)}
    assert sum(shuffled_rows(found)) <= 10


def test_unit_words_are_filtered_before_they_are_rows(spark):
    from granary.operators import search as S

    units = spark.createDataFrame([(k, k, ["some", "words", "lic", "license"] * 50, ["title"]) for k in range(20)], "chunk_id long, item_id long, tokens array<string>, title_tokens array<string>")
    asked = spark.createDataFrame([(1, ["words", "lic"])], "query_id long, terms array<string>")
    found = S.unit_bm25(units, asked, every=True, prefix=True)
    assert found.count() == 20
    assert "explode(tokens" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_unit_scores_do_not_follow_the_places_of_words(spark):
    from granary.operators import search as S

    units = spark.createDataFrame([(1, 1, ["x", "y", "a", "z"], ["b"]), (2, 2, ["a", "y", "x", "z"], ["b"]), (3, 3, ["q"], ["b"])], "chunk_id long, item_id long, tokens array<string>, title_tokens array<string>")
    got = {r.chunk_id: r.score for r in S.unit_bm25(units, spark.createDataFrame([(1, ["a"])], "query_id long, terms array<string>")).collect()}
    assert set(got) == {1, 2} and got[1] == got[2]


def test_pages_reach_python_in_small_batches(spark):
    from granary.plans.catalog import QUERIES

    for name in ("page_items", "readable_pages"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_prompts_of_turns_are_shuffled_once(spark):
    from test_pages_at_size import shuffled_rows

    from granary.plans import prompts as P

    rows = [(q, "user" if q % 2 else "model", f" text {q} when") for q in range(0, 200) if q % 5]
    rows += [(63, "user", "again"), (1, None, None), (None, "user", "no number"), (None, "model", "x")]
    c = spark.createDataFrame(rows, "query_id long, role string, text string")
    asked = c.where("role = 'user'").select("query_id", "text")
    before = asked.select("query_id", F.explode(F.array(*[F.col("query_id") - k for k in (1, 2, 3)])).alias("place"))
    told = before.join(c.select(F.col("query_id").alias("place"), F.col("role").alias("title"), "text"), "place")
    kinds = [("chatml", None), ("llama3", True)]
    want = sorted((r.query_id or -1, f, r.temporal, r.prompt) for f, t in kinds for r in P.prompts(asked, told, f, t).collect())
    found = P.chats(P.after_turns(c), kinds)
    assert sorted((r.query_id or -1, r.family, r.temporal, r.prompt) for r in found.collect()) == want
    assert len(shuffled_rows(found)) == 1


def test_context_needs_no_index_and_cuts_chunks_once(spark, monkeypatch):
    from granary.operators import chunks as C
    from granary.plans.catalog import QUERIES

    cuts = []
    cut = C.chunks
    monkeypatch.setattr(C, "chunks", lambda *a, **k: cuts.append(1) or cut(*a, **k))
    monkeypatch.setattr(I, "postings", lambda *_: 1 / 0)
    found = QUERIES["context_blocks"](spark, SF)
    assert found.count() > 0 and len(cuts) == 1
    assert "regexp_extract_all" not in found.select("text")._jdf.queryExecution().optimizedPlan().toString()
