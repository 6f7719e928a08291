"""Grounded context: distinctive terms, candidates, scores, pins, and the word budget.

All stages but the last are joins and windows over a small table of queries. The last, a
greedy fill that skips what does not fit and goes on, is sequential; it runs on the few
ordered candidates of each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import NOT_ALNUM, SYNONYMS, content_terms, words
from granary.operators import grams, nearest
from granary.operators.chunks import OVERLAP
from granary.sources.vault import checkpoint

OWN, AUX, MAX_SHARE = 0.08, 0.04, 0.34
POOL, EXTRA, BONUS, DECAY = 40, 3, 0.5, (1.0, 0.5, 0.25)
BUDGET, STOP, DECOY, UNIT_WORDS = 1400, 0.9, 15, 60


def asked_terms(queries: DataFrame) -> DataFrame:
    """The terms (term) of queries (text, aux) that ``distinctive_terms`` judges."""
    return queries.select(F.explode(F.array_union(content_terms(F.col("text")), content_terms(F.col("aux")))).alias("term")).distinct()


def distinctive_terms(queries: DataFrame, df: DataFrame, n_items: int) -> DataFrame:
    """Rows (query_id, term, weight, df, own) of the terms of queries (query_id, text, aux) that few items hold.

    A query's own terms count even where no item holds them; those of its rewrites (aux)
    count half, and only where some item does.
    """
    n = F.lit(float(max(n_items, 1)))
    own = queries.select("query_id", F.explode(content_terms(F.col("text"))).alias("term"))
    aux = queries.select("query_id", F.explode(content_terms(F.col("aux"))).alias("term")).join(own, ["query_id", "term"], "left_anti")
    asked = own.withColumn("own", F.lit(True)).unionByName(aux.withColumn("own", F.lit(False)))
    known = df.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    found = asked.join(known, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    share = F.col("df") / n
    found = found.where((share <= MAX_SHARE) & (F.col("own") | (F.col("df") > 0)))
    return found.select("query_id", "term", (F.when(F.col("own"), OWN).otherwise(AUX) * (1 - share)).alias("weight"), "df", "own")


def literal_candidates(chunks: DataFrame, terms: DataFrame, index: grams.Grams | None = None) -> DataFrame:
    """Rows (query_id, item_id, ord, boost): chunks that contain distinctive terms, with their weights.

    ``index`` has the trigrams of the chunks; without one all texts are read. Terms are made
    once, since they may come from a pass over all texts.
    """
    terms = checkpoint(terms.select("query_id", "term", "weight"))
    met = grams.containing(index, chunks, terms) if index else grams.scanned(chunks, terms)
    return met.join(F.broadcast(terms), "term").groupBy("query_id", "item_id", "ord").agg(F.sum("weight").alias("boost"))


def digit_terms(queries: DataFrame) -> DataFrame:
    """Rows (query_id, term): the tokens of queries that hold a digit."""
    parts = F.filter(F.split("text", NOT_ALNUM), lambda t: (F.octet_length(t) >= 2) & t.rlike("[0-9]"))
    return queries.select("query_id", F.explode(F.array_distinct(F.transform(parts, lambda t: F.lower(t)))).alias("term"))


def digit_pins(queries: DataFrame, occ: DataFrame, most: int = 2) -> DataFrame:
    """Rows (query_id, term, item_id): items that a token with a digit names, if one or two hold it."""
    asked = digit_terms(queries)
    met = occ.select("term", "item_id").join(F.broadcast(asked), "term").distinct()
    few = met.groupBy("query_id", "term").count().where(F.col("count") <= most).drop("count")
    return met.join(F.broadcast(few), ["query_id", "term"]).select("query_id", "term", "item_id")


def apply_pins(candidates: DataFrame, pins: DataFrame) -> DataFrame:
    """Candidates of items that hold all pins of their query; if there are none, any pin; if none, all candidates."""
    need = pins.groupBy("query_id").agg(F.countDistinct("term").alias("need"))
    have = pins.groupBy("query_id", "item_id").agg(F.countDistinct("term").alias("have"))
    c = candidates.join(F.broadcast(need), "query_id", "left").join(F.broadcast(have), ["query_id", "item_id"], "left")
    grade = F.when(F.col("have") == F.col("need"), 2).when(F.col("have") > 0, 1).otherwise(0)
    c = c.withColumn("grade", grade)
    best = F.max("grade").over(Window.partitionBy("query_id"))
    return c.withColumn("best", best).where(F.col("grade") == F.col("best")).drop("need", "have", "grade", "best")


def item_scores(scored: DataFrame) -> DataFrame:
    """Scores of items from their three best chunks, the second at half and the third at a quarter."""
    by = Window.partitionBy("query_id", "item_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    weights = F.array(*[F.lit(w) for w in DECAY])
    best = scored.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= len(DECAY))
    return best.groupBy("query_id", "item_id").agg(F.sum(F.col("score") * F.element_at(weights, F.col("rn"))).alias("score"))


def candidates(vectors: DataFrame, queries: DataFrame, chunks: DataFrame, terms: DataFrame, pins: DataFrame, pool: int = POOL, index: grams.Grams | None = None) -> DataFrame:
    """Rows (query_id, chunk_id, item_id, ord, text, score, literal): the nearest chunks and those with distinctive terms.

    ``vectors`` has (chunk_id, item_id, ord, vec) of all chunks, ``queries`` (query_id, vec).
    The pool comes from blocked products; chunks with literal terms beside it are few, and
    only they are compared row by row.
    """
    keys = ["query_id", "chunk_id", "item_id", "ord"]
    literal = checkpoint(literal_candidates(chunks, terms, index))
    near = checkpoint(nearest.nearest(vectors, queries, pool).select(*keys, "cos"))
    asked = queries.select("query_id", F.col("vec").cast("array<double>").alias("q"))
    cos = F.aggregate(F.zip_with("vec", "q", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda t, x: t + x)
    others = literal.join(vectors.select("chunk_id", "item_id", "ord", "vec"), ["item_id", "ord"]).join(F.broadcast(asked), "query_id").where(F.size("vec") == F.size("q"))
    others = others.select(*keys, F.round(cos, nearest.DIGITS).alias("cos")).join(near, keys, "left_anti")
    c = near.unionByName(others).join(literal, ["query_id", "item_id", "ord"], "left")
    c = c.join(chunks.select("item_id", "ord", "text"), ["item_id", "ord"])
    rare = terms.where("own and df between 1 and 2").groupBy("query_id").agg(F.collect_set("term").alias("rare"))
    c = c.join(F.broadcast(rare), "query_id", "left")
    literal = F.coalesce(F.arrays_overlap(F.split(F.lower("text"), NOT_ALNUM), F.col("rare")), F.lit(False))
    c = c.select("query_id", "chunk_id", "item_id", "ord", "text", (F.col("cos") + F.coalesce("boost", F.lit(0.0))).alias("score"), literal.alias("literal"))
    return apply_pins(c, pins)


def top_items(scored: DataFrame) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("item_id"))
    return item_scores(scored).withColumn("rn", F.row_number().over(by)).where("rn = 1").select("query_id", F.col("item_id").alias("top_item"))


def rerank_head(scored: DataFrame, k: int, extra: int = EXTRA) -> DataFrame:
    """The k candidates a reranker sees: the best, with up to ``extra`` literal ones from below in place of the last."""
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    c = scored.withColumn("place", F.row_number().over(by))
    late = Window.partitionBy("query_id").orderBy(F.when(F.col("literal") & (F.col("place") > k), F.col("place")).asc_nulls_last())
    c = c.withColumn("late", F.when(F.col("literal") & (F.col("place") > k), F.row_number().over(late)))
    c = c.withColumn("taken", F.when(F.col("late") <= extra, F.col("late")))
    # each literal one pops the last of the head, which may be one that came before it
    n = F.count("taken").over(Window.partitionBy("query_id"))
    c = c.withColumn("n", n)
    kept = ((F.col("place") <= k) & (F.col("place") <= k - F.least(F.col("n"), F.lit(1)))) | ((F.col("taken").isNotNull()) & (F.col("taken") == F.col("n")))
    return c.where(kept).drop("place", "late", "taken", "n")


def rerank_texts(head: DataFrame, items: DataFrame) -> DataFrame:
    """A reranker's passages: title units show the title and the first UNIT_WORDS words of their item."""
    few = F.broadcast(head.where("ord < 0").select(F.col("item_id").alias("id")).distinct())
    shown = F.concat("title", F.lit(": "), F.array_join(F.slice(words(F.col("content")), 1, UNIT_WORDS), " "))
    titles = items.join(few, "id").select(F.col("id").alias("item_id"), shown.alias("shown"))
    return head.join(titles, "item_id", "left").withColumn("text", F.when(F.col("ord") < 0, F.coalesce("shown", "text")).otherwise(F.col("text"))).drop("shown")


def rerank_top(head: DataFrame, score: Callable[[Column, Column], Column], queries: DataFrame) -> DataFrame:
    """Rows (query_id, top_item): the item of the best reranked passage; literal passages get a bonus."""
    seen = head.join(F.broadcast(queries.select("query_id", F.col("text").alias("question"))), "query_id")
    logit = score(F.col("question"), F.col("text")) + F.when(F.col("literal"), BONUS).otherwise(0.0)
    best = seen.groupBy("query_id", "item_id").agg(F.max(logit).alias("logit"))
    by = Window.partitionBy("query_id").orderBy(F.col("logit").desc(), F.col("item_id"))
    return best.withColumn("rn", F.row_number().over(by)).where("rn = 1").select("query_id", F.col("item_id").alias("top_item"))


def fill(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Chunks chosen for one query: its ordered candidates with their neighbours, up to the budget in words.

    Rows have (query_id, item_id, ord, place, text, n, whole, top_item, kind): candidates
    with their place, and all chunks that may be wanted beside them with no place.
    """
    texts = {(r.item_id, r.ord): (r.text, r.n) for r in pdf.itertuples()}
    asked = pdf[pdf.place > 0].sort_values("place")
    if asked.empty:
        return pdf.iloc[:0][["query_id", "item_id", "ord", "text"]]
    top, whole = asked.iloc[0].top_item, int(asked.iloc[0].whole)
    chosen: dict[tuple[int, int], str] = {}
    used = 0

    def add(item: int, at: int) -> bool:
        nonlocal used
        if at < 0 or (item, at) not in texts:
            return False
        if (item, at) in chosen:
            return True
        text, n = texts[item, at]
        if used + n > budget:
            return False
        used += n
        chosen[item, at] = text
        return True

    if whole >= 0:
        chosen |= {k: t for k, (t, _) in texts.items() if k[0] == top and k[1] >= 0}
        used = whole
    add(top, 0)
    for r in asked.itertuples():
        if whole >= 0 and r.item_id != top and r.n < DECOY:
            continue
        if not add(r.item_id, r.ord):
            continue
        add(r.item_id, r.ord - 1)
        add(r.item_id, r.ord + 1)
        if used >= int(budget * STOP):
            break
    rows = [(int(asked.iloc[0].query_id), item, at, text) for (item, at), text in chosen.items()]
    return pd.DataFrame(rows, columns=["query_id", "item_id", "ord", "text"])


def blocks(scored: DataFrame, chunks: DataFrame, items: DataFrame, top: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Rows (query_id, place, item_id, title, text): the context of each query, its top item first."""
    from granary.operators.chunks import document_words, skip_words

    c = scored.join(F.broadcast(top), "query_id")
    by = Window.partitionBy("query_id").orderBy((F.col("item_id") == F.col("top_item")).desc(), F.col("score").desc(), F.col("chunk_id"))
    asked = c.withColumn("place", F.row_number().over(by)).select("query_id", "item_id", "ord", "place", "top_item")
    near = asked.select("query_id", "item_id", F.explode(F.array(F.col("ord") - 1, F.col("ord"), F.col("ord") + 1)).alias("ord"))
    size = document_words(chunks).select(F.col("item_id").alias("top_item"), F.when(F.col("words") <= budget, F.col("words")).otherwise(-1).alias("whole"))
    tops = top.join(size, "top_item", "left").withColumn("whole", F.coalesce("whole", F.lit(-1)))
    opening = tops.select("query_id", F.col("top_item").alias("item_id"), F.lit(0).alias("ord"))
    own = chunks.where("ord >= 0").select("item_id", "ord").join(F.broadcast(tops.where("whole >= 0").select("query_id", F.col("top_item").alias("item_id"))), "item_id").select("query_id", "item_id", "ord")
    wanted = near.unionByName(opening).unionByName(own).distinct().join(asked.drop("top_item"), ["query_id", "item_id", "ord"], "left").join(tops, "query_id")
    full = wanted.join(chunks, ["item_id", "ord"]).select("query_id", F.col("item_id").cast("long").alias("item_id"), F.col("ord").cast("int").alias("ord"), F.coalesce("place", F.lit(0)).cast("int").alias("place"), "text", F.size(words(F.col("text"))).alias("n"), F.col("whole").cast("long").alias("whole"), F.col("top_item").cast("long").alias("top_item"))
    chosen = full.groupBy("query_id").applyInPandas(lambda pdf: fill(pdf, budget), "query_id long, item_id long, ord int, text string")
    run_by = Window.partitionBy("query_id", "item_id").orderBy("ord")
    runs = chosen.withColumn("run", F.col("ord") - F.row_number().over(run_by))
    in_run = Window.partitionBy("query_id", "item_id", "run").orderBy("ord")
    part = F.when(F.row_number().over(in_run) == 1, F.col("text")).otherwise(skip_words(F.col("text"), OVERLAP))
    made = runs.withColumn("part", part).groupBy("query_id", "item_id", "run").agg(F.min("ord").alias("first"), F.sort_array(F.collect_list(F.struct("ord", "part"))).alias("parts"))
    made = made.join(F.broadcast(top), "query_id").join(items.select(F.col("id").alias("item_id"), "title"), "item_id")
    order = Window.partitionBy("query_id").orderBy((F.col("item_id") != F.col("top_item")), F.col("item_id"), F.col("first"))
    return made.select("query_id", F.row_number().over(order).alias("place"), "item_id", "title", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"))


def catalog(items: DataFrame, most: int) -> DataFrame:
    """One line for each of the newest items, with its first words unless they repeat the title."""
    new = items.orderBy(F.desc("added_at"), F.desc("id")).limit(most)
    opening = F.array_join(F.slice(words(F.col("content")), 1, 14), " ")
    same = (opening == "") | opening.startswith(F.rtrim(F.col("title"), F.lit("…"))) | F.col("title").startswith(opening)
    return new.select("id", F.concat(F.lit("- "), "title", F.lit(" ["), "kind", F.lit("]"), F.when(same, "").otherwise(F.concat(F.lit(": "), opening, F.lit("…")))).alias("line"))


def expansions(queries: DataFrame, occ: DataFrame | None = None, table: dict[str, str] | DataFrame | None = None, terms: int = 3, most: int = 12) -> DataFrame:
    """Rows (query_id, synonym, place) for queries of ``terms`` words or more; only words that occur, where ``occ`` is given. ``table`` has synonyms by word, or rows (word, j, synonym)."""
    spark = queries.sparkSession
    synonyms = table
    if not isinstance(table, DataFrame):
        rows = [(w, j, s) for w, t in (table or SYNONYMS).items() for j, s in enumerate(t.split())]
        synonyms = F.broadcast(spark.createDataFrame(rows, "word string, j int, synonym string"))
    parts = F.filter(F.split(F.lower("text"), NOT_ALNUM), lambda w: w != "")
    asked = queries.select("query_id", parts.alias("words")).where(F.size("words") >= terms)
    found = asked.select("query_id", "words", F.posexplode("words").alias("i", "word")).join(synonyms, "word").where(~F.array_contains("words", F.col("synonym")))
    found = found.groupBy("query_id", "synonym").agg(F.min(F.col("i") * 1000 + F.col("j")).alias("at"))
    if occ is not None:
        found = found.join(occ.select(F.col("term").alias("synonym")).distinct(), "synonym", "left_semi")
    by = Window.partitionBy("query_id").orderBy("at")
    return found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most).select("query_id", "synonym", F.col("place").cast("long").alias("place"))


def hit_rates(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Shares of questions with a gold item first, and among the first three."""
    met = ranked.join(gold.withColumn("good", F.lit(True)), "item_id", "left").groupBy("query_id").agg(F.min(F.when(F.col("good"), F.col("rank"))).alias("at"))
    rate = lambda k: F.round(F.avg(F.when(F.col("at") < k, 1.0).otherwise(0.0)), 6)
    return met.agg(F.count("*").alias("questions"), rate(1).alias("hit1"), rate(3).alias("hit3"))


def nearest_rank(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles of each key that are values of it: the one at the rounded place, without interpolation."""
    by = Window.partitionBy(key)
    r = rows.where(F.col(value).isNotNull()).withColumn("r", F.row_number().over(by.orderBy(value))).withColumn("n", F.count("*").over(by))
    at = lambda p: F.floor((F.col("n") - 1) * p + 0.5) + 1
    return r.groupBy(key).agg(*[F.max(F.when(F.col("r") == at(p), F.col(value))).alias(name) for name, p in shares.items()])
