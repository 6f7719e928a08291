"""Batched keyword, vector and hybrid search. Every result carries a query_id.

Queries come from the driver as small tables, so the side that is broadcast is bounded by
what was typed, never by the data.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.text import HIT_CLOSE, HIT_OPEN, LEFT_OUT, SNIPPET_TOKENS, TOKEN, ascii_tokens, content_terms, is_code_name, stems
from granary.operators import index as I
from granary.operators import nearest as K
from granary.plans.query import Filters, phrases
from granary.sources.vault import checkpoint

K1, B, TITLE_WEIGHT = 1.2, 0.75, 3.0
MIN_COSINE, COSINE_WINDOW, SEMANTIC_FLOOR, KEYWORD_WEIGHT = 0.45, 0.12, 0.40, 0.60
ABSENT_TERMS, ABSENT_COSINE = 2, 0.70
NO_TOKEN = TOKEN.replace("[", "[^")[:-1] + "*"
PHRASE = "query_id long, pos int, n int, j int, term string, is_prefix boolean"


def phrase_table(spark: SparkSession, queries: dict[int, str]) -> DataFrame:
    return spark.createDataFrame(phrases(queries), PHRASE)


#: As many forms of what was typed go to all tasks; more are joined like any table.
FORMS, PUSHED = 100_000, 2_000
#: As many ranges of terms become a filter of the index's scan.
RANGES = 100


def typed_forms(parts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows (query_id, pos, n, j, term, df): the index's terms that each typed term meets, exactly or as a prefix.

    One pass over the vocabulary (term, df): each term is looked up by itself and by its
    beginnings of the lengths that the typed prefixes have, if it is as long.
    """
    keys = [F.struct(F.lit(False).alias("is_prefix"), F.col("term").alias("typed"))]
    for row in parts.where("is_prefix").select(F.length("term").alias("size")).distinct().collect():
        keys.append(F.when(F.length("term") >= row.size, F.struct(F.lit(True).alias("is_prefix"), F.substring("term", 1, row.size).alias("typed"))))
    keyed = vocabulary.select("term", "df", F.explode(F.array_compact(F.array(*keys))).alias("key")).select("term", "df", "key.is_prefix", "key.typed")
    return keyed.join(F.broadcast(parts.withColumnRenamed("term", "typed")), ["is_prefix", "typed"]).select("query_id", "pos", "n", "j", "term", "df")


def narrowed(posted: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of some terms: few of them become filters of the scan, by bucket and by term."""
    if len(terms) > PUSHED:
        return posted
    buckets = [r.b for r in posted.sparkSession.createDataFrame([(t,) for t in terms], "term string").select(I.bucket(F.col("term")).alias("b")).distinct().collect()] if terms else []
    return posted.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def ranged(posted: DataFrame, forms: DataFrame) -> DataFrame:
    """Postings of terms from the first to the last form of each typed term: the forms of a prefix follow each other, so no others are among them."""
    ends = forms.groupBy("query_id", "pos", "j").agg(F.min("term").alias("low"), F.max("term").alias("high")).select("low", "high").distinct()
    spans: list[tuple[str, str]] = []
    for low, high in sorted(map(tuple, ends.collect())):  # no more than were typed
        if spans and low <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(high, spans[-1][1])
        else:
            spans.append((low, high))
    if not spans or len(spans) > RANGES:
        return posted
    return posted.where(reduce(or_, [F.col("term").between(low, high) for low, high in spans]))


def matched_terms(posted: DataFrame, forms: DataFrame) -> DataFrame:
    """Postings of the terms that a query's words meet. Few terms become a filter of the index's scan, more a filter by ranges before they are joined."""
    few = forms.limit(FORMS + 1).toArrow()
    if few.num_rows <= FORMS:
        posted = narrowed(posted, few.column("term").unique().to_pylist())
        forms = F.broadcast(posted.sparkSession.createDataFrame(few))
    else:
        posted = ranged(posted, forms)
    return posted.join(forms.drop("df"), "term")


def whole_phrases(met: DataFrame) -> DataFrame:
    """Rows (query_id, pos, n, item_id, field, start): places where all terms of a query word adjoin. A word of one term is met as it stands."""
    keys = ["query_id", "pos", "n", "item_id", "field", "start"]
    placed = I.places(met).select("query_id", "pos", "n", "item_id", "field", (F.col("place") - F.col("j")).alias("start"), "j")
    several = placed.where("n > 1").groupBy(*keys).agg(F.countDistinct("j").alias("have")).where("have = n").drop("have")
    return placed.where("n = 1").drop("j").unionByName(several)


def frequency(title_weight: float) -> Column:
    return (F.col("n_title") * F.lit(float(title_weight)) + F.col("n_content")).cast("double")


def phrase_hits(posted: DataFrame, forms: DataFrame, title_weight: float = TITLE_WEIGHT) -> DataFrame:
    """Rows (query_id, pos, item_id, length, block, tf): weighted occurrences of each query word; of several terms only where they adjoin.

    ``forms`` are those of typed_forms. Words of one term need no places.
    """
    met = matched_terms(posted, forms)
    item = ["query_id", "pos", "item_id"]
    counted = met.where("n = 1").groupBy(*item).agg(F.max("length").alias("length"), F.max("block").alias("block"), F.sum(frequency(title_weight)).alias("tf"))
    if forms.where("n > 1").isEmpty():
        return counted
    weight = F.when(F.col("field") == "t", F.lit(title_weight)).otherwise(F.lit(1.0))
    several = met.where("n > 1")
    whole = whole_phrases(several).groupBy(*item).agg(F.sum(weight).alias("tf"))
    sizes = several.groupBy(*item).agg(F.max("length").alias("length"), F.max("block").alias("block"))
    return counted.unionByName(whole.join(sizes, item).select(*counted.columns))


def match_snippets(ranked: DataFrame, items: DataFrame, whole: DataFrame, size: int = SNIPPET_TOKENS) -> DataFrame:
    """``ranked`` with a snippet of each item's content: ``size`` tokens from the hit on after which the most query words follow.

    Hits stand between marks; left-out text is shown as such. Items met by their title
    alone show their beginning. ``whole`` has the hits of ``whole_phrases``.
    """
    keys = ["query_id", "item_id"]
    hits = whole.where("field = 'c'").join(ranked.select(*keys), keys)
    later = hits.select(*keys, F.col("pos").alias("other"), F.col("start").alias("at"))
    seen = hits.select(*keys, "start").distinct().join(later, keys).where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + size))
    best = seen.groupBy(*keys, "start").agg(F.countDistinct("other").alias("words")).groupBy(*keys).agg((-F.max(F.struct("words", -F.col("start"))).getItem("col2")).alias("begin"))
    lit = hits.select(*keys, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("place")).groupBy(*keys).agg(F.collect_set("place").alias("lit"))
    shown = ranked.join(best, keys, "left").join(lit, keys, "left").join(items.select(F.col("id").alias("item_id"), "content"), "item_id")
    pieces = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(f"({TOKEN}{NO_TOKEN})"), F.lit(1))
    shown = shown.withColumn("pieces", pieces).withColumn("begin", F.coalesce("begin", F.lit(0))).withColumn("lit", F.coalesce("lit", F.array().cast("array<int>")))
    token = lambda p: F.regexp_extract(p, TOKEN, 0)
    marked = lambda p, i: F.when(F.array_contains("lit", F.col("begin") + i), F.concat(F.lit(HIT_OPEN), token(p), F.lit(HIT_CLOSE), F.regexp_replace(p, f"^{TOKEN}", ""))).otherwise(p)
    text = F.array_join(F.transform(F.slice("pieces", F.col("begin") + 1, F.lit(size)), marked), "")
    text = F.regexp_replace(text, f"[^\\p{{L}}\\p{{N}}\\p{{Co}}{HIT_CLOSE}]+$", "")
    more = F.size("pieces") > F.col("begin") + size
    snippet = F.concat(F.when(F.col("begin") > 0, LEFT_OUT).otherwise(""), text, F.when(more, LEFT_OUT).otherwise(""))
    return shown.select(*ranked.columns, snippet.alias("snippet"))


def idf(items: Column, df: Column) -> Column:
    return F.greatest(F.log((items - df + 0.5) / (df + 0.5)), F.lit(1e-6))


def impact(tf: Column, length: Column, mean: Column, k1: float = K1, b: float = B) -> Column:
    """What a word adds to an item's score, but for its idf: more with tf, less with length."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def word_scores(hits: DataFrame, totals: DataFrame) -> DataFrame:
    """Hits with column part: what each word adds to each item's score. A word's df counts its hits."""
    df = hits.groupBy("query_id", "pos").agg(F.count("*").alias("df"))
    part = idf(F.col("items"), F.col("df")) * impact(F.col("tf"), F.col("length"), F.col("mean"))
    return hits.join(F.broadcast(df), ["query_id", "pos"]).crossJoin(F.broadcast(totals)).withColumn("part", part).drop("df", "items", "mean")


def bm25(hits: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows (query_id, item_id, score) of all items that have some word; idf never under 1e-6."""
    return word_scores(hits, totals).groupBy("query_id", "item_id").agg(F.sum("part").alias("score"))


#: Blocks, and items for each wanted one, that are scored first to learn how high the wanted ones score at least.
SEED_BLOCKS, SEED_ITEMS = 8, 4
#: Scores this close may tie once they are rounded.
ROUNDED = 1e-8


def frequent_words(forms: DataFrame) -> list[Row]:
    """Query words (query_id, pos, term, df) that meet one frequent term alone, whose blocks have bounds; no more than were typed."""
    words = forms.groupBy("query_id", "pos").agg(F.count("*").alias("forms"), F.max("n").alias("n"), F.min("term").alias("term"), F.max("df").alias("df"))
    return words.where((F.col("forms") == 1) & (F.col("n") == 1) & (F.col("df") > I.FREQUENT)).drop("forms", "n").collect()


class Pruned:
    """Keyword search that reads of frequent terms only the blocks whose bounds reach the wanted ranks.

    Words that are rare, begun or of several terms are scored whole. A block's bound for a
    query is the sum of what its frequent terms can add at most and of what its other words
    do add at most. The best blocks are scored first; the score of the last wanted rank
    there is reached by all that is wanted, so blocks bounded under it are left out. What
    is found, ties too, is what scoring everything finds.
    """

    def __init__(self, index: I.Index, forms: DataFrame, frequent: list[Row], limit: int, title_weight: float = TITLE_WEIGHT):
        spark, self.limit, self.title_weight = index.postings.sparkSession, limit, title_weight
        total = index.totals.first()
        items, self.mean = F.lit(total["items"]), F.lit(float(total["mean"]) or 1.0)
        self.posted = narrowed(index.postings, sorted({f.term for f in frequent}))
        words = spark.createDataFrame(frequent, "query_id long, pos int, term string, df long")
        self.words = words.select("query_id", "pos", "term", idf(items, F.col("df")).alias("idf"))
        others = forms.join(F.broadcast(words.select("query_id", "pos")), ["query_id", "pos"], "left_anti")
        hits = checkpoint(phrase_hits(index.postings, others, title_weight))
        self.whole = word_scores(hits, index.totals).select("query_id", "pos", "item_id", "block", "part")
        most = impact(F.col("most_title") * F.lit(float(title_weight)) + F.col("most_content"), F.col("least_length"), self.mean)
        bounded = index.blocks.join(F.broadcast(self.words), "term").select("query_id", "block", (F.col("idf") * most).alias("bound"), "n")
        added = self.whole.groupBy("query_id", "pos", "block").agg(F.max("part").alias("bound"), F.lit(0).cast("long").alias("n"))
        self.bounds = checkpoint(bounded.unionByName(added.drop("pos")).groupBy("query_id", "block").agg(F.sum("bound").alias("bound"), F.sum("n").alias("n")))

    def scores(self, blocks: DataFrame) -> DataFrame:
        """Scores (query_id, item_id, score) of all items of some blocks (query_id, block)."""
        asked = blocks.join(F.broadcast(self.words), "query_id")
        part = F.col("idf") * impact(frequency(self.title_weight), F.col("length"), self.mean)
        frequent = self.posted.join(asked, ["term", "block"]).select("query_id", "item_id", part.alias("part"))
        whole = self.whole.join(blocks.select("query_id", "block"), ["query_id", "block"]).select("query_id", "item_id", "part")
        return frequent.unionByName(whole).groupBy("query_id", "item_id").agg(F.sum("part").alias("score"))

    def needed(self) -> DataFrame:
        """Blocks (query_id, block, bound, n) that may hold wanted items."""
        by = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
        before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        seeds = self.bounds.withColumns({"turn": F.row_number().over(by), "before": before}).where((F.col("turn") <= SEED_BLOCKS) | (F.col("before") < SEED_ITEMS * self.limit))
        ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc())
        reached = self.scores(seeds.select("query_id", "block")).withColumn("turn", F.row_number().over(ranked)).where(F.col("turn") == self.limit).select("query_id", F.col("score").alias("reached"))
        known = self.bounds.join(F.broadcast(reached), "query_id", "left")
        return known.where(F.col("bound") * (1 + 1e-9) + ROUNDED >= F.coalesce("reached", F.lit(0.0))).drop("reached")

    def best(self) -> DataFrame:
        return self.scores(checkpoint(self.needed().select("query_id", "block")))

    def reading(self) -> DataFrame:
        """Rows (query_id, needed, held): postings of frequent terms that a query scores, of those that there are."""
        held = self.bounds.groupBy("query_id").agg(F.sum("n").alias("held"))
        return held.join(self.needed().groupBy("query_id").agg(F.sum("n").alias("needed")), "query_id", "left").select("query_id", F.coalesce("needed", F.lit(0)).alias("needed"), "held")


def pruned(index: I.Index, forms: DataFrame, limit: int, title_weight: float = TITLE_WEIGHT) -> Pruned | None:
    """The pruned search for some words; None where none of them is frequent."""
    frequent = frequent_words(forms)
    return Pruned(index, forms, frequent, limit, title_weight) if frequent else None


def keyword(index: I.Index, parts: DataFrame, limit: int, title_weight: float = TITLE_WEIGHT, digits: int = 9) -> DataFrame:
    """The best items (query_id, item_id, score, rank) by BM25; scores are rounded, ties go to the smaller id."""
    forms = checkpoint(typed_forms(parts, index.vocabulary))
    found = pruned(index, forms, limit, title_weight)
    scored = found.best() if found else bm25(phrase_hits(index.postings, forms, title_weight), index.totals)
    return top(scored.withColumn("score", F.round("score", digits)), limit)


def top(scored: DataFrame, limit: int, score: str = "score", key: str = "item_id") -> DataFrame:
    """The best ``limit`` rows of each query with their rank from 0; ties to the smaller id."""
    by = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(by) - 1).where(F.col("rank") < limit)


def coverage(hits: DataFrame, parts: DataFrame, words: DataFrame) -> DataFrame:
    """Rows (query_id, item_id, coverage): the share of query words an item has; words are (query_id, n_words)."""
    met = hits.groupBy("query_id", "item_id").agg(F.countDistinct("pos").alias("met"))
    return met.join(F.broadcast(words), "query_id").select("query_id", "item_id", (F.col("met") / F.col("n_words")).alias("coverage"))


def best_chunks(found: DataFrame) -> DataFrame:
    """The nearest chunk (query_id, item_id, cos, chunk_id, ord) of each item; ties to the smaller chunk id."""
    best = found.groupBy("query_id", "item_id").agg(F.max(F.struct("cos", (-F.col("chunk_id")).alias("behind"), "ord")).alias("best"))
    return best.select("query_id", "item_id", "best.cos", (-F.col("best.behind")).alias("chunk_id"), "best.ord")


def semantic_nearest(chunks: DataFrame, queries: DataFrame, limit: int, floor: float = MIN_COSINE, window: float = COSINE_WINDOW) -> DataFrame:
    """Items over the floor and near the best one, by cosine, with no more than ``limit`` kept of any partition."""
    best = K.nearest_items(chunks, queries, limit, floor)
    return best.withColumn("top", F.max("cos").over(Window.partitionBy("query_id"))).where(F.col("cos") >= F.col("top") - window).drop("top")


def semantic(found: DataFrame, limit: int, floor: float = MIN_COSINE, window: float = COSINE_WINDOW) -> DataFrame:
    """Items over the floor and near the best one, by cosine."""
    best = best_chunks(found.where(F.col("cos") >= floor))
    best = best.withColumn("top", F.max("cos").over(Window.partitionBy("query_id"))).where(F.col("cos") >= F.col("top") - window).drop("top")
    return top(best, limit, "cos")


def semantic_score(cos: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos - SEMANTIC_FLOOR) / (1 - SEMANTIC_FLOOR)))


def fold_queries(vectors: DataFrame) -> DataFrame:
    """Rows (query_id, vec): twice the query plus its rewrites, to unit length.

    ``vectors`` has (query_id, role, vec), role 0 for the query and more for rewrites.
    """
    parts = vectors.select("query_id", F.posexplode("vec").alias("i", "x"), F.when(F.col("role") == 0, 2.0).otherwise(1.0).alias("w"))
    sums = parts.groupBy("query_id", "i").agg(F.sum(F.col("x").cast("double") * F.col("w")).alias("x"))
    made = sums.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return made.select("query_id", F.transform("v", lambda p: p["x"] / F.greatest(F.col("norm"), F.lit(1e-6))).alias("vec"))


def fuse(keyword: DataFrame, covered: DataFrame, sem: DataFrame, limit: int) -> DataFrame:
    """Hybrid scores (query_id, item_id, score, via): keyword ranks by coverage squared, plus the semantic score."""
    kw = keyword.join(covered, ["query_id", "item_id"], "left").select("query_id", "item_id", "rank", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
    kw = kw.withColumn("kw", KEYWORD_WEIGHT * F.col("coverage") * F.col("coverage") / (1 + F.col("rank")))
    both = kw.join(sem.select("query_id", "item_id", semantic_score(F.col("cos")).alias("sem")), ["query_id", "item_id"], "full_outer")
    k, s = F.coalesce(F.col("coverage") >= 0.5, F.lit(False)), F.col("sem").isNotNull()
    via = F.when(k & s, "both").when(s, "sem").otherwise("kw")
    scored = both.select("query_id", "item_id", (F.coalesce("kw", F.lit(0.0)) + F.coalesce("sem", F.lit(0.0))).alias("score"), via.alias("via"))
    return top(scored, limit)


def reciprocal_ranks(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank + 1) over the lists (query_id, key, rank) that hold a key."""
    every = lists[0].select("query_id", key, "rank")
    for more in lists[1:]:
        every = every.unionByName(more.select("query_id", key, "rank"))
    return every.groupBy("query_id", key).agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"))


def best_per_item(units: DataFrame) -> DataFrame:
    """A ranking of units as a ranking of items, each at its best unit."""
    first = units.groupBy("query_id", "item_id").agg(F.min("rank").alias("at"))
    by = Window.partitionBy("query_id").orderBy("at")
    return first.select("query_id", "item_id", (F.row_number().over(by) - 1).alias("rank"))


def keep(f: Filters) -> Column:
    """Whether an item passes the filters of a query."""
    ok = F.lit(True)
    if f.kinds:
        ok = ok & F.col("kind").isin(f.kinds)
    if f.code:
        ok = ok & (F.col("kind") != "web") & is_code_name(F.coalesce("source", "title"))
    if f.since is not None:
        ok = ok & (F.col("added_at") >= f.since)
    if f.source is not None:
        ok = ok & F.contains(F.lower(F.concat_ws(" ", F.coalesce("source", F.lit("")), F.col("title"))), F.lit(f.source))
    return ok


def has_tags(tags: list[str]) -> Column:
    ok = F.lit(True)
    for t in tags:
        ok = ok & F.array_contains("tags", t)
    return ok


def term_presence(terms: DataFrame, occ: DataFrame) -> DataFrame:
    """Rows (query_id, term, present): whether a term, a stem of it, or a word that begins with it occurs.

    ``terms`` has (query_id, term) and is small.
    """
    small = terms.select("query_id", "term", F.explode(F.array_union(F.array("term"), stems(F.col("term")))).alias("form"))
    vocabulary = occ.select("term").distinct()
    exact = small.join(vocabulary.select(F.col("term").alias("form")), "form", "left_semi").select("query_id", "term").distinct()
    prefix = vocabulary.select(F.col("term").alias("word")).join(F.broadcast(terms), F.col("word").startswith(F.col("term"))).select("query_id", "term").distinct()
    met = exact.unionByName(prefix).distinct().withColumn("present", F.lit(True))
    return terms.join(met, ["query_id", "term"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def absent(queries: DataFrame, occ: DataFrame, best: DataFrame) -> DataFrame:
    """Rows (query_id, n_terms, n_present, best_cosine, absent): what the corpus cannot answer.

    ``queries`` has (query_id, text) and is small; ``best`` has (query_id, cos), the best
    cosine of each query that has a vector.
    """
    terms = queries.select("query_id", F.explode(content_terms(F.col("text"))).alias("term"))
    met = term_presence(terms, occ).groupBy("query_id").agg(F.count("*").alias("n_terms"), F.count_if("present").alias("n_present"))
    out = queries.select("query_id").join(met, "query_id", "left").join(best, "query_id", "left")
    out = out.select("query_id", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("n_present", F.lit(0)).alias("n_present"), F.col("cos").alias("best_cosine"))
    gone = (F.col("n_terms") >= ABSENT_TERMS) & (F.col("n_present") == 0) & (F.col("best_cosine").isNull() | (F.col("best_cosine") < ABSENT_COSINE))
    return out.withColumn("absent", gone)


def best_cosine(found: DataFrame) -> DataFrame:
    """Rows (query_id, cos): the largest cosine, 0 at least."""
    return found.groupBy("query_id").agg(F.greatest(F.lit(0.0), F.max("cos")).alias("cos"))


def any_term_present(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows (query_id, present): whether any content term of a text is a term of the index, exactly."""
    terms = queries.select("query_id", F.explode(content_terms(F.col("text"))).alias("term"))
    met = terms.join(vocabulary, "term", "left_semi").select("query_id").distinct().withColumn("present", F.lit(True))
    return queries.select("query_id").join(met, "query_id", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def unit_bm25(
    units: DataFrame,
    queries: DataFrame,
    title_weight: float = 3.0,
    k1: float = 1.5,
    b: float = 0.75,
    every: bool = False,
    prefix: bool = False,
    stopwords: list[str] | tuple[str, ...] = (),
    extra: DataFrame | None = None,
    extra_weight: float = 0.5,
) -> DataFrame:
    """Okapi scores (query_id, chunk_id, item_id, score) of units with their titles, for the evaluation harness.

    ``units`` has (chunk_id, item_id, tokens, title_tokens); ``queries`` (query_id, terms)
    of lower-case ASCII tokens. Any term may match, with ``every`` all must; repeated terms
    count again. ``stopwords`` go unless nothing else is left. With ``prefix`` the last term
    counts the terms that begin with it in units that lack it, under its own df. ``extra``
    (query_id, term) are expansions of half weight, which no unit must have.
    """
    kept = F.filter("terms", lambda t: ~t.isin(list(stopwords))) if stopwords else F.col("terms")
    asked = queries.withColumn("terms", F.when(F.size(kept) > 0, kept).otherwise(F.col("terms"))).select("query_id", F.size("terms").alias("n"), F.posexplode("terms").alias("j", "term"))
    asked = asked.select("query_id", "n", "j", "term", F.lit(1.0).alias("weight"), (F.col("j") == F.col("n") - 1).alias("last"))
    if extra is not None:
        more = extra.select("query_id", F.lit(0).alias("n"), (-1 - F.row_number().over(Window.partitionBy("query_id").orderBy("term"))).alias("j"), "term", F.lit(float(extra_weight)).alias("weight"), F.lit(False).alias("last"))
        asked = asked.unionByName(more)
    # Only what was asked for is counted: texts are read once, and of their words those that may match are kept.
    typed = asked.select("term", "last").collect()
    begins = [r.term for r in typed if prefix and r.last]
    begun_by = F.array(*map(F.lit, begins)).cast("array<string>")
    asks = lambda t: t.isin(sorted({r.term for r in typed})) | F.exists(begun_by, lambda p: t.startswith(p))
    weighed = lambda c, w: F.transform(F.filter(c, asks), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    met_words = F.concat(weighed("tokens", 1.0), weighed("title_tokens", float(title_weight)))
    read = checkpoint(units.select("chunk_id", "item_id", (F.size("tokens") + title_weight * F.size("title_tokens")).alias("length"), met_words.alias("met")))
    terms = read.select("chunk_id", "item_id", F.inline("met"))
    size = read.select("chunk_id", "length")
    totals = size.agg(F.count("*").alias("units"), F.avg("length").alias("mean"))
    tf = terms.join(F.broadcast(asked.select("term").distinct()), "term").groupBy("chunk_id", "item_id", "term").agg(F.sum("w").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    met = tf.join(F.broadcast(asked), "term").select("query_id", "n", "j", "term", "weight", "chunk_id", "item_id", "tf")
    if prefix:
        lasts = asked.where("last").select("query_id", "n", "j", F.col("term").alias("typed"), "weight")
        begun = terms.join(F.broadcast(lasts), F.col("term").startswith(F.col("typed")) & (F.col("term") != F.col("typed"))).groupBy("query_id", "n", "j", "typed", "weight", "chunk_id", "item_id").agg(F.sum("w").alias("tf"))
        met = met.unionByName(begun.withColumnRenamed("typed", "term").join(met.select("query_id", "j", "chunk_id"), ["query_id", "j", "chunk_id"], "left_anti"))
    met = met.join(df, "term", "left").join(size, "chunk_id").crossJoin(F.broadcast(totals)).withColumn("f", F.col("tf") * F.col("weight")).withColumn("df", F.coalesce("df", F.lit(0)))
    idf = F.log(1 + (F.col("units") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = met.groupBy("query_id", "chunk_id", "item_id").agg(F.sum(part).alias("score"), F.count_if(F.col("j") >= 0).alias("have"), F.max("n").alias("n"))
    return (scored.where("have = n") if every else scored).select("query_id", "chunk_id", "item_id", "score")


def boost_terms(questions: DataFrame, units: DataFrame, weight: float = 0.08, least: int = 4, most_share: float = 0.34, stopwords: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Rows (query_id, term, weight): longer terms of questions that few items hold, the rarer the heavier."""
    asked = questions.select("query_id", F.explode(F.array_distinct(ascii_tokens(F.col("text")))).alias("term")).where((F.length("term") >= least) & ~F.col("term").isin(list(stopwords) or [""]))
    typed = F.array(*[F.lit(r.term) for r in asked.select("term").distinct().collect()]).cast("array<string>")
    said = units.select("item_id", F.explode(F.array_intersect(F.concat("tokens", "title_tokens"), typed)).alias("term"))
    df = said.join(F.broadcast(asked.select("term").distinct()), "term").groupBy("term").agg(F.countDistinct("item_id").alias("df"))
    items = units.agg(F.greatest(F.countDistinct("item_id"), F.lit(1)).alias("items"))
    share = F.coalesce("df", F.lit(0)) / F.col("items")
    return asked.join(df, "term", "left").crossJoin(F.broadcast(items)).where(share <= most_share).select("query_id", "term", (F.lit(weight) * (1 - share)).alias("weight"))


def boosted(found: DataFrame, texts: DataFrame, boosts: DataFrame) -> DataFrame:
    """Cosines (query_id, chunk_id, item_id, cos) with column dense: the cosine and the weights of boost terms in a unit's text (chunk_id, text)."""
    met = texts.join(F.broadcast(boosts), F.lower("text").contains(F.col("term"))).groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("boost"))
    return found.join(met, ["query_id", "chunk_id"], "left").withColumn("dense", F.col("cos") + F.coalesce("boost", F.lit(0.0))).drop("boost")


def rerank_items(fused: DataFrame, reranked: DataFrame) -> DataFrame:
    """Items (query_id, item_id, score) with their rank by best reranked unit (query_id, item_id, logit), unseen ones last, then by score."""
    best = reranked.groupBy("query_id", "item_id").agg(F.max("logit").alias("logit"))
    by = Window.partitionBy("query_id").orderBy(F.col("logit").desc_nulls_last(), F.col("score").desc(), F.col("item_id"))
    return fused.join(best, ["query_id", "item_id"], "left").withColumn("rank", F.row_number().over(by) - 1).drop("logit")
