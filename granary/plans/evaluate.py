"""Evaluation: a configured retrieval run over a table of questions, and its report."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import chunks as C
from granary.operators import context as X
from granary.operators import search as S
from granary.plans import models as M

#: Words left out of keyword queries where stopwords are.
KEYWORD_STOPWORDS = (
    "a an and are as at be been being but by can did do does for from had has have how i if in into is it its me my of "
    "on or our so than that the their them then there these they this to was we were what when where which who whom why "
    "will with you your"
).split()


@dataclass(frozen=True)
class Config:
    """What a run may vary; the values are those of the live search. The names, which configuration files use.

    Paths are empty where nothing is read from them. The names of models and what concerns their
    running go to the caller's factory, see ``embedders``.
    """

    db: str = ""
    rechunk: bool = True
    doc_descriptions: str = ""
    chunk_contexts: str = ""
    embed_model: str = ""
    embed_model_file: str = "model.onnx"
    max_len: int = 512
    batch_size: int = 16
    query_instruction: str = ""
    cache_dir: str = ""
    query_cache: bool = True
    threads: int = 0
    dense_top: int = 40
    min_cosine: float = S.MIN_COSINE
    cosine_window: float = S.COSINE_WINDOW
    sem_floor: float = S.SEMANTIC_FLOOR
    bm25: bool = True
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_title_weight: float = 3.0
    bm25_doc_units: bool = True
    kw_stopwords: bool = False
    typo_or: bool = True
    prefix_last: bool = True
    idf_boost: bool = True
    idf_boost_weight: float = 0.08
    idf_min_len: int = 4
    idf_max_frac: float = 0.34
    idf_stopwords: bool = False
    query_expansion: str = "off"
    expansion_table: str = ""
    expansion_max: int = 12
    expansion_weight: float = 0.5
    prf: bool = False
    prf_k: int = 3
    prf_text: str = "title"
    prf_opening_words: int = 12
    rerank: bool = False
    rerank_model: str = ""
    rerank_model_file: str = "model.onnx"
    rerank_max_len: int = 320
    rerank_batch_size: int = 0
    rerank_threads: int = 0
    rerank_k: int = 20
    rerank_doc_words: int = 60
    rerank_fusion: str = "off"
    chunk_mode: str = "words"
    chunk_min_words: int = 0
    chunk_words: int = 100
    chunk_overlap: int = 20
    max_chunks: int = 600
    unit_text: str = "title_chunk"
    doc_units: bool = False
    doc_unit_text: str = "title"
    doc_opening_words: int = 60
    pooling: str = "cls"
    query_prefix: str = ""
    passage_prefix: str = ""
    kw_weight: float = S.KEYWORD_WEIGHT
    fusion: str = "score"
    rrf_k: int = 60
    topk: int = 5
    absent_metric: str = "cosine"
    absent_threshold: float = 0.45
    absent_cos_max: float = 1.0
    absent_rare_frac: float = 0.0
    absent_margin_k: int = 3
    absent_min_terms: int = 1

    @classmethod
    def of(cls, **values) -> Config:
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**values)


def fuse(cfg: Config, dense: DataFrame, keyword: DataFrame, coverage: DataFrame) -> DataFrame:
    """Item scores (query_id, item_id, score) by the configured fusion.

    ``dense`` has all cosines (query_id, chunk_id, item_id, cos), ``keyword`` unit scores
    (query_id, chunk_id, item_id, score).
    """
    kw = S.top(keyword, 10**9, "score", "chunk_id")
    near = S.top(dense, cfg.dense_top, "cos", "chunk_id")
    if cfg.fusion == "score":
        ranked = S.best_per_item(kw).join(coverage, ["query_id", "item_id"], "left")
        part = cfg.kw_weight * F.pow(F.coalesce("coverage", F.lit(0.0)), 2) / (1 + F.col("rank"))
        sem = S.semantic(dense, 10**9, cfg.min_cosine, cfg.cosine_window)
        norm = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("cos") - cfg.sem_floor) / (1 - cfg.sem_floor)))
        both = sem.select("query_id", "item_id", norm.alias("s"))
        both = both.unionByName(ranked.select("query_id", "item_id", part.alias("s"))) if cfg.bm25 else both
        return both.groupBy("query_id", "item_id").agg(F.sum("s").alias("score"))
    kw = kw.where(F.col("rank") < cfg.dense_top)
    if cfg.fusion == "rrf_units":
        lists = [near, kw] if cfg.bm25 else [near]
        units = near.select("query_id", "chunk_id", "item_id").unionByName(kw.select("query_id", "chunk_id", "item_id")).distinct()
        fused = S.reciprocal_ranks(lists, "chunk_id", cfg.rrf_k).join(units, ["query_id", "chunk_id"])
        return fused.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    if cfg.fusion == "rrf_docs":
        lists = [S.best_per_item(near)] + ([S.best_per_item(kw)] if cfg.bm25 else [])
        return S.reciprocal_ranks(lists, "item_id", cfg.rrf_k)
    raise ValueError(f"unknown fusion: {cfg.fusion}")


def rare_hits(questions: DataFrame, vocabulary: DataFrame, least: int) -> DataFrame:
    """Rows (query_id, n_content_terms, rare_hit_frac): the share of longer terms that occur anywhere; 1 without any."""
    asked = questions.select("query_id", F.explode(F.array_distinct(F.filter(T.ascii_tokens(F.col("text")), lambda t: F.length(t) >= least))).alias("term"))
    met = asked.join(vocabulary.select("term").distinct().withColumn("known", F.lit(1)), "term", "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("known").alias("k"))
    return questions.select("query_id").join(met, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_content_terms"), F.coalesce(F.col("k") / F.col("n"), F.lit(1.0)).alias("rare_hit_frac"))


def margin(ranked: DataFrame, score: str, k: int) -> DataFrame:
    """Rows (query_id, top, margin): the best score and its distance to the k-th."""
    by = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "item_id")
    r = ranked.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= k)
    return r.groupBy("query_id").agg(F.max(score).alias("top"), (F.max(score) - F.min(score)).alias("margin"))


def absent_signal(cfg: Config) -> Column:
    """Whether a question counts as absent, from columns top_cosine, top_fused, cos_margin, fused_margin, n_content_terms, rare_hit_frac."""
    simple = {"cosine": "top_cosine", "fused": "top_fused", "margin_cos": "cos_margin", "margin_fused": "fused_margin"}
    if cfg.absent_metric in simple:
        return F.coalesce(F.col(simple[cfg.absent_metric]), F.lit(0.0)) < cfg.absent_threshold
    zero = (F.col("n_content_terms") >= cfg.absent_min_terms) & (F.col("rare_hit_frac") <= cfg.absent_rare_frac) & (F.coalesce("top_cosine", F.lit(0.0)) < cfg.absent_cos_max)
    if cfg.absent_metric == "bm25_zero":
        return zero
    if cfg.absent_metric == "combined":
        return zero | (F.coalesce("top_cosine", F.lit(0.0)) < cfg.absent_threshold)
    raise ValueError(f"unknown absent metric: {cfg.absent_metric}")


def json_table(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Rows (key, value) of a JSON file of one object, whose values are of the type ``value``."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, {value}>").alias("m"))
    return rows.select(F.explode("m").alias("key", "value"))


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """Rows (word, j, synonym) of a JSON file {"word": ["synonym", ...]}, all in lower case."""
    rows = json_table(spark, path, "array<string>").select(F.lower("key").alias("word"), F.posexplode("value").alias("j", "synonym"))
    return rows.select("word", "j", F.lower("synonym").alias("synonym"))


def units_of(cfg: Config, items: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Rows (chunk_id, item_id, ord, title, text, embed_text) of items, cut and headed as configured; document units stand at ord -1.

    Without ``rechunk`` the chunks are those ``stored`` (item_id, ord, text), in the order of their ord. ``embed_text`` is what is
    embedded: the title where configured, a chunk's context ("item:ord") and its text. A document unit may hold the item's title, its opening or its description.
    """
    spark, titles = items.sparkSession, items.select(F.col("id").alias("item_id"), "title")
    if cfg.rechunk:
        cut = C.chunk_by_headings if cfg.chunk_mode == "para_heading" else C.chunk_text
        more = {"least": cfg.chunk_min_words} if cfg.chunk_mode == "para_heading" else {}
        sizes = {"target": cfg.chunk_words, "overlap": cfg.chunk_overlap, "most": cfg.max_chunks}

        def parts(contents: pd.Series) -> pd.Series:
            return contents.map(lambda t: cut(t or "", **sizes, **more))

        texts = F.pandas_udf(parts, "array<string>")("content")
        made = items.select(F.col("id").alias("item_id"), "title", F.posexplode(texts).alias("ord", "text"))
    else:
        if stored is None:
            raise ValueError("without rechunk the stored chunks are wanted")
        place = F.row_number().over(Window.partitionBy("item_id").orderBy("ord", "text")) - 1
        made = stored.where("ord >= 0").withColumn("ord", place).join(titles, "item_id").select("item_id", "title", "ord", "text")
    made = made.withColumn("embed_text", F.col("text"))
    if cfg.chunk_contexts:
        said = json_table(spark, cfg.chunk_contexts, "string").select("key", F.nullif("value", F.lit("")).alias("context"))
        keyed = made.withColumn("key", F.concat_ws(":", "item_id", "ord")).join(said, "key", "left")
        made = keyed.withColumn("embed_text", F.concat_ws("\n", "context", "text")).select(*made.columns)
    if cfg.unit_text == "title_chunk":
        made = made.withColumn("embed_text", F.concat_ws("\n", "title", "embed_text"))
    if cfg.doc_units:
        whole = items.select(F.col("id").alias("item_id"), "title", F.lit(-1).alias("ord"), F.array_join(F.slice(T.words(F.col("content")), 1, cfg.doc_opening_words), " ").alias("opening"))
        if cfg.doc_unit_text == "description":
            told = json_table(spark, cfg.doc_descriptions, "string").select(F.col("key").cast("long").alias("item_id"), F.col("value").alias("description")) if cfg.doc_descriptions else None
            whole = whole.join(told, "item_id", "left") if told is not None else whole.withColumn("description", F.lit(None).cast("string"))
        text = {"title": F.lit(""), "title_opening": F.col("opening"), "description": F.coalesce("description", F.lit(""))}[cfg.doc_unit_text]
        shown = F.col("title") if cfg.doc_unit_text == "title" else F.concat_ws("\n", "title", text)
        made = made.unionByName(whole.select("item_id", "title", "ord", text.alias("text"), shown.alias("embed_text")))
    return made.withColumn("chunk_id", F.xxhash64("item_id", "ord"))


def embedders(cfg: Config, make: Callable[[Config, str], M.Embedder]) -> tuple[Callable[[], M.Embedder], Callable[[], M.Embedder]]:
    """What makes the embedder of passages and that of questions: ``make`` is given the settings and what comes before each text."""
    return lambda: make(cfg, cfg.passage_prefix), lambda: make(cfg, cfg.query_prefix + cfg.query_instruction)


def embedded(cfg: Config, texts: DataFrame, make: Callable[[], M.Embedder], kind: str = "passages") -> DataFrame:
    """Texts (id, text) with vectors. With ``cache_dir`` those kept there are taken, and new ones are kept there; questions are, where ``query_cache`` is set."""
    if not cfg.cache_dir or (kind == "questions" and not cfg.query_cache):
        return texts.withColumn("vec", M.embed(F.col("text"), make))
    path, spark = f"{cfg.cache_dir}/{kind}", texts.sparkSession
    try:
        kept = spark.read.schema("key string, vec array<float>").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        kept = spark.createDataFrame([], "key string, vec array<float>")
    _, fresh = M.embed_cached(texts, kept, make)
    fresh.select("key", F.col("vec").cast("array<float>").alias("vec")).write.mode("append").parquet(path)
    now = spark.read.schema("key string, vec array<float>").parquet(path).groupBy("key").agg(F.first("vec").alias("vec"))
    return texts.withColumn("key", M.cache_key(make().name, F.col("text"))).join(now, "key").drop("key")


def feedback(cfg: Config, kw: DataFrame, units: DataFrame) -> DataFrame:
    """Rows (query_id, feedback): titles of the first items by keywords, or titles with their unit's opening."""
    first = S.best_per_item(S.top(kw, 10**9, "score", "chunk_id")).where(F.col("rank") < cfg.prf_k)
    by = Window.partitionBy("query_id", "item_id").orderBy(F.col("score").desc(), "chunk_id")
    best = kw.withColumn("rn", F.row_number().over(by)).where("rn = 1").select("query_id", "item_id", "chunk_id")
    said = F.col("title") if cfg.prf_text == "title" else F.concat_ws(" ", "title", F.array_join(F.slice(T.words(F.col("text")), 1, cfg.prf_opening_words), " "))
    told = first.join(best, ["query_id", "item_id"]).join(units.select("chunk_id", said.alias("said")), "chunk_id")
    return told.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "said"))), lambda x: x["said"]), " ").alias("feedback"))


def run(cfg: Config, questions: DataFrame, units: DataFrame, dense: DataFrame, rerank: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Rows (query_id, top_items, absent) for questions (query_id, text).

    ``units`` has (chunk_id, item_id, tokens, title_tokens), and (ord, title, text) where
    boosts, document units or a reranker are wanted; ``dense`` the cosines of all units for
    all questions; ``rerank`` scores a question and a passage.
    """
    asked = questions.select("query_id", T.ascii_tokens(F.col("text")).alias("terms"))
    scored = units if cfg.bm25_doc_units or "ord" not in units.columns else units.where("ord >= 0")
    extra = X.expansions(questions, most=cfg.expansion_max, terms=1, table=synonyms(questions.sparkSession, cfg.expansion_table) if cfg.expansion_table else None).select("query_id", F.col("synonym").alias("term")) if cfg.query_expansion in ("keyword", "both") else None
    stopwords = KEYWORD_STOPWORDS if cfg.kw_stopwords else ()
    kw = S.unit_bm25(scored, asked, cfg.bm25_title_weight, cfg.bm25_k1, cfg.bm25_b, not cfg.typo_or, cfg.typo_or and cfg.prefix_last, stopwords, extra, cfg.expansion_weight)
    if cfg.idf_boost and "text" in units.columns:
        boosts = S.boost_terms(questions, units, cfg.idf_boost_weight, cfg.idf_min_len, cfg.idf_max_frac, T.STOPWORDS if cfg.idf_stopwords else ())
        texts = units.select("chunk_id", F.concat_ws(" ", "title", "text").alias("text"))
        dense = S.boosted(dense, texts, boosts).withColumn("cos", F.col("dense")).drop("dense")
    vocabulary = units.select("item_id", F.explode(F.array_union("tokens", "title_tokens")).alias("term")).distinct()
    terms = asked.select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    cover = terms.join(vocabulary, "term").groupBy("query_id", "item_id").agg((F.count("*") / F.first("n")).alias("coverage"))
    fused = fuse(cfg, dense, kw, cover)
    if cfg.rerank_fusion == "docs" and rerank is not None:
        heads = S.top(dense, cfg.dense_top, "cos", "chunk_id").select("query_id", "chunk_id", "item_id", (2 * F.col("rank")).alias("place")).unionByName(S.top(kw, cfg.rerank_k, "score", "chunk_id").select("query_id", "chunk_id", "item_id", (10**6 + F.col("rank")).alias("place")))
        heads = heads.groupBy("query_id", "chunk_id", "item_id").agg(F.min("place").alias("place"))
        some = heads.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "chunk_id"))).where(F.col("rn") <= cfg.rerank_k)
        shown = some.join(units.select("chunk_id", F.concat_ws(": ", "title", F.array_join(F.slice(T.words(F.col("text")), 1, cfg.rerank_doc_words), " ")).alias("passage")), "chunk_id").join(F.broadcast(questions), "query_id")
        order = S.rerank_items(fused, shown.select("query_id", "item_id", rerank(F.col("text"), F.col("passage")).alias("logit")))
        fused = order.select("query_id", "item_id", (-F.col("rank")).cast("double").alias("score"))
    best = S.top(fused, cfg.topk).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item_id"))), lambda r: r["item_id"]).alias("top_items"))
    by_item = dense.groupBy("query_id", "item_id").agg(F.max("cos").alias("cos"))
    signals = questions.select("query_id")
    for name, ranked, col in (("cos", by_item, "cos"), ("fused", fused, "score")):
        m = margin(ranked, col, cfg.absent_margin_k).select("query_id", F.col("top").alias("top_cosine" if name == "cos" else "top_fused"), F.col("margin").alias(f"{name}_margin"))
        signals = signals.join(m, "query_id", "left")
    signals = signals.join(rare_hits(questions, vocabulary, cfg.idf_min_len), "query_id")
    return signals.join(best, "query_id", "left").select("query_id", F.coalesce("top_items", F.array().cast("array<bigint>")).alias("top_items"), absent_signal(cfg).alias("absent"))


def report(found: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of rates. ``expected`` has (query_id, items); none mean that the question has no answer."""
    r = found.join(expected, "query_id")
    gone = F.size("items") == 0
    hit = lambda k: F.arrays_overlap(F.slice("top_items", 1, k), "items")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return r.agg(
        F.count("*").alias("questions"), count(~gone).alias("answerable"), count(~gone & hit(1)).alias("hit1"), count(~gone & hit(3)).alias("hit3"),
        count(gone & F.col("absent")).alias("absent_correct"), count(~gone & F.col("absent")).alias("false_absent"),
    )


def synthetic_vault(spark: SparkSession, n: int = 400, seed: int = 1, now: int = 1_700_000_000) -> tuple[DataFrame, DataFrame]:
    """Items with one fact each that no other has, and a question for every tenth."""
    rng = random.Random(seed)
    syllables = "ba ko ri tun vel dar mis po len gru sha ner".split()
    name = lambda: "".join(rng.choice(syllables) for _ in range(3)).capitalize()
    filler = lambda k: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(k))
    kinds = ("invoice", "letter", "manual", "minutes")
    items, questions = [], []
    for i in range(n):
        kind, who, number = kinds[i % 4], name(), rng.randint(10_000, 99_999)
        fact = f"The {kind} for {who} {i} has the number {number}."
        body = f"{filler(rng.randint(30, 200))}\n\n{fact}\n\n{filler(rng.randint(30, 200))}"
        items.append((i, f"{kind.capitalize()} {who} {i}", "text", None, body, f"synthetic-{i}", now + i, [kind]))
        if i % 10 == 0:
            questions.append((i, f"what is the number of the {kind} for {who} {i}", [i], str(number)))
    schema = "id long, title string, kind string, source string, content string, hash string, added_at long, tags array<string>"
    return spark.createDataFrame(items, schema), spark.createDataFrame(questions, "query_id long, text string, items array<long>, answer string")


__all__ = ["Config", "absent_signal", "embedded", "embedders", "fuse", "json_table", "margin", "rare_hits", "report", "run", "synonyms", "synthetic_vault", "units_of"]
