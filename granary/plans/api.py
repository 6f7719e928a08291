"""A vault: items with their chunks, vectors and index, and the calls an agent makes on it.

Single calls are batches of one. The vault's tables are DataFrames; changes make new ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import chunks as C
from granary.operators import context as X
from granary.operators import grams as R
from granary.operators import index as I
from granary.operators import ingest as G
from granary.operators import nearest as K
from granary.operators import search as S
from granary.plans import models as M
from granary.plans.prompts import prompt
from granary.plans.query import dense_query, expand, match_tokens, parse_filters, split_tags, strip_question
from granary.sources import files

MISSING = "I couldn't find that in your files."


@dataclass
class Vault:
    """Items and what is derived from them. ``make`` makes the embedder in each worker."""

    spark: SparkSession
    items: DataFrame
    make: Callable[[], M.Embedder] = M.HashingEmbedder
    rerank: Callable = M.lexical_reranker
    family: str = "chatml"
    thinking: bool | None = None
    _derived: dict[str, DataFrame | I.Index | R.Grams] = field(default_factory=dict, repr=False)

    def _get(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._derived:
            self._derived[name] = build().persist()
        return self._derived[name]

    @property
    def index(self) -> I.Index:
        if "index" not in self._derived:
            self._derived["index"] = I.of(self.items)
        return self._derived["index"]

    @property
    def vocabulary(self) -> DataFrame:
        return self.index.vocabulary

    @property
    def grams(self) -> R.Grams:
        """Trigrams of the chunks: once they are there, questions look their terms up instead of reading all texts."""
        if "grams" not in self._derived:
            made = R.of(self.chunks)
            self._derived["grams"] = R.Grams(made.postings.persist(), made.counts.persist())
        return self._derived["grams"]

    @property
    def chunks(self) -> DataFrame:
        return self._get("chunks", lambda: C.with_title_units(self.items, C.chunks(self.items)).withColumn("chunk_id", F.xxhash64("item_id", "ord")))

    @property
    def vectors(self) -> DataFrame:
        made = lambda: M.embed_chunks(self.items, self.chunks.drop("chunk_id"), self.make).withColumn("chunk_id", F.xxhash64("item_id", "ord"))
        return self._get("vectors", made)

    def query_vectors(self, texts: dict[int, str]) -> DataFrame:
        asked = self.spark.createDataFrame(sorted(texts.items()), "query_id long, text string")
        return asked.select("query_id", M.embed(F.col("text"), self.make).alias("vec"))

    # ------------------------------------------------------------ search

    def keyword(self, texts: dict[int, str], limit: int) -> DataFrame:
        return S.keyword(self.index, S.phrase_table(self.spark, texts), limit)

    def semantic(self, texts: dict[int, str], limit: int) -> DataFrame:
        return S.semantic_nearest(self.vectors, self.query_vectors(texts), limit)

    def hybrid(self, texts: dict[int, str], limit: int) -> DataFrame:
        parts = S.phrase_table(self.spark, texts)
        hits = S.phrase_hits(self.index.postings, S.typed_forms(parts, self.vocabulary))
        kw = S.top(S.bm25(hits, self.index.totals), 2 * limit)
        n = self.spark.createDataFrame([(q, max(1, len(match_tokens(t)))) for q, t in texts.items()], "query_id long, n_words int")
        return S.fuse(kw, S.coverage(hits, parts, n), self.semantic(texts, 2 * limit), limit)

    def search(self, query: str, limit: int = 40, now: int = 0, strict: bool = True) -> DataFrame:
        """Rows (item_id, title, kind, source, added_at, tags, score, via) of a query with filters and tags.

        With ``strict`` filters choose among the best hits of the words; without it they
        come first. A query of filters alone browses the newest items.
        """
        filters, rest = parse_filters(query, now)
        tags, words = split_tags(rest)
        keep = S.keep(filters) & S.has_tags(tags)
        narrow = tags or not filters.is_empty()
        if not words:
            pool = self.items.orderBy(F.desc("added_at"), F.desc("id")).limit(600 if narrow else limit)
            return pool.where(keep).orderBy(F.desc("added_at"), F.desc("id")).limit(limit).select(F.col("id").alias("item_id"), "title", "kind", "source", "added_at", "tags", F.lit(0.0).alias("score"), F.lit("").alias("via"))
        wide = max(6 * limit, 200) if narrow else limit
        vault = self if strict or not narrow else Vault(self.spark, self.items.where(keep), self.make, self.rerank)
        ranked = vault.hybrid({0: words}, wide).join(self.items.withColumnRenamed("id", "item_id"), "item_id")
        return ranked.where(keep).orderBy("rank").limit(limit).select("item_id", "title", "kind", "source", "added_at", "tags", "score", "via")

    def absent(self, texts: dict[int, str]) -> DataFrame:
        best = S.best_cosine(K.nearest(self.vectors, self.query_vectors(texts), 1))
        return S.absent(self.spark.createDataFrame(sorted(texts.items()), "query_id long, text string"), self.vocabulary, best)

    def live(self, query: str, now: int = 0, limit: int = 40) -> DataFrame:
        """The search of a panel: nothing where the words are absent."""
        _, query = strip_question(query)
        words = split_tags(parse_filters(query, now)[1])[1]
        found = self.search(query, limit, now)
        return found.limit(0) if words and self.absent({0: words}).first().absent else found

    # ------------------------------------------------------------ calls

    def retrieve(self, query: str, limit: int = 8, mode: str = "hybrid", tags: list[str] | str = (), kind: str | None = None) -> list[dict]:
        """Hits with a passage each: the nearest chunk unless the title won, else the words around the hits, else the start of the text."""
        limit = min(max(int(limit), 1), 25)
        wanted = tags.replace(",", " ").split() if isinstance(tags, str) else list(tags)
        wide = 4 * limit if wanted or kind else limit
        ranked = {"hybrid": self.hybrid, "keyword": self.keyword, "semantic": self.semantic}[mode]({0: query}, wide)
        hits = ranked.select("item_id", "rank").join(self.items.withColumnRenamed("id", "item_id"), "item_id").where(S.has_tags([t.lstrip("#").lower() for t in wanted]))
        if kind:
            hits = hits.where(F.col("kind") == kind)
        best = S.best_chunks(K.all_pairs(self.vectors.join(hits.select("item_id"), "item_id", "left_semi"), self.query_vectors({0: query}))).where("ord >= 0")
        best = best.join(self.chunks.select("item_id", "ord", F.col("text").alias("passage")), ["item_id", "ord"]).select("item_id", "passage")
        rows = hits.join(best, "item_id", "left").orderBy("rank").limit(limit)
        whole = S.whole_phrases(S.matched_terms(self.index.postings, S.typed_forms(S.phrase_table(self.spark, {0: query}), self.vocabulary)))
        marked = S.match_snippets(rows.select(F.lit(0).cast("long").alias("query_id"), "item_id"), self.items, whole.where("field = 'c'"))
        met = marked.join(whole.where("field = 'c'").select("item_id").distinct(), "item_id").select("item_id", T.plain_snippet(F.col("snippet")).alias("around"))
        rows = rows.join(met, "item_id", "left").orderBy("rank")
        shown = rows.select(F.col("item_id").alias("id"), "title", "kind", "source", "tags", F.coalesce("passage", "around", T.preview(F.col("content"), 160)).alias("snippet"))
        return [r.asDict() for r in shown.collect()]

    def get(self, item_id: int | str, max_chars: int = 20_000) -> dict | None:
        most = max(int(max_chars), 200)
        r = self.items.where(F.col("id") == int(item_id)).select("id", "title", "kind", "source", "tags", F.substring("content", 1, most).alias("content"), F.length("content").alias("chars")).first()
        return r and r.asDict() | {"truncated": r.chars > most}

    def list_recent(self, limit: int = 20, kind: str | None = None) -> list[dict]:
        limit = min(max(int(limit), 1), 100)
        pool = self.items.orderBy(F.desc("added_at"), F.desc("id")).limit(5 * limit if kind else limit)
        rows = pool.where(F.col("kind") == kind if kind else F.lit(True)).orderBy(F.desc("added_at"), F.desc("id")).limit(limit)
        return [r.asDict() for r in rows.select("id", "title", "kind", "source", "tags", T.preview(F.col("content"), 120).alias("snippet")).collect()]

    def put(self, text: str, now: int, title: str | None = None, tags: str = "", kind: str = "note") -> tuple[Vault, str]:
        """The vault with a text in it, and what happened: added, updated or duplicate."""
        new = self.spark.createDataFrame([(text, title, tags)], "content string, title string, tag_text string")
        row = new.select(
            F.lit(0).cast("long").alias("id"), F.coalesce("title", T.note_title(F.col("content"), F.lit(now))).alias("title"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("source"),
            "content", T.item_hash(F.lit(kind), F.lit(None).cast("string"), F.col("content")).alias("hash"), F.lit(now).cast("long").alias("added_at"), T.tag_set(F.col("tag_text")).alias("tags"),
        )
        done = G.actions(row.withColumn("error", F.lit(None).cast("string")).select("id", "hash", "content", "error"), self.items.select("id", "hash", "content")).first().action
        top = self.items.agg(F.max("id")).first()[0] or 0
        return Vault(self.spark, G.merge(row.withColumn("id", F.lit(top + 1).cast("long")), self.items), self.make, self.rerank), done

    def add(self, now: int, text: str | None = None, path: str | None = None, url: str | None = None, title: str | None = None, tags: str = "", fetch: files.Fetch | None = None, readers: dict[str, files.Reader] | None = None) -> tuple[Vault, dict]:
        """The vault with a text, a file or a page in it, and what happened.

        ``fetch`` reads addresses; a bare address as text is fetched too. What cannot be read
        is an error with the name and message that a list of failures shows.
        """
        if url or (text and fetch and self.spark.range(1).select(T.is_bare_url(F.lit(text))).first()[0]):
            if fetch is None:
                raise ValueError("nothing reads addresses here")
            page = files.fetched(self.spark.createDataFrame([((url or text).strip(),)], "url string"), fetch).first()
            if page.error is None:
                row = (page.title, "web", page.address, page.content, hashlib.sha256(page.address.encode()).hexdigest())
            elif url:
                return self, {"action": "failed", "title": page.url, "error": page.error}
            else:
                url = None
                row = None
        else:
            row = None
        if row is None and path:
            where = self.spark.range(1).select(T.windows_path(F.lit(path))).first()[0]
            found = files.extract(self.spark.read.format("binaryFile").load(path if where == path else where), readers).first()
            if found.error is not None:
                said = self.spark.range(1).select(T.failure_title(F.lit(path), F.lit(found.error)).alias("title"))
                said = said.select("title", T.strip_title(F.lit(found.error), F.col("title")).alias("error")).first()
                return self, {"action": "failed", "title": said.title, "error": said.error}
            row = (found.title, found.kind, path, found.content, found.bytes_hash)
        if row is None:
            if not (text or "").strip():
                raise ValueError("give a text, a path or an address")
            row = (self.spark.range(1).select(T.text_title(F.lit(text))).first()[0], "text", None, text, None)
        made = self.spark.createDataFrame([(title or row[0], *row[1:], tags)], "title string, kind string, source string, content string, bytes_hash string, tag_text string")
        made = made.select(F.lit(0).cast("long").alias("id"), "title", "kind", "source", "content", T.item_hash(F.col("kind"), F.col("source"), F.col("content"), F.col("bytes_hash")).alias("hash"), F.lit(now).cast("long").alias("added_at"), T.tag_set(F.col("tag_text")).alias("tags"))
        done = G.actions(made.withColumn("error", F.lit(None).cast("string")).select("id", "hash", "content", "error"), self.items.select("id", "hash", "content")).first().action
        top = self.items.agg(F.max("id")).first()[0] or 0
        merged = G.merge(made.withColumn("id", F.lit(top + 1).cast("long")), self.items)
        return Vault(self.spark, merged, self.make, self.rerank), {"action": done, "title": title or row[0], "kind": row[1], "words": len(row[3].split())}

    def forget(self, item_id: int | str) -> Vault:
        gone = self.spark.createDataFrame([(int(item_id),)], "id long")
        return Vault(self.spark, G.delete(self.items, gone, "id"), self.make, self.rerank)

    def resources(self) -> list[dict]:
        """The newest items as resources, each with what its kind and opening say."""
        return [{"uri": f"item:{r['id']}", "name": r["title"], "description": f"{r['kind']} · {r['snippet'][:80]}", "mimeType": "text/plain"} for r in self.list_recent(100)]

    def templates(self) -> list[dict]:
        return [{"uriTemplate": "item:{id}", "name": "An item by its number", "mimeType": "text/plain"}]

    def read_resource(self, uri: str) -> str | None:
        """The text behind a resource's address."""
        found = re.fullmatch(r"item:(\d+)", uri)
        row = found and self.items.where(F.col("id") == int(found[1])).select("content").first()
        return row.content if row else None

    # ------------------------------------------------------------ answers

    def gather(self, question: str, budget: int = X.BUDGET, cores: int = 8) -> list[tuple[str, str]]:
        """Excerpts (title, text) for a question, its top item first; none where it is absent."""
        asked = self.spark.createDataFrame([(0, question, "")], "query_id long, text string, aux string")
        known = {r.synonym for r in X.expansions(asked, self.vocabulary).collect()}
        words = [w for w in re.split(r"[\W_]+", question.lower()) if w]
        text = dense_query(question, expand(words, known))
        if self.absent({0: question}).first().absent:
            return []
        terms = X.distinctive_terms(asked, self.vocabulary, self.items.count())
        cut = self.chunks.select("item_id", "ord", "text")
        cands = X.candidates(self.vectors, self.query_vectors({0: text}), cut, terms, X.digit_pins(asked, self.index.postings), index=self._derived.get("grams"))
        top = X.rerank_top(X.rerank_texts(X.rerank_head(cands, M.head_size(cores)), self.items), self.rerank, asked)
        return [(r.title, r.text) for r in X.blocks(cands, cut, self.items, top, budget).orderBy("place").collect()]

    def ask(self, question: str, generate: Callable[[str], str] | None = None) -> tuple[str, list[str]]:
        """An answer and the titles behind it. Without a generator the answer is the excerpts."""
        sources = self.gather(question)
        if not sources:
            return MISSING, []
        titles = list(dict.fromkeys(t for t, _ in sources))
        said = "\n\n".join(t for _, t in sources) if generate is None else generate(prompt(question, sources, family=self.family, thinking=self.thinking))
        return said, titles

    def ask_about(self, item_id: int, question: str, generate: Callable[[str], str] | None = None, most: int = X.BUDGET) -> tuple[str, str]:
        """An answer from one item alone, of which a model sees the first ``most`` words, and its title."""
        cut = F.when(F.size(T.words(F.col("content"))) > most, F.array_join(F.slice(T.words(F.col("content")), 1, most), " ")).otherwise(F.col("content"))
        row = self.items.where(F.col("id") == int(item_id)).select("title", cut.alias("text")).first()
        if row is None:
            return MISSING, ""
        return (row.text if generate is None else generate(prompt(question, [(row.title, row.text)], family=self.family, thinking=self.thinking)), row.title)

    def trace(self, question: str, path: str) -> None:
        """Writes the context of a question, as an answer would see it."""
        rows = [(k, title, text) for k, (title, text) in enumerate(self.gather(question), 1)]
        self.spark.createDataFrame(rows, "place int, title string, text string").coalesce(1).write.mode("overwrite").json(path)

    def self_check(self, questions: list[tuple[str, list[str]]]) -> list[bool]:
        """Whether an expected text is in each answer, whatever its case."""
        return [any(e.lower() in self.ask(q)[0].lower() for e in expected) for q, expected in questions]



#: Facts of unique names, with questions whose answer holds one of the words given.
SANITY = (
    ("Marlowe ledger", "Ledger of Marlowe and Finch. Invoice MF-2210 over 318.40 EUR was settled on 9 May.", "How much was invoice MF-2210?", ("318.40",)),
    ("Tessaly lighthouse log", "The Tessaly lighthouse was relit in 1931 by its keeper, Orla Venn.", "Who relit the Tessaly lighthouse?", ("Orla Venn", "Venn")),
    ("Quillon oven card", "Quillon bread: 700 g of rye flour. Bake at 235 C for thirty minutes.", "At how many degrees is Quillon bread baked?", ("235",)),
)


def sanity_vault(spark: SparkSession, now: int = 0) -> tuple[Vault, list[tuple[str, list[str]]]]:
    """A small vault of made-up facts, and questions with what their answers hold."""
    rows = [(i, title, "text", None, text, f"sanity-{i}", now, []) for i, (title, text, _, _) in enumerate(SANITY)]
    items = spark.createDataFrame(rows, "id long, title string, kind string, source string, content string, hash string, added_at long, tags array<string>")
    return Vault(spark, items), [(q, list(expected)) for _, _, q, expected in SANITY]


def load_questions(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """Questions with expected words from a JSON file [{"q": ..., "expect": [...]}]; those without either are passed over."""
    rows = spark.read.schema("q string, expect array<string>").option("multiLine", "true").json(path)
    return [(r.q, r.expect) for r in rows.where("trim(q) <> '' and size(expect) > 0").collect()]


def summary(passed: list[bool], source: str, seconds: float, mode: str = "retrieval only") -> str:
    """A line about a self-check."""
    return f"Self-check: {sum(passed)}/{len(passed)} — {source} ({mode}, {seconds:.1f}s)" if passed else f"Self-check couldn't run: {source}"
