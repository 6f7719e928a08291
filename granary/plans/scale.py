"""Vaults of planted facts, of any size: items made in tasks, questions with one right item each, and what search makes of them.

Each item tells four facts about a name that no other item has. All follows from the
item's id and a salt, so an item is the same however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SYLLABLES = "ba ko ri tun vel dar mis po len gru sha ner".split()
FIRST, LAST = "Ana Bo Cem Dov Eda Finn Gil Hana Ivo Jun".split(), "Abelin Borsk Castell Drummel Ekman Farquist Gorlan Hesket Immer Jonsdal Kirwan".split()
OFFICES = "Aarhus Bergen Cadiz Dover Essen Funchal Ghent Hobart Izmir".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday".split()
KINDS = ("note", "text", "file", "web")
FORMS = "brief report log memo ledger".split()
#: Lengths in words, and how many of ten items have them: a few lines, a page, a long text.
BANDS = ((4, 30, 30), (4, 150, 399), (2, 900, 1799))
PARAGRAPH = 70
SHAPES = ("code", "leader", "office", "budget")
ITEM = ("id", "title", "kind", "source", "content", "hash", "added_at", "tags")


def drawn(key: Column, salt: str, n: int) -> Column:
    """A number under ``n`` that follows from a key."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(n))


def pick(words: list[str] | tuple[str, ...], key: Column, salt: str) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (drawn(key, salt, len(words)) + 1).cast("int"))


def name(key: Column) -> Column:
    """A word of six syllables for each id under 12^6, which no other has, and the id itself behind it."""
    n = len(SYLLABLES)
    mixed = F.pmod(key * 5003 + 77, F.lit(n**6))
    parts = [F.element_at(F.array(*[F.lit(s) for s in SYLLABLES]), (F.floor(mixed / n**k) % n + 1).cast("int")) for k in range(6)]
    return F.concat(F.initcap(F.concat(*parts)), F.lit("-"), (key + 100).cast("string"))


def facts(key: Column, salt: str = "") -> Column:
    """What an item tells: (name, title, code, leader, office, budget, day)."""
    said = {
        "name": name(key),
        "title": F.concat(name(key), F.lit(" "), pick(FORMS, key, salt + "form")),
        "code": (drawn(key, salt + "code", 9000) + 1000).cast("string"),
        "leader": F.concat(pick(FIRST, key, salt + "first"), F.lit(" "), pick(LAST, key, salt + "last")),
        "office": pick(OFFICES, key, salt + "office"),
        "budget": (drawn(key, salt + "budget", 9000) + 100).cast("string"),
        "day": pick(DAYS, key, salt + "day"),
    }
    return F.struct(*[c.alias(k) for k, c in said.items()])


def told(f: Column) -> Column:
    """The facts as three lines."""
    return F.concat(
        F.lit("The head of "), f["name"], F.lit(" is "), f["leader"], F.lit(", who works at the office in "), f["office"], F.lit(".\nThe access code of "), f["name"], F.lit(" is "), f["code"],
        F.lit(" and its approved budget is "), f["budget"], F.lit(" EUR.\nMeetings about "), f["name"], F.lit(" are held on each "), f["day"], F.lit("."),
    )


def asked(f: Column, shape: Column) -> Column:
    """A question of one of four shapes."""
    texts = {"code": ("What is the access code of ", "?"), "leader": ("Who is the head of ", "?"), "office": ("At which office is ", " run?"), "budget": ("How large is the approved budget of ", "?")}
    return F.coalesce(*[F.when(shape == i, F.concat(F.lit(texts[s][0]), f["name"], F.lit(texts[s][1]))) for i, s in enumerate(SHAPES)])


def filler(key: Column, words: Column, salt: str) -> Column:
    """So many made-up words, in paragraphs."""
    syllables = F.array(*[F.lit(s) for s in SYLLABLES])
    at = lambda k, j: F.element_at(syllables, (F.pmod(F.xxhash64(key, k, F.lit(salt + j)), F.lit(len(SYLLABLES))) + 1).cast("int"))
    some = F.when(words > 0, F.transform(F.sequence(F.lit(1), words), lambda k: F.concat(at(k, "a"), at(k, "b")))).otherwise(F.array().cast("array<string>"))
    starts = F.sequence(F.lit(1), F.greatest(words, F.lit(1)), F.lit(PARAGRAPH))
    return F.array_join(F.transform(starts, lambda s: F.array_join(F.slice(some, s, PARAGRAPH), " ")), "\n\n")


def length(key: Column, salt: str) -> Column:
    """An item's words by its band."""
    band, upto, out = F.pmod(key, F.lit(10)), 0, None
    for tenths, least, most in BANDS:
        upto += tenths
        words = drawn(key, salt + "length", most - least + 1) + least
        out = F.when(band < upto, words) if out is None else out.when(band < upto, words)
    return out.cast("int")


def vault(spark: SparkSession, n: int, salt: str = "", now: int = 1_700_000_000) -> DataFrame:
    """Items of ids 0 to ``n`` - 1, with their facts between two parts of filler, and their facts (``facts``)."""
    key = F.col("id")
    i = spark.range(n).withColumns({"facts": facts(key, salt), "words": length(key, salt), "kind": pick(KINDS, key, salt + "kind")})
    first = (F.col("words") / 2).cast("int")
    body = F.concat_ws("\n\n", filler(key, first, salt + "before"), told(F.col("facts")), filler(key, F.col("words") - first, salt + "after"))
    made = {"title": F.col("facts.title"), "source": F.lit(None).cast("string"), "content": body, "hash": F.sha2(F.concat(F.lit(salt + "/scale/"), "id"), 256), "added_at": F.lit(now) + key, "tags": F.array(F.lit("scale"), F.col("kind"))}
    return i.withColumns(made).select(*ITEM, "facts")


def planted(items: DataFrame, salt: str = "") -> DataFrame:
    """Items with facts of their own written below their texts, and with those facts' titles."""
    made = items.withColumn("facts", facts(F.col("id"), salt))
    return made.withColumns({"title": F.col("facts.title"), "content": F.concat("content", F.lit("\n\n"), told(F.col("facts")))}).select(*ITEM, "facts")


def questions(some: DataFrame) -> DataFrame:
    """Four questions about each item of a vault: (query_id, text, items, title, answer, shape)."""
    shape = F.col("shape")
    q = some.select("id", "facts", F.explode(F.array(*[F.lit(i) for i in range(len(SHAPES))])).alias("shape"))
    answer = F.coalesce(*[F.when(shape == i, F.col(f"facts.{s}")) for i, s in enumerate(SHAPES)])
    return q.select((F.col("id") * len(SHAPES) + shape).alias("query_id"), asked(F.col("facts"), shape).alias("text"), F.array("id").alias("items"), F.col("facts.title").alias("title"), answer.alias("answer"), "shape")


def one_each(asked_all: DataFrame) -> DataFrame:
    """One question of each item's four, the shapes in turn by id."""
    return asked_all.where(F.pmod(F.floor(F.col("query_id") / len(SHAPES)), F.lit(len(SHAPES))) == F.col("shape"))


def rates(ranked: DataFrame, expected: DataFrame, items: DataFrame) -> DataFrame:
    """One row (questions, hit1, hit3, answered): how often an item of the expected title is first, or among three, and how often the first holds the answer."""
    met = ranked.where(F.col("rank") < 3).join(items.select(F.col("id").alias("item_id"), F.col("title").alias("found"), "content"), "item_id")
    met = met.select("query_id", "rank", "found", "content")
    best = expected.join(met, "query_id", "left").groupBy("query_id").agg(
        F.min(F.when(F.col("found") == F.col("title"), F.col("rank"))).alias("at"), F.max(F.when(F.col("rank") == 0, F.contains("content", F.col("answer")))).alias("answered")
    )
    return best.agg(F.count("*").alias("questions"), F.count_if(F.col("at") == 0).alias("hit1"), F.count_if(F.col("at") < 3).alias("hit3"), F.count_if(F.coalesce("answered", F.lit(False))).alias("answered"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON file [{"q", "expect_title", "expect", "expect_ids", "expect_pattern"}]: (query_id, text, title, answers, ids, pattern). Those without a text are passed over."""
    rows = spark.read.schema("q string, expect_title string, expect array<string>, expect_ids array<bigint>, expect_pattern string").option("multiLine", "true").json(path)
    named = rows.select(F.col("q").alias("text"), F.col("expect_title").alias("title"), F.coalesce("expect", F.array().cast("array<string>")).alias("answers"), F.coalesce("expect_ids", F.array().cast("array<bigint>")).alias("ids"), F.col("expect_pattern").alias("pattern"))
    return named.where("trim(text) <> ''").select(F.xxhash64("text", "title").alias("query_id"), "*")


def read_items(spark: SparkSession, path: str, now: int = 0) -> DataFrame:
    """Items of a JSON file [{"title", "kind", "text", "tags"}]; ids go from 0 by title and text."""
    from pyspark.sql import Window

    rows = spark.read.schema("title string, kind string, text string, tags array<string>").option("multiLine", "true").json(path)
    i = rows.withColumn("id", F.row_number().over(Window.orderBy("title", "text")).cast("long") - 1)
    content = F.coalesce("text", F.lit(""))
    return i.select("id", "title", F.coalesce("kind", F.lit("text")).alias("kind"), F.lit(None).cast("string").alias("source"), content.alias("content"), F.sha2(F.concat_ws("\0", "kind", "title", content), 256).alias("hash"), (F.lit(now) + F.col("id")).alias("added_at"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def expected_items(asked_of: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (query_id, items) for read questions: the ids that they name, of items of the title, and of items whose text meets the pattern; none where the question has no answer.

    Questions are what a person wrote, so there are few patterns, and each text is held against all of them.
    """
    i = items.select("id", F.col("title").alias("own"), "content")
    by_title = asked_of.where("title is not null").join(i, F.col("own") == F.col("title")).select("query_id", "id")
    by_pattern = i.join(asked_of.where("pattern is not null").select("query_id", "pattern"), F.expr("content rlike pattern")).select("query_id", "id")
    named = asked_of.select("query_id", F.explode("ids").alias("id"))
    met = named.unionByName(by_title).unionByName(by_pattern).groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("items"))
    return asked_of.select("query_id").join(met, "query_id", "left").select("query_id", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def absent_report(questions: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows (query_id, question, words, best_cosine, absent): what the gate decides for each question, and on what grounds. ``judged`` is what ``Vault.absent`` gives."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return questions.join(judged, "query_id").select("query_id", F.col("text").alias("question"), words.alias("words"), "n_terms", "n_present", "best_cosine", "absent")


def refused(report: DataFrame) -> DataFrame:
    """One row (questions, refused)."""
    return report.agg(F.count("*").alias("questions"), F.count_if("absent").alias("refused"))
