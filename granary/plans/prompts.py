"""Prompts for a generator, as text and as columns, and where a generator's text runs in circles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import TIME_WORDS, asks_for_time

#: The marks of chats by family. Where a family has no system part, the instructions stand before what the user says.
FAMILIES = {
    "chatml": "<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n{user}<|im_end|>\n<|im_start|>assistant\n",
    "llama3": "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n{system}<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n{user}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
    "phi": "<|system|>{system}<|end|><|user|>{user}<|end|><|assistant|>",
    "gemma": "<bos><start_of_turn>user\n{system}\n\n{user}<end_of_turn>\n<start_of_turn>model\n",
}
#: What opens an answer of models that can think, by whether they shall; and what opens one by dates.
THINKING = {None: "", False: "<think>\n\n</think>\n\n", True: "<think>\n"}
TIMELINE = "Timeline:\n"

ROLE = "You answer questions about a person's own files from the excerpts given, without naming excerpts or their numbers. "
MISSED = "Where no excerpt has the answer, say only: I couldn't find that in your files."
DIRECT = ROLE + "Answer in one or two sentences, with names, numbers and dates as they are written. Name files by their exact titles. Bars part the columns of tables, and a label's value stands below it. " + MISSED
BY_TIME = ROLE + "The question is about order or time: list what matters with its dates under 'Timeline:', the newest first, then write a line that begins with 'Answer:' and follows from the list. " + MISSED


SPACES = r"^[\t-\r\x{85}\p{Z}]+|[\t-\r\x{85}\p{Z}]+$"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, "")


def _filled(family: str, system: Column, user: Column) -> Column:
    """A family's marks around a system text and a user's; what these hold is never taken for a mark's place."""
    before, rest = FAMILIES[family].split("{system}")
    between, after = rest.split("{user}")
    return F.concat(F.lit(before), system, F.lit(between), user, F.lit(after))


def prompts(questions: DataFrame, sources: DataFrame, family: str = "chatml", thinking: bool | None = None) -> DataFrame:
    """Rows (query_id, temporal, prompt) for questions (query_id, text) and what answers them (query_id, place, title, text).

    Excerpts are numbered from 1 by their place, and equal places by title and text. A question about order or
    time asks for a timeline and opens it, unless the model thinks: ``thinking`` is None for models that cannot.
    Null titles and texts are empty; a question without sources has no excerpts.
    """
    told = sources.select("query_id", F.struct("place", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")).alias("s"))
    told = told.groupBy("query_id").agg(F.collect_list("s").alias("told"))
    return chats(questions.join(told, "query_id", "left"), [(family, thinking)]).drop("family")


def chats(questions: DataFrame, kinds: list[tuple[str, bool | None]]) -> DataFrame:
    """Rows (query_id, family, temporal, prompt), one for each of ``kinds`` (family, thinking), of questions (query_id, text, told), ``told`` an array of (place, title, text) without nulls, or null."""
    shown = F.array_join(F.transform(F.sort_array("told"), lambda s, i: F.concat(F.lit("Excerpt "), i + 1, F.lit(" (from "), s["title"], F.lit("):\n"), _trimmed(s["text"]), F.lit("\n\n"))), "")
    user = F.concat(F.coalesce(shown, F.lit("")), F.lit("Question: "), _trimmed(F.coalesce("text", F.lit(""))))
    asked = questions.select("query_id", user.alias("user"), asks_for_time(F.col("text")).alias("asks"))

    def one(family: str, thinking: bool | None) -> Column:
        by_time = F.col("asks") & F.lit(thinking is not True)
        made = _filled(family, F.when(by_time, F.lit(BY_TIME)).otherwise(F.lit(DIRECT)), F.col("user"))
        return F.struct(F.lit(family).alias("family"), by_time.alias("temporal"), F.concat(made, F.lit(THINKING[thinking]), F.when(by_time, F.lit(TIMELINE)).otherwise(F.lit(""))).alias("prompt"))

    return asked.select("query_id", F.inline(F.array(*[one(*k) for k in kinds])))


#: Turns whose excerpts are gathered together.
TURNS = 64


def after_turns(turns: DataFrame, before: int = 3) -> DataFrame:
    """Questions (query_id, text, told) of users' turns (query_id, role, text), with the turns of the ``before`` numbers ahead of each as excerpts.

    Turns are shuffled once, dealt by runs of numbers; the last of a run are in the next one too. Of questions of
    one number each is told what all of them are, as a join would.
    """
    run = F.floor(F.col("query_id") / TURNS)
    own = turns.select(run.alias("run"), "query_id", "role", "text", F.lit(True).alias("own"))
    ahead = turns.where(F.floor((F.col("query_id") + before) / TURNS) > run).select((run + 1).alias("run"), "query_id", "role", "text", F.lit(False).alias("own"))
    by = Window.partitionBy("run").orderBy("query_id")
    excerpt = F.struct(F.col("query_id").alias("place"), F.coalesce("role", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    told = F.collect_list(excerpt).over(by.rangeBetween(-before, -1))
    alike = F.count_if(F.col("own") & (F.col("role") == "user")).over(by.rangeBetween(0, 0))
    met = own.unionByName(ahead).withColumns({"told": told, "alike": alike}).where("own and role = 'user'")
    each = F.when(F.col("alike") > 1, F.flatten(F.array_repeat("told", F.col("alike").cast("int")))).otherwise(F.col("told"))
    return met.select("query_id", "text", F.when(F.col("query_id").isNotNull(), each).alias("told"))


def prompt(question: str, sources: list[tuple[str, str]], system: str | None = None, family: str = "chatml", thinking: bool | None = None) -> str:
    """The prompt of one question and its (title, text) sources; ``system`` stands in for the instructions of the kind of question."""
    words = set(re.split(r"[\W_]+", question.lower()))
    by_time = system is None and thinking is not True and not words.isdisjoint(TIME_WORDS)
    shown = "".join(f"Excerpt {i} (from {title}):\n{text.strip()}\n\n" for i, (title, text) in enumerate(sources, 1))
    user = f"{shown}Question: {question.strip()}"
    made = user.join(_parts(family, system if system is not None else BY_TIME if by_time else DIRECT))
    return made + THINKING[thinking] + (TIMELINE if by_time else "")


def _parts(family: str, system: str) -> list[str]:
    """What stands before and after a user's text."""
    before, rest = FAMILIES[family].split("{system}")
    between, after = rest.split("{user}")
    return [before + system + between, after]


LEAST_LINE = 12


def without_loops(texts: DataFrame) -> DataFrame:
    """Texts (id, text) cut before the first line that was there already: (id, place, text), ``place`` that line's number from 0 or null.

    Lines are compared without the spaces around them; those of at most 12 bytes, and one that no line
    break has ended, are never cut at. Ids are unique; null texts stay null. Lines are grouped by id and
    digest, so that long texts are spread over tasks.
    """
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("place", "line"), F.size(F.split("text", "\n")).alias("n"))
    lines = lines.where(F.col("place") < F.col("n") - 1).select("id", "place", _trimmed(F.col("line")).alias("line"))
    long = lines.where(F.octet_length("line") > LEAST_LINE).select("id", "place", F.sha2("line", 256).alias("line"))
    again = long.withColumn("nth", F.row_number().over(Window.partitionBy("id", "line").orderBy("place"))).where("nth = 2")
    first = again.groupBy("id").agg(F.min("place").alias("place"))
    kept = F.when(F.col("place").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.slice(F.split("text", "\n"), F.lit(1), F.col("place")), "\n"), F.lit("\n")))
    return texts.select("id", "text").join(first, "id", "left").select("id", "place", kept.alias("text"))
