"""Prompts as text and as columns, and texts that run in circles."""

from __future__ import annotations

import random

import pytest

from granary.plans import prompts as P

SOURCES = [("a {user}", " one \n"), ("b", "{system} two")]


@pytest.mark.parametrize(("family", "thinking"), [("chatml", None), ("chatml", False), ("llama3", None), ("phi", None), ("gemma", True)])
def test_text_and_columns_agree(spark, family, thinking):
    texts = {1: "Which invoice came LAST? ", 2: "who wrote it", 3: "lastly {user}", 4: "", 5: None}
    rows = [(1, k, *s) for k, s in enumerate(SOURCES)] + [(2, 1, "b", "{system} two"), (2, 0, "a {user}", " one \n"), (4, 0, None, None)]
    asked = spark.createDataFrame(list(texts.items()), "query_id long, text string")
    got = {r.query_id: r for r in P.prompts(asked, spark.createDataFrame(rows, "query_id long, place int, title string, text string"), family, thinking).collect()}
    shown = {1: SOURCES, 2: SOURCES, 3: [], 4: [("", "")], 5: []}
    for q, text in texts.items():
        assert got[q].prompt == P.prompt(text or "", shown[q], family=family, thinking=thinking)
        assert got[q].temporal == (q == 1 and thinking is not True)
    assert got[1].prompt.endswith(P.THINKING[thinking] + (P.TIMELINE if thinking is not True else ""))
    assert "Excerpt 1 (from a {user}):\none\n\nExcerpt 2 (from b):\n{system} two\n\nQuestion: who wrote it" in got[2].prompt
    assert P.prompt("when", [], "Be brief.") == P.prompt("what", [], "Be brief.").replace("what", "when")


def cut(text):
    """The text line by line, until a line comes again."""
    seen, out = set(), ""
    for line in text.split("\n")[:-1]:
        said = line.strip()
        if len(said.encode()) > 12:
            if said in seen:
                return out
            seen.add(said)
        out += line + "\n"
    return text


def test_loops_are_cut(spark):
    rng = random.Random(3)
    lines = ["a line of some length", " a line of some length\t", "short", "short", "", "é" * 6, "é" * 7, "another long enough line"]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(0, 9))) for _ in range(60)] + ["", "\n", "a line of some length\na line of some length", "x" * 50_000 + "\n" + "x" * 50_000 + "\n", "thirteen bytes\n" * 5_000]
    rows = [*enumerate(texts), (900, None)]
    got = {r.id: r for r in P.without_loops(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert {i: r.text for i, r in got.items()} == {i: None if t is None else cut(t) for i, t in rows}
    assert got[len(texts) - 1].place == 1 and got[900].place is None
    assert P.without_loops(spark.createDataFrame([], "id long, text string")).count() == 0
