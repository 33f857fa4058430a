"""Normalisation and Markdown table rules, against goldens and a plain spec."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import text as X


def spec_normalize(raw: str) -> str:
    """The rules read one by one, a character at a time."""
    lines: list[list[str]] = [[]]
    previous = ""
    for char in unicodedata.normalize("NFKC", raw):
        if char == "\n" and previous == "\r":
            pass
        elif char in "\r\n":
            lines.append([])
        elif char not in " \t\f\v":
            lines[-1].append(char)
        elif lines[-1][-1:] != [" "]:
            lines[-1].append(" ")
        previous = char
    out: list[str] = []
    for characters in lines:
        line = "".join(characters).strip()
        rule = len(line) > 1 and line[0] in "-|:=" and all(c in "-|:=" or c.isspace() for c in line)
        if not rule and (line or out[-1:] != [""] or out[-2:-1] == []):
            out.append(line)
    while out and not out[0]:
        out.pop(0)
    while out and not out[-1]:
        out.pop()
    return "\n".join(out).strip()


@pytest.mark.parametrize(
    "raw, expected",
    [
        # Runs of tabs and blanks shrink, line ends are one kind, outer blanks go.
        ("north \t wind\r  blows\r\n\tcold  ", "north wind\nblows\ncold"),
        # Three line ends and more leave one empty line.
        ("dawn\n\n\n\n\ndusk", "dawn\n\ndusk"),
        # Lines of rule characters alone go, wherever they stand.
        ("top\n:==:|--:\nrest", "top\nrest"),
        ("= = =\nonly this", "only this"),
        ("red\n\n|:-:|\n\n\nblue", "red\n\nblue"),
        # One such character, or others beside it, is text.
        ("=", "="),
        ("x = y | z", "x = y | z"),
        (":- )", ":- )"),
        (" \t\r\n \n", ""),
        # Compatibility characters become plain ones.
        ("Ｔｅａ ½ ㎏", "Tea 1⁄2 kg"),
    ],
)
def test_normalize_goldens(evaluate, raw, expected):
    assert evaluate(X.normalize_text, [raw]) == [expected]


ALPHABET = "ab.-|:= \t\n\r\f\x0b\x1c\x1f\x85\xa0    　ﬁ́e"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(ALPHABET, max_size=40), min_size=200, max_size=200))
def test_normalize_matches_spec(evaluate, texts):
    assert evaluate(X.normalize_text, texts) == [spec_normalize(t) for t in texts]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn", "Co"]), max_size=20), min_size=100, max_size=100))
def test_nfkc_matches_python(evaluate, texts):
    assert evaluate(X.nfkc, texts) == [unicodedata.normalize("NFKC", t) for t in texts]


def test_nulls_stay_null(evaluate):
    assert evaluate(X.normalize_text, [None]) == [None]


def test_sentence_spacing(evaluate):
    texts = ["Rain fell.\nSnow came", "one\n\ntwo", "s\nt\nu", "\nlate", "alone"]
    expected = [re.sub(r"(?<!\n)\n(?!\n)", ".\n\n", t) for t in texts]
    assert evaluate(X.sentence_spacing, texts) == expected
    assert expected[0] == "Rain fell..\n\nSnow came"


def test_final_text(evaluate):
    assert evaluate(X.final_text, ["the  quick\tfox\njumped\n\n\nfar"]) == ["the quick fox.\n\njumped\n\nfar"]


def test_split_sections(evaluate):
    raw = "intro\n## Rivers\nlong\n##### not one\n# Lakes"
    assert evaluate(X.split_sections, [raw]) == [["intro", "Rivers\nlong\n##### not one", "Lakes"]]


TABLES = [
    # Every row becomes its own group of "column: value" lines.
    (
        "| Planet | Moons |\n|:-------|------:|\n| Mars | 2 |\n| Venus | 0 |\n| Saturn | 146 |",
        "Planet: Mars\nMoons: 2\n\nPlanet: Venus\nMoons: 0\n\nPlanet: Saturn\nMoons: 146",
    ),
    # Inline marks in headings and cells go.
    ("| *Tree* | `Kind` |\n|---|---|\n| **oak** | [leafy](http://t.ree) |", "Tree: oak\nKind: leafy"),
    # No table, no change.
    ("A plain line\n\nand a | lonely bar", "A plain line\n\nand a | lonely bar"),
    # What stands before keeps its distance, what comes after follows at once.
    ("Seen:\n\n| Bird |\n|------|\n| wren |\n\nDone.", "Seen:\n\nBird: wren\nDone."),
    # A rule or a heading alone is no table.
    ("|===|", "|===|"),
    ("| Bird |\n|------|\n", "| Bird |\n|------|\n"),
    # Cells beyond the headings are numbered; a heading needs no rule below it.
    ("|size|\n|9|8|7|\n\n-\n|hue|\n|red|", "size: 9\ncol_1: 8\ncol_2: 7\n-\nhue: red"),
]


@pytest.mark.parametrize("raw, expected", TABLES)
def test_markdown_tables(evaluate, raw, expected):
    assert evaluate(X.linearize_markdown_tables, [raw]) == [expected]


def test_long_markdown_table(evaluate):
    rows = 20_000
    raw = "| k |\n|---|\n" + "| v |\n" * rows
    assert evaluate(X.linearize_markdown_tables, [raw]) == ["\n\n".join(["k: v"] * rows)]


def test_strip_markdown_inline(evaluate):
    raw = "***Loud*** and *soft*, `code` with [a link](http://x.y), plain"
    assert evaluate(X.strip_markdown_inline, [raw]) == ["Loud and soft, code with a link, plain"]


def test_normalisation_stays_in_the_jvm(spark):
    df = spark.range(1).select(X.final_text(F.col("id").cast("string")).alias("t"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
