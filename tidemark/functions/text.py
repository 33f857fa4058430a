r"""Text normalisation as Column expressions.

Everything here stays in the JVM. The line-oriented rules are expressed over the
whole text instead of a split / transform / join over an array of lines, and
byte-wise functions (``replace``, ``trim``, ``contains``) come first: a regular
expression runs only over texts that need it, and starts with a test that fails
fast on ordinary characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character str.isspace() accepts, as the body of a Java
# character class (whose own \s is ASCII-only) and as a plain string.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
# What is left of them inside a line after NFKC, apart from the plain blank.
_RARE = r"\x1c-\x1f\x85\u1680\u2028\u2029"
_RARE_CHARS = "\x1c\x1d\x1e\x1f\x85\u1680\u2028\u2029"
_RULE_CHARS = "-|:="


def strip(c: Column) -> Column:
    """Unicode-aware strip of both ends (plain ``trim`` only knows U+0020)."""
    return F.trim(c, F.lit(_SPACES))


def nfkc(c: Column) -> Column:
    """Unicode NFKC through the ICU library that ships with Spark.

    ``reflect`` calls the static ``Normalizer.compose(text, compatibility)``,
    so no row leaves the JVM. NULL stays NULL.
    """
    composed = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True)
    )
    return F.when(c.isNotNull(), composed)


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def unify_newlines(c: Column) -> Column:
    return _replace(_replace(c, "\r\n", "\n"), "\r", "\n")


def _contains_any(c: Column, *texts: str) -> Column:
    found = c.contains(texts[0])
    for text in texts[1:]:
        found = found | c.contains(text)
    return found


def normalization_steps() -> list:
    r"""Normalisation after NFKC, one function of Column per step.

    1. CRLF / CR become LF.
    2. Runs of blank characters become one space.
    3. Every line is stripped.
    4. Lines of two or more ``- | : =`` characters and spaces are removed with
       their line feed, so the blank lines around them still merge.
    5. Three or more line feeds become two; the whole text is stripped.
    """

    def single_blanks(c: Column) -> Column:
        squeezed = F.regexp_replace(c, r"[\t\f\x0B][ \t\f\x0B]*| [ \t\f\x0B]+", " ")
        return F.when(_contains_any(c, "  ", "\t", "\f", "\x0b"), squeezed).otherwise(c)

    def stripped_lines(c: Column) -> Column:
        edges = F.regexp_replace(c, rf"[ {_RARE}]+\n[ {_RARE}]*|\n[ {_RARE}]+", "\n")
        plain = _replace(_replace(c, " \n", "\n"), "\n ", "\n")
        return strip(F.when(_contains_any(c, *_RARE_CHARS), edges).otherwise(plain))

    def no_rules(c: Column) -> Column:
        start = r"[-|:=](?<=\A[-|:=]|\n[-|:=])"
        without = F.regexp_replace(c, rf"{start}[-|:= {_RARE}]+(?:\n|\z)", "")
        # The first character of a rule, with a line feed put before the text.
        lines = F.concat(F.lit("\n"), c)
        possible = _contains_any(lines, *("\n" + x for x in _RULE_CHARS))
        return F.when(possible, without).otherwise(c)

    def short_gaps(c: Column) -> Column:
        closed = F.regexp_replace(c, r"\n\n\n+", "\n\n")
        return strip(F.when(c.contains("\n\n\n"), closed).otherwise(c))

    return [unify_newlines, single_blanks, stripped_lines, no_rules, short_gaps]


def _through(c: Column, steps: list) -> Column:
    """Apply the steps in turn, each to the value (not the expression) before.

    ``transform`` over a one-element array binds each intermediate text to a
    lambda variable, so a step that reads its input twice computes it once.
    """
    value = F.array(c)
    for step in steps:
        value = F.transform(value, step)
    return F.get(value, F.lit(0))


def normalize_text(c: Column) -> Column:
    return _through(nfkc(c), normalization_steps())


def sentence_spacing(c: Column) -> Column:
    """Turn each single line feed into a full stop and a paragraph break."""
    exact = F.regexp_replace(c, r"\n(?<!\n\n)(?!\n)", ".\n\n")
    # Without longer runs, pairs can step aside while single ones are replaced.
    pairs = _replace(_replace(_replace(c, "\n\n", "\0"), "\n", ".\n\n"), "\0", "\n\n")
    return F.when(_contains_any(c, "\n\n\n", "\0"), exact).otherwise(pairs)


def final_text(c: Column) -> Column:
    """The text that is hashed, counted and chunked."""
    return _through(nfkc(c), normalization_steps() + [sentence_spacing])


def split_sections(c: Column) -> Column:
    return F.split(c, r"\n#{1,3} ", -1)


def strip_markdown_inline(c: Column) -> Column:
    """Drop code, emphasis and link markup, keeping the visible text."""
    c = F.regexp_replace(c, r"`([^`]+)`", "$1")
    c = F.regexp_replace(c, r"\*{1,3}([^*]+)\*{1,3}", "$1")
    return F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")


# A run of lines that start and end with a pipe. The group is possessive: Java
# then walks it in a loop, so a table of any length cannot exhaust the stack.
_TABLE_RUN = r"(?md)(?:^[ \t]*\|.+\|[ \t]*$\n?)++"
_TABLE_RULE = rf"\A[ \t]*\|[{SPACE}:|-]+\|[ \t]*\z"


def _table_cells(line: Column) -> Column:
    inner = F.regexp_replace(strip(line), r"\A\|+|\|+\z", "")
    return F.transform(F.split(inner, r"\|", -1), lambda x: strip_markdown_inline(strip(x)))


def _linear_tables(blocks: Column) -> Column:
    """Rewrite an array of table texts.

    Lines and header cells are worked out once per table, in lambdas of their
    own: an expression repeated inside a lambda would run again for every cell.
    """

    def lines_of(block: Column) -> Column:
        kept = F.filter(
            F.split(block, "\n", -1), lambda x: (strip(x) != "") & ~x.rlike(_TABLE_RULE)
        )
        return F.struct(block.alias("block"), kept.alias("lines"))

    def with_header(t: Column) -> Column:
        return F.struct(
            t["block"].alias("block"),
            F.size(t["lines"]).alias("n"),
            F.slice(t["lines"], F.lit(2), F.greatest(F.size(t["lines"]), F.lit(1))).alias("rows"),
            _table_cells(F.get(t["lines"], F.lit(0))).alias("header"),
        )

    def rewritten(t: Column) -> Column:
        def pair(cell: Column, i: Column) -> Column:
            unnamed = F.concat(F.lit("col_"), i.cast("string"))
            return F.concat(F.coalesce(F.get(t["header"], i), unnamed), F.lit(": "), cell)

        def row(line: Column) -> Column:
            return F.array_join(F.transform(_table_cells(line), pair), "\n")

        linear = F.array_join(F.transform(t["rows"], row), "\n\n")
        return F.when(t["n"] < 2, t["block"]).otherwise(linear)

    return F.transform(F.transform(F.transform(blocks, lines_of), with_header), rewritten)


def linearize_markdown_tables(c: Column) -> Column:
    """Rewrite each pipe table as ``header: cell`` lines, one group per row.

    The text is cut at the tables; the pieces between them and the rewritten
    tables are then interleaved again.
    """
    between = F.split(c, _TABLE_RUN, -1)
    tables = _linear_tables(F.regexp_extract_all(c, F.lit(_TABLE_RUN), F.lit(0)))
    woven = F.zip_with(
        between, tables, lambda text, table: F.concat(text, F.coalesce(table, F.lit("")))
    )
    return F.when(c.rlike(_TABLE_RUN), F.array_join(woven, "")).otherwise(c)
