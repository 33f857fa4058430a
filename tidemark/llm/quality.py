"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a column expression over the row's own text, so the whole judgement is one
narrow stage without a shuffle and without user functions; no row meets another row.

Defined cases: a null or blank text has zero words and fails; a text of one or two words has
no window; rows are judged one by one, so repeated rows get equal verdicts; columns of the
input are kept, and a clashing name among the added ones is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[ \t-\r]"
SYMBOLS = "#*$%&|<>"
# Frequent short words of the languages that the rules cover.
STOP_WORDS = (
    "the of and to in is that it a be for on with as by are this was from have not or at "
    "le la les un une de des du et en que qui est dans pour par sur au avec il elle "
    "der die das und ist von mit den dem ein eine zu auf für sich nicht auch es im "
    "el los las una del y por con para se su al lo como más"
).split()


# The names of the measures.
MEASURES = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_exclamations n_letters "
    "n_capitals n_stop_words"
).split()


@dataclass(frozen=True)
class Rule:
    """Rejects a text whose ``part`` lies outside [least, most] of ``whole``."""

    name: str
    part: str
    whole: str
    least: float | None = None
    most: float | None = None


# The table. Parts and wholes are names in MEASURES.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("exclamations", "n_exclamations", "n_words", most=0.2),
    Rule("letters", "n_letters", "word_chars", least=0.6),
    Rule("capitals", "n_capitals", "n_letters", most=0.5),
    Rule("stop_words", "n_stop_words", "n_words", least=0.01),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=0.5),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas in it use it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _split(text: Column) -> Column:
    return F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")


def _left(text: Column, others: str) -> Column:
    """Characters left when the runs of ``others`` are taken out."""
    return F.char_length(F.regexp_replace(text, others, ""))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three which occurs twice or more in the text.

    Windows are compared as text, after a look at their hashes: where no two hashes are equal,
    no two windows are. Else neighbours among the sorted (window, place) pairs give the
    places, and places next to each other share words.
    """
    zero = F.lit(0).cast("long")

    def hashes(w: Column) -> Column:
        ends = lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), ends)

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(w) - 2),
            lambda i: F.struct(
                F.concat_ws(" ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("w"),
                i.alias("i"),
            ),
        )

    def places(pairs: Column) -> Column:
        def same(i: Column) -> Column:
            return F.get(pairs, i)["w"] == F.get(pairs, i + 1)["w"]

        at = F.sequence(F.lit(0), F.size(pairs) - 1)
        hits = F.filter(
            at, lambda i: ((i + 1 < F.size(pairs)) & same(i)) | ((i > 0) & same(i - 1))
        )
        return F.sort_array(F.transform(hits, lambda i: F.get(pairs, i)["i"]))

    def covered(spots: Column) -> Column:
        gaps = F.transform(
            F.sequence(F.lit(0), F.size(spots) - 1),
            lambda i: F.least(F.lit(3), F.coalesce(F.get(spots, i + 1) - F.get(spots, i), F.lit(3))),
        )
        total = F.aggregate(gaps, zero, lambda total, g: total + g)
        return F.when(F.size(spots) == 0, zero).otherwise(total)

    return (
        F.when(F.size(words) < 3, zero)
        .when(_let(hashes(words), lambda h: F.size(F.array_distinct(h)) == F.size(h)), zero)
        .otherwise(_let(F.sort_array(windows(words)), lambda p: _let(places(p), covered)))
    )


def measures(text: Column, words: Column) -> list[Column]:
    """The counts that rules may refer to, of a text that is not null and of its words."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    stops = F.filter(words, lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(STOP_WORDS))
    counts = {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.array_join(words, "")),
        "n_symbols": _left(text, f"[^{SYMBOLS}]+"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeated_words(words),
        "n_lines": F.size(lines),
        "n_exclamations": _left(text, "[^!]+"),
        "n_letters": _left(text, r"\P{L}+"),
        "n_capitals": _left(text, r"\P{Lu}+"),
        "n_stop_words": F.size(stops),
    }
    return [value.cast("long").alias(name) for name, value in counts.items()]


def verdict(counts: Column, rules=RULES) -> Column:
    """All rules as one condition over a struct of measures."""
    passed = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            passed &= counts[rule.part] >= F.lit(rule.least) * counts[rule.whole]
        if rule.most is not None:
            passed &= counts[rule.part] <= F.lit(rule.most) * counts[rule.whole]
    return passed


def judged(text: Column, rules=RULES) -> Column:
    """A struct of the measures, ``base_failed`` and ``kept``.

    One expression that computes every part once, so that it may also stand in a filter.
    """

    def judge(counts: Column) -> Column:
        repeated = 100 * counts["n_repeat_words"] > 50 * counts["n_words"]
        failed = (counts["n_words"] < 50) | repeated
        return F.struct(
            counts.alias("counts"),
            failed.alias("base_failed"),
            (~failed & verdict(counts, rules)).alias("kept"),
        )

    return _let(
        F.coalesce(text, F.lit("")),
        lambda t: _let(_split(t), lambda w: _let(F.struct(*measures(t, w)), judge)),
    )


def judge(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Add the measures, ``base_failed`` and ``kept``."""
    added = ["_judged", "base_failed", "kept", *MEASURES]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in added]
    found = df.select(*rest, judged(F.col(text), rules).alias("_judged"))
    return found.select(*rest, "_judged.counts.*", "_judged.base_failed", "_judged.kept")
