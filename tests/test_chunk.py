"""The splitter against the rules written out piece by piece."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import chunk as C


def spec_split(text, separators=("\n\n", "\n", " ", ""), size=300, overlap=50):
    """List-of-pieces form of the same rules, for comparison only."""

    def pieces_of(text, sep):
        if not sep:
            return list(text)
        first, *rest = text.split(sep)
        return [p for p in [first] + [sep + r for r in rest] if p]

    def merge(pieces):
        out, window = [], []
        for p in pieces:
            if window and sum(map(len, window)) + len(p) > size:
                out.append("".join(window).strip())
                while window and (
                    sum(map(len, window)) > overlap or sum(map(len, window)) + len(p) > size
                ):
                    window.pop(0)
            window.append(p)
        out.append("".join(window).strip())
        return [o for o in out if o]

    at = next(i for i, s in enumerate(separators) if s in text)
    done, held = [], []
    for piece in pieces_of(text, separators[at]):
        if len(piece) < size:
            held.append(piece)
            continue
        if held:
            done += merge(held)
            held = []
        rest = separators[at + 1 :]
        done += spec_split(piece, rest, size, overlap) if rest else [piece]
    return done + (merge(held) if held else [])


TOKENS = st.sampled_from(["a", "word", " ", "  ", "\n", "\n\n", "x" * 60, "y" * 299, "z" * 700, "é😀"])


@settings(max_examples=400, deadline=None)
@given(st.lists(TOKENS, max_size=120).map("".join))
def test_split_matches_rules(text):
    assert C.split_text(text) == (spec_split(text) if text else [])


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n", max_size=80))
def test_split_matches_rules_with_small_sizes(text):
    assert C.split_text(text, 12, 4) == (spec_split(text, size=12, overlap=4) if text else [])


def test_goldens():
    long = ("Lorem ipsum dolor sit amet, consectetur adipiscing elit. " * 40).strip()
    chunks = C.split_text(long)
    assert len(chunks) > 1 and max(map(len, chunks)) <= 300
    assert C.split_text("Short") == ["Short"]
    assert C.split_text("") == []
    assert C.split_text("tiny\n\nsmall\n\nbrief") == ["tiny\n\nsmall\n\nbrief"]


def test_rows_and_ids(spark):
    long = ("Chunk me into multiple segments while preserving order. " * 35).strip()
    docs = spark.createDataFrame(
        [("abc123", long), ("none", ""), ("short", "Short")], "document_id string, text string"
    )
    rows = C.chunk_documents(docs).orderBy("document_id", "chunk_index").collect()
    mine = [r for r in rows if r.document_id == "abc123"]
    assert [r.chunk_index for r in mine] == list(range(len(mine))) and len(mine) > 1
    assert mine[0].chunk_id == "1a6d312f62bc667f34dd2a30cf89fc4e6c81f749cb1b0912315536994587da35"
    assert mine[0].point_id == "668edd12-1ae7-526b-92eb-06b16ed18c7c"
    assert mine[1].chunk_id == hashlib.sha256(b"abc123:1").hexdigest()
    assert len({r.chunk_id for r in rows}) == len(rows)
    assert {r.document_id for r in rows} == {"abc123", "short"}
    stats = {r.document_id: r for r in C.chunk_stats(C.chunk_documents(docs)).collect()}
    assert stats["abc123"].n_chunks == len(mine) and stats["abc123"].last_index == len(mine) - 1


def test_texts_built_in_the_same_plan(spark):
    """Lambda functions upstream of the UDF must not end up in its arguments."""
    from tidemark.functions import text as X

    df = spark.createDataFrame([("d", "a\n\n\nb")], "document_id string, raw string")
    built = df.select("document_id", X.final_text(F.col("raw")).alias("text"))
    assert [r.chunk_text for r in C.chunk_documents(built).collect()] == ["a\n\nb"]
