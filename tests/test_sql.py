"""SQL names of the functions: same results as the columns, still in the JVM."""

import pytest
from pyspark.sql import functions as F
from tidemark import sql
from tidemark.functions import text as X
from tidemark.operators import chunk as C

TEXTS = [
    "Rain\t fell\r\n\r\n\r\n== ==\nＳｎｏｗ  came.\n\n'quoted' and \\ back", "", None, "=\n|--|", "/a/b.TAR.gz", "x" * 700,
    "one\n# two\n### three", "words " * 200 + "\n\n" + "more. " * 90,
]


@pytest.fixture(scope="module")
def names(spark):
    return sql.register(spark, "tm_")


def test_same_as_the_columns(spark, names):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    frame.createOrReplaceTempView("tm_texts")
    for name, (function, types) in sql.FUNCTIONS.items():
        given = {"STRING": "t", "INT": "i", "BIGINT": "i * 4000000000", "DOUBLE": "i / 5"}
        arguments = [given[k] for k in types]
        got = spark.sql(f"SELECT i, tm_{name}({', '.join(arguments)}) AS r FROM tm_texts")
        want = frame.select("i", function(*[F.expr(f"CAST({a} AS {k})") for a, k in zip(arguments, types)]).alias("r"))
        assert sorted(got.collect(), key=lambda r: r.i) == sorted(want.collect(), key=lambda r: r.i), name
    for name, function in (("normalize_text", X.normalize_text), ("final_text", X.final_text)):
        got = spark.sql(f"SELECT i, tm_{name}(t) AS r FROM tm_texts")
        assert sorted(got.collect()) == sorted(frame.select("i", function(F.col("t")).alias("r")).collect()), name
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_splitter_as_a_table_function(spark, names):
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "document_id string, text string")
    frame.repartition(3).createOrReplaceTempView("tm_docs")
    got = spark.sql("""
        SELECT document_id, chunk_index, chunk_text, tm_chunk_id(document_id, chunk_index) AS chunk_id
        FROM tm_docs, LATERAL tm_split_chunks(text)""")
    want = C.chunk_documents(frame).select("document_id", "chunk_index", "chunk_text", "chunk_id")
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() > 8
