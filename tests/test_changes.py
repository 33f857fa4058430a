"""File arrivals as changes, and model inference in groups of like length."""

import random
import sys
import types
import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark import cloudpickle
from tidemark.config import parse_config
from tidemark.engine import Engine
from tidemark.operators import embed as E
from tidemark.streaming import changes as C

DAY = datetime(2024, 1, 1)
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the model below runs in workers


def arrivals(*rows):
    return [(p, "txt", t.encode(), len(t), DAY + timedelta(days=d)) for p, t, d in rows]


def index_of(engine):
    documents = sorted((r.source_path, r.content_hash) for r in engine.tables.documents().collect())
    return documents, sorted((r.source_path, r.chunk_text) for r in engine.tables.chunks().collect())


BATCHES = [
    arrivals(("a", "first words", 1), ("b", "stays the same", 1), ("c", "one", 1), ("c", "two", 2), ("c", "three", 3)),
    arrivals(("a", "edited words", 5), ("b", "stays the same", 6), ("c", "too late", 2), ("d", "new", 1)),
    arrivals(("a", "too late as well", 4), ("a", "edited words", 5), ("d", "newer", 2), ("b", "changed", 7)),
]
LAST = [("a", "edited words"), ("b", "changed"), ("c", "three"), ("d", "newer")]


@pytest.fixture
def make_engine(spark, work):
    return lambda name: Engine(spark, parse_config({"paths": {"data_dir": str(work / name)}}), E.HashingEmbedder(16))


def test_a_stream_of_changes_gives_the_batch_index(spark, work, make_engine):
    feed, engine, name = str(work / "feed"), make_engine("streamed"), uuid.uuid4().hex
    for batch in BATCHES:
        spark.createDataFrame(batch, C.ARRIVAL).coalesce(1).write.mode("append").parquet(feed)
        C.follow(engine, spark.readStream.schema(C.ARRIVAL).parquet(feed), name).awaitTermination()
    assert index_of(engine)[1] == LAST
    plain = make_engine("plain")
    plain.initialize()
    plain.ingest_frame(spark.createDataFrame(arrivals(*[(p, t, 1) for p, t in LAST]), C.ARRIVAL).drop("modified"))
    assert index_of(engine) == index_of(plain)
    # The whole feed again, in one batch, in a fresh index and with a fresh state.
    replayed = make_engine("replayed")
    C.follow(replayed, spark.readStream.schema(C.ARRIVAL).parquet(feed), uuid.uuid4().hex).awaitTermination()
    assert index_of(replayed) == index_of(plain)
    # A batch that runs again changes nothing.
    again = spark.createDataFrame([(*r, "replace") for r in arrivals(("a", "edited words", 5))], C.CHANGE)
    C.apply_changes(engine, again)
    assert index_of(engine) == index_of(plain)


def test_actions_do_not_depend_on_the_order():
    moments = [(DAY, "h1"), (DAY, "h2"), (DAY + timedelta(1), "h1"), (DAY + timedelta(2), "h3"), (DAY + timedelta(2), "h3")]
    rng = random.Random(0)
    for _ in range(20):
        order, known = rng.sample(moments, len(moments)), None
        for arrival in order:
            if C.judge(known, arrival) != "late":
                known = max(known, arrival) if known else arrival
        assert known == (DAY + timedelta(2), "h3")
    assert C.judge(None, moments[0]) == "insert" and C.judge(moments[1], moments[0]) == "late"
    assert C.judge(moments[0], moments[1]) == "replace" and C.judge(moments[3], moments[4]) == "skip"


# -- inference ------------------------------------------------------------------------------


def small_model():
    """A padded model: letters looked up, masked mean, one layer. Notes the groups it is given."""
    weights = np.random.default_rng(0).standard_normal((128, 6))

    def encode(texts):
        longest = max(map(len, texts), default=1) or 1
        ids = np.zeros((len(texts), longest), int)
        for i, t in enumerate(texts):
            ids[i, : len(t)] = [ord(c) % 127 + 1 for c in t]
        mask = (ids > 0)[:, :, None]
        total = np.where(mask, weights[ids % 128], 0).cumsum(axis=1)[:, -1]
        return np.tanh(total / np.maximum(mask.sum(axis=1), 1)) + 0.01

    return encode


def test_vectors_do_not_depend_on_batches(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefgh ", k=rng.choice([1, 3, 40, 900]))) for _ in range(300)] + [None, ""]
    rows = list(enumerate(texts))
    want = None
    for seed, size, padded in ((0, 1, 1), (1, 7, 2000), (2, 64, 1 << 20), (3, 300, 500)):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "i int, t string").repartition(seed + 1)
        found = E.ModelEmbedder(small_model, 6, size, padded).embed(df, "t").collect()
        got = {r.i: r.embedding for r in found}
        want = want or got
        assert got == want
    assert want[300] is None and len(want[301]) == 6


def test_groups_bound_padding():
    lengths = [5, 1, 100, 2, 3, 50, 50, 4]
    groups = list(E.micro_batches(lengths, 3, 60))
    assert sorted(i for g in groups for i in g) == list(range(8))
    for g in groups:
        assert len(g) <= 3 and (len(g) == 1 or len(g) * max(lengths[i] for i in g) <= 60)
    assert [lengths[i] for g in groups for i in g] == sorted(lengths)
    assert list(E.micro_batches([], 3, 60)) == []


def test_resource_profile_gives_the_same_vectors(spark):
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(1)).build
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "a longer text")], "i int, t string")
    plain = E.ModelEmbedder(small_model, 6).embed(df, "t").collect()
    staged = E.ModelEmbedder(small_model, 6, profile=profile)
    try:
        assert staged.embed(df, "t").collect() == plain
    except Exception as exc:  # local masters without dynamic allocation refuse profiles
        assert "ResourceProfile" in str(exc)


def test_local_model_files_are_loaded(monkeypatch):
    """The loaders hand names, folders and options to their libraries, and normalise nothing away."""
    calls = []

    class Model:
        def __init__(self, name, cache_folder, local_files_only):
            calls.append((name, cache_folder, local_files_only))
            if name == "gone":
                raise OSError("no such model")

        def encode(self, texts, batch_size, normalize_embeddings, show_progress_bar):
            return np.ones((len(texts), 2)) * batch_size

    monkeypatch.setitem(sys.modules, "sentence_transformers", types.SimpleNamespace(SentenceTransformer=Model))
    encode = E.load_sentence_transformer("m", "/cache", 4)
    assert encode(["a", "b"]).tolist() == [[4.0, 4.0]] * 2 and calls == [("m", "/cache/hub", True)]
    with pytest.raises(RuntimeError, match="not found in local cache"):
        E.load_sentence_transformer("gone", "/cache", 4)
