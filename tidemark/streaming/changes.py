"""A stream of file arrivals turned into changes of the index.

Files arrive again: edited, unchanged, or late. Per source path a keyed state remembers the newest
arrival (its moment and the hash of its content), and each arrival becomes one of

* ``insert``: the first arrival of the path,
* ``replace``: newer than the remembered one, with another content,
* ``skip``: newer, with the same content (the moment moves on),
* ``late``: older than the remembered one; it changes nothing.

Of arrivals with one moment the one with the larger hash counts as newer, so any order of arrival
ends in the same state. A batch is applied to the stored index in one change: what is inserted or
replaced is ingested, and older documents of replaced paths are removed. A batch that runs again
after a failure finds the same state and changes nothing more. Only paths that arrive are touched;
the state is a hundred bytes a path, kept by Spark in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.engine import Engine
from tidemark.session import work_dir

ARRIVAL = "source_path string, source_kind string, content binary, byte_size long, modified timestamp"
CHANGE = f"{ARRIVAL}, action string"
STATE = "modified timestamp, content_hash string"


def judge(known: tuple | None, arrival: tuple) -> str:
    """What an arrival ``(moment, hash)`` is to the newest known one."""
    if known is None:
        return "insert"
    if arrival[1] == known[1]:
        return "skip" if arrival[0] >= known[0] else "late"
    return "replace" if arrival > known else "late"


def _per_path(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Judge a path's arrivals from the oldest on; of several that count in one batch only the
    newest carries its content on, the others were replaced before anybody saw them."""
    known = tuple(state.get) if state.exists else None
    arrived = pd.concat(list(frames), ignore_index=True)
    arrived = arrived.sort_values(["modified", "content_hash"], kind="stable").reset_index(drop=True)
    actions, last = [], None
    for i, moment, content in zip(range(len(arrived)), arrived["modified"], arrived["content_hash"]):
        action = judge(known, (moment, content))
        if action in ("insert", "replace"):
            if last is not None:  # the path's first action of the batch stands, with newer content
                action, actions[last] = actions[last], "skip"
            last = i
        if action != "late":
            known = (moment, content)
        actions.append(action)
    state.update(known)
    arrived["action"] = actions
    arrived.loc[~arrived["action"].isin(["insert", "replace"]), "content"] = None
    yield arrived.drop(columns="content_hash")


def changes(arrivals: DataFrame) -> DataFrame:
    """``arrivals`` (columns of ``ARRIVAL``) with their ``action``; the content of what is skipped
    or late is left out."""
    hashed = arrivals.withColumn("content_hash", F.sha2("content", 256))
    return hashed.groupBy("source_path").applyInPandasWithState(
        _per_path, CHANGE, STATE, "append", GroupStateTimeout.NoTimeout
    )


def apply_changes(engine: Engine, batch: DataFrame) -> None:
    """One micro-batch of changes to the stored index."""
    counted = batch.where(F.col("action").isin("insert", "replace")).persist()
    try:
        if counted.isEmpty():
            return
        tables = engine.tables
        with tables.change():
            # What replaced paths hold now; ids of the new contents are known after the ingest.
            before = tables.versions_of(counted.where("action = 'replace'"))
            old = engine.stage(before, "replaced")
            written = engine.ingest_frame(counted.select("source_path", "source_kind", "content", "byte_size"))
            gone = old.join(written.select("document_id"), "document_id", "left_anti")
            tables.delete_documents(gone)
    finally:
        counted.unpersist()


def follow(engine: Engine, arrivals: DataFrame, name: str = "changes", trigger: dict | None = None) -> StreamingQuery:
    """Apply a stream of arrivals to the index; by default what is there now, then stop."""
    engine.initialize()
    return (
        changes(arrivals).writeStream.foreachBatch(lambda batch, _: apply_changes(engine, batch))
        .option("checkpointLocation", f"{work_dir(engine.spark)}/streams/{name}")
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
