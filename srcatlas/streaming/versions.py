"""Newest versions of files as a stream with state: what is late, repeated or expired is told before anything is indexed.

One state per file holds the newest version seen: its time, whether it deletes the file, and a digest of the content.  A row
that is older than the state, or that repeats it, gives nothing; a newer one goes on and sets a timer, and when the stream's
watermark passes a version's time its timer fires and the file goes.  The watermark trails the latest time by ``ttl``, so a
version expires once a version of any file is ``ttl`` younger, and rows that arrive later than that have expired already.
State keeps no content, so its size follows the number of files that have not expired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from srcatlas.functions.tables import CHUNK_BYTES
from srcatlas.operators.embed import Embedder
from srcatlas.streaming.reindex import index_batch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "repo string, path string, mtime timestamp, content string, cause string"


def _digest(content: str | None) -> str:
    return "" if content is None else hashlib.sha256(content.encode()).hexdigest()


class NewestVersion(StatefulProcessor):
    """Of the versions of one file, in any order: the changes from one newest version to the next."""

    def __init__(self, expires: bool):
        self.expires = expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "mtime timestamp, digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for batch in rows:
            for mtime, content in zip(batch["mtime"], batch["content"]):
                content = None if pd.isna(content) else content
                # of versions with one time a deletion comes last, then the greatest content
                rank = (mtime, content is None, content or "")
                best = rank if best is None or rank > best else best
        mtime, deleted, content = best
        content = None if deleted else content
        held = self.newest.get() if self.newest.exists() else None
        if held is not None and (mtime < pd.Timestamp(held[0]) or (mtime == pd.Timestamp(held[0]) and _digest(content) == held[1])):
            yield pd.DataFrame(columns=["repo", "path", "mtime", "content", "cause"])
            return
        self.newest.update((mtime.to_pydatetime(), _digest(content)))
        if self.expires:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(mtime.value // 1_000_000))
        cause = "deleted" if deleted else "new" if held is None or not held[1] else "changed"
        yield pd.DataFrame({"repo": [key[0]], "path": [key[1]], "mtime": [mtime], "content": [content], "cause": [cause]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.newest.get() if self.newest.exists() else None
        self.newest.clear()
        if held is None or not held[1]:
            yield pd.DataFrame(columns=["repo", "path", "mtime", "content", "cause"])
            return
        yield pd.DataFrame({"repo": [key[0]], "path": [key[1]], "mtime": [pd.Timestamp(held[0])], "content": [None], "cause": ["expired"]})

    def close(self) -> None:
        pass


def newest_versions(stream: DataFrame, ttl: str | None = None) -> DataFrame:
    """A stream of versions (``repo, path, mtime, content``; no content marks a deletion) -> a stream of changes, with ``cause``:
    new, changed, deleted or expired (the last two without content).

    ``ttl``: an interval such as ``20 days``; without it nothing expires, and state keeps every file.  Needs Spark's RocksDB
    state store, which is set on the session.  Rows without ``mtime`` are no versions and are left out.
    """
    stream.sparkSession.conf.set(PROVIDER, ROCKSDB)
    rows = stream.where(F.col("mtime").isNotNull()).select("repo", "path", "mtime", "content")
    if ttl is not None:
        rows = rows.withWatermark("mtime", ttl)
    mode = "EventTime" if ttl is not None else "None"
    return rows.groupBy("repo", "path").transformWithStateInPandas(NewestVersion(ttl is not None), CHANGES, "Update", mode)


def start_stateful_reindex(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    ttl: str | None = None,
    embedder: Embedder | None = None,
    max_bytes: int = CHUNK_BYTES,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Like ``start_reindex``, but only changes are indexed: late and repeated versions are dropped by state, expired files go.

    The index is read by ``current_index``.
    """

    def each(changes: DataFrame, batch: int) -> None:
        index_batch(changes.drop("cause"), batch, target, embedder, max_bytes)

    return (
        newest_versions(stream, ttl)
        .writeStream.outputMode("update")
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
