"""An index as a table with snapshots, whose refresh rewrites only what changed.

    <path>/data/<build>/<kind>/bucket=<n>/part-...    never changed once written
    <path>/snapshots/v<number>/part-...               kind, bucket, build: where each bucket's newest rows are

A file belongs to one of a fixed number of buckets by a hash of repository and path, with its chunks and its row of state.  A
refresh reads and writes the buckets of changed files and leaves the files of all others where they are.  A write becomes
visible when its snapshot, a table of at most two rows per bucket, is moved to its name; until then readers have the one before,
and what a job that died has left is never read.  A reader keeps the snapshot it began with: the files of replaced buckets stay
until ``vacuum``.  One writer at a time is meant: a second one that began from the same snapshot is refused.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.schemas import CHUNKS, INDEX_STATE
from srcatlas.session import exists, move, names_in, remove

BUCKETS = 64
CHUNK_ROWS, STATE_ROWS = "chunks", "state"
_SCHEMAS = {CHUNK_ROWS: CHUNKS, STATE_ROWS: INDEX_STATE}
_FILE = {CHUNK_ROWS: "file", STATE_ROWS: "path"}
_MANIFEST = "kind string, bucket int, build string, buckets int"

#: (kind, bucket) -> build
Manifest = dict[tuple[str, int], str]


class ChangedMeanwhile(RuntimeError):
    """Another writer has committed since this one began."""


def bucket_of(repo: Column, path: Column, buckets: int) -> Column:
    digits = F.left(F.md5(F.concat_ws("/", repo, path)), F.lit(8))
    return (F.conv(digits, 16, 10).cast("long") % buckets).cast("int")


class IndexTable:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        """``buckets`` holds for a table that is still to be made; another keeps the number it was made with."""
        self.spark, self.path = spark, path.rstrip("/")
        last = self.version()
        self.buckets = self._rows(last)[0].buckets if last else buckets

    # Snapshots.

    def versions(self) -> list[int]:
        return [int(n[1:]) for n in names_in(self.spark, f"{self.path}/snapshots") if re.fullmatch(r"v\d+", n)]

    def version(self) -> int:
        """The newest snapshot's number; 0 where there is none."""
        return max(self.versions(), default=0)

    def _snapshot(self, version: int) -> str:
        return f"{self.path}/snapshots/v{version:012d}"

    def _rows(self, version: int) -> list:
        return self.spark.read.schema(_MANIFEST).parquet(self._snapshot(version)).collect()  # two rows per bucket at most

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.version() if version is None else version
        return {(r.kind, r.bucket): r.build for r in self._rows(version) if r.kind} if version else {}

    def _commit(self, manifest: Manifest, base: int) -> int:
        rows = [(kind, bucket, build, self.buckets) for (kind, bucket), build in sorted(manifest.items())] or [(None, None, None, self.buckets)]
        held = f"{self.path}/snapshots/.{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(held)
        if self.version() != base or not move(self.spark, held, self._snapshot(base + 1)):
            remove(self.spark, held)
            raise ChangedMeanwhile(f"{self.path} has a newer snapshot than {base}")
        return base + 1

    # Reading.

    def _read(self, kind: str, manifest: Manifest, buckets: set[int] | None = None) -> DataFrame:
        places = [f"{self.path}/data/{build}/{kind}/bucket={b}" for (k, b), build in sorted(manifest.items()) if k == kind and (buckets is None or b in buckets)]
        schema = _SCHEMAS[kind]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The chunks of a snapshot, the newest if not told."""
        return self._read(CHUNK_ROWS, self.manifest(version))

    def state(self, version: int | None = None) -> DataFrame:
        """``repo, path, mtime, indexed_at`` of the indexed files of a snapshot."""
        return self._read(STATE_ROWS, self.manifest(version))

    def bucketed(self, kind: str, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", bucket_of(F.col("repo"), F.col(_FILE[kind]), self.buckets))

    # Writing.

    def _write(self, kind: str, rows: DataFrame, build: str) -> set[int]:
        """Write rows as files per bucket; large buckets are split over tasks."""
        place = f"{self.path}/data/{build}/{kind}"
        wanted = rows.select(*_SCHEMAS[kind].names)
        self.bucketed(kind, wanted).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(place)
        return {int(n.removeprefix("bucket=")) for n in names_in(self.spark, place) if n.startswith("bucket=")}

    def _replace(self, base: int, parts: dict[str, DataFrame], buckets: set[int] | None) -> int:
        build = uuid.uuid4().hex
        kept = {key: at for key, at in self.manifest(base).items() if buckets is not None and key[1] not in buckets}
        for kind, rows in parts.items():
            kept |= {(kind, b): build for b in self._write(kind, rows, build)}
        return self._commit(kept, base)

    def write(self, index: DataFrame, state: DataFrame | None = None) -> int:
        """A snapshot with these rows only; returns its number."""
        parts = {CHUNK_ROWS: index} | ({STATE_ROWS: state} if state is not None else {})
        return self._replace(self.version(), parts, None)

    def refresh(self, changes: DataFrame, fresh: DataFrame, now: Column) -> int:
        """A snapshot where the files of ``changes`` (``repo, path, mtime, status``, written) have the chunks ``fresh`` instead.

        Deleted files go.  Buckets without a changed file keep their files on disk.
        """
        base = self.version()
        found = changes.select(bucket_of(F.col("repo"), F.col("path"), self.buckets).alias("bucket")).distinct()
        touched = {r.bucket for r in found.collect()}  # at most as many as there are buckets
        if not touched:
            return base
        manifest = self.manifest(base)
        gone = changes.select("repo", F.col("path").alias("file"))
        chunks = self._read(CHUNK_ROWS, manifest, touched).join(gone, ["repo", "file"], "left_anti")
        stamped = changes.where(F.col("status") != "deleted").select("repo", "path", "mtime", now.alias("indexed_at"))
        state = self._read(STATE_ROWS, manifest, touched).join(changes.select("repo", "path"), ["repo", "path"], "left_anti")
        parts = {CHUNK_ROWS: chunks.select(*CHUNKS.names).unionByName(fresh.select(*CHUNKS.names)), STATE_ROWS: state.select(*INDEX_STATE.names).unionByName(stamped)}
        return self._replace(base, parts, touched)

    def load_or_build(self, build: Callable[[], DataFrame]) -> DataFrame:
        """The newest snapshot; where there is none, also after a build that died, one of what ``build()`` returns."""
        if not self.version():
            self.write(build())
        return self.read()

    def vacuum(self, keep: int = 1) -> None:
        """Remove all but the newest ``keep`` snapshots, and builds that none of those reads: readers of older ones must be done."""
        versions = sorted(self.versions())
        for old in versions[: max(0, len(versions) - max(1, keep))]:
            remove(self.spark, self._snapshot(old))
        used = {build for v in versions[-max(1, keep) :] for build in self.manifest(v).values()}
        for build in names_in(self.spark, f"{self.path}/data"):
            if build not in used:
                remove(self.spark, f"{self.path}/data/{build}")
                continue
            for kind in names_in(self.spark, f"{self.path}/data/{build}"):
                live = {b for v in versions[-max(1, keep) :] for (k, b), at in self.manifest(v).items() if at == build and k == kind}
                for name in names_in(self.spark, f"{self.path}/data/{build}/{kind}"):
                    if name.startswith("bucket=") and int(name.removeprefix("bucket=")) not in live:
                        remove(self.spark, f"{self.path}/data/{build}/{kind}/{name}")

    def exists(self) -> bool:
        return exists(self.spark, f"{self.path}/snapshots") and bool(self.version())
