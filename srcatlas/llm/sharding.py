"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring; a document belongs to the shard of the next point clockwise from the hash of its
``doc_id``.  A shard takes its own documents up to a bound just above the mean size; what is over continues clockwise to
the next shards with room (Mirrokni, Thorup, Zadimoghaddam, "Consistent Hashing with Bounded Loads", 2016).  The law is
``bytes``: no shard exceeds (1 + SLACK) times the mean by more than a document, and therefore none is far below it.

The driver sees one sum per arc of the ring, so a fixed number of rows.  It works out which stretch of each arc's running
size goes to which shard; executors look their document's stretch up.  Equal texts are not tied together: a group of
copies with a third of all rows fits no bounded shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm.common import UID, running_total_by, whole_text, with_uid
from srcatlas.session import durable

SHARDS = 16
POINTS = 256
SLACK = 0.001
CUT = -1

Stretch = tuple[int, int, int, int]


def ring(shards: int, points: int = POINTS) -> tuple[list[int], list[int]]:
    """Sorted positions (signed 64-bit) and the shard that owns each; another shard only adds points of its own."""
    placed = sorted((xxhash.xxh64_intdigest(f"{s}/{p}".encode()) - (1 << 63), s) for s in range(shards) for p in range(points))
    return [p for p, _ in placed], [s for _, s in placed]


def stretches(sizes: dict[int, int], owners: list[int], shards: int, slack: float = SLACK) -> list[Stretch]:
    """(arc, from, to, shard): where each part of an arc's running size goes.

    Own documents first, arc by arc up to the bound; then each arc's overflow, clockwise to shards with room.
    """
    total = sum(sizes.values())
    bound = max(1, -int(-total * (1 + slack) // shards))
    load, out, over = [0] * shards, [], []
    for arc in sorted(sizes):
        shard, size = owners[arc], sizes[arc]
        own = min(size, bound - load[shard])
        load[shard] += own
        if own:
            out.append((arc, 0, own, shard))
        if own < size:
            over.append((arc, own, size))
    for arc, done, size in over:
        point = arc
        while done < size:
            point = (point + 1) % len(owners)
            shard = owners[point]
            moved = min(size - done, bound - load[shard])
            if moved > 0:
                load[shard] += moved
                out.append((arc, done, done + moved, shard))
                done += moved
    return out


def place_cut(rows: list[tuple[int, int, int]], load: list[int], owners: list[int], slack: float) -> list[tuple[int, int]]:
    """(uid, shard) for the documents on cuts, in their order (largest first): clockwise to the first shard with room, else the emptiest."""
    bound = -int(-(sum(load) + sum(size for _, _, size in rows)) * (1 + slack) // len(load))
    out = []
    for uid, arc, size in rows:
        around = dict.fromkeys([*owners[arc:], *owners[:arc]])
        shard = next((s for s in around if load[s] + size <= bound), min(around, key=lambda s: load[s]))
        load[shard] += size
        out.append((uid, shard))
    return out


def bounded_shards(docs: DataFrame, shards: int = SHARDS, points: int = POINTS, slack: float = SLACK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    A null text has size 1, as an empty one.  Rows with a null ``doc_id``, like repeated rows, meet in one arc and may
    overflow it row by row.  Slots count from 0 without gaps in each shard.  An empty table gives no rows.
    """
    places, owners = ring(shards, points)

    @F.pandas_udf("int")
    def arc_of(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = np.array(places, np.int64)
        for batch in hashes:
            yield pd.Series(np.searchsorted(held, batch.to_numpy(np.int64)) % len(held), dtype="int32")

    narrow = docs.select(
        "doc_id",
        (F.octet_length(whole_text()) + F.lit(1)).cast("long").alias("size"),
        F.crc32(whole_text()).alias("text_crc32"),
        arc_of(F.xxhash64("doc_id")).alias("arc"),
        F.xxhash64("doc_id", whole_text()).alias("place"),
    )
    rows = durable(with_uid(narrow), "sized")
    sizes = {r.arc: r.size for r in rows.groupBy("arc").agg(F.sum("size").alias("size")).collect()}  # one row per arc
    parts = docs.sparkSession.createDataFrame(stretches(sizes, owners, shards, slack) or [(-1, 0, 0, 0)], "arc int, lo long, hi long, shard int")

    # the order in an arc depends on the rows alone, not on the tasks that wrote them
    order = [F.col("place"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    run = running_total_by(rows, ["arc"], order, F.col("size"), "before")
    within = (run["arc"] == parts["arc"]) & (run["before"] >= parts["lo"]) & (run["before"] < parts["hi"])
    whole = F.when(F.col("before") + F.col("size") <= F.col("hi"), F.col("shard")).otherwise(CUT).alias("shard")
    placed = run.join(F.broadcast(parts), within).select("doc_id", "size", "text_crc32", run["arc"], "place", whole, UID)
    placed = durable(placed, "placed")
    # a cut ends an arc's own part or fills a shard: at most two per shard, so this is a handful of rows
    cut = placed.where(F.col("shard") == CUT).orderBy(F.desc("size"), *order).select(UID, "arc", "size").collect()
    load = {r.shard: r.size for r in placed.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
    put = place_cut([tuple(r) for r in cut], [load.get(s, 0) for s in range(shards)], owners, slack)
    late = docs.sparkSession.createDataFrame(put or [(-1, -1)], f"{UID} long, late int")
    placed = placed.join(F.broadcast(late), UID, "left").withColumn("shard", F.coalesce("late", "shard")).drop("late")
    return running_total_by(placed, ["shard"], order, F.lit(1), "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
