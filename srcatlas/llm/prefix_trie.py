"""Prefix trie of conversations as a burst trie over Spark tables.

A conversation is a sequence of turn ids (SHA-256 of role and text).  Equal conversations are one entry with a weight.  The
trie begins as one container under the root.  A container that holds more turns than ``container_rows`` bursts: its members
are dealt to one container per next turn id, and the heads of these are counted by grouped aggregation.  A container with
one member is a chain, written off row by row.  The others are small: they are dealt to shards, where each one's suffixes are
sorted and swept into nodes, with a stack of the nodes that are open.  Totals of subtrees then go up the few levels of heads.

A node is named by its smallest member and its depth.  No conversation, container or group of copies of any size is held
by one task: turns are numbered over ranges, copies are counted before anything is dealt, and the numbers of a group's members
are hashed as a stream of sorted pieces.  Every step is a written table, so a lost executor costs one step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.llm.common import UID, numbered, with_uid
from srcatlas.session import durable

#: Turns of a container's members below its head, over which it bursts.
CONTAINER_ROWS = 256
#: Nodes handed over at a time.
BATCH_NODES = 4096
#: Member numbers in one piece of a list that is hashed.
PIECE_IDS = 4096
#: Turns of a chain whose sizes are added up in one group.
CHAIN_BLOCK = 4096
#: A rebuilt conversation begins with fewer turns of its family's first than this.
SHARED_TURNS = 9
FAMILY = 5

NO_ENDS = hashlib.sha256(b"").hexdigest()
_PARTS = ["x0", "x1", "x2", "x3"]
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_rep long, end_weight long"


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 0), ``tid``, ``bytes``, with ``n`` turns of the conversation: turns by number, null first.

    Equal numbers are ordered by the digest of role and text.  Rows without ``conv_id`` belong to no conversation and are
    left out.  Numbers come from ranges of all turns, so that one conversation may hold any share of the rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    tid = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    narrow = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", tid.alias("tid"), F.octet_length(text).cast("long").alias("bytes")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tid"), F.col(UID)]
    ranked = durable(numbered(with_uid(narrow), order, "rank").select("conv_id", "rank", "tid", "bytes"), "ranked-turns")
    first = durable(ranked.groupBy("conv_id").agg(F.min("rank").alias("first"), F.count("*").alias("n")), "conversations")
    return ranked.join(first, "conv_id").select("conv_id", (F.col("rank") - F.col("first")).alias("pos"), "tid", "bytes", "n")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first ``h`` turns of their family's first one, then go on with their own after ``h``.

    Returns (``conv_id``, ``n``) of every conversation, and (``conv_id``, ``pos``, ``tid``, ``bytes``); both written.
    """
    own = durable(ordered_turns(turns), "turns")
    size = own.where("pos = 0").select("conv_id", "n")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = (F.crc32(F.col("conv_id").cast("string")) % SHARED_TURNS).alias("h")
    convs = size.select("conv_id", "n", base.alias("base"), heads)
    convs = convs.join(size.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    convs = convs.withColumn("kept", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = durable(convs.select("conv_id", "base", "h", "kept", (F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "families")
    tail = own.drop("n").join(convs.select("conv_id", "h", "kept"), "conv_id").where("pos >= h")
    shared = own.where((F.col("pos") < SHARED_TURNS) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), "pos", "tid", "bytes")
    shared = shared.join(convs.select("base", "conv_id", "h"), "base").where("pos < h")
    rows = tail.select("conv_id", (F.col("pos") - F.col("h") + F.col("kept")).alias("pos"), "tid", "bytes").union(
        shared.select("conv_id", "pos", "tid", "bytes")
    )
    return convs.select("conv_id", "n"), durable(rows, "rebuilt")


def equal_sequences(convs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``rep``, ``n``, ``w``): the smallest member and the number of members of each distinct sequence; and the hashed lists
    of members (``end_rep``, ``ends_sha256``) of those with two or more.

    A sequence is told by its length and the xor of the digests of its (place, turn id) pairs, which partial sums build in any
    order.
    """
    pair = F.sha2(F.concat(F.encode(F.col("pos").cast("string"), "UTF-8"), F.lit(":").cast("binary"), F.col("tid")), 256)
    parts = [F.bit_xor(F.conv(F.substring("d", 15 * i + 1, 15), 16, 10).cast("long")).alias(x) for i, x in enumerate(_PARTS)]
    signs = rows.select("conv_id", pair.alias("d")).groupBy("conv_id").agg(*parts)
    zero = F.lit(0).cast("long")
    signed = convs.join(signs, "conv_id", "left").select("conv_id", "n", *[F.coalesce(x, zero).alias(x) for x in _PARTS])
    signed = durable(signed, "signed")
    key = ["n", *_PARTS]
    classes = durable(signed.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count("*").alias("w")), "classes")
    members = signed.join(classes.where("w > 1"), key).select("rep", "conv_id")
    return classes.select("rep", "n", "w"), durable(hashed_lists(members), "ends")


def hashed_lists(members: DataFrame) -> DataFrame:
    """(``rep``, ``conv_id``) -> (``end_rep``, ``ends_sha256``): SHA-256 of each list of numbers, ascending, comma-joined.

    Ranges of sorted numbers become pieces of PIECE_IDS numbers; a list's pieces are hashed in order as a stream.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(rep, held):
            return pa.RecordBatch.from_pylist([{"rep": rep, "first": held[0], "ids": ",".join(map(str, held))}], schema=schema)

        schema, now, held = pa.schema([("rep", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]), None, []
        for batch in batches:
            for rep, conv in zip(batch["rep"].to_pylist(), batch["conv_id"].to_pylist()):
                if held and (rep != now or len(held) == PIECE_IDS):
                    yield row(now, held)
                    held = []
                now = rep
                held.append(conv)
        if held:
            yield row(now, held)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(rep, digest):
            return pa.RecordBatch.from_pylist([{"end_rep": rep, "ends_sha256": digest.hexdigest()}])

        now, digest = None, None
        for batch in batches:
            for rep, ids in zip(batch["rep"].to_pylist(), batch["ids"].to_pylist()):
                if rep != now or digest is None:
                    if digest is not None:
                        yield row(now, digest)
                    now, digest = rep, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if digest is not None:
            yield row(now, digest)

    ranged = members.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id")
    short = durable(ranged.mapInArrow(pieces, "rep long, first long, ids string"), "pieces")
    dealt = short.repartition("rep").sortWithinPartitions("rep", "first")
    return dealt.select("rep", "ids").mapInArrow(digests, "end_rep long, ends_sha256 string")


def swept(rep_rows: list[tuple], head: int, depth: int) -> list[tuple]:
    """Nodes below ``head`` (of ``depth``) from its members' suffixes: [(rep, weight, [(turn id, bytes), ...]), ...], all distinct.

    Suffixes are sorted and read once; nodes that the next suffix does not share are closed and handed to their parents.
    """
    top = [None, depth, 0, 0, 0, 0, 0, None, 0, None]  # parent, depth, bytes, members, children, leaves, saved, end, its weight, smallest
    stack, closed, before = [top], [], []

    def close() -> None:
        node = stack.pop()
        up = node[0]
        node[5] = node[5] or 1
        node[6] += (node[3] - 1) * node[2]
        up[3] += node[3]
        up[4] += 1
        up[5] += node[5]
        up[6] += node[6]
        up[9] = node[9] if up[9] is None else min(up[9], node[9])
        closed.append(node)

    for rep, weight, suffix in sorted(rep_rows, key=lambda r: [t for t, _ in r[2]]):
        same = 0
        while same < min(len(before), len(suffix)) and before[same][0] == suffix[same][0]:
            same += 1
        while len(stack) > same + 1:
            close()
        for _, size in suffix[same:]:
            stack.append([stack[-1], stack[-1][1] + 1, size, 0, 0, 0, 0, None, 0, None])
        end = stack[-1]
        end[3] += weight
        end[7], end[8] = rep, weight
        end[9] = rep if end[9] is None else min(end[9], rep)
        before = suffix
    while len(stack) > 1:
        close()
    top[9] = head
    return [(n[9], n[1], n[0][9], n[3], n[4], n[5], n[6], n[7], n[8] or None) for n in closed]


def sweep_containers(rows: DataFrame) -> DataFrame:
    """``head``, ``depth``, ``rep``, ``w``, ``pos``, ``tid``, ``bytes`` -> the nodes below the heads, and ``top``: right below one.

    Containers are dealt to shards by their heads; a shard holds one container at a time.
    """

    names = [c.split()[0] for c in NODE.split(", ")]
    schema = pa.schema([(n, pa.int64()) for n in names] + [("top", pa.bool_())])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> list[dict]:
            return [dict(zip(names, n)) | {"top": n[1] == now[1] + 1} for n in swept(held, *now)]

        now, held, out = None, [], []
        for batch in batches:
            cells = zip(*(batch[c].to_pylist() for c in ("head", "depth", "rep", "w", "tid", "bytes")))
            for head, depth, rep, w, tid, size in cells:
                if now != (head, depth):
                    if held:
                        out += done()
                    now, held = (head, depth), []
                    if len(out) > BATCH_NODES:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                if not held or held[-1][0] != rep:
                    held.append((rep, w, []))
                held[-1][2].append((tid, size))
        if held:
            out += done()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    dealt = rows.repartition("head", "depth").sortWithinPartitions("head", "depth", "rep", "pos")
    return dealt.select("head", "depth", "rep", "w", "tid", "bytes").mapInArrow(sweep, NODE + ", top boolean")


def _chain(rows: DataFrame, saved: Column) -> DataFrame:
    last, first = F.col("pos") + 1 == F.col("n"), F.col("pos") == F.col("depth")
    parent = F.when(first, F.col("head")).otherwise(F.col("rep"))  # a sequence that ends at the head may have a smaller number
    end = lambda c: F.when(last, F.col(c))
    return rows.select(
        F.col("rep").alias("conv_id"), (F.col("pos") + 1).alias("depth"), parent.alias("parent_conv_id"), F.col("w").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens"),
        end("rep").alias("end_rep"), end("w").alias("end_weight"), first.alias("top"),
    )


def chains(rows: DataFrame) -> DataFrame:
    """Nodes of containers with one member: one for each of its turns.  Sizes to the end are summed by blocks, then inside them."""
    alone = _chain(rows.where("w = 1"), F.lit(0))
    copies = rows.where("w > 1").withColumn("block", F.floor(F.col("pos") / CHAIN_BLOCK))
    after = Window.partitionBy("rep").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = copies.groupBy("rep", "block").agg(F.sum("bytes").alias("s")).select("rep", "block", F.coalesce(F.sum("s").over(after), F.lit(0)).alias("later"))
    inside = F.sum("bytes").over(Window.partitionBy("rep", "block").orderBy(F.desc("pos")))
    summed = copies.withColumn("inside", inside).join(later, ["rep", "block"])
    return alone.union(_chain(summed, (F.col("w") - 1) * (F.col("inside") + F.col("later"))))


def _burst(members: DataFrame, rows: DataFrame, depth: int, container_rows: int) -> tuple[DataFrame, DataFrame]:
    """Members (``rep``, ``n``, ``w``, ``head``) of containers at ``depth`` -> the heads one turn deeper, and the members below these."""
    step = rows.where(F.col("pos") == depth).select(F.col("conv_id").alias("rep"), "tid", "bytes")
    moved = durable(members.join(step, "rep"), "burst")
    left = F.col("n") - depth - 1
    heads = moved.groupBy(F.col("head").alias("parent_conv_id"), "tid").agg(
        F.min("rep").alias("conv_id"), F.sum("w").alias("n_convs"), F.max("bytes").alias("bytes"),
        F.max(F.when(left == 0, F.col("rep"))).alias("end_rep"), F.max(F.when(left == 0, F.col("w"))).alias("end_weight"),
        F.sum(left).alias("turns"), F.sum(F.when(left > 0, 1).otherwise(0)).alias("open"),
    )
    heads = durable(heads, "heads")
    fate = F.when(F.col("open") == 1, "chain").when(F.col("turns") > container_rows, "burst").otherwise("sweep").alias("fate")
    names = heads.select(F.col("parent_conv_id").alias("head"), "tid", F.col("conv_id").alias("next"), fate)
    below = moved.where(left > 0).join(names, ["head", "tid"]).select("rep", "n", "w", F.col("next").alias("head"), "fate")
    return heads, durable(below, "members")


def _totalled(heads: DataFrame, below: DataFrame) -> DataFrame:
    """Heads of one depth with the totals of their subtrees; ``below``: nodes one turn deeper."""
    sums = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(
        F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    sums = durable(sums, "sums")
    zero = F.lit(0).cast("long")
    own = (F.col("n_convs") - 1) * F.col("bytes")
    full = heads.join(sums, "conv_id", "left").withColumn("depth", F.col("depth").cast("long"))
    full = full.withColumn("n_children", F.coalesce("n_children", zero)).withColumn("n_leaves", F.coalesce("n_leaves", zero + 1))
    return durable(full.withColumn("saved_tokens", F.coalesce("saved_tokens", zero) + own).select(*[c.split()[0] for c in NODE.split(", ")]), "totals")


def trie_nodes(convs: DataFrame, rows: DataFrame, container_rows: int = CONTAINER_ROWS) -> tuple[DataFrame, DataFrame]:
    """All nodes of the trie over sequences (``convs``: ``conv_id``, ``n``; ``rows``: ``conv_id``, ``pos``, ``tid``, ``bytes``; written).

    Returns the nodes (columns of NODE: ``end_rep`` and ``end_weight`` tell the sequence that ends there) and the hashed lists of
    members of sequences with two or more.
    """
    classes, ends = equal_sequences(convs, rows)
    # by place in each file, so that a burst reads the pages of one depth only
    kept = rows.join(classes.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi")
    kept = durable(kept.sortWithinPartitions("pos"), "sequences")
    root = classes.agg(
        F.min("rep").alias("conv_id"), F.sum("w").alias("n_convs"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.max(F.when(F.col("n") == 0, F.col("rep"))).alias("end_rep"),
        F.max(F.when(F.col("n") == 0, F.col("w"))).alias("end_weight"), F.sum("n").alias("turns"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("open"),
    )
    root = durable(root.where("conv_id is not null"), "root")
    found = root.first()
    levels, settled, depth = [root.drop("turns", "open")], [], 0
    if found and found.open:
        fate = "chain" if found.open == 1 else "burst" if found.turns > container_rows else "sweep"
        members = classes.where("n > 0").select("rep", "n", "w", F.lit(found.conv_id).alias("head"), F.lit(fate).alias("fate"))
        settled.append(members.where("fate <> 'burst'").withColumn("depth", F.lit(0).cast("long")))
        while members.where("fate = 'burst'").limit(1).count():
            heads, members = _burst(members.where("fate = 'burst'").drop("fate"), kept, depth, container_rows)
            depth += 1
            levels.append(heads.select("conv_id", "n_convs", "bytes", F.lit(depth).cast("long").alias("depth"), "parent_conv_id", "end_rep", "end_weight"))
            settled.append(members.where("fate <> 'burst'").withColumn("depth", F.lit(depth).cast("long")))
    nodes = None
    if settled:
        held = settled[0]
        for more in settled[1:]:
            held = held.union(more)
        held = durable(held, "settled")
        suffixes = kept.join(held.withColumnRenamed("rep", "conv_id"), "conv_id").where("pos >= depth").withColumnRenamed("conv_id", "rep")
        suffixes = durable(suffixes, "suffixes")
        nodes = sweep_containers(suffixes.where("fate = 'sweep'")).union(chains(suffixes.where("fate = 'chain'")))
        nodes = durable(nodes, "nodes")
    out, below = nodes.drop("top") if nodes is not None else None, None
    for at in range(depth, -1, -1):
        under = [x for x in (nodes.where(F.col("top") & (F.col("depth") == at + 1)) if nodes is not None else None, below) if x is not None]
        if not under:
            under = [durable(root.where("false").select(F.lit(0).cast("long").alias("parent_conv_id"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")), "none")]
        wanted = [x.select("parent_conv_id", "n_leaves", "saved_tokens") for x in under]
        below = _totalled(levels[at], wanted[0].union(wanted[1]) if len(wanted) > 1 else wanted[0])
        out = below if out is None else out.unionByName(below)
    return out, ends


def prefix_trie(turns: DataFrame, container_rows: int = CONTAINER_ROWS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    A null role or text is empty; turns without a number come first; rows without ``conv_id`` are left out; repeated rows are
    turns of their own; extra columns are not read.  Equal numbers are ordered by the digest of role and text.  An empty
    table has no node, since a root has a member.
    """
    nodes, ends = trie_nodes(*rebuilt(turns), container_rows)
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    alone = F.when(F.col("end_rep").isNull(), F.lit(NO_ENDS)).otherwise(F.sha2(F.col("end_rep").cast("string"), 256))
    few = nodes.where("end_rep is null or end_weight = 1").select(*shown, alone.alias("ends_sha256"))
    many = nodes.where("end_weight > 1").join(ends, "end_rep").select(*shown, "ends_sha256")
    return few.union(many)
