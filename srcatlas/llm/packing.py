"""Packing into windows by minimum bin slack.

Documents longer than a window are cut into full windows and one remainder.  Remainders are counted by length (at most
SEQUENCE - 1 numbers), and the driver plans windows over these counts: the longest remaining length opens a window, and a
bitset subset-sum (a bit per reachable fill) over the remaining lengths, longest first, finds the fill closest to the
capacity; going back through the steps gives how often each length is used.  The window is planned as often as the counts
allow, so the plan is short whatever the number of documents.  Tasks number the pieces of each length as they make them, and
pieces look up their place in the plan by that number and the counts of the tasks before.
"""

from __future__ import annotations

import base64
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.llm.common import UID, whole_text, with_uid
from srcatlas.session import durable

SEQUENCE = 1024
END_ID = 0
#: Text whose distinct words are encoded together, and how many at a time.
SLICE_BYTES = 32 << 20
WORDS_AT_ONCE = 20_000
END = struct.pack("<I", END_ID)

PLAN = "length int, lo long, hi long, sequence long, offset long"


def best_fill(counts: list[int], opener: int, capacity: int) -> dict[int, int]:
    """Of each length, how many go into a window opened by ``opener``: the fill is the closest to ``capacity`` there is."""
    reach, steps = 1 << opener, []
    limit, goal = (1 << capacity + 1) - 1, 1 << capacity
    for length in range(min(opener, capacity - opener), 0, -1):
        left, power = counts[length] - (length == opener), 1
        left = min(left, (capacity - opener) // length)
        while left > 0 and not reach & goal:
            take = min(power, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & limit
            left, power = left - take, power * 2
        if reach & goal:
            break
    used, fill = {opener: 1}, reach.bit_length() - 1
    for length, take, before in reversed(steps):
        if not before >> fill & 1:
            used[length] = used.get(length, 0) + take
            fill -= length * take
    return used


def plan_windows(counts: dict[int, int], capacity: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(length, from rank, to rank, sequence of the first, offset) for every place of every planned window."""
    left, placed, plan, sequence = [0] * (capacity + 1), [0] * (capacity + 1), [], 0
    for length, n in counts.items():
        left[length] = n
    for opener in range(capacity, 0, -1):
        while left[opener]:
            used = best_fill(left, opener, capacity)
            times = min(left[k] // n for k, n in used.items())
            offset = 0
            for length in sorted(used, reverse=True):
                for _ in range(used[length]):
                    plan.append((length, placed[length], placed[length] + times, sequence, offset))
                    placed[length] += times
                    offset += length
                left[length] -= used[length] * times
            sequence += times
    return plan


class ByteBpe:
    """Ids of many texts at once: every distinct word of a slice of texts is encoded once, ids are gathered with numpy.

    The vocabulary's pattern begins a new piece at every space that stands between two characters other than white space,
    so a text has the ids of "first", " second", " third" ... one after the other.  A space next to white space belongs
    to a run that the pattern takes as a whole: texts that have one are encoded as a whole.

    ``tiktoken`` gives the ids that ``tokenizers`` gives with ``add_special_tokens=False`` (tested), in a third of the
    time.  Strings of the tokens added in the vocabulary's JSON form have their own ids; texts with one are encoded as a whole.
    """

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as file:
            self.added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
        encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
        self.encode, self.encode_added = encoding.encode_ordinary, lambda text: encoding.encode(text, allowed_special="all")
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.widths[list(ranks.values())] = [len(token) for token in ranks]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each after a space, and where each word's begin (one more at the end)."""
        parts, bounds, done = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)], 0
        for low in range(0, len(words), WORDS_AT_ONCE):
            text = " " + " ".join(words[low : low + WORDS_AT_ONCE].to_pylist())
            ids = np.array(self.encode(text), "<u4")
            spaces = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 32)
            parts.append(ids)
            bounds.append(np.append(np.searchsorted(np.cumsum(self.widths[ids]), spaces[1:], "right"), len(ids)) + done)
            done += len(ids)
        return np.concatenate(parts), np.concatenate(bounds)

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without an end id."""
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        index, offsets = coded.indices.to_numpy(), split.offsets.to_numpy() - split.offsets[0].as_py()
        plain = pc.and_(pc.equal(pc.utf8_trim_whitespace(coded.dictionary), coded.dictionary), pc.not_equal(coded.dictionary, ""))
        plain = plain.to_numpy(zero_copy_only=False)
        ids, bounds = self._words(pc.if_else(plain, coded.dictionary, "-"))
        odd = np.concatenate([[0], np.cumsum(~plain[index])])
        whole = odd[offsets[1:]] > odd[offsets[:-1]]
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        step = np.diff(bounds)
        for doc, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if whole[doc]:
                yield np.array(self.encode_added(texts[doc].as_py()), "<u4").tobytes()
                continue
            first = np.array(self.encode(coded.dictionary[index[low]].as_py()), "<u4").tobytes()
            used = index[low + 1 : high]
            n = step[used]
            at = np.repeat(bounds[used] - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield first + ids[at].tobytes()


def token_pieces(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most SEQUENCE ids: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` (and ``ids``),
    with ``nth``: its number from 0 among the pieces of that length which its task has made.

    A null text is empty and has the end id only.
    """
    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, nth long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteBpe(tokenizer_path)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        made = [0] * (SEQUENCE + 1)
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for part in _slices(batch):
                rows = [[] for _ in names]
                for doc_id, ids in zip(part["doc_id"].to_pylist(), tokenizer.texts(part["text"])):
                    ids += END
                    total = len(ids) // 4
                    for start in range(0, total, SEQUENCE):
                        piece = ids[4 * start : 4 * (start + SEQUENCE)]
                        length = len(piece) // 4
                        for column, value in zip(rows, (doc_id, start, length, zlib.crc32(piece), total, made[length], piece)):
                            column.append(value)
                        made[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names)

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(cut, schema)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of some SLICE_BYTES of text, at least one row each."""
    sizes, low, held = pc.binary_length(batch["text"]).to_pylist(), 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= SLICE_BYTES or i + 1 == len(sizes):
            yield batch.slice(low, i + 1 - low)
            low, held = i + 1, 0


def packed(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: pieces of a sequence follow one another from 0 without gaps.

    Repeated rows and rows without ``doc_id`` are packed like others.  An empty table gives no rows.
    """
    pieces = durable(with_uid(token_pieces(docs, tokenizer_path, with_ids)).withColumn("part", F.shiftright(UID, 33)).drop(UID), "pieces")
    made = durable(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most SEQUENCE rows
    plan = docs.sparkSession.createDataFrame(plan_windows(counts) or [(0, 0, 0, 0, 0)], PLAN)
    # a piece's rank among those of its length: pieces of the tasks before its own, then its number in its task
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = durable(made.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "firsts")
    ranked = pieces.join(firsts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("nth"))
    place = (ranked["length"] == plan["length"]) & (ranked["rank"] >= plan["lo"]) & (ranked["rank"] < plan["hi"])
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    return ranked.join(F.broadcast(plan), place).select(
        *[ranked[c].cast("long").alias(c) if c == "length" else ranked[c] for c in out],
        (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"),
        F.col("offset"),
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """Pieces with ``ids`` -> ``sequence_id``, ``ids`` (one binary of unsigned 32-bit numbers, not padded), ``n_tokens``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most SEQUENCE ids
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))
