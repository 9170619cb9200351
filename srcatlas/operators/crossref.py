"""References between files: in how many other files of the repository does a file's stem occur?

The rule is a substring test (``main`` is found in ``domain``), case-sensitive, each other file once.
Comparing every file with every other one is quadratic in a repository, so the test is turned into
equality joins that give the same numbers:

* A stem made of word characters can only occur inside one run of word characters.  Every place in a file's distinct runs is
  tested by its first few characters, once per class of stem lengths (PREFIXES), against a filter of the repository's stems
  (bits, one for each prefix).  What passes, with the text that follows as far as the longest stem of the class, meets the
  stems by equality of the prefix, and those that it begins with are in the file.
* Any other stem has a first character that is no word character: its anchor (``-`` in ``user-service``).  It is
  met only at the anchors of that kind: the word characters before the anchor and the text after it give one
  candidate for each place and length that the repository's stems with this anchor have.  Without white space in
  the stem, distinct runs of non-blank characters are enough; with it, whole texts are read, once.
* The empty stem (a file named ``.py``) occurs in every file: a row count.

Then ``imported_by = files holding the stem - 1 if the file holds its own``.  No pair of files is formed, and a
repository with unusual names costs the others nothing.

Small tables (stems, lengths, anchors) are written to the shared folder, so the planner knows their size and
sends them to every task only if they are small.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcatlas.functions.text import stem
from srcatlas.operators.skew import hot_keys, salted_join
from srcatlas.session import bounded_batches, durable

# Word characters: ASCII letters, digits, underscore and everything beyond ASCII.
_WORD = r"[A-Za-z0-9_\x{80}-\x{10FFFF}]"
_IS_WORD = np.array([chr(c).isalnum() or c == ord("_") for c in range(128)] + [True])
#: Longer runs are cut into windows of this many characters, overlapping by the longest stem.
WINDOW = 256
#: Stems are looked up by so many first characters: the largest of these that they have.
PREFIXES = (1, 2, 3, 4, 8)
#: Bits a prefix in the filter of its repository, and the largest filter in words of 64 bits (1 MB; it is read where it was sent, not copied with rows).
BITS_PER_PREFIX = 16
MAX_WORDS = 1 << 17


def _kind(base: Column) -> Column:
    """``word``, ``mixed`` (no white space), ``spaced`` or ``empty``; a column of its own, so no join key carries the pattern."""
    return (
        F.when(base == "", "empty").when(base.rlike(f"^{_WORD}+$"), "word").when(base.rlike(r"\s"), "spaced").otherwise("mixed")
    )


def _windows(text: Column, overlap: Column) -> Column:
    """``text`` cut into windows: every substring of up to ``overlap + 1`` characters starts in one window
    and lies within it.  Two linear passes of a pattern."""
    body = f"(?s).{{1,{WINDOW}}}"
    return F.zip_with(
        F.regexp_extract_all(text, F.lit(body), F.lit(0)),
        F.regexp_extract_all(text, F.concat(F.lit(f"{body}(?=(.{{0,"), overlap.cast("string"), F.lit("}))")), F.lit(1)),
        lambda head, tail: F.concat(head, tail),
    )


def _bit(q: Column, prefix: Column, words: Column) -> Column:
    """The place of a prefix in its repository's filter of ``words`` times 64 bits."""
    return F.pmod(F.xxhash64(q, prefix), words.cast("long") * 64)


def prefix_filters(anchors: DataFrame) -> DataFrame:
    """``repo, classes array<struct<q,width>>, bits``: the classes of a repository's stems with the longest stem of each, and a
    bit set for each prefix.

    A filter has ``BITS_PER_PREFIX`` bits a prefix and ``MAX_WORDS`` words of 64 bits at most; beyond that more prefixes
    pass that meet nothing in the join that follows, and no prefix is lost.
    """
    per_class = anchors.groupBy("repo", "q").agg(F.max(F.char_length("base")).alias("width"), F.count_distinct("prefix").alias("n"))
    sizes = per_class.groupBy("repo").agg(
        F.array_sort(F.collect_list(F.struct("q", "width"))).alias("classes"),
        F.least(F.ceil(F.sum("n") * BITS_PER_PREFIX / 64), F.lit(MAX_WORDS)).cast("int").alias("words"),
    )
    places = anchors.join(sizes, "repo").select("repo", _bit(F.col("q"), F.col("prefix"), F.col("words")).alias("bit"))
    mark = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    marked = places.groupBy("repo", F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(mark).alias("marks"))
    every = sizes.withColumn("word", F.explode(F.sequence(F.lit(0), F.col("words") - 1)))
    cells = every.join(marked, ["repo", "word"], "left").withColumn("marks", F.coalesce("marks", F.lit(0)))
    in_order = F.array_sort(F.collect_list(F.struct("word", "marks")))
    return cells.groupBy("repo").agg(F.first("classes").alias("classes"), F.transform(in_order, lambda c: c["marks"]).alias("bits"))


def prefix_rows(runs: DataFrame, anchors: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """``repo, path, q, piece`` of word runs (``repo, path, run``): at most one row for each place and class of lengths that the
    repository's stems have, whatever the number of lengths, and hardly any whose prefix no stem has.

    No text is shuffled for it, but where there are so many filters that they are not broadcast; a repository may hold most
    runs, so the join is salted (``hot`` as in ``salted_join``).
    """
    filters = durable(prefix_filters(anchors), "prefix-filters")
    longest = anchors.agg(F.max(F.char_length("base"))).first()[0] or 0  # a file system bounds the length of a name
    whole = F.array(F.struct(F.col("run").alias("window"), F.char_length("run").alias("starts")))
    cut = F.transform(_windows(F.col("run"), F.lit(longest)), lambda w: F.struct(w.alias("window"), F.least(F.lit(WINDOW), F.char_length(w)).alias("starts")))
    windows = runs.select("repo", "path", F.inline(F.when(F.char_length("run") > WINDOW, cut).otherwise(whole)))
    met = salted_join(windows, filters, ["repo"], ["path", "window"], hot=hot, written="filters-by-salt")

    # one row a place, in generated code: the filter's bits are read where they lie, not copied
    room = F.least("starts", F.char_length("window") - F.col("q") + 1)
    places = met.select("repo", "path", "window", "starts", "bits", F.inline("classes")).where(room > 0)
    places = places.select("repo", "path", "window", "q", "width", "bits", F.explode(F.sequence(F.lit(1), room)).alias("at"))
    bit = _bit(F.col("q"), F.substring("window", F.col("at"), F.col("q")), F.size("bits"))
    known = F.getbit(F.get("bits", F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1
    return places.where(known).select("repo", "path", "q", F.substring("window", F.col("at"), F.col("width")).alias("piece"))


def _word_hits(files: DataFrame, stems: DataFrame) -> DataFrame:
    """``repo, base, path`` for stems of word characters, with repeats."""
    n = F.char_length("base")
    q = reduce(lambda rest, c: F.when(n >= c, c).otherwise(rest), PREFIXES[1:], F.lit(PREFIXES[0]))
    anchors = durable(stems.select("repo", "base", q.alias("q"), F.substring("base", F.lit(1), q).alias("prefix")), "prefix-anchors")
    hot = hot_keys(files.groupBy("repo").agg(F.sum(F.size("runs")).alias("n")), ["repo"], "n")
    rows = durable(prefix_rows(files.select("repo", "path", F.explode("runs").alias("run")), anchors, hot), "prefix-hits")
    rows = rows.withColumn("prefix", F.left("piece", F.col("q")))
    # a prefix may be in most files of a repository
    met = salted_join(rows, anchors, ["repo", "q", "prefix"], ["path"], written="anchors-by-salt")
    return met.where(F.startswith("piece", "base")).select("repo", "base", "path")


def _anchored(stems: DataFrame) -> DataFrame:
    """``repo, anchor, tail, places``: the places and lengths of a repository's stems with this anchor, written."""
    before = F.regexp_extract("base", f"^({_WORD}*)", 1)
    cells = stems.select(
        "repo", F.char_length(before).alias("o"), F.substring("base", F.char_length(before) + 1, F.lit(1)).alias("anchor"), F.char_length("base").alias("n")
    )
    after = F.max(F.col("n") - F.col("o") - 1).alias("tail")
    return durable(cells.groupBy("repo", "anchor").agg(after, F.collect_set(F.struct("o", "n")).alias("places")), "anchors")


def _candidates(text: Column) -> Column:
    """Distinct substrings of ``text`` around its anchors: columns ``anchor``, ``tail`` and ``places`` say which."""
    mark = F.concat(F.lit("\\Q"), "anchor", F.lit("\\E"))
    heads = F.regexp_extract_all(text, F.concat(F.lit(f"(?<!{_WORD})({_WORD}*+)"), mark), F.lit(1))
    rest = F.concat(F.lit("(?s)"), mark, F.lit("(?=(.{0,"), F.col("tail").cast("string"), F.lit("}))"))
    tails = F.regexp_extract_all(text, rest, F.lit(1))

    def around(head: Column, tail: Column) -> Column:
        fits = F.filter("places", lambda s: (s["o"] <= F.char_length(head)) & (s["n"] - s["o"] - 1 <= F.char_length(tail)))
        return F.transform(fits, lambda s: F.concat(F.right(head, s["o"]), "anchor", F.left(tail, s["n"] - s["o"] - 1)))

    return F.array_distinct(F.flatten(F.zip_with(heads, tails, around)))


def _mixed_hits(texts: DataFrame, stems: DataFrame) -> DataFrame:
    """``repo, base, path`` for stems with other characters but no white space, with repeats."""
    marks = _anchored(stems)
    runs = F.filter(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), lambda r: F.contains(r, F.col("anchor")))
    per_file = texts.join(marks.select("repo", "anchor"), "repo").where(F.contains("text", F.col("anchor")))
    per_file = durable(per_file.select("repo", "path", "anchor", F.explode(F.array_distinct(runs)).alias("run")), "anchored-runs")
    vocabulary = durable(per_file.groupBy("repo", "anchor", "run").agg(F.count(F.lit(1)).alias("files")), "vocabulary")
    pieces = vocabulary.join(marks, ["repo", "anchor"]).select("repo", "anchor", "run", F.explode(_candidates(F.col("run"))).alias("base"))
    found = pieces.join(stems, ["repo", "base"])
    key = ["repo", "anchor", "run"]
    return salted_join(per_file, found, key, ["path"], hot=hot_keys(vocabulary, key, "files")).select("repo", "base", "path")


def pieces_of_text(text: str, anchor: str, places: list[dict]) -> list[str]:
    """``_candidates`` of a whole text: the distinct substrings that have ``anchor`` at place ``o`` of ``n``, word characters before it."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.flatnonzero(codes == ord(anchor))
    breaks = np.concatenate([[-1], np.flatnonzero(~_IS_WORD[np.minimum(codes, 128)])])
    before = at - breaks[np.searchsorted(breaks, at) - 1] - 1  # word characters right before each anchor
    found: set[str] = set()
    for place in places:
        starts = at[before >= place["o"]] - place["o"]
        starts = starts[starts + place["n"] <= len(codes)]
        if place["n"] <= 3 < len(starts):  # three code points fit a number, so repeats go before any text is made
            keys = reduce(lambda key, k: key << 21 | codes[starts + k], range(place["n"]), np.zeros(len(starts), np.int64))
            starts = starts[np.unique(keys, return_index=True)[1]]
        found.update(text[s : s + place["n"]] for s in starts.tolist())
    return list(found)


def _pieces(texts: pa.Array, anchors: pa.Array, places: pa.Array) -> pa.Array:
    rows = zip(texts, anchors.to_pylist(), places)
    return pa.array([pieces_of_text(text.as_py(), anchor, spots.as_py()) for text, anchor, spots in rows], pa.list_(pa.string()))


def _spaced_hits(texts: DataFrame, stems: DataFrame) -> DataFrame:
    """``repo, base, path`` for stems with white space."""
    marked = texts.join(_anchored(stems), "repo").where(F.contains("text", F.col("anchor")))
    bounded_batches(texts.sparkSession)
    found = F.arrow_udf(_pieces, T.ArrayType(T.StringType()))("text", "anchor", "places")
    pieces = marked.select("repo", "path", F.explode(found).alias("base"))
    return pieces.join(stems, ["repo", "base"]).select("repo", "base", "path")


def add_imported_by(rows: DataFrame) -> DataFrame:
    """Replace ``text`` by ``imported_by``; every other column of the file stays.

    Many files may share a stem (``index``, ``__init__``), so the counts come back by a salted join.
    """
    kept = [c for c in rows.columns if c != "text"]
    base = stem(F.col("path"))
    files = durable(
        rows.select(
            *kept,
            base.alias("base"),
            _kind(base).alias("kind"),
            F.contains("text", base).cast("int").alias("_own"),
            F.array_distinct(F.regexp_extract_all("text", F.lit(f"{_WORD}+"), F.lit(0))).alias("runs"),
        ),
        "file-runs",
    )
    kinds = {r.kind for r in files.select("kind").distinct().collect()}  # at most four rows
    texts = rows.select("repo", "path", "text")
    counts = files.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).select("repo", F.lit("").alias("base"), "n")
    for kind, hits in (("word", _word_hits), ("mixed", _mixed_hits), ("spaced", _spaced_hits)):
        if kind in kinds:
            stems = durable(files.where(F.col("kind") == kind).select("repo", "base").distinct(), "stems")
            found = hits(files if kind == "word" else texts, stems)
            counts = counts.unionByName(found.groupBy("repo", "base").agg(F.count_distinct("path").alias("n")))

    joined = salted_join(files.drop("runs", "kind"), counts, ["repo", "base"], ["path"], how="left")
    return joined.withColumn("imported_by", F.coalesce(F.col("n") - F.col("_own"), F.lit(0)).cast("long")).drop(
        "base", "_own", "n"
    )


def imported_by(texts: DataFrame) -> DataFrame:
    """``repo, path, imported_by`` for every file."""
    return add_imported_by(texts.select("repo", "path", "text"))
