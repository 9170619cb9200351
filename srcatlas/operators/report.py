"""Report rows: context, structure, dependencies and key files of each repository.

A report is a table of lines (``repo, section, block, item, line_no, text``) that is read in the order of
its first five columns.  It is never gathered per repository, so one repository may hold most files.
``prompt_parts`` assembles lines into texts of bounded size for a text generator.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.functions.tables import EXCERPT_BYTES, EXCERPT_HALF, EXCERPT_LINES, EXCERPT_MARK
from srcatlas.functions.text import byte_len, lines_of
from srcatlas.operators.deps import deps_report
from srcatlas.operators.structure import DISPLAY_GLUE, dir_listing, repo_overview
from srcatlas.session import durable

ORDER = ("repo", "section", "block", "item", "line_no")
OPENING, CONTEXT, STRUCTURE, DEPENDENCIES, KEY_FILES, CLOSING = range(1, 7)
#: Bytes of one part of a prompt.
PART_BYTES = 1 << 16
#: Block of the lines that follow the context.
APPROACH = "approach"

# Headings and labels of a report.
CONTEXT_HEADING = "Codebase Context:"
CONTEXT_LABELS = ["- Primary Languages: ", "- Total Files: ", "- Total Lines of Code: "]
HEADINGS = {STRUCTURE: "Codebase structure:", DEPENDENCIES: "Project Dependencies:", KEY_FILES: "Key files content:"}


#: Lines of a prompt: section, block within it, texts.
Prose = list[tuple[int, str, list[str]]]


@dataclass(frozen=True)
class PromptTemplate:
    """Lines around a report that make a prompt of it.  Callers with a model of their own bring their own lines.

    ``opening`` says what is wanted for each detail (an unknown one counts as standard), ``approach`` how to read the report,
    ``example`` shows an answer unless the detail is brief, ``sections`` lists an answer's parts, with ``metrics`` as one more if
    measures are wanted, and ``review`` is what to check at the end.
    """

    opening: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "brief": ("Task: say in at most two paragraphs what this repository is for and how it is laid out.",),
            "standard": (
                "Task: describe this repository for an engineer who is about to work on it.",
                "Cover its purpose, its parts and how they meet, in about a page.",
            ),
            "comprehensive": (
                "Task: write a full description of this repository for the people who will maintain it.",
                "Go through every part that the report shows, with its duties, its interfaces and what it depends on.",
            ),
        }
    )
    approach: tuple[str, ...] = (
        "How to read the report:",
        "- Take the directory listing for the outline, then the key files for the detail; the importance value orders them.",
        "- Take names of libraries from the dependencies only.",
        "- Where an excerpt was cut, say what can be told from its two ends and no more.",
    )
    example: tuple[str, ...] = (
        "Example of the style (another repository):",
        "  Purpose: `relay` copies orders from a queue into a ledger, at least once each.",
        "  Parts: `cmd/relay.go` starts the workers; `internal/ledger` owns the tables and is the only writer.",
    )
    sections: tuple[str, ...] = (
        "Sections of the answer:",
        "1. Purpose and users",
        "2. Parts and their duties, by path",
        "3. How data and calls pass between the parts",
        "4. Dependencies and what each is used for",
    )
    metrics: tuple[str, ...] = ("5. Size and weight: what the line counts and importance values above say about where the work lies",)
    review: tuple[str, ...] = (
        "Before you answer, check:",
        "- every path you name stands in the report",
        "- nothing is claimed that the report leaves open",
        "- the answer is as long as was asked for",
    )

    def lines(self, detail: str, metrics: bool) -> Prose:
        opening = self.opening.get(detail, self.opening["standard"])
        closing = [("1", () if detail == "brief" else self.example), ("2", (*self.sections, *(self.metrics if metrics else ()))), ("3", self.review)]
        found = [(OPENING, "", opening), (CONTEXT, APPROACH, self.approach), *((CLOSING, block, texts) for block, texts in closing)]
        return [(section, block, list(texts)) for section, block, texts in found if texts]


def fixed2(x: Column) -> Column:
    """A non-negative number with two decimals, rounded on its exact binary value (half to even).

    Java's own formatter rounds the shortest decimal form instead, which differs on values such as 0.145.
    """
    # The fraction as a whole number of units of 2**-56, or of 2**-60 where the number is below 1/16.  That
    # is exact from 2**-8 on, anything smaller rounds to zero, and a hundred times it fits a long.
    unit = F.when(x < 0.0625, F.lit(2**60)).otherwise(F.lit(2**56))
    whole = F.floor(x)
    product = F.floor((x - whole) * unit) * 100
    hundredths = F.floor(product / unit)
    # The quotient was a double and may be off by one at a boundary.
    q = hundredths + F.when(product < hundredths * unit, -1).when(product >= (hundredths + 1) * unit, 1).otherwise(0)
    twice = (product - q * unit) * 2
    up = (twice > unit) | ((twice == unit) & (q % 2 == 1))
    total = whole * 100 + q + up.cast("int")
    return F.format_string("%d.%02d", F.floor(total / 100), total % 100)


def excerpt(text: Column, detail: str) -> Column:
    """A long text of many lines is cut to its first and last lines, unless all detail is wanted."""
    if detail == "comprehensive":
        return text

    def cut(lines: Column) -> Column:
        ends = F.concat(
            F.array_join(F.slice(lines, 1, EXCERPT_HALF), "\n"),
            F.lit(f"\n{EXCERPT_MARK}\n"),
            F.array_join(F.slice(lines, -EXCERPT_HALF, EXCERPT_HALF), "\n"),
        )
        return F.when(F.size(lines) > EXCERPT_LINES, ends)

    # The lines are bound by a lambda, so a text is split once, and only if it is large.
    shortened = F.transform(F.array(lines_of(text)), cut)[0]
    return F.when(byte_len(text) > EXCERPT_BYTES, F.coalesce(shortened, text)).otherwise(text)


def key_file_excerpt(key_files: DataFrame, by_file: DataFrame, detail: str = "standard") -> DataFrame:
    """``repo, rank, path, score, header, excerpt``.

    The key files are written out, so their size is known when the join is planned: a small table goes to every
    task and the texts are filtered where they are, a large one is joined by file.
    """
    chosen = durable(key_files, "key-files")
    text = F.array_join("chunks", DISPLAY_GLUE)
    header = F.concat(F.lit("--- "), "path", F.lit(" (Importance: "), fixed2(F.col("score")), F.lit(") ---"))
    return by_file.select("repo", "path", "chunks").join(chosen, ["repo", "path"]).select(
        "repo", "rank", "path", "score", header.alias("header"), excerpt(text, detail).alias("excerpt")
    )


def _rows(df: DataFrame, section: int, block: Column, item: Column, line_no: Column, text: Column) -> DataFrame:
    return df.select(
        "repo",
        F.lit(section).alias("section"),
        block.alias("block"),
        item.alias("item"),
        line_no.cast("int").alias("line_no"),
        text.alias("text"),
    )


def _frame(overview: DataFrame, prose: Prose) -> DataFrame:
    """Lines that every repository has once: context, headings and, for a prompt, its opening and closing."""
    context = [
        F.lit(CONTEXT_HEADING),
        *[F.concat(F.lit(label), F.col(c).cast("string")) for label, c in zip(CONTEXT_LABELS, ("languages", "files", "loc"))],
    ]
    headings = [(section, "", [text]) for section, text in HEADINGS.items()]
    cells = [(CONTEXT, "", i, text) for i, text in enumerate(context)]
    cells += [(section, block, i, F.lit(t)) for section, block, texts in [*headings, *prose] for i, t in enumerate(texts)]
    table = F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(block).alias("block"), F.lit(i).alias("line_no"), text.alias("text")) for s, block, i, text in cells
    ])
    return overview.select("repo", F.inline(table)).select("repo", "section", "block", F.lit("").alias("item"), "line_no", "text")


def report(
    structure: DataFrame,
    by_file: DataFrame,
    excerpts: DataFrame,
    around: Prose = (),
) -> DataFrame:
    """All lines of a report; with ``around`` (``PromptTemplate.lines``) also what makes a prompt of it."""
    frame = _frame(repo_overview(structure), list(around))
    listing = _rows(dir_listing(structure), STRUCTURE, F.col("dir"), F.col("path"), F.lit(0), F.col("line"))
    deps = _rows(
        deps_report(by_file), DEPENDENCIES, F.col("block").cast("string"), F.lit(""), F.col("pos"), F.col("line")
    )
    rank = F.lpad(F.col("rank").cast("string"), 3, "0")
    body = F.posexplode(F.array("header", "excerpt")).alias("line_no", "text")
    files = excerpts.select(
        "repo", F.lit(KEY_FILES).alias("section"), rank.alias("block"), F.col("path").alias("item"), body
    )
    return frame.unionByName(listing).unionByName(deps).unionByName(files)


def prompt_parts(lines: DataFrame, max_bytes: int = PART_BYTES) -> DataFrame:
    """``repo, part, prompt``: each repository's lines in order, joined into texts of bounded size.

    A part takes the lines that start within its ``max_bytes`` of the whole, so joining the parts gives
    the whole prompt however large it is.  Offsets come from a running total in two steps: within the
    ranges of a range-partitioned copy, and over the sums of those ranges.  So no task sees more than one
    range of a repository.  The copy is written out, which fixes its range numbers.
    """
    ranged = lines.repartitionByRange(*ORDER).withColumn("_range", F.spark_partition_id())
    fixed = durable(ranged, "prompt-lines").withColumn("_bytes", byte_len(F.col("text")).cast("long") + 1)
    sums = fixed.groupBy("repo", "_range").agg(F.sum("_bytes").alias("_n"))
    earlier = Window.partitionBy("repo").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("repo", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("repo", "_range").orderBy(*ORDER[1:])
    start = F.col("_offset") + F.col("_run") - F.col("_bytes")
    placed = (
        fixed.withColumn("_run", F.sum("_bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(offsets, ["repo", "_range"])
        .withColumn("part", F.floor(start / max_bytes).cast("int"))
    )
    gathered = F.sort_array(F.collect_list(F.struct(*ORDER[1:], "text")))
    return placed.groupBy("repo", "part").agg(F.array_join(gathered["text"], "\n").alias("prompt"))
