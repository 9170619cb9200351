"""Importance of a file: imports, telling patterns, references by other files, place and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.functions.tables import TOP_FILES, TOP_FILES_OTHERWISE
from srcatlas.functions.text import depth, line_count
from srcatlas.operators.crossref import add_imported_by

# Patterns and weights.  White space is ASCII without the vertical tab, and "any character"
# stops at a line feed only; Java's \s and . differ from that, so both are spelled out.
_S = r"[\t\n\f\r ]"
IMPORT_PATTERNS = {
    (".go",): [rf"import{_S}+\(([^)]*)\)", rf'import{_S}+"[^"]+"'],
    (".js", ".ts"): [rf"import{_S}+[^\n]*{_S}+from{_S}+['\"]", r"require\(['\"]"],
    (".py",): [rf"import{_S}+[a-zA-Z0-9_]+", rf"from{_S}+[a-zA-Z0-9_]+{_S}+import"],
    (".java",): [rf"import{_S}+[a-zA-Z0-9_.]+;"],
}
SCORE_PATTERNS = {
    (".go",): [(rf"type{_S}+[A-Z][a-zA-Z0-9_]*{_S}+interface", 2.0), (rf"func{_S}+main\(", 5.0)],
    (".java",): [
        (rf"interface{_S}+[A-Z][a-zA-Z0-9_]*", 2.0),
        (rf"abstract{_S}+class", 2.5),
        (rf"public{_S}+static{_S}+void{_S}+main", 5.0),
    ],
    (".ts", ".js"): [
        (rf"interface{_S}+[A-Z][a-zA-Z0-9_]*", 2.0),
        (rf"class{_S}+[A-Z][a-zA-Z0-9_]*", 1.5),
        (rf"export{_S}+default", 1.2),
    ],
    (".py",): [
        (rf"class{_S}+[A-Z][a-zA-Z0-9_]*", 1.5),
        (rf"def{_S}+__init__", 0.5),
        (rf"if{_S}+__name__{_S}*=={_S}*[\"']__main__[\"']", 5.0),
    ],
}
PATH_SCORES = [
    (("main", "cmd"), 2.0),
    (("api", "internal"), 1.5),
    (("core", "model", "service", "controller"), 1.8),
    (("util", "helper"), 0.7),
]


def _by_suffix(values: dict[tuple[str, ...], str], default: str) -> Column:
    """One ``CASE`` over the suffix of ``path``, so a text only meets the patterns of its own language."""
    cases = " ".join(
        f"when {' or '.join(f'endswith(path, {s!r})' for s in suffixes)} then {value}"
        for suffixes, value in values.items()
    )
    return F.expr(f"case {cases} else {default} end")


def _count(pattern: str) -> str:
    """Number of matches in ``text``, as SQL; the single quote is written as a character code there."""
    return "regexp_count(text, r'" + pattern.replace("'", r"\x27") + "')"


def import_count() -> Column:
    counts = {suffixes: " + ".join(map(_count, patterns)) for suffixes, patterns in IMPORT_PATTERNS.items()}
    return _by_suffix(counts, "0").cast("long")


def pattern_score() -> Column:
    scores = {
        suffixes: " + ".join(f"{_count(p)} * {w}D" for p, w in weighted) for suffixes, weighted in SCORE_PATTERNS.items()
    }
    return _by_suffix(scores, "0.0D")


def path_score() -> Column:
    terms = [
        f"case when {' or '.join(f'contains(lower(path), {w!r})' for w in words)} then {score}D else 0.0D end"
        for words, score in PATH_SCORES
    ]
    return F.expr(" + ".join(terms))


def loc_factor(loc: Column) -> Column:
    return F.least(loc / F.lit(1000.0), F.lit(1.0))


def file_features(texts: DataFrame, keep_text: bool = False) -> DataFrame:
    """Everything about a file that its own row tells: no shuffle."""
    loc = line_count(F.col("text"))
    return texts.select(
        "repo",
        "path",
        import_count().alias("imports"),
        pattern_score().alias("patterns"),
        path_score().alias("path_score"),
        depth(F.col("path")).alias("depth"),
        loc.alias("loc"),
        loc_factor(loc).alias("loc_factor"),
        *(["text"] if keep_text else []),
    )


def importance(texts: DataFrame) -> DataFrame:
    """Components and ``score`` of every file.

    The terms are added in a fixed order, since double addition is not associative.
    """
    score = (
        F.col("loc_factor") * 0.2
        + (F.lit(1.0) / F.col("depth")) * 0.15
        + F.col("path_score") * 0.2
        + F.col("imports") * 0.15
        + F.col("imported_by") * 0.2
        + F.col("patterns") * 0.1
    ) * 10
    return add_imported_by(file_features(texts, keep_text=True)).select(
        "repo", "path", "imports", "patterns", "imported_by", "path_score", "depth", "loc_factor", score.alias("score")
    )


def key_files(scored: DataFrame, detail: str = "standard", focus: str = "") -> DataFrame:
    """The top files of each repository by score, path ascending on ties.

    The focus is applied after the cut, so a focus outside the top files leaves none.  The rank limit is
    pushed below the shuffle by Spark, so a repository sends at most K rows per task.
    """
    by_score = Window.partitionBy("repo").orderBy(F.desc("score"), "path")
    top = (
        scored.select("repo", "path", "score", F.row_number().over(by_score).alias("rank"))
        .where(F.col("rank") <= TOP_FILES.get(detail, TOP_FILES_OTHERWISE))
    )
    return top.where(F.startswith(F.col("path"), F.lit(focus))) if focus else top
