"""Declared dependencies, read from the manifests in a repository's root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.arrays import items
from srcatlas.functions.text import base_name, lines_of, trim_space

# Manifest paths and the texts of the report.
GO_MANIFEST, NODE_MANIFEST, PYTHON_MANIFEST = "go.mod", "package.json", "requirements.txt"
MANIFESTS = (GO_MANIFEST, NODE_MANIFEST, PYTHON_MANIFEST)
HEADINGS = {
    ("go", "runtime"): "Go Dependencies:",
    ("node", "runtime"): "Node.js Dependencies:",
    ("node", "dev"): "Dev Dependencies:",
    ("python", "runtime"): "Python Dependencies:",
}
NOTHING_FOUND = "No standard dependency files detected."
_S = r"[\t\n\f\r ]"


def _lines(chunks: Column) -> Column:
    """Trimmed non-blank lines of all chunks, in order."""
    return F.filter(F.flatten(F.transform(chunks, lambda c: F.transform(lines_of(c), trim_space))), lambda x: x != "")


def _block_pattern(key: str) -> str:
    return rf'"{key}"{_S}*:{_S}*\{{([^}}]*)\}}'


def _node_entries(text: Column, key: str) -> Column:
    """Entries of the first object under ``key``: quotes, spaces and line feeds removed, cut at commas."""
    body = F.regexp_extract(text, _block_pattern(key), 1)
    for ch in ("\n", '"', " "):
        body = F.replace(body, F.lit(ch), F.lit(""))
    return F.filter(F.transform(F.split(body, ",", -1), trim_space), lambda x: x != "")


def _go_specs(chunks: Column) -> Column:
    return F.filter(
        _lines(chunks), lambda x: ~F.startswith(x, F.lit("module ")) & ~F.startswith(x, F.lit("go "))
    )


def _python_specs(chunks: Column) -> Column:
    return F.filter(_lines(chunks), lambda x: ~F.startswith(x, F.lit("#")))


def _lists(by_file: DataFrame, anywhere: bool = False) -> DataFrame:
    """``repo, path, block, ecosystem, scope, title, specs``: the lists of each manifest, present or empty.

    One pass over the manifests.  ``block`` numbers the lists of a repository in report order.  A manifest
    is one file, so an array holds all of a list.
    """
    chunks, text = F.col("chunks"), F.array_join("chunks", "")
    path = base_name(F.col("path")) if anywhere else F.col("path")

    def listing(block: int, key: tuple[str, str], present: Column, specs: Column) -> Column:
        return F.when(
            present,
            F.struct(
                F.lit(block).alias("block"), F.lit(key[0]).alias("ecosystem"), F.lit(key[1]).alias("scope"),
                F.lit(HEADINGS[key]).alias("title"), specs.alias("specs"),
            ),
        )

    is_node = path == NODE_MANIFEST
    is_dev = is_node & text.rlike(_block_pattern("devDependencies"))
    found = [
        listing(0, ("go", "runtime"), path == GO_MANIFEST, _go_specs(chunks)),
        listing(1, ("node", "runtime"), is_node, _node_entries(text, "dependencies")),
        listing(2, ("node", "dev"), is_dev, _node_entries(text, "devDependencies")),
        listing(3, ("python", "runtime"), path == PYTHON_MANIFEST, _python_specs(chunks)),
    ]
    manifests = by_file.where(path.isin(*MANIFESTS))
    return manifests.select("repo", "path", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def dependencies(by_file: DataFrame, anywhere: bool = False) -> DataFrame:
    """``repo, ecosystem, scope, pos, spec`` of all three kinds, ``pos`` counting from 0 per list.

    ``anywhere``: manifests in subdirectories count as well, and ``path`` tells them apart.
    """
    entries = F.posexplode(items("specs")).alias("pos", "spec")
    return _lists(by_file, anywhere).select("repo", *(["path"] if anywhere else []), "ecosystem", "scope", entries)


def deps_go(by_file: DataFrame) -> DataFrame:
    return dependencies(by_file.where(F.col("path") == GO_MANIFEST))


def deps_node(by_file: DataFrame) -> DataFrame:
    return dependencies(by_file.where(F.col("path") == NODE_MANIFEST))


def deps_python(by_file: DataFrame) -> DataFrame:
    return dependencies(by_file.where(F.col("path") == PYTHON_MANIFEST))


def deps_report(by_file: DataFrame) -> DataFrame:
    """The dependency section as rows: ``repo, block, pos, line``, to be read in that order.

    ``pos`` is -1 for a heading.  A manifest without entries still has its heading; the dev list has one
    only where its object exists.
    """
    entries = F.transform("specs", lambda s: F.concat(F.lit("- "), s))
    lines = F.posexplode(F.concat(F.array("title"), entries)).alias("_n", "line")
    listed = _lists(by_file).select("repo", "block", lines).select(
        "repo", "block", (F.col("_n") - 1).alias("pos"), "line"
    )
    has_any = F.max(F.col("path").isin(*MANIFESTS))
    none = by_file.groupBy("repo").agg(has_any.alias("_any")).where(~F.col("_any")).select(
        "repo", F.lit(0).alias("block"), F.lit(-1).alias("pos"), F.lit(NOTHING_FOUND).alias("line")
    )
    return listed.unionByName(none)
