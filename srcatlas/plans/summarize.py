"""The summary job: an index in, report lines or generated summaries out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from srcatlas.operators.importance import importance, key_files
from srcatlas.operators.report import PART_BYTES, PromptTemplate, key_file_excerpt, prompt_parts, report
from srcatlas.operators.structure import chunks_by_file, file_text, with_structure
from srcatlas.session import durable

#: A user's text generator: batches ``repo, part, prompt`` in, ``repo, part, summary`` out.
Generator = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


@dataclass(frozen=True)
class SummaryOptions:
    """``detail``: brief, standard or comprehensive (anything else counts as standard).

    ``focus``: keep only key files whose path starts with this text.  ``metrics``: ask for a word on
    the measures.  ``template``: the lines around a report in a prompt.
    """

    detail: str = "standard"
    focus: str = ""
    metrics: bool = True
    template: PromptTemplate = field(default_factory=PromptTemplate)


def _report(by_file: DataFrame, options: SummaryOptions, as_prompt: bool) -> DataFrame:
    """``by_file`` is read by several branches, so it is written once to the shared folder together with
    language and line count; branches then read only the columns they need."""
    table = durable(with_structure(by_file), "by-file")
    ranked = key_files(importance(file_text(table)), options.detail, options.focus)
    return report(
        table.select("repo", "path", "language", "loc"),
        table,
        key_file_excerpt(ranked, table, options.detail),
        options.template.lines(options.detail, options.metrics) if as_prompt else [],
    )


def report_lines(by_file: DataFrame, options: SummaryOptions = SummaryOptions()) -> DataFrame:
    """The lines that come from the data: what a report holds without a text generator.  See
    ``operators.report`` for the columns and their order."""
    return _report(by_file, options, as_prompt=False)


def prompt_lines(by_file: DataFrame, options: SummaryOptions = SummaryOptions()) -> DataFrame:
    """All lines of each repository's prompt: the report and the template's lines around it."""
    return _report(by_file, options, as_prompt=True)


def summarize(
    index: DataFrame,
    options: SummaryOptions = SummaryOptions(),
    generator: Generator | None = None,
    max_prompt_bytes: int = PART_BYTES,
) -> DataFrame:
    """Report lines of an index or, given a generator, its answer per repository and prompt part."""
    by_file = chunks_by_file(index)
    if generator is None:
        return report_lines(by_file, options)
    parts = prompt_parts(prompt_lines(by_file, options), max_prompt_bytes)
    return parts.mapInPandas(generator, "repo string, part int, summary string")
