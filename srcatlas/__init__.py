"""Source-code corpora as Spark tables: scan, chunk, embed, structure, rank, report.

Every operator is ``DataFrame -> DataFrame`` and keeps a ``repo`` column, so one job covers any
number of repositories.  No rows of data are collected to the driver; some operators read a few numbers (a total, a
count, the kinds of names) while a plan is built.
"""

import sys

from pyspark import cloudpickle

from srcatlas.plans.indexing import index_files
from srcatlas.plans.summarize import SummaryOptions, summarize
from srcatlas.sources.code_tree import scan_code_files
from srcatlas.sources.index_store import read_index, read_index_json, write_index, write_index_json

# Workers get this package's functions by value, so they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "SummaryOptions",
    "index_files",
    "read_index",
    "read_index_json",
    "scan_code_files",
    "summarize",
    "write_index",
    "write_index_json",
]
