"""Functions that consume rows, as a sink that keeps all results or none.

A consumer is called in every task with the task's rows and gives back results (texts).  They are written beside the target
folder and moved into it only when every task is done; the first error ends the job, and what was written is removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from srcatlas.sources.fs import move_file, remove_tree, write_bytes

#: What a consumer does: a task's rows in, result texts out.
Consumer = Callable[[Iterator[Row]], Iterator[str]]


@dataclass
class Written(WriterCommitMessage):
    file: str
    results: int


class ConsumerWriter(DataSourceWriter):
    def __init__(self, consumer: Consumer, folder: str):
        self.consumer, self.folder = consumer, folder.rstrip("/")
        self.held = f"{self.folder}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        results = [json.dumps({"result": r}, ensure_ascii=False) for r in self.consumer(iterator)]
        name = f"part-{uuid.uuid4().hex}.json"
        write_bytes(f"{self.held}/{name}", "".join(f"{line}\n" for line in results).encode())
        return Written(name, len(results))

    def commit(self, messages: list[Written | None]) -> None:
        for done in messages:
            if done is not None:
                move_file(f"{self.held}/{done.file}", f"{self.folder}/{done.file}")
        write_bytes(f"{self.folder}/_SUCCESS", b"")
        remove_tree(self.held)

    def abort(self, messages: list[Written | None]) -> None:
        remove_tree(self.held)


def consume(rows: DataFrame, consumer: Consumer, folder: str) -> None:
    """Call ``consumer`` on all rows; its results are lines of JSON (``result``) in ``folder``, or the first error is raised."""

    columns = rows.schema  # the class goes to the workers, and a DataFrame cannot

    class ConsumerSink(DataSource):
        @classmethod
        def name(cls) -> str:
            return "consumer"

        def schema(self) -> StructType:
            return columns

        def writer(self, schema, overwrite: bool) -> ConsumerWriter:
            return ConsumerWriter(consumer, folder)

    rows.sparkSession.dataSource.register(ConsumerSink)
    rows.write.format("consumer").mode("append").save()
