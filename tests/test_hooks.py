"""Users' functions: vectors kept across runs, consumers that keep all or nothing, chunkers from SQL."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from srcatlas.functions.sql_chunkers import register_chunkers
from srcatlas.operators.chunk import line_chunks, paragraph_blocks, paragraph_chunks
from srcatlas.session import names_in, new_shared_path, shared_dir
from srcatlas.sources.consumer import consume
from srcatlas.sources.vector_store import VectorStore

CHUNKS = "repo string, file string, chunk_idx int, content string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def sizes():
    def embed(batches):
        for batch in batches:
            yield pd.DataFrame({"text": batch["text"], "embedding": [[float(len(t))] for t in batch["prepared"]]})

    return embed


def test_a_second_run_sends_no_known_text(spark, tmp_path, sizes):
    store = VectorStore(spark, str(tmp_path / "vectors"))
    first = spark.createDataFrame([("r", f"f{i}", 0, f"text {i % 20}") for i in range(60)], CHUNKS)
    got = store.attach(first, sizes)
    assert got.count() == 60 and {r.embedding[0] for r in got.collect()} == {6.0, 7.0}
    assert store.fill(first.select(F.col("content").alias("text")).distinct(), sizes) == 0

    def only_new(batches):
        for batch in batches:
            assert set(batch["text"]) <= {"new one", "blank later"}
            yield pd.DataFrame({"text": batch["text"][batch["text"] == "new one"], "embedding": [[9.0]] * int((batch["text"] == "new one").sum())})

    second = spark.createDataFrame([("r", "a", 0, "text 3"), ("r", "b", 0, "new one"), ("r", "c", 0, "blank later")], CHUNKS)
    assert sorted((r.file, r.embedding[0]) for r in store.attach(second, only_new).collect()) == [("a", 6.0), ("b", 9.0)]
    assert store.vectors().count() == 21


def test_a_run_that_fails_keeps_what_is_done(spark, tmp_path, sizes):
    store = VectorStore(spark, str(tmp_path / "vectors"))
    texts = spark.createDataFrame([(f"text {i}",) for i in range(40)], "text string").repartition(4)

    def dies(batches):
        for n, batch in enumerate(batches):
            for i in range(0, len(batch), 2):
                part = batch.iloc[i : i + 2]
                if any(t == "text 17" for t in part["text"]):
                    raise RuntimeError("lost")
                yield pd.DataFrame({"text": part["text"], "embedding": [[1.0]] * len(part)})

    with pytest.raises(Exception, match="lost"):
        store.fill(texts, dies)
    kept = store.vectors().count()
    assert 0 < kept < 40
    assert store.fill(texts, sizes) == 40 - kept and store.vectors().count() == 40


def test_a_consumer_keeps_all_results_or_none(spark, tmp_path):
    rows = spark.createDataFrame([("r", f"f{i}") for i in range(50)], "repo string, path string").repartition(5)
    consume(rows, lambda rs: (f"{r.repo}/{r.path}" for r in rs), str(tmp_path / "out"))
    found = [json.loads(line)["result"] for n in os.listdir(tmp_path / "out") if n.endswith(".json") for line in open(tmp_path / "out" / n)]
    assert sorted(found) == sorted(f"r/f{i}" for i in range(50)) and "_SUCCESS" in os.listdir(tmp_path / "out")

    def fails(rs):
        for r in rs:
            if r.path == "f33":
                raise ValueError("first error")
            yield r.path

    with pytest.raises(Exception, match="first error"):
        consume(rows, fails, str(tmp_path / "none"))
    assert sorted(os.listdir(tmp_path)) == ["out"]


@pytest.mark.parametrize("limit", [0, 1, 7, 50])
def test_chunkers_from_sql(spark, files, limit):
    register_chunkers(spark)
    texts = ["", "\n", "a", "a\n", "a\r\n\r\nb\r", "\n\n", "x" * 40 + "\n\ny", "é\n\n" * 30, "one\n\ntwo  \n\n\nthree", " \t\n\n  x", "\r", "p\nq\n\nr"]
    df = files([("r", f"f{i}", t) for i, t in enumerate(texts)])
    df.createOrReplaceTempView("sql_files")
    call = lambda f, out: spark.sql(f"SELECT f.repo, f.path, {out} FROM sql_files f, LATERAL {f} c")
    got = call(f"paragraph_chunks(f.content, {limit})", "c.chunk_idx, c.content")
    assert rows_of(got) == rows_of(paragraph_chunks(df, limit))
    if limit:
        assert rows_of(call(f"line_chunks(f.content, {limit})", "c.chunk_idx, c.content")) == rows_of(line_chunks(df, limit))
    blocks = call("paragraph_blocks(f.content)", "c.start_line, c.end_line, c.content")
    assert rows_of(blocks) == rows_of(paragraph_blocks(df))
    assert "Python" not in call("line_chunks(f.content, 9)", "c.content")._jdf.queryExecution().executedPlan().toString()


def test_attach_writes_no_text_but_its_chunks(spark, tmp_path, sizes):
    """Digests are counted and meet the store; of known texts nothing is dealt, and texts are not written beside their chunks."""
    store = VectorStore(spark, str(tmp_path / "vectors"))
    rows = spark.createDataFrame([("r", f"f{i}", 0, f"text {i % 20}") for i in range(60)] + [("r", "blank", 0, " "), ("r", "null", 0, None)], CHUNKS)
    before = set(names_in(spark, shared_dir(spark)))
    assert store.fill(rows.where("content like 'text 1%'").select(F.col("content").alias("text")).distinct(), sizes) == 11
    got = store.attach(rows, sizes)
    assert rows_of(got.select("file", F.col("embedding")[0])) == rows_of(rows.where("content like 'text%'").select("file", F.length("content").cast("float")))
    written = [n for n in names_in(spark, shared_dir(spark)) if n not in before]
    held = [n for n in written if "string" in str(spark.read.parquet(f"{shared_dir(spark)}/{n}").dtypes)]
    assert len(held) == 1 and held[0].startswith("chunks-")
    assert store.vectors().count() == 20
