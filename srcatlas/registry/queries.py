"""The registered queries: each operator over tables made from the given ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from srcatlas.functions.arrays import items
from srcatlas.functions.sql_chunkers import register_chunkers
from srcatlas.functions.text import normalize, token_estimate
from srcatlas.operators import chunk, deps, embed, importance, report, select, structure
from srcatlas.operators.crossref import imported_by as count_references
from srcatlas.operators.definitions import definitions as find_definitions
from srcatlas.operators.definitions import semantic_chunks as find_semantic_chunks
from srcatlas.operators.incremental import changed_files as find_changed_files
from srcatlas.plans import indexing, summarize
from srcatlas.registry import fixtures as fx
from srcatlas.session import names_in, new_shared_path
from srcatlas.sources.code_tree import list_code_files, stream_line_chunks
from srcatlas.sources.code_tree import scan_code_files as scan
from srcatlas.sources.consumer import consume
from srcatlas.sources.index_store import load_or_build, read_index, read_index_json, write_index, write_index_array, write_index_json
from srcatlas.sources.index_table import IndexTable
from srcatlas.sources.split_lines import split_line_chunks
from srcatlas.sources.vector_store import VectorStore
from srcatlas.streaming import reindex
from srcatlas.streaming.versions import start_stateful_reindex

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

BATCH_CHUNK_BYTES = 200
LINE_CHUNK_BYTES = 500
LONG_CHUNK_BYTES = 40000


def query(fn: Query) -> Query:
    """Register under the function's name; a trailing underscore keeps clear of a module of that name."""
    REGISTRY[fn.__name__.rstrip("_")] = fn
    return fn


def _r6(c: str):
    return F.round(c, 6).alias(c)


def _docs(spark, sf):
    return fx.view(spark, sf, fx.DOCS_SQL)


def _raw_docs(spark, sf):
    return fx.view(spark, sf, fx.RAW_DOCS_SQL)


def _code(spark, sf):
    return fx.view(spark, sf, fx.CODE_SQL)


def _code_by_file(spark, sf):
    return structure.chunks_of_files(_code(spark, sf))


def _code_texts(spark, sf):
    return structure.file_text(_code_by_file(spark, sf))


def _manifests(spark, sf):
    return structure.chunks_of_files(fx.view(spark, sf, fx.MANIFESTS_SQL))


def _turns(spark, sf):
    return fx.view(spark, sf, fx.TURNS_SQL)


# Sources and sinks.


@query
def scan_code_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_shared_path(spark, "code-tree")
    fx.write_as_files(_code(spark, sf), folder)
    return scan(spark, [f"{folder}/r{i}" for i in range(4)]).select("repo", "path", "ext", "size", "content")


@query
def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    versions = fx.view(spark, sf, fx.FILE_VERSIONS_SQL)
    latest = F.max("mtime").alias("mtime")
    files = versions.where("mtime >= timestamp'2024-01-08 00:00:00'").groupBy("repo", "path").agg(latest)
    state = versions.where("mtime < timestamp'2024-01-20 00:00:00'").groupBy("repo", "path").agg(latest)
    state = state.withColumn("indexed_at", F.col("mtime"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return find_changed_files(files, state, now, F.expr("interval 20 days"))


@query
def index_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "index")
    write_index(indexing.index_files(_docs(spark, sf)), path)
    return read_index(spark, path).select(
        "repo", "file", "chunk_idx", F.md5("content").alias("content_md5"), F.size("embedding").alias("dims")
    )


def _incoming(versions: DataFrame, path: str, batches: int) -> DataFrame:
    """A stream of ``versions`` in so many micro-batches, over files written by about as many tasks as the table is read by."""
    each = max(1, -(-versions.rdd.getNumPartitions() // batches))
    versions.repartition(batches * each, "version").write.parquet(path)
    return versions.sparkSession.readStream.schema(versions.schema).option("maxFilesPerTrigger", each).parquet(path)


@query
def stream_reindex(spark: SparkSession, sf: str) -> DataFrame:
    incoming, target, log = (new_shared_path(spark, x) for x in ("versions", "live-index", "stream-log"))
    mtime = (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("version").cast("int")))
    versions = fx.view(spark, sf, fx.DOC_VERSIONS_SQL).withColumn("mtime", mtime)
    reindex.start_reindex(_incoming(versions, incoming, 4), target, log).awaitTermination()
    return reindex.current_index(spark, target).select("repo", "file", "chunk_idx", "content")


@query
def line_chunks_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Line chunks of written files, cut while they are read."""
    folder = new_shared_path(spark, "code-tree")
    fx.write_as_files(_code(spark, sf), folder)
    listing = list_code_files(spark, [f"{folder}/r{i}" for i in range(4)])
    return stream_line_chunks(listing, LINE_CHUNK_BYTES).select("repo", "file", "chunk_idx", "content")


def _written_code(spark, sf) -> tuple[str, dict[str, str]]:
    folder = new_shared_path(spark, "code-tree")
    fx.write_as_files(_code(spark, sf), folder)
    return folder, {f"r{i}": f"{folder}/r{i}" for i in range(4)}


@query
def scan_pushed(spark: SparkSession, sf: str) -> DataFrame:
    """A scan of a part: the source gets the filters and leaves other directories closed."""
    files = scan(spark, _written_code(spark, sf)[1], where="repo in ('r0', 'r2') and path like 'internal/%' and size > 150")
    return files.select("repo", "path", "ext", "size", "content")


@query
def scan_by_levels(spark: SparkSession, sf: str) -> DataFrame:
    return scan(spark, _written_code(spark, sf)[1], by_levels=True).select("repo", "path", "ext", "size", "content")


@query
def scan_failing(spark: SparkSession, sf: str) -> DataFrame:
    """A scan with a root that is missing: files and errors per repository, and how the scan that fails with it ends."""
    roots = {**_written_code(spark, sf)[1], "missing": new_shared_path(spark, "missing")}
    found = scan(spark, roots).groupBy("repo").agg(F.count("content").alias("files"), F.count("_error").alias("errors"))
    try:
        left = scan(spark, roots, mode="FAILFAST").count()
    except PySparkException:
        left = None
    ended = spark.range(1).select(F.lit("all or nothing").alias("repo"), F.lit(left).cast("long").alias("files"), F.lit(int(left is None)).cast("long").alias("errors"))
    return found.unionByName(ended)


@query
def tree_watched(spark: SparkSession, sf: str) -> DataFrame:
    """An index that follows a tree: every fifth file changed and every seventh removed between two triggers."""
    folder, roots = _written_code(spark, sf)
    table, log = IndexTable(spark, new_shared_path(spark, "index-table"), buckets=16), new_shared_path(spark, "stream-log")
    watch = lambda: reindex.watch_tree(spark, roots, table, log, F.expr("interval 20 days")).awaitTermination()
    watch()
    number = F.regexp_extract("path", "m([0-9]+)[.]", 1).cast("long")
    fx.write_as_files(_code(spark, sf).where(number % 5 == 0).withColumn("content", F.concat("content", F.lit("# changed"))), folder)
    fx.remove_files(_code(spark, sf).where(number % 7 == 0), folder)
    watch()
    return table.read().select("repo", "file", "chunk_idx", "content")


@query
def stream_stateful(spark: SparkSession, sf: str) -> DataFrame:
    """Re-indexing with state per file: versions in any order, repeated ones, and files that expire 500 minutes after the last."""
    incoming, target, log = (new_shared_path(spark, x) for x in ("versions", "live-index", "stream-log"))
    mtime = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("version").cast("int"))
    versions = fx.view(spark, sf, fx.DOC_VERSIONS_SQL).withColumn("mtime", mtime)
    stream = _incoming(versions.union(versions.where("version % 3 = 0")), incoming, 2)
    start_stateful_reindex(stream, target, log, "500 minutes").awaitTermination()
    return reindex.current_index(spark, target).select("repo", "file", "chunk_idx", "content")


@query
def line_chunks_split(spark: SparkSession, sf: str) -> DataFrame:
    """Line chunks of documents as files, each file cut by byte ranges."""
    folder = new_shared_path(spark, "doc-tree")
    docs = _docs(spark, sf)
    fx.write_as_files(docs, folder)
    repos = [r.repo for r in docs.select("repo").distinct().collect()]  # a name per source
    listing = list_code_files(spark, {repo: f"{folder}/{repo}" for repo in sorted(repos)})
    return split_line_chunks(listing, LINE_CHUNK_BYTES, range_bytes=2048)


@query
def scan_report(spark: SparkSession, sf: str) -> DataFrame:
    """From written files to dependency lines."""
    folder = new_shared_path(spark, "packages")
    packages = fx.view(spark, sf, fx.MANIFESTS_SQL)
    fx.write_as_files(packages, folder)
    last = packages.agg(F.max(F.regexp_extract("repo", "[0-9]+", 0).cast("int"))).first()[0]
    name = F.concat(F.lit("pkg"), "id")
    roots = spark.range(last + 1).select(name.alias("repo"), F.concat(F.lit(f"{folder}/"), name).alias("root"))
    files = scan(spark, roots, names=["go.mod", "package.json", "requirements.txt"])
    return deps.deps_report(structure.chunks_of_files(files.where("_error is null")))


def _some_vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An embedder of its own: length and first code point; nothing for texts whose length divides by three."""
    for batch in batches:
        size = batch["prepared"].str.len()
        kept = batch[size % 3 != 0]
        vectors = [[float(len(t)), float(ord(t[0]))] for t in kept["prepared"]]
        yield pd.DataFrame({"text": kept["text"], "embedding": pd.Series(vectors, index=kept.index, dtype=object)})


@query
def index_custom_embedder(spark: SparkSession, sf: str) -> DataFrame:
    index = indexing.index_files(_docs(spark, sf), _some_vectors)
    values = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(("size", "first_code"))]
    return index.select("repo", "file", "chunk_idx", "content", *values)


@query
def index_custom_stats(spark: SparkSession, sf: str) -> DataFrame:
    files = _docs(spark, sf)
    return indexing.index_stats(files, index=indexing.index_files(files, _some_vectors))


@query
def index_custom_errors(spark: SparkSession, sf: str) -> DataFrame:
    files = _docs(spark, sf)
    return indexing.error_report(indexing.file_errors(files, index=indexing.index_files(files, _some_vectors)))


@query
def refresh_with_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Index and changes where the directories ``de`` could not be listed: their files stay, others may go."""
    known = _docs(spark, sf).withColumn("mtime", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    number = F.regexp_extract("path", "_([0-9]+)", 1).cast("long")
    listed = known.where(~F.col("path").startswith("de/") & (number % 5 != 0))
    newer = F.when(number % 7 == 0, F.lit("2024-01-02 00:00:00").cast("timestamp")).otherwise(F.col("mtime"))
    listed = listed.withColumn("mtime", newer).withColumn("content", F.when(number % 7 == 0, "changed").otherwise(F.col("content")))
    failed = known.select("repo").distinct().select(
        "repo", F.lit("de").alias("path"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("timestamp").alias("mtime"),
        F.lit("failed to list").alias("_error"),
    )
    files = listed.withColumn("_error", F.lit(None).cast("string")).unionByName(failed)
    state = known.select("repo", "path", "mtime", F.col("mtime").alias("indexed_at"))
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    changes = find_changed_files(files, state, now, F.expr("interval 20 days"))
    index = indexing.refresh_index(indexing.index_files(known), files, changes)
    return index.select("repo", "file", "chunk_idx", "content")


def _numbered_docs(spark, sf):
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    number = F.regexp_extract("path", "_([0-9]+)", 1).cast("long")
    return _docs(spark, sf).withColumn("mtime", stamp).withColumn("number", number)


def _later(known: DataFrame) -> DataFrame:
    """Every 89th document changed, every 97th gone."""
    changed = F.col("number") % 89 == 0
    stamp = F.when(changed, F.lit("2024-01-02 00:00:00").cast("timestamp")).otherwise(F.col("mtime"))
    return known.where("number % 97 <> 0").withColumn("mtime", stamp).withColumn("content", F.when(changed, "changed").otherwise(F.col("content")))


@query
def index_refresh_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """An index with snapshots after a refresh, and whether a chunk's bucket was written again."""
    table = IndexTable(spark, new_shared_path(spark, "index-table"), buckets=32)
    known, now, ttl = _numbered_docs(spark, sf), F.lit("2024-01-03 00:00:00").cast("timestamp"), F.expr("interval 20 days")
    indexing.refresh_table(table, known.drop("number"), now, ttl)
    before = table.manifest()
    indexing.refresh_table(table, _later(known).drop("number"), now, ttl)
    after = table.manifest()
    again = [b for (kind, b), build in after.items() if kind == "chunks" and before.get((kind, b)) != build]  # at most one per bucket
    rows = table.bucketed("chunks", table.read())
    return rows.select("repo", "file", "chunk_idx", "content", "bucket", F.col("bucket").isin(again).alias("rewritten"))


def _dies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An embedder that is lost after its first batch."""
    for batch in batches:
        yield pd.DataFrame({"text": batch["text"], "embedding": [[1.0]] * len(batch)})
        raise RuntimeError("lost")


@query
def index_crashed_build(spark: SparkSession, sf: str) -> DataFrame:
    """Indexes whose first build died, as a plain folder and as a table with snapshots: both are built again."""
    docs, plain = _docs(spark, sf), new_shared_path(spark, "index-plain")
    table = IndexTable(spark, new_shared_path(spark, "index-table"))
    for load in (lambda build: load_or_build(spark, plain, build), table.load_or_build):
        try:
            load(lambda: indexing.index_files(docs, _dies))
        except PySparkException as e:
            if "lost" not in str(e):
                raise
    built = [load_or_build(spark, plain, lambda: indexing.index_files(docs)), table.load_or_build(lambda: indexing.index_files(docs))]
    both = built[0].withColumn("kind", F.lit("plain")).unionByName(built[1].withColumn("kind", F.lit("table")))
    return both.select("kind", "repo", "file", "chunk_idx", "content")


@query
def index_json(spark: SparkSession, sf: str) -> DataFrame:
    """An index exported as JSON lines, read back, built where it is missing, read again."""
    exported, stored = new_shared_path(spark, "index-json"), new_shared_path(spark, "index-stored")
    write_index_json(indexing.index_files(_docs(spark, sf)), exported)
    for _ in range(2):
        index = load_or_build(spark, stored, lambda: read_index_json(spark, exported, array=False))
    peak = F.round(F.array_max("embedding").cast("double"), 5).alias("peak")
    filled = F.size(F.filter("embedding", lambda x: x != 0)).alias("filled")
    return index.select("repo", "file", "chunk_idx", "content", filled, peak)


@query
def index_json_array(spark: SparkSession, sf: str) -> DataFrame:
    """An index exported as JSON arrays and read back, each file by several tasks."""
    exported = new_shared_path(spark, "index-array")
    write_index_array(indexing.index_files(_docs(spark, sf)), exported)
    index = read_index_json(spark, exported, repo="all", range_bytes=100_000)
    peak = F.round(F.array_max("embedding").cast("double"), 5).alias("peak")
    return index.select("repo", "file", "chunk_idx", "content", F.size("embedding").alias("dims"), peak)


def _lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An embedder of its own: the length."""
    for batch in batches:
        yield pd.DataFrame({"text": batch["text"], "embedding": [[float(len(t))] for t in batch["prepared"]]})


@query
def embed_store(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors kept across two runs: the first embeds the code, the second code and documents, and sends the new texts only."""
    store = VectorStore(spark, new_shared_path(spark, "vector-store"))
    code = chunk.paragraph_chunks(_code(spark, sf))
    both = chunk.paragraph_chunks(_code(spark, sf).unionByName(_docs(spark, sf)))
    added = [store.fill(embed.distinct_texts(chunks), _lengths) for chunks in (code, both)]
    attached = store.attach(both, _lengths).select("repo", "file", "chunk_idx", F.md5("content").alias("content_md5"), F.col("embedding")[0].cast("double").alias("size"))
    return attached.withColumn("first_run", F.lit(added[0])).withColumn("second_run", F.lit(added[1]))


@query
def chunks_by_sql(spark: SparkSession, sf: str) -> DataFrame:
    """Line chunks by a lateral join with a table function."""
    register_chunkers(spark)
    files = _code(spark, sf).unionByName(fx.view(spark, sf, fx.PAGES_SQL))
    call = f"select f.repo, f.path as file, c.chunk_idx, c.content from {{files}} f, lateral line_chunks(f.content, {LINE_CHUNK_BYTES}) c"
    return spark.sql(call, files=files)


def _path_and_size(rows: Iterator[Row]) -> Iterator[str]:
    return (f"{r.repo}/{r.path} {r.size}" for r in rows)


def _first_error(rows: Iterator[Row]) -> Iterator[str]:
    for r in rows:
        yield r.path
        raise ValueError("first error wins")


@query
def paths_consumed(spark: SparkSession, sf: str) -> DataFrame:
    """What a consumer of paths gives for a listing, and how many files a consumer that fails leaves behind."""
    listing = list_code_files(spark, _written_code(spark, sf)[1])
    done, failed = new_shared_path(spark, "consumed"), new_shared_path(spark, "failed")
    consume(listing, _path_and_size, done)
    try:
        consume(listing, _first_error, failed)
    except PySparkException as e:
        if "first error wins" not in str(e):
            raise
    return spark.read.schema("result string").json(done).withColumn("left_by_failure", F.lit(len(names_in(spark, failed))))


# Filters and scalar functions.


@query
def code_files_filter(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.concat(
        F.when(F.col("path").contains("7"), "build/").when(F.col("path").contains("8"), "src/dist.d/").otherwise(""), "path"
    )
    return select.code_files(_code(spark, sf).select("repo", moved.alias("path")))


@query
def token_estimate_(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("repo", "path", token_estimate(F.col("content")).alias("tokens"))


@query
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit("\n \t\n \n  "), F.regexp_replace("content", "m", "\n"), F.lit("\n \n"))
    return _code(spark, sf).select("repo", "path", normalize(padded).alias("text"))


@query
def embed_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    return embed.embed_eligibility(chunk.paragraph_chunks(_raw_docs(spark, sf), LONG_CHUNK_BYTES))


@query
def distinct_texts(spark: SparkSession, sf: str) -> DataFrame:
    return embed.distinct_texts(chunk.paragraph_chunks(_docs(spark, sf)))


# Chunkers.


@query
def paragraph_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.paragraph_chunks(_docs(spark, sf)).unionByName(chunk.paragraph_chunks(_code(spark, sf)))


@query
def paragraph_chunks_small(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.paragraph_chunks(_docs(spark, sf), BATCH_CHUNK_BYTES)


@query
def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    pages = fx.view(spark, sf, fx.PAGES_SQL)
    return chunk.line_chunks(_code(spark, sf).unionByName(pages), LINE_CHUNK_BYTES)


@query
def paragraph_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.paragraph_blocks(_code(spark, sf))


@query
def definitions(spark: SparkSession, sf: str) -> DataFrame:
    return find_definitions(_code(spark, sf))


@query
def semantic_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return find_semantic_chunks(_code(spark, sf))


# Embedding.


def _weights(df: DataFrame, *keys: str) -> DataFrame:
    cells = df.select(*keys, F.posexplode(items("embedding")).alias("dim", "w")).where(F.col("w") != 0)
    return cells.select(*keys, "dim", F.round(F.col("w").cast("double"), 5).alias("weight"))


@query
def embed_batches(spark: SparkSession, sf: str) -> DataFrame:
    return embed.embed_batches(chunk.with_paragraph_chunks(_docs(spark, sf), BATCH_CHUNK_BYTES))


@query
def embed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    vectors = embed.embed_texts(embed.distinct_texts(chunk.paragraph_chunks(_docs(spark, sf))))
    return _weights(vectors.withColumn("text_md5", F.md5("text")), "text_md5")


def _given_vectors(spark: SparkSession, sf: str, chunks: DataFrame, every: bool) -> DataFrame:
    """A vector of the ``embeddings`` table for each text, by a hash over all of them; unless ``every``, none where
    the hash divides by five."""
    h = F.conv(F.left(F.md5("text"), F.lit(8)), 16, 10).cast("long")
    texts = embed.distinct_texts(chunks).select("text", h.alias("h"))
    given = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    chosen = texts if every else texts.where(F.col("h") % 5 != 0)
    return chosen.withColumn("vec_id", F.col("h") % given.agg(F.count(F.lit(1))).scalar()).join(given, "vec_id").select("text", "embedding")


@query
def embed_reattach(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunk.paragraph_chunks(_docs(spark, sf))
    attached = embed.attach_vectors(chunks, _given_vectors(spark, sf, chunks, every=True))
    first = F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value")
    return attached.select("repo", "file", "chunk_idx", F.md5("content").alias("content_md5"), first)


@query
def embed_coverage(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunk.paragraph_chunks(_docs(spark, sf))
    attached = embed.attach_vectors(chunks, _given_vectors(spark, sf, chunks, every=False))
    return embed.embed_coverage(chunks, attached)


@query
def code_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    full = indexing.code_embeddings(_code(spark, sf))
    peak = F.round(F.array_max("embedding").cast("double"), 5).alias("peak")
    return full.select("repo", "file", "metadata.*", peak)


@query
def index_files(spark: SparkSession, sf: str) -> DataFrame:
    peak = F.round(F.array_max("embedding").cast("double"), 5).alias("peak")
    filled = F.size(F.filter("embedding", lambda x: x != 0)).alias("filled")
    return indexing.index_files(_docs(spark, sf)).select("repo", "file", "chunk_idx", "content", filled, peak)


@query
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.index_stats(_docs(spark, sf))


@query
def index_errors(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.error_report(indexing.file_errors(_raw_docs(spark, sf)))


# Structure.


@query
def chunks_by_file(spark: SparkSession, sf: str) -> DataFrame:
    by_file = structure.chunks_by_file(_turns(spark, sf))
    return by_file.select(
        "repo", "path", F.size("chunks").alias("n_chunks"), F.array_join("chunks", "\u001f").alias("joined")
    )


@query
def file_text(spark: SparkSession, sf: str) -> DataFrame:
    by_file = structure.chunks_by_file(_turns(spark, sf))
    shown = structure.file_text(by_file, structure.DISPLAY_GLUE).withColumnRenamed("text", "display")
    return structure.file_text(by_file).join(shown, ["repo", "path"])


@query
def file_structure(spark: SparkSession, sf: str) -> DataFrame:
    return structure.file_structure(structure.chunks_of_files(_docs(spark, sf).unionByName(_code(spark, sf))))


@query
def index_structure(spark: SparkSession, sf: str) -> DataFrame:
    return structure.index_structure(chunk.paragraph_chunks(_docs(spark, sf), BATCH_CHUNK_BYTES))


def _structure(spark, sf):
    return structure.file_structure(_code_by_file(spark, sf))


@query
def language_loc(spark: SparkSession, sf: str) -> DataFrame:
    return structure.language_loc(_structure(spark, sf))


@query
def main_languages(spark: SparkSession, sf: str) -> DataFrame:
    files = _docs(spark, sf).unionByName(_code(spark, sf))
    return structure.main_languages(structure.file_structure(structure.chunks_of_files(files)))


@query
def repo_totals(spark: SparkSession, sf: str) -> DataFrame:
    return structure.repo_totals(_structure(spark, sf))


@query
def repo_overview(spark: SparkSession, sf: str) -> DataFrame:
    return structure.repo_overview(_structure(spark, sf))


@query
def dir_listing(spark: SparkSession, sf: str) -> DataFrame:
    return structure.dir_listing(_structure(spark, sf))


# Importance.


@query
def import_counts(spark: SparkSession, sf: str) -> DataFrame:
    return importance.file_features(_code_texts(spark, sf)).select("repo", "path", "imports")


@query
def pattern_scores(spark: SparkSession, sf: str) -> DataFrame:
    return importance.file_features(_code_texts(spark, sf)).select("repo", "path", _r6("patterns"))


@query
def path_scores(spark: SparkSession, sf: str) -> DataFrame:
    features = importance.file_features(_code_texts(spark, sf))
    return features.select("repo", "path", _r6("path_score"), "depth", _r6("loc_factor"))


@query
def imported_by(spark: SparkSession, sf: str) -> DataFrame:
    return count_references(_code_texts(spark, sf))


@query
def imported_by_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names with hyphens, dots and blanks, and one that is empty, over parts and documents."""
    named = fx.view(spark, sf, fx.NAMES_SQL).unionByName(fx.view(spark, sf, fx.NAMED_DOCS_SQL))
    return count_references(named.withColumnRenamed("content", "text"))


@query
def importance_(spark: SparkSession, sf: str) -> DataFrame:
    scored = importance.importance(_code_texts(spark, sf))
    rounded = [_r6(c) for c in ("patterns", "path_score", "loc_factor", "score")]
    return scored.select("repo", "path", "imports", "imported_by", "depth", *rounded)


def _key_files(spark, sf, detail="standard", focus=""):
    return importance.key_files(importance.importance(_code_texts(spark, sf)), detail, focus)


@query
def key_files(spark: SparkSession, sf: str) -> DataFrame:
    return _key_files(spark, sf, "comprehensive").select("repo", "rank", "path", _r6("score"))


@query
def key_files_focus(spark: SparkSession, sf: str) -> DataFrame:
    return _key_files(spark, sf, "standard", "cmd").select("repo", "rank", "path", _r6("score"))


@query
def key_file_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    ranked = _key_files(spark, sf, "brief")
    shown = report.key_file_excerpt(ranked, _code_by_file(spark, sf), "brief")
    return shown.select("repo", "rank", "path", "header", "excerpt")


@query
def text_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """The excerpt rule over every document and page."""
    files = _docs(spark, sf).unionByName(fx.view(spark, sf, fx.PAGES_SQL))
    text = F.array_join("chunks", structure.DISPLAY_GLUE)
    return structure.chunks_of_files(files).select("repo", "path", report.excerpt(text, "standard").alias("excerpt"))


# Dependencies.


@query
def deps_go(spark: SparkSession, sf: str) -> DataFrame:
    return deps.deps_go(_manifests(spark, sf))


@query
def deps_node(spark: SparkSession, sf: str) -> DataFrame:
    return deps.deps_node(_manifests(spark, sf))


@query
def deps_python(spark: SparkSession, sf: str) -> DataFrame:
    return deps.deps_python(_manifests(spark, sf))


@query
def deps_anywhere(spark: SparkSession, sf: str) -> DataFrame:
    return deps.dependencies(_manifests(spark, sf), anywhere=True)


@query
def deps_report(spark: SparkSession, sf: str) -> DataFrame:
    return deps.deps_report(_manifests(spark, sf))


# Reports.


@query
def repo_report(spark: SparkSession, sf: str) -> DataFrame:
    files = _code(spark, sf).unionByName(fx.view(spark, sf, fx.MANIFESTS_SQL))
    return summarize.report_lines(structure.chunks_of_files(files))


@query
def repo_prompt(spark: SparkSession, sf: str) -> DataFrame:
    options = summarize.SummaryOptions(detail="brief", focus="cmd/", metrics=False)
    return summarize.prompt_lines(_code_by_file(spark, sf), options)


@query
def repo_prompt_full(spark: SparkSession, sf: str) -> DataFrame:
    """The longest form: every part of the template, whole key files, code and manifests."""
    files = _code(spark, sf).unionByName(fx.view(spark, sf, fx.MANIFESTS_SQL))
    return summarize.prompt_lines(structure.chunks_of_files(files), summarize.SummaryOptions(detail="comprehensive"))


def _count_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A generator of its own: the number of bytes of a prompt part."""
    for batch in batches:
        sizes = batch["prompt"].map(lambda p: f"{len(p.encode())} bytes")
        yield pd.DataFrame({"repo": batch["repo"], "part": batch["part"], "summary": sizes})


@query
def summary_generated(spark: SparkSession, sf: str) -> DataFrame:
    index = indexing.index_files(_code(spark, sf))
    return summarize.summarize(index, summarize.SummaryOptions(detail="brief", focus="cmd/", metrics=False), _count_lines, 4000)


@query
def prompt_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The listing of the code corpus as prompt lines, in parts of 4,000 bytes."""
    listing = structure.dir_listing(_structure(spark, sf))
    lines = listing.select(
        "repo", F.lit(report.STRUCTURE).alias("section"), F.col("dir").alias("block"), F.col("path").alias("item"),
        F.lit(0).alias("line_no"), F.col("line").alias("text"),
    )
    return report.prompt_parts(lines, 4000)
