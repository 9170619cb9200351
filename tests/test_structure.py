"""Paths, languages, listings, dependencies and reports."""

import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from srcatlas.functions import text as tx
from srcatlas.operators import deps, report, structure
from srcatlas.operators.select import code_files
from srcatlas.operators.skew import hot_keys, salted_join
from srcatlas.plans.indexing import index_files
from srcatlas.plans.summarize import SummaryOptions, prompt_lines, summarize

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.mark.parametrize(
    ("path", "ext", "stem", "directory", "language"),
    [
        ("a/b.py", ".py", "b", "a", "Python"),
        ("A.PY", ".PY", "A", ".", "Unknown"),
        ("x.c", ".c", "x", ".", "C"),
        ("d.e/x", "", "x", "d.e", "Unknown"),
        ("/a.go", ".go", "a", "/", "Go"),
        (".gitignore", ".gitignore", "", ".", "Unknown"),
        ("a.", ".", "a", ".", "Unknown"),
        ("/x/y.test.ts", ".ts", "y.test", "/x", "TypeScript"),
    ],
)
def test_paths(files, path, ext, stem, directory, language):
    p = F.col("path")
    row = files({path: ""}).select(tx.extension(p), tx.stem(p), tx.directory(p), tx.language(p)).first()
    assert tuple(row) == (ext, stem, directory, language)


def test_selection(files):
    df = files({p: "" for p in ("UP.PY", "build/b.py", "src/__init__.py", "build.py", "a/dist/b/c.go", "x.mod", "a/build", "venv.js")})
    assert {r.path for r in code_files(df).collect()} == {"src/__init__.py", "build.py", "venv.js"}


def by_file(spark, rows):
    return spark.createDataFrame(rows, "repo string, path string, chunks array<string>")


def test_lines_and_languages(spark):
    df = by_file(spark, [("r", "a.py", ["a\nb", "c"]), ("r", "b.go", ["x\n\ny"]), ("r", "c.zz", ["q"] * 50), ("r", "d.js", ["1\n2"]),
                         ("r", "e.c", ["1"]), ("s", "n.zz", ["1"])])
    st = structure.file_structure(df)
    assert {r.path: r["loc"] for r in st.where("repo = 'r'").collect()} == {"a.py": 3, "b.go": 3, "c.zz": 50, "d.js": 2, "e.c": 1}
    rows = {r.repo: (r.languages, r.files, r["loc"]) for r in structure.repo_overview(st).collect()}
    assert rows == {"r": ("Go, Python, JavaScript", 5, 59), "s": ("", 1, 1)}
    lines = [r.line for r in structure.dir_listing(st).where("repo = 's'").orderBy("dir", "path").collect()]
    assert lines == ["Root directory:", "  - n.zz (Unknown, 1 lines)"]


def test_dependencies(spark):
    package = '{\n "dependencies": {"a": ">=1 <2",\n "b":"1,2"},', ' "devDependencies" : {\n\t"c": "3"}}'
    df = by_file(spark, [
        ("r", "go.mod", ["module m\n\ngo 1.2", "require (\n\tx v1 // indirect\n)"]),
        ("r", "package.json", list(package)),
        ("r", "requirements.txt", ["# c\n flask==1 \n", "\tz"]),
        ("s", "sub/go.mod", ["module m"]),
        ("t", "go.mod", ["module m"]),
        ("u", "package.json", ['{"devDependencies": {}}']),
    ])
    rows = deps.dependencies(df).orderBy("repo", "ecosystem", F.desc("scope"), "pos").collect()
    assert [(r.repo, r.ecosystem, r.scope, r.pos, r.spec) for r in rows] == [
        ("r", "go", "runtime", 0, "require ("), ("r", "go", "runtime", 1, "x v1 // indirect"), ("r", "go", "runtime", 2, ")"),
        ("r", "node", "runtime", 0, "a:>=1<2"), ("r", "node", "runtime", 1, "b:1"), ("r", "node", "runtime", 2, "2"),
        ("r", "node", "dev", 0, "c:3"),
        ("r", "python", "runtime", 0, "flask==1"), ("r", "python", "runtime", 1, "z"),
    ]
    lines = {}
    for r in deps.deps_report(df).orderBy("repo", "block", "pos").collect():
        lines.setdefault(r.repo, []).append(r.line)
    assert lines["s"] == ["No standard dependency files detected."]
    assert lines["t"] == ["Go Dependencies:"]
    assert lines["u"] == ["Node.js Dependencies:", "Dev Dependencies:"]
    assert lines["r"][:2] == ["Go Dependencies:", "- require ("] and "Dev Dependencies:" in lines["r"]


def test_two_decimals(spark):
    values = [0.145, 0.125, 0.375, 2.675, 1.005, 81.765, 3.0, 0.999, 7.994999, 4.305, 1234.565, 0.15, 0.005, 99.995]
    values += [i / 1000 for i in range(0, 9000, 7)]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", report.fixed2(F.col("x")).alias("s"))
    for r in df.collect():
        assert r.s == f"{r.x:.2f}"


def test_excerpt(spark):
    long = "\n".join(f"line {i} " + "x" * 40 for i in range(101))
    few = "\n".join("y" * 100 for _ in range(100))
    df = spark.createDataFrame([(long,), (few,), ("short\n" * 200,)], "t string")
    cut, same, small = (r[0] for r in df.select(report.excerpt(F.col("t"), "standard")).collect())
    lines = long.split("\n")
    assert cut == "\n".join(lines[:50]) + "\n...[middle section omitted]...\n" + "\n".join(lines[-50:])
    assert (same, small) == (few, "short\n" * 200)
    assert df.select(report.excerpt(F.col("t"), "comprehensive")).first()[0] == long


def count_lines(batches):
    for b in batches:
        yield pd.DataFrame({"repo": b.repo, "part": b.part, "summary": b.prompt.str.len().astype(str)})


def test_whole_summary(spark, files):
    df = files([("big", f"d{i % 5}/f{i}.py", f"def f{i}(): pass\n\nf{i + 1}") for i in range(120)] + [("one", "cmd/main.go", "func main() {}")])
    index = index_files(df)
    facts = summarize(index)
    lines = [r.text for r in facts.where("repo = 'one'").orderBy(*report.ORDER).collect()]
    assert lines == [
        "Codebase Context:", "- Primary Languages: Go", "- Total Files: 1", "- Total Lines of Code: 1", "Codebase structure:",
        "Directory cmd:", "  - main.go (Go, 1 lines)", "Project Dependencies:", "No standard dependency files detected.",
        "Key files content:", "--- cmd/main.go (Importance: 9.75) ---", "func main() {}",
    ]
    options = SummaryOptions(detail="comprehensive", metrics=True)
    prompt = prompt_lines(structure.chunks_by_file(index), options)
    ordered = {}
    for r in prompt.orderBy(*report.ORDER).collect():
        ordered.setdefault(r.repo, []).append(r.text)
    parts = {}
    for r in report.prompt_parts(prompt, 700).orderBy("repo", "part").collect():
        parts.setdefault(r.repo, []).append(r.prompt)
    assert {k: "\n".join(v) for k, v in parts.items()} == {k: "\n".join(v) for k, v in ordered.items()}
    assert len(parts["big"]) > 3
    assert report.PromptTemplate().metrics[0] in ordered["one"]
    answers = summarize(index, options, generator=count_lines, max_prompt_bytes=1 << 20).collect()
    assert {r.repo: int(r.summary) for r in answers} == {k: len("\n".join(v)) for k, v in ordered.items()}


def test_salted_join_is_a_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(0, 3000, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left"):
        got = sorted(map(tuple, salted_join(left, right, ["k"], ["v"], how=how).select("k", "v", "w").collect()), key=str)
        assert got == sorted(map(tuple, left.join(right, "k", how).select("k", "v", "w").collect()), key=str)


@pytest.mark.parametrize("share", [0.0005, 0.01, 0.5])
def test_hot_keys_are_dealt_by_rows_per_task(spark, share):
    n = 20_000
    hot_rows = int(n * share)
    left = spark.range(n).select(F.when(F.col("id") < hot_rows, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = left.select("k").distinct().withColumn("w", F.col("k") * 2)
    hot = hot_keys(left.groupBy("k").count(), ["k"], "count", rows_per_task=100)
    assert [(r.k, r._fan) for r in hot.collect()] == ([(-1, -(-hot_rows // 100))] if hot_rows > 100 else [])
    joined = salted_join(left, right, ["k"], ["v"], rows_per_task=100)
    assert joined.count() == n and joined.where("w <> k * 2").count() == 0
