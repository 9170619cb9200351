"""Patterns, path scores and depth."""

import pytest

from srcatlas.operators.importance import file_features


@pytest.mark.parametrize(
    ("path", "text", "imports", "patterns"),
    [
        ("a.py", "from a import b", 2, 0.0),
        ("a.go", 'import (\n "a"\n "b"\n "c"\n)', 1, 0.0),
        ("a.go", 'import "x"\ntype A interface {}\nfunc main() {', 1, 7.0),
        ("a.tsx", 'import a from "x"', 0, 0.0),
        ("a.ts", "import a from 'x'\nrequire(\"y\")\nexport default class A", 2, 2.7),
        ("a.js", "interface B\nimport a\n from 'x'", 1, 2.0),
        ("a.py", 'class A:\n def __init__\nif __name__ == "__main__":', 0, 7.0),
        ("A.java", "import a.b.C;\npublic abstract class X\ninterface Y\npublic static void main", 1, 9.5),
        ("a.py", "import\x0bos", 0, 0.0),
        ("a.js", "import a\u2028b from 'x'", 1, 0.0),
    ],
)
def test_counts(spark, path, text, imports, patterns):
    df = spark.createDataFrame([("r", path, text)], "repo string, path string, text string")
    row = file_features(df).first()
    assert (row.imports, round(row.patterns, 9)) == (imports, patterns)


@pytest.mark.parametrize(
    ("path", "score", "depth"),
    [("cmd/api/core/util.go", 6.0, 4), ("a.go", 0.0, 1), ("/x/a.go", 0.0, 3), ("Main/HELPER.go", 2.7, 2)],
)
def test_paths(spark, path, score, depth):
    df = spark.createDataFrame([("r", path, "x\n" * 1500)], "repo string, path string, text string")
    row = file_features(df).first()
    assert round(row.path_score, 9) == score and row.depth == depth and row.loc_factor == 1.0
