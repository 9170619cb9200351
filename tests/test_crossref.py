"""Cross-references against brute force, with unusual names, skew and long runs."""

import base64
import random

from pyspark.sql import functions as F

from srcatlas.operators import crossref
from srcatlas.operators.crossref import PREFIXES, WINDOW, imported_by, prefix_filters, prefix_rows
from srcatlas.operators.importance import importance, key_files


def brute(rows):
    out = {}
    for repo, path, text in rows:
        name = path.rsplit("/", 1)[-1]
        stem = name.rsplit(".", 1)[0] if "." in name else name
        out[repo, path] = sum(1 for r, p, t in rows if r == repo and p != path and stem in t)
    return out


def spark_counts(spark, rows):
    df = spark.createDataFrame(rows, "repo string, path string, text string")
    return {(r.repo, r.path): r.imported_by for r in imported_by(df).collect()}


def test_substring_counts(spark):
    rows = [("r", "main.go", "x"), ("r", "a/b.py", "the domain"), ("r", ".py", "main"), ("q", "main.go", "domain")]
    assert spark_counts(spark, rows) == brute(rows)
    assert brute(rows)["r", "main.go"] == 2 and brute(rows)["r", ".py"] == 2


def test_random_names_and_texts(spark):
    rng = random.Random(7)
    pieces = ["a", "b", "ab", "Ab", "é", "-", ".", " ", "\n", "日本", "a.b", "_", "$", "\\"]
    rows, seen = [], set()
    for _ in range(160):
        repo = rng.choice(["r", "r", "q", "s"])
        name = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 4))).replace("/", "") + rng.choice([".py", ".go", "", ".t"])
        path = rng.choice(["", "d/", "d/e/"]) + name
        if (repo, path) in seen or not name:
            continue
        seen.add((repo, path))
        rows.append((repo, path, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))))
    assert spark_counts(spark, rows) == brute(rows)


def test_long_runs_and_long_names(spark):
    long_stem = "n" * 40 + "Z" * 300
    blob = "q" * 1000 + long_stem + "q" * 700 + "edge" + "w" * 255 + "tail"
    rows = [("r", f"{long_stem}.py", "x"), ("r", "edge.js", "y"), ("r", "wtail.c", "z"), ("r", "blob.txt", blob),
            ("r", "my file-1.js", "q"), ("r", "other.md", "p" * 255 + "my file-1" + "p" * 600)]
    assert spark_counts(spark, rows) == brute(rows)


def test_hot_repository_and_hot_names(spark):
    """One repository holds most files, most of them share a stem and a keyword that contains stems."""
    rows = [("hot", f"d{i}/index.js", f"import x{i} port") for i in range(900)]
    rows += [("hot", "port.js", "import"), ("hot", "im.js", "none"), ("cold", "index.js", "index"), ("cold", "a.py", "index")]
    got = spark_counts(spark, rows)
    assert got["hot", "port.js"] == 900
    assert got["hot", "im.js"] == 901
    assert got["hot", "d5/index.js"] == 0
    assert got["cold", "index.js"] == 1
    assert len(got) == len(rows)


def test_score_and_top_files(spark):
    rows = [("r", f"cmd/f{i}.go", "func main() {}\n" * i) for i in range(8)] + [("r", "z/a.txt", "f3 f4")]
    scored = importance(spark.createDataFrame(rows, "repo string, path string, text string"))
    by_path = {r.path: r for r in scored.collect()}
    f3 = by_path["cmd/f3.go"]
    assert (f3.imports, f3.patterns, f3.imported_by, f3.path_score, f3.depth) == (0, 15.0, 1, 2.0, 2)
    expected = (4 / 1000 * 0.2 + (1 / 2) * 0.15 + 2.0 * 0.2 + 0 * 0.15 + 1 * 0.2 + 15.0 * 0.1) * 10
    assert f3.score == expected
    top = [r.path for r in key_files(scored, "brief").orderBy("rank").collect()]
    assert top == ["cmd/f7.go", "cmd/f6.go", "cmd/f5.go"]
    assert key_files(scored, "anything").count() == 5
    assert key_files(scored, "brief", focus="z/").count() == 0


def test_a_window_gives_a_row_per_place_and_class_at_most(spark):
    """Stems of 43 lengths: the rows do not follow the number of lengths, and hold no more text than the longest stem of their class."""
    rng = random.Random(5)
    window = base64.b64encode(rng.randbytes(300)).decode().replace("+", "_").replace("/", "_")[:WINDOW]
    stems = [("r", window[i : i + n], n) for n in range(1, 44) for i in (3, 90)]
    q = lambda n: max(c for c in PREFIXES if c <= n)
    anchors = spark.createDataFrame([(r, b, q(n), b[: q(n)]) for r, b, n in stems], "repo string, base string, q int, prefix string")
    rows = prefix_rows(spark.createDataFrame([("r", "f", window)], "repo string, path string, run string"), anchors)
    counts = {r.q: r["count"] for r in rows.groupBy("q").count().collect()}
    assert set(counts) == set(PREFIXES) and max(counts.values()) <= WINDOW and counts[1] <= 64
    assert {r.q: r.n for r in rows.groupBy("q").agg(F.max(F.char_length("piece")).alias("n")).collect()} == {1: 1, 2: 2, 3: 3, 4: 7, 8: 43}


def test_noise_with_names_of_many_lengths(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    noise = "".join(rng.choices(letters, k=60_000))
    names = {noise[i : i + n] for n in range(1, 44) for i in rng.sample(range(60_000 - n), 3)} | {"".join(rng.choices(letters, k=n)) for n in range(2, 44)}
    rows = [("r", f"d/{n}.py", rng.choice(["x", noise[:300], " ".join(rng.sample(sorted(names), 4))])) for n in sorted(names)] + [("r", "noise.txt", noise)]
    assert spark_counts(spark, rows) == brute(rows)


def test_a_hot_stem_of_one_character(spark):
    rows = [("r", f"f{i}/name{i}.py", f"aeiou{i} eee xyz{i % 7}") for i in range(400)] + [("r", "e.js", "none"), ("r", "ou.js", "e"), ("q", "e.js", "no")]
    assert spark_counts(spark, rows) == brute(rows)


def test_prefixes_that_no_stem_has_do_not_leave_the_window(spark, monkeypatch):
    """The filter of a repository lets all its own prefixes through, hardly any other, and those of other repositories neither."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choices(letters, k=WINDOW)) for _ in range(40)]
    stems = [("r", w[100:112]) for w in words[:5]] + [("q", words[6][20:32]), ("empty", "zzzz")]
    keys = [(r, b, 8, b[:8]) for r, b in stems[:-1]] + [("empty", "zzzz", 4, "zzzz")]
    anchors = spark.createDataFrame(keys, "repo string, base string, q int, prefix string")
    runs = spark.createDataFrame([(r, str(i), w) for r in ("r", "q") for i, w in enumerate(words)], "repo string, path string, run string")
    wanted = {("r", str(i), 8, w[100:112]) for i, w in enumerate(words[:5])} | {("q", "6", 8, words[6][20:32])}
    found = {tuple(r) for r in prefix_rows(runs, anchors).collect()}
    assert wanted <= found and len(found) < 0.15 * 2 * len(words) * WINDOW
    assert {r.repo: len(r.bits) for r in prefix_filters(anchors).collect()} == {"r": 2, "q": 1, "empty": 1}

    monkeypatch.setattr("srcatlas.operators.crossref.MAX_WORDS", 1)  # a full filter costs rows and loses none
    assert wanted <= {tuple(r) for r in prefix_rows(runs, anchors).collect()}
    assert {r.repo: len(r.bits) for r in prefix_filters(anchors).collect()} == {"r": 1, "q": 1, "empty": 1}


def test_pieces_of_a_text_equal_the_candidates_of_expressions(spark):
    """Whole texts are cut by arrays in Python, runs by expressions: both give the same pieces."""
    rng = random.Random(8)
    signs = ["a", "b1", "_", " ", "  ", "\n", "-", ".", "é", "漢", "😀", "\t"]
    rows = []
    for n in range(300):
        places = sorted({(o, o + 1 + rng.randint(0, 4)) for o in (rng.randint(0, 3) for _ in range(rng.randint(1, 3)))})
        rows.append((n, "".join(rng.choices(signs, k=rng.randint(0, 30))), rng.choice(" \n-."), max(e - o - 1 for o, e in places), places))
    df = spark.createDataFrame(rows, "n int, text string, anchor string, tail int, places array<struct<o:int,n:int>>")
    for r in df.withColumn("wanted", crossref._candidates(F.col("text"))).collect():
        got = crossref.pieces_of_text(r.text, r.anchor, [p.asDict() for p in r.places])
        assert sorted(got) == sorted(r.wanted)


def test_whole_texts_go_to_python(spark):
    """Each blank of a text cost a lambda per place and length."""
    rows = [("r", "a b.py", "a b x-y"), ("r", "x-y.py", "a  b, x-y.z; x-y"), ("r", "i.j.py", "i.j a b\nx-y"), ("s", "k.l.py", ""), ("s", "m n.py", "k.l m\nn m n")]
    texts = spark.createDataFrame(rows, "repo string, path string, text string")
    got = {(r.repo, r.path): r.imported_by for r in crossref.imported_by(texts).collect()}
    assert got == {("r", "a b.py"): 1, ("r", "x-y.py"): 2, ("r", "i.j.py"): 0, ("s", "k.l.py"): 1, ("s", "m n.py"): 0}
    stems = spark.createDataFrame([("r", "a b")], "repo string, base string")
    plan = crossref._spaced_hits(texts, stems)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
