import hashlib
from collections import defaultdict

from conftest_llm import MESSY
from pyspark.sql import functions as F

from srcatlas.llm import exact
from srcatlas.llm.exact import drop_exact_duplicates, exact_duplicates


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1] or ""].append(row[0])
    out = []
    for row in rows:
        ids = [i for i in groups[row[1] or ""] if i is not None]
        keep = max(ids) if ids else None
        digest = hashlib.sha256((row[1] or "").encode()).hexdigest()
        out.append((row[0], keep, len(groups[row[1] or ""]), row[0] == keep, digest))
    return sorted(out, key=repr)


def run(docs):
    sha = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    got = exact_duplicates(docs, sha).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    return sorted(map(tuple, got), key=repr)


def test_messy_rows(messy, empty):
    assert run(messy) == expected(MESSY)
    assert run(empty) == []


def test_texts_that_differ_after_the_prefix_only(make_docs):
    start = "p" * exact.PREFIX_CHARS
    rows = [(i, start + f"{i % 7:04d}" + "é" * (i % 2)) for i in range(60)] + [(100 + i, start + "x" * i) for i in range(9)]
    assert run(make_docs(rows)) == expected(rows)


def test_a_full_bitmap_only_costs_time(make_docs, monkeypatch):
    monkeypatch.setattr(exact, "FILTER_BITS", 8)
    rows = [(i, f"text {i // 3}") for i in range(90)]
    assert run(make_docs(rows)) == expected(rows)


def test_hot_group(make_docs):
    rows = [(i, "same") for i in range(3000)] + [(5000 + i, f"other {i}") for i in range(3000)]
    assert run(make_docs(rows)) == expected(rows)


def test_one_row_stays(messy, empty):
    kept = drop_exact_duplicates(messy)
    assert kept.columns == messy.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 3, 4, 5, 7, 8, 9, 10]
    assert kept.where("doc_id is null").count() == 1
    assert drop_exact_duplicates(empty).count() == 0


def test_of_repeated_rows_one_stays(make_docs):
    docs = make_docs([(1, "a"), (1, "a"), (2, "b"), (2, "b"), (2, "b"), (None, "c"), (None, "c")])
    assert drop_exact_duplicates(docs).count() == 3
