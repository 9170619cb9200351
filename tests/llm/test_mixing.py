import random

import pytest
from conftest_llm import MESSY
from pyspark.sql import functions as F

from srcatlas.llm.mixing import MAX_REPEAT, mixed, mixture, targets


def slow_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in stopped]
        if not free:
            return {s: MAX_REPEAT * sizes[s] for s in order}
        rest = total - sum(MAX_REPEAT * sizes[s] for s in stopped)
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if share[s] > MAX_REPEAT * sizes[s]}
        if not above:
            return {s: MAX_REPEAT * sizes[s] if s in stopped else share[s] for s in order}
        stopped |= above


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100, None: 50},
        {"a": 10_000, "b": 1, "c": 2, "d": 3, "é": 5, "Z": 7},
        {"a": 0, "b": 10},
        {"a": 0},
        {f"s{i:02d}": (i * 37) % 11 * 100 for i in range(25)},
        {},
    ],
)
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "__sa_source string, source_size long")
    got = {r[0]: r.target for r in targets(rows).collect()}
    assert got == pytest.approx(slow_targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def make(n):
    rng = random.Random(n)
    return [(i, "w " * rng.randint(1, 300), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]


def test_taken_words_come_near_the_targets(make_docs):
    rows = make(900)
    docs = make_docs(rows)
    got = mixture(docs).collect()
    source, goal, taken = {r[0]: r[2] for r in rows}, {}, {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        goal[source[r.doc_id]] = r.target
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    for s in goal:
        assert taken[s] == pytest.approx(goal[s], rel=0.02)
    assert sorted(map(tuple, mixture(docs.repartition(7)).collect())) == sorted(map(tuple, got))
    copies = {r.doc_id: r["count"] for r in mixed(docs).groupBy("doc_id").count().collect()}
    assert copies == {r.doc_id: r.taken // r.size for r in got if r.taken}


def test_messy_rows(messy, empty):
    got = mixture(messy).collect()
    assert len(got) == len(MESSY) and {r.doc_id: r.size for r in got}[2] == 0
    assert mixed(messy).columns == messy.columns
    assert mixture(empty).count() == 0 and mixed(empty).count() == 0


def test_no_python_in_the_plan(messy):
    for df in (mixture(messy), mixed(messy)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert mixed(messy).where(F.col("a").isNotNull()).count() == 0
