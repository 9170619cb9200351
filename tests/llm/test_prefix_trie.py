import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from srcatlas.llm.prefix_trie import NO_ENDS, hashed_lists, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, `a.b` int"


def tid(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def slow_trie(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, tid(r, x), r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members = {}
    for c, v in made.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for path, m in members.items():
        d = len(path)
        sub = [p for p in members if p[:d] == path]
        inner = {p[:-1] for p in members if p}
        ends = ",".join(str(c) for c in sorted(c for c in m if len(made[c]) == d))
        out.append((
            min(m), d, min(members[path[:-1]]) if d else None, len(m), sum(len(p) == d + 1 for p in sub), sum(p not in inner for p in sub),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in sub if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def made(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(partitions)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(rng, n, deep=6, words=("a", "b", "é", None)):
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, deep)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("container_rows", [1, 7, 4096])
def test_nodes_match_brute_force(spark, container_rows):
    rng = random.Random(container_rows)
    rows = conversations(rng, 60) + [(c, t, "user", "same") for c in range(200, 230) for t in range(12)] + [(None, 1, "user", "lost")]
    rows += [(500, t, "user", f"long {t}") for t in range(60)] + [(505 + i, 3, "x", "y") for i in range(4)]
    assert got(prefix_trie(made(spark, rows), container_rows)) == slow_trie(rows)


def test_one_deep_chain_of_copies(spark):
    rows = [(c, t, "u", f"{t}" * 3) for c in (10, 15, 20) for t in range(40)]
    assert got(prefix_trie(made(spark, rows), 4)) == slow_trie(rows)
    assert got(prefix_trie(made(spark, rows[:40]), 4)) == slow_trie(rows[:40])


def test_repeated_rows_turnless_and_long_texts(spark):
    rows = [(1, 0, "u", "x" * 100_000), (1, 0, "u", "x" * 100_000), (1, 0, "u", None), (7, None, None, None), (12, 1, "u", "t"), (3, 0, "", "")]
    assert got(prefix_trie(made(spark, rows))) == slow_trie(rows)
    only = [(7, 0, "u", "t")]  # 7 takes its own turns after the first h only, and conversation 5 is absent
    assert zlib.crc32(b"7") % 9 > 0 and got(prefix_trie(made(spark, only))) == [(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())]


def test_an_empty_table_has_no_node(spark):
    assert prefix_trie(made(spark, [])).collect() == []


def test_lists_are_hashed_over_pieces(spark, monkeypatch):
    from srcatlas.llm import prefix_trie as module

    monkeypatch.setattr(module, "PIECE_IDS", 3)
    rows = [(1, i) for i in range(1, 1000, 7)] + [(5, 5), (5, -2)]
    found = {r.end_rep: r.ends_sha256 for r in hashed_lists(spark.createDataFrame(rows, "rep long, conv_id long").repartition(5)).collect()}
    wanted = {rep: hashlib.sha256(",".join(map(str, sorted(i for r, i in rows if r == rep))).encode()).hexdigest() for rep in (1, 5)}
    assert found == wanted and NO_ENDS not in found.values()


def test_the_input_is_not_read_by_one_task(spark):
    rows = [(3, t, "u", f"t{t % 5}") for t in range(3000)]
    assert prefix_trie(made(spark, rows), 50).agg(F.max("depth")).first()[0] == 3000 - zlib.crc32(b"3") % 9
