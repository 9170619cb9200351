import random
import re

import xxhash
from conftest_llm import MESSY
from pyspark.sql import functions as F

from srcatlas.llm.components import components
from srcatlas.llm.simhash import RADIUS, TABLES, drop_near_duplicates, fingerprint, links, masks, near_duplicates


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprint_matches_slow_version():
    rng = random.Random(3)
    texts = ["", " ", "a", "A b", "a b c", "ÄÖ x\tY\vz", *(" ".join(rng.choices(["The", "of", "Näh", "x", "."], k=n)) for n in range(1, 60))]
    for text in texts:
        assert fingerprint(text.encode()) == slow_fingerprint(text)


def test_fingerprint_of_a_text_longer_than_a_piece():
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdef", k=rng.randint(1, 9))) for _ in range(250_000))
    assert len(text) > 1 << 20
    assert fingerprint(text.encode()) == slow_fingerprint(text)


def test_every_pair_of_positions_is_left_out_by_some_table():
    kept = masks()
    assert len(kept) == TABLES == 2 ** (RADIUS + 1) - 1
    assert max(64 - m.bit_count() for m in kept) <= 28
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in kept)


def test_links_have_the_components_of_all_pairs(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.add(x - (1 << 64) if x >> 63 else x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= RADIUS
    want = slow_components(prints, near)
    edges = links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(near(r.a, r.b) for r in edges.collect())
    assert {p: got.get(p, p) for p in prints} == want


def test_a_bucket_of_thousands_is_not_opened_into_pairs(spark):
    base = 0x0123456789ABCDEF
    prints = {base ^ (1 << i) ^ (1 << j) ^ (1 << k) for i in range(21) for j in range(i, 21) for k in range(j, 21)}
    edges = links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    assert edges.count() < 40 * 7 * len(prints)
    assert components(edges).select("root").distinct().count() == 1


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 90)] + [(5, 5), (2, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 90)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_messy_rows(messy):
    got = near_duplicates(messy).collect()
    assert len(got) == len(MESSY)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for row in MESSY:
        if row[0] is not None:
            assert by_id[row[0]].fingerprint == f"{slow_fingerprint(row[1]):016x}"
    assert by_id[5].component_id == by_id[1].component_id == 1
    assert {by_id[i].component_id for i in (2, 3, 4)} == {2}
    assert by_id[7].component_id == by_id[6].component_id == 6


def test_one_row_of_each_group_stays(messy, empty):
    kept = drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 6, 8, 9, 10]
    assert sum(r.doc_id is None for r in rows) == 1
    assert kept.where(F.col("kept") == "x").count() == len(rows)
    assert drop_near_duplicates(empty).count() == 0 and near_duplicates(empty).count() == 0
