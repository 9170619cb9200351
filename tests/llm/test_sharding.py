import random
import zlib

from conftest_llm import MESSY
from pyspark.sql import functions as F

from srcatlas.llm.sharding import SLACK, bounded_shards, ring, stretches


def test_stretches_give_every_byte_a_shard_within_the_bound():
    rng = random.Random(1)
    _, owners = ring(5, 20)
    sizes = {a: rng.randint(1, 5000) for a in range(len(owners)) if rng.random() < 0.9}
    sizes[17] = 60_000
    out = stretches(sizes, owners, 5)
    bound = -int(-sum(sizes.values()) * (1 + SLACK) // 5)
    load = [0] * 5
    for arc, size in sizes.items():
        parts = sorted((lo, hi) for a, lo, hi, _ in out if a == arc)
        assert parts[0][0] == 0 and parts[-1][1] == size and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
    for _, lo, hi, shard in out:
        load[shard] += hi - lo
    assert max(load) <= bound


def test_a_new_shard_moves_few_documents():
    (p16, o16), (p17, o17) = ring(16), ring(17)
    assert set(zip(p16, o16)) <= set(zip(p17, o17))


def test_shards_are_near_equal_and_slots_gapless(make_docs):
    rng = random.Random(2)
    rows = [(i, "x" * min(4000, int(rng.paretovariate(1.1) * 30))) for i in range(4000)]
    got = bounded_shards(make_docs(rows)).collect()
    text = dict(rows)
    size, slots = [0] * 16, [[] for _ in range(16)]
    for r in got:
        assert r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in got) == list(range(4000))
    assert max(size) - min(size) <= 4000 / 2
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_one_key_with_a_third_of_all_rows_is_spread(make_docs):
    rows = [(7, "same text")] * 1000 + [(100 + i, f"text {i}") for i in range(2000)]
    sizes = [r[0] for r in bounded_shards(make_docs(rows)).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 16 and max(sizes) <= 1.05 * sum(sizes) / 16


def test_messy_rows(messy, empty):
    got = bounded_shards(messy).collect()
    assert len(got) == len(MESSY)
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id in (2, 3, 8)) == [(2, 1), (3, 1), (8, len(MESSY[10][1].encode()) + 1)]
    assert bounded_shards(empty).count() == 0


def test_shards_and_slots_do_not_depend_on_the_partitions(make_docs):
    rng = random.Random(6)
    rows = [(rng.choice([None, i]), "y" * rng.randint(0, 900)) for i in range(800)] + [(5, "same")] * 30
    got = [sorted(((r.doc_id or -1, r.size, r.text_crc32, r.shard, r.slot) for r in bounded_shards(make_docs(rows, n)).collect())) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2]


def test_a_new_shard_moves_a_small_part_of_the_documents(make_docs):
    rng = random.Random(7)
    docs = make_docs([(i, "z" * rng.randint(100, 900)) for i in range(3000)])
    old, new = ({r.doc_id: r.shard for r in bounded_shards(docs, n).collect()} for n in (16, 17))
    moved = [i for i in old if old[i] != new[i]]
    # a seventeenth of all must move; bounded loads move some more, far from the 16 in 17 that a remainder would
    assert len(moved) / len(old) < 0.2 and sum(new[i] == 16 for i in moved) / len(old) > 0.04
