"""Line chunks of one file by many tasks."""

import random

import pytest

from srcatlas.operators.chunk import line_chunks
from srcatlas.sources.code_tree import list_code_files, stream_line_chunks
from srcatlas.sources.split_lines import entered, split_line_chunks, table_of


def slow_entered(sizes, used, limit):
    begun = 0
    for size in sizes:
        if used and used + size + 1 > limit:
            used = 0
        if used:
            used += 1 + size
        elif size:
            used, begun = size, begun + 1
    return used, begun


def test_tables_take_every_state_as_a_walk_does():
    rng = random.Random(2)
    for _ in range(2000):
        limit = rng.randint(1, 12)
        sizes = [rng.choice([0, 0, 1, 2, 3, 5, 20]) for _ in range(rng.randint(0, 14))]
        table = table_of(sizes, limit)
        assert len(table["full"]) <= limit + 1
        for used in range(0, limit + 4):
            assert entered(table, used, limit)[1:] == slow_entered(sizes, used, limit), (sizes, used, limit)


@pytest.mark.parametrize("limit,range_bytes", [(1, 1), (7, 3), (7, 10), (50, 16), (500, 64)])
def test_chunks_equal_those_of_whole_files(spark, files, tmp_path, limit, range_bytes):
    rng = random.Random(limit * range_bytes)
    texts = [b"", b"\n", b"a", b"a\n", b"a\r\n\r\nb\r", b"\n\n", b"x" * 40 + b"\ny", "é\n".encode() * 30, b"one\n\ntwo  \n\n\nthree", b"\r", b"z" * 300, b"a\n\r", b"bad \xe2\x82 byte\n\xff\n"]
    bits = [b"a", b"bb", b"\n", b"\n", b"\r\n", b"\n\n", "é".encode(), b"x" * 9, b"\xff", b" "]
    texts += [b"".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(15)]
    (tmp_path / "r").mkdir()
    for i, text in enumerate(texts):
        (tmp_path / "r" / f"f{i}.py").write_bytes(text)
    listing = list_code_files(spark, f"{tmp_path}/r")
    got = sorted((r.file, r.chunk_idx, r.content) for r in split_line_chunks(listing, limit, range_bytes).collect())
    assert got == sorted((r.file, r.chunk_idx, r.content) for r in stream_line_chunks(listing, limit).collect())
    plain = [(i, t.decode()) for i, t in enumerate(texts) if b"\xff" not in t and b"\xe2\x82 " not in t]
    want = line_chunks(files([("r", f"f{i}.py", t) for i, t in plain]), limit).collect()
    names = {f"f{i}.py" for i, _ in plain}
    assert [g for g in got if g[0] in names] == sorted((r.file, r.chunk_idx, r.content) for r in want)
