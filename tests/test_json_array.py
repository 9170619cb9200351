"""JSON arrays read by byte ranges."""

import json
import random

import pytest

from srcatlas.schemas import CHUNKS
from srcatlas.sources.index_store import read_index_json, write_index_array
from srcatlas.sources.json_array import ESCAPED, INSIDE, OUTSIDE, OWN_TASKS, TASK_BYTES, array_objects, objects, outcome, outcomes, range_tasks


def states(data):
    """(inside a string or after a backslash, open brackets) before each byte and at the end, byte by byte."""
    out, state, depth = [], OUTSIDE, 0
    for c in data:
        out.append((state, depth))
        if state == ESCAPED:
            state = INSIDE
        elif state == INSIDE:
            state = ESCAPED if c == 92 else OUTSIDE if c == 34 else INSIDE
        elif c == 34:
            state = INSIDE
        else:
            depth += (c in b"[{") - (c in b"]}")
    return [*out, (state, depth)]


def made(rng):
    texts = ['a"b', "\\\\", '\\"', "{[", "]}", "é漢😀", "x" * 30, "", "line\nend", '","']
    rows = [{"file": rng.choice(texts), "content": "".join(rng.choices(texts, k=3)), "embedding": [rng.random() for _ in range(rng.randint(0, 3))], "o": {"deep": [{"x": "}"}]}} for _ in range(rng.randint(0, 9))]
    return rows, json.dumps(rows, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5).encode()


def test_outcomes_and_objects_match_a_reading_byte_by_byte():
    rng = random.Random(3)
    for _ in range(400):
        rows, data = made(rng)
        known, size = states(data), rng.choice([1, 2, 3, 7, 20, 100])
        found = []
        for start in range(0, len(data), size):
            part, (state, depth) = data[start : start + size], known[start]
            end, grown = known[min(len(data), start + size)]
            assert outcome(part, state) == (end, grown - depth)
            more = (data[i : i + 5] for i in range(start + size, len(data), 5))
            found += [(start + at, json.loads(text)) for at, text in objects(part, state, depth, more)]
        assert [r for _, r in sorted(found, key=lambda x: x[0])] == rows


@pytest.mark.parametrize("range_bytes", [16, 1000, 1 << 20])
def test_arrays_of_several_files_are_read_by_several_tasks(spark, tmp_path, range_bytes):
    rng, wanted = random.Random(range_bytes), []
    for name in ("one.json", "two.json", "empty.json"):
        rows = [{"file": f"f{rng.randint(0, 3)}", "content": rng.choice(["a\n", '"\\', "{é", "]"]) + str(i), "embedding": [i / 2]} for i in range(0 if name == "empty.json" else 40)]
        (tmp_path / name).write_text(json.dumps(rows, indent=2))
        seen = {}
        for r in rows:
            seen[r["file"]] = seen.get(r["file"], -1) + 1
            wanted.append((f"file:{tmp_path}/{name}", r["file"], seen[r["file"]], r["content"], r["embedding"]))
    got = read_index_json(spark, str(tmp_path), range_bytes=range_bytes).collect()
    assert sorted((r.repo.replace("file://", "file:"), r.file, r.chunk_idx, r.content, r.embedding) for r in got) == sorted(wanted)
    if range_bytes == 16:
        assert array_objects(spark, str(tmp_path), range_bytes).rdd.getNumPartitions() > 100


def test_many_ranges_share_tasks(spark, tmp_path):
    rows = [{"file": "f", "content": "text " * 30 + str(i), "embedding": [i / 2]} for i in range(400)]
    (tmp_path / "all.json").write_text(json.dumps(rows))
    got = array_objects(spark, str(tmp_path), 50)  # some 1,600 ranges
    assert got.rdd.getNumPartitions() == OWN_TASKS
    assert [json.loads(r.json) for r in sorted(got.collect(), key=lambda r: r.at)] == rows
    assert [range_tasks(*x) for x in ((3, 900, 8), (100, 900, 8), (100_000, 900, 8), (100_000, 1000 * TASK_BYTES, 8))] == [8, 100, OWN_TASKS, 1001]


def test_an_object_of_many_blocks_is_read_behind_its_range(spark, tmp_path):
    rows = [{"file": "f", "content": 'a"\\' * 200_000, "embedding": []}, {"file": "f", "content": "b", "embedding": [1.0]}]
    (tmp_path / "all.json").write_text(json.dumps(rows))
    assert [r.content for r in read_index_json(spark, str(tmp_path), range_bytes=1000).orderBy("chunk_idx").collect()] == [r["content"] for r in rows]


def test_export_computes_the_index_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    index = spark.createDataFrame([("r", f"f{i}", 0, f"text {i}", [float(i)]) for i in range(50)], CHUNKS)
    write_index_array(index.mapInPandas(count, CHUNKS), str(tmp_path / "out"))
    assert seen.value == 50
    assert read_index_json(spark, str(tmp_path / "out")).count() == 50


def test_outcomes_of_all_states_at_once():
    rng = random.Random(5)
    for _ in range(500):
        part = bytes(rng.choices(b'ab"\\{}[]\n', k=rng.randint(0, 12)))
        assert outcomes(part) == [outcome(part, s) for s in (OUTSIDE, INSIDE, ESCAPED)]
