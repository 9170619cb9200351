import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest_llm import MESSY
from tokenizers import Tokenizer

from srcatlas.llm.packing import SEQUENCE, ByteBpe, best_fill, packed, plan_windows, sequences

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_reference_tokenizer(reference):
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "Ab", "1", "é", "　", "\xa0", "'s", ".", "!!", "日本", "\x1c", "​", "\x85", "\r", "😀", "-", "\x00", "The", "Straße"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(8000)] + ["", " ", " a", "a ", "x" * 50_000, "word " * 20_000]
    for text, ids in zip(texts, ByteBpe(PATH).texts(pa.array(texts))):
        assert np.frombuffer(ids, "<u4").tolist() == reference(text), repr(text)


def test_added_tokens_have_the_ids_of_the_reference_tokenizer(reference):
    rng = random.Random(4)
    end = "<|endoftext|>"
    assert reference(f"a {end} b") == [64, 220, 50256, 275]
    bits = [" ", "  ", "\n", "a", "Ab", "1", "é", "'s", ".", "日本", "\r", "<|", "|>", "endoftext", "<|endoftext|", "<|ENDOFTEXT|>", end, end]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(8000)]
    texts += [end, end * 3, f"{end} ", f" {end}", f"a {end} b", f"\n\n{end}\n\n", "word " * 20_000 + end, f"x{end}" * 5000]
    for text, ids in zip(texts, ByteBpe(PATH).texts(pa.array(texts))):
        assert np.frombuffer(ids, "<u4").tolist() == reference(text), repr(text)


def slow_best(counts, opener, capacity):
    reach = {opener}
    for length, n in enumerate(counts):
        for _ in range(n - (length == opener)):
            reach |= {r + length for r in reach if r + length <= capacity}
    return max(reach)


def test_fill_is_the_closest_there_is():
    rng = random.Random(2)
    for _ in range(300):
        capacity = rng.randint(5, 40)
        counts = [0, *(rng.choice([0, 0, 1, 2, 5]) for _ in range(capacity))]
        used_lengths = [i for i, n in enumerate(counts) if n]
        if used_lengths:
            used = best_fill(counts, used_lengths[-1], capacity)
            assert all(n <= counts[k] for k, n in used.items())
            assert sum(k * n for k, n in used.items()) == slow_best(counts, used_lengths[-1], capacity)


def test_plan_places_every_piece_once():
    rng = random.Random(3)
    counts = {i: rng.randint(1, 2000) for i in range(1, SEQUENCE + 1) if rng.random() < 0.8}
    plan = plan_windows(counts)
    ranks, fill = defaultdict(list), defaultdict(int)
    for length, lo, hi, sequence, offset in plan:
        ranks[length].append((lo, hi))
        for s in (sequence, sequence + hi - lo - 1):
            fill[s] = max(fill[s], offset + length)
    for length, n in counts.items():
        spans = sorted(ranks[length])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert max(fill.values()) <= SEQUENCE
    windows = max(s + hi - lo for _, lo, hi, s, _ in plan)
    assert windows * SEQUENCE < 1.012 * sum(k * n for k, n in counts.items())


def test_round_trip(messy, make_docs, reference):
    for docs, rows in ((messy, MESSY), (make_docs([(i, f"text {i} " * (i * 7 % 900)) for i in range(120)]), None)):
        rows = rows or [(r.doc_id, r.text) for r in docs.collect()]
        pieces = packed(docs, PATH, with_ids=True)
        stored = pieces.collect()
        whole = defaultdict(list)
        held = {r.sequence_id: (r.ids, r.n_tokens) for r in sequences(pieces).collect()}
        for r in stored:
            ids, n = held[r.sequence_id]
            part = bytes(ids)[4 * r.offset : 4 * (r.offset + r.length)]
            assert part == bytes(r.ids) and zlib.crc32(part) == r.ids_crc32 and n <= SEQUENCE
            whole[r.doc_id].append((r.start, np.frombuffer(part, "<u4").tolist(), r.doc_tokens))
        want = defaultdict(list)
        for row in rows:
            ids = [*reference(row[1]), 0]
            want[row[0]] += [(at, ids[at : at + SEQUENCE], len(ids)) for at in range(0, len(ids), SEQUENCE)]
        assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in want.items()}
        offsets = defaultdict(list)
        for r in stored:
            offsets[r.sequence_id].append((r.offset, r.length))
        for spans in offsets.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_empty_table(empty):
    assert packed(empty, PATH).count() == 0
