"""Chunking rules: hand-made cases and a comparison with a plain transcription of the rules."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from srcatlas.functions.text import WHITESPACE
from srcatlas.operators.chunk import line_chunks, paragraph_blocks, paragraph_chunks


def contents(df):
    return [r.content for r in df.orderBy("file", "chunk_idx").collect()]


@pytest.mark.parametrize(
    ("text", "limit", "expected"),
    [
        ("a\n\n\nb", 8000, ["a\n\nb"]),
        ("aaaa\n\nbbbb", 8, ["aaaa\n\nbbbb"]),
        ("aaaaa\n\nbbbb", 8, ["aaaaa", "bbbb"]),
        ("x" * 20, 8, ["x" * 20]),
        ("éé\n\néé", 7, ["éé", "éé"]),
        ("\n\n \t\n\n", 8000, []),
        ("", 8000, []),
        ("a\r\n\r\nb", 8000, ["a\r\n\r\nb"]),
        ("a" * 600 + "\n\n" + "b" * 600, 0, ["a" * 600, "b" * 600]),
        ("\u3000a\u2003\n\n\u00a0b\u0085", 8000, ["a\n\nb"]),
        ("  a\n  b", 8000, ["a\n  b"]),
    ],
)
def test_paragraphs(files, text, limit, expected):
    assert contents(paragraph_chunks(files({"f": text}), limit)) == expected


@pytest.mark.parametrize(
    ("text", "limit", "expected"),
    [
        ("aa\nbb\ncc", 5, ["aa\nbb", "cc"]),
        ("\na\n\nb", 100, ["a\n\nb"]),
        ("a\r\nb\r\n", 100, ["a\nb"]),
        ("a\n\n", 100, ["a\n"]),
        ("a\n\r", 100, ["a\n"]),
        ("a\r\r\nb", 100, ["a\r\nb"]),
        ("a\nb", 0, ["a", "b"]),
        ("", 10, []),
        ("x" * 70000, 10, ["x" * 70000]),
    ],
)
def test_lines(files, text, limit, expected):
    assert contents(line_chunks(files({"f": text}), limit)) == expected


def test_blocks(files):
    rows = paragraph_blocks(files({"f": "x\n y\n\nz", "g": "x\n", "h": "\n \t\n"})).orderBy("file", "start_line").collect()
    assert [(r.file, r.start_line, r.end_line, r.content) for r in rows] == [
        ("f", 1, 2, "x\n y"), ("f", 4, 4, "z"), ("g", 1, 1, "x"),
    ]


def size(s):
    return len(s.encode())


def packed_paragraphs(text, limit):
    limit = limit if limit > 0 else 1000
    out, cur = [], ""
    for piece in text.split("\n\n"):
        piece = piece.strip(WHITESPACE)
        if not piece:
            continue
        if cur and size(cur) + size(piece) > limit:
            out.append(cur)
            cur = ""
        cur = cur + "\n\n" + piece if cur else piece
        if size(cur) >= limit:
            out.append(cur)
            cur = ""
    return out + [cur] if cur else out


def packed_lines(text, limit):
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    out, cur = [], ""
    for line in lines:
        line = line.removesuffix("\r")
        if cur and size(cur) + size(line) + 1 > limit:
            out.append(cur)
            cur = ""
        cur = cur + "\n" + line if cur else line
    return out + [cur] if cur else out


TEXTS = st.lists(st.text(alphabet="ab é\n\n\n\r\t\u3000", max_size=60), min_size=1, max_size=40)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=TEXTS, limit=st.integers(0, 12))
def test_against_transcription(files, texts, limit):
    df = files([("r", f"{i:03d}", t) for i, t in enumerate(texts)])
    for operator, plain in ((paragraph_chunks, packed_paragraphs), (line_chunks, packed_lines)):
        got = {}
        for r in operator(df, limit).orderBy("file", "chunk_idx").collect():
            assert r.chunk_idx == len(got.setdefault(r.file, []))
            got[r.file].append(r.content)
        assert got == {f"{i:03d}": c for i, t in enumerate(texts) if (c := plain(t, limit))}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=TEXTS)
def test_every_line_with_text_is_in_one_block(files, texts):
    df = files([("r", f"{i:03d}", t) for i, t in enumerate(texts)])
    got = {}
    for r in paragraph_blocks(df).collect():
        for n, line in enumerate(r.content.split("\n"), r.start_line):
            assert n <= r.end_line
            assert (r.file, n) not in got
            got[r.file, n] = line
    want = {
        (f"{i:03d}", n): line
        for i, t in enumerate(texts)
        for n, line in enumerate(t.split("\n"), 1)
        if line.strip(WHITESPACE)
    }
    assert got == want


def test_same_result_for_any_partitioning(files):
    df = files([("r", f"{i}", f"a{i}\n\nb\n\n" * (i % 7)) for i in range(200)])
    one = sorted(map(tuple, paragraph_chunks(df.repartition(1), 10).collect()))
    assert one == sorted(map(tuple, paragraph_chunks(df.repartition(8), 10).collect()))
    assert one


def test_fold_is_evaluated_once(files):
    plan = paragraph_chunks(files({"f": "a"}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("aggregate(") == 2  # blocks, and the pieces of one
    assert "Exchange" not in plan
