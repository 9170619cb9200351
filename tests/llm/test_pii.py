import hashlib
import random
import re

from conftest_llm import MESSY

from srcatlas.llm.pii import find_spans, luhn, mod97, personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def slow_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and slow_luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(7)
    bits = ["a", "b.c", "@", ".", "x@y.de", "1", "25", "255", "256", "0001", "1.2.3.4", "+", "+1 (", ")", "-", " ", "4111 1111 1111 1111", "é", "٣", "%", "\n", "5500-0000-0000-0004"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randint(1, 14)))
        base = [s[:3] for s in find_spans(text) if s[0] in PATTERNS]
        assert base == slow_base(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 500_000, "+1" + " " * 1_000_000, "a@" * 300_000, "1 " * 500_000):
        find_spans(text)


def test_checksums_and_added_kinds():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("DE89370400440532013000") and not mod97("DE88370400440532013000")
    text = "Konto: DE89 3704 0044 0532 0130 00 HERE, wrong DE88370400440532013000, ssn 078-05-1120 but order 078-05-1120"
    spans = {(k, text[a:b]) for k, a, b, _ in find_spans(text) if k in ("iban", "national")}
    assert ("iban", "DE89 3704 0044 0532 0130 00") in spans and not any("DE88" in s for _, s in spans)
    assert ("national", "078-05-1120") in spans
    assert not [s for s in find_spans("part 078-05-1120 of nothing") if s[0] == "national"]


def test_context_moves_the_score_but_keeps_base_spans():
    near, far = find_spans("call +1 (555) 555-0100"), find_spans("isbn +1 (555) 555-0100")
    assert near[0][:1] == far[0][:1] == ("phone",) and near[0][3] > far[0][3]


def test_rows(messy, make_docs, empty):
    rows = personal_data(messy).collect()
    assert len(rows) == len(MESSY) and all(r.spans == "" and r.n_email == 0 for r in rows)
    assert personal_data(empty).count() == 0
    text = "é mail me@x.org or 10.0.0.1, 4111111111111111"
    (row,) = personal_data(make_docs([(1, text)])).collect()
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in slow_base(text))
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 0)
    assert row.spans == base and row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_large_numbers_of_documents_are_kept_beside_null_ones(spark):
    ids = [9007199254740993, None, 9007199254740995, -(2**63), 2**63 - 1]
    rows = spark.createDataFrame([(i, "a@b.de") for i in ids], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id for r in personal_data(rows).collect()), key=lambda i: (i is None, i or 0)) == sorted(ids, key=lambda i: (i is None, i or 0))
