import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from srcatlas.llm.packing import SEQUENCE
from srcatlas.session import names_in, shared_dir
from test_mixing import slow_targets
from test_quality import slow_counts
from test_simhash import slow_components, slow_fingerprint


def body(i, n=90):
    rng = random.Random(i)
    return " ".join("".join(rng.choices("abcdefghijklm", k=rng.randint(2, 9))) for _ in range(n))


def rows():
    out = [(i, body(i, 60 + i % 90), "abc"[i % 3]) for i in range(300)]
    out += [(1000 + i, body(i % 7, 60 + i % 7 % 90), "a") for i in range(60)]  # exact copies
    out += [(2000 + i, body(i, 1500), "b") for i in range(4)] + [(2100 + i, body(i, 1500) + " end", "b") for i in range(4)]  # near copies
    out += [(3000 + i, "# $ % " * 40 + body(i), "c") for i in range(10)] + [(4000, None, None), (4001, "", "a"), (4002, "short", None)]
    return out


def test_stages_match_a_brute_force_version(spark, make_docs, tmp_path):
    docs = make_docs(rows())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept, seen = docs, [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(str(tmp_path / f"s{len(seen)}"))
        kept = spark.read.parquet(str(tmp_path / f"s{len(seen)}"))
        seen.append(kept)
    texts = [[(r.doc_id, r.text, r.source) for r in s.collect()] for s in seen[:5]]
    assert all(s.columns == docs.columns for s in seen[:5])

    good = [r for r in texts[0] if (c := slow_counts(r[1]))[0] >= 50 and c[4] * 2 <= c[0] and c[2] * 50 <= c[1]]
    assert sorted(texts[1]) == sorted(good)
    last = {}
    for r in good:
        last[r[1]] = max(last.get(r[1], -1), r[0])
    assert sorted(r[0] for r in texts[2]) == sorted(last.values())
    prints = {r[0]: slow_fingerprint(r[1]) for r in texts[2]}
    groups = slow_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert sorted(r[0] for r in texts[3]) == sorted(set(groups.values()))
    sizes, taken = {}, {}
    for r in texts[3]:
        sizes[r[2]] = sizes.get(r[2], 0) + len(r[1].split())
    for r in texts[4]:
        taken[r[2]] = taken.get(r[2], 0) + len(r[1].split())
    assert taken == pytest.approx(slow_targets(sizes), rel=0.05)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = seen[5].collect()
    assert sum(r.length for r in pieces) == sum(len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for r in texts[4])
    assert max(r.offset + r.length for r in pieces) <= SEQUENCE
    ids = {r[0]: tokenizer.encode(r[1], add_special_tokens=False).ids + [0] for r in texts[4]}
    assert all(np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length] for r in pieces)
    left = set(names_in(spark, shared_dir(spark)))
    total = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert {n.rsplit("-", 1)[0] for n in set(names_in(spark, shared_dir(spark))) - left} == {"packing"}
    assert abs(total - len(pieces)) <= 2 + len(pieces) // 10


def test_empty_table(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_columns_with_names_like_those_of_working_columns_pass(spark, make_docs, tmp_path):
    clash = ["__sa_uid", "__sa_f", "__sa_size", "__sa_length", "__sa_fp", "__sa_kept", "__SA_digest", "carried_13"]
    docs = make_docs(rows()[:80])
    for i, c in enumerate(clash):
        docs = docs.withColumn(c, F.lit(i))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    assert {tuple(r) for r in kept.select(*clash).distinct().collect()} == {tuple(range(len(clash)))}
    assert corpus_pipeline.packing(spark, kept, str(tmp_path)).count() > 0
