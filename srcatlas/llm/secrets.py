"""Secrets: patterns and a wide net propose spans, a character network reads each with its context.

Base kinds (assign, access, hex) follow the fixed patterns below, leftmost and without overlap within a kind; a match that is
too short is dropped and nothing in it is tried again.  The wide net takes every run of SHAPE characters outside base spans
(kind ``other``).  The network scores every span; base spans stay whatever their score, others are kept from the threshold on.

The network is trained on labelled findings of the corpus: base findings are true, other runs are not, and in the texts of a
bounded sample of documents made-up credentials and made-up harmless names stand for what the patterns miss.  Findings are split
by a hash into those to train, to calibrate and to test with.
"""

from __future__ import annotations

import base64
import random
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.llm.char_cnn import CharCnn, Window, calibrate, fit
from srcatlas.llm.common import free_name, whole_text

# Kinds in order, patterns and least lengths of the base spans.
BASE_KINDS = ["assign", "access", "hex"]
OTHER = "other"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

#: Characters a credential is made of, and the least length of a run that the wide net takes.
SHAPE = r"A-Za-z0-9+/_.=~-"
RUN_CHARS = 16
RUN = re.compile(rf"(?<![{SHAPE}])[{SHAPE}]{{{RUN_CHARS},}}")
_KEYWORDS = ("password", "passwd", "secret", "token", "api")

CONTEXT_BEFORE, CONTEXT_AFTER = 32, 16
#: Documents whose findings are labelled, and the most findings that train and test the network.
SAMPLE_DOCS = 3_000
MAX_FINDINGS = 12_000
#: A finding to learn from is left out if its span is longer.
LEARNT_CHARS = 400
SHARES = {"train": 60, "calibrate": 80, "test": 100}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed; code points, end exclusive."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    # both other kinds are made of SHAPE characters and longer than a run must be
    for run in RUN.finditer(text):
        a, b = run.span()
        out += [("access", *m.span()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= ACCESS_CHARS]
        out += [("hex", *m.span()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= HEX_CHARS]
    return sorted(out, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def other_spans(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Runs of SHAPE characters, without marks at their ends, that meet no base span."""
    taken, i = sorted((a, b) for _, a, b in base), 0
    for run in RUN.finditer(text):
        kept = run[0].strip(".=-_~")
        start = run.start() + run[0].find(kept) if kept else run.end()
        end = start + len(kept)
        while i < len(taken) and taken[i][1] <= run.start():
            i += 1
        if len(kept) >= RUN_CHARS and not any(a < end and start < b for a, b in _until(taken, i, end)):
            yield OTHER, start, end


def _until(spans: list[tuple[int, int]], i: int, end: int) -> Iterator[tuple[int, int]]:
    while i < len(spans) and spans[i][0] < end:
        yield spans[i]
        i += 1


def window(text: str, start: int, end: int) -> Window:
    return text[max(0, start - CONTEXT_BEFORE) : start], text[start:end], text[end : end + CONTEXT_AFTER]


# Labelled findings.

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ALNUM = _LETTERS + "0123456789"


def _draw(rng: random.Random, letters: str, n: int) -> str:
    return "".join(rng.choices(letters, k=n))


def _credential(rng: random.Random) -> str:
    """A made-up credential in one of the usual forms."""
    form = rng.randrange(8)
    if form == 0:
        return rng.choice(["ghp_", "gho_", "glpat-", "npm_", "sk_live_", "pk_live_", "xoxb-", "sk-"]) + _draw(rng, _ALNUM, rng.randint(20, 40))
    if form == 1:
        return base64.b64encode(rng.randbytes(rng.randint(18, 48))).decode().rstrip("=")
    if form == 2:
        return ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256"}', rng.randbytes(30), rng.randbytes(32)))
    if form == 3:
        return "AIza" + _draw(rng, _ALNUM + "-_", 35)
    if form == 4:
        return rng.randbytes(rng.randint(12, 32)).hex().upper()
    return _draw(rng, _ALNUM + ("+/" if form == 5 else "-_" if form == 6 else ""), rng.randint(16, 64))


def _harmless(rng: random.Random, words: list[str]) -> str:
    """A made-up long name that is no credential, from words of the text around it where a form has words."""
    some = [w for w in rng.choices(words, k=rng.randint(3, 6))] if words else ["long", "plain", "name"]
    form = rng.randrange(9)
    if form == 0:
        return str(uuid.UUID(bytes=rng.randbytes(16)))
    if form == 1:
        return f"20{rng.randint(10, 29)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}.{rng.randint(0, 59):02}.{rng.randint(0, 59):02}"
    if form == 2:
        return _draw(rng, "0123456789", rng.randint(16, 30))
    if form == 3:
        return "".join(w.capitalize() for w in some)
    if form == 4:
        return rng.choice("_-./").join(some) + rng.choice(["", f"{rng.randint(1, 99)}", f".v{rng.randint(1, 9)}.{rng.randint(0, 20)}"])
    if form == 5:
        return "/".join(some) + rng.choice([".html", ".py", ".json", f"/{rng.randint(1, 9999)}"])
    if form == 6:
        return rng.choice("=-_.~") * rng.randint(4, 20) + rng.choice(some) + rng.choice("=-_.~") * rng.randint(14, 30)
    if form == 7:
        return f"mail{rng.randint(1, 99)}.{some[0]}.example.com"
    return "".join(some)


def _learnt(text: str, rng: random.Random) -> Iterator[tuple[str, str, str, str, int]]:
    """(origin, before, span, after, label) of one text: its own findings and two made-up ones in places of its own."""
    base = base_spans(text)
    for spans, label in ((base, 1), (other_spans(text, base), 0)):
        for kind, a, b in spans:
            if b - a <= LEARNT_CHARS:
                yield (kind, *window(text, a, b), label)
    for label in (1, 0):
        space = re.compile(r"\s|\Z").search(text, rng.randint(0, len(text)))
        at = space.start()
        made = _credential(rng) if label else _harmless(rng, re.findall(r"[A-Za-z]{2,12}", text[max(0, at - 2000) : at + 2000]))
        if len(made) >= RUN_CHARS:
            mark = rng.choice([" ", " ", ' "', "(", ": ", " = "])
            yield "made", (text[max(0, at - CONTEXT_BEFORE) : at] + mark)[-CONTEXT_BEFORE:], made, (rng.choice([" ", '" ', ") ", "\n"]) + text[at:])[:CONTEXT_AFTER], label


LABELLED = "origin string, before string, span string, after string, label int, draw long"


def labelled_findings(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, most: int = MAX_FINDINGS) -> DataFrame:
    """``origin``, ``before``, ``span``, ``after``, ``label`` (1 true, 0 not), ``draw``: findings of about ``sample_docs``
    documents, which a hash of number and text chooses, and of them the ``most`` with the smallest draw."""
    share = F.lit(sample_docs) / docs.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    key = F.xxhash64("doc_id", "text")
    chosen = docs.where(F.col("text").isNotNull() & (F.pmod(key, F.lit(1 << 30)) < share * (1 << 30))).select(key.alias("key"), "text")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["key"], batch["text"]):
                rng = random.Random(int(key))
                rows += [(*f, rng.getrandbits(62)) for f in _learnt(text, rng)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LABELLED.split(", ")])

    found = chosen.mapInPandas(learn, LABELLED)
    return found.orderBy("draw", "span", "before", "after", "label").limit(most)


def trained(findings: DataFrame) -> CharCnn | None:
    """The network, trained and calibrated; ``findings`` is bounded (``labelled_findings``).  None without both labels in both parts."""
    rows = findings.collect()  # at most MAX_FINDINGS short windows
    parts = {name: [r for r in rows if part_of(r.draw) == name] for name in SHARES}
    if any(len({r.label for r in parts[p]}) < 2 for p in ("train", "calibrate")):
        return None
    windows = {p: [(r.before, r.span, r.after) for r in parts[p]] for p in parts}
    net = fit(windows["train"], [r.label for r in parts["train"]])
    return calibrate(net, windows["calibrate"], [r.label for r in parts["calibrate"]])


def part_of(draw: int) -> str:
    """``train``, ``calibrate`` or ``test``."""
    return next(name for name, upto in SHARES.items() if draw // 7 % 100 < upto)


# Finding.

FOUND = "array<struct<kind:string,start:long,end:long,score:double,kept:boolean>>"


def find_secrets(text: str, net: CharCnn | None) -> list[tuple[str, int, int, float | None, bool]]:
    """(kind, start, end, score, kept) of every candidate by start, then kind.  Without a network, base spans without a score."""
    base = base_spans(text)
    if net is None:
        return [(*s, None, True) for s in base]
    spans = [*base, *other_spans(text, base)]
    scores = net.scores([window(text, a, b) for _, a, b in spans])
    found = [(k, a, b, round(float(p), 4), k != OTHER or bool(p >= net.threshold)) for (k, a, b), p in zip(spans, scores)]
    return sorted(found, key=lambda s: (s[1], [*BASE_KINDS, OTHER].index(s[0])))


def with_findings(docs: DataFrame, net: CharCnn | None, out: str) -> DataFrame:
    """``docs`` with the array ``out`` (FOUND) of every candidate of the whole text; texts alone go to the Python workers."""

    @F.pandas_udf(FOUND)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ["kind", "start", "end", "score", "kept"]
        for batch in texts:
            yield pd.Series([[dict(zip(names, s)) for s in find_secrets(t, net)] for t in batch], dtype=object)

    return docs.withColumn(out, find(whole_text()))


def secret_findings(docs: DataFrame, net: CharCnn | None = None) -> DataFrame:
    """One row per kept span: the columns of ``docs`` and a struct ``finding`` (a free name if that is taken)."""
    net = net or trained(labelled_findings(docs))
    out = "finding" if "finding" not in {c.lower() for c in docs.columns} else free_name(docs, "finding")
    return with_findings(docs, net, out).withColumn(out, F.explode(F.filter(out, lambda s: s["kept"])))


def _named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, counts of the base kinds, ``base_sha256``, ``spans`` (kept ones), ``scores`` of these.

    A null or empty text has no spans: counts 0, empty strings.  Repeated rows give repeated rows; no text is shuffled but
    those of the labelled sample.  An empty table gives no rows.
    """
    net = trained(labelled_findings(docs.select("doc_id", "text")))
    rows = with_findings(docs.select("doc_id", "text"), net, "found").select("doc_id", F.filter("found", lambda s: s["kept"]).alias("kept"))
    base = F.filter("kept", lambda s: s["kind"] != OTHER)
    counts = [F.expr(f"cast(size(filter(kept, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE_KINDS]
    scores = F.array_join(F.transform("kept", lambda s: F.coalesce(F.format_number(s["score"], 4), F.lit(""))), ",")
    return rows.select("doc_id", *counts, F.sha2(_named(base), 256).alias("base_sha256"), _named(F.col("kept")).alias("spans"), scores.alias("scores"))
