"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds (email, ip, card, phone) follow the fixed patterns below, leftmost and without overlap within a kind; a match
that fails its check is dropped and nothing inside it is tried again.  Added kinds are ``iban`` (mod 97) and ``national``
(three-two-four digits, only with a telling word nearby).  A score never removes a base span.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm.common import whole_text

# Kinds in order, patterns and bounds of the base spans.
BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["iban", "national"]
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive forms of the fixed patterns: a start inside a run of digits could only repeat the run's own failure.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
CARD_DIGITS = (13, 19)
PHONE_DIGITS = (9, 15)

#: Score of a confirmed span before its context is seen.
START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "national": 0.4}
#: Words that raise or lower the score of a kind when they stand within CONTEXT_CHARS of the span.
TELLING = {
    "email": ["mail", "contact", "write", "correo", "courriel"],
    "ip": ["ip", "address", "host", "server", "adresse"],
    "card": ["card", "visa", "credit", "karte", "carte", "tarjeta", "payment"],
    "phone": ["phone", "call", "tel", "mobile", "telefon", "llame"],
    "iban": ["iban", "account", "bank", "konto", "compte", "cuenta"],
    "national": ["ssn", "social", "security", "identity"],
}
MISLEADING = {"ip": ["version", "release", "section"], "card": ["isbn", "order", "serial", "tracking"], "phone": ["isbn", "order"]}
CONTEXT_CHARS = 40
CONTEXT_STEP = 0.2
ACCEPT_ADDED = 0.5

_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """Checksum of card numbers: every second digit from the right counts double, digits of the double added."""
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    """Checksum of account numbers: the first four characters go last, letters count from 10."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @, back over the local part and on over the domain: as the pattern finds them, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if PHONE_DIGITS[0] <= sum(c in "0123456789" for c in m[0]) <= PHONE_DIGITS[1]:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest run of groups that passes the checksum: words in capitals after the number do not hide it."""
    for m in IBAN.finditer(text):
        ends = [len(m[0]), *[i for i in range(len(m[0]) - 1, 14, -1) if m[0][i] == " "]]
        for end in ends:
            plain = m[0][:end].replace(" ", "")
            if 15 <= len(plain) <= 34 and mod97(plain):
                yield m.start(), m.start() + end
                break


def _nationals(text: str) -> Iterator[tuple[int, int]]:
    for m in NATIONAL.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield m.span()


FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "national": _nationals}


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    words = {w.lower() for w in _WORD.findall(near)}
    up, down = not words.isdisjoint(TELLING[kind]), not words.isdisjoint(MISLEADING.get(kind, ()))
    return min(1.0, max(0.0, START_SCORE[kind] + CONTEXT_STEP * up - CONTEXT_STEP * down))


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; code points, end exclusive."""
    spans = [(k, a, b, _score(text, k, a, b)) for k in BASE_KINDS for a, b in FINDERS[k](text)]
    starts = sorted(spans, key=lambda s: s[1])
    keys = [s[1] for s in starts]
    for kind in ADDED_KINDS:
        for a, b in FINDERS[kind](text):
            i = bisect_left(keys, b)
            inside = i and any(s[1] <= a and b <= s[2] for s in starts[max(0, i - len(BASE_KINDS)) : i])
            score = _score(text, kind, a, b)
            if score >= ACCEPT_ADDED and not inside:
                spans.append((kind, a, b, score))
    return spans


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"


def _row(text: str) -> tuple:
    spans = find_spans(text)
    named = [f"{k}:{a}:{b}" for k, a, b, _ in spans]
    base = ",".join(n for n, s in zip(named, spans) if s[0] in BASE_KINDS)
    counts = [sum(s[0] == k for s in spans) for k in BASE_KINDS]
    return *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(named), ",".join(f"{s[3]:.1f}" for s in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, counts of the base kinds, ``spans`` as kind:start:end and their ``scores``.

    A null or empty text has no spans: counts 0, empty strings.  Repeated rows give repeated rows; no row is shuffled, and
    texts alone go to the Python workers.
    """

    @F.pandas_udf(FOUND)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([_row(t) for t in batch], columns=[c.split()[0] for c in FOUND.split(", ")])

    return docs.select("doc_id", find(whole_text()).alias("found")).select("doc_id", "found.*")
