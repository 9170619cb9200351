import random
import re

import numpy as np
import pytest
from conftest_llm import MESSY

from srcatlas.llm import language
from srcatlas.llm.html_text import read_page
from srcatlas.llm.language import BUCKETS, TEXT_WEIGHT, model, page_languages, text_likelihoods

WORDS = {"en": "the of and to in that is with for this there".split(), "de": "der die das und nicht ein mit auf für über wir".split(), "fr": "le la les des est que dans pour une avec être".split()}


def text(lang, n, rng):
    return " ".join(rng.choices(WORDS[lang], k=n))


def page(lang, declared, rng, n=60):
    return f"<html{f' lang={declared!r}' if declared else ''}><body><p>{text(lang, n, rng)}</p></body></html>"


def test_held_out_accuracy_by_text(make_docs):
    rng = random.Random(1)
    langs, table = model(make_docs([(i, text(lang, 80, rng), "s", lang) for lang in WORDS for i in range(30)] + [(9, None, "s", "xx"), (9, "?", "s", None)]))
    assert langs == sorted(WORDS)
    for lang in WORDS:
        for _ in range(30):
            scores = text_likelihoods(text(lang, 15, rng), table)
            assert langs[scores.index(max(scores))] == lang
    assert text_likelihoods("", table) == [0.0] * 3


def test_evidence_is_fused(spark, make_docs):
    rng = random.Random(2)
    docs = make_docs([(i, text(lang, 80, rng), "s", lang) for lang in WORDS for i in range(30)])
    tld = {"en": "com", "de": "de", "fr": "fr"}
    rows = [(i, f"http://{lang}{i % 5}.site{lang}.{tld[lang]}/a", page(lang, lang, rng)) for lang in WORDS for i in range(40)]
    rows += [
        (900, "http://de1.sitede.de/b", "<html><body></body></html>"),  # no text, no declaration: host and suffix
        (901, "http://new.example/", page("fr", "en", rng)),  # wrongly declared: the text wins
        (902, None, None),
        (903, "http://x.org/", "<html lang='de'></html>"),  # declaration alone
        (903, "http://x.org/", "<html lang='de'></html>"),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, lang string")
    got = page_languages(pages, docs).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    assert [by_id[i].lang for i in (900, 901, 903)] == ["de", "fr", "de"] and by_id[902].lang in WORDS
    assert all(0 < r.score <= 1.0 + 1e-9 for r in got)
    assert sum(r.page_id < 100 and r.lang == r.declared for r in got) == 120
    assert page_languages(pages.limit(0), docs).count() == 0


def test_no_labels(spark, make_docs, empty):
    pages = spark.createDataFrame([(1, "http://a.org/", "<p>x</p>")], "page_id long, url string, html string")
    assert page_languages(pages, empty).collect()[0].lang is None
    assert len(MESSY)


def slow_languages(pages, docs):
    """The whole fusion in plain Python: page_id -> (language, score, text language, declared, suffix)."""
    counts = {}
    for lang, text in docs:
        if lang is not None and text is not None:
            counts[lang] = counts.get(lang, 0) + slow_trigrams(text)
    langs = sorted(counts)
    table = np.stack([(counts[x] + 1) / (counts[x] + 1).sum() for x in langs], axis=1)
    rows = []
    for page_id, url, html in pages:
        html, url = html or "", url or ""
        found = slow_trigrams("\n".join(t for t, _ in read_page(html).blocks)) if read_page(html).blocks else np.zeros(BUCKETS, int)
        total = found.sum()
        ll = np.array(found @ np.log(table).astype("float32") / total * min(total, TEXT_WEIGHT) if total else np.zeros(len(langs)))
        p = np.exp(ll - ll.max())
        sure = langs[int(ll.argmax())] if 1 / p.sum() >= 0.9 else None
        m = re.search(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})", html)
        host = m2[1].lower() if (m2 := re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", url)) else ""
        step = m3[1].lower() if (m3 := re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", url)) else ""
        rows.append({"id": page_id, "ll": ll, "lang": sure, "declared": m[1].lower() if m else None, "suffix": f"{host.split('.')[-1]}/{step}",
                     "host": host, "domain": ".".join(host.split(".")[-3:])})

    def share(key, row, lang):
        n = sum(r[key] == row[key] and r["lang"] == lang for r in rows)
        return (n + 1) / (sum(r["lang"] == lang for r in rows) + len({r[key] for r in rows}) + 1)

    everywhere = np.array([sum(r["lang"] == x for r in rows) + 1.0 for x in langs])
    out = {}
    for r in rows:
        own, prior = np.array([float(r["lang"] == x) for x in langs]), everywhere / everywhere.sum()
        for key in ("domain", "host"):
            left = np.array([float(sum(o[key] == r[key] and o["lang"] == x for o in rows)) for x in langs]) - own
            prior = (left + prior * 5) / (left.sum() + 5)
        post = r["ll"] + np.log(prior) + np.log([share("declared", r, x) for x in langs]) + np.log([share("suffix", r, x) for x in langs])
        out[r["id"]] = (langs[int(post.argmax())], 1 / np.exp(post - post.max()).sum(), r["lang"], r["declared"], r["suffix"])
    return out


def slow_trigrams(text):
    data, out = f" {text.lower()} ".encode(), np.zeros(BUCKETS, int)
    for a, b, c in zip(data, data[1:], data[2:]):
        out[((a * 961 + b * 31 + c) * 2654435761 % 2**32) >> 18] += 1
    return out


def test_the_fusion_matches_brute_force(spark):
    rng = random.Random(12)
    words = {"en": "the and with that this from have".split(), "de": "der und mit dass dies von haben".split(), "fr": "le et avec que cette de avoir".split()}
    say = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    docs = [(rng.choice(list(words)),) for _ in range(60)]
    docs = [(lang, say(lang, 40)) for (lang,) in docs] + [(None, "x"), ("en", None)]
    pages = []
    for i in range(70):
        lang, other = rng.choice(list(words)), rng.choice(list(words))
        tag = rng.choice([f"<html lang='{lang}-XX'>", f"<html lang={other}>", "<html>", ""])
        url = rng.choice([f"http://{lang}.site.org/{lang}/x", f"https://u@www.{other}.de:80/a", "http://shared.example.com/", "no url", None])
        body = rng.choice([f"<p>{say(lang, rng.randint(1, 30))}</p>", f"<p>{say(lang, 3)} {say(other, 3)}</p>", ""])
        pages.append((i, url, rng.choice([tag + body] * 9 + [None])))
    got = page_languages(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "lang string, text string"))
    wanted = slow_languages(pages, docs)
    assert len({w[0] for w in wanted.values()}) == 3
    for r in got.collect():
        lang, score, text_lang, declared, suffix = wanted[r.page_id]
        assert (r.lang, r.text_lang, r.declared, r.suffix) == (lang, text_lang, declared, suffix)
        assert r.score == pytest.approx(score, rel=1e-4)


def test_a_dirty_language_column_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGS", 3)
    docs = [(f"x{i:03}", "abc") for i in range(50)] + [("en", "the and that")] * 3 + [("de", "und der das")] * 2
    assert language.model(spark.createDataFrame(docs, "lang string, text string"))[0] == ["de", "en", "x000"]
