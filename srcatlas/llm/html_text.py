"""Main text of web pages by consensus of a host's pages on where its articles stand.

Every page is read once into a tree of block elements.  A container's score is its text outside links times the square of
that text's share in text and links below it, weighed by its tag, so the container that holds the article and little else
comes first.  Text that is left out (comments, adverts) has no say.  A container that adds text of its own (a title, an
introduction) to the best container in it scores at least as much as both, if it adds little else.
Pages vote for the generalised paths of their good containers (tags with classes, digits masked); votes are added up per
host in Spark, and every page is read again with its host's winning path.  A page where that path is missing, or holds far
less than the page's own best container, uses its own best.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.session import durable

# Elements by what they mean for the text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object svg math canvas textarea title".split())
#: Raw elements whose content runs to the end of the page where the end tag is missing; the others are passed over as tags.
TO_THE_END = set("script style textarea title".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
LEFT_OUT = set("nav header footer aside form menu dialog button select fieldset head".split())
CLOSES_P = set("address article aside blockquote body center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CONTAINERS = set("article main section div td body center blockquote html".split())
ROOTS = set("html body article main".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
NOISE_WORDS = set(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising banner sponsor sponsored"
    " promo promotion cookie cookies consent notice notices notification alert popup modal overlay newsletter subscribe subscription signup login"
    " comment comments reply replies respond disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager widget form search toolbar".split()
)
#: Words of what readers and advertisers add, which may be longer than the article.
ADDED_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent notification alert popup newsletter"
    " subscribe subscription signup login comment comments reply replies respond disqus share sharing social related recommended".split()
)
#: Classes that make an inline element an advert.
ADVERT_CLASSES = set("ad ads advert adverts advertisement advertising sponsored".split())
#: Words after one of these in a class or id say what a page has or lacks, not what the element is.
MODIFIERS = set("has no with without".split())
#: How a node is marked: not at all, by a word or as a form (a page's wrapper may be), by words of ADDED_WORDS, by its tag, role or hidden.
CLEAN, SOFT, ADDED, HARD = range(4)
#: A marked element that holds so many times the text of what is not marked is the page's wrapper.
WRAPS = 9
NOISE_ROLES = set("navigation banner contentinfo complementary search menu dialog alert form".split())
#: A page as a whole is the article only if no part of it is.
WEIGHT = {"article": 1.2, "main": 1.1, "body": 0.6, "html": 0.5}

VOTE_SHARE = 0.5
#: What a page may hold on its host's path at least, as a share of its own best: a container that would not be voted for is not used.
OWN_BEST_SHARE = VOTE_SHARE

#: A path with more characters is told by its digest.
PATH_CHARS = 512

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?--!?>|.*\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<attrs>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+|[^<>]*)>|<[!?/][^<>]*>", re.S
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class _Node:
    tag: str
    path: str
    parent: int
    mark: int = CLEAN
    article: bool = False  # an article or main element, and not one of a reader's or advertiser's
    noise: bool = False
    text: int = 0  # characters outside links and noise, here and below
    other: int = 0  # characters in links outside noise, here and below
    own: int = 0  # characters outside links and noise, not in a container below
    blocks: tuple[int, int] = (0, 0)


@dataclass
class Page:
    """Block containers of a page and its blocks of text, in page order."""

    nodes: list[_Node] = field(default_factory=list)
    blocks: list[tuple[str, bool]] = field(default_factory=list)
    places: list[tuple[int, int]] = field(default_factory=list)  # node and characters outside links of each block


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(source)} if source.strip() else {}


def _noise_words(attrs: dict[str, str]) -> set[str]:
    """Words of ``NOISE_WORDS`` in classes and id, each up to a modifier (``has-sidebar`` has none)."""
    found: set[str] = set()
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in _PART.findall(name)]
        stop = next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))
        found |= NOISE_WORDS.intersection(words[:stop])
    return found


def _hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def _left_out_inline(attrs: dict[str, str]) -> bool:
    """Hidden, or an advert by a class of just that name: other classes of inline elements say how words look (``hljs-comment``)."""
    return _hidden(attrs) or not ADVERT_CLASSES.isdisjoint(attrs.get("class", "").lower().split())


def _mark(tag: str, attrs: dict[str, str]) -> int:
    if tag in LEFT_OUT:
        return SOFT if tag in ("form", "fieldset") else HARD
    if tag in ROOTS or not attrs:
        return CLEAN
    if _hidden(attrs) or attrs.get("role", "").lower() in NOISE_ROLES:
        return HARD
    words = _noise_words(attrs)
    return CLEAN if not words else ADDED if words & ADDED_WORDS else SOFT


def _path(above: str, tag: str, attrs: dict[str, str]) -> str:
    """The generalised path of an element below the path ``above``; a long one is a digest, so paths do not grow with the depth."""
    classes = sorted({re.sub(r"\d+", "0", c.lower()) for c in attrs.get("class", "").split()})
    step = ".".join([tag, *classes])
    path = f"{above}>{step}" if above else step
    return path if len(path) <= PATH_CHARS else "#" + hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def read_page(source: str) -> Page:
    """Read a page of any size in one pass; never fails on broken markup: unmatched end tags are ignored."""
    page = Page()
    stack: list[int] = []
    spots: dict[str, list[int]] = {}  # where in the stack each tag is open
    parts: list[str] = []
    links = 0
    noisy_inline: list[str] = []
    linked = 0
    unclosed: dict[str, int] = {}  # from where on a raw element has no end tag

    def open_node(tag: str, attrs: dict[str, str]) -> None:
        up = page.nodes[stack[-1]] if stack else None
        path = _path(up.path if up else "", tag, attrs)
        article = tag == "main" or tag == "article" and not _noise_words(attrs) & ADDED_WORDS
        page.nodes.append(_Node(tag, path, stack[-1] if stack else -1, _mark(tag, attrs), article, blocks=(len(page.blocks), -1)))
        spots.setdefault(tag, []).append(len(stack))
        stack.append(len(page.nodes) - 1)

    def close_top() -> None:
        node = page.nodes[stack.pop()]
        spots[node.tag].pop()
        node.blocks = (node.blocks[0], len(page.blocks))

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                page.blocks.append((text, False))
                page.places.append((stack[-1], max(0, len(text) - linked)))
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if not text:
            return
        if "&" in text:
            text = entities.unescape(text)
        if noisy_inline:
            return
        parts.append(text)
        if links:
            linked += len(text.strip())

    open_node("html", {})
    at = 0
    while True:
        m = _TOKEN.search(source, at)
        add(source[at : m.start() if m else len(source)])
        if not m:
            break
        at = m.end()
        if not m["tag"]:
            continue
        tag, ends = m["tag"].lower(), bool(m["end"])
        if tag in RAW and not ends:
            if tag in ("svg", "math") and m[0].endswith("/>"):
                continue
            if at > unclosed.get(tag, len(source)):
                continue
            close = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            if close:
                at = close.end()
            elif tag in TO_THE_END:
                at = len(source)
            else:
                unclosed[tag] = at
            continue
        if tag in ("br", "wbr"):
            add(" " if tag == "br" else "")
            continue
        if tag == "a":
            links = max(0, links - 1) if ends else links + 1
            continue
        if tag in INLINE:
            if ends:
                if noisy_inline and noisy_inline[-1] == tag:
                    noisy_inline.pop()
            elif noisy_inline:
                noisy_inline += [tag] if tag == noisy_inline[0] else []
            elif m["attrs"] and _left_out_inline(_attributes(m["attrs"])):
                noisy_inline.append(tag)
            continue
        flush()
        links, noisy_inline = 0, []
        if tag in VOID:
            continue
        if ends:
            if spots.get(tag) and tag not in ("html", "body"):
                depth = spots[tag][-1]
                while len(stack) > depth:
                    close_top()
            continue
        if tag in CLOSES_P and stack and page.nodes[stack[-1]].tag == "p":
            close_top()
        if tag in SAME_LEVEL:
            depth = max((spots[t][-1] for t in SAME_LEVEL[tag] if spots.get(t)), default=-1)
            if depth > max((spots[t][-1] for t in SCOPE[tag] if spots.get(t)), default=-1):
                while len(stack) > depth:
                    close_top()
        if tag in ("html", "body") and spots.get(tag):
            continue
        open_node(tag, _attributes(m["attrs"]))
    flush()
    while stack:
        close_top()
    _settle(page)
    return page


def _wrappers(page: Page) -> set[int]:
    """Marked nodes that are the page's wrapper and not noise, decided by what they hold and what stands outside marked nodes.

    The largest go first, those of readers and advertisers last.  Where nothing but marked nodes has text, all that are not
    ``HARD`` are read.
    """
    nodes = page.nodes
    if not any(n.mark in (SOFT, ADDED) for n in nodes):
        return set()
    text, articles = [0] * len(nodes), [int(n.article) for n in nodes]  # here and below, outside HARD nodes
    for at, own in page.places:
        text[at] += own
    clean, clean_articles = text[:], articles[:]  # outside all marked nodes below
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        if nodes[i].mark != HARD:
            text[up] += text[i]
            articles[up] += articles[i]
        if nodes[i].mark == CLEAN:
            clean[up] += clean[i]
            clean_articles[up] += clean_articles[i]
    found: set[int] = set()
    outside, articles_outside = clean[0], clean_articles[0]
    large = sorted((i for i, n in enumerate(nodes) if n.mark in (SOFT, ADDED) and text[i] > outside), key=lambda i: (-text[i], i))
    if not large:
        return found
    above = [-1] * len(nodes)  # the nearest marked ancestor
    for i, n in enumerate(nodes[1:], 1):
        above[i] = n.parent if nodes[n.parent].mark else above[n.parent]
    for kinds in ((SOFT,), (SOFT, ADDED)):
        for i in large:
            n = nodes[i]
            if n.mark not in kinds or i in found or above[i] >= 0 and above[i] not in found or articles_outside or text[i] <= outside:
                continue
            much = text[i] > WRAPS * outside
            if (articles[i] and much) if n.mark == ADDED else (articles[i] or n.tag == "form" or much):
                found.add(i)
                outside += clean[i]
                articles_outside += clean_articles[i]
    return found if outside else {i for i, n in enumerate(nodes) if n.mark in (SOFT, ADDED)}


def _settle(page: Page) -> None:
    """Decide which nodes and blocks are noise, and add up the text of the others."""
    nodes, wrappers = page.nodes, _wrappers(page)
    for i, n in enumerate(nodes):
        n.noise = n.parent >= 0 and nodes[n.parent].noise or n.mark != CLEAN and i not in wrappers
    page.blocks = [(text, nodes[at].noise) for (text, _), (at, _) in zip(page.blocks, page.places)]
    for (text, noise), (at, own) in zip(page.blocks, page.places):
        if not noise:
            nodes[at].text += own
            nodes[at].own += own
            nodes[at].other += len(text) - own
    for n in reversed(nodes[1:]):
        up = nodes[n.parent]
        up.text += n.text
        up.other += n.other
        if n.tag not in CONTAINERS:
            up.own += n.own


def _scored(page: Page) -> list[tuple[float, int]]:
    """(score, node) of every container with text, best first; of equal scores, the deeper one."""
    found, below = [], [(0.0, -1)] * len(page.nodes)  # best score in each node and where it stands
    for i in range(len(page.nodes) - 1, -1, -1):
        n, inside = page.nodes[i], below[i]
        if n.tag in CONTAINERS and not n.noise and n.text:
            score = n.text * (n.text / (n.text + n.other)) ** 2 * WEIGHT.get(n.tag, 1.0)
            if inside[1] >= 0 and n.tag not in ("html", "body"):
                held = page.nodes[inside[1]]
                if n.own >= n.text + n.other - held.text - held.other - n.own and n.own:
                    score = max(score, inside[0] + n.own)
            found.append((score, i))
            inside = max(inside, (score, i))
        if n.parent >= 0:
            below[n.parent] = max(below[n.parent], inside)
    return sorted(found, key=lambda s: (-s[0], -s[1]))


def votes(source: str) -> list[tuple[str, float]]:
    """(path, share of the best score) of a page's good containers, one per path.

    A page as a whole has a vote only if it is the best: it would gather those of all templates of a host.
    """
    page = read_page(source)
    scored, out = _scored(page), {}
    for score, i in scored:
        share = score / scored[0][0]
        if share >= VOTE_SHARE and (i == scored[0][1] or page.nodes[i].tag not in ("html", "body")):
            out.setdefault(page.nodes[i].path, share)
    return list(out.items())


def main_text(source: str, path: str | None) -> str:
    """Text of the containers on ``path``, without noise; blocks joined by line ends."""
    page = read_page(source)
    scored = _scored(page)
    if not scored:
        return ""
    nodes = page.nodes
    best = nodes[scored[0][1]]
    chosen = sorted((i for _, i in scored if nodes[i].path == path and nodes[i].text > nodes[i].other), key=lambda i: nodes[i].blocks)
    if sum(nodes[i].text for i in chosen) < OWN_BEST_SHARE * best.text:
        chosen = [scored[0][1]]
    out, upto = [], 0
    for i in chosen:
        first, last = nodes[i].blocks
        out += [text for text, noise in page.blocks[max(first, upto) : last] if not noise]
        upto = max(upto, last)
    return "\n".join(out)


def host_paths(pages: DataFrame) -> DataFrame:
    """``pages`` -> (``__sa_host``, ``__sa_path``): each host's winning path, written.  Ties go to the first path by text."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(h, p, s) for h, source in zip(batch["host"], batch["html"]) for p, s in votes(source)]
            yield pd.DataFrame(rows, columns=["host", "path", "share"])

    cast = pages.select(_host().alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInPandas(vote, "host string, path string, share double")
    # shares are added as whole numbers, so that the order of addition does not matter
    summed = cast.groupBy("host", "path").agg(F.sum(F.round(F.col("share") * 1_000_000).cast("long")).alias("votes"))
    top = summed.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("votes"), "path")).alias("top"))
    return durable(top.select(F.col("host").alias("__sa_host"), F.col("top.path").alias("__sa_path")), "paths")


def _host():
    """Host of ``url`` in lower case without port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def extracted(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``url``, ``text`` (empty if none), ``n_chars``.

    A null or empty page has an empty text.  Pages without a host vote together.  Repeated rows give repeated rows.
    """
    paths = host_paths(pages)

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, chosen in batches:
            yield pd.Series([main_text(s, p) for s, p in zip(sources, chosen)], dtype=object)

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host().alias("__sa_host"))
    texts = rows.join(paths, "__sa_host", "left").select("page_id", "url", read("html", "__sa_path").alias("text"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
