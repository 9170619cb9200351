import random
import re
import time

import pytest

from srcatlas.llm.html_text import CLOSES_P, SAME_LEVEL, SCOPE, extracted, main_text, read_page, votes

ARTICLE = "<article><h1>Title &amp; more</h1><p><b>Bold  start<br><p>Second\n block with <a href='#'>a link</a>.</p><ul><li>one<li>two</ul></article>"
PAGE = f"""<!DOCTYPE html><html lang="en"><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href="/x">menu</a></ul></nav><!-- <p>not</p> --><div class="ad-box">Buy</div>
<div id="cookie-notice">We use cookies</div>{ARTICLE}<aside>Side</aside><section class="comments"><p>A long comment by a reader of this page</p></section>
<form><p>Subscribe</p></form><footer>&copy; foot</footer></body></html>"""
WANT = "Title & more\nBold start\nSecond block with a link.\none\ntwo"


def test_main_text_without_the_rest():
    path = votes(PAGE)[0][0]
    assert path == "html>body.has-sidebar>article" and main_text(PAGE, path) == WANT
    assert main_text(PAGE, None) == WANT


@pytest.mark.parametrize("source", ["", "plain", "<", "<p", "<p>a<b>c", "</div></p>x", "<!-- open", "<script>x", "a &lt; b &#x41;", "<td>x</table>", "<div " + 'a="' * 50])
def test_broken_markup_never_fails(source):
    read_page(source)
    votes(source)
    main_text(source, "html")


def test_long_and_deep_pages():
    assert main_text("<p>" + "word " * 300_000, None).count("word") == 300_000
    assert "deep" in main_text("<div>" * 3000 + "deep", None)
    read_page("<a " * 100_000)
    read_page('<p x="' * 50_000)


def test_comments_in_the_article_and_references():
    source = "<main><p>a&nbsp;b &lt;i&gt; caf&eacute;</p><div class='reader-comments'><p>no</p></div><p>x<span class='ad'>y</span>z</p><p hidden>h</p></main>"
    assert main_text(source, None) == "a b <i> café\nxz"


def test_the_hosts_path_wins_over_one_pages_best(spark):
    body = "<html><body><div class='story s{i}'><p>{text}</p></div><div class='extra'><p>{other}</p></div></body></html>"
    rows = [(i, f"http://h.org/{i}", body.format(i=i, text="story text " * 30, other="x")) for i in range(8)]
    rows.append((9, "http://H.org:80/9", body.format(i=9, text="story text " * 6, other="related words " * 9)))
    got = {r.page_id: r for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9].text == ("story text " * 6).strip() and got[9].n_chars == len(got[9].text)


def test_rows(spark):
    rows = [(1, "http://a.org/x", PAGE), (2, None, PAGE), (3, "no url", None), (None, "http://a.org/y", ""), (1, "http://a.org/x", PAGE)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = extracted(pages).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, ""), (1, WANT), (1, WANT), (2, WANT), (3, "")]
    assert extracted(pages.limit(0)).count() == 0


def test_text_left_out_has_no_say_in_the_score():
    parts = ("<h1>" + "t" * 20 + "</h1>", "<p>" + "i" * 300 + "</p>", "<div class='content'><p>" + "c" * 700 + "</p></div>")
    want = "\n".join(["t" * 20, "i" * 300, "c" * 700])
    for n in (0, 350, 3000, 30_000):
        for tag in ("article", "div class='story'"):
            page = f"<body><{tag}>{''.join(parts)}<div class='comments'><p>{'x' * n}</p></div><p>e<span class='ad'>{'y' * n}</span></p></{tag.split()[0]}></body>"
            path = votes(page)[0][0]
            assert path.startswith(f"html>body>{tag.split()[0]}") and path.count(">") == 2
            assert main_text(page, path) == main_text(page, None) == want + "\ne"


def test_a_title_and_introduction_beside_links_belong_to_the_article():
    links = "<div class='more'>" + "<a href='#'>" + "l" * 300 + "</a></div>"
    page = f"<body><div class='story'><h1>{'t' * 20}</h1><p>{'i' * 300}</p><div class='content'><p>{'c' * 700}</p></div>{links}</div></body>"
    assert main_text(page, None).startswith("t" * 20 + "\n" + "i" * 300 + "\n" + "c" * 700)


def test_comments_do_not_bar_the_hosts_path_and_two_templates_share_a_host(spark):
    one = "<body><div class='story'><p>{text}</p><div class='comments'><p>{noise}</p></div></div></body>"
    two = "<body><div class='story'><p>{teaser}</p></div><div class='longread'><p>{text}</p></div></body>"
    rows = [(i, f"http://h.org/{i}", one.format(text="story text " * 30, noise="said " * 500 * (i % 2))) for i in range(12)]
    rows += [(100 + i, f"http://h.org/b{i}", two.format(teaser="teaser " * 20, text="long read " * 35)) for i in range(6)]
    got = {r.page_id: r.text for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == ("story text " * 30).strip() for i in range(12))
    assert all(got[100 + i] == ("long read " * 35).strip() for i in range(6))


@pytest.mark.parametrize("before", ["<svg viewBox='0 0 1 1'/>", "<math display=inline />", "<!-->", "<!--->", "<svg><path d='x'>", "<noscript><object data=x>", "<iframe src=x>", "<canvas>"])
def test_icons_empty_comments_and_open_elements_before_an_article(before):
    page = f"<body><p>start</p>{before}<article><p>{'word ' * 40}</p><svg><text>no</text></svg><p>end</p></article></body>"
    assert "start" in [t for t, _ in read_page(page).blocks]
    if not before.startswith("<svg>"):
        assert main_text(page, None) == ("word " * 40).strip() + "\nend"
    assert main_text(page.replace("<svg><text>no</text></svg>", ""), None) == ("word " * 40).strip() + "\nend"
    read_page(before * 50_000)


BODY = f"<h1>Title</h1><p>{'word ' * 60}</p>"
SAID = f"<div class='comments'><div class='comment'><p>{'said ' * 300}</p></div></div>"


@pytest.mark.parametrize(
    "start,end",
    [
        ("<div class='container has-sidebar'>", "</div>"),
        ("<div id='page' class='no-header'>", "</div>"),
        ("<div class='page-with-comments'>", "</div>"),
        ("<div class='widget-area content'><article>", "</article></div>"),
        ("<div class='widget-area content'>", "</div>"),
        ("<form id='main-form'>", "</form>"),
        ("<form><div class='widget-area'><main>", "</main></div></form>"),
        ("<div class='share-page'><article>", "</article></div>"),
        ("<div class='share-page'>", "</div>"),
    ],
)
def test_a_wrapper_with_a_noise_word_is_not_noise(start, end):
    for skip in ("", "<p>Skip</p>") if "share-page'>" not in start or "article" in start else ("",):
        for extra in ("", "<div class='header'><h1>Site</h1></div>", SAID if "share" not in start else ""):
            got = main_text(f"<body>{skip}{start}{extra}{BODY}{end}<footer>foot</footer></body>", None)
            assert "Title\n" + ("word " * 60).strip() in got and "foot" not in got
            assert ("said" not in got and "Site" not in got) or start == "<div class='share-page'>"


def test_readers_texts_stay_noise():
    teaser = f"<article><p>{'teaser ' * 200}</p></article>"
    for extra in (SAID, f"<div class='related'>{teaser}</div>", f"<div class='sidebar'>{'aside ' * 80}</div>", f"<ol class='comments'><article class='comment'>{'said ' * 900}</article></ol>"):
        for tag in ("article", "div"):
            assert main_text(f"<body><{tag}>{BODY}</{tag}>{extra}</body>", None) == "Title\n" + ("word " * 60).strip()


@pytest.mark.parametrize(
    "inline", ["<span class='hljs-comment'># keep me</span>", "<span class='search-term'>kept word</span>", "<label class='form-label'>this term</label>", "<em class='widget-x'>that</em>", "<a class='share-link' href='#'>here</a>"]
)
def test_inline_words_of_the_article_stay_whatever_their_class(inline):
    words = inline.split(">")[1].split("<")[0]
    assert main_text(f"<article><p>{'word ' * 30}</p><pre>x {inline} y</pre></article>", None).endswith(f"x {words} y")
    for hidden in ("hidden", "aria-hidden='true'", "style='color:red; display: none'"):
        assert main_text(f"<article><p>{'word ' * 30}</p><p>x <span {hidden}>no</span>y</p></article>", None).endswith("x y")


@pytest.mark.parametrize(
    "source",
    ["<div class='a b'>" * 20_000 + "deep", "<div>" * 20_000 + "</section>" * 20_000, "<ul><li>" + "<div>" * 20_000 + "<ul><li>x</li></ul>" * 20_000, "<li><div>" * 20_000,
     "<table>" * 10_000 + "<td>x</td>" * 10_000, "<body>" * 20_000 + "<html>" * 20_000],
)
def test_deep_pages_take_linear_time_and_memory(source):
    start = time.perf_counter()
    page = read_page(source)
    votes(source)
    assert time.perf_counter() - start < 6 and sum(len(n.path) for n in page.nodes) < 600 * len(page.nodes)


def slow_tree(source):
    """(tag, parent) of every element of simple markup, with the stack searched from its top each time."""
    out, stack = [("html", -1)], [0]
    for end, tag in re.findall(r"<(/?)(\w+)>", source):
        if end:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if out[stack[i]][0] == tag), None)
            stack = stack[:depth] if depth is not None and tag != "body" else stack
            continue
        if tag in CLOSES_P and out[stack[-1]][0] == "p":
            stack.pop()
        for i in range(len(stack) - 1, -1, -1) if tag in SAME_LEVEL else ():
            above = out[stack[i]][0]
            if above in SCOPE[tag]:
                break
            if above in SAME_LEVEL[tag]:
                stack = stack[:i]
                break
        if tag == "body" and any(out[i][0] == "body" for i in stack):
            continue
        out.append((tag, stack[-1]))
        stack.append(len(out) - 1)
    return out


def test_the_tree_matches_a_slow_reading():
    rng = random.Random(3)
    tags = ["div", "p", "ul", "li", "table", "tr", "td", "th", "dl", "dt", "dd", "section", "body"]
    for _ in range(3000):
        source = "".join(f"<{'/' * (rng.random() < 0.4)}{rng.choice(tags)}>" for _ in range(rng.randint(0, 25)))
        assert [(n.tag, n.parent) for n in read_page(source).nodes] == slow_tree(source), source
