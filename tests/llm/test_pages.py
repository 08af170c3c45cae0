"""URL rules and main texts."""

import random
import time

import pytest

from tracklake.llm import html, urls
from tracklake.llm.queries import op2_url_filter

URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "http://example.net/EN/x", "https://x.net", "https://x.net?a", "ftp://notexample.net/en/", "http://example.com/de/", "http://sub.example.com/de/a",
    "http://xexample.com/de/", "http://a.org/fr/", "http://org/fr/1", "http://a.org/french", "http://spam-farm.example.org/", "http://x.org#://y.net/", "a://b://c.net/", "http://cheap.pills.com", "HTTP://İ.net/", "http://poker.a/b\nnet/", "http://user:p@h.net:80/x",
]


def plain(url):
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", None, "allow"
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:][: min([rest[cut:].find(c) for c in "?#" if c in rest[cut:]] or [len(rest)])]
    best = None
    for verdict, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")):
        if (host == h or host.endswith(f".{h}")) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


@pytest.mark.parametrize("way", [urls.judge, lambda d, **k: urls._judge_joined(d, "url", urls.RULES, "allow", "filter")])
def test_rules(spark, way):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string")
    out = way(df)
    assert out.columns == [*df.columns, "filter"] and out.count() == 2 * len(URLS)
    for r in out.collect():
        host, path, rule, verdict = plain(r.url)
        assert tuple(r["filter"])[:3] == (host, path, rule), r.url
        if verdict:
            assert r["filter"].verdict == verdict
    judged = {r.url: r["filter"].verdict for r in out.collect()}
    assert judged["http://spam-farm.example.org/"] == judged["http://cheap.pills.com"] == "block" and judged["http://a.org/french"] == judged[None] == "allow"
    assert way(df.limit(0)).count() == 0


def test_url_query_is_native(spark):
    df = op2_url_filter(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "url" in plan.split("ReadSchema")[1] and "html" not in plan
    assert all((r.host, r.path, r.rule) == plain(u)[:3] for r, u in ((r, r.url) for r in df.join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), "page_id").collect()))


def test_rules_are_indexed_by_their_rarest_token(spark):
    df = spark.createDataFrame([("a.net/en",)] * 5 + [("example.net/fr",)] * 2, "hp string")
    index = urls.rarest(df, df["hp"], (urls.host_rule("allow", "example.net", "/en/"),))
    assert list(index) == ["example"]


def test_many_rules_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(u, "a", "b", "c", "d") for u in URLS], "url string, u string, hp string, rule_url string, `__best` string")
    want = {r.url: tuple(r["filter"]) for r in urls.judge(df).collect()}
    monkeypatch.setattr(urls, "INLINE", 3)
    assert {r.url: tuple(r["filter"]) for r in urls.judge(df).collect()} == want


SITE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page sidebar-left"><header><h1>Site</h1></header><nav><a href=1>Home</a></nav>
<div id="cookie-notice"><p>We use cookies, and this text on them is quite long, longer than it has to be.</p></div><div class="wrap">%s
<div class="comments"><p>A reader writes a long comment that has as many words as a paragraph of the article has, or more.</p></div><aside><p>Side matter.</p></aside></div>
<form><label>Mail</label><input name=a></form><div role="contentinfo">All rights</div><footer>&copy; x</footer><script>var a = "<p>no</p>";</script></body></html>"""


@pytest.mark.parametrize("around", ["<article>%s</article>", "<main>%s</main>", "<div class='post'>%s</div>", "<div><div>%s</div></div>", "<td>%s</td>"])
@pytest.mark.parametrize("broken", [False, True])
def test_article(around, broken):
    end = "" if broken else "</p>"
    body = f"<h2>Head &amp; more</h2><p>First  part\n with <b>bold</b> &lt;tag&gt; and <a href=x>a link</a> in its text.{end}<p>Second part, which goes<br>on and on for a while.{end}<blockquote>A quotation</blockquote><ul><li>one<li>two</ul><p><!-- no -->Last part of the whole article, once more with a few words.</p>"
    want = "Head & more\nFirst part with bold <tag> and a link in its text.\nSecond part, which goes on and on for a while.\nA quotation\none\ntwo\nLast part of the whole article, once more with a few words."
    assert html.extract(SITE % (around % body)) == want


def test_cut_pages_and_no_pages():
    whole = SITE % "<article><p>One paragraph of text.</p><p>Another paragraph of text.</p></article>"
    cut = whole[: whole.index("</article>")]
    assert html.extract(cut) == html.extract(whole) == "One paragraph of text.\nAnother paragraph of text."
    for page in (None, "", "<html></html>", "<script>x", "<!-- x", "<nav>menu</nav>"):
        assert html.extract(page) == "", page
    assert html.extract("words &eacute; only") == "words é only"


def test_marks_around_the_article():
    art = "<article class='post tag-sidebar'><p>The text of the article.</p></article>"
    assert html.extract(f"<body><div class='layout with-sidebar'>{art}<div class=sidebar><p>side</p></div></div></body>") == "The text of the article."
    assert html.extract(f"<body>{art}<div id=comments><article class='comment even'><p>A reader's view of it, at some length.</p></article></div></body>") == "The text of the article."
    assert html.extract("<body><div class='search-page'><p>All text stands here.</p></div></body>") == "All text stands here."


def test_strange_pages_do_not_fail():
    rng = random.Random(1)
    parts = ["<p>", "</p>", "<div class=ad>", "</div>", "<b>", "</b>", "<li>", "<table>", "<td>", "</tr>", "text ", "&amp;", "&#0;", "&#xZ;", "<", ">", "<a href='", "'", '"', "<!--", "-->", "<![CDATA[", "]]>", "<script>", "</script>", "<br/>", "</x>", "\x00"]
    for _ in range(400):
        assert isinstance(html.extract("".join(rng.choices(parts, k=40))), str)
    assert html.extract("<div>" * 20_000 + "deep") == "deep"
    html.extract("<p>x" * 50_000)


def test_pages_of_the_tables(spark):
    """The tables' articles: their blocks by a plain split."""
    import re
    from html import unescape

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        article = r.html.partition("<article>")[2].partition("</article>")[0]
        parts = (" ".join(unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in re.split(r"</?(?:p|h1)>", article))
        assert html.extract(r.html) == "\n".join(p for p in parts if p)


def test_operator_on_awkward_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (2, None, "<p>a</p>", "t"), (2, None, "<p>a</p>", "t")], "page_id long, url string, html string, text string")
    out = html.extract_text(df)
    assert out.columns == [*df.columns, "main"] and [tuple(r.main) for r in out.orderBy("page_id").collect()] == [("", 0), ("a", 1), ("a", 1)]
    assert html.extract_text(df.limit(0)).count() == 0


PARTS = ["<p>%s</p>" % " ".join([f"Paragraph {k} of the article has a good many words in it, so that it is dense."] * 2) for k in range(6)]
LINKS = "".join(f"<li><a href=/{k}>Link number {k} of the list</a></li>" for k in range(9))
BOXES = [
    f"<div class=col2><ul>{LINKS}</ul></div>",
    "<div class=box><h3><a href=1>Teaser one</a></h3><p><a href=1>Read what is in it</a></p><h3><a href=2>Teaser two</a></h3><p>More <a href=2>of it</a></p></div>",
    "<div class=teaser><a href=x>Buy these things now</a></div>",
    "<div class=box>Things at a low price</div>",
    f"<h3>Seen by many</h3><ul>{LINKS}</ul>",
]


def words_in(parts):
    return "\n".join(p[3:-4] for p in parts)


@pytest.mark.parametrize("box", BOXES)
@pytest.mark.parametrize("around", ["<div class=wrap><div class=post>%s</div>%s</div>", "<section>%s</section>%s", "<div><div><div>%s</div>%s</div></div>"])
def test_unlabelled_boxes_beside_the_article(around, box):
    assert html.extract(f"<body>{around % (''.join(PARTS), box)}</body>") == words_in(PARTS)


def test_unlabelled_lists_and_sections():
    table = f"<table><tr><td><ul>{LINKS}</ul></td><td>{''.join(PARTS)}</td></tr></table>"
    assert html.extract(f"<body>{table}</body>") == words_in(PARTS)
    assert html.extract(f"<body><div>{''.join(PARTS)}<ul>{LINKS}</ul></div></body>") == words_in(PARTS)
    two = f"<div><h1>Title</h1><section>{''.join(PARTS[:3])}</section><h2>Next</h2><section>{''.join(PARTS[3:])}</section><p>Short end.</p>{BOXES[0]}</div>"
    assert html.extract(f"<body>{two}</body>") == f"Title\n{words_in(PARTS[:3])}\nNext\n{words_in(PARTS[3:])}\nShort end."


def test_marks_are_no_verdict():
    text = "".join(PARTS)
    inside = f"<h2 id='related-work'>Related work</h2>{text}<section id='discussion'><p>A discussion of it.</p></section><h2 id=search>Search</h2><p class=notice>A notice.</p><div class=legal><p>The law of it.</p></div>"
    want = f"Related work\n{words_in(PARTS)}\nA discussion of it.\nSearch\nA notice.\nThe law of it."
    side = "<div class=related><ul><li><a href=1>Another article</a></li></ul></div><div class=share>Share it</div><div class=comments><p>I think so too.</p></div>"
    for around in ("<article>%s</article>", "<main>%s</main>", "<div><div class=post>%s</div></div>"):
        assert html.extract(f"<body>{around % (inside + side)}<div class=notice>We use cookies.</div></body>") == want, around
    for layout in ("layout has-sidebar", "page-header-top", "with-ads"):
        page = f"<body><div class='{layout}'><div>{text}</div><div class=sidebar><p>Side matter.</p></div></div><div class=cookie><p>Other text</p></div></body>"
        assert html.extract(page) == words_in(PARTS), layout


def test_forms_around_the_article():
    field = "<form><label>Mail</label><input name=a></form>"
    for article in ("<div>%s</div>", "<article>%s</article>", "%s"):
        assert html.extract(f"<body><form action=/><nav><a href=1>Home</a></nav>{article % ''.join(PARTS)}</form></body>") == words_in(PARTS)
        assert html.extract(f"<body>{article % ''.join(PARTS)}{field}</body>") == words_in(PARTS)
    assert html.extract("<body><form>Some words.</form></body>") == "Some words."


def unlabelled_page(rng):
    """(page, its article's blocks, the other blocks): random class names, nesting and order; nothing but the density tells them apart."""
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuvz", k=rng.randint(2, 9)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    name = lambda: f"{rng.choice('qxyz')}{rng.randint(10, 9999)}"
    box = lambda inside: f"<{(t := rng.choice(('div', 'section', 'div')))} class={name()}>{inside}</{t}>"
    article, inside, side = [], "", []
    for k in range(rng.randint(4, 14)):
        text = say(15, 70)
        if k and rng.random() < 0.2:
            head = say(2, 5)
            article.append(head)
            inside += f"<h2>{head}</h2>"
        article.append(text)
        middle = text.split(" ")
        middle[3] = f"<a href=/{k}>{middle[3]}</a>" if rng.random() < 0.3 else f"<b>{middle[3]}</b>"
        inside += f"<p>{' '.join(middle)}</p>"

    def links():
        some = [say(1, 5) for _ in range(rng.randint(4, 15))]
        side.extend(some)
        return box("<ul>" + "".join(f"<li><a href=/{i}>{t}</a></li>" for i, t in enumerate(some)) + "</ul>")

    def teasers():
        out = ""
        for i in range(rng.randint(2, 6)):
            head, text = say(2, 6), say(3, 8)
            side.extend((head, text))
            out += box(f"<h4><a href=/{i}>{head}</a></h4><a href=/{i}>{text}</a>")
        return box(out)

    def line():
        text = say(2, 6)
        side.append(text)
        return box(text)

    around = [rng.choice((links, teasers, line))() for _ in range(rng.randint(2, 6))]
    main = inside if rng.random() < 0.3 else box(inside)
    for _ in range(rng.randint(0, 2)):
        cut = rng.randint(0, len(around))
        main = box("".join(around[:cut]) + main) if rng.random() < 0.5 else box(main + "".join(around[:cut]))
        around = around[cut:]
    cut = rng.randint(0, len(around))
    if main == inside:
        main = box(main)
    return f"<html><body>{''.join(around[:cut])}{main}{''.join(around[cut:])}</body></html>", article, side


def blocks_found(seed, monkeypatch, **change):
    monkeypatch.setattr(html, "MARKS", frozenset())
    for k, v in change.items():
        monkeypatch.setattr(html, k, v)
    rng, right, wrong, missed = random.Random(seed), 0, 0, 0
    for _ in range(300):
        page, article, _ = unlabelled_page(rng)
        got = html.extract(page).split("\n")
        right += sum(b in article for b in got)
        wrong += sum(b not in article for b in got)
        missed += sum(b not in got for b in article)
    return right / (right + wrong), right / (right + missed)


def test_density_alone_finds_the_article(monkeypatch):
    """Block precision and recall without any list of class words."""
    precision, recall = blocks_found(5, monkeypatch)
    assert precision >= 0.95 and recall >= 0.95, (precision, recall)


def test_without_the_density_the_page_comes_whole(monkeypatch):
    """The result comes through the density: with the body for the main node much else is in it."""
    body = lambda root: next((n for n in root.items if not isinstance(n, str)), root)
    precision, _ = blocks_found(5, monkeypatch, main_node=body)
    assert precision < 0.7, precision


def test_parsing_time_grows_with_the_page():
    def took(page):
        start = time.perf_counter()
        html.extract(page)
        return time.perf_counter() - start

    for piece in ("<b>x", "<b></i>", "<a '", "<a \"<b '", "<svg/>", "<div class=notice>", "<p>x", "<i><div><b>", "<div><article>x", "</div>", "<td>"):
        assert min(took(piece * 16_000) for _ in range(2)) < 4 * min(took(piece * 8_000) for _ in range(2)) + 0.1, piece
    n = 8000
    assert took("<b>" * n + "</i>" * n) < 2 and took("<i><div>" + "<b>" * n + "</i>" * n) < 2
