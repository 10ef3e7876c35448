import html
import re

from meterlens.llm import html_text as h, queries
from meterlens.llm.common import table

PAGES = "page_id long, url string, html string, host string, path int, text string"


def plain_article(page):
    """The blocks of generated pages, by their fixed layout."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inside)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p.replace("<b>", ""))).split()) for p in parts]
    return "\n".join(p for p in parts if p)


def test_generated_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in table(spark, sf, "pages").collect()}
    rows = queries.QUERIES["op5_html_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text) == (pages[r.page_id].url, plain_article(pages[r.page_id].html))
        assert r.n_chars == len(r.text)


def test_parts_that_are_no_text():
    page = """<html><body><header>Top <a href=x>l</a></header><div class="sidebar2 x"><p>side</p></div><main>
    <div id=c class="post-12 entry"><h2>T&eacute;st &amp; x&#33;</h2><p title="a>b">one <b>two</b>
    three<p>four<br>five<ul><li>i1<li>i2</ul><table><tr><td>a<td>b</table><script>if(a<b){"</p>"}</script>
    <div class=comments><p>c1</div><form><p>f</form><pre> z  y</pre><!-- <p>no</p> --><p hidden>no</p></div></main>
    <div class="cookie-notice">x</div><div style="display: none">no</div><footer>f"""
    assert h.main_text(page, None) == "Tést & x!\none two three\nfour five\ni1\ni2\na\nb\nz y"
    assert h.main_text("", None) == "" and h.main_text("<<<>>", None) == "<<<>>"
    assert h.main_text("just &lt;text&gt;", None) == "just <text>"
    assert h.main_text("<article><p>cut off in a ta", None) == "cut off in a ta"


def test_host_vote_corrects_single_pages(spark):
    def page(text, extra):
        return f"<body><div class='post p{len(text)}'><p>{text}</p></div><div class='extra e7'><p>{extra}</p></div></body>"

    long, short = "long text of the article " * 20, "more to read, one of few words"
    rows = [(i, "http://Host.example/a", page(f"{long}{i}", short), "x", 1, "y") for i in range(5)]
    rows.append((9, "http://host.example:80/b?q", page("short article", short * 3), "x", 1, "y"))
    rows.append((10, "https://other.example/", page("short article", short * 3), "x", 1, "y"))
    rows += [(11, None, None, None, None, None), (12, "no url", "", "x", 1, "y"), (12, "no url", "", "x", 1, "y"), (None, "", "<p>a</p>", "", 0, "")]
    got = h.extract(spark.createDataFrame(rows, PAGES)).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert all(texts[i] == f"{long}{i}" for i in range(5))
    assert texts[9] == "short article"
    assert texts[10] == f"short article\n{short * 3}"
    assert texts[11] == texts[12] == "" and texts[None] == "a"
    assert h.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_long_and_broken_pages():
    for page in ("<div>x" * 20_000, "<p title='" * 20_000 + "x", "<" * 200_000, "<!--" * 50_000, "<b>x</i>" * 30_000, "<b><p>x" * 20_000):
        h.main_text(page, None)
    deep = "<div>" * 500 + "text " * 50
    assert h.main_text(deep, None) == ("text " * 50).strip()
    assert max(len(p) for p in h.container_scores(h.blocks(deep))) < 500


def test_wrappers_with_layout_words_keep_the_article():
    first, second = "first words of the article, and more of them " * 4, "second paragraph of it, as long as the first " * 4
    story = f"<h1>Title</h1><p>{first}</p><p>{second}</p>"
    side = "<div class='sidebar'><p>side text of some words</p><article><p>teaser</p></article></div><footer><p>foot</p></footer>"
    want = f"Title\n{first.strip()}\n{second.strip()}"
    for wrap in ("div class='content-sidebar-wrap'", "div class='site right-sidebar'", "div id=page class=has-sidebar", "div class=nav-open",
                 "div class='container widgets-on'", "div class='comments-open'", "form id=aspnetForm method=post", "div role=form"):
        end = f"</{wrap.split()[0]}>"
        for inner in (f"<article>{story}</article>", f"<main><p></p>{story}</main>", f"<div>{story}</div>", story, f"<div class=has-menu><article>{story}</article></div>"):
            assert h.main_text(f"<body><{wrap}>{inner}{side}{end}<nav><a href=x>menu</a></nav></body>", None) == want, (wrap, inner)
            assert h.main_text(f"<body><{wrap}>{inner}{side}", None) == want, (wrap, inner)
            assert h.main_text(f"<body><form><{wrap}>{inner}{end}{side}</form>", None) == want, (wrap, inner)


def test_parts_longer_than_the_article_stay_out():
    short, long = "a short article of one paragraph that has somewhat more than eighty characters in it", "much talk of others " * 100
    for start, end in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class=post>", "</div>")):
        for part in (f"<div class=comments><article><p>{long}</p></article></div>", f"<div id=cookie-consent><p>{long}</p></div>", f"<footer><p>{long}</p></footer>"):
            assert h.main_text(f"<body>{start}<p>{short}</p>{part}{end}", None) == short
            assert h.main_text(f"<body>{start}<p>{short}</p>{end}{part}", None) == short
        assert h.main_text(f"<body>{start}<p>{short}</p>{end}<aside><article><p>{long}</p></article></aside>", None) == short


def test_inner_containers_do_not_cut_title_and_lead(spark):
    body = "long text of the article " * 40
    title, lead = "Title of it", "The lead paragraph."
    outside = f"<h1>{title}</h1><p>{lead}</p>"
    for page in (
        f"<body><article>{outside}<div class='entry-content'><p>{body}</p></div></article><div class=x><p>more to read</p></div></body>",
        f"<body><div>{outside}<div class='entry-content'><p>{body}</p></div></div></body>",
        f"<body><div><div class='entry-head'><h1>{title}</h1></div><div class=lead><p>{lead}</p></div><div class=post-text><p>{body}</p></div></div></body>",
    ):
        assert h.main_text(page, None) == f"{title}\n{lead}\n{body.strip()}", page
    half = f"<body><div class=a><div class=post><p>{body}{body}</p></div><div class=b><p>{body}</p></div></div></body>"
    assert h.main_text(half, None) == f"{(body + body).strip()}\n{body.strip()}"

    def page(n):
        return f"<body><article>{outside}<div class='entry-content'><p>{'text ' * n}</p></div></article></body>"

    rows = [(n, "http://h.example/", page(n), "x", 1, "y") for n in (5, 900, 901, 902)]
    for r in h.extract(spark.createDataFrame(rows, PAGES)).collect():
        assert r.text == f"{title}\n{lead}\n{('text ' * r.page_id).strip()}"
