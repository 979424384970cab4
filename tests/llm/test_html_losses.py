"""Nothing of the article is lost to names and tags that only look like something else; a host's vote changes a page."""

import random
import re

import pytest

from auditlake.llm.html_text import Page, extract_text

ARTICLE = " ".join(f"Sentence {k} of the article goes on for a while." for k in range(12))
WRAPPED = [
    "<html><body><form runat=server><p>{a}</p></form></body></html>",
    '<body><div class="layout-with-sidebar"><p>{a}</p></div></body>',
    '<article class="post related-on">{a}</article>',
    '<div id="search-results">{a}</div>',
    "<div>{a}</div>",
    "<aside>{a}</aside>",
    '<div class="sidebar">{a}</div><nav><a href=1>one</a></nav>',
    "<head><title>no</title><body><p>{a}",
    "<h1></h1><form><div class=content>{a}</div><input><div class=comments>" + "I disagree at length. " * 90 + "</div></form>",
    "<nav>menu</nav>{a}<footer>foot</footer>",
    "<p><a name=top></a>{a}",
    "<table><tr><td>{a}<td></table>",
    '<div style="display: none">{a}</div>',
]


@pytest.mark.parametrize("layout", WRAPPED)
def test_the_whole_article(layout):
    assert Page(layout.format(a=ARTICLE)).main_text(None) == ARTICLE


@pytest.mark.parametrize("part", ["<tr><td>", "<tr><th>", "<li>", "<dt>", "<dd>", "<p>", "<tr><td><p>"])
def test_end_tags_left_out(part):
    around = ("<table>", "</table>") if "<tr>" in part else ("<ul>", "</ul>")
    source = around[0] + "".join(f"{part}cell text {k}" for k in range(8000)) + around[1]
    page = Page(source)
    assert page.main_text(None) == " ".join(f"cell text {k}" for k in range(8000))
    assert max(page.depths) < 5  # an open cell or row ends at the next one


@pytest.mark.parametrize("source", ["<div>" * 20000, "<div></p></span></td>" * 20000, "<td><div>" * 20000, "<li class=ad>" * 20000, "<a href=x><b>" * 20000, "</div>" * 20000, "<form>" * 20000, '<div class="a b c">' * 5000])
def test_deep_and_hostile_pages(source):
    assert Page(source + "<p>end").main_text(None) in ("end", "")


def test_other_parts_are_cut():
    parts = ["<nav>n n n</nav>", "<header>h</header>", "<footer>f</footer>", "<div class=sidebar>s</div>", '<div class="cookie-banner">c</div>', "<form>name<input></form>", '<div id="comments-area">r r r</div>', "<p class=ad>buy</p>", "<script>x</script>", '<ul class="menu"><li>m</ul>', "<aside>a</aside>"]
    rng = random.Random(1)
    for _ in range(200):
        some = [rng.choice(parts) for _ in range(6)]
        cut = rng.randrange(7)
        assert Page("".join(some[:cut]) + f"<div class=content><h1>Head</h1><p>{ARTICLE}</p></div>" + "".join(some[cut:])).main_text(None) == f"Head {ARTICLE}"


def test_random_trees_lose_nothing():
    """Trees of plain elements, some end tags left out: all text comes back, in order."""
    rng = random.Random(2)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return f" w{rng.randrange(1000)} "
        tag = rng.choice(["div", "section", "p", "ul", "blockquote", "span", "td", "b", "article", "main"])
        inside = "".join(tree(depth - 1) for _ in range(rng.randrange(1, 4)))
        return f"<{tag}>{inside}" + ("" if rng.random() < 0.2 and tag in ("p", "td") else f"</{tag}>")

    for _ in range(500):
        source = f"<body>{''.join(tree(4) for _ in range(3))}</body>"
        assert Page(source).main_text(None).split() == re.findall(r"w\d+", source)


def test_the_vote_of_a_host_changes_a_page(spark):
    page = "<body><div class=content><p>{a}</p></div>{x}</body>"
    rows = [(k, f"http://h.com/{k}", page.format(a=ARTICLE, x="")) for k in range(6)]
    rows += [(6, "http://h.com/6", page.format(a=ARTICLE, x="<div class=box7>Win a prize in our great game today.</div>")), (7, "http://other.com/", rows[0][2].replace("content", "x"))]
    alone = Page(rows[6][2]).main_text(None)
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert alone == ARTICLE + " Win a prize in our great game today."
    assert got == {k: ARTICLE for k in range(8)}


@pytest.mark.parametrize("source,want", [
    ("<article><p>{a}</p><h2 id='related-work'>Related work</h2><p>{a}</p><h2 id='share-of-the-vote'>Share</h2><h3 id=comments>Comments</h3></article>", "{a} Related work {a} Share Comments"),
    ("<article><p>{a}</p><section id='search-and-rescue'><p>Short one.</p></section><div id='copyright-law'>Law text.</div><p>{a}</p></article>", "{a} Short one. Law text. {a}"),
    ("<body><header>Site</header><main><header><h1>Head</h1><p>lead</p></header><p>{a}</p></main></body>", "Head lead {a}"),
    ("<body><div class='article'><header><h1>Head</h1>lead</header><p>{a}</p></div></body>", "Head lead {a}"),
    ("<body><p>{a}</p><section><header><h2>Sub</h2></header><p>{a}</p></section></body>", "{a} Sub {a}"),
    ("<article><p>{a}</p><blockquote><p>Words</p><footer>Author</footer></blockquote><p>{a}</p><footer>Site</footer></article>", "{a} Words Author {a}"),
    ("<body><SCRIPT>var x = 1;</SCRIPT><p>İstanbul {a}</p><STYLE>p {{}}</STYLE>after</body>", "İstanbul {a} after"),
    ("<body class='post-template'><header>Site name</header><div id=header>site</div><p>{a}</p><div id=footer>foot</div><div id=comments>I agree.</div></body>", "{a}"),
    ("<body><p>{a}</p><div id='search-our-site'>Find <input name=q></div><div class='more-related-here'><a href=1>one</a> <a href=2>two</a></div></body>", "{a}"),
])
def test_names_and_sections(source, want):
    assert Page(source.format(a=ARTICLE)).main_text(None) == want.format(a=ARTICLE)


def test_random_trees_with_names_lose_nothing():
    """Names that hold a word of the list beside others, and headings with ids of such words, aren't evidence by themselves."""
    from auditlake.llm.html_text import BOILERPLATE

    rng, words = random.Random(4), sorted(BOILERPLATE)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return f" w{rng.randrange(1000)} "
        tag = rng.choice(["div", "section", "p", "ul", "span", "h2", "h3", "article"])
        word = rng.choice(words)
        name = "" if rng.random() < 0.4 else f" id={word}" if tag[0] == "h" else f" {rng.choice(['id', 'class'])}={word}-of-the-{rng.choice(['vote', 'law', 'sea'])}"
        return f"<{tag}{name}>{''.join(tree(depth - 1) for _ in range(rng.randrange(1, 4)))}</{tag}>"

    for _ in range(300):
        source = f"<body>{''.join(tree(4) for _ in range(3))}</body>"
        assert Page(source).main_text(None).split() == re.findall(r"\bw\d+", source)
