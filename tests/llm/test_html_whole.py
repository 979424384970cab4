"""Headline and lead outside the container with the body are part of the text, on short and long pages."""

import pytest

from auditlake.llm import html_text

LAYOUTS = [
    "<div class=post><h1>{h}</h1><div class=content>{b}</div></div>",
    "<div id=wrap><h1>{h}</h1><p>{l}</p><div class=entry-text>{b}</div></div>",
    "<main><h1>{h}</h1><p>{l}</p><article>{b}</article></main>",
    "<div class=post><div class=top><h1>{h}</h1></div><div class=content>{b}</div></div>",
]


def page(layout, paragraphs):
    body = "".join(f"<p>Paragraph {k} says a good deal about the matter.</p>" for k in range(paragraphs))
    inner = layout.format(h="The headline", l="A lead of some words.", b=body)
    return f"<html><body><nav>menu</nav>{inner}<div><a href=1>One more page of this site</a> <a href=2>Another page of it</a></div><footer>x</footer></body></html>"


def expected(layout, paragraphs):
    lead = "A lead of some words. " if "{l}" in layout else ""
    return "The headline " + lead + " ".join(f"Paragraph {k} says a good deal about the matter." for k in range(paragraphs))


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("paragraphs", [1, 5, 300])
def test_headline_and_lead_stay(layout, paragraphs):
    assert html_text.Page(page(layout, paragraphs)).main_text(None) == expected(layout, paragraphs)


def test_an_inner_path_of_the_host_cuts_nothing():
    layout = LAYOUTS[1]
    assert html_text.Page(page(layout, 3)).main_text("html>body>div.wrap>div.entry.text") == expected(layout, 3)


def test_hosts(spark):
    rows = [(k, f"http://h{k % 2}.com/{k}", page(LAYOUTS[k % 2], 1 + 40 * k)) for k in range(6)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: expected(LAYOUTS[k % 2], 1 + 40 * k) for k in range(6)}
