import time

import pytest

from xylem.llm import html_extract as h


def page(body):
    return f"<!DOCTYPE html><html><head><title>A &amp; B</title><script>var x = '<p>no, no</p>';</script></head><body>{body}</body></html>"


PROSE = "A long paragraph, with commas, and enough words to be taken for the real text of this page."


def test_main_text_is_kept_and_boilerplate_is_not():
    body = (
        "<nav><ul><li><a href='/x'>One, two, three and some more words</a></li></ul></nav><div class='sidebar'><p>Buy this, buy that, and buy the other thing today.</p></div>"
        f"<article><h1>Head</h1><p>{PROSE}<p>Second, {PROSE}<br>after a break<div>inner, {PROSE}</div></article><footer><p>All rights reserved, of course, by everyone involved.</p></footer>"
    )
    title, text, score, container, density = h.extract(page(body))
    assert (title, container, density) == ("A & B", "article", 0.0) and score == 10 + 3 + 5 + 4 / 2
    assert text.split("\n") == ["Head", PROSE, f"Second, {PROSE}", "after a break", f"inner, {PROSE}"]


def test_points_by_hand():
    # two paragraphs in one div: each 1 + its commas; the div starts with 5 points
    root, _ = h.parse("<body><section><div><p>aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa, b</p><p>cccccccccccccccccccccccccccccc, d, e</p></div></section></body>")
    points = {x.tag: x.points for x in h.score(root)}
    assert points == {"div": 5 + 2 + 3, "section": 3 + 1 + 1.5, "body": 2 / 6 + 3 / 6, "html": 2 / 9 + 3 / 9}


def test_link_density_discounts():
    linked = "<div id='one'>" + "".join(f"<p><a href='#'>{PROSE}</a></p>" for _ in range(4)) + "</div>"
    _, text, *_ = h.extract(page(f"<div>{linked}</div><div><p>{PROSE} Unlinked.</p></div>"))
    assert "Unlinked." in text


def test_siblings_that_read_like_text_are_kept():
    _, text, *_ = h.extract(page(f"<div><div>{''.join(f'<p>{PROSE}</p>' for _ in range(5))}</div><p>A short end.</p><p><a href='#'>link only</a></p></div>"))
    assert "A short end." in text and "link only" not in text


def test_broken_pages():
    for bad in ("<p", "<p x='", "<<<>>>", "</p></p>", "<a>" * 30_000, "<!-- x", "<![CDATA[x", "<script>x", "&#0;&#xD800;&bogus;", "x" * 1_000_000):
        h.extract(bad)
    deep = "<div>" * 20_000 + f"<p>{PROSE}</p>"
    assert PROSE in h.extract(deep)[1]


@pytest.mark.parametrize(
    "bad",
    [
        "<" + 'a"' * 20_000,
        "<" + 'a"' * 200_000,
        "<a " * 150_000,
        '<a "' * 100_000 + ">",
        "<a '\">" * 100_000,
        '<p x="' * 50_000 + "<b>" * 50_000,
        "</b>" * 20_000 + "<b>" * 20_000 + "</i>" * 20_000 + "</p>" * 20_000,
        "<blockquote>some words, " * 20_000,
        "<table><tr><td>some words, " * 10_000,
        "<li><dd>" * 20_000,
        "<title >" + "</title" + " " * 200_000,
        "<!--" * 100_000,
        "<![CDATA[" * 50_000,
        "&" * 300_000,
    ],
    ids=range(14),
)
def test_time_is_in_proportion_to_the_page(bad):
    for page in (bad, bad + "<a>" * 20_000 + f"<p>{PROSE}" * 20_000):
        began = time.process_time()
        h.extract(page)
        assert time.process_time() - began < 8


def test_tags_with_open_quotes():
    assert PROSE in h.extract(page(f"<div><p title=\"never closed>{PROSE}</p><p>{PROSE}</p></div>"))[1]
    assert h.extract(f"<div><p>{PROSE}</p></div><a href='x")[1] == PROSE


def test_text_outside_paragraphs():
    """Text in divs with breaks, in list items, and in short paragraphs only."""
    _, text, _, container, _ = h.extract(page(f"<nav><a href='/'>Home, news, and more</a></nav><div id='x'>{PROSE}<br>{PROSE} <b>bold</b></div><div><a href='/y'>next page, please read on</a></div>"))
    assert (text, container) == (f"{PROSE}\n{PROSE} bold", "div")
    _, text, _, container, _ = h.extract(page(f"<div class='menu'><a href='/'>Home</a></div><ul>{''.join(f'<li>{PROSE}' for _ in range(3))}</ul>"))
    assert (text.split("\n"), container) == ([PROSE] * 3, "ul")
    assert h.extract(page("<nav><a href='/'>Home</a></nav><article><p>One line.</p><p>Two.</p></article>"))[1] == "One line.\nTwo."
    assert h.extract(page("<a href='/'>Home</a> bare"))[1] == "Home bare" and h.extract("only &lt;text")[1] == "only <text"
    assert h.extract(page(""))[1:3] == ("", 0.0)


def test_hostile_tables(spark):
    rows = [(1, "u", page(f"<div><p>{PROSE}</p></div>"), 0, "a"), (1, "u", page(f"<div><p>{PROSE}</p></div>"), 0, "a"), (None, None, None, None, None), (2, "v", "", 1, "b"), (3, "w", "no tags", 1, "b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, score int, HTML string")
    got = h.extract_pages(df).collect()
    assert len(got) == 5 and sum(r.text == PROSE for r in got) == 2
    assert [(r.text, r.score) for r in got if r.page_id is None] == [(None, None)] and [r.text for r in got if r.page_id in (2, 3)] == ["", "no tags"]
    assert h.extract_pages(df.limit(0)).collect() == []
