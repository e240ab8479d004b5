"""Main text of pages: the sums of line windows against brute force, pages without marks, broken pages and edge cases."""

import random
import re
import time

import pytest

from vocalis.llm import html


def regions_by_hand(lengths, span, surge, dive):
    """Lines of all chains of windows whose sums stay at ``dive`` and reach ``surge``, without short lines at their ends."""
    span = min(span, len(lengths))
    sums = [sum(lengths[i : i + span]) for i in range(len(lengths) - span + 1)]
    out = []
    for chain in re.finditer("1+", "".join("1" if s >= dive else "0" for s in sums)):
        if max(sums[chain.start() : chain.end()]) >= surge:
            lines = list(range(chain.start(), chain.end() + span - 1))
            long = [i for i in lines if lengths[i] >= dive / span]
            out.append((long[0], long[-1] + 1) if long else (lines[-1], lines[-1] + 1))
    return out


def test_regions_equal_brute_force():
    rng = random.Random(3)
    for _ in range(3000):
        lengths = [rng.choice((0, 0, 3, 9, 12, 40, 90)) for _ in range(rng.randrange(1, 30))]
        span, surge, dive = rng.randrange(1, 6), rng.randrange(20, 120), rng.randrange(10, 20)
        got = [r for r in html.main_regions(lengths, span, surge, dive) if any(lengths[slice(*r)])]
        want = [r for r in regions_by_hand(lengths, span, surge, dive) if any(lengths[slice(*r)])]
        assert got == want


def test_pages_without_their_article_marks(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    same = sum(html.main_text(re.sub("</?article>", "", p)) == html.main_text(p) for p in pages)
    assert same >= 0.9 * len(pages)
    for p in pages:
        lines = html.main_text(re.sub("</?article>", "", p)).split("\n")
        assert set(lines) <= set(html.main_text(p).split("\n"))


def test_the_sums_decide():
    page = "<p>+</p><p>#</p><div>" + "long text here " * 10 + "</div>" + "<p><a href=x>link</a></p>" * 4 + "<p>One more line of some more words.</p><p>And another one.</p>"
    assert html.main_text(page) == ("long text here " * 10).strip() + "\nOne more line of some more words.\nAnd another one."
    assert html.main_text(page, surge=60) == ("long text here " * 10).strip()
    assert html.main_text(page, span=1, surge=20, dive=20).count("\n") == 1
    marked = "<p>" + "teaser " * 80 + "</p><article><p>Hi.</p><p>The text.</p></article><p>About us</p>"
    assert html.main_text(marked) == "Hi.\nThe text."
    # the marks settle the ends, whatever the thresholds
    assert html.main_text(marked, surge=3, dive=1) == "Hi.\nThe text."
    card = "<article><a href=x>Card</a></article>"
    long = "<article><p>" + "long text here " * 10 + "</p><p>End.</p></article>"
    assert html.main_text(card + "<p>About us and more</p>" * 9 + long) == ("long text here " * 10).strip() + "\nEnd."
    assert html.main_text(card + "<hr>" + card) == "Card\nCard"


@pytest.mark.parametrize("unit", ['<a href="x" ', '<a "', "<a \"'", "<b><i></u>", "<b></div><div>", "<form>", "<li><b>", "<div>", "<article class=x>", "<!--", "<![CDATA[", "&amp", "<script>", "<p <p"])
def test_broken_pages_take_linear_time(unit):
    page, times = unit * (1_000_000 // len(unit)), []
    for part in (page[: len(page) // 4], page):
        began = time.process_time()
        html.main_text(part)
        times.append(time.process_time() - began)
    assert times[1] < max(0.5, 10 * times[0])


def test_nothing_else_is_dropped():
    page = '<head><title>T</title><body><article><p>First paragraph.</p><p><a href=x>See the full report here</a></p><div class="related-work widget">Related work.</div><p>f = <math><mi>x</mi></math></p><p>I</p></article>'
    assert html.main_text(page) == "First paragraph.\nSee the full report here\nRelated work.\nf = x\nI"


def test_tables_of_odd_pages(spark):
    long = "<article>" + "<p>word &lt;b&gt; word</p>" * 20000 + "</article>"
    rows = [(1, "u", "<p>Plain text", "x", 1), (1, "u", "<p>Plain text", "x", 1), (2, None, None, "y", 2), (None, "v", "", None, None), (3, "w", "<script>x", "z", 3), (4, "w", long, "z", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html.extract_main_text(df).collect()), key=str)
    want = [(1, "u", "Plain text", 10)] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", "", 0), (4, "w", "\n".join(["word <b> word"] * 20000), 20000 * 14 - 1)]
    assert got == sorted(want, key=str)
    empty = html.extract_main_text(df.limit(0))
    assert empty.columns == ["page_id", "url", "text", "n_chars"] and empty.count() == 0


def test_words_in_ids_of_text_are_no_furniture():
    for tag in ("article", "main", "div"):
        page = f"""<{tag}><h2 id="search-algorithms">Search</h2><p>{"words of text " * 9}</p><h2 id="comments-on-the-law">Comments</h2><p id="promotion-history">A promotion.</p><p>Last words here.</p></{tag}>"""
        assert html.main_text(page) == "Search\n" + ("words of text " * 9).strip() + "\nComments\nA promotion.\nLast words here."
    inside = '<article><p>Text.</p><section id="navigation-at-sea"><p>At sea.</p></section><div class="wide comments-section">A reader</div><div id="comments">B</div><ul class="breadcrumb"><li>C</ul><div class="ad-slot">D</div><p class="advert">E</p></article>'
    assert html.main_text(inside) == "Text.\nAt sea."
    assert html.main_text('<div class="post-comments-below">A reader</div><p>' + "words of text " * 9 + "</p>") == ("words of text " * 9).strip()


def test_furniture_does_not_part_the_text():
    adverts = '<div class="ad">Buy this now, it is very cheap today</div>' * 4
    assert html.main_text(f"<article><p>{'words of text ' * 9}</p>{adverts}<p>A</p></article>") == ("words of text " * 9).strip() + "\nA"
    assert html.main_text(f"<p>Intro.</p><nav><ul>{'<li>Menu' * 9}</ul></nav><p>{'words of text ' * 9}</p>") == "Intro.\n" + ("words of text " * 9).strip()
    assert html.main_text("<p><a href=x>One link only</a></p>") == "One link only"
