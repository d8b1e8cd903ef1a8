"""Main text of pages with buttons and adverts inside paragraphs, names round whole articles, and other markup of real pages."""

from __future__ import annotations

import random

import pytest

from hexlane.llm import html_extract

SAY = [f"Sentence {i} of the article goes on for a while, with commas, so that it counts as text." for i in range(12)]
BODY = "".join(f"<p>{x}</p>" for x in SAY[:6])
TEXT = " ".join(SAY[:6])


def text_of(html):
    page = html_extract.Page(html)
    return page.text(page.parts(page.scored()))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<article>{BODY}<p>Read <button>SUBSCRIBE</button> text</p></article>", f"{TEXT} Read text"),
        (f"<article>{BODY}<p>One <label>L</label>two <span class='ad'>AD</span>three<span class=sponsored-by>S</span></p></article>", f"{TEXT} One two three"),
        (f"<article><p>Opening words <span class='share'>SHARE{BODY}</article>", f"Opening words {TEXT}"),
        (f"<div class='container has-sidebar'><article>{BODY}</article><div class='sidebar'><p>{SAY[7]}</p></div></div>", TEXT),
        (f"<form id='aspnetForm'><div class=menu>M</div><div class='body-text'>{BODY}</div><div class=footer>F</div></form>", TEXT),
        (f"<div id='article-with-comments'><div class=text>{BODY}</div><div class=comments><p>{SAY[8]}</p></div></div>", TEXT),
        (f"<div class='search-tips'>{BODY}</div><div class=cookie>{SAY[9]}</div>", TEXT),
        (f"<div class='article'><header><h1>The title</h1></header>{BODY}<footer>F</footer></div>", f"The title {TEXT}"),
        (f"<header><h1>Site</h1></header><div class='article'>{BODY}</div>", TEXT),
        (f"<div class=overlay-page><div class=post>{BODY}<div class=related><p>{SAY[10]}</p></div></div></div>", TEXT),
        (f"<article>{BODY}<button><div>Sub<p>scribe</p></div></button><p>End of it.</p></article>", f"{TEXT} End of it."),
        ("<nav>Menu</nav><div class='cookie-notice'>We use cookies</div>", ""),
        (f"<nav>Menu</nav><div class='comments'><p>{SAY[1]}</p><p>{SAY[2]}</p><p>{SAY[3]}</p><p>{SAY[4]}</p></div>", ""),
        ("<div class=ad>Buy</div><p>Short page.</p>", "Short page."),
        ("<p>a<span class=ad>x</span>b</p>", "ab"),
    ],
)
def test_pieces(html, want):
    assert text_of(f"<!DOCTYPE html><html><head><title>T</title></head><body>{html}</body></html>") == want


def test_pages_put_together_at_random(spark):
    """Articles with left-out elements strewn in and wrappers around; brute force is what was put in."""
    rng = random.Random(3)
    noise = ["<button>Go</button>", "<span class='ad-slot'>ad</span>", "<label>Mail</label>", "<span class='share'>tweet</span>", "<script>x<y</script>", "<!-- c -->"]
    between = [f"<aside><p>{SAY[11]}</p></aside>", f"<div class='promo'><p>{SAY[10]}</p></div>", "<form><input name=q>Search</form>", "<nav><ul><li><a href=/>x</a></ul></nav>", f"<div class='related-posts'>{SAY[9]}</div>"]
    around = [("<div class='page has-sidebar'>", "</div>"), ("<form id='f'>", "</form>"), ("<div class='layout-with-menu'>", "</div>"), ("", "")]
    rows, want = [], {}
    for i in range(120):
        parts, words = [], []
        for j in range(rng.randrange(4, 9)):
            a, b = f"Page {i} part {j} begins here, and", f"goes on for some more words, {rng.random()}."
            parts.append(f"<p>{a} {rng.choice(noise) if rng.random() < 0.5 else ''} {b}</p>")
            words.append(f"{a} {b}")
            if rng.random() < 0.4:
                parts.append(rng.choice(between))
        opening, closing = rng.choice(around)
        tag = rng.choice([("<article>", "</article>"), ("<div class='post-body'>", "</div>"), ("<main>", "</main>")])
        rows.append((i, f"http://h{i % 3}.example/{i}", f"<html><body><nav>menu</nav>{opening}{tag[0]}{''.join(parts)}{tag[1]}{closing}<footer>foot, with commas, and more</footer></body></html>"))
        want[i] = " ".join(words)
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
