"""Pages that are cut off, never closed or oddly named, and texts that only the cut can label."""

import pytest

from assure.llm import html_extract

LONG = "An index of all the words in many pages is made before any of them is asked for."
CASES = {
    "a head without an end": (f"<html><head><title>x</title><p>{LONG}", LONG),
    "a head ended by text": (f"<head><title>x</title>{LONG}", LONG),
    "a button never closed, in a div": (f"<body><div><button>Go<p>hidden</div><p>{LONG}</p>", LONG),
    "a button never closed": (f"<body><button>Go <p>{LONG}</p>", LONG),
    "a button with blocks": (f"<body><button><div>Go on</div></button><p>{LONG}</p>", LONG),
    "a slash in a script tag": (f'<p>{LONG}<script src="a.js"/>alert(1)</script><p>{LONG}', f"{LONG}\n{LONG}"),
    "a slash in a drawing": (f"<p>{LONG}<svg/><p>{LONG}", f"{LONG}\n{LONG}"),
    "a title in a drawing": (f"<p>{LONG}<svg><title>no</title><g>x</g></svg><p>{LONG}", f"{LONG}\n{LONG}"),
    "a name of two senses": (f'<div id="search-engines"><article><h1>Search engines</h1><p>{LONG}</p></article></div>', f"Search engines\n{LONG}"),
    "a class of two senses": (f'<article><p>{LONG}</p><p class="related-work">{LONG}</p></article>', f"{LONG}\n{LONG}"),
    "boxes of boilerplate": (
        f'<div class="cookie-notice">{LONG}</div><div class="siteHeader">{LONG}</div><article><p>{LONG}</p></article><ol class="comment-list"><li>{LONG}</li></ol><div id="related_posts">{LONG}</div>',
        LONG,
    ),
    "nested lists never closed": (f"<article><ul><li>{LONG}<li>{LONG}</ul></article>", f"{LONG}\n{LONG}"),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    page, want = CASES[name]
    assert "\n".join(html_extract.main_blocks(page)) == want


def test_neighbours_decide_on_a_block_in_doubt():
    page = html_extract.Page(f"<article><p>{LONG}</p><p>Of.</p><p>{LONG}</p></article>")
    odds = [html_extract.log_odds(page, b) for b in page.blocks]
    assert odds[0] > 0 > odds[1]
    assert html_extract.main_blocks(f"<article><p>{LONG}</p><p>Of.</p><p>{LONG}</p></article>") == [LONG, "Of.", LONG]


def test_long_pages_repeated_rows_and_clashing_names(spark):
    page = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    rows = [(1, "u", page, "a", 5), (1, "u", page, "a", 5), (2, None, None, None, None)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    text = "\n".join([LONG] * 20_000)
    assert [(r["page_id"], r["text"] == text, r["n_chars"]) for r in got] == [(1, True, len(text)), (1, True, len(text)), (2, False, 0)]
