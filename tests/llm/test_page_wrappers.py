"""Wrappers whose names merely hold a word of what stands around, and forms over the whole page."""

from __future__ import annotations

import pytest

from panelvar.llm import pages

from .test_pages import BODY, LONG


@pytest.mark.parametrize("mark", ["content-sidebar-wrap", "has-sidebar", "no-comments", "search-results", "social", "widget"])
def test_wrappers_of_the_article(mark):
    for tag in ("article", "main"):
        page = f'<body><nav>Menu</nav><div class="{mark}"><{tag}><p>{LONG}</p></{tag}><div class="sidebar"><p>{LONG}</p></div></div></body>'
        assert pages.main_text(page) == BODY
    page = f'<body><nav>Menu</nav><div class="{mark}"><div><p>{LONG}</p></div></div><footer>{LONG}</footer></body>'
    assert pages.main_text(page) == BODY


def test_forms_over_the_page():
    for inner in (f"<article><p>{LONG}</p></article>", f"<div><p>{LONG}</p><p>{LONG}</p></div>"):
        want = BODY if "article" in inner else f"{BODY} {BODY}"
        assert pages.main_text(f'<form id="aspnetForm"><nav>Menu</nav>{inner}<footer>{LONG}</footer></form>') == want


@pytest.mark.parametrize("mark", ["comments", "comment-list", "sidebar", "site-sidebar", "social-links", "cookie-notice"])
def test_what_stands_around_still_goes(mark):
    page = f'<body><article><p>{LONG}</p></article><div class="{mark}"><article class="c"><p>Other. {LONG}</p></article></div></body>'
    assert pages.main_text(page) == BODY
    page = f'<body><div><p>{LONG}</p></div><div class="{mark}"><p>Other. {LONG}</p></div></body>'
    assert pages.main_text(page) == BODY
