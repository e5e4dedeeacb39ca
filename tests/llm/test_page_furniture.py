"""Boxes named for furniture, buttons and elements that are not shown give no text."""

from __future__ import annotations

import pytest

from panelvar.llm import pages

from .test_pages import BODY, LONG


@pytest.mark.parametrize("mark", ["ad-container", "cookie-notice-wrapper", "comments-wrapper", "sidebar-content", "commentlist"])
def test_boxes_of_furniture(mark):
    for tag in ("article", "div"):
        page = f'<body><{tag}><p>{LONG}</p></{tag}><div class="{mark}"><p>Other. {LONG}</p></div></body>'
        assert pages.main_text(page) == BODY
    inside = f'<body><article><p>{LONG}</p><div class="{mark}"><p>Other. {LONG}</p></div></article></body>'
    assert pages.main_text(inside) == BODY


@pytest.mark.parametrize("mark", ["content-sidebar-wrap", "sidebar-content", "comments-wrapper", "ad-container"])
def test_a_box_that_holds_the_article_keeps_it(mark):
    page = f'<body><nav>Menu</nav><div class="{mark}"><article><p>{LONG}</p></article></div></body>'
    assert pages.main_text(page) == BODY


def test_buttons():
    assert pages.main_text(f"<article><p>{LONG}</p><button type=submit>Subscribe <b>now</b></button></article>") == BODY
    assert pages.main_text(f"<article><button>Open <p>{LONG}</p></article>").endswith(BODY)  # never closed


@pytest.mark.parametrize("mark", ["hidden", 'hidden=""', 'style="color:red; display: none"', "style='DISPLAY:NONE'"])
def test_elements_that_are_not_shown(mark):
    assert pages.main_text(f"<article><p>{LONG}</p><div {mark}><p>Other. {LONG}</p></div></article>") == BODY


@pytest.mark.parametrize("mark", ['class="hidden-gems"', 'data-hidden="x"', 'style="display:block"'])
def test_elements_that_only_look_so(mark):
    assert pages.main_text(f"<article><p {mark}>{LONG}</p></article>") == BODY
