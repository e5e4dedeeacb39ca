"""Pages in languages without a stop-word list, and without an article element."""

from __future__ import annotations

import pytest

from panelvar.llm import pages

TEXTS = {
    "ru": "Старый дом стоял на холме над рекой, и из его окон была видна вся долина. " * 4,
    "pl": "Stary dom stał na wzgórzu nad rzeką, z jego okien było widać całą dolinę oraz las. " * 4,
    "zh": "这座老房子坐落在河边的小山上，从窗户可以看到整个山谷，远处还有一片森林和几座小村庄。" * 4,
    "nl": "Het oude huis stond boven op een heuvel naast rivier, vanuit alle ramen zag men heel dal liggen. " * 4,
}


@pytest.mark.parametrize("lang", TEXTS)
def test_unlisted_language_without_article(lang):
    body = " ".join(TEXTS[lang].split())
    page = f'<nav><a href="/">X</a></nav><div><h1>{body[:10]}</h1><p>{body}</p><p>{body[:20]}</p><p>{body}</p></div><div class="ad">{body}</div><p><a href="/y">{body}</a></p><footer>{body}</footer>'
    got = pages.main_text(page)
    assert got.count(body) == 2 and len(got) <= 2 * len(body) + 40


def test_keywords_on_a_page_of_a_listed_language_still_go():
    text = "The house of the river was on the hill and it had a view of all the land that lay by it. " * 6
    page = f"<div><p>{text}</p></div><div>{'Shoes Boots Sandals Sneakers Slippers ' * 6}</div><div><p>{text}</p></div>"
    assert "Boots" not in pages.main_text(page)
