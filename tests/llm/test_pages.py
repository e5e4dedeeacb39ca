from __future__ import annotations

from panelvar.llm import pages

LONG = "The house of the river was on the hill and it had a view of all the land that lay by it. " * 3
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p>"; document.write("<p>x</p>");</script></head>
<body><header><h2>Site</h2></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies on this site and the partners of it do so as well, it is for you and for them.</div>
<div id="content"><h1>A&nbsp;title &amp; more</h1><p>{LONG}<b>Bold</b> end.<br>After&#x20;break</p><p>Short one.</p>
<form><p>{LONG}</p><input name=q></form><p>{LONG}</div>
<div class="comments"><p>{LONG}</p></div><aside><p>{LONG}</p></aside><div class="ad">Buy this.</div>
<p><a href=x>{LONG}</a></p><footer>&copy; {LONG}</footer></body></html>"""
BODY = " ".join(LONG.split())


def test_main_text_of_a_page():
    assert pages.main_text(PAGE) == f"A title & more {BODY} Bold end. After break Short one. {BODY}"


def test_article_with_short_blocks_and_cut_off_markup():
    page = f'<nav>Menu</nav><article><h1>Top</h1><p>Of.</p><p>{LONG}<p>No stop words whatsoever.</p><div class="share">Tell others</div><p>1 &lt; 2 <!-- hidden --> <em>and'
    assert pages.main_text(page) == f"Top Of. {BODY} No stop words whatsoever. 1 < 2 and"
    assert pages.main_text("<article><p>a<script>never closed <p>b") == "a"
    assert pages.main_text("") == pages.main_text("<nav><a href=x>y</a></nav>") == ""


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, doc string"
    rows = [(1, "u", PAGE, "t", "d"), (1, "u", PAGE, "t", "d"), (2, None, None, None, None), (None, "u", "", "t", "d"), (3, "u", f"<p>{LONG * 2000}", "t", "d")]
    out = pages.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc"]["page_id"] or 0, r["n_chars"]) for r in out) == sorted([(1, len(out[0]["text"]))] * 2 + [(2, 0), (0, 0), (3, len(" ".join((LONG * 2000).split())))])
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert pages.extract(spark.createDataFrame([], schema)).collect() == []
