"""Main text of web pages by two-pass block rules.

A page falls into blocks of text at block-level tags. The first pass classifies each block alone by
where it stands, link density, length and share of stop words: good, bad, or undecided (short, or
near the limits). In the second pass an undecided block inherits from its nearest decided neighbours
on either side; menus, footers and the like, which stand around the text, don't count as such. Where
the two differ, the nearer one decides, and the one before if both are as near.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common words of English, German, French and Spanish: fixed values.
STOP_WORDS = frozenset(
    "the of and to in is was for it on that by this with at as be are from or an which have had not a has his her they you "
    "der die und das den von zu mit ist im des sich auf für nicht ein eine als auch es an werden aus er dem einer wie "
    "le la les de du des et en un une que dans pour est sur au qui par ne pas il elle se plus ce avec "
    "el los las y que una por con para se del al lo como su más o ha no es".split()
)
#: Elements whose text is never shown, and those that start and end blocks.
HIDDEN = frozenset("script style noscript template svg math head iframe object select textarea button canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and words of class, id or role, that stand around anything but the main text.
AROUND = frozenset("nav footer aside form header menu dialog".split())
AROUND_NAMES = re.compile(
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|contentinfo|cookies?|consent|disqus|footer|gdpr|masthead|menu|modal|nav\w*|"
    r"newsletter|notices?|popup|promo\w*|related|repl(?:y|ies)|respond|search|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)",
    re.I,
)
#: Parts of a class that say no such element is here, or that it only holds or lays out others.
NEGATED = frozenset("has no not non with without hide hidden is show".split())
HOLDS = frozenset("wrap wrapper wrapped container content main page layout body inner outer results result article entry post".split())
#: Of these, the names of bare boxes: a box named first for what stands around ("comments-wrapper") is that thing.
BOXES = frozenset("wrap wrapper wrapped container content body inner outer".split())
MAIN = frozenset(("article", "main"))
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
UNSHOWN = re.compile(r"\s(?:hidden(?=[\s=/>])|style\s*=\s*[\"']?[^\"'>]*display\s*:\s*none)", re.I)
MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: First pass: most link density; characters of a short and of a long block; shares of stop words.
LINK_DENSITY, SHORT, LONG, FEW, MANY = 0.4, 70, 200, 0.10, 0.20

#: Letters of the script of the stop words, letters of scripts without spaces, ends of sentences.
LATIN, DENSE = re.compile("[A-Za-z\u00c0-\u024f]"), re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
ENDS = (".", "!", "?", "\u2026", "\u3002", "\uff01", "\uff1f", "\u0964", "\u061f")

GOOD, BAD, OPEN = 1, -1, 0
#: What marks an element as around: its own name, being a form, its class, id or role.
ELEMENT, FORM, NAMED = "element", "form", "named"


def names_around(marks: str) -> bool:
    """Whether a class, id or role names something around the main text, and not what merely holds or lacks it."""
    for token in marks.lower().split():
        parts = [x for x in re.split(r"[_-]+", token) if x]
        if not any(AROUND_NAMES.fullmatch(x) for x in parts) or parts[0] in NEGATED:
            continue
        holds = HOLDS.intersection(parts)
        if not holds or (AROUND_NAMES.fullmatch(parts[0]) and holds <= BOXES):
            return True
    return False


def blocks(page: str) -> Iterator[tuple[str, int, tuple[tuple[int, str, bool], ...], bool]]:
    """Each block's text, characters in links, open elements around the main text, whether in an article.

    An element around is its number, kind, and whether an article or main element is open inside it.
    """
    stack: list[tuple[str, str, bool, int]] = []  # open elements: name, kind of around or "", main, number
    opened = 0
    text, links, in_link, end = [], 0, 0, ""

    def take():
        body = " ".join("".join(text).split())
        last = max((k for k, x in enumerate(stack) if x[2]), default=-1)
        around = tuple((x[3], x[1], k < last) for k, x in enumerate(stack) if x[1])
        out = (body, links, around, last >= 0)
        text.clear()
        return out

    at, n = 0, len(page)
    while at < n:
        found = TOKEN.match(page, at)
        piece = found.group() if found else page[at]
        at += len(piece)
        if piece[0] != "<" or len(piece) == 1:
            shown = html.unescape(piece)
            text.append(shown)
            if in_link:
                links += len("".join(shown.split()))
            continue
        name = NAME.match(piece)
        if not name:
            if piece.startswith("<![CDATA["):
                text.append(piece[9:].removesuffix("]]>"))
            continue
        name = name.group(1).lower()
        closing = piece[1] == "/"
        if name in HIDDEN and not closing:
            if not piece.endswith("/>"):
                stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif name == "head":
                    body = re.compile(r"<body\b", re.I).search(page, at)
                    at = body.start() if body else at
                elif name != "button":  # a button that is never closed must not take the page with it
                    at = n
            continue
        if name == "a":
            in_link = max(0, in_link + (-1 if closing else 1))
        if name not in BLOCKS and name not in AROUND and name not in MAIN:
            continue
        block = take()
        if block[0]:
            yield block
        links, in_link = 0, in_link
        if name in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            in_link = 0
        elif not piece.endswith("/>"):
            if name == "p" and stack and stack[-1][0] == "p":  # an open paragraph ends where the next begins
                stack.pop()
            marks = " ".join(next(filter(None, m), "") for m in MARKS.findall(piece))
            in_main = name in MAIN or any(x[2] for x in stack)
            kind = ""
            if name in AROUND and not (name == "header" and in_main):
                kind = FORM if name == "form" else ELEMENT
            elif name not in ("body", "html") and UNSHOWN.search(piece):
                kind = ELEMENT
            elif name not in ("body", "html", "article", "main") and marks and names_around(marks):
                kind = NAMED
            opened += 1
            stack.append((name, kind, name in MAIN, opened))
    block = take()
    if block[0]:
        yield block


def _stop_words(body: str) -> tuple[int, int]:
    """Stop words, and all words."""
    tokens = re.findall(r"[^\W\d_]+", body.lower())
    return sum(w in STOP_WORDS for w in tokens), len(tokens)


def _linked(body: str, links: int) -> bool:
    return links > LINK_DENSITY * len("".join(body.split()))


def first_pass(body: str, links: int, around: bool, in_main: bool, fits: bool = True) -> int:
    """``fits``: whether the page's language is one of the stop words'; else length and links alone decide."""
    chars = len(body)
    if around or _linked(body, links):
        return BAD
    stops, words = _stop_words(body)
    share = stops / words if words else 0.0
    # Scripts that need no spaces say more in a character; a block without Latin letters is in no listed language.
    dense = len(DENSE.findall(body))
    if not fits or words and 2 * len(LATIN.findall(body)) < sum(c.isalpha() for c in body):
        chars += 2 * dense
        if chars < SHORT:
            return OPEN
        return GOOD if in_main or chars >= LONG or body.endswith(ENDS) else OPEN
    if chars < SHORT:
        return OPEN
    if share >= MANY or (in_main and share >= FEW):
        return GOOD
    return OPEN if in_main or share >= FEW and chars >= LONG else BAD


def listed_language(found: list[tuple]) -> bool:
    """Whether the blocks of text, taken together, have the share of stop words that text in a listed language has."""
    counts = [_stop_words(b[0]) for b in found if len(b[0]) >= SHORT and not _linked(b[0], b[1])]
    return sum(c[0] for c in counts) >= MANY * sum(c[1] for c in counts)


def second_pass(labels: list[int], around: list[bool], in_main: list[bool]) -> list[int]:
    n = len(labels)
    decided = [label if not x else OPEN for label, x in zip(labels, around)]
    nearest: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for order in (range(n), range(n - 1, -1, -1)):
        last = None
        for k in order:
            if last is not None:
                nearest[k].append((abs(k - last), decided[last]))
            if decided[k]:
                last = k
    out = []
    for k, label in enumerate(labels):
        if not label and in_main[k]:  # an article's short blocks are its own
            label = GOOD
        elif not label:
            label = min(nearest[k], key=lambda x: x[0])[1] if nearest[k] else BAD
        out.append(label)
    return out


def _judged(found: list[tuple], lifted: set[int], reset: bool) -> list[int]:
    around = [any(n not in lifted and not (reset and outside) for n, _, outside in b[2]) for b in found]
    fits = listed_language([b for b, x in zip(found, around) if not x])
    return second_pass([first_pass(b[0], b[1], x, b[3], fits) for b, x in zip(found, around)], around, [b[3] for b in found])


def main_labels(found: list[tuple]) -> list[int]:
    """Labels of the blocks of a page, where what holds the main text does not count as around it.

    That is a form that holds an article or most of the page (menus, footers and the like aside); any element around the page's only
    articles; and, if nothing else of the page is good, a named wrapper of most of its text.
    """
    held: dict[tuple[int, str], int] = {}
    lifted: set[int] = set()
    total = 0
    for body, _, marks, _ in found:
        if not any(kind == ELEMENT for _, kind, _ in marks):
            total += len(body)
        for n, kind, outside in marks:
            held[n, kind] = held.get((n, kind), 0) + len(body)
            if kind == FORM and outside:
                lifted.add(n)
    half = total / 2
    lifted |= {n for (n, kind), size in held.items() if kind == FORM and size > half}
    reset = not any(b[3] and all(n in lifted for n, _, _ in b[2]) for b in found)
    labels = _judged(found, lifted, reset)
    if GOOD not in labels:
        wrappers = {n for (n, kind), size in held.items() if kind == NAMED and size > half}
        if wrappers:
            labels = _judged(found, lifted | wrappers, reset)
    return labels


def main_text(page: str) -> str:
    found = list(blocks(page))
    labels = main_labels(found)
    return " ".join(b[0] for b, label in zip(found, labels) if label == GOOD)


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """doc (all columns but the html), text (empty if none), n_chars (its code points).

    Null html counts as empty; broken and cut-off markup is read as far as it goes; repeated rows
    are read each; a very long page is read whole; an empty table gives an empty one.
    """
    slim = [f.name for f in pages.schema.fields if f.name != html_column]

    @F.pandas_udf("string")
    def text_of(html_: pd.Series) -> pd.Series:
        return html_.map(main_text)

    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in slim]).alias("doc"), text_of(F.coalesce(F.col(html_column), F.lit(""))).alias("text"))
    return rows.select("doc", "text", F.length("text").cast("bigint").alias("n_chars"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("doc.page_id", "doc.url", "text", "n_chars")
