"""Main text of web pages by two-pass block rules: stop words, length and links first, then the nearest decided neighbours.

The stop words are those of English, French, German and Spanish; text of other languages is told by length, links and place.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacube.llm import textbuf as tb

#: Frequent function words of four languages.
STOP_WORDS = frozenset(
    """a about after all also an and are as at be been but by can could for from had has have he her his how i if in into is it its
    more no not of on one or our she so some that the their them then there they this to was we were what when which who will with would you
    au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais même ne nous on ou où par pas plus pour qu que
    qui sa se ses si son sont sur un une vous
    aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für haben hat ich ihr im in ist
    kann man mit nach nicht noch nur oder sich sie sind so und uns unter vom von vor war was wenn wie wir wird zu zum zur über
    al como con cual de del desde donde el ella en entre era es esta este está fue ha hay la las lo los más me mi muy no nos o para pero por
    porque que se ser si sin sobre son su sus también un una y ya""".split()
)
#: Elements whose text is never article text, elements that end a block, and words that mark page furniture in class, id or role.
OUTSIDE = frozenset("nav footer aside form menu dialog button select option datalist noscript template svg canvas object iframe audio video head".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul""".split()
)
HOLDERS = BLOCKS - frozenset("p li dd dt tr td th h1 h2 h3 h4 h5 h6 hr option tbody thead tfoot caption legend".split()) | frozenset("svg canvas object audio video math button".split())
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|banners?|promo\w*|cookies?|consent|gdpr|notices?|alert|popups?|modal|overlay|newsletter|subscri\w*|signup|login|search|"
    r"comments?|commentlist|disqus|replies|respond|sidebars?|side-bar|widgets?|nav\w*|menus?|breadcrumbs?|toolbar|pagination|pager|footers?|masthead|"
    r"related|recommend\w*|shar(?:e|ing)|social|tags|copyright|legal|skip|contentinfo|complementary|navigation)(?=$|[\s_-])",
    re.I,
)
#: Names of the element that holds the article on pages without an article or main element.
HOLDS_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|page)?[_-]?(?:content|article|story|body-?text|main)(?=$|[\s_-])", re.I)
BARRIERS = frozenset(("article", "main", "body", "html"))
_ARTICLE_TAG = re.compile(r"<(?:article|main)[\s>]", re.I)
_ATTRS = re.compile(r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_MARK = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[^\W\d_]+")

#: Blocks under SHORT letters are left to their neighbours; beyond LONG they must show function words; densities are shares of words, of letters in links.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 200, 0.10, 0.22, 0.5


def _marks(attributes: str) -> tuple[bool, bool, bool]:
    """(page furniture by name, hidden, article by name)"""
    named = hidden = holds = False
    for key, a, b, c in _MARK.findall(attributes):
        value = a or b or c
        key = key.lower()
        if key in ("class", "id", "role"):
            named = named or bool(FURNITURE.search(value))
            holds = holds or bool(HOLDS_ARTICLE.search(value))
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return named, hidden, holds


def blocks(page: str, marked: bool = True) -> list[tuple[str, float, bool, int]]:
    """(text, share of letters in links, outside, article number or 0) of each block in page order.

    ``marked``: article elements can be page furniture by name, as other elements are; main elements never are.
    """
    out: list[tuple[str, float, bool, int]] = []
    stack: list[tuple[str, bool, int]] = []
    open_tags: Counter = Counter()  # of the whole stack
    within: list[Counter] = [Counter()]  # of the stack above each of the elements that paragraphs and items cannot close
    words: list[str] = []
    linked: list[str] = []
    in_link = articles = breaks = 0
    at, n = 0, len(page)
    by_tag = bool(_ARTICLE_TAG.search(page))

    def end_block():
        nonlocal breaks
        breaks = 0
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            if text:
                ref = len("".join(" ".join(html.unescape("".join(linked)).split()).split()))
                out.append((text, ref / max(1, len(text.replace(" ", ""))), bool(stack and stack[-1][1]), stack[-1][2] if stack else 0))
            words.clear()
            linked.clear()

    def push(tag: str, outside: bool, article: int):
        stack.append((tag, outside, article))
        open_tags[tag] += 1
        within[-1][tag] += 1
        if tag in BARRIERS:
            within.append(Counter())

    def pop() -> str:
        tag = stack.pop()[0]
        if tag in BARRIERS:
            within.pop()
        open_tags[tag] -= 1
        within[-1][tag] -= 1
        return tag

    def text(piece: str):
        nonlocal breaks
        words.append(piece)
        if in_link:
            linked.append(piece)
        if breaks and not piece.isspace():
            breaks = 0

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            if page.startswith("<!--", lt):
                stop = page.find("-->", lt + 4)
                at = n if stop < 0 else stop + 3
            elif page.startswith("<![CDATA[", lt):
                stop = page.find("]]>", lt)
                at = n if stop < 0 else stop + 3
            else:
                stop = page.find(">", lt)
                at = n if stop < 0 else stop + 1
            continue
        closing = nxt == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if not name:
            text("<" if not closing else "</")
            at = lt + 1 + closing
            continue
        tag = name[0].lower()
        rest = _ATTRS.match(page, name.end())
        if not rest:
            stop = page.find(">", name.end())  # a quote that never ends, or a page cut inside a tag
            attributes, at = page[name.end() : n if stop < 0 else stop], n if stop < 0 else stop + 1
        else:
            attributes, at = rest[0][:-1], rest.end()
        if tag in RAW and not closing:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else n
            continue
        if tag == "br":
            breaks += 1
            words.append("\n")
            if breaks > 1:
                end_block()
            continue
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag not in BLOCKS and tag not in HOLDERS:
            if tag in ("img", "input"):
                words.append(" ")
            continue
        end_block()
        if stack and not closing and stack[-1][0] in ("p", "li") and tag in (stack[-1][0], "p"):
            if stack[-1][0] == "p" or tag == "li":
                pop()  # its end tag was left out
        named, hidden, holds = _marks(attributes) if attributes and not closing else (False, False, False)
        if closing:
            if (open_tags if tag in HOLDERS else within[-1])[tag] > 0:
                while pop() != tag:
                    pass
            continue
        outside, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        if tag not in HOLDERS:
            in_link = 0 if tag in ("p", "li", "td") else in_link
            if named or hidden:
                push(tag, True, article)
            continue
        if attributes.rstrip().endswith("/") and tag not in ("div", "section", "article", "main"):
            continue
        if tag in ("article", "main") or (holds and not by_tag and not named and tag in ("div", "section", "td")):
            if not outside:
                articles += 1
                article = articles
            named = named and marked and tag == "article"
        root = tag in ("html", "body")
        outside = outside or hidden and not root or named and not root or tag in OUTSIDE or tag == "header" and not article
        push(tag, outside, article)
    end_block()
    return out


def classify(found: list[tuple[str, float, bool, int]]) -> list[bool]:
    """Pass 1 decides what it can; pass 2 gives undecided blocks the label of the nearest decided one of their part of the page.

    An article element is no verdict: links and function words decide inside and outside it.  It only makes a long
    block with few function words undecided, and is the label where neighbours do not settle one; beside an
    article, that takes neighbours on both sides.
    """
    some_article = any(a and not o for _, _, o, a in found)
    labels: list[bool | None] = []
    for text, link, outside, article in found:
        words = _WORD.findall(text.lower())
        density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        if outside or link > LINKS:
            labels.append(False)
        elif len(text) < SHORT:
            labels.append(None)
        elif density >= STOP_HIGH or (len(text) >= LONG and density >= STOP_LOW):
            labels.append(True)
        elif len(text) >= LONG and density < STOP_LOW and not article:
            labels.append(False)
        else:
            labels.append(None)
    # the nearest decided block before and after each, of the same part; furniture inside an article says nothing about its text
    nearest: list[list[int | None]] = [[None] * len(found), [None] * len(found)]
    for side, order in zip(nearest, (range(len(found)), range(len(found) - 1, -1, -1))):
        last: dict[int, int] = {}
        for i in order:
            _, _, outside, article = found[i]
            if labels[i] is None:
                side[i] = last.get(article)
            elif not (article and outside):
                last[article] = i
    out = [bool(x) for x in labels]
    for i, label in enumerate(labels):
        if label is not None:
            continue
        article, before, after = found[i][3], nearest[0][i], nearest[1][i]
        if before is None and after is None or some_article and not article and (before is None or after is None):
            out[i] = bool(article)
        elif before is None or after is None:
            out[i] = bool(labels[after if before is None else before])
        elif labels[before] == labels[after]:
            out[i] = bool(labels[before])
        else:
            out[i] = bool(article) if i - before == after - i else bool(labels[before if i - before < after - i else after])
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    if not any(a and not o and len(t) >= SHORT for t, _, o, a in found):
        found = blocks(page, marked=False)  # no text but in articles with such names: then the names say nothing
    return "\n".join(b[0] for b, good in zip(found, classify(found), strict=True) if good)


def extract_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` without the html column, with the main text of the whole html and its n_chars (code points).

    Null and empty pages, and pages without article text, give an empty text.  Blocks are never cut or capped;
    repeated rows give repeated results.  Columns named like the two results are replaced.
    """
    own = tb.others(pages.columns, (html_col, out_col, "n_chars"))
    schema = pages.select(*own).schema.add(out_col, "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            texts = [main_text(x) if x else "" for x in batch.column(len(own)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*own, out_col, "n_chars"])

    return pages.select(*own, F.col(html_col).cast("string").alias(tb.unused("__html", own))).mapInArrow(tb.frugal(run), schema)
