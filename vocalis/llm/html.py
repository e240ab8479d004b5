"""Main text of HTML pages by the distribution of line blocks (operator 3).

Markup is stripped into lines, one for each block element, and lines inside page furniture (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments) are left out. Of the others each gets a length, on all pages alike: its characters
but for spaces and those in links. Furniture is told by element and role, and by words of ids and classes: outside an article a
container with such a word is furniture, elsewhere (and for headings, paragraphs and the like everywhere) an id or class has to consist of such words and
``FRAME`` words alone, since ids of headings are made of their text. The page itself and its outermost article are no
furniture whatever their classes say, nor is a form that holds the article or all text of the page.

The span of the text is found by the sums of lengths over windows of ``span`` lines: a region holds a window that surges to ``surge``
and goes on over the windows next to it until their sum dives below ``dive``. Its first and last line are those of ``dive / span`` or
more, what a line has there on average; all lines between them are kept. Where a page marks articles, the marks settle what the sums
leave open, namely the ends: an article that a region touches is kept as a whole, and nothing around it. Where no
region touches any, all of them are kept; where no sum surges on a page without marks, all lines that have a length, or all.

A null or empty page has an empty text. Repeated pages give repeated rows; a table without rows
gives none. Columns besides those named are not read. Time is linear in the page, however its tags are nested or broken.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>|<(?=/?[a-zA-Z])[^<>]*>?", re.S)
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"""(?:\s|["'])(id|class|role|aria-label|hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: Elements whose content is no text, elements that end a line, elements without content.
RAW = frozenset("script style noscript template textarea iframe select".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Furniture by element, by role and by the words of ids and classes.
FURNITURE = frozenset("nav aside footer form button head dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner popup modal overlay cookie cookies consent gdpr notice "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment comments disqus replies respond "
    "newsletter subscribe subscription signup login search pagination pager".split()
)
#: Words that an id or class of furniture may have besides, where it must have no others.
FRAME = frozenset("section list box area container wrapper wrap block slot unit bar widget inner links link item items form thread count button reader readers user users site page top bottom main global header".split())
#: Elements that are furniture only by whole ids and classes: their ids are often made of the text.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th tr span a b i em strong code pre blockquote figure figcaption caption table label abbr cite q small sub sup time".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ARTICLE = re.compile(r"<(?:article|main)(?=[\s/>])", re.I)
FORM_END = re.compile(r"</form(?=[\s/>])", re.I)
CLOSES_P = BLOCK - {"br", "option"}


def _noisy(tag: str, words: str = "any") -> bool:
    """Whether attributes tell of furniture: by a word of ids and classes (``any``), by ids and classes that say nothing else (``whole``), or by none (``no``)."""
    for name, value in ATTRIBUTE.findall(tag):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
        if words == "no":
            continue
        if name == "role":
            if value.lower() in ROLES:
                return True
        elif name in ("id", "class", "aria-label"):
            if words == "any":
                tokens = [value]
            else:
                tokens = value.split() if name == "class" else [value]
            for token in tokens:
                found = {w.lower() for w in WORDS.findall(token)}
                if not NOISE.isdisjoint(found) and (words == "any" or found <= NOISE | FRAME):
                    return True
    return False


def lines_of(html: str, forms: bool = True) -> list[tuple[str, int, int]]:
    """Lines outside furniture as (text, characters in links, number of the article or 0). Without ``forms`` no form is furniture."""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # element, furniture, article
    blocks: list[int] = []  # places of block elements in the stack
    open_now: Counter[str] = Counter()
    articles = [m.start() for m in ARTICLE.finditer(html)]
    form_ends = [m.start() for m in FORM_END.finditer(html)]
    parts: list[str] = []
    linked = noise = article = number = at = 0

    def end_line() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text and not noise:
            out.append((text, linked, number if article else 0))
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if open_now["a"]:
                linked += len("".join(unescape(piece).split()))

    def pop_to(depth: int) -> None:
        nonlocal noise, article
        while len(stack) > depth:
            name, bad, main = stack.pop()
            open_now[name] -= 1
            noise -= bad
            article -= main
        while blocks and blocks[-1] >= depth:
            blocks.pop()

    def close(name: str) -> None:
        """Close the innermost open element of this name; each element that is passed is closed with it."""
        depth = len(stack) - 1
        while stack[depth][0] != name:
            depth -= 1
        pop_to(depth)

    def holds_article() -> bool:
        """Whether an article begins before the form that begins here ends."""
        ends, begins = bisect_left(form_ends, at), bisect_left(articles, at)
        return begins < len(articles) and (ends == len(form_ends) or articles[begins] < form_ends[ends])

    while True:
        found = TAG.search(html, at)
        text(html[at : found.start() if found else len(html)])
        if not found:
            break
        tag, at = found[0], found.end()
        named = NAME.match(tag)
        if not named:
            if tag.startswith("<![CDATA["):
                text(tag[9:].removesuffix("]]>"))
            continue
        closing, name = named[1], named[2].lower()
        if name in RAW and not closing:
            if not tag.endswith("/>"):
                ending = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = ending.end() if ending else len(html)
            continue
        if name in BLOCK:
            end_line()
        if closing:
            if open_now[name]:
                close(name)
            continue
        if name in VOID or tag.endswith("/>"):
            continue
        if name == "body" and open_now["head"]:
            close("head")
        if name in CLOSES_P and blocks and stack[blocks[-1]][0] == "p":
            pop_to(blocks[-1])
        if name in ("li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
            pop_to(len(stack) - 1)
        if name == "a" and open_now["a"]:
            continue
        if name in ("html", "body"):
            bad = False
        elif name == "form" and (not forms or holds_article()):
            bad = _noisy(tag, "no")
        else:
            outermost = name == "main" or (name == "article" and not open_now["article"])
            words = "no" if outermost else "whole" if article or name in TEXTUAL else "any"
            bad = name in FURNITURE or (name == "header" and not article) or _noisy(tag, words)
        main = not noise and not bad and (name in ("article", "main") or 'role="main"' in tag.lower())
        number += main and not article
        noise += bad
        article += main
        if name in BLOCK:
            blocks.append(len(stack))
        open_now[name] += 1
        stack.append((name, bad, main))
    end_line()
    return out


def main_regions(lengths: list[int], span: int, surge: int, dive: int) -> list[tuple[int, int]]:
    """Regions of lines, as (first, behind the last), between the points where window sums surge and dive."""
    n, span = len(lengths), max(1, min(span, len(lengths)))
    least = dive / span
    total, sums = sum(lengths[:span]), []
    for i in range(n - span + 1):
        sums.append(total)
        if i + span < n:
            total += lengths[i + span] - lengths[i]
    regions, at = [], 0
    while at < len(sums):
        begin = at
        while at < len(sums) and sums[at] >= dive:
            at += 1
        if begin < at and max(sums[begin:at]) >= surge:
            first, last = begin, at + span - 2
            while first < last and lengths[first] < least:
                first += 1
            while last > first and lengths[last] < least:
                last -= 1
            regions.append((first, last + 1))
        at += 1
    return regions


def main_text(html: str | None, span: int = 3, surge: int = 40, dive: int = 10) -> str:
    """The main text, one line for each block."""
    lines = lines_of(html or "") or lines_of(html or "", forms=False)
    lengths = [max(0, len(text) - text.count(" ") - linked) for text, linked, _ in lines]
    regions = main_regions(lengths, span, surge, dive) if lines else []
    articles = {n for _, _, n in lines} - {0}
    if articles:
        touched = {lines[i][2] for first, behind in regions for i in range(first, behind)} - {0}
        kept = [n in (touched or articles) for _, _, n in lines]
    else:
        kept = [False] * len(lines)
        for first, behind in regions:
            kept[first:behind] = [True] * (behind - first)
        if not any(kept):
            kept = [n > 0 or not any(lengths) for n in lengths]
    return "\n".join(line[0] for line, keep in zip(lines, kept, strict=True) if keep)


def extract_main_text(pages: DataFrame, span: int = 3, surge: int = 40, dive: int = 10) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    rows = pages.select("page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), span, surge, dive) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long").select(F.col("page_id"), "url", "text", "n_chars")
