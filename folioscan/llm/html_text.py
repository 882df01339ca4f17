"""Main text of web pages by the distribution of text over their blocks.

Markup is stripped into blocks, the lines of the method; elements that by their
name, role or class are menus, headers, footers, sidebars, notices, adverts, forms
or comments leave an empty line. Text lengths are summed over sliding windows of
lines. Where a window rises above a threshold the text surges, where it falls to
nothing it dives, and what lies between the two is kept, as often as the text surges;
so is all text between the first surge and the last dive.

What a page marks as its article only changes what the windows sum up. Where
``article`` elements hold most of the marked text, their blocks count with all their
text, links included, and others with none. Where there is just a ``main``, which often
holds menus, too, its blocks count without links. Where nothing is marked, all blocks
count without links, and it takes a threshold's worth of text to surge.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window, and characters in a window at which text surges outside a marked article.
WINDOW, SURGE = 3, 80
#: How a page marks a block: as a part of its main element, or of an article.
MAIN, ARTICLE = 1, 2

_START = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")  # of a tag, quotes in pairs
#: Tags of a page whose quotes may fail to pair; from then on, tags end at the next bracket.
ODD_QUOTES = 64
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")

# Names of HTML elements.
RAW = frozenset("script style noscript template svg iframe object canvas title textarea select audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
WALLS = frozenset("div ul ol td section article main body nav aside form header footer blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav aside footer form menu dialog button fieldset head".split())
#: Words of a class or id that mark an element as no part of the article.
HINTS = frozenset(
    """ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promoted promotion
    sidebar sidebars sidenav menu menus submenu nav navbar navigation topnav subnav breadcrumb breadcrumbs header masthead topbar toolbar footer colophon
    cookie cookies consent gdpr notice notices alert alerts banner banners popup popups modal overlay toast newsletter subscribe subscription signup login paywall
    form forms search searchbox comment comments commentlist reply replies respond disqus discussion
    share sharing sharebar social related recommended recommendations widget widgets pagination pager copyright legal disclaimer skip skiplink hidden""".split()
)
#: Words that say no more than where or how such an element stands. A name of several
#: words is a hint only if they are all hints or of these: share-price-table is none.
BESIDE = frozenset("site page main top bottom left right primary secondary global box bar block list container wrapper wrap inner outer area section panel slot item items post posts article articles link links content text".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """The tags of a page in order: start, end, "/" for an end tag, name, attributes. What
    is no text, such as comments and scripts, comes as one without a name.

    Each character is looked at a bounded number of times: nothing is searched for again
    that isn't in the rest of the page. An element that is never closed reaches to the end;
    only svg ends with its own tag, others only if they have no end tag.
    """
    at, odd, missing, size = 0, 0, set(), len(page)

    def find(what: str, start: int) -> int:
        found = -1 if what in missing else page.find(what, start)
        if found < 0:
            missing.add(what)
        return found

    while m := _START.search(page, at):
        start = m.start()
        if m[2] is None:
            mark = "-->" if m[0] == "<!--" else ">"
            end = find(mark, m.end())
            if end < 0 and mark == ">":
                at = m.end()  # stays text
                continue
            at = size if end < 0 else end + len(mark)
            yield start, at, "", "", ""
            continue
        rest = _REST.match(page, m.end()) if odd < ODD_QUOTES else None
        if rest:
            attributes, at = rest[1], rest.end()
        else:
            odd += 1
            end = find(">", m.end())
            attributes, at = page[m.end() : size if end < 0 else end], size if end < 0 else end + 1
        name = m[2].lower()
        if m[1] or name not in RAW:
            yield start, at, m[1], name, attributes
            continue
        own_end = attributes.endswith("/")
        close = None if own_end and name == "svg" or name in missing else re.compile(rf"</{name}\s*+>", re.I).search(page, at)
        if close:
            at = close.end()
        elif not own_end:
            missing.add(name)
            at = size
        yield start, at, "", "", ""


def _hints(value: str) -> set[str]:
    """The hints that the names of a class or id give, each taken as a whole."""
    found = set()
    for name in value.split():
        words = set(_WORD.findall(name))
        if words and words <= HINTS | BESIDE:
            found |= words & HINTS
    return found


def _judged(name: str, attributes: str) -> tuple[bool, int]:
    """Whether an element is boilerplate, and whether it marks the main text: as
    an article or as the page's main part, or 0."""
    boilerplate, marks = name in BOILERPLATE, {"article": ARTICLE, "main": MAIN}.get(name, 0)
    if not attributes or attributes.isspace():
        return boilerplate, marks
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "").lower()
        if key in ("class", "id"):
            found = _hints(value)
            if found and name not in ("html", "body", "main") and (name != "article" or found & {"comment", "comments", "reply", "related", "ad", "sponsored", "promo"}):
                boilerplate = True
        elif key == "role":
            boilerplate |= value in ROLES and name not in ("html", "body", "main", "article")
            marks = max(marks, {"main": MAIN, "article": ARTICLE}.get(value, 0))
        elif key == "itemprop":
            marks = ARTICLE if value == "articlebody" else marks
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            boilerplate |= name not in ("html", "body")
    return boilerplate, marks


def page_lines(page: str, hints: bool = True) -> tuple[list[tuple[str, int, int, bool] | None], bool]:
    """The blocks of a page in order: (text, characters outside links, the mark around
    it or 0, is a heading); None where boilerplate was left out. And whether the page
    ended in boilerplate. Without ``hints``, elements are judged
    by their names only."""
    lines: list[tuple[str, int, int, bool] | None] = []
    text: list[str] = []
    links = anchor = marked = 0
    heading = False
    skipped = titles_only = 0  # depth of the stack at which left-out text, or a header of an article, began
    stack: list[tuple[str, int]] = []  # open elements, and the mark outside each
    places: dict[str, list[int]] = {}  # depths of open elements by name
    walls: list[int] = []  # depths of elements that an unclosed paragraph doesn't reach beyond

    def flush() -> None:
        nonlocal links
        if text:
            joined = "".join(text)
            if "&" in joined:
                joined = html.unescape(joined)
            if joined := " ".join(joined.split()):
                lines.append((joined, len(joined) if heading else max(0, len(joined) - links), marked, heading))
            text.clear()
        links = 0

    def pop(depth: int) -> None:
        nonlocal skipped, titles_only, marked
        marked = stack[depth][1]
        while len(stack) > depth:
            name, _ = stack.pop()
            places[name].pop()
            if walls and walls[-1] == len(stack):
                walls.pop()
        if skipped > depth:
            skipped = 0
            lines.append(None)
        if titles_only > depth:
            titles_only = 0

    at = 0
    for start, end, ending, name, attributes in _tags(page):
        if start > at and not skipped and (not titles_only or heading):
            text.append(page[at:start])
            if anchor:
                links += start - at
        at = end
        if not name:
            continue
        if name == "a":
            anchor = not ending
            if not attributes.strip():
                continue
        if name in BLOCKS:
            if not skipped:
                flush()
            heading = name in HEADINGS and not ending
            anchor = 0
        elif name == "br" and not skipped:
            text.append(" ")
        if name in VOID or (attributes.endswith("/") and name not in BLOCKS):
            continue
        open_at = places.get(name)
        if ending:
            if open_at and (skipped or name in BLOCKS or open_at[-1] + 1 == len(stack)):
                pop(open_at[-1])
            continue
        if (name == "p" or name == "li") and open_at and (not walls or open_at[-1] > walls[-1]):
            pop(open_at[-1])  # these end one another where they aren't closed
        boilerplate, marks = _judged(name, attributes if hints else "")
        if name not in BLOCKS and not boilerplate:
            continue
        if name in WALLS:
            walls.append(len(stack))
        places.setdefault(name, []).append(len(stack))
        stack.append((name, marked))
        if not skipped:
            marked = max(marked, marks)
        if skipped:
            continue
        header = name == "header" or (hints and boilerplate and "header" in attributes.lower())
        if header and marked and not titles_only:
            titles_only = len(stack)
        elif boilerplate or (name == "header" and not marked):
            flush()
            skipped = len(stack)
    if not skipped and (not titles_only or heading):
        text.append(page[at:])
        flush()
    return lines, skipped > 0


def between_surge_and_dive(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """The lines (first, end) between each surge and its dive."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    spans, start = [], None
    for i, total in enumerate(sums):
        if start is None and lengths[i] and total > surge:
            start = i
        elif start is not None and not total:
            spans.append((start, i))
            start = None
    if start is not None:
        spans.append((start, len(lengths)))
    if not spans:
        return between_surge_and_dive(lengths, window, 0) if surge and any(lengths) else []
    return [(first, max(i for i in range(first, end) if lengths[i]) + 1) for first, end in spans]


def main_text(page: str) -> str:
    """The main text of a page: its blocks joined by newlines, empty if there is none."""
    lines, unclosed = page_lines(page)
    if unclosed and not any(lines):  # an element that only its class marks was never closed
        lines, _ = page_lines(page, hints=False)
    lengths, mark = _weighed(lines)
    spans = between_surge_and_dive(lengths, surge=0 if mark else SURGE)
    if not spans:
        return ""
    first, end = spans[0]
    if not mark:  # the title may be one of the lines before the surge
        above = max((i + 1 for i in range(first) if not lines[i]), default=0)
        titles = [i for i in range(max(above, first - WINDOW), first) if lines[i] and lines[i][3]]
        first = titles[0] if titles else first
    spans[0] = (first, end)
    inside = {i for first, end in spans for i in range(first, end)}
    return "\n".join(lines[i][0] for i in range(spans[0][0], spans[-1][1]) if lines[i] and lines[i][2] >= mark and (lengths[i] or i in inside))


def _weighed(lines: list) -> tuple[list[int], int]:
    """The text that the windows sum up for each line, and the least mark that counts."""
    of = lambda mark: sum(len(x[0]) for x in lines if x and x[2] >= mark)
    if 2 * of(ARTICLE) >= of(MAIN) > 0:
        return [len(x[0]) if x and x[2] == ARTICLE else 0 for x in lines], ARTICLE
    mark = MAIN if any(x and x[2] and x[1] for x in lines) else 0
    return [x[1] if x and x[2] >= mark else 0 for x in lines], mark


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text (the main text; empty if none),
    n_chars (its code points).

    Character references are decoded, white space inside a block becomes one space,
    and blocks are joined by newlines in page order; nothing is capped. A null page
    counts as empty; null ids and urls are kept. Repeated rows give repeated
    answers, further columns are ignored, and no rows give no rows.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})
