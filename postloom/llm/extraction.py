"""Main text of HTML pages by the distribution of text over blocks of lines.

Markup becomes lines at the borders of block elements. Lines inside elements that never hold an article (menus, forms,
footers and the like, by tag, role or class name, whatever their length) and lines that are mostly link text count as empty. The
text lengths of a few consecutive lines are summed; where the sum surges the article begins, where it dives to nothing the article ends.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.base import lean

#: Lines of a window, and the text length at which a window's sum is a surge.
WINDOW, SURGE = 3, 80

# Element names of HTML by how they are treated.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "audio", "b", "bdi", "bdo", "big", "br", "button", "canvas", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "map", "mark", "math", "meta", "nobr", "object", "q", "ruby", "rb", "rp", "rt", "s", "samp", "select", "small", "span", "strike", "strong", "sub", "sup", "svg", "time", "tt", "u", "var", "video", "wbr"}
FOREIGN = {"svg", "math"}
NEVER = {"nav", "footer", "aside", "form", "head", "button", "select", "option", "menu", "dialog", "svg", "canvas", "object", "audio", "video", "map", "datalist", "fieldset"}
ARTICLE = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HOLDERS = {"article", "main", "body", "div", "section", "td", "blockquote", "center"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "paywall", "nav", "navbar", "navigation", "navi", "menu", "menus", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "sidebar", "sidebars", "aside", "rail", "widget", "widgets", "footer", "foot", "masthead", "topbar", "toolbar", "header", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion", "share", "sharing", "social", "related", "recommended", "recommendations", "skip", "copyright", "legal", "disclaimer", "announcement", "announcements", "toast", "promoted", "affiliate", "responses", "feedback", "guestbook"}
#: Names beside "header" that make it the article's own.
OWN_HEADER = {"article", "post", "entry", "story", "content"}
#: Words beside a name that say whether something is there, that it is the page's layout, and that it is a part of what is named.
STATES = {"no", "not", "non", "without", "with", "has", "have", "is", "hide", "hides", "hidden", "enable", "enabled", "disable", "disabled", "open", "closed", "supports", "show", "beside", "allowed"}
LAYOUT = {"wrap", "wrapper", "content", "article", "story", "entry", "body", "page", "main", "layout"}
PARTS = {"wrap", "wrapper", "content", "body", "box", "inner", "container", "area", "section", "block", "list", "item", "items", "entry"}
SIDES = {"left", "right", "top", "bottom"}
#: Names of reader comments, which may stand in article elements.
COMMENTS = {"comment", "comments", "commentlist", "reply", "replies", "respond", "discussion", "responses", "guestbook"}
#: Why an element is left out: not at all, by its name, as its readers' comment, or always.
KEPT, NAMED, COMMENT, ALWAYS = range(4)

_OPEN = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]++))?+|["']""")
_WANTED = re.compile(r"class|id|role|hidden|item", re.I)
_CAMEL = re.compile(r"([a-z])([A-Z])")
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def tokens(page: str) -> Iterator[tuple[str, bool, str, int, int]]:
    """(element name, whether it closes, attributes, begin, end) of each piece of markup; no name for comments, declarations and raw text.

    Each place is looked at a bounded number of times: what isn't closed anywhere behind a place isn't searched for again.
    """
    size, at = len(page), 0
    missing: dict[str, bool] = {}

    def find(what: str, start: int) -> int:
        if missing.get(what):
            return -1
        k = page.find(what, start)
        missing[what] = k < 0
        return k

    def tag_end(start: int) -> int:
        while True:
            m = _STOP.search(page, start)
            if not m:
                return -1
            if m[0] == ">":
                return m.end()
            start = m.end()
            before = m.start() - 1
            while before >= 0 and page[before] in " \t\n\r\f" and m.start() - before < 9:
                before -= 1
            if page[before] == "=":  # a quoted value; quotes elsewhere are like letters
                close = find(m[0], start)
                start = close + 1 if close >= 0 else start

    while True:
        begin = page.find("<", at)
        if begin < 0 or begin + 1 >= size:
            return
        mark = page[begin + 1]
        if mark == "!" or mark == "?":
            stop, skip = ("-->", 2) if page.startswith("<!--", begin) else ("]]>", 3) if page.startswith("<![CDATA[", begin) else (">", 1)
            k = find(stop, begin + skip)
            at = size if k < 0 else k + len(stop)
            yield "", False, "", begin, at
            continue
        closing = mark == "/"
        m = _OPEN.match(page, begin + 1 + closing)
        if not m:
            if closing and begin + 2 < size:
                k = find(">", begin)
                at = size if k < 0 else k + 1
                yield "", False, "", begin, at
            else:
                at = begin + 1  # a "<" of the text
            continue
        at = tag_end(m.end())
        if at < 0:  # the page ends inside this tag
            yield "", False, "", begin, size
            return
        name = m[0].lower()
        if name in _ENDS and not closing:
            k = _ENDS[name].search(page, at)
            stop = tag_end(k.end()) if k else -1
            at = size if stop < 0 else stop
            yield "", False, "", begin, at
            continue
        yield name, closing, page[m.end() : at - 1], begin, at


def _parts(token: str) -> list[str]:
    return _PART.findall(_CAMEL.sub(r"\1-\2", token).lower())


def _named(token: str, alone: bool, own: bool) -> bool:
    """Whether a class name or id is that of something beside articles. ``alone``: it is the element's only one; ``own``: a header would be an article's."""
    parts = _parts(token)
    if not any(x in NAMES and not (x == "header" and own) for x in parts) or not STATES.isdisjoint(parts):
        return False
    if len(parts) == 1:
        return True
    if parts[-1] in NAMES:
        return parts[0] not in ("wrap", "wrapper", "layout", "body")
    if parts[0] in NAMES and parts[-1] in SIDES:  # beside other names, a side is the page's layout
        return alone
    if parts[0] in NAMES and parts[-1] in PARTS:
        return True
    return LAYOUT.isdisjoint(parts) and SIDES.isdisjoint(parts)


def unwanted(tag: str, attributes: str, inside_article: bool, behind_text: bool) -> int:
    """Why an element is left out; ``behind_text``: it stands in an article element, behind text of the article's own."""
    if tag in NEVER or tag == "header" and not inside_article:
        return ALWAYS
    why = COMMENT if tag == "article" and behind_text else KEPT  # an article's articles are its readers' comments
    if not attributes or tag in ("html", "body") or not _WANTED.search(attributes):
        return why
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = (m[1] or "").lower(), (m[2] or "").strip("\"'")
        if kind == "hidden" and value.lower() != "until-found" or kind == "aria-hidden" and value.lower() == "true":
            return ALWAYS
        if kind == "itemprop" and value.lower() == "comment" or kind == "itemtype" and value.lower().endswith("/comment") or kind == "role" and value.lower() == "comment":
            why = COMMENT
        elif kind == "role" and value.lower() in ROLES and tag not in ARTICLE:
            return ALWAYS
        elif kind in ("class", "id"):
            names = value.split()
            own = inside_article or any(not OWN_HEADER.isdisjoint(_parts(token)) for token in names)
            for token in names:
                parts = _parts(token)
                if parts and parts[0] in COMMENTS and STATES.isdisjoint(parts):
                    why = COMMENT
                elif tag not in ARTICLE and _named(token, kind == "id" or len(names) == 1, own):
                    why = max(why, COMMENT if parts[-1] in COMMENTS else NAMED)
    return why


def page_lines(page: str) -> list[tuple[str, int, int, int]]:
    """(text, characters of link text, kind, holder) of the page's lines in order; kind is 1 in an article element, 0 elsewhere, -1 where no article can be.

    A line that is -1 has no text: it marks the place of what was left out, once for neighbours. Lines of one holder stand
    directly, but for lists and headings, in the same element.
    """
    lines: list[tuple[str, int, int, int, int, int]] = []  # text, links, in an article, holder, always left out, innermost element that may be
    words: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, why it is left out, its number if it is by name
    places: dict[str, list[int]] = {}
    blocks: list[int] = []
    holders: list[int] = [0]
    soft: list[int] = [-1]
    soft_ones: list[list[int]] = []  # why, the element around it that is left out, and how many main, article and h1 elements it holds
    state = {"links": 0, "anchor": -1, "articles": 0, "never": 0, "holder": 0, "nested": 0, "heading": 0, "own": 0}
    met = {"main": 0, "article": 0, "h1": 0}

    def flush() -> None:
        if words:
            text = _SPACE.sub(" ", "".join(words)).strip()
            if text:
                lines.append((text, state["links"], int(state["articles"] > 0), holders[-1], state["never"], soft[-1]))
                if state["nested"] == 1 and not state["heading"] and not state["never"]:
                    state["own"] = 1
            words.clear()
        state["links"] = 0

    def mark() -> None:
        lines.append(("", 0, 0, holders[-1], state["never"], soft[-1]))

    def take(raw: str) -> None:
        if raw and not state["never"]:
            text = html.unescape(raw) if "&" in raw else raw
            words.append(text)
            if state["anchor"] >= 0:
                state["links"] += len(text.strip())

    def push(name: str, why: int) -> None:
        places.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            blocks.append(len(stack))
        number = -1
        if why == ALWAYS:
            if not state["never"] and name not in INLINE:
                flush()
            state["never"] += 1
            if state["never"] == 1 and name not in INLINE:
                mark()
        elif why:
            flush()
            number = len(soft_ones)
            soft_ones.append([why, soft[-1], -met["main"], -met["article"], -met["h1"]])
            soft.append(number)
            mark()
        elif not state["never"] and name in met:
            met[name] += 1
        if name in ARTICLE and not why:
            state["articles"] += 1
        if name == "article":
            if not state["nested"]:
                state["own"] = 0
            state["nested"] += 1
        if name in HEADINGS:
            state["heading"] += 1
        if name in HOLDERS:
            state["holder"] += 1
            holders.append(state["holder"])
        stack.append((name, why, number))

    def pop(k: int) -> None:
        """Close the elements from place k on."""
        while len(stack) > k:
            name, why, number = stack.pop()
            places[name].pop()
            if name not in INLINE:
                blocks.pop()
            if why == ALWAYS and name not in INLINE or number >= 0:
                flush()
            if why == ALWAYS:
                state["never"] -= 1
            elif number >= 0:
                soft.pop()
                for i, what in enumerate(met, 2):
                    soft_ones[number][i] += met[what]
            if name in ARTICLE and not why:
                state["articles"] -= 1
            state["nested"] -= name == "article"
            state["heading"] -= name in HEADINGS
            if name in HOLDERS:
                holders.pop()
            if len(stack) <= state["anchor"]:
                state["anchor"] = -1

    at = 0
    for tag, closing, attributes, begin, end in tokens(page):
        take(page[at:begin])
        at = end
        if not tag:  # a comment, a declaration or an element of raw text, which leave the block as it is
            continue
        inline = tag in INLINE
        if tag == "br":
            take(" ")
        elif not inline and not state["never"]:
            flush()
        if closing:
            k = places[tag][-1] if places.get(tag) else -1
            if tag == "a":
                state["anchor"] = -1
            elif k >= 0 and (not inline or not blocks or blocks[-1] < k or stack[k][1] == ALWAYS):
                pop(k)
        elif tag not in VOID and not (tag in FOREIGN and attributes.endswith("/")):
            drawing = any(places.get(x) for x in FOREIGN)
            if not inline and not drawing and blocks and stack[blocks[-1]][0] == "p":
                pop(blocks[-1])  # a paragraph ends where another block begins
            if tag in ("li", "dt", "dd", "tr", "td", "th") and blocks and stack[blocks[-1]][0] == tag:
                pop(blocks[-1])
            if tag == "a":
                state["anchor"] = len(stack)
            why = unwanted(tag, attributes, state["articles"] > 0, state["nested"] > 0 and state["own"] > 0)
            if tag != "a" or why:
                push(tag, why)
    take(page[at:])
    flush()
    pop(0)
    return _kept(lines, soft_ones, list(met.values()))


def _kept(lines: list[tuple], soft: list[list[int]], met: list[int]) -> list[tuple[str, int, int, int]]:
    """Without the lines of elements that are left out.

    A name doesn't count for an element that holds a main element, or all of the page's articles and first headings. If nothing
    were left, the element with most text is kept, of comments last, and what it holds is decided anew.
    """
    held = [0] * len(soft)
    for text, *_, never, within in lines:
        if within >= 0 and not never:
            held[within] += len(text)
    for number in range(len(soft) - 1, -1, -1):  # elements come after those around them
        if soft[number][1] >= 0:
            held[soft[number][1]] += held[number]
    spared = [why == NAMED and (main > 0 or bool(met[1] and met[2]) and (articles, h1) == (met[1], met[2])) for why, _, main, articles, h1 in soft]
    while True:
        out: list[bool] = []
        for (_, around, *_), spare in zip(soft, spared, strict=True):
            out.append(around >= 0 and out[around] or not spare)
        kept: list[tuple[str, int, int, int]] = []
        for text, links, article, holder, never, within in lines:
            gone = never or within >= 0 and out[within]
            if gone and (not kept or kept[-1][2] != -1):
                kept.append(("", 0, -1, -1))
            elif text and not gone:
                kept.append((text, links, article, holder))
        outer = [n for n, (_, around, *_) in enumerate(soft) if out[n] and held[n] and not (around >= 0 and out[around])]
        if not outer or any(text and 2 * links <= len(text) for text, links, *_ in kept):
            return kept
        spared[min(outer, key=lambda n: (soft[n][0], -held[n], n))] = True


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article of a page: lines between the surge and the dive of the windows' text lengths, joined by line feeds.

    Where the page has article elements, only they count. A page whose windows never surge gives its longest run. Lines of
    links between two lines of an article, and the text behind them in the same element, belong to it.
    """
    lines = page_lines(page)
    if any(kind == 1 for _, _, kind, _ in lines):
        lines = [line for line in lines if line[2] != 0]
    sizes = [0 if kind == -1 or 2 * links > len(text) and kind == 0 else len(text) for text, links, kind, _ in lines]
    if not any(sizes):
        return ""
    sums = [sum(sizes[i : i + window]) for i in range(len(sizes))]
    level = min(surge, max(sums))
    taken: list[int] = []
    i = 0
    while i < len(sums):
        if sums[i] >= level:
            first = i
            while first < len(sizes) and not sizes[first]:
                first += 1
            end = i
            while end < len(sums) and sums[end]:  # the dive
                end += 1
            least = taken[-1] + 1 if taken else 0
            while first > least and any(sizes[max(least, first - window) : first]):  # short lines before the surge, such as a heading
                first -= 1
            last = max((k for k in range(first, min(end, len(sizes))) if sizes[k]), default=first)
            around = {lines[k][3] for k in range(first, last + 1) if sizes[k]}
            k = last + 1
            while k < len(lines) and lines[k][2] != -1 and (lines[k][3] in around):  # text behind links, in the same element
                if sizes[k]:
                    last = k
                k += 1
            taken += [k for k in range(first, last + 1) if sizes[k] or lines[k][0] and lines[k][3] in around]
            i = max(end, last + 1)
        else:
            i += 1
    return "\n".join(lines[k][0] for k in taken)


def _extract(window: int, surge: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                some = batch.slice(lo, 200)
                texts = [main_text(x or "", window, surge) for x in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, *, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """page_id, url, main text and its code points of every row.

    Null or empty html and pages without an article give an empty text; rows that repeat stay; null ids and urls stay
    null; other columns are left out. A page cut off anywhere gives what came before. A row is read whole, however long.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(window, surge), "page_id long, url string, text string, n_chars long")
