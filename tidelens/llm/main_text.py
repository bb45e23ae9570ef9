"""Main text of HTML pages by line-block distribution: text lengths over sliding windows of lines, cut where they surge and dive."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW = 3  # lines summed at each place
SURGE = 80  # characters in a window that mark running text

# Elements of HTML by what they mean here
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "math", "object", "canvas", "audio", "video", "xmp", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt",
          "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "link", "meta", "source", "track", "param"}
BOXES = {"html", "body", "main", "article", "section", "div", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "ul", "ol", "dl", "blockquote", "figure", "center", "details"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "button", "select", "option", "fieldset", "dialog", "head", "datalist", "label", "legend", "map", "applet", "frameset"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist", "note", "status"}
COMMENTS = {"comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "discussion", "feedback", "reviews"}
WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "banner", "promo", "promoted", "promotion", "sponsor", "sponsored", "nav", "navbar",
         "navigation", "menu", "submenu", "breadcrumb", "breadcrumbs", "header", "masthead", "topbar", "footer", "colophon", "copyright", "sidebar", "aside", "rail", "widget",
         "widgets", "related", "recommended", "recommendations", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "disclaimer", "popup", "modal",
         "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "share", "sharing", "social", "pagination", "pager", "toolbar", "skip", "tags",
         "toc", "paywall"} | COMMENTS
UNLESS = {"no", "has", "with", "without", "hide", "not"}  # before such a word it describes a layout

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
KEEP, SOFT, HARD = 0, 1, 2  # not boilerplate, by a word in its class or id, by its element


@dataclass
class Line:
    text: str
    plain: int  # characters outside links; 0 for boilerplate
    boxes: tuple[int, ...]  # the boxes it is in, outermost first
    drop: int
    heading: bool


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if "=" in raw or "hidden" in raw else {}


def _marked(tag: str, raw: str) -> int:
    """Whether an element is boilerplate by its name, role, class or id."""
    if tag in BOILERPLATE:
        return HARD
    if not raw.strip(" />") or tag in ("html", "body"):
        return KEEP
    a = _attributes(raw)
    if a.get("aria-hidden") == "true" or ("hidden" in a and a["hidden"] != "until-found") or re.search(r"display\s*:\s*none", a.get("style", "")) or a.get("role", "").lower() in ROLES:
        return HARD
    for name in (a.get("class", "") + " " + a.get("id", "")).split():
        parts = [p.lower() for p in _PART.findall(name)]
        if UNLESS & set(parts):
            continue
        if COMMENTS & set(parts):
            return HARD
        if tag not in HEADINGS and tag not in ("main", "article") and WORDS & set(parts):
            return SOFT
    return KEEP


def lines_of(page: str) -> tuple[list[Line], dict[int, str]]:
    """The blocks of text of a page in order, and the boxes that claim to be its main part (number: element)."""
    lines: list[Line] = []
    stack: list[tuple[str, int, int]] = [("", 0, KEEP)]  # element, box, boilerplate
    main: dict[int, str] = {}
    held: list[str] = []
    state = {"plain": 0, "link": 0, "box": 0, "heading": False, "header": 0}

    def cut():
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            drop = stack[-1][2]
            if drop == KEEP and any(s[0] == "header" for s in stack) and not state["heading"]:
                drop = HARD
            boxes = tuple(dict.fromkeys(s[1] for s in stack))
            lines.append(Line(text, state["plain"] if drop == KEEP else 0, boxes, drop, state["heading"]))
        state["plain"] = 0

    pos, end = 0, len(page)
    for m in iter(lambda: _TOKEN.search(page, pos), None):
        if m.start() > pos:
            held.append(page[pos:m.start()])
            state["plain"] += 0 if state["link"] else m.start() - pos
        pos = m.end()
        if m[2] is None:
            continue
        tag, raw, closing = m[2].lower(), m[3], bool(m[1])
        if tag in RAW:
            if not closing and not raw.endswith("/>"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
                pos = stop.end() if stop else end
            continue
        if tag in INLINE:
            if tag == "br":
                held.append(" ")
            elif tag == "a":
                state["link"] = int(not closing)
            if closing:
                if stack[-1][0] == tag:
                    cut()
                    stack.pop()
            elif tag not in VOID and ((mark := _marked(tag, raw)) or stack[-1][0] == tag):  # an inline advert: its text is a line of its own
                cut()
                stack.append((tag, stack[-1][1], max(mark, stack[-1][2])))
            continue
        cut()
        state["link"] = 0
        if closing:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if at:
                del stack[at:]
            state["heading"] = False if tag in HEADINGS else state["heading"]
        elif tag not in VOID:
            state["heading"] = tag in HEADINGS
            mark, before = _marked(tag, raw), stack[-1][2]
            if tag == "header" and not any(s[0] in ("article", "main") for s in stack):
                mark = HARD
            claims = tag in ("article", "main") or "articleBody" in raw
            level = KEEP if claims and mark == KEEP and before == SOFT else max(mark, before)
            if tag in ("p", *HEADINGS):  # these end where the next block starts
                while stack[-1][0] in ("p", *HEADINGS):
                    stack.pop()
                level = max(mark, stack[-1][2])
                if mark:
                    stack.append((tag, stack[-1][1], level))
            elif tag in BOXES or tag in BOILERPLATE or tag == "header" or mark:
                state["box"] += 1
                if claims and level == KEEP:
                    main[state["box"]] = tag
                stack.append((tag, state["box"] if tag in BOXES else stack[-1][1], level))
    if pos < end:
        held.append(page[pos:])
        state["plain"] += 0 if state["link"] else end - pos
    cut()
    return lines, main


def regions(lines: list[Line]) -> list[list[int]]:
    """Runs of lines between a surge and the next dive of the window sums.

    Where the box changes and at boilerplate, as many empty lines as a window has are put in between: sums fall to zero there."""
    row: list[tuple[int, int]] = []  # (line or -1, characters)
    before = None
    for i, line in enumerate(lines):
        if line.drop != KEEP or line.boxes != before:
            row += [(-1, 0)] * WINDOW
        before = line.boxes if line.drop == KEEP else None
        row.append((i, line.plain))
    sums = [sum(n for _, n in row[i:i + WINDOW]) for i in range(len(row))]
    out, run = [], []
    for (i, _), total in zip(row, sums):
        if total:
            run += [i] if i >= 0 else []
        elif run:
            out.append(run)
            run = []
    return [r for r in [*out, run] if r]


def between(lines: list[Line], picked: list[int]) -> list[int]:
    """Of the picked lines those from the first surge to the last dive: the first and the last line that a window with text covers.

    Runs of links at the ends, longer than a window reaches, are cut; with nothing but links there is no surge and all is kept."""
    text = [k for k, i in enumerate(picked) if lines[i].plain]
    return picked[max(text[0] - WINDOW + 1, 0):text[-1] + WINDOW] if text else picked


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in order, joined by two newlines.

    The lines of the box that claims to be the article (``article``, ``main``, ``itemprop=articleBody``), or else of the box around the
    region with the most text, are searched for their first surge and last dive; what stands between and is no boilerplate is kept."""
    lines, main = lines_of(page or "")
    size = lambda picked: sum(lines[i].plain for i in picked)
    scope = range(len(lines))
    within = {b: [i for i in scope if b in lines[i].boxes and lines[i].drop == KEEP] for b in main}
    if any(within.values()):
        most = max(map(size, within.values()))
        # the innermost box that holds nearly all of it: a main element may hold an article and more
        best = min((b for b in within if within[b] and size(within[b]) * 10 >= most * 6), key=lambda b: (main[b] == "main", -size(within[b]), b))
        kept = within[best]
    else:
        found = regions(lines)
        peak = lambda run: max(sum(lines[i].plain for i in run[k:k + WINDOW]) for k in range(len(run)))
        strong = [r for r in found if peak(r) >= SURGE] or found
        if not strong:
            return ""
        core = max(strong, key=lambda r: (size(r), -r[0]))
        box = lines[core[0]].boxes
        beside = [r for r in strong if r is not core and len(lines[r[0]].boxes) == len(box) and lines[r[0]].boxes[:-1] == box[:-1]]
        if len(core) == 1 and len(box) > 3 and beside:
            box = box[:-1]  # each paragraph has a box of its own
        if len(box) > 2:
            kept = [i for i in scope if lines[i].drop == KEEP and lines[i].boxes[:len(box)] == box]
        else:  # everything lies in the body: from the surge to the dive
            kept = [i for i in core if lines[i].drop == KEEP]
    return "\n\n".join(lines[i].text for i in between(lines, kept))


def _texts(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = pa.array([main_text(x.as_py()) for x in batch.column("html")], pa.large_string())
        rest = [c for c in batch.schema.names if c != "html"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], text.cast(pa.string())], [*rest, "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of the main text of every page.

    Markup, scripts, styles and comments of the source are stripped and character references decoded; block elements end a line, white
    space inside it is one space. Elements, roles, classes and ids that stand for menus, headers, footers, sidebars, notices, adverts,
    forms and reader comments count no characters. Characters outside links are summed over sliding windows of lines; a region runs
    from a surge of these sums to the dive where they fall to zero. Whole pages are read, one row at a time; short and link-only blocks
    inside the article are kept. Null or empty pages, and pages without text, have an empty text. Repeated rows are each returned; other
    columns are ignored; an empty table gives no rows.
    """
    ids = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(ids.dtypes)
    out = ids.mapInArrow(_texts, f"id {kinds['id']}, url {kinds['url']}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
