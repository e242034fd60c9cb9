"""The visible text of HTML pages, laid out: blocks apart, lists with markers, table cells aligned.

A page is read into a tree: a start tag closes what can't hold it (a paragraph before a block, an item before the next, a cell before a
row), missing rows are put in, end tags without a start are ignored and what stays open ends with its parent. The end tag of an inline
element leaves the blocks open inside it as they are: a formatting element (b, a, font ...) ends there and what follows in these blocks isn't
in it, the tag of any other is ignored. Script, style and the like hold raw text. Elements open at any depth. The tree is walked once, by a stack of its own, as Python's calls end too soon:

* hidden are the elements of HIDDEN, those with `hidden`, display:none, inputs, closed dialogs, closed details but for their first summary, and text
  under visibility:hidden that isn't made visible again;
* runs of white space are one blank, but not in pre and textarea or as white-space says; br is a new line;
* blocks begin on a new line, those of SPACED with an empty line before and after;
* items have "- " or their number, by start, value and reversed, and are indented by their depth; a list in a list has no empty lines around it;
* a table is a grid with column and row spans; a column is as wide as its widest cell, cells are two blanks apart, lines of a cell
  stay in its column. A table in a cell is laid out in it.

Defined cases: a null, empty or text-free page has the empty text. Broken markup never fails: what can't be a tag is text. Rows that repeat
a page_id are pages of their own; null ids are kept. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Generator, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes object video audio canvas svg math datalist meta link base param "
                   "source track area map input colgroup col rp".split())
BLOCK = frozenset("html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table ul xmp "
                  "caption tbody thead tfoot tr td th".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure hr fieldset xmp".split())
ENDS_P = BLOCK - frozenset("html body dd dt li option optgroup caption tbody thead tfoot tr td th legend".split()) | {"li", "dd", "dt"}
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that the end tag of an inline element can't close
SPECIAL = BLOCK | frozenset("applet button head marquee noscript object select template".split())
WHITE_SPACE = {"pre": "kept", "pre-wrap": "kept", "break-spaces": "kept", "pre-line": "lined", "normal": "text", "nowrap": "text"}
#: A start tag closes an open element of the first set, unless one of the second is open inside
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}), "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}), "optgroup": ({"optgroup"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}), "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "body": ({"head"}, set()),
}
#: Widest span that is laid out, as in browsers
MOST_COLUMNS = 1000

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_NUMBER = re.compile(r"\s*([+-]?\d{1,9})")


class Element:
    __slots__ = ("tag", "attributes", "children", "ended")

    def __init__(self, tag: str, attributes: dict[str, str], children: list | None = None):
        self.tag, self.attributes, self.children = tag, attributes, [] if children is None else children
        self.ended = False  # by an end tag, while blocks inside are still open


def _attributes(page: str, at: int, no_more: set[str]) -> tuple[dict[str, str], int]:
    """Attributes from `at`, and the place after the tag's end; -1 if the tag doesn't end."""
    out: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        if not m:
            end = page.find(">", at)
            return out, end + 1 if end >= 0 else -1
        name, at, value = m[1].lower(), m.end(), ""
        if m[2]:
            quote = page[at:at + 1]
            end = page.find(quote, at + 1) if quote and quote in "\"'" and quote not in no_more else -1
            if end >= 0:
                value, at = page[at + 1:end], end + 1
            else:
                if quote and quote in "\"'":
                    no_more.add(quote)
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        out.setdefault(name, unescape(value))


def tokens(page: str) -> Iterator[tuple]:
    """("text", text), ("start", tag, attributes) and ("end", tag) in order; text is decoded."""
    at, n, no_more = 0, len(page), set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", unescape(page[at:])
            return
        if lt > at:
            yield "text", unescape(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            if page.startswith((">", "->"), lt + 4):
                end = page.index(">", lt + 4) - 2
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, lt)
        if not m:
            if page.startswith("</", lt):  # no tag: browsers drop it
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<"
                at = lt + 1
            continue
        tag = m[1].lower()
        given, at = _attributes(page, m.end(), no_more)
        if at < 0:
            return
        if page[lt + 1] == "/":
            yield "end", tag
            continue
        yield "start", tag, given
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            end = close.start() if close else n
            raw = page[at:end]
            if tag == "textarea" or tag == "title":
                raw = unescape(raw)
            if raw:
                yield "text", raw
            at = end


def tree_of(page: str) -> Element:
    root = Element("html", {})
    open_ = [root]
    places: dict[str, list[int]] = {}  # where in open_ the elements of a tag stand, so that depth costs no search
    special: list[int] = []  # where those of SPECIAL stand

    def push(tag, attributes):
        node = Element(tag, attributes)
        open_[-1].children.append(node)
        if tag not in VOID:
            places.setdefault(tag, []).append(len(open_))
            if tag in SPECIAL:
                special.append(len(open_))
            open_.append(node)

    def cut(k) -> None:
        while len(open_) > k or open_[-1].ended:
            node = open_.pop()
            if not node.ended:
                places[node.tag].pop()
            if special and special[-1] == len(open_):
                special.pop()

    def end_early(k) -> None:
        """End an element in which blocks stay open. If it hides its text, they move out of it, and what they hold so far goes into copies of it."""
        node, inside, holder = open_[k], open_[k + 1:], open_[k - 1]
        places[node.tag].pop()
        if not _hides(node):
            node.ended = True
            return
        node.children.pop()
        for i, inner in enumerate(inside):
            holder.children.append(inner)
            before = inner.children
            if i + 1 < len(inside):
                before.pop()
            inner.children = [Element(node.tag, node.attributes, before)] if before else []
            holder = inner
        del open_[k]
        for t in {e.tag for e in inside}:
            places[t] = [at - (at > k) for at in places[t]]
        special[:] = [at - (at > k) for at in special]

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags, stop) -> None:
        k = last(tags)
        if k and k > last(stop):
            cut(k)

    for kind, *more in tokens(page):
        if kind == "text":
            open_[-1].children.append(more[0])
            continue
        tag = more[0]
        if kind == "end":
            if tag == "br":
                push("br", {})
            elif tag in HEADINGS:
                close(HEADINGS, {"td", "th", "table"})
            elif tag == "li":
                close({"li"}, {"ul", "ol", "menu", "td", "th", "table"})
            elif tag in SPECIAL and tag not in ("html", "body"):
                close({tag}, {"td", "th", "table"} - {tag} if tag not in ("tr", "tbody", "thead", "tfoot", "table") else {"table"} - {tag})
            elif (k := last({tag})) > last({"td", "th", "table", "caption"}):
                if not special or special[-1] < k:
                    cut(k)
                elif tag in FORMATTING:
                    end_early(k)
            continue
        if tag == "html":
            continue
        if tag == "body" and open_[-1].tag != "head":
            continue
        if tag in BLOCK and open_[-1].tag == "head":
            cut(len(open_) - 1)
        if tag in ENDS_P:
            close({"p"}, {"table", "td", "th", "button"})
        if tag in HEADINGS and open_[-1].tag in HEADINGS:
            cut(len(open_) - 1)
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in ("td", "th") and open_[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push("tr", {})
        push(tag, more[1])
    return root


def _style(node: Element) -> dict[str, str]:
    style = node.attributes.get("style")
    if not style:
        return {}
    return {k.strip().lower(): v.replace("!important", "").strip().lower() for k, _, v in (p.partition(":") for p in style.split(";"))}


def _hides(node: Element) -> bool:
    style = _style(node)
    return "hidden" in node.attributes or style.get("display") == "none" or "visibility" in style


def _spaces(node: Element, given: str) -> str:
    """What becomes of white space in a node, as a method of Lines."""
    if node.tag in ("pre", "textarea", "xmp"):
        given = "kept"
    return WHITE_SPACE.get(_style(node).get("white-space", ""), given)


def _number(node: Element, name: str, default: int) -> int:
    m = _NUMBER.match(node.attributes.get(name, ""))
    return int(m[1]) if m else default


class Lines:
    """Lines under construction: one that is open, and the empty lines due before the next. Lists nested in a list's lines have none around them."""

    def __init__(self, nested: bool = False):
        self.nested = nested
        self.lines: list[str] = []
        self.now = ""
        self.gap = 0

    def text(self, s: str) -> None:
        """Text whose runs of white space are one blank."""
        s = _BLANKS.sub(" ", s)
        if not self.now or self.now[-1] in " \n":
            s = s.lstrip(" ")
        if s:
            self.now += s

    def kept(self, s: str) -> None:
        head, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.now += head
        for line in rest:
            self.line(True)
            self.now = line

    def lined(self, s: str) -> None:
        """Text whose lines stay, with runs of blanks as one."""
        head, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.text(head)
        for line in rest:
            self.line(True)
            self.text(line)

    def line(self, always: bool = False) -> None:
        """End the open line; one without text counts only if it was asked for."""
        now = self.now.rstrip(" ")
        self.now = ""
        if now or always:
            self.add([now])

    def add(self, lines: list[str]) -> None:
        if self.lines and any(lines):
            self.lines += [""] * self.gap
        if any(lines):
            self.gap = 0
        self.lines += lines

    def space(self) -> None:
        self.line()
        if self.lines:
            self.gap = 1

    def done(self) -> list[str]:
        self.line()
        out = self.lines
        while out and not out[-1]:
            out.pop()
        while out and not out[0]:
            out.pop(0)
        return out


def _run(walk: Generator) -> list[str] | None:
    """Run a walk that yields the walks it needs and is given what they return."""
    stack, result = [walk], None
    while stack:
        try:
            stack.append(stack[-1].send(result))
            result = None
        except StopIteration as end:
            stack.pop()
            result = end.value
    return result


def _walk(node: Element, out: Lines, shown: bool, spaces: str, preset: list | None = None) -> Generator:
    for child in preset if preset is not None else node.children:
        if isinstance(child, str):
            if shown:
                getattr(out, spaces)(child)
            continue
        tag, given = child.tag, child.attributes
        if tag in HIDDEN or "hidden" in given or tag == "dialog" and "open" not in given:
            continue
        style = _style(child)
        if style.get("display") == "none":
            continue
        see = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""), shown)
        if tag == "br":
            if shown:
                out.line(True)
            continue
        if tag == "table":
            out.space()
            out.add((yield _table_lines(child, see)))
            out.space()
            continue
        if tag in ("ul", "ol", "menu"):
            (out.line if out.nested else out.space)()
            out.add((yield _list_lines(child, see, _spaces(child, spaces))))
            (out.line if out.nested else out.space)()
            continue
        if tag == "dd":
            out.line()
            part = Lines(out.nested)
            yield _walk(child, part, see, _spaces(child, spaces))
            out.add(["  " + s if s else s for s in part.done()])
            continue
        block = tag in BLOCK
        if block:
            (out.space if tag in SPACED else out.line)()
        summary = None
        if tag == "details" and "open" not in given:
            summary = [c for c in child.children if isinstance(c, Element) and c.tag == "summary"][:1]
        yield _walk(child, out, see, _spaces(child, spaces), summary)
        if block:
            (out.space if tag in SPACED else out.line)()
        elif tag in ("td", "th"):
            out.text(" ")


def _list_lines(node: Element, shown: bool, spaces: str) -> Generator:
    items = [c for c in node.children if isinstance(c, Element) and c.tag == "li"]
    step = -1 if "reversed" in node.attributes else 1
    number = _number(node, "start", len(items) if step < 0 else 1)
    out = Lines()
    for child in node.children:
        part = Lines(True)
        if isinstance(child, str) or child.tag != "li":
            yield _walk(node, part, shown, spaces, [child])
            out.add(part.done())
            continue
        if child.tag == "li" and node.tag == "ol":
            number = _number(child, "value", number)
            mark = f"{number}. "
            number += step
        else:
            mark = "- "
        holder = Element("li", child.attributes)
        holder.children = child.children
        wrapped = Element("span", {k: v for k, v in child.attributes.items() if k in ("hidden", "style")})
        if "hidden" in wrapped.attributes or _style(wrapped).get("display") == "none":
            if node.tag == "ol":
                number -= step
            continue
        see = {"hidden": False, "collapse": False, "visible": True}.get(_style(wrapped).get("visibility", ""), shown)
        yield _walk(holder, part, see, _spaces(child, spaces))
        lines = part.done()
        if lines:
            out.add([mark + lines[0], *[" " * len(mark) + s if s else s for s in lines[1:]]])
    return out.done()


def _table_lines(table: Element, shown: bool) -> Generator:
    rows: list[tuple[Element, bool]] = []
    captions: list[list[str]] = []
    loose = Lines()

    def visible(node: Element, now: bool) -> bool | None:
        style = _style(node)
        if node.tag in HIDDEN or "hidden" in node.attributes or style.get("display") == "none":
            return None
        return {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""), now)

    def gather(node: Element, now: bool) -> Generator:
        for child in node.children:
            if isinstance(child, str):
                if now and child.strip():
                    loose.text(child)
            elif (see := visible(child, now)) is not None:
                if child.tag == "tr":
                    rows.append((child, see))
                elif child.tag in ("tbody", "thead", "tfoot"):
                    yield gather(child, see)
                elif child.tag == "caption":
                    part = Lines()
                    yield _walk(child, part, see, _spaces(child, "text"))
                    captions.append(part.done())
                else:  # what a table can't hold stands before it
                    yield _walk(node, loose, now, "text", [child])

    yield gather(table, shown)
    grid: dict[tuple[int, int], list[str]] = {}
    spans: list[tuple[int, int, int, list[str]]] = []
    taken: dict[int, int] = {}  # column: rows that a cell from above still covers
    width = 0
    for y, (row, see) in enumerate(rows):
        x, covered = 0, {c: n for c, n in taken.items() if n > 0}
        taken = {c: n - 1 for c, n in covered.items()}
        for cell in row.children:
            if isinstance(cell, str):
                if see and cell.strip():
                    loose.text(cell)
                continue
            look = visible(cell, see)
            if look is None:
                continue
            if cell.tag not in ("td", "th"):
                yield _walk(row, loose, see, "text", [cell])
                continue
            while covered.get(x, 0) > 0:
                x += 1
            across = min(max(_number(cell, "colspan", 1), 1), MOST_COLUMNS)
            down = max(_number(cell, "rowspan", 1), 0) or len(rows)
            part = Lines()
            yield _walk(cell, part, look, _spaces(cell, "text"))
            lines = part.done()
            if across == 1:
                grid[y, x] = lines
            else:
                spans.append((y, x, across, lines))
            for c in range(x, x + across):
                if down > 1:
                    taken[c] = max(taken.get(c, 0), down - 1)
            x += across
            width = max(width, x)
    wide = [0] * width
    for (_, x), lines in grid.items():
        wide[x] = max([wide[x], *map(len, lines)])
    for _, x, across, lines in spans:
        lack = max([0, *map(len, lines)]) - sum(wide[x:x + across]) - 2 * (across - 1)
        if lack > 0:
            wide[x + across - 1] += lack
    starts, at = [], 0
    for w in wide:
        starts.append(at)
        at += w + 2 if w else 0
    by_row: dict[int, list] = {}
    for (y, x), lines in grid.items():
        by_row.setdefault(y, []).append((x, lines))
    for y, x, _, lines in spans:
        by_row.setdefault(y, []).append((x, lines))
    out = Lines()
    out.add(loose.done())
    for lines in captions:
        out.add(lines)
    for y in range(len(rows)):
        cells = sorted(by_row.get(y, ()), key=lambda c: c[0])
        for k in range(max([0, *(len(lines) for _, lines in cells)])):
            line = ""
            for x, lines in cells:
                if k < len(lines) and lines[k]:
                    line = line.ljust(starts[x]) + lines[k]
            out.add([line.rstrip(" ")])
    return out.done()


def visible_text(page: str | None) -> str:
    if not page:
        return ""
    out = Lines()
    _run(_walk(tree_of(page), out, True, "text"))
    return "\n".join(out.done())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            texts = [visible_text(p.as_py()) for p in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["page_id", "text"])


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, text: one row per page."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(
        _extract, "page_id long, text string")
