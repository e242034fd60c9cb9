"""HTML: end tags out of order, details, white space, and pages against a plain recursive rendering."""

import random
import re
import time

import pytest

from evigrid.llm.html_text import visible_text

PAGES = {
    "<b><p>x</b>y</p>z": "xy\n\nz",
    "<span><div>x</span>y</div>z": "xy\nz",
    "<a><ul><li>x</a>y<li>w</ul>z": "- xy\n- w\n\nz",
    "<b><i><div>x</b>y</i>z</div>w": "xyz\nw",
    "<b style='display:none'>a<div>b<p>c</b>d</p>e</div>f": "d\n\ne\nf",
    "<i style='visibility:hidden'>a<ul><li>b</i>c<li>d</ul>e": "- c\n- d\n\ne",
    "<ul><li>a<ol></li><li>b</ol>c</ul>": "- a\n  1. b\n  c",
    "<h1>a</h2>b": "a\n\nb",
    "<table><tr><td><b>x<td>y</b>z</table>": "x  yz",
    "</b></span></div>a</li>": "a",
    "<details>q<summary>s</summary><p>hidden</p><summary>t</summary></details>u": "s\nu",
    "<details open><summary>s</summary>shown</details>": "s\nshown",
    "<details>none</details>a": "a",
    "<div style='white-space: pre'>a  b\n c</div>": "a  b\n c",
    "<div style='white-space:pre-line'>a  b\n c</div>": "a b\nc",
    "<pre>a  b<i style='white-space:normal'>  c\n d</i></pre>": "a  b c d",
    "<table><tr><td style='white-space:pre'>a\n b<td>c</table>": "a   c\n b",
}


@pytest.mark.parametrize("page", PAGES)
def test_rules(page):
    assert visible_text(page) == PAGES[page]


def grown(pick, depth=0, words=iter(range(10 ** 9))):
    """A random tree of blocks and words: (tag, children) and strings."""
    out = []
    for _ in range(pick.randint(1, 4)):
        kind = pick.choice(["text", "text", "div", "p", "ul", "ol", "section"]) if depth < 4 else "text"
        if kind == "text":
            out.append(f"w{next(words)} ")
        elif kind == "p":
            out.append(("p", [f"w{next(words)}"]))
        elif kind in ("ul", "ol"):
            out.append((kind, [("li", [f"w{next(words)} ", *grown(pick, depth + 1)]) for _ in range(pick.randint(1, 3))]))
        else:
            out.append((kind, grown(pick, depth + 1)))
    return out


def html(nodes, between=lambda: ""):
    out = ""
    for n in nodes:
        if isinstance(n, str):
            out += between() + n
        elif n[0] in ("ul", "ol"):
            out += f"<{n[0]}>" + "".join(f"<li>{html(inner, between)}{between()}</li>" for _, inner in n[1]) + f"</{n[0]}>"
        else:
            out += f"{between()}<{n[0]}>{html(n[1], between)}{between()}</{n[0]}>"
    return out


def plain(nodes, item=False):
    """Lines of a tree by recursion: every part is its lines and the empty lines it asks for around it."""
    parts = []
    for n in nodes:
        if isinstance(n, str):
            if parts and parts[-1][2]:
                parts[-1][0][-1] += " " + n.strip()
            else:
                parts.append(([n.strip()], 0, True))
        elif n[0] in ("ul", "ol"):
            lines = []
            for k, (_, inner) in enumerate(n[1]):
                mark = f"{k + 1}. " if n[0] == "ol" else "- "
                first, *rest = plain(inner, True)
                lines += [mark + first, *[" " * len(mark) + s if s else s for s in rest]]
            parts.append((lines, 0 if item else 1, False))
        else:
            # blocks inside a block can ask for empty lines at its ends
            parts.append((plain(n[1], item), 1 if n[0] == "p" else (ends(n[1], 0, item), ends(n[1], -1, item)), False))
    out = []
    due = 0
    for lines, gap, _ in parts:
        before, after = gap if isinstance(gap, tuple) else (gap, gap)
        if out and max(due, before):
            out.append("")
        out += lines
        due = after
    return out


def ends(nodes, side, item):
    """1 if the first or last thing in a block asks for an empty line."""
    n = nodes[side]
    if isinstance(n, str):
        return 0
    return 1 if n[0] == "p" else int(not item) if n[0] in ("ul", "ol") else ends(n[1], side, item)


@pytest.mark.parametrize("seed", range(150))
def test_equals_a_recursive_rendering(seed):
    pick = random.Random(seed)
    tree = grown(pick)
    want = "\n".join(plain(tree))
    assert visible_text(html(tree)) == want
    tags = [f"<{c}{t}>" for c in ("", "/") for t in ("b", "i", "a", "font", "span", "label")]
    assert visible_text(html(tree, lambda: pick.choice(tags) if pick.random() < .6 else "")) == want


def test_many_ends_in_deep_blocks_take_no_long_time():
    n = 20000
    started = time.time()
    assert re.sub(r"\s", "", visible_text("<b><div>" * n + "x" + "</b>" * n + "y" + "</div>" * n + "z")) == "xyz"
    assert time.time() - started < 20
