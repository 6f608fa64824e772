import random

import html_tree as H
import pytest
from leadweave.functions.html import PageScan, Program

TAGS = ["div", "p", "li", "ul", "a", "span", "td", "tr", "br", "img", "h1", "table", "script"]
SELECTORS = [
    "div", "div.a", "div > p::text", "ul li::text", "a::attr(href)", ".a .b", ".a > .b::text", "#x", "[data-k]", "[data-k=v]::text", "[href^='/o']::attr(href)",
    "li a::attr(href), li::text", "span::text, a::text, p::text", "* > span", "div p > a::text", "td::text", "tr > td a", "h1.a.b::text, .b::attr(class)", "div div::text",
    "[class*=a]::attr(data-k)", "ul > li > a::text", "p::text",
]


def page(rnd):
    out, opened = [], []
    for _ in range(rnd.randint(1, 60)):
        what = rnd.random()
        if what < 0.45:
            tag = rnd.choice(TAGS)
            attrs = "".join(f' {k}="{v}"' for k, v in (("class", rnd.choice(["a", "b", "a b", ""])), ("id", "x"), ("data-k", rnd.choice(["v", "w"])), ("href", rnd.choice(["/o/1", "", "z"]))) if rnd.random() < 0.3)
            out.append(f"<{tag}{attrs}{rnd.choice(['', '', '', '/'])}>")
            opened.append(tag)
        elif what < 0.7:
            out.append(rnd.choice(["text", " ", "\n", "a &amp; b", "x<!-- c -->y", "1 < 2", "&copy"]))
        elif opened:
            out.append(f"</{rnd.choice(opened)}>" if rnd.random() < 0.3 else f"</{opened.pop()}>")
    return "".join(out)


@pytest.mark.parametrize("seed", range(6))
def test_scan_equals_tree(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        text = page(rnd)
        listing = rnd.choice(["div", "li", ".a", "ul > li, p", "#x", "* > span"])
        fields = {s: s for s in SELECTORS if "::" in s}
        tree = H.parse_html(text)
        scan = PageScan.of(Program({"(listing)": listing, **fields}, "(listing)"), text)
        want = [{s: v for s in fields if (v := H.first(box, s)) is not None} for box in H.select(tree, listing)]
        assert scan.boxes == want, (text, listing)
        counts = PageScan.of(Program({s: s for s in SELECTORS}), text).counts
        assert counts == [sum(1 for _ in H.select(tree, s)) for s in SELECTORS], text


def test_what_is_open_is_all_that_is_held():
    scan = PageScan(Program({"(listing)": "div", "t": "div > p::text"}, "(listing)"))
    for k in range(300):
        scan.feed(f"<div><p>row {k}</p></div>")
    assert len(scan.stack) == 1 and not scan.boxes_open
    scan.close()
    assert [b["t"] for b in scan.boxes] == [f"row {k}" for k in range(300)]
