"""A small HTML reader for listing pages: all selectors of a source in one pass over the tags.

The CSS subset of directory descriptions (comma lists, tag, .class, #id, [attr], [attr=v],
[attr*=v], [attr^=v], [attr$=v], descendant and child steps; ``::text`` or ``::attr(name)`` at the
end) is compiled to one automaton: every step of every selector is a bit. An open tag knows the
steps that end at it and those that end at it or above; a tag is tested only for steps of its own
name, and takes a step if the one before it ended at its parent, or above it. No tree is built:
what is held is the stack of open tags. Runs inside ``mapInPandas``, one page at a time."""

import re
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# an opening tag that ends an open one of the same kind
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}

_SIMPLE = re.compile(
    r"(?P<tag>[a-zA-Z][\w-]*|\*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)"
    r"|\[(?P<attr>[\w-]+)(?:(?P<op>[*^$~]?=)(?P<q>['\"]?)(?P<val>.*?)(?P=q))?\]"
)
_STEP = re.compile(r"\s*(>)?\s*((?:[^\s>\[]|\[[^\]]*\])+)")
_COMPOUND = re.compile(
    r"(?:[a-zA-Z][\w-]*|\*|[.#][\w-]+|\[[\w-]+(?:[*^$~]?=(?:'[^']*'|\"[^\"]*\"|[^\]]*))?\])+")
_COMMA = re.compile(r",(?![^\[]*\])")
_ATTR_TESTS = {
    "=": lambda have, want: have == want, "*=": lambda have, want: want in have,
    "^=": lambda have, want: have.startswith(want), "$=": lambda have, want: have.endswith(want),
    "~=": lambda have, want: want in have.split(),
}


@lru_cache(maxsize=1024)
def compile_selector(selector: str):
    """-> alternatives of a comma list, each ([(is_child_step, tag or None, [test of the attributes,
    ...]), ...], wanted) with wanted None, "text" or an attribute name prefixed by "@". What is not
    understood is an error."""
    return [_compile_one(part.strip()) for part in _COMMA.split(selector)]


def _compile_one(selector: str):
    body, _, pseudo = selector.partition("::")
    wanted = None
    if pseudo == "text":
        wanted = "text"
    elif pseudo.startswith("attr(") and pseudo.endswith(")"):
        wanted = "@" + pseudo[5:-1].strip()
    elif pseudo:
        raise ValueError(f"unsupported selector: {selector!r}")
    steps = []
    if not body.strip() or _STEP.sub("", body).strip():
        raise ValueError(f"unsupported selector: {selector!r}")
    for child, simple in _STEP.findall(body):
        if not _COMPOUND.fullmatch(simple):
            raise ValueError(f"unsupported selector: {selector!r}")
        tag, tests = None, []
        for m in _SIMPLE.finditer(simple):
            if m["tag"]:
                tag = None if m["tag"] == "*" else m["tag"].lower()
            elif m["cls"]:
                tests.append(lambda e, c=m["cls"]: c in e.get("class", "").split())
            elif m["id"]:
                tests.append(lambda e, i=m["id"]: e.get("id") == i)
            elif m["op"]:
                tests.append(lambda e, a=m["attr"], f=_ATTR_TESTS[m["op"]], v=m["val"]: a in e and f(e[a], v))
            else:
                tests.append(lambda e, a=m["attr"]: a in e)
        steps.append((child == ">", tag, tests))
    return steps, wanted


class Program:
    """The selectors of a source as one automaton. ``listing`` names the one that marks boxes."""

    def __init__(self, selectors: dict[str, str], listing: str | None = None):
        self.names = list(selectors)
        self.listing = self.names.index(listing) if listing else None
        self.by_tag: dict[str, list] = {}
        self.any_tag: list = []
        bit = 1
        for number, selector in enumerate(selectors.values()):
            for rank, (steps, wanted) in enumerate(compile_selector(selector)):
                before = 0
                for place, (child, tag, tests) in enumerate(steps):
                    final = (rank, number, wanted) if place == len(steps) - 1 else None
                    step = (bit, before, child, tests, final)
                    (self.any_tag if tag is None else self.by_tag.setdefault(tag, [])).append(step)
                    before, bit = bit, bit << 1

    def enter(self, tag: str, attrs: dict, ended: int, above: int) -> tuple[int, dict[int, str | None]]:
        """Steps that end at a tag below a parent where ``ended`` end, and ``above`` at or above it;
        and what the selectors that match it want, the first alternative of each."""
        bits, finals = 0, []
        for steps in (self.by_tag.get(tag, ()), self.any_tag):
            for bit, before, child, tests, final in steps:
                if (not before or before & (ended if child else above)) and all(t(attrs) for t in tests):
                    bits |= bit
                    if final:
                        finals.append(final)
        return bits, {number: wanted for _, number, wanted in sorted(finals, key=lambda f: -f[0])}


class _Open:
    """An open tag: which steps end here and above, the selectors that want its text, whether it is
    a box, and how many texts it has had between its tags."""

    __slots__ = ("tag", "ended", "above", "texts", "number", "box", "in_text", "run")

    def __init__(self, tag, ended, above, texts, number, box):
        self.tag, self.ended, self.above, self.texts, self.number, self.box = tag, ended, above, texts, number, box
        self.in_text, self.run = False, 0


class PageScan(HTMLParser):
    """One pass over a page. ``counts``: matches of every selector; ``boxes``: of every listing, in
    order, the first match of each selector inside it."""

    def __init__(self, program: Program):
        super().__init__(convert_charrefs=True)
        self.program = program
        self.counts = [0] * len(program.names)
        self.found: list[dict] = []  # per box: selector -> [number of the tag, parts of its value, text]
        self.boxes_open: list[int] = []
        self.stack = [_Open("#document", 0, 0, (), -1, False)]
        self.tags = 0

    @classmethod
    def of(cls, program: Program, text: str) -> "PageScan":
        scan = cls(program)
        scan.feed(text)
        scan.close()
        return scan

    @property
    def boxes(self) -> list[dict[str, str]]:
        return [{self.program.names[k]: "".join(v) for k, (_, v, _) in found.items()} for found in self.found]

    def _tag(self, tag: str, attrs: list, stays: bool) -> None:
        here = self.stack[-1]
        here.in_text = False
        values = {k: v or "" for k, v in attrs}
        ended, wants = self.program.enter(tag, values, here.ended, here.above)
        number, texts = self.tags, []
        self.tags += 1
        box = self.program.listing in wants
        if box:
            self.boxes_open.append(len(self.found))
            self.found.append({})
        for name, wanted in wants.items():
            if wanted == "text":
                texts.append(name)
            elif wanted is None:
                self.counts[name] += 1
            elif wanted[1:] in values:
                self.counts[name] += 1
                self._offer(name, number, values[wanted[1:]])
        if stays:
            self.stack.append(_Open(tag, ended, here.above | ended, texts, number, box))
        elif box:
            self.boxes_open.pop()

    def _offer(self, name: int, number: int, value: str, run: int = 0) -> None:
        """The first tag in document order that gives a value is the match of an open box."""
        for k in self.boxes_open:
            known = self.found[k].get(name)
            if known is None or number < known[0]:
                self.found[k][name] = [number, [value], run]

    def _leave(self) -> None:
        if self.stack.pop().box:
            self.boxes_open.pop()

    def handle_starttag(self, tag, attrs):
        if self.stack[-1].tag in CLOSES.get(tag, ()):
            self._leave()
        self._tag(tag, attrs, tag not in VOID)

    def handle_startendtag(self, tag, attrs):
        self._tag(tag, attrs, False)

    def handle_endtag(self, tag):
        for place in range(len(self.stack) - 1, 0, -1):
            if self.stack[place].tag == tag:
                while len(self.stack) > place:
                    self._leave()
                return

    def handle_data(self, data):
        here = self.stack[-1]
        starts = not here.in_text
        if starts:
            here.in_text = True
            here.run += 1
        for name in here.texts:
            if starts:
                self.counts[name] += 1
                self._offer(name, here.number, data, here.run)
                continue
            for k in self.boxes_open:
                known = self.found[k].get(name)
                if known and known[0] == here.number and known[2] == here.run:
                    known[1].append(data)
