"""Model of ``leadweave.functions.html``: a tag tree of the whole page, searched once per selector."""

from html.parser import HTMLParser

from leadweave.functions.html import CLOSES, VOID, compile_selector


class Element:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """This element and everything below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Element))


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Element("#document", {}, None)

    def handle_starttag(self, tag, attrs):
        if self.here.tag in CLOSES.get(tag, ()):
            self.here = self.here.parent
        node = Element(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.here.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.here))

    def handle_endtag(self, tag):
        node = self.here
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        children = self.here.children
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)


def parse_html(text: str) -> Element:
    builder = _TreeBuilder()
    builder.feed(text)
    builder.close()
    return builder.root


_NOTHING = object()


def _matches(element: Element, steps, last: int) -> bool:
    child, tag, tests = steps[last]
    if element.tag == "#document" or (tag and element.tag != tag) or not all(t(element.attrs) for t in tests):
        return False
    if last == 0:
        return True
    up = element.parent
    if child:
        return up is not None and _matches(up, steps, last - 1)
    while up is not None:
        if _matches(up, steps, last - 1):
            return True
        up = up.parent
    return False


def select(scope: Element, selector: str):
    """Matching elements in document order, or their texts / attribute values."""
    alternatives = compile_selector(selector)
    for element in scope.walk():
        wanted = next((w for steps, w in alternatives if _matches(element, steps, len(steps) - 1)), _NOTHING)
        if wanted is _NOTHING:
            continue
        if wanted is None:
            yield element
        elif wanted == "text":
            yield from (c for c in element.children if isinstance(c, str))
        elif wanted[1:] in element.attrs:
            yield element.attrs[wanted[1:]]


def first(scope: Element, selector: str) -> str | None:
    return next(iter(select(scope, selector)), None)
