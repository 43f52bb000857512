"""A small HTML tree with CSS selectors over an inverted index, for use inside page functions.

Built on the standard library's tokenizer, which tolerates malformed pages. Selectors: tag, #id, .class, [a], [a="v"], [a*="v"],
[a^="v"], descendants, +, :not(.class), :first-child, :last-child, and commas; results come in document order.

A page is a list of nodes in document order, each with the range of its descendants and of its text. One pass lists the nodes of each id,
class, attribute and tag; a selector looks only at the nodes of the rarest of its last step's keys. Nothing recurses over the page's depth.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A new tag of the key ends an open element of the values.
IMPLIED = {"li": ("li",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
for _block in "div ul ol table article section h1 h2 h3 h4 form nav aside".split():
    IMPLIED[_block] = ("p",)
BORDERS = frozenset("table ul ol div body html select dl".split())
RAW = frozenset(("script", "style"))


class Page:
    """What the nodes of a page share: themselves in order, their texts in order, and the index, made when a selector first asks."""

    __slots__ = ("nodes", "texts", "_index")

    def __init__(self):
        self.nodes: list[Node] = []
        self.texts: list[str] = []
        self._index: dict[tuple[str, str], list[int]] | None = None

    def close(self) -> None:
        """Ranges of all nodes, from the last to the first."""
        for node in reversed(self.nodes):
            up = node.parent
            if up is not None:
                up.end, up.text_end = max(up.end, node.end), max(up.text_end, node.text_end)

    def index(self) -> dict[tuple[str, str], list[int]]:
        """Numbers of the nodes of each key, rising; "any" lists all."""
        if self._index is None:
            self._index = found = {}
            for order, node in enumerate(self.nodes):
                if not order:
                    continue
                keys = [("tag", node.tag)]
                if node.attrs:
                    keys += [("attr", a) for a in node.attrs]
                    if node.classes:
                        keys += [("cls", c) for c in dict.fromkeys(node.classes)]
                    if "id" in node.attrs:
                        keys.append(("id", node.attrs["id"]))
                for key in keys:
                    if key in found:
                        found[key].append(order)
                    else:
                        found[key] = [order]
            found["any", ""] = [*range(1, len(self.nodes))]
        return self._index


class Node:
    __slots__ = ("page", "tag", "attrs", "classes", "children", "parent", "order", "end", "place", "below", "text_start", "text_end")

    def __init__(self, page: Page, tag: str, attrs: dict[str, str], parent: Node | None):
        self.page, self.tag, self.attrs, self.parent = page, tag, attrs, parent
        self.classes = attrs["class"].split() if "class" in attrs else ()
        self.children: list[Node | str] = []
        self.below: list[Node] = []  # child elements
        self.order, self.text_start = len(page.nodes), len(page.texts)
        self.end, self.text_end = self.order + 1, self.text_start
        self.place = len(parent.below) if parent is not None else 0
        if parent is not None:
            parent.children.append(self)
            parent.below.append(self)
        page.nodes.append(self)

    def elements(self) -> list[Node]:
        return self.page.nodes[self.order + 1 : self.end]

    def text(self) -> str:
        """Text of the node and all below it, without scripts and styles."""
        return "".join(self.page.texts[self.text_start : self.text_end])

    def markup(self) -> str:
        """The node written as HTML again."""
        out: list[str] = []
        left: list[Node | str | tuple[str]] = [self]
        while left:
            at = left.pop()
            if isinstance(at, tuple):
                out.append(at[0])
            elif isinstance(at, str):
                out.append(html.escape(at))
            else:
                attrs = "".join(f' {k}="{html.escape(v or "")}"' for k, v in at.attrs.items())
                out.append(f"<{at.tag}{attrs}>")
                if at.tag not in VOID:
                    left.append((f"</{at.tag}>",))
                    left += [(c,) if at.tag in RAW and isinstance(c, str) else c for c in reversed(at.children)]
        return "".join(out)

    def script(self) -> str:
        """The raw text right inside the node."""
        return "".join(c for c in self.children if isinstance(c, str))

    def select(self, selector: str) -> list[Node]:
        """Matching nodes below this one, in document order."""
        index, groups = self.page._index or self.page.index(), _compiled.get(selector) or _compile(selector)
        if len(groups) == 1:  # most selectors have no match on most pages
            for key in groups[0][1]:
                if key not in index:
                    return []
        nodes, found = self.page.nodes, []
        for steps, keys in groups:
            if not all(map(index.__contains__, keys)):
                continue
            last = steps[-1]
            numbers = index[last.keys[0]] if len(last.keys) == 1 else min((index[key] for key in last.keys), key=len)
            inside = numbers[bisect_left(numbers, self.order + 1) : bisect_left(numbers, self.end)]
            if last.exact and len(steps) == 1:
                found += inside
            else:
                found += [k for k in inside if _matches(nodes[k], steps, len(steps) - 1)]
        return [nodes[k] for k in (found if len(groups) == 1 else sorted(set(found)))] if found else []

    def first(self, *selectors: str) -> Node | None:
        """The first match of the first selector that has one."""
        for selector in selectors:
            if found := self.select(selector):
                return found[0]
        return None

    def first_text(self, *selectors: str) -> str | None:
        """The first text that the matches of the first selector that has any hold."""
        for selector in selectors:
            for node in self.select(selector):
                if text := squeeze(node.text()):
                    return text
        return None

    def first_attr(self, name: str, *selectors: str) -> str | None:
        for selector in selectors:
            for node in self.select(selector):
                if value := (node.attrs.get(name) or "").strip():
                    return value
        return None


def squeeze(text: str | None) -> str | None:
    return " ".join(text.split()) or None if text else None


class _Builder(HTMLParser):
    def __init__(self, mark: str = ""):
        super().__init__(convert_charrefs=True)
        self.page, self.mark = Page(), mark  # mark: what stands for an ampersand that isn't read
        self.root = self.at = Node(self.page, "#root", {}, None)

    def handle_starttag(self, tag, attrs):
        ends = IMPLIED.get(tag, ())
        at = self.at
        while at is not self.root and ends:
            if at.tag in ends:
                self.at = at.parent
                ends = ends if tag == "tr" else ()
            elif at.tag in BORDERS:
                break
            at = at.parent
        node = Node(self.page, tag, {k: (v.replace(self.mark, "&") if self.mark else v) if v else "" for k, v in attrs}, self.at)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        at = self.at
        while at is not self.root and at.tag != tag:
            at = at.parent
        if at is not self.root:
            self.at = at.parent

    def handle_data(self, data):
        if self.mark:
            data = data.replace(self.mark, "&")
        self.at.children.append(data)
        if self.at.tag not in RAW:
            self.page.texts.append(data)
            self.at.text_end = len(self.page.texts)


#: Elements of which some versions of HTMLParser read the content in ways of their own.
_OWN_RULES = frozenset("textarea title iframe noembed noframes noscript xmp plaintext".split())
#: An ampersand of a reference that no semicolon ends.
_OPEN = re.compile(r"&(?=#?[A-Za-z0-9]+(?![A-Za-z0-9;]))")


def parse(page: str, closed: bool = False) -> Node:
    """The root of a page's tree. closed: only references that end in a semicolon are read, others stay as they are written."""
    page, mark = page or "", ""
    if closed and _OPEN.search(page):
        mark = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in page)
        page = _OPEN.sub(mark, page)
    builder = _Builder(mark)
    if not _feed_plain(builder, page):
        builder = _Builder(mark)
        builder.feed(page)
        builder.close()
    builder.page.close()
    return builder.root


#: A tag as most are written: a name, and attributes that are bare or have a quoted value.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z_][-.:\w]*(?:="[^"]*"|='[^']*'|(?=[ \t\n\r\f/>])))*)[ \t\n\r\f]*(/?)>""", re.ASCII)
_ATTRIBUTE = re.compile(r"""([^ \t\n\r\f=]+)(?:=(?:"([^"]*)"|'([^']*)'))?""")


def _feed_plain(builder: _Builder, page: str) -> bool:
    """Give the builder the page's tags and texts as HTMLParser would; false, with the builder to be thrown away, if it holds anything but plain tags."""
    at, tag_at, find, data = 0, _TAG.match, page.find, builder.handle_data
    while (start := find("<", at)) >= 0:
        if start > at:
            text = page[at:start]
            data(html.unescape(text) if "&" in text else text)
        if (tag := tag_at(page, start)) is None:
            return False
        at = tag.end()
        end, name, attributes, empty = tag.groups()
        name = name.lower()
        if end:
            if attributes or empty:
                return False
            builder.handle_endtag(name)
            continue
        attrs = [(k.lower(), html.unescape(v) if "&" in v else v) for k, v1, v2 in _ATTRIBUTE.findall(attributes) for v in (v1 or v2,)] if attributes else ()
        if empty:
            builder.handle_startendtag(name, attrs)
            continue
        builder.handle_starttag(name, attrs)
        if name in RAW:  # its text is raw and ends with its own end tag
            ended = find(f"</{name}>", at)
            if ended < 0 or "</" in page[at:ended]:
                return False
            if ended > at:
                data(page[at:ended])
            at = ended
        elif name in _OWN_RULES and not page.startswith(f"</{name}>", find("<", at)):
            return False
    if at < len(page):
        text = page[at:]
        data(html.unescape(text) if "&" in text else text)
    return True


_TOKEN = re.compile(r'(?P<tag>^[\w-]+|\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[*^]?=)"(?P<value>[^"]*)")?\]|:not\(\.(?P<nocls>[\w-]+)\)|:(?P<place>first-child|last-child)')


class Step:
    """A compound of a selector: whether it must follow its neighbour, its tests, and the index keys that any match has."""

    __slots__ = ("adjacent", "tests", "keys", "exact")

    def __init__(self, adjacent: bool, tests: list[dict[str, str]]):
        self.adjacent, self.tests = adjacent, tests
        keys = [(kind, t[kind]) for t in tests for kind in ("id", "cls", "tag", "attr") if kind in t and t[kind] != "*"]
        self.keys = keys or [("any", "")]
        self.exact = len(tests) == len(keys) == 1 and "value" not in tests[0]  # what has the key matches


_compiled: dict[str, list[tuple[list[Step], list[tuple[str, str]]]]] = {}


def _compile(selector: str) -> list[tuple[list[Step], list[tuple[str, str]]]]:
    """Of each alternative its steps, and the keys that the page must have for it."""
    if selector in _compiled:
        return _compiled[selector]
    groups = []
    for part in selector.split(","):
        steps = []
        for combined in re.findall(r'(\+)?\s*((?:[^\s+\["]|\[[^\]]*\])+)', part.strip()):
            tests = [{k: v for k, v in m.groupdict().items() if v is not None} for m in _TOKEN.finditer(combined[1])]
            steps.append(Step(combined[0] == "+", tests))
        groups.append((steps, [key for step in steps for key in step.keys]))
    _compiled[selector] = groups
    return groups


def _fits(node: Node, step: Step) -> bool:
    for t in step.tests:
        if "tag" in t:
            ok = t["tag"] in ("*", node.tag)
        elif "id" in t:
            ok = node.attrs.get("id") == t["id"]
        elif "cls" in t:
            ok = t["cls"] in node.classes
        elif "nocls" in t:
            ok = t["nocls"] not in node.classes
        elif "attr" in t:
            value = node.attrs.get(t["attr"])
            wanted, op = t.get("value", ""), t.get("op")
            ok = value is not None and (op is None or (op == "=" and value == wanted) or (op == "*=" and wanted in value) or (op == "^=" and value.startswith(wanted)))
        else:
            ok = node.place == (0 if t["place"] == "first-child" else len(node.parent.below) - 1)
        if not ok:
            return False
    return True


def _matches(node: Node, steps: list[Step], last: int) -> bool:
    """Whether node fits step `last` and what stands above or before it fits the steps before."""
    if not _fits(node, steps[last]):
        return False
    if last == 0:
        return True
    if steps[last].adjacent:
        return node.place > 0 and _matches(node.parent.below[node.place - 1], steps, last - 1)
    up = node.parent
    while up is not None and up.tag != "#root":
        if _matches(up, steps, last - 1):
            return True
        up = up.parent
    return False


def json_slice(html: str, key: str, most: int = 500_000) -> str | None:
    """Text of the JSON object or array that follows a quoted key in a script; None if it isn't whole or wrong."""
    found = key in html and re.search(r"""["']?\b""" + re.escape(key) + r"""["']?\s*[:=]\s*(?=[\[{])""", html)
    if not found:
        return None
    text = html[found.end() : found.end() + most]
    try:
        return text[: json.JSONDecoder().raw_decode(text)[1]]
    except ValueError:
        return None


def js_string(page: str, key: str) -> str | None:
    """The quoted text after a key of a script, as in parentItem = "B0..." or "parentItem": "B0..."."""
    found = key in page and re.search(r"""["']?\b""" + re.escape(key) + r"""["']?\s*[:=]\s*(["'])(.*?)\1""", page)
    return found.group(2) if found else None


def json_blob(html: str, key: str, most: int = 500_000):
    text = json_slice(html, key, most)
    return None if text is None else json.loads(text)


def json_ld(root: Node) -> list[dict]:
    """Objects of all application/ld+json scripts, arrays opened; malformed ones are left out."""
    out = []
    for node in root.select('script[type="application/ld+json"]'):
        try:
            value = json.loads(node.script())
        except ValueError:
            continue
        out += [v for v in (value if isinstance(value, list) else [value]) if isinstance(v, dict)]
    return out


def key_values(root: Node, *selectors: str) -> dict[str, str]:
    """Key and value of table rows (th, td) and of list items with a bold label; the first of equal keys holds."""
    out: dict[str, str] = {}
    for selector in selectors:
        for box in root.select(selector):
            for row in box.select("tr"):
                head, cell = row.first_text("th"), row.first_text("td")
                if head and cell:
                    out.setdefault(head.rstrip(" :"), cell)
            for item in box.select("li"):
                label = item.first_text("b", "strong", ".a-text-bold")
                whole = squeeze(item.text())
                if label and whole and whole.startswith(label):
                    if value := whole[len(label) :].strip(" :‎‏"):
                        out.setdefault(label.rstrip(" :‎‏"), value)
    return out
