"""Listing pages and article text, with the standard library's HTML parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

from ..functions.text import NOISE, SPACE_CLASS

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_SPACE = re.compile(SPACE_CLASS + "+")
MIN_MAIN_CHARS = 40


def collapse(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = field(default=None, repr=False)
    children: list = field(default_factory=list, repr=False)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, without: tuple[str, ...] = ()) -> str:
        parts: list[str] = []
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            elif node.tag not in without:
                stack += reversed(node.children)
        return "".join(parts)

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        if self.at.tag in _CLOSES.get(tag, ()):
            self.at = self.at.parent or self.root
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent or self.root
        if node is not self.root:
            self.at = node.parent or self.root

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_STEP = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[#.][\w-]+)*)$")


@dataclass(frozen=True)
class Step:
    tag: str | None
    ids: tuple[str, ...]
    classes: tuple[str, ...]

    def matches(self, node: Node) -> bool:
        return (self.tag is None or node.tag == self.tag) and all(node.attrs.get("id") == i for i in self.ids) and set(self.classes) <= set(node.attrs.get("class", "").split())


def selector(css: str) -> list[Step]:
    """Steps of a selector of tags, #ids, .classes and descent; anything else is an error."""
    steps = []
    for part in css.split():
        m = _STEP.match(part)
        if not m or not part:
            raise ValueError(f"selector not supported: {css!r}")
        marks = re.findall(r"[#.][\w-]+", m[2] or "")
        steps.append(Step(None if m[1] in (None, "*") else m[1].lower(), tuple(x[1:] for x in marks if x[0] == "#"), tuple(x[1:] for x in marks if x[0] == ".")))
    if not steps:
        raise ValueError("empty selector")
    return steps


def find(root: Node, steps: list[Step]) -> list[Node]:
    """Matching nodes in document order."""

    def fits(node: Node) -> bool:
        if not steps[-1].matches(node):
            return False
        rest = list(steps[:-1])
        for up in node.ancestors():
            if rest and rest[-1].matches(up):
                rest.pop()
        return not rest

    return [n for n in root.walk() if fits(n)]


def _date_near(node: Node, date_steps: list[Step], levels: int = 5) -> str | None:
    """The date element's text: the node itself, below it, or below one of its ancestors up to the body."""
    near = [node]
    for up in node.ancestors():
        if up.tag in ("body", "html", "#root") or len(near) > levels:
            break
        near.append(up)
    for where in near:
        hits = [where] if where is node and date_steps[-1].matches(where) else []
        hits += [n for n in find(where, date_steps) if n is not where]
        for hit in hits:
            if text := collapse(hit.text()):
                return text
    return None


def listing(html: str, final_url: str, item_selector: str, date_selector: str | None = None, title_from: str = "text", include: list[str] = (), exclude: list[str] = ()) -> list[dict]:
    """Candidates (ord, url, title, date_text) of a listing page: the selected elements' links, against the final URL,
    http(s) only, filtered by substrings, the first of each URL."""
    root, out, seen = parse(html), [], set()
    steps, dates = selector(item_selector), selector(date_selector) if date_selector else None
    include, exclude = [list(filter(None, include)) if any(include) or not include else None, list(filter(None, exclude))]
    base = next((n.attrs.get("href", "") for n in root.walk() if n.tag == "base"), "")
    for node in find(root, steps):
        anchor = node if node.tag == "a" else next((n for n in node.walk() if n.tag == "a" and n.attrs.get("href")), None)
        if anchor is None or not anchor.attrs.get("href", "").strip():
            continue
        try:
            url = urljoin(urljoin(final_url, base), anchor.attrs["href"].strip())
        except ValueError:
            continue
        if not re.match(r"https?://[^/\s]", url, re.I) or url in seen:
            continue
        if include is None or include and not any(p in url for p in include) or any(p in url for p in exclude):
            continue
        seen.add(url)
        text, attr = collapse(anchor.text()), collapse(anchor.attrs.get("title", "") or anchor.attrs.get("aria-label", ""))
        alt = next((collapse(n.attrs.get("alt", "")) for n in anchor.walk() if n.tag == "img" and n.attrs.get("alt")), "")
        title = (attr or text or alt) if title_from == "attr" else (text or attr or alt)
        out.append({"ord": len(out), "url": url, "title": title, "date_text": _date_near(node, dates) if dates else None})
    return out


def advertised_feeds(html: str, base: str) -> list[str]:
    """Distinct feeds that a page names in its head."""
    found = [urljoin(base, n.attrs["href"]) for n in parse(html).walk() if n.tag == "link" and "alternate" in n.attrs.get("rel", "").lower().split() and re.search("rss|atom|xml", n.attrs.get("type", ""), re.I) and n.attrs.get("href")]
    return list(dict.fromkeys(found))


def _path(node: Node) -> str | None:
    """A selector for a container: its id, or tag and first class, if those can be written in one."""
    if (i := node.attrs.get("id", "")) and re.fullmatch(r"[A-Za-z][\w-]*", i):
        return f"#{i}"
    for c in node.attrs.get("class", "").split():
        if re.fullmatch(r"[A-Za-z][\w-]*", c):
            return f"{node.tag}.{c}"
    return node.tag if node.tag in ("main", "article", "section", "nav", "ul", "ol") else None


def container_links(html: str, base: str) -> Iterator[tuple[int, str, int, str]]:
    """(container, selector, depth, link) of each link, against base, and each container around it that a selector can name.
    Containers are numbered in the page's order."""
    number: dict[int, int] = {}
    around: dict[int, list[tuple[int, str, int]]] = {}
    depth: dict[int, int] = {}
    for node in parse(html).walk():
        up = node.parent
        depth[id(node)] = 0 if up is None else depth[id(up)] + 1
        held = [] if up is None else around[id(up)]
        if (path := _path(node)) is not None:
            number[id(node)] = len(number)
            held = [*held, (number[id(node)], path, depth[id(node)])]
        around[id(node)] = held
        if node.tag == "a" and node.attrs.get("href"):
            try:
                href = urljoin(base, node.attrs["href"])
            except ValueError:
                continue
            for k, path, d in held:
                yield k, path, d, href
