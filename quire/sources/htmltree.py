"""A small HTML tree: void elements, implied ends, and raw text as browsers have them; no foster parents."""

from __future__ import annotations

import base64
import binascii
import re
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set("p div h1 h2 h3 h4 h5 h6 li tr blockquote pre article section header footer nav aside main figure figcaption details summary dt dd".split())
SKIP = {"script", "style", "noscript", "svg"}
#: What a new element ends if it is open, up to the element that bounds the search.
_ENDS_P = BLOCK - {"li", "tr", "dt", "dd"} | {"ul", "ol", "dl", "table", "form", "hr", "address", "center", "menu"} | {"li", "dt", "dd"}
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"})}
_P_BOUNDS = {"table", "td", "th", "button", "caption", "object"}
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "s", "small", "strike", "strong", "tt", "u"}


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: "Node | None"):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up

    def elements(self):
        return [k for k in self.kids if isinstance(k, Node)]

    def walk(self):
        """All elements below, in document order."""
        todo = self.elements()[::-1]
        while todo:
            n = todo.pop()
            yield n
            todo += n.elements()[::-1]

    def text(self) -> str:
        out, todo = [], self.kids[::-1]
        while todo:
            k = todo.pop()
            if isinstance(k, str):
                out.append(k)
            else:
                todo += k.kids[::-1]
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def _end(self, tags: set[str], bounds: set[str]) -> None:
        n = self.at
        last = None
        while n.up is not None and n.tag not in bounds:
            if n.tag in tags:
                last = n
            n = n.up
        if last is not None:
            self.at = last.up

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._reopen(lambda: self._end({"p"}, _P_BOUNDS))
        if tag in _ENDS:
            self._end(*_ENDS[tag])
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(n)
        if tag not in VOID:
            self.at = n

    def _reopen(self, end) -> None:
        """Ends a paragraph; formatting that was open in it goes on after it."""
        before = self.at
        end()
        if before is self.at:
            return
        held, n = [], before
        while n is not self.at:
            if n.tag in FORMATTING:
                held.append(n)
            n = n.up
        for f in reversed(held):
            n = Node(f.tag, dict(f.attrs), self.at)
            self.at.kids.append(n)
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        n = self.at
        while n.up is not None and n.tag != tag:
            if tag in FORMATTING and n.tag in BLOCK and n.tag != "p":
                return
            n = n.up
        if n.up is not None:
            self.at = n.up

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def is_fragment(html: str) -> bool:
    return "<html" not in html.lower()


def text_of(root: Node) -> str:
    """The visible text: block elements on lines of their own, at most one blank line in a row. The title counts."""
    parts: list[str] = []
    todo: list = [root]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            if t := n.strip():
                parts += [t, " "]
        elif isinstance(n, tuple):
            parts.append("\n")
        elif n.tag == "br":
            parts.append("\n")
        elif n.tag not in SKIP:
            if n.tag in BLOCK:
                parts.append("\n")
                todo.append(())
            todo += n.kids[::-1]
    lines = [x.strip() for x in "".join(parts).split("\n")]
    out: list[str] = []
    for x in lines:
        if x or (out and out[-1]):
            out.append(x)
    return "\n".join(out).strip()


def _item_text(li: Node) -> str:
    parts = [k.strip() if isinstance(k, str) else k.text().strip() for k in li.kids if isinstance(k, str) or k.tag not in ("ul", "ol")]
    return " ".join(p for p in parts if p)


def _items(lst: Node, depth: int, out: list) -> None:
    for li in lst.elements():
        if li.tag == "li":
            if t := _item_text(li):
                out.append({"type": "list_item", "text": t, "indent_level": depth})
            for k in li.elements():
                if k.tag in ("ul", "ol"):
                    _items(k, depth + 1, out)


def _int(s: str | None, default: int) -> int:
    return int(s) if s and re.fullmatch(r"\+?[0-9]{1,9}", s) else default


def table_of(t: Node) -> list[list[dict]]:
    """Rows of cells; what nested tables hold is in them too."""
    return [[{"text": c.text().strip(), "col_span": _int(c.attrs.get("colspan"), 1), "row_span": _int(c.attrs.get("rowspan"), 1)} for c in r.walk() if c.tag in ("td", "th")] for r in t.walk() if r.tag == "tr"]


def tables_of(root: Node) -> list[list[list[dict]]]:
    return [rows for n in root.walk() if n.tag == "table" and (rows := table_of(n))]


def blocks_of(root: Node) -> list[dict]:
    """Headings, paragraphs, list items and tables in order; text outside of them is left out."""
    out: list[dict] = []

    def visit(node: Node) -> None:
        for n in node.elements():
            if n.tag in SKIP:
                continue
            if re.fullmatch("h[1-6]", n.tag):
                if t := n.text().strip():
                    out.append({"type": "heading", "text": t, "level": int(n.tag[1])})
            elif n.tag in ("p", "blockquote"):
                if t := n.text().strip():
                    out.append({"type": "paragraph", "text": t})
            elif n.tag in ("ul", "ol"):
                _items(n, 0, out)
            elif n.tag == "table":
                if rows := table_of(n):
                    out.append({"type": "table", "text": "", "rows": rows})
            else:
                visit(n)

    visit(root)
    return out


META = {"author": "author", "dc.creator": "author", "description": "subject", "dc.description": "subject", "keywords": "keywords", "generator": "creator", "dcterms.created": "creation_date", "dc.date": "creation_date", "dcterms.modified": "modification_date"}


def metadata_of(root: Node) -> dict[str, str]:
    """The first title, and the last non-empty of each kind of named meta element."""
    out: dict[str, str] = {}
    titles = [n for n in root.walk() if n.tag == "title"]
    if titles and (t := titles[0].text().strip()):
        out["title"] = t
    for n in root.walk():
        if n.tag == "meta" and (field := META.get(n.attrs.get("name", "").lower())) and (c := n.attrs.get("content", "").strip()):
            out[field] = c
    return out


def data_uri(src: str) -> tuple[str, bytes] | None:
    """(colour space, bytes) of a base64 data URI; RGB for PNG and JPEG, else the MIME type."""
    if not src.startswith("data:") or ";base64," not in src:
        return None
    mime, _, body = src[5:].partition(";base64,")
    try:
        raw = base64.b64decode(body.strip(), validate=True)
    except (binascii.Error, ValueError):
        return None
    return ("RGB" if any(k in mime for k in ("png", "jpeg", "jpg")) else mime), raw


def images_of(root: Node) -> list[dict]:
    """Images with their bytes, or with their address in filters where they lie elsewhere."""
    out = []
    for n in root.walk():
        if n.tag == "img" and (src := n.attrs.get("src", "")):
            size = {"width": _int(n.attrs.get("width"), 0), "height": _int(n.attrs.get("height"), 0), "bits": 8}
            found = data_uri(src)
            out.append(size | ({"color_space": found[0], "data": found[1], "filters": []} if found else {"color_space": None, "data": b"", "filters": [src]}))
    return out


def links_of(root: Node) -> list[dict]:
    return [{"type": "link", "uri": n.attrs["href"], "text": n.text().strip()} for n in root.walk() if n.tag == "a" and n.attrs.get("href")]
