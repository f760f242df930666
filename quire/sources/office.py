"""Word, Excel, PowerPoint and EPUB files into one shape: plain dicts of lists."""

from __future__ import annotations

import posixpath
import re
from xml.etree import ElementTree

from quire.functions.kept import Kept
from quire.sources import htmltree
from quire.sources.archive import BY_SIZE, Archive, ArchiveError


def _xml(text: str) -> ElementTree.Element:
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        text = re.sub(r"<!DOCTYPE[^\[>]*(\[.*?\]\s*)?>", "", text, flags=re.S)
    return ElementTree.fromstring(text)


#: Tags and attributes without their namespaces.
_bare = Kept(lambda tag: tag.rpartition("}")[2], 1024)


def local(e: ElementTree.Element) -> str:
    return _bare[e.tag]


def attr(e: ElementTree.Element, name: str) -> str | None:
    for k, v in e.attrib.items():
        if _bare[k] == name:
            return v
    return None


def child(e: ElementTree.Element, *names: str) -> ElementTree.Element | None:
    for n in names:
        for c in e:
            if _bare[c.tag] == n:
                e = c
                break
        else:
            return None
    return e


def every(e: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [c for c in e.iter() if _bare[c.tag] == name]


CORE = {"title": "title", "creator": "author", "subject": "subject", "keywords": "keywords", "created": "creation_date", "modified": "modification_date"}


def core_metadata(a: Archive) -> dict[str, str]:
    if not a.has("docProps/core.xml"):
        return {}
    found = {local(e): (e.text or "").strip() for e in _xml(a.text("docProps/core.xml"))}
    return {f: found[k] for k, f in CORE.items() if found.get(k)}


def grid(rows: list[list[str]]) -> list[list[dict]]:
    return [[{"text": c, "col_span": 1, "row_span": 1} for c in r] for r in rows]


# --- Word ------------------------------------------------------------------


def _run_text(r: ElementTree.Element) -> str:
    return "".join((c.text or "") if local(c) == "t" else "\t" if local(c) == "tab" else "\n" if local(c) in ("br", "cr") else "" for c in r)


def _paragraph_text(p: ElementTree.Element) -> str:
    """Runs, also in links and insertions; deletions are left out."""
    out = []
    for c in p:
        if local(c) == "r":
            out.append(_run_text(c))
        elif local(c) in ("hyperlink", "ins", "smartTag"):
            out.append(_paragraph_text(c))
    return "".join(out)


def _content(e: ElementTree.Element):
    """Paragraphs and tables of a body, cell or content control, in order."""
    for c in e:
        if local(c) in ("p", "tbl"):
            yield c
        elif local(c) == "sdt" and (inner := child(c, "sdtContent")) is not None:
            yield from _content(inner)


def _table_rows(t: ElementTree.Element) -> list[list[str]]:
    cell = lambda c: "\n".join(x for p in c if local(p) == "p" and (x := _paragraph_text(p)))
    return [[cell(c) for c in r if local(c) == "tc"] for r in t if local(r) == "tr"]


def _all_text(e: ElementTree.Element) -> list[str]:
    out = []
    for c in _content(e):
        if local(c) == "p":
            out.append(_paragraph_text(c))
        else:
            for r in c:
                for cell in r:
                    if local(cell) == "tc":
                        out += _all_text(cell)
    return [t for t in out if t]


def heading_style(style: str | None) -> int | None:
    m = re.fullmatch("heading([1-9])", (style or "").replace(" ", "").lower())
    return int(m[1]) if m else None


def docx(content: bytes) -> dict:
    a = Archive(content, BY_SIZE)
    body = child(_xml(a.text("word/document.xml")), "body")
    blocks: list[dict] = []
    for c in _content(body):
        if local(c) == "tbl":
            blocks.append({"type": "table", "text": "", "rows": grid(_table_rows(c))})
            continue
        if not (text := _paragraph_text(c)):
            continue
        style = child(c, "pPr", "pStyle")
        number = child(c, "pPr", "numPr")
        if style is not None and (level := heading_style(attr(style, "val"))):
            blocks.append({"type": "heading", "text": text, "level": level})
        elif number is not None:
            depth = child(number, "ilvl")
            blocks.append({"type": "list_item", "text": text, "indent_level": int(attr(depth, "val") or 0) if depth is not None else 0})
        else:
            blocks.append({"type": "paragraph", "text": text})
    meta = core_metadata(a)
    if "author" in meta:
        meta["creator"] = meta["author"]
    images = [{"width": 0, "height": 0, "bits": None, "color_space": None, "data": a.read(n), "filters": []} for n in sorted(a.names()) if n.startswith("word/media/")]
    return {"page_count": 1, "text": "\n".join(_all_text(body)), "metadata": meta, "blocks": blocks, "images": images, "bookmarks": []}


# --- Excel -----------------------------------------------------------------


def cell_text(kind: str | None, raw: str | None, strings: list[str]) -> str:
    if raw is None:
        return ""
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return "true" if raw == "1" else "false"
    if kind == "e":
        return f"#ERR:{raw}"
    if kind in ("str", "inlineStr", "d"):
        return raw
    x = float(raw)
    return str(int(x)) if x == int(x) and abs(x) < 2**63 else repr(x)


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def sheets(content: bytes) -> tuple[list[str], list[tuple[str, list[list[str]]]]]:
    """(all names, (name, rows) of those that can be read)."""
    a = Archive(content, BY_SIZE)
    strings = []
    if a.has("xl/sharedStrings.xml"):
        strings = ["".join(t.text or "" for t in every(si, "t")) for si in _xml(a.text("xl/sharedStrings.xml")) if local(si) == "si"]
    rels = {attr(r, "Id"): attr(r, "Target") for r in _xml(a.text("xl/_rels/workbook.xml.rels"))}
    names, out = [], []
    for s in every(_xml(a.text("xl/workbook.xml")), "sheet"):
        names.append(attr(s, "name") or "")
        target = rels.get(attr(s, "id")) or ""
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        try:
            root = _xml(a.text(path))
            cells: dict[tuple[int, int], str] = {}
            for i, r in enumerate(every(root, "row")):
                at = int(attr(r, "r") or i + 1) - 1
                for j, c in enumerate(x for x in r if local(x) == "c"):
                    v, inline = child(c, "v"), child(c, "is")
                    raw = "".join(t.text or "" for t in every(inline, "t")) if inline is not None else v.text if v is not None else None
                    cells[at, _column(attr(c, "r")) if attr(c, "r") else j] = cell_text(attr(c, "t"), raw, strings)
        except (ArchiveError, ElementTree.ParseError, ValueError, IndexError):
            continue
        if cells:
            r0, r1 = min(r for r, _ in cells), max(r for r, _ in cells)
            c0, c1 = min(c for _, c in cells), max(c for _, c in cells)
            out.append((names[-1], [[cells.get((r, c), "") for c in range(c0, c1 + 1)] for r in range(r0, r1 + 1)]))
        else:
            out.append((names[-1], []))
    return names, out


def xlsx(content: bytes) -> dict:
    names, found = sheets(content)
    blocks: list[dict] = []
    for page, (name, rows) in enumerate(found, 1):
        blocks.append({"type": "heading", "text": name, "level": 1, "page": page})
        if rows:
            blocks.append({"type": "table", "text": "", "rows": grid(rows), "page": page})
    text = "\n".join(f"=== Sheet: {n} ===\n" + "".join("\t".join(r) + "\n" for r in rows) for n, rows in found)
    return {"page_count": len(names), "text": text, "metadata": {}, "blocks": blocks, "images": [], "bookmarks": [], "sheets": names}


# --- PowerPoint ------------------------------------------------------------


def _slide(root: ElementTree.Element) -> dict:
    title, blocks, tables = None, [], []
    for shape in root.iter():
        if local(shape) == "graphicFrame":
            for t in every(shape, "tbl"):
                rows = [["".join(x.text or "" for x in every(c, "t")).strip() for c in r if local(c) == "tc"] for r in t if local(r) == "tr"]
                if rows := [r for r in rows if r]:
                    tables.append(rows)
        elif local(shape) == "sp":
            ph = child(shape, "nvSpPr", "nvPr", "ph")
            is_title = ph is not None and attr(ph, "type") in ("title", "ctrTitle")
            body = child(shape, "txBody")
            for p in [] if body is None else [c for c in body if local(c) == "p"]:
                if not (text := "".join(t.text or "" for t in every(p, "t")).strip()):
                    continue
                pr = child(p, "pPr")
                level = int(attr(pr, "lvl") or 0) if pr is not None else 0
                bullet = pr is not None and any(local(c) in ("buChar", "buAutoNum") for c in pr)
                if is_title and title is None:
                    title = text
                blocks.append({"text": text, "title": is_title, "bullet": bullet, "level": level})
    return {"title": title, "blocks": blocks, "tables": tables}


_small_slide = Kept(lambda text: _slide(_xml(text)), 512)


def slide(text: str) -> dict:
    """A slide from its part of the archive. Small ones, which decks of one template share, are kept."""
    if len(text) > 4096:
        return _slide(_xml(text))
    s = _small_slide[text]
    return {"title": s["title"], "blocks": [dict(b) for b in s["blocks"]], "tables": [[list(r) for r in t] for t in s["tables"]]}


def slides(content: bytes) -> list[dict]:
    a = Archive(content)
    paths = [n for n in a.names() if re.fullmatch(r"ppt/slides/slide[0-9]+\.xml", n)]
    out = []
    for i, n in enumerate(sorted(paths, key=lambda n: int(re.search("[0-9]+", n)[0])), 1):
        s = slide(a.text(n))
        notes = f"ppt/notesSlides/notesSlide{i}.xml"
        s["notes"] = None
        if a.has(notes):
            s["notes"] = "\n".join(x for p in every(_xml(a.text(notes)), "p") if (x := "".join(t.text or "" for t in every(p, "t")).strip())) or None
        out.append(s | {"index": i})
    return out


def pptx(content: bytes) -> dict:
    blocks, parts, marks = [], [], []
    found = slides(content)
    for s in found:
        page = s["index"]
        said = [f"--- Slide {page} ---"]
        if s["title"]:
            blocks.append({"type": "heading", "text": s["title"], "level": 1, "page": page})
            marks.append({"title": s["title"], "page": page, "level": 1})
            said.append(s["title"])
        for b in s["blocks"]:
            if not b["title"]:
                said.append(b["text"])
                blocks.append({"type": "list_item", "text": b["text"], "indent_level": b["level"], "page": page} if b["bullet"] else {"type": "paragraph", "text": b["text"], "page": page})
        blocks += [{"type": "table", "text": "", "rows": grid(t), "page": page} for t in s["tables"]]
        parts.append("\n".join(said) + "\n" + (f"\nNotes:\n{s['notes']}\n" if s["notes"] else ""))
    meta = core_metadata(Archive(content))
    meta.pop("keywords", None)
    return {"page_count": len(found), "text": "\n\n".join(parts), "metadata": meta, "blocks": blocks, "images": [], "bookmarks": marks, "notes": [s["notes"] for s in found]}


# --- EPUB ------------------------------------------------------------------


def ncx(xml: str) -> list[dict]:
    """(title, href, level) of a table of contents, from the top down."""
    out: list[dict] = []

    def walk(e: ElementTree.Element, level: int) -> None:
        for p in e:
            if local(p) == "navPoint":
                label, src = child(p, "navLabel", "text"), child(p, "content")
                out.append({"title": (label.text or "").strip() if label is not None else "", "href": (attr(src, "src") or "") if src is not None else "", "level": level})
                walk(p, level + 1)

    top = child(_xml(xml), "navMap")
    if top is not None:
        walk(top, 0)
    return out


def nav(html: str) -> list[dict]:
    navs = [n for n in htmltree.parse(html).walk() if n.tag == "nav"]
    own = next((n for n in navs if n.attrs.get("epub:type") == "toc"), navs[0] if navs else None)
    top = next((n for n in own.walk() if n.tag == "ol"), None) if own else None
    out: list[dict] = []

    def walk(ol: htmltree.Node, level: int) -> None:
        for li in ol.elements():
            if li.tag == "li":
                a = next((k for k in li.elements() if k.tag == "a"), None)
                if a is not None:
                    out.append({"title": a.text().strip(), "href": a.attrs.get("href", ""), "level": level})
                for k in li.elements():
                    if k.tag == "ol":
                        walk(k, level + 1)

    if top is not None:
        walk(top, 0)
    return out


def _toc(a: Archive, items: dict[str, str], base: str) -> list[dict]:
    for kind, fits in ((ncx, lambda i, h: i == "ncx" or h.endswith(".ncx")), (nav, lambda i, h: "nav" in h and h.endswith((".xhtml", ".html")))):
        for i, h in items.items():
            if fits(i, h):
                try:
                    if found := kind(a.text(base + h)):
                        return found
                except (ArchiveError, ElementTree.ParseError):
                    continue
    return []


def epub(content: bytes) -> dict:
    a = Archive(content)
    rootfile = next((attr(r, "full-path") for r in every(_xml(a.text("META-INF/container.xml")), "rootfile") if attr(r, "full-path")), None)
    if rootfile is None:
        raise ArchiveError("missing_entry", "no rootfile is named")
    base = rootfile.rpartition("/")[0]
    base = f"{base}/" if base else ""
    opf = _xml(a.text(rootfile))
    meta_e, manifest, spine = child(opf, "metadata"), child(opf, "manifest"), child(opf, "spine")
    raw = {local(e): (e.text or "").strip() for e in (meta_e if meta_e is not None else []) if (e.text or "").strip()}
    meta = {f: v for f, v in (("title", raw.get("title")), ("author", raw.get("creator")), ("subject", raw.get("subject") or raw.get("description")), ("creator", raw.get("publisher")), ("creation_date", raw.get("date"))) if v}
    items = {attr(i, "id"): attr(i, "href") for i in (manifest if manifest is not None else []) if attr(i, "id") and attr(i, "href")}
    order = [attr(i, "idref") for i in (spine if spine is not None else []) if local(i) == "itemref"]
    contents = _toc(a, items, base)
    titles = lambda h: next((t["title"] for t in contents if t["href"].partition("#")[0].endswith(h.partition("#")[0])), None)
    blocks, parts, chapters, images = [], [], [], []
    for idx, ref in enumerate(order):
        if ref not in items or not a.has(base + items[ref]):
            continue
        root = htmltree.parse(a.text(base + items[ref]))
        title = titles(items[ref])
        chapters.append({"index": idx, "title": title, "href": items[ref]})
        blocks += [b | {"page": idx + 1} for b in htmltree.blocks_of(root)]
        images += htmltree.images_of(root)
        text = htmltree.text_of(root)
        if text.strip():
            parts.append(f"--- {title} ---\n{text}" if title else text)
    held = [{"width": 0, "height": 0, "bits": None, "color_space": None, "data": a.read(base + h), "filters": [h]} for h in items.values() if h.lower().endswith((".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".bmp")) and a.has(base + h)]
    by_href = {c["href"]: c["index"] + 1 for c in chapters}
    marks = [{"title": t["title"], "page": by_href.get(t["href"].partition("#")[0], 1), "level": t["level"] + 1} for t in contents]
    return {"page_count": len(chapters), "text": "\n\n".join(parts), "metadata": meta, "blocks": blocks, "images": held + [i for i in images if i["data"]], "bookmarks": marks, "chapters": chapters}
