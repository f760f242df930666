"""Edits of PDF files that keep what they don't touch: objects are copied as they are, with all they refer to."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from math import cos, radians, sin

from quire.functions.kept import Kept
from quire.sources import crypt
from quire.sources.pdf import INFO, Name, Op, Pdf, PdfError, Ref, Stream, operations, spans_and_lines

INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")
#: Kinds of actions by what sanitize() calls them.
ACTIONS = {"JavaScript": "javascript", "Launch": "action", "SubmitForm": "action", "ImportData": "action", "URI": "link", "GoToR": "link"}


def text_string(s: str) -> bytes:
    try:
        return s.encode("ascii")
    except UnicodeEncodeError:
        return b"\xfe\xff" + s.encode("utf-16-be")


#: Names in PDF syntax.
_name = Kept(lambda v: b"/" + re.sub(rb"[^!-~]|[#()<>\[\]{}/%]", lambda m: b"#%02x" % m[0][0], v.encode("latin-1")), 4096)


def dump(v, seal=None) -> bytes:
    """PDF syntax of a value; seal encrypts its strings."""
    if isinstance(v, Op):
        return v.encode("latin-1")
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if v is None:
        return b"null"
    if isinstance(v, str):
        return _name[str(v)]
    if isinstance(v, bytes):
        return b"<" + (v if seal is None else seal(v)).hex().encode() + b">"
    if isinstance(v, int):
        return b"%d" % v
    if isinstance(v, float):
        return (b"%.6f" % v).rstrip(b"0").rstrip(b".") or b"0"
    if isinstance(v, Ref):
        return b"%d %d R" % v
    if isinstance(v, dict):
        return b"<< " + b" ".join(_name[str(k)] + b" " + dump(x, seal) for k, x in v.items()) + b" >>"
    return b"[" + b" ".join(dump(x, seal) for x in v) + b"]"


class Out:
    """The objects of a new file. A stream like one that is there already is not put in again."""

    def __init__(self):
        self.objects: list = []
        self.known: dict[tuple[int, int], Ref | None] = {}
        self.streams: dict[bytes, Ref] = {}
        self.todo: list[tuple[Pdf, int, Ref]] = []

    def new(self, value=None) -> Ref:
        if isinstance(value, Stream):
            info = {k: v for k, v in value.info.items() if k != "Length"}
            h = hashlib.sha256(dump(info) + value.raw).digest()
            if h in self.streams:
                return self.streams[h]
            value = Stream(info, value.raw)
            self.streams[h] = Ref((len(self.objects) + 1, 0))
        self.objects.append(value)
        return Ref((len(self.objects), 0))

    def copy(self, pdf: Pdf, v):
        """A value of a file with its references as they are in the new one."""
        if isinstance(v, Ref):
            key = (id(pdf), v[0])
            if key not in self.known:
                o = pdf.object(v[0])
                if isinstance(o, Stream):  # its parts first, so that equal ones are found
                    self.known[key] = None
                    self.known[key] = self.new(Stream(self.copy(pdf, {k: x for k, x in o.info.items() if k != "Length"}), o.raw))
                elif o is None:
                    self.known[key] = None
                else:
                    self.known[key] = self.new()
                    self.todo.append((pdf, v[0], self.known[key]))
            return self.known[key]
        if isinstance(v, dict):
            return {k: self.copy(pdf, x) for k, x in v.items()}
        if isinstance(v, list):
            return [self.copy(pdf, x) for x in v]
        return v

    def finish(self) -> None:
        while self.todo:
            pdf, num, at = self.todo.pop()
            self.objects[at[0] - 1] = self.copy(pdf, pdf.object(num))

    def file(self, root: Ref, info: Ref | None = None, encrypt: dict | None = None) -> bytes:
        self.finish()
        key, aes, extra = None, False, b""
        if encrypt is not None:
            key, aes, entry, file_id = sealed(encrypt)
            extra = b" /Encrypt %d 0 R /ID [<%s> <%s>]" % (self.new(entry)[0], file_id.hex().encode(), file_id.hex().encode())
        last = len(self.objects) if encrypt is not None else None
        out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
        for i, o in enumerate(self.objects, 1):
            places.append(len(out))
            seal = None if key is None or i == last else lambda b, i=i: crypt.seal(key, i, b, aes)
            if isinstance(o, Stream):
                raw = o.raw if seal is None else seal(o.raw)
                body = dump(o.info | {"Length": len(raw)}, seal) + b"\nstream\n" + raw + b"\nendstream"
            else:
                body = dump(o, seal)
            out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % at for at in places)
        named = b" /Info %d 0 R" % info[0] if info else b""
        return bytes(out + b"trailer\n<< /Size %d /Root %d 0 R%s%s >>\nstartxref\n%d\n%%%%EOF\n" % (len(places) + 1, root[0], named, extra, start))


def sealed(encrypt: dict) -> tuple[bytes, bool, dict, bytes]:
    """(key, whether by AES, the encryption entry, the file's id) of {user, owner, algorithm, permissions}."""
    how, p = encrypt.get("algorithm", "aes128"), int(encrypt.get("permissions", -4))
    user, owner, file_id = str(encrypt.get("user") or ""), str(encrypt.get("owner") or ""), os.urandom(16)
    std = lambda method, n: {"CF": {"StdCF": {"CFM": Name(method), "AuthEvent": Name("DocOpen"), "Length": n}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    entry: dict = {"Filter": Name("Standard"), "P": p}
    if how == "aes256":
        key, found = crypt.entries_256(user.encode(), (owner or user).encode(), p)
        return key, True, entry | {"V": 5, "R": 6, "Length": 256} | std("AESV3", 32) | found, file_id
    if how not in ("aes128", "rc4"):
        raise PdfError("unsupported_encryption", how)
    revision = 4 if how == "aes128" else 3
    u, o = (x.encode("cp1252", "replace") for x in (user, owner))
    own = crypt.owner_entry(o, u, revision, 16)
    key = crypt.file_key(u, own, p, file_id, revision, 16)
    entry |= {"R": revision, "Length": 128, "O": own, "U": crypt.user_entry(key, file_id, revision)}
    return key, revision == 4, entry | ({"V": 4} | std("AESV2", 16) if revision == 4 else {"V": 2}), file_id


def page_refs(pdf: Pdf) -> list[tuple[Ref | None, dict]]:
    """Each page with its reference."""
    if (held := getattr(pdf, "page_list", None)) is not None:
        return held
    root = pdf.get(pdf.trailer, "Root")
    out, todo, seen = [], [root.get("Pages") if isinstance(root, dict) else None], set()
    while todo:
        r = todo.pop()
        if isinstance(r, Ref):
            if r in seen:
                continue
            seen.add(r)
        node = pdf.resolve(r)
        if isinstance(node, dict):
            kids = pdf.get(node, "Kids")
            if isinstance(kids, list):
                todo += kids[::-1]
            else:
                out.append((r if isinstance(r, Ref) else None, node))
    pdf.page_list = out
    return out


@dataclass
class Page:
    """A page of a new file: one of a file (from 1), or a blank one of a size; and what is done to it."""

    pdf: Pdf | None = None
    number: int = 0
    size: tuple[float, float] = (612.0, 792.0)
    rotate: int = 0
    content: bytes | None = None
    over: list[bytes] = field(default_factory=list)
    under: list[bytes] = field(default_factory=list)
    resources: dict = field(default_factory=dict)
    changes: dict = field(default_factory=dict)


def pages_of(pdf: Pdf) -> list[Page]:
    return [Page(pdf, i) for i in range(1, len(page_refs(pdf)) + 1)]


def assemble(pages: list[Page], out: Out | None = None, meta: dict[str, str] | None = None, catalog: dict | Callable[[], dict] | None = None, outline: list[dict] | None = None, encrypt: dict | None = None, keep: bool = True) -> bytes:
    """A file of the pages. The first file's catalog entries come along if keep, with the fields of all
    files' forms; catalog replaces entries (None takes one off; a function is called once pages have their
    places), meta the information, outline the
    bookmarks. Links to pages that aren't in the new file lead nowhere."""
    out = out or Out()
    if not pages:
        raise PdfError("malformed", "no pages are left")
    files = list({id(p.pdf): p.pdf for p in pages if p.pdf is not None}.values())
    refs = {id(f): page_refs(f) for f in files}
    for f in files:
        for r, _ in refs[id(f)]:
            if r is not None:
                out.known[id(f), r[0]] = None
    root, tree = out.new(), out.new()
    kids = []
    for p in pages:
        at = out.new()
        kids.append(at)
        if p.pdf is not None and (r := refs[id(p.pdf)][p.number - 1][0]) is not None and out.known.get((id(p.pdf), r[0])) is None:
            out.known[id(p.pdf), r[0]] = at
    for p, at in zip(pages, kids):
        out.objects[at[0] - 1] = _page(out, p, refs, tree)
    out.objects[tree[0] - 1] = {"Type": Name("Pages"), "Count": len(kids), "Kids": kids}
    top: dict = {}
    if keep and files:
        old = files[0].get(files[0].trailer, "Root")
        top = {k: out.copy(files[0], v) for k, v in old.items() if k not in ("Type", "Pages", *(("Outlines",) if outline is not None else ()))}
        forms = [(f, f.get(f.get(f.trailer, "Root"), "AcroForm")) for f in files]
        forms = [(f, x) for f, x in forms if isinstance(x, dict)]
        if forms and len(files) > 1:
            top["AcroForm"] = out.copy(forms[0][0], {k: v for k, v in forms[0][1].items() if k != "Fields"}) | {"Fields": [out.copy(f, x) for f, form in forms for x in f.get(form, "Fields") or []]}
    top |= (catalog() if callable(catalog) else catalog) or {}
    if outline:
        top["Outlines"] = _outline(out, outline, kids)
    out.objects[root[0] - 1] = {"Type": Name("Catalog"), "Pages": tree} | {k: v for k, v in top.items() if v is not None}
    known = {f: k for k, f in INFO.items()}
    if meta is None and files:
        old = files[0].get(files[0].trailer, "Info")
        info = out.new(out.copy(files[0], old)) if isinstance(old, dict) else None
    else:
        info = out.new({known[f]: text_string(v) for f, v in (meta or {}).items() if f in known and v})
    return out.file(root, info, encrypt)


def _page(out: Out, p: Page, refs: dict, tree: Ref) -> dict:
    if p.pdf is None:
        return {"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, *p.size], "Resources": {}} | ({"Rotate": p.rotate % 360} if p.rotate else {})
    old = refs[id(p.pdf)][p.number - 1][1]
    page = {k: out.copy(p.pdf, v) for k, v in (old | p.changes).items() if k not in ("Parent", "Contents") and v is not None}
    for k in INHERITED:
        if k not in page and (v := p.pdf.inherited(old, k)) is not None:
            page[k] = out.copy(p.pdf, v)
    if p.rotate:
        page["Rotate"] = (int(p.pdf.inherited(old, "Rotate") or 0) + p.rotate) % 360
    if p.resources:
        own = p.pdf.inherited(old, "Resources") or {}
        merged = {k: out.copy(p.pdf, v) for k, v in own.items()}
        for kind, entries in p.resources.items():
            merged[kind] = {k: out.copy(p.pdf, v) for k, v in (p.pdf.get(own, kind) or {}).items()} | entries
        page["Resources"] = merged
    packed = lambda b: out.new(Stream({"Filter": Name("FlateDecode")}, zlib.compress(b)))
    if p.content is not None:
        body = [packed(p.content)]
    else:
        held = p.pdf.resolve(old.get("Contents"))
        body = [out.copy(p.pdf, x) for x in held] if isinstance(held, list) else [out.copy(p.pdf, old["Contents"])] if "Contents" in old else []
    if p.over or p.under:
        body = [*map(packed, p.under), packed(b"q"), *body, packed(b"Q"), *map(packed, p.over)]
    return page | {"Parent": tree, "Contents": body}


def _outline(out: Out, items: list[dict], kids: list[Ref]) -> Ref:
    """Bookmarks (title, page, level); one that skips levels is under the last there is."""
    root = out.new()
    nodes: list[dict] = []
    stack: list[tuple[int, Ref, list[Ref]]] = [(0, root, [])]
    groups: list[tuple[Ref, list[Ref]]] = [(root, stack[0][2])]
    for it in items:
        while stack[-1][0] >= max(1, it.get("level") or 1):
            stack.pop()
        at = out.new()
        page = min(max(it.get("page") or 1, 1), len(kids))
        nodes.append({"Title": text_string(it["title"] or ""), "Parent": stack[-1][1], "Dest": [kids[page - 1], Name("Fit")]})
        out.objects[at[0] - 1] = nodes[-1]
        stack[-1][2].append(at)
        stack.append((max(1, it.get("level") or 1), at, []))
        groups.append((at, stack[-1][2]))
    out.objects[root[0] - 1] = {"Type": Name("Outlines")}
    for at, own in groups:
        for a, b in zip(own, own[1:]):
            out.objects[a[0] - 1]["Next"], out.objects[b[0] - 1]["Prev"] = b, a
        if own:
            out.objects[at[0] - 1] |= {"First": own[0], "Last": own[-1], "Count": len(own)}
    return root


# --- edits ------------------------------------------------------------------


def merge(contents: list[bytes]) -> bytes:
    return assemble([p for c in contents for p in pages_of(Pdf(c))])


def select(content: bytes, numbers: list[int]) -> bytes:
    """The pages named, in this order; for splitting, reordering and deleting."""
    pdf = Pdf(content)
    n = len(page_refs(pdf))
    if bad := [k for k in numbers if not 1 <= k <= n]:
        raise PdfError("malformed", f"there is no page {bad[0]}")
    return assemble([Page(pdf, k) for k in numbers])


def insert_blank(content: bytes, after: list[int], size: tuple[float, float] = (612.0, 792.0)) -> bytes:
    """Blank pages after the pages named; 0 is before the first."""
    pages = pages_of(Pdf(content))
    out = [Page(size=size) for k in after if k == 0]
    for p in pages:
        out += [p, *(Page(size=size) for k in after if k == p.number)]
    return assemble(out)


def rotate(content: bytes, degrees: int, on: list[int] | None = None) -> bytes:
    if degrees % 90:
        raise PdfError("malformed", "rotation goes by 90 degrees")
    pages = pages_of(Pdf(content))
    for p in pages:
        p.rotate = degrees if on is None or p.number in on else 0
    return assemble(pages)


FONT = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}


def place(width: float, height: float, text: str, size: float, angle: float, position: str, margin: float = 50.0) -> tuple[float, float]:
    """As mutate.watermark_place() has it for columns."""
    wide = len(text.encode()) * size * 0.5
    if position == "center":
        return width / 2 - wide * cos(radians(angle)) / 2, height / 2 - wide * sin(radians(angle)) / 2
    if position not in ("top_left", "top_right", "bottom_left", "bottom_right"):
        raise PdfError("malformed", f"not a position: {position}")
    end, side = position.split("_")
    return margin if side == "left" else width - margin - wide, height - margin - size if end == "top" else margin


def watermark(content: bytes, text: str, on: list[int] | None = None, size: float = 60.0, angle: float = 45.0, opacity: float = 0.3, position: str = "center", over: bool = True, color: tuple[float, float, float] = (0.5, 0.5, 0.5)) -> bytes:
    pages = pages_of(pdf := Pdf(content))
    for p in pages:
        if on is None or p.number in on:
            box = pdf.box(page_refs(pdf)[p.number - 1][1])
            x, y = place(box[2] - box[0], box[3] - box[1], text, size, angle, position)
            turn = (cos(radians(angle)), sin(radians(angle)), -sin(radians(angle)), cos(radians(angle)), x + box[0], y + box[1])
            drawn = b"q /QuireG gs %s rg BT /QuireF %s Tf %s Tm %s Tj ET Q" % (b" ".join(dump(float(c)) for c in color), dump(float(size)), b" ".join(dump(float(v)) for v in turn), dump(text.encode("cp1252", "replace")))
            (p.over if over else p.under).append(drawn)
            p.resources = {"Font": {"QuireF": FONT}, "ExtGState": {"QuireG": {"ca": float(opacity), "CA": float(opacity)}}}
    return assemble(pages)


def stamp(content: bytes, overlay: bytes, page: int = 1, on: list[int] | None = None, x: float = 0.0, y: float = 0.0, scale: float = 1.0, opacity: float = 1.0, over: bool = True) -> bytes:
    """A page of another file drawn on the pages."""
    pages, other, out = pages_of(Pdf(content)), Pdf(overlay), Out()
    node = page_refs(other)[page - 1][1]
    form = out.new(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": other.box(node), "Resources": out.copy(other, other.inherited(node, "Resources") or {}), "Filter": Name("FlateDecode")}, zlib.compress(other.content(node))))
    for p in pages:
        if on is None or p.number in on:
            (p.over if over else p.under).append(b"q /QuireG gs %s 0 0 %s %s %s cm /QuireX Do Q" % tuple(dump(float(v)) for v in (scale, scale, x, y)))
            p.resources = {"XObject": {"QuireX": form}, "ExtGState": {"QuireG": {"ca": float(opacity), "CA": float(opacity)}}}
    return assemble(pages, out)


def redact(content: bytes, pattern: str, regex: bool = False, case_sensitive: bool = False) -> tuple[bytes, int]:
    """(the file without the spans that hold the pattern and what they overlap, how many went).

    Text is taken out of the page's own content; what follows stays in its place. Text inside of form
    objects isn't looked at.
    """
    hit = re.compile(pattern if regex else re.escape(pattern), 0 if case_sensitive else re.I)
    pages, gone_in_all = pages_of(pdf := Pdf(content)), 0
    for p in pages:
        node = page_refs(pdf)[p.number - 1][1]
        spans = spans_and_lines(pdf, node)[0]
        boxes = [(s["x"], s["y"] - 0.3 * s["font_size"], s["x"] + s["width"], s["y"] + 0.8 * s["font_size"]) for s in spans]
        hits = [b for s, b in zip(spans, boxes) if hit.search(s["text"])]
        gone = {i for i, a in enumerate(boxes) if hit.search(spans[i]["text"]) or any(a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3] for b in hits)}
        if gone:
            p.content = _without(pdf, node, spans, gone)
            gone_in_all += len(gone)
    return assemble(pages), gone_in_all


def _without(pdf: Pdf, node: dict, spans: list[dict], gone: set[int]) -> bytes:
    from quire.sources.pdf import Font

    fonts = {k: Font(pdf, f) for k, v in (pdf.get(pdf.inherited(node, "Resources") or {}, "Font") or {}).items() if isinstance(f := pdf.resolve(v), dict)}
    out, font, at, stack = [], None, 0, []

    def kept(raw):
        """A string, or in its place the step to where it would have ended."""
        nonlocal at
        if not isinstance(raw, bytes) or not (font.decode(raw)[0] if font else raw):
            return raw
        at += 1
        return -1000.0 * spans[at - 1]["step"] if at - 1 in gone else raw

    for op, a in operations(pdf.content(node), images=True):
        if op == "BI":
            out.append(a[0])
            continue
        if op == "Tf" and len(a) > 1:
            font = fonts.get(a[-2])
        elif op == "q":
            stack.append(font)
        elif op == "Q" and stack:
            font = stack.pop()
        if op in ("Tj", "'", '"') and a:
            if isinstance(new := kept(a[-1]), float):
                if op != "Tj":
                    if op == '"' and len(a) > 2:
                        out += [dump(a[-3]) + b" Tw", dump(a[-2]) + b" Tc"]
                    out.append(b"T*")
                out.append(dump([new]) + b" TJ")
                continue
        elif op == "TJ" and a and isinstance(a[-1], list):
            a = [*a[:-1], [kept(x) if isinstance(x, bytes) else x for x in a[-1]]]
        out.append(b" ".join([*map(dump, a), op.encode("latin-1")]))
    return b"\n".join(out)


def sanitize(content: bytes, javascript: bool = True, embedded: bool = True, actions: bool = True, links: bool = True) -> tuple[bytes, list[str]]:
    """(the file without what acts, the category of each thing removed)."""
    on = {"javascript": javascript, "action": actions, "link": links}
    pdf, removed = Pdf(content), []
    root = pdf.get(pdf.trailer, "Root")
    catalog: dict = {}

    def bad(action) -> bool:
        action = pdf.resolve(action)
        kind = ACTIONS.get(pdf.get(action, "S")) if isinstance(action, dict) else None
        if kind and on[kind]:
            removed.append(kind)
            return True
        return False

    if "OpenAction" in root and bad(root["OpenAction"]):
        catalog["OpenAction"] = None
    if "AA" in root and actions:
        removed.append("action")
        catalog["AA"] = None
    names = pdf.get(root, "Names")
    if isinstance(names, dict):
        left = dict(names)
        for k, name, wanted in (("JavaScript", "javascript", javascript), ("EmbeddedFiles", "embedded_file", embedded)):
            if k in left and wanted:
                left.pop(k)
                removed.append(name)
        if len(left) < len(names):
            catalog["Names"] = left or None
    pages = pages_of(pdf)
    out = Out()
    for p in pages:
        node = page_refs(pdf)[p.number - 1][1]
        if "AA" in node and actions:
            removed.append("action")
            p.changes["AA"] = None
        notes = pdf.get(node, "Annots") or []
        keep = []
        for r in notes:
            a = pdf.resolve(r)
            if not isinstance(a, dict) or "A" in a and bad(a["A"]):
                continue
            if embedded and pdf.get(a, "Subtype") == "FileAttachment":
                removed.append("embedded_file")
                continue
            keep.append(r)
        if len(keep) < len(notes):
            p.changes["Annots"] = keep
    if isinstance(catalog.get("Names"), dict):
        catalog["Names"] = out.copy(pdf, catalog["Names"])
    return assemble(pages, out, catalog=catalog), removed


def optimize(content: bytes, strip_metadata: bool = False) -> bytes:
    """The file without unused objects and repeated streams, plain streams packed."""
    pdf = Pdf(content)
    for num in list(pdf.places):
        o = pdf.object(num)
        if isinstance(o, Stream) and "Filter" not in o.info and len(small := zlib.compress(o.raw, 9)) < len(o.raw):
            pdf.cache[num] = Stream(o.info | {"Filter": Name("FlateDecode")}, small)
    return assemble(pages_of(pdf), meta={} if strip_metadata else None, catalog={"Metadata": None} if strip_metadata else None)


def set_metadata(content: bytes, updates: dict[str, str | None]) -> bytes:
    """Sets fields, or clears those that are null."""
    pdf = Pdf(content)
    from quire.sources.pdf import pdf_text

    info = pdf.get(pdf.trailer, "Info") or {}
    old = {f: t for k, f in INFO.items() if (t := pdf_text(pdf.get(info, k)))}
    return assemble(pages_of(pdf), meta=old | updates)


def set_bookmarks(content: bytes, items: list[dict]) -> bytes:
    return assemble(pages_of(Pdf(content)), outline=items, catalog={"Outlines": None})


def encrypt(content: bytes, user: str, owner: str | None = None, algorithm: str = "aes128", permissions: int = -4) -> bytes:
    return assemble(pages_of(Pdf(content)), encrypt={"user": user, "owner": owner or user, "algorithm": algorithm, "permissions": permissions})


def annotate(content: bytes, new: list[dict], remove: list[str] | None = None) -> bytes:
    """New annotations {page, type, rect, contents, uri, color}; those of the types in remove go first."""
    pages = pages_of(pdf := Pdf(content))
    kinds = {"link": "Link", "text": "Text", "free_text": "FreeText", "highlight": "Highlight", "underline": "Underline", "strike_out": "StrikeOut", "square": "Square", "circle": "Circle", "line": "Line", "stamp": "Stamp"}
    gone = {t.lower().replace("_", "") for t in remove or []}
    for p in pages:
        node = page_refs(pdf)[p.number - 1][1]
        keep = [r for r in pdf.get(node, "Annots") or [] if str((pdf.resolve(r) or {}).get("Subtype")).lower() not in gone]
        for a in new:
            if a["page"] == p.number:
                made = {"Type": Name("Annot"), "Subtype": Name(kinds[a["type"]]), "Rect": [float(v) for v in a["rect"]]}
                if a.get("contents"):
                    made["Contents"] = text_string(a["contents"])
                if a.get("uri"):
                    made["A"] = {"S": Name("URI"), "URI": a["uri"].encode()}
                if a.get("color"):
                    made["C"] = [float(v) for v in a["color"]]
                keep.append(made)
        p.changes["Annots"] = keep
    return assemble(pages)


def fill_form(content: bytes, values: dict[str, str]) -> tuple[bytes, list[str]]:
    """(the file with fields' values set by their full names, the names that no field has)."""
    pdf = Pdf(content)
    form = pdf.get(pdf.get(pdf.trailer, "Root"), "AcroForm")
    left, seen = dict(values), set()
    todo = [(r, "") for r in (pdf.get(form, "Fields") or [])] if isinstance(form, dict) else []
    while todo:
        r, before = todo.pop()
        f = pdf.resolve(r)
        if not isinstance(f, dict) or id(f) in seen:
            continue
        seen.add(id(f))
        from quire.sources.pdf import pdf_text

        own = pdf_text(pdf.get(f, "T"))
        name = ".".join(x for x in (before, own) if x)
        kids = pdf.get(f, "Kids") or []
        todo += [(k, name) for k in kids]
        if name in left and own is not None and not int(pdf.get(f, "Ff") or 0) & 1:
            f["V"] = Name(left.pop(name)) if pdf.get(f, "FT") == "Btn" else text_string(left.pop(name))
            f.pop("AP", None)
    if isinstance(form, dict):
        form["NeedAppearances"] = True
    return assemble(pages_of(pdf)), sorted(left)
