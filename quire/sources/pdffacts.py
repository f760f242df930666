"""What the archive and accessibility rules ask of a PDF file, told from its objects."""

from __future__ import annotations

from xml.etree import ElementTree

from quire.sources import pdfedit
from quire.sources.pdf import Name, Pdf, PdfError, Stream, operations

Issue = tuple[str, str, str, "int | None"]


def _dict(pdf: Pdf, v) -> dict | None:
    v = pdf.resolve(v)
    return v if isinstance(v, dict) else None


def _script(pdf: Pdf, action) -> bool:
    a = _dict(pdf, action)
    return a is not None and pdf.get(a, "S") == "JavaScript"


def xmp_names(raw: bytes) -> dict[str, str]:
    """Local names of the elements and attributes of XMP, with their texts. Raises where it isn't XML."""
    if b"<!ENTITY" in raw:
        raise ElementTree.ParseError("entities")
    out: dict[str, str] = {}
    for e in ElementTree.fromstring(raw.decode("utf-8", "replace").strip("\0 \n\r\t")).iter():
        out[e.tag.rpartition("}")[2]] = (e.text or "").strip()
        out |= {k.rpartition("}")[2]: v.strip() for k, v in e.attrib.items() if "}" in k}
    return out


def pdf_a(content: bytes, level: str = "1b", password: str | None = None) -> list[Issue]:
    """(severity, rule, message, page) of each breach of an archive level (1a, 1b or 2b)."""
    out: list[Issue] = []
    pdf = Pdf(content, password)
    if "Encrypt" in pdf.trailer:
        out.append(("error", "encryption", "an archive file must not be encrypted", None))
    root = _dict(pdf, pdf.trailer.get("Root"))
    if root is None:
        return [*out, ("error", "xmp.catalog", "there is no catalog", None)]
    meta = pdf.resolve(root.get("Metadata"))
    if meta is None:
        out.append(("error", "xmp.missing", "there is no XMP metadata", None))
    elif not isinstance(meta, Stream):
        out.append(("error", "xmp.not_stream", "the metadata isn't a stream", None))
    else:
        try:
            names = xmp_names(pdf.decoded(meta))
            if "part" not in names:
                out.append(("error", "xmp.no_pdfaid_part", "XMP names no part", None))
            elif names["part"] != level[0]:
                out.append(("warning", "xmp.part_mismatch", f"XMP names part {names['part']}, not {level[0]}", None))
            if "conformance" not in names:
                out.append(("warning", "xmp.no_pdfaid_conformance", "XMP names no conformance", None))
        except ElementTree.ParseError:
            out.append(("error", "xmp.parse", "XMP can't be read", None))
    for nr, node in _numbered(pdf):
        for f in (_dict(pdf, pdf.inherited(node, "Resources")) or {}).get("Font") and _dict(pdf, _dict(pdf, pdf.inherited(node, "Resources"))["Font"]).values() or []:
            font = _dict(pdf, f)
            if font is None:
                continue
            name, told = str(pdf.get(font, "BaseFont") or "unknown"), _dict(pdf, font.get("FontDescriptor"))
            if told is None and pdf.get(font, "Subtype") == "Type1" and "FontDescriptor" not in font or told is not None and not any(k in told for k in ("FontFile", "FontFile2", "FontFile3")):
                out.append(("error", "font.not_embedded", f"not embedded: {name}", nr))
    intents = pdf.resolve(root.get("OutputIntents"))
    if not isinstance(intents, list):
        out.append(("warning", "output_intent.missing", "there is no output intent", None))
    elif not any(pdf.get(d, "S") == "GTS_PDFA1" for i in intents if (d := _dict(pdf, i))):
        out.append(("warning", "output_intent.no_pdfa", "no output intent is for archives", None))
    if level.startswith("1"):
        for nr, node in _numbered(pdf):
            group = _dict(pdf, node.get("Group"))
            if group is not None and pdf.get(group, "S") == "Transparency":
                out.append(("error", "transparency.group", "transparency isn't allowed at this level", nr))
            states = _dict(pdf, (_dict(pdf, pdf.inherited(node, "Resources")) or {}).get("ExtGState")) or {}
            for s in filter(None, (_dict(pdf, x) for x in states.values())):
                blend, mask = pdf.get(s, "BM"), pdf.get(s, "SMask")
                if isinstance(blend, str) and blend not in ("Normal", "Compatible"):
                    out.append(("error", "transparency.blend_mode", f"blend mode {blend} isn't allowed at this level", nr))
                if mask is not None and mask != "None":
                    out.append(("error", "transparency.smask", "soft masks aren't allowed at this level", nr))
    for v in (_dict(pdf, root.get("AA")) or {}).values():
        if _script(pdf, v):
            out.append(("error", "javascript.action", "JavaScript isn't allowed", None))
    if _script(pdf, root.get("OpenAction")):
        out.append(("error", "javascript.open_action", "opening the file runs JavaScript", None))
    if "JavaScript" in (_dict(pdf, root.get("Names")) or {}):
        out.append(("error", "javascript.names_tree", "the file names JavaScript", None))
    for nr, node in _numbered(pdf):
        out += [("error", "javascript.action", "JavaScript isn't allowed", nr) for v in (_dict(pdf, node.get("AA")) or {}).values() if _script(pdf, v)]
    return out


def _numbered(pdf: Pdf):
    return [(i, node) for i, (_, node) in enumerate(pdfedit.page_refs(pdf), 1)]


def pdf_ua(content: bytes, password: str | None = None) -> list[Issue]:
    """(severity, rule, message, page) of each breach of the accessibility rules."""
    pdf, out = Pdf(content, password), []
    root = _dict(pdf, pdf.trailer.get("Root"))
    if root is None:
        return [("error", "ua.catalog", "there is no catalog", None)]
    mark = pdf.resolve(root.get("MarkInfo"))
    if mark is None:
        out.append(("error", "ua.mark_info.missing", "there is no mark information", None))
    elif not isinstance(mark, dict):
        out.append(("error", "ua.mark_info.invalid", "the mark information isn't a dictionary", None))
    elif pdf.get(mark, "Marked") is not True:
        out.append(("error", "ua.mark_info.not_marked", "the document isn't marked as tagged", None))
    if not (isinstance(lang := pdf.resolve(root.get("Lang")), bytes) and lang):
        out.append(("error", "ua.lang.missing", "no language is named", None))
    if pdf.get(_dict(pdf, root.get("ViewerPreferences")) or {}, "DisplayDocTitle") is not True:
        out.append(("warning", "ua.display_doc_title", "the title isn't displayed", None))
    tree = _dict(pdf, root.get("StructTreeRoot"))
    if tree is None:
        out.append(("error", "ua.struct_tree.missing", "there is no structure tree", None))
    else:
        heads, todo, seen = [], [tree], {id(tree)}
        while todo:
            e = todo.pop()
            kind = str(pdf.get(e, "S") or "")
            if kind == "Figure" and "Alt" not in e:
                out.append(("error", "ua.figure.no_alt", "a figure has no text", None))
            if len(kind) == 2 and kind[0] == "H" and kind[1] in "123456":
                heads.append(int(kind[1]))
            kids = pdf.resolve(e.get("K"))
            kids = kids if isinstance(kids, list) else [kids] if kids is not None else []
            found = [d for k in kids if (d := _dict(pdf, k)) is not None and "S" in d and id(d) not in seen]
            seen.update(map(id, found))
            todo += found[::-1]
        out += [("warning", "ua.heading.skip", f"H{a} is followed by H{b}", None) for a, b in zip(heads, heads[1:]) if b > a + 1]
    for nr, node in _numbered(pdf):
        if pdf.get(node, "Tabs") != "S":
            out.append(("warning", "ua.tab_order", "tabs don't follow the structure", nr))
        for a in filter(None, (_dict(pdf, x) for x in pdf.get(node, "Annots") or [])):
            if pdf.get(a, "Subtype") != "Widget" and "Contents" not in a and "Alt" not in a:
                out.append(("warning", "ua.annotation.no_alt", f"{pdf.get(a, 'Subtype')} has no text", nr))
        if "Contents" in node and not any(op in ("BDC", "BMC") for op, _ in operations(pdf.content(node))):
            out.append(("warning", "ua.tagged_content", "content isn't tagged", nr))
    return out


XMP = """<?xpacket begin="" id="W5M0MpCehiHzreSzNTczkc9d"?>
<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:pdfaid="http://www.aiim.org/pdfa/ns/id/"><pdfaid:part>{part}</pdfaid:part><pdfaid:conformance>{conformance}</pdfaid:conformance></rdf:Description></rdf:RDF></x:xmpmeta>
<?xpacket end="w"?>"""


def to_pdf_a(content: bytes, level: str = "1b", password: str | None = None) -> tuple[bytes, list[str], list[Issue]]:
    """(the file made archivable, the actions taken, the issues that are left, such as fonts not embedded)."""
    if level not in ("1a", "1b", "2b"):
        raise PdfError("malformed", f"not a level: {level}")
    before, done, out = pdf_a(content, level, password), [], pdfedit.Out()
    rules = {r for _, r, _, _ in before}
    pdf = Pdf(content, password)
    root = pdf.get(pdf.trailer, "Root")
    if "encryption" in rules:
        done.append("removed encryption")
    catalog: dict = {}
    if any(r.startswith("xmp.") for r in rules):
        raw = XMP.format(part=level[0], conformance=level[1].upper()).encode()
        catalog["Metadata"] = out.new(Stream({"Type": Name("Metadata"), "Subtype": Name("XML")}, raw))
        done.append("wrote XMP metadata")
    if any(r.startswith("output_intent.") for r in rules):
        catalog["OutputIntents"] = [{"Type": Name("OutputIntent"), "S": Name("GTS_PDFA1"), "OutputConditionIdentifier": b"sRGB"}]
        done.append("added an output intent with a color profile")
    if any(r.startswith("javascript.") for r in rules):
        catalog |= {"OpenAction": None, "AA": None}
        if (names := _dict(pdf, root.get("Names"))) is not None:
            catalog["Names"] = out.copy(pdf, {k: v for k, v in names.items() if k != "JavaScript"})
        done.append("removed a JavaScript action")
    pages = pdfedit.pages_of(pdf)
    for p, (_, node) in zip(pages, pdfedit.page_refs(pdf)):
        if any(r == "javascript.action" and nr == p.number for _, r, _, nr in before):
            p.changes["AA"] = None
        if any(r == "transparency.group" and nr == p.number for _, r, _, nr in before):
            p.changes["Group"] = None
            done.append("removed a transparency group")
    made = pdfedit.assemble(pages, out, catalog=catalog)
    return made, done, pdf_a(made, level)
