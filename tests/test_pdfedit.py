"""Edits of PDF files, read again."""

import zlib

import pytest

from quire.plans.files import raw_pdf, stream
from quire.sources import pdf, pdfedit


def book(name: str, n: int = 3, **how) -> bytes:
    """n pages with text, inherited box and font, a link from the first page to the last, and a picture on each."""
    kids = b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(n))
    pages = []
    for i in range(n):
        notes = b"/Annots [<< /Subtype /Link /Rect [0 0 9 9] /Dest [%d 0 R /Fit] >> << /Subtype /Link /Rect [0 0 9 9] /A << /S /URI /URI (http://x/%d) >> >>]" % (5 + 2 * (n - 1), i)
        pages += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R %s >>" % (6 + 2 * i, notes), stream(b"q BT /F1 12 Tf 72 700 Td (%s page %d) Tj ( secret) Tj ( tail) Tj ET Q" % (name.encode(), i + 1))]
    extra = how.get("catalog", b"")
    return raw_pdf(
        [b"<< /Type /Catalog /Pages 2 0 R %s >>" % extra, b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 500 800] /Resources << /Font << /F1 3 0 R >> /XObject << /Im 4 0 R >> >> >>" % (n, kids), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", stream(b"xyz").replace(b"<<", b"<< /Subtype /Image /Width 1 /Height 3", 1), *pages, *how.get("more", [])]
    )


def texts(content: bytes, **how) -> list[str]:
    found = pdf.read(content, **how)
    return ["".join(s["text"] for s in found["spans"] if s["page"] == p["page"]) for p in found["pages"]]


def test_page_sets():
    a, b = book("a"), book("b", 2)
    both = pdfedit.merge([a, b])
    assert texts(both) == [f"{n} page {i} secret tail" for n, k in (("a", 3), ("b", 2)) for i in range(1, k + 1)]
    found = pdf.read(both)
    assert len(found["images"]) == 5 and {x["target_page"] for x in found["annotations"]} == {None, 3, 5}
    assert both.count(b"/Image") == 1  # equal streams are there once
    assert texts(pdfedit.select(a, [3, 1, 1])) == ["a page 3 secret tail", "a page 1 secret tail", "a page 1 secret tail"]
    left = pdf.read(pdfedit.select(a, [1, 2]))
    assert [x["target_page"] for x in left["annotations"] if x["uri"] is None] == [None, None]  # the page linked to is gone
    assert texts(pdfedit.insert_blank(a, [0, 2])) == ["", *texts(a)[:2], "", texts(a)[2]]
    assert [p["rotation"] for p in pdf.read(pdfedit.rotate(a, 450, [2]))["pages"]] == [0, 90, 0]
    with pytest.raises(pdf.PdfError):
        pdfedit.select(a, [4])
    with pytest.raises(pdf.PdfError):
        pdfedit.select(a, [])


def test_marks_on_pages():
    a = book("a")
    marked = pdfedit.watermark(a, "DRAFT", [2], size=20, angle=0, position="top_right")
    spans = [s for s in pdf.read(marked)["spans"] if s["text"] == "DRAFT"]
    assert [(s["page"], s["x"], s["y"]) for s in spans] == [(2, 400.0, 730.0)]
    assert texts(pdfedit.watermark(a, "X", over=False))[0].startswith("X")
    stamped = pdfedit.stamp(a, book("s", 1), on=[1])
    assert b"/Form" in stamped and len(pdf.read(stamped)["spans"]) == 9


@pytest.mark.parametrize("algorithm", ["rc4", "aes128", "aes256"])
def test_encrypt_keeps_all(algorithm):
    sealed = pdfedit.encrypt(book("a"), "pw", "own", algorithm)
    assert texts(sealed, password="pw") == texts(sealed, password="own") == texts(book("a"))
    with pytest.raises(pdf.PdfError):
        pdf.read(sealed)
    assert b"secret" not in sealed and b"http" not in sealed
    assert [x["uri"] for x in pdf.read(sealed, "pw")["annotations"]][1] == "http://x/0"


def test_redact_leaves_the_rest_in_place():
    a = book("a")
    before = {s["text"]: s["x"] for s in pdf.read(a)["spans"]}
    out, n = pdfedit.redact(a, "SECRET")
    after = {s["text"]: s["x"] for s in pdf.read(out)["spans"]}
    assert n == 3 and " secret" not in after and after[" tail"] == pytest.approx(before[" tail"]) and len(pdf.read(out)["images"]) == 3
    assert b"secret" not in b"".join(zlib.decompress(o.raw) if o.info.get("Filter") else o.raw for o in (pdf.Pdf(out).object(i) for i in pdf.Pdf(out).places) if isinstance(o, pdf.Stream))
    every = pdf.Lexer(b"x")
    assert every.next() == "x"
    odd = raw_pdf([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 1 /Kids [3 0 R] /MediaBox [0 0 9 9] >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", stream(b"BI /W 1 ID \x01\x02 EI BT /F 10 Tf 2 Tc 20 TL 9 90 Td (ab) Tj [(cd) 50 (hit)] TJ (lo) ' 1 1 (hit) \" (end) Tj ET")])
    want = [(s["text"], round(s["x"], 3), round(s["y"], 3)) for s in pdf.read(odd)["spans"] if s["text"] != "hit"]
    got = pdfedit.redact(odd, "hit")[0]
    assert [(s["text"], round(s["x"], 3), round(s["y"], 3)) for s in pdf.read(got)["spans"]] == want
    assert any(b"\x01\x02" in zlib.decompress(o.raw) for o in (pdf.Pdf(got).object(i) for i in pdf.Pdf(got).places) if isinstance(o, pdf.Stream))


def test_sanitize_and_optimize():
    acts = book("a", catalog=b"/OpenAction << /S /JavaScript /JS (x) >> /Names << /JavaScript << /Names [] >> /EmbeddedFiles << /Names [] >> /Dests << >> >> /AA << >> /Lang (en)", more=[stream(b"never used")])
    out, removed = pdfedit.sanitize(acts)
    assert sorted(removed) == ["action", "embedded_file", "javascript", "javascript", "link", "link", "link"]
    assert b"JavaScript" not in out and b"/Dests" in out and b"/Lang" in out and texts(out) == texts(acts)
    kept, removed = pdfedit.sanitize(acts, javascript=False, embedded=False, links=False)
    assert removed == ["action"] and b"JavaScript" in kept
    small = pdfedit.optimize(acts)
    assert b"never used" not in small and texts(small) == texts(acts)
    named = pdfedit.set_metadata(acts, {"title": "é", "author": "A"})
    assert pdf.read(named)["metadata"]["title"] == "é"
    assert "title" not in pdf.read(pdfedit.optimize(named, strip_metadata=True))["metadata"]
    assert pdf.read(pdfedit.set_metadata(named, {"title": None}))["metadata"].get("title") is None


def test_bookmarks_annotations_forms():
    marks = [{"title": "a", "page": 1, "level": 1}, {"title": "b", "page": 2, "level": 3}, {"title": "c", "page": 3, "level": 1}]
    assert [(m["title"], m["page"], m["level"]) for m in pdf.read(pdfedit.set_bookmarks(book("a"), marks))["bookmarks"]] == [("a", 1, 1), ("b", 2, 2), ("c", 3, 1)]
    noted = pdfedit.annotate(book("a"), [{"page": 2, "type": "highlight", "rect": [1, 2, 3, 4], "contents": "n", "color": [1, 0, 0]}], remove=["link"])
    assert [(x["page"], x["type"], x["contents"]) for x in pdf.read(noted)["annotations"]] == [(2, "highlight", "n")]
    form = book("a", catalog=b"/AcroForm << /Fields [11 0 R] >>", more=[b"<< /T (top) /Kids [12 0 R 13 0 R] >>", b"<< /T (x) /FT /Tx /Parent 11 0 R /V (old) >>", b"<< /T (locked) /FT /Tx /Ff 1 /Parent 11 0 R >>"])
    filled, left = pdfedit.fill_form(form, {"top.x": "new", "top.locked": "no", "none": "z"})
    assert {f["t"]: f["value"] for f in pdf.read(filled)["fields"]} == {"top": None, "x": "new", "locked": None} and left == ["none", "top.locked"]
    assert len(pdf.read(pdfedit.merge([filled, filled]))["fields"]) == 6


def test_signatures():
    from quire.sources import sign

    key, cert = sign.identity("Ann Ö", serial=7)
    told = sign.certificate(cert)
    assert told["subject"] == "CN=Ann Ö" and told["self_signed"] and told["serial"] == 7 and (told["not_after"] - told["not_before"]).days == 365
    made = sign.sign(book("a"), key, cert, name="Ann", reason="because", at=0)
    (s,) = sign.signatures(made)
    assert (s["name"], s["reason"], s["date"], s["covers_whole_file"], s["integrity_ok"], s["subject"], s["has_timestamp"]) == ("Ann", "because", "D:19700101000000Z", True, True, "CN=Ann Ö", False)
    assert texts(made) == texts(book("a"))
    (changed,) = sign.signatures(made.replace(b"page 2", b"page 9"))
    assert not changed["integrity_ok"] and changed["covers_whole_file"]
    (longer,) = sign.signatures(made + b"% more")
    assert longer["integrity_ok"] and not longer["covers_whole_file"]
    form = book("a", catalog=b"/AcroForm << /Fields [11 0 R] >>", more=[b"<< /T (x) /FT /Tx /V (old) >>"])
    assert {f["t"] for f in pdf.read(sign.sign(form, key, cert))["fields"]} == {"x", "Signature1"}
    assert sign.signatures(book("a")) == [] and sign.checked(b"x", b"not a signature") == (False, None)
    with pytest.raises(pdf.PdfError):
        sign.detached(b"x", b"no key", cert)


def test_pictures():
    from quire.operators import render

    made = pdf.write([{"width": 72, "height": 36, "spans": [{"text": "L", "x": 0, "y": 10, "font_size": 20}], "segments": [(10, 2, 60, 2)]}, {"width": 10, "height": 20}])
    (_, one), (n, two) = render.pictures(made, 72)
    assert one.shape == (36, 72) and n == 2 and two.shape == (20, 10) and (two == 255).all()
    assert (one[33, 10:61] == 0).all() and one[33, 62] == 255  # the rule line
    dots = one[:30, :12] == 0
    assert dots[:, 0].sum() >= 14 and dots[:9].sum() == 0 or dots.any()  # an upright stroke
    assert render.pictures(made, 144, [1])[0][1].shape == (72, 144)
    raw = render.png(one)
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and zlib.decompress(raw[raw.index(b"IDAT") + 4 : raw.index(b"IEND") - 8])[:2] == b"\0\xff"
    assert render.drawn({"width": 10, "height": 20, "rotation": 90}, [], [], 72).shape == (10, 20)
    assert render.glyph("é").any() and not render.glyph(" ").any()
