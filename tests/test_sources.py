"""Readers and writers on small files made here."""

import io
import zipfile

import pytest

from quire import pipeline
from quire.operators import convert, markdown
from quire.sources import archive, detect, htmltree, office, pdf, reader


def zipped(**entries):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for n, x in entries.items():
            z.writestr(n.replace("__", "/").replace("--", "."), x)
    return buf.getvalue()


def test_archive_limits():
    big = zipped(a=b"x" * 1000, b=b"y" * 1000)
    assert archive.Archive(big).read("a") == b"x" * 1000
    for limits, name, code in [
        (archive.Limits(entry_bytes=999), "a", "entry_too_large"),
        (archive.Limits(ratio=2), "a", "ratio_too_high"),
        (archive.Limits(), "c", "missing_entry"),
    ]:
        with pytest.raises(archive.ArchiveError) as e:
            archive.Archive(big, limits).read(name)
        assert e.value.code == code
    with pytest.raises(archive.ArchiveError, match="too_many"):
        archive.Archive(big, archive.Limits(entries=1))
    a = archive.Archive(big, archive.Limits(total_bytes=1500))
    a.read("a")
    with pytest.raises(archive.ArchiveError, match="archive_too_large"):
        a.read("b")
    assert (a.bytes_read, a.entries_read) == (1000, 1)
    with pytest.raises(archive.ArchiveError, match="not_utf8"):
        archive.Archive(zipped(a=b"\xff\xfe\xfa")).text("a")
    with pytest.raises(archive.ArchiveError, match="not_an_archive"):
        archive.Archive(b"PK nothing")


HTML = """<!DOCTYPE html><html><head><title>T &amp; t</title><meta name="author" content="A"><meta name="author" content="B"><meta name=keywords content="k"><style>p{}</style></head>
<body><h1>Head</h1><p>one<p>two <b>bold<br>next</p><script>var x='<p>';</script>
<ul><li>a<ul><li>b</li></ul><li>c</ul><div>bare <p>in div</p></div><blockquote>quoted</blockquote>
<table><tr><th colspan=2>h</th></tr><tr><td>x<td>y</tr></table><a href="/l">link</a><img src="data:image/png;base64,AAEC" width=3 height=x><img src="far.png"></body></html>"""


def test_html():
    root = htmltree.parse(HTML)
    assert htmltree.metadata_of(root) == {"title": "T & t", "author": "B", "keywords": "k"}
    blocks = htmltree.blocks_of(root)
    assert [(b["type"], b["text"]) for b in blocks] == [
        ("heading", "Head"), ("paragraph", "one"), ("paragraph", "two boldnext"), ("list_item", "a"), ("list_item", "b"), ("list_item", "c"), ("paragraph", "in div"), ("paragraph", "quoted"), ("table", "")
    ]
    assert [b["indent_level"] for b in blocks if b["type"] == "list_item"] == [0, 1, 0]
    assert [[c["text"] for c in r] for r in blocks[-1]["rows"]] == [["h"], ["x", "y"]] and blocks[-1]["rows"][0][0]["col_span"] == 2
    text = htmltree.text_of(root)
    assert text.startswith("T & t") and "var x" not in text and "\n\n\n" not in text and "two bold\nnext" in text
    a, b = htmltree.images_of(root)
    assert (a["color_space"], a["data"], a["width"], a["height"]) == ("RGB", b"\0\1\2", 3, 0) and b["filters"] == ["far.png"]
    assert htmltree.is_fragment("<p>x</p>") and not htmltree.is_fragment(HTML)
    assert [x["uri"] for x in htmltree.links_of(root)] == ["/l"]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_docx():
    body = """<w:p><w:pPr><w:pStyle w:val="Heading 2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>
<w:p><w:r><w:t>a</w:t><w:tab/></w:r><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>
<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:p/>
<w:sdt><w:sdtContent><w:p><w:r><w:t>inside</w:t></w:r></w:p></w:sdtContent></w:sdt>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"""
    d = office.docx(zipped(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/media/i.png": b"png"}))
    assert [(b["type"], b["text"], b.get("level"), b.get("indent_level")) for b in d["blocks"]] == [("heading", "Title", 2, None), ("paragraph", "a\tnewlink", None, None), ("list_item", "item", None, 1), ("paragraph", "inside", None, None), ("table", "", None, None)]
    assert d["text"] == "Title\na\tnewlink\nitem\ninside\nc1\nc2" and d["images"][0]["data"] == b"png"
    assert office.heading_style("heading 10") is None and office.heading_style("Heading9") == 9


def test_xlsx_cells():
    assert [office.cell_text(k, v, ["s0"]) for k, v in [("s", "0"), ("b", "1"), ("e", "#N/A"), (None, "42.0"), (None, "3.15"), (None, None), ("str", "f")]] == ["s0", "true", "#ERR:#N/A", "42", "3.15", "", "f"]
    names, found = office.sheets(convert.xlsx_bytes([("A", [["x", "1"], ["y", ""]]), ("B", [])], {}))
    assert names == ["A", "B"] and found == [("A", [["x", "1"], ["y", ""]]), ("B", [])]
    assert office.xlsx(convert.xlsx_bytes([("A", [["x", "1"]])], {}))["text"] == "=== Sheet: A ===\nx\t1\n"


def test_pptx():
    s = office.slides(convert.pptx_bytes([("T1", ["a", "b"]), (None, ["c"])], {}))
    assert [(x["title"], [b["text"] for b in x["blocks"] if not b["title"]]) for x in s] == [("T1", ["a", "b"]), (None, ["c"])]
    d = office.pptx(convert.pptx_bytes([("T1", ["a"])], {"title": "D"}))
    assert d["text"] == "--- Slide 1 ---\nT1\na\n" and d["metadata"] == {"title": "D"} and d["bookmarks"] == [{"title": "T1", "page": 1, "level": 1}]


def test_epub():
    d = office.epub(convert.epub_bytes([("One", "<h1>One</h1><p>p1</p>"), ("Two", "<p>p2</p>")], {"title": "Book", "author": "Me"}))
    assert d["page_count"] == 2 and d["metadata"] == {"title": "Book", "author": "Me"}
    assert [(b["page"], b["type"], b["text"]) for b in d["blocks"]] == [(1, "heading", "One"), (1, "paragraph", "p1"), (2, "paragraph", "p2")]
    assert [(m["title"], m["page"]) for m in d["bookmarks"]] == [("One", 1), ("Two", 2)] and d["text"].startswith("--- One ---\n")
    toc = office.nav('<nav epub:type="toc"><ol><li><a href="a">A</a><ol><li><a href="b">B</a></li></ol></li></ol></nav>')
    assert [(t["title"], t["level"]) for t in toc] == [("A", 0), ("B", 1)]


def test_detect():
    assert detect.of_bytes(b"%PDF-1.4") == "pdf" and detect.of_bytes(b"  <HTML>") == "html" and detect.of_bytes(b"x") == "unknown" and detect.of_bytes(None) == "unknown"
    for fmt in ("docx", "xlsx", "pptx", "epub", "html", "pdf"):
        assert detect.of_bytes(convert.generate([{"type": "paragraph", "text": "x", "level": None, "indent_level": None}], fmt)) == fmt


def test_pdf_lexer():
    lex = pdf.Lexer(rb"/Na#20me (a\(b\)\\ (n) \101\n) <48 6> [1 -2.5 3 0 R true null] << /K [/V] >> % c" + b"\nend")
    got = []
    while (v := lex.next()) is not None:
        got.append(v)
    assert got == ["Na me", b"a(b)\\ (n) A\n", b"H`", [1, -2.5, (3, 0), True, None], {"K": ["V"]}, "end"]
    assert pdf.operations(b"1 0 0 RG BI /W 1 ID \x00\xff EI q (x) Tj") == [("RG", [1, 0, 0]), ("BI", []), ("q", []), ("Tj", [b"x"])]
    assert pdf.cmap(b"1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <03> <0061> <04> <05> [<0078> <0079>] endbfrange") == {b"\1": "A", b"\2": "a", b"\3": "b", b"\4": "x", b"\5": "y"}
    rows = bytes([2, 1, 1, 2, 1, 1])
    assert pdf.unpredict(rows, {"Predictor": 12, "Columns": 2}) == bytes([1, 1, 2, 2])


@pytest.mark.parametrize("compress", [True, False])
def test_pdf_round_trip(compress):
    page = {"width": 300, "height": 200, "spans": [{"text": "Hello (world)", "x": 20, "y": 150, "font_size": 12}, {"text": "Bold é", "x": 20, "y": 120, "font_size": 18, "bold": True}], "segments": [(10, 10, 110, 10)]}
    d = pdf.read(pdf.write([page, {"spans": []}], {"title": "T (x)", "author": "Ä"}, compress))
    assert d["page_count"] == 2 and d["metadata"]["title"] == "T (x)" and d["metadata"]["author"] == "Ä" and d["metadata"]["pdf_version"] == "1.7"
    assert [(s["text"], s["x"], s["y"], s["font_size"], s["font_name"]) for s in d["spans"]] == [("Hello (world)", 20, 150, 12, "Helvetica"), ("Bold é", 20, 120, 18, "Helvetica-Bold")]
    assert d["segments"] == [{"page": 1, "ax": 10, "ay": 10, "bx": 110, "by": 10}] and d["pages"][0]["width"] == 300


def test_pdf_structures():
    raw = b"""%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R /Outlines 6 0 R /AcroForm << /Fields [9 0 R] >> >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 100 200] /Rotate 90 >> endobj
3 0 obj << /Type /Page /Parent 2 0 R /Contents [4 0 R] /Annots [5 0 R] /Resources << /XObject << /I 8 0 R >> >> >> endobj
4 0 obj << /Length 57 >> stream
q 2 0 0 2 0 0 cm BT 5 TL 10 20 Td [(a) -500 (b)] TJ T* (c) ' ET Q
endstream endobj
5 0 obj << /Subtype /Link /Rect [0 0 1 1] /A << /S /URI /URI (http://x) >> >> endobj
6 0 obj << /First 7 0 R >> endobj
7 0 obj << /Title (Ch 1) /Dest [3 0 R /Fit] >> endobj
8 0 obj << /Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceGray /BitsPerComponent 8 /Length 1 >> stream
Z
endstream endobj
9 0 obj << /T (group) /FT /Tx /Ff 1 /Kids [10 0 R] >> endobj
10 0 obj << /T (name) /Parent 9 0 R /V (val) >> endobj
trailer << /Root 1 0 R >>
"""
    d = pdf.read(raw)
    assert d["pages"] == [{"page": 1, "width": 100, "height": 200, "rotation": 90}]
    assert [s["text"] for s in d["spans"]] == ["a", "b", "c"] and (d["spans"][0]["x"], d["spans"][0]["y"]) == (20, 40)
    assert d["bookmarks"] == [{"title": "Ch 1", "page": 1, "level": 1}] and d["annotations"][0]["uri"] == "http://x"
    assert d["images"][0]["data"].strip() == b"Z" and [(f["t"], f["ft"], f["parent"], f["value"]) for f in d["fields"]] == [("group", "Tx", None, None), ("name", None, 0, "val")]
    for bad, code in [(b"nothing", "not_a_pdf"), (raw.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 5 0 R"), "unsupported_encryption")]:
        with pytest.raises(pdf.PdfError) as e:
            pdf.read(bad)
        assert e.value.code == code


def test_open_files(spark, tmp_path):
    blocks = [{"type": "heading", "text": "Top", "level": 1, "indent_level": None}, {"type": "paragraph", "text": "words here", "level": None, "indent_level": None}, {"type": "list_item", "text": "item", "level": None, "indent_level": 0}, {"type": "table", "text": "", "level": None, "indent_level": None, "rows": [["a", "b"], ["1", "2"]]}]
    for fmt in ("pdf", "docx", "xlsx", "pptx", "epub", "html"):
        (tmp_path / f"d.{fmt}").write_bytes(convert.generate(blocks, fmt, {"title": "Doc"}))
    (tmp_path / "d.md").write_bytes(convert.generate(blocks, "markdown"))
    (tmp_path / "bad.pdf").write_bytes(b"junk")
    docs = reader.open_files(spark, str(tmp_path))
    docs = docs.stored()
    name = lambda p: p.rpartition(".")[2]
    assert {name(r.doc_id): r.format for r in docs.files.filter("error IS NULL").collect()} == {k: k if k != "md" else "markdown" for k in ("pdf", "docx", "xlsx", "pptx", "epub", "html", "md")}
    assert docs.errors.count() == 1
    heads = {name(r.doc_id): r.text for r in docs.blocks.filter("type = 'heading' AND level = 1").collect()}
    assert {k: v for k, v in heads.items() if k != "xlsx"} == dict.fromkeys(("pdf", "docx", "pptx", "epub", "html", "md"), "Top")
    texts = {name(r.doc_id): r.text for r in docs.texts.collect()}
    assert all("words here" in texts[k] for k in ("pdf", "docx", "pptx", "epub", "html", "md"))
    cells = {(name(r.doc_id), r.text) for r in docs.cells.collect()}
    assert all((k, "2") in cells for k in ("docx", "xlsx", "epub", "html"))
    assert docs.metadata.filter("field = 'title' AND value = 'Doc'").count() == 6 - 1  # workbooks have none


def test_convert_round_trip(spark):
    df = spark.createDataFrame([(1, HTML), (2, None)], "id long, html string")
    made = convert.convert(reader.open_table(df, "id", "html", "html").parsed, "docx")
    rows = {r.doc_id: r for r in made.collect()}
    assert rows[1].tables == 1 and rows[1].blocks == 9 and rows[2].error
    assert [b["text"] for b in office.docx(bytes(rows[1].content))["blocks"]][:2] == ["Head", "one"]


@pytest.mark.parametrize("algorithm", ["rc4", "aes128", "aes256"])
def test_encrypted_pdf(algorithm):
    made = pdf.write([{"spans": [{"text": "hidden (text)", "x": 9, "y": 9}]}], {"title": "Secret title"}, encrypt={"user": "u", "owner": "o", "algorithm": algorithm})
    assert b"Secret" not in made
    for password in ("u", "o"):
        d = pdf.read(made, password)
        assert d["spans"][0]["text"] == "hidden (text)" and d["metadata"]["title"] == "Secret title"
    for password, code in ((None, "password_required"), ("x", "wrong_password")):
        with pytest.raises(pdf.PdfError) as e:
            pdf.read(made, password)
        assert e.value.code == code
    open_ = pdf.write([{"spans": [{"text": "t", "x": 9, "y": 9}]}], encrypt={"owner": "o", "algorithm": algorithm})
    assert pdf.read(open_)["spans"][0]["text"] == "t"  # no user password is needed


def test_ciphers():
    from quire.sources import crypt

    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    for n, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        aes = crypt.Aes(bytes(range(n)))
        assert aes.encrypt(block).hex() == want and aes.decrypt(aes.encrypt(block)) == block
        for encrypt in (True, False):
            assert crypt.cbc(bytes(range(n)), block * 3, block, encrypt) == crypt.cbc(bytes(range(n)), block * 3, block, encrypt, plain=True)
    for n in (0, 1, 15, 16, 40):
        assert crypt.cbc_decrypt(b"k" * 16, crypt.cbc_encrypt(b"k" * 16, b"d" * n, b"i" * 16)) == b"d" * n


def _ruled_page():
    """A heading, a paragraph, and a ruled table of two rows and two columns."""
    spans = [{"text": "Big Title", "x": 72, "y": 780, "font_size": 20}, {"text": "some words of the body of this page", "x": 72, "y": 740, "font_size": 11}, {"text": "and more of them below", "x": 72, "y": 726, "font_size": 11}]
    for r, row in enumerate([["name", "n"], ["a|b", "2"]]):
        spans += [{"text": t, "x": 80 + 100 * c, "y": 610 - 20 * r, "font_size": 11} for c, t in enumerate(row)]
    rules = [(72, y, 272, y) for y in (625, 605, 585)] + [(x, 585, x, 625) for x in (72, 172, 272)]
    return {"width": 595, "height": 842, "spans": spans, "segments": rules}


def test_pdf_keeps_headings_and_tables(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf.write([_ruled_page()], {"title": "T"}))
    docs = reader.open_files(spark, str(tmp_path))
    said = docs.markdown().first().markdown
    assert said.startswith("# Big Title\n\nsome words of the body of this page and more of them below\n") and "| name | n   |\n| ---- | --- |\n| a\\|b | 2   |" in said
    assert docs.stored().markdown().first().markdown == said
    for target in ("docx", "html", "epub"):
        again = reader.parse(convert.convert(docs.parsed, target).first().content, target)
        assert {"heading", "table"} <= {b["type"] for b in again["blocks"]}, target
        assert [c["text"] for c in again["cells"]] == ["name", "n", "a|b", "2"]
    p = pipeline.run_file("a.pdf", (tmp_path / "a.pdf").read_bytes(), [pipeline.Step("extract_tables"), pipeline.Step("to_markdown")])
    assert p["markdown"] == said


def test_tables_of_html_stay(spark):
    page = "<h1>A</h1><p>w</p><table><tr><td>x</td><td>y<5</td></tr><tr><td>1</td></tr></table><p>z</p>"
    docs = reader.open_table(spark.createDataFrame([(1, page)], "id long, html string"), "id", "html", "html")
    said = docs.markdown().first().markdown
    assert said == "# A\n\nw\n\n| x   | y<5 |\n| --- | --- |\n| 1   |\n\nz\n"
    assert markdown.render(docs.blocks, cells=docs.cells, strip_markers=False).first().markdown == said
    assert "<th>y&lt;5</th>" in convert.html(docs.blocks, cells=docs.cells).first().html
    assert "<th>y&lt;5</th>" in docs.markdown(html=True).first().markdown


def test_files_are_parsed_once(spark):
    docs = reader.open_table(spark.createDataFrame([(1, "<p>a</p>")], "id long, html string"), "id", "html", "html")
    for name in ("files", "errors", "texts", "blocks", "cells", "images", "bookmarks", "pages", "annotations", "links", "metadata"):
        plan = getattr(docs, name)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, (name, plan)
    assert docs.markdown()._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_pages_by_folds_and_by_joins(spark):
    """pagefold has the same blocks and tables as structure.extract and tables.detect."""
    import random

    from pyspark.sql import functions as F

    from quire.operators import structure, tables
    from quire.sources import pagefold

    r = random.Random(3)
    rows, rules = [], []
    for page in range(1, 9):
        for i in range(r.randrange(1, 25)):
            size, bold = r.choice([10.0, 10.0, 10.0, 10.5, 18.0, 14.0]), r.random() < 0.15
            for j in range(r.choice([1, 1, 2, 3, 3])):
                rows.append((1, page, len(rows), r.choice(["word", "- item", "2. two", "é x", " "]), 40.0 + 120 * j + r.choice([0, 0, 5, 40]), 780.0 - 15 * i - r.choice([0, 0, 20]), 30.0, size, "X-Bold" if bold else "X"))
        if page % 2:
            rules += [(1, page, 30.0, y, 400.0, y) for y in (500.0, 600.0, 701.0)] + [(1, page, x, 500.0, x, 701.0) for x in (30.0, 200.0, 400.0)]
    s = spark.createDataFrame(rows, "doc_id long, page int, span_idx int, text string, x double, y double, width double, font_size double, font_name string")
    g = spark.createDataFrame(rules, "doc_id long, page int, ax double, ay double, bx double, by double")
    grouped = reader.group_spans(s)
    want = [tuple(x) for x in structure.extract(grouped).orderBy("page", "block_idx").select("page", "type", "text", "level", "indent_level", "x0", "y1").collect()]
    key = ["doc_id", "page"]
    lattice = tables.fill(tables.grid(tables.clusters(tables.intersections(g))), grouped)
    big = lattice.groupBy(*key, "table_id").agg(F.max("row").alias("r"), F.max("col").alias("c")).filter("r >= 1 AND c >= 1").select(*key, "table_id")
    lattice = lattice.join(big, [*key, "table_id"]).select("page", "table_id", "row", "col", "text")
    words = tables.words(grouped)
    modal = tables.modal_columns(words).filter("cols >= 2")
    bounds = tables.boundaries(words, modal)
    loose = tables.stream_cells(words, bounds, tables.stream_lines(words.join(modal.select(*key), key), bounds)).select("page", "table_id", "row", "col", "text")
    cells = sorted(tuple(x) for x in lattice.unionByName(loose.join(lattice.select("page").distinct(), "page", "left_anti")).collect())
    assert cells == sorted(tuple(x) for x in tables.detect(g, grouped).select("page", "table_id", "row", "col", "text").collect())
    got, found = [], []
    for page in range(1, 9):
        spans = [dict(zip(s.columns, x)) for x in rows if x[1] == page]
        _, blocks = pagefold.page_of(spans, [dict(zip(g.columns, x)) for x in rules if x[1] == page])
        lines = pagefold.lines_of(spans)
        got += [(page, b["type"], b["text"], b["level"], b["indent_level"], b["box"][0], b["box"][3]) for b in pagefold.text_blocks(lines, spans)]
        tables_ = pagefold.ruled([x[2:] for x in rules if x[1] == page], lines) or pagefold.aligned(lines)
        found += [(page, t, i, j, c) for t, x in enumerate(tables_) for i, row in enumerate(x["rows"]) for j, c in enumerate(row)]
        assert sum(b["type"] == "table" for b in blocks) == len(tables_)
    assert got == want and sorted(found) == cells


def test_folders_go_with_the_driver(tmp_path):
    import os
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
from quire import storage
s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', '{tmp_path}').getOrCreate()
print('ROWS', storage.stored(s.range(3), 'x').count(), sum(len(f) for _, _, f in __import__('os').walk('{tmp_path}')) > 0)
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, timeout=120)
    assert "ROWS 3 True" in out.stdout, out.stderr
    assert not [n for n in os.listdir(tmp_path) if n.startswith("quire-")]
