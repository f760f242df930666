"""Queries on whole files: rows of the tables are written as files of a format, and read by the readers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire import pipeline, storage
from quire.operators import convert, pdfsets, render, security
from quire.sources import pdf, pdfedit, pdffacts, reader, sign

QUERIES = []


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES.append((name, fn, sql))
        return fn

    return add


def read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


def parts(spark, d):
    """The parts, spread over all cores: what is made of a row takes far longer than reading it."""
    return storage.spread(read(spark, d, "part"), "p_partkey")


def suppliers(spark, d):
    return storage.spread(read(spark, d, "supplier"), "s_suppkey")


def raw_pdf(objects: list[bytes]) -> bytes:
    """A PDF file of the objects, the first of which is the catalog."""
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % at for at in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def stream(body: bytes) -> bytes:
    return b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body)


def page(*contents: bytes, fonts: bytes = b"/F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>") -> bytes:
    """A file of one page with the content streams given."""
    first = 4
    kids = b" ".join(b"%d 0 R" % (first + i) for i in range(len(contents)))
    return raw_pdf(
        [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 1 /Kids [3 0 R] /MediaBox [0 0 600 800] >>", b"<< /Type /Page /Parent 2 0 R /Contents [%s] /Resources << /Font << %s >> >> >>" % (kids, fonts), *map(stream, contents)]
    )


# --- every format: part p is a file of the format p % 7, with a heading and a paragraph ----------------

FORMATS = ("pdf", "docx", "xlsx", "pptx", "epub", "html", "unknown")
KIND = "CASE p_partkey % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'pptx' WHEN 4 THEN 'epub' WHEN 5 THEN 'html' ELSE 'unknown' END"


def _files(spark, d):
    def make(keys: pd.Series, heads: pd.Series, bodies: pd.Series) -> pd.Series:
        out = []
        for k, h, b in zip(keys, heads, bodies):
            blocks = [{"type": "heading", "text": h, "level": 1}, {"type": "paragraph", "text": b}]
            out.append(b"\0\1\2" if k % 7 == 6 else convert.generate(blocks, FORMATS[k % 7], {"title": h, "author": "A"}))
        return pd.Series(out)

    made = parts(spark, d).select("p_partkey", F.pandas_udf(make, "binary")("p_partkey", "p_name", "p_type").alias("content"))
    return reader.open_table(made, "p_partkey", "content")


@query("open_any", f"SELECT p_partkey AS doc_id, {KIND} AS format, CASE WHEN p_partkey % 7 < 6 THEN 1 END AS page_count, CASE WHEN p_partkey % 7 = 6 THEN 'malformed' END AS code FROM part")
def open_any(spark, d):
    return _files(spark, d).files.select("doc_id", "format", "page_count", F.col("error.code").alias("code"))


@query("open_errors", "SELECT p_partkey AS doc_id, 'unknown' AS format, 'malformed' AS code, 'the format isn''t known' AS message FROM part WHERE p_partkey % 7 = 6")
def open_errors(spark, d):
    return _files(spark, d).errors


@query("open_texts", f"""SELECT p_partkey AS doc_id, CASE {KIND} WHEN 'xlsx' THEN '=== Sheet: Content ===' || chr(10) || p_name || chr(10) || p_type || chr(10) WHEN 'pptx' THEN '--- Slide 1 ---' || chr(10) || p_name || chr(10) || p_type || chr(10)
  WHEN 'epub' THEN '--- ' || p_name || ' ---' || chr(10) || p_name || chr(10) || p_name || chr(10) || chr(10) || p_type WHEN 'html' THEN p_name || chr(10) || p_name || chr(10) || chr(10) || p_type ELSE p_name || chr(10) || p_type END AS text FROM part WHERE p_partkey % 7 < 6""")  # fmt: skip
def open_texts(spark, d):
    return _files(spark, d).texts


@query("open_blocks", f"""SELECT p_partkey AS doc_id, 0 AS block_idx, 'heading' AS type, 1 AS level, CASE WHEN {KIND} = 'xlsx' THEN 'Content' ELSE p_name END AS text FROM part WHERE p_partkey % 7 < 6
UNION ALL SELECT p_partkey, 1, CASE WHEN {KIND} = 'xlsx' THEN 'table' ELSE 'paragraph' END, NULL, CASE WHEN {KIND} = 'xlsx' THEN '' ELSE p_type END FROM part WHERE p_partkey % 7 < 6""")  # fmt: skip
def open_blocks(spark, d):
    return _files(spark, d).blocks.select("doc_id", "block_idx", "type", "level", "text")


@query("open_metadata", f"""WITH m AS (SELECT p_partkey AS doc_id, {KIND} AS f, p_name FROM part WHERE p_partkey % 7 NOT IN (2, 6))
SELECT doc_id, 'title' AS field, p_name AS value FROM m UNION ALL SELECT doc_id, 'author', 'A' FROM m WHERE f <> 'html' UNION ALL SELECT doc_id, 'pdf_version', '1.7' FROM m WHERE f = 'pdf' UNION ALL SELECT doc_id, 'creator', 'A' FROM m WHERE f = 'docx'""")  # fmt: skip
def open_metadata(spark, d):
    return _files(spark, d).metadata


@query("open_markdown", f"""SELECT p_partkey AS doc_id, CASE {KIND} WHEN 'pptx' THEN '## Slide 1: ' || p_name || chr(10) || chr(10) || p_type WHEN 'xlsx' THEN '# Content' || chr(10) || chr(10) || '| ' || rpad(p_name, w, ' ') || ' |' || chr(10) || '| ' || repeat('-', w) || ' |' || chr(10) || '| ' || rpad(p_type, w, ' ') || ' |' ELSE '# ' || p_name || chr(10) || chr(10) || p_type END || chr(10) AS markdown
FROM (SELECT *, greatest(3, strlen(p_name), strlen(p_type))::INTEGER AS w FROM part) WHERE p_partkey % 7 < 6""")  # fmt: skip
def open_markdown(spark, d):
    return _files(spark, d).markdown()


@query("open_summary", f"SELECT p_partkey AS doc_id, 2 AS blocks, ({KIND} = 'xlsx')::INTEGER AS tables, ({KIND} IN ('pptx', 'html', 'epub'))::INTEGER AS bookmarks FROM part WHERE p_partkey % 7 < 6")
def open_summary(spark, d):
    docs = _files(spark, d).stored()
    ok = docs.files.filter("error IS NULL").select("doc_id")
    blocks = docs.blocks.groupBy("doc_id").agg(F.count("*").cast("int").alias("blocks"), F.count_if(F.col("type") == "table").cast("int").alias("tables"))
    marks = docs.bookmarks.groupBy("doc_id").agg(F.count("*").cast("int").alias("bookmarks"))
    return ok.join(blocks, "doc_id", "left").join(marks, "doc_id", "left").na.fill(0)


@query("convert_any", f"""WITH f AS (SELECT p_partkey AS doc_id, {KIND} AS f, p_name, p_type FROM part WHERE p_partkey % 7 < 6)
SELECT doc_id, 0 AS block_idx, 'heading' AS type, CASE WHEN f = 'xlsx' THEN 'Content' ELSE p_name END AS text FROM f UNION ALL SELECT doc_id, 1, CASE WHEN f = 'xlsx' THEN 'table' ELSE 'paragraph' END, CASE WHEN f = 'xlsx' THEN '' ELSE p_type END FROM f""")  # fmt: skip
def convert_any(spark, d):
    """Every file to DOCX, and read again."""
    made = convert.convert(_files(spark, d).get("blocks", "cells", "metadata", "error"), "docx").filter("error IS NULL").select("doc_id", "content")
    return reader.open_table(made, "doc_id", "content").blocks.select("doc_id", "block_idx", "type", "text")


@query("convert_pdf", "SELECT p_partkey AS doc_id, p_name AS heading, p_type AS body, (CASE WHEN p_size % 4 = 0 THEN 1 ELSE p_size % 4 END)::INTEGER AS level FROM part")
def convert_pdf(spark, d):
    """Blocks to PDF and back: headings are told by their size, so a heading's level is 1 on a page with one."""
    p = parts(spark, d)

    def make(heads: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([convert.generate([{"type": "heading", "text": h, "level": 1}, {"type": "paragraph", "text": b}], "pdf") for h, b in zip(heads, bodies)])

    made = p.select("p_partkey", F.pandas_udf(make, "binary")("p_name", "p_type").alias("content"))
    b = reader.open_table(made, "p_partkey", "content").blocks.groupBy("doc_id").agg(F.max(F.when(F.col("type") == "heading", F.col("text"))).alias("heading"), F.max(F.when(F.col("type") == "paragraph", F.col("text"))).alias("body"))
    level = F.when(F.col("p_size") % 4 == 0, 1).otherwise(F.col("p_size") % 4)
    return b.join(read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), level.cast("int").alias("level")), "doc_id")


# --- PDF ------------------------------------------------------------------------------------------------


@query("pdf_password", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 4 < 3 THEN p_name END AS text, CASE WHEN p_partkey % 4 = 3 THEN 'wrong_password' END AS code FROM part")
def pdf_password(spark, d):
    """Files sealed by three algorithms and opened with the password, which every fourth has not."""

    def make(keys: pd.Series, texts: pd.Series) -> pd.Series:
        seal = lambda k: {"user": "pw" if k % 4 < 3 else "other", "owner": "o", "algorithm": ("rc4", "aes128", "aes256", "aes128")[k % 4]}
        return pd.Series([pdf.write([{"spans": [{"text": t, "x": 72, "y": 700, "font_size": 12}]}], {}, encrypt=seal(k)) for k, t in zip(keys, texts)])

    made = parts(spark, d).select("p_partkey", F.pandas_udf(make, "binary")("p_partkey", "p_name").alias("content"))
    return reader.open_table(made, "p_partkey", "content", "pdf", password="pw").get("text", "error").select("doc_id", "doc.text", F.col("doc.error.code").alias("code"))


@query("pdf_media_box", "SELECT s_suppkey AS doc_id, i::INTEGER AS page, CASE WHEN i = 2 THEN 300.0::DOUBLE ELSE 500.0::DOUBLE + s_nationkey END AS width, 700.0::DOUBLE AS height, CASE WHEN i = 2 THEN 0 ELSE 90 END AS rotation FROM supplier, generate_series(1, 3) AS g(i)")
def pdf_media_box(spark, d):
    """Pages that have their box and rotation from the node above, but for the second."""

    def make(nations: pd.Series) -> pd.Series:
        return pd.Series(
            [
                raw_pdf([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 3 /Kids [3 0 R 5 0 R] /Rotate 90 /MediaBox [0 0 %d 700] >>" % (500 + n), b"<< /Type /Pages /Parent 2 0 R /Kids [4 0 R 6 0 R] /Count 2 >>", b"<< /Type /Page /Parent 3 0 R >>", b"<< /Type /Page /Parent 2 0 R >>", b"<< /Type /Page /Parent 3 0 R /MediaBox [10 0 310 700] /Rotate 0 >>"])
                for n in nations
            ]
        )

    made = suppliers(spark, d).select("s_suppkey", F.pandas_udf(make, "binary")("s_nationkey").alias("content"))
    return reader.open_table(made, "s_suppkey", "content", "pdf").pages


@query("pdf_contents", "SELECT s_suppkey AS doc_id, s_name || ' n' || s_nationkey AS text FROM supplier")
def pdf_contents(spark, d):
    """A page of two streams, a text object going from one to the other."""
    make = F.pandas_udf(lambda names, nations: pd.Series([page(b"BT /F1 10 Tf 72 700 Td (%s) Tj" % n.encode(), b"( n%d) Tj ET" % k) for n, k in zip(names, nations)]), "binary")
    return reader.open_table(suppliers(spark, d).select("s_suppkey", make("s_name", "s_nationkey").alias("content")), "s_suppkey", "content", "pdf").texts


@query("pdf_lexer", "SELECT s_suppkey AS doc_id, 'a(b)c\\ ' || s_name || chr(10) || 'AB' || s_nationkey || '  tail' AS text FROM supplier")
def pdf_lexer(spark, d):
    """Strings with nested and escaped brackets, octal codes, hex with an odd digit, arrays, comments and names."""

    def make(names: pd.Series, nations: pd.Series) -> pd.Series:
        return pd.Series([page(b"q %% a comment (Tj)\nBT /F1 10 Tf 1 0 0 1 72 700 Tm (a(b)\\143\\\\\\040%s) Tj\n0 -20 Td [<4142> -10 (%d) 0 <2>] TJ 0 0 Td ET Q BT /F1 10 Tf 200 680 Td /X /Y (tail) Tj ET" % (n.encode(), k)) for n, k in zip(names, nations)])

    return reader.open_table(suppliers(spark, d).select("s_suppkey", F.pandas_udf(make, "binary")("s_name", "s_nationkey").alias("content")), "s_suppkey", "content", "pdf").texts


FONT = b"/F1 << /Type /Font /Subtype /Type1 /BaseFont /Mono /FirstChar 32 /Widths [" + b"500 " * 96 + b"] >>"


@query("pdf_spacing", """SELECT p_partkey AS doc_id, 0 AS span_idx, 'a b' AS text, 100.0::DOUBLE AS x, 15.0::DOUBLE * (p_size % 3 + 1) / 2 AS width FROM part
UNION ALL SELECT p_partkey, 1, 'c', 100.0::DOUBLE + (15 + 3 * 2 + p_size % 5) * (p_size % 3 + 1) / 2.0::DOUBLE, 5.0::DOUBLE * (p_size % 3 + 1) / 2 FROM part""")  # fmt: skip
def pdf_spacing(spark, d):
    """Characters 2 points apart, words p_size % 5 more, all scaled by half of p_size % 3 + 1."""
    make = F.pandas_udf(lambda sizes: pd.Series([page(b"BT /F1 10 Tf 2 Tc %d Tw %d Tz 100 700 Td (a b) Tj (c) Tj ET" % (s % 5, 50 * (s % 3 + 1)), fonts=FONT) for s in sizes]), "binary")
    made = parts(spark, d).select("p_partkey", make("p_size").alias("content"))
    return reader.open_table(made, "p_partkey", "content", "pdf").part("spans").select("doc_id", "span_idx", "text", "x", "width")


@query("pdf_fonts", "SELECT p_partkey AS doc_id, 'é' || p_name AS text, 300.0::DOUBLE / 1000 * 10 + strlen(p_name) * 5 AS width FROM part")
def pdf_fonts(spark, d):
    """The first code is a wide-eyed glyph by the font's map to Unicode; widths are those of the font."""
    to = b"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <00> <ff> endcodespacerange 1 beginbfchar <01> <00e9> endbfchar 1 beginbfrange <20> <7e> <0020> endbfrange endcmap"

    def make(names: pd.Series) -> pd.Series:
        out = []
        for n in names:
            body = b"BT /F1 10 Tf 72 700 Td (\\001%s) Tj ET" % n.encode()
            font = b"/F1 << /Type /Font /Subtype /TrueType /BaseFont /T /FirstChar 1 /Widths [300 " + b"500 " * 126 + b"] /ToUnicode 5 0 R >>"
            out.append(raw_pdf([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 1 /Kids [3 0 R] /MediaBox [0 0 600 800] >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << %s >> >> >>" % font, stream(body), stream(to)]))
        return pd.Series(out)

    made = parts(spark, d).select("p_partkey", F.pandas_udf(make, "binary")("p_name").alias("content"))
    return reader.open_table(made, "p_partkey", "content", "pdf").part("spans").select("doc_id", "text", "width")


@query("pdf_metadata", "SELECT p_partkey AS doc_id, f.field, CASE f.field WHEN 'title' THEN p_name WHEN 'subject' THEN p_type WHEN 'pdf_version' THEN '1.7' ELSE p_brand END AS value FROM part CROSS JOIN (VALUES ('title'), ('subject'), ('producer'), ('pdf_version')) AS f(field)")
def pdf_metadata(spark, d):
    make = F.pandas_udf(lambda a, b, c: pd.Series([pdf.write([{"spans": []}], {"title": x, "subject": y, "producer": z}) for x, y, z in zip(a, b, c)]), "binary")
    made = parts(spark, d).select("p_partkey", make("p_name", "p_type", "p_brand").alias("content"))
    return reader.open_table(made, "p_partkey", "content", "pdf").metadata


@query("pdf_bookmarks", "SELECT s_suppkey AS doc_id, o::INTEGER AS ord, CASE o WHEN 0 THEN s_name WHEN 1 THEN 'n' || s_nationkey ELSE 'end' END AS title, CASE WHEN o = 2 THEN 2 ELSE 1 END AS page, CASE WHEN o = 1 THEN 2 ELSE 1 END AS level FROM supplier, generate_series(0, 2) AS g(o)")
def pdf_bookmarks(spark, d):
    def make(names: pd.Series, nations: pd.Series) -> pd.Series:
        out = []
        for n, k in zip(names, nations):
            marks = [b"<< /First 6 0 R /Last 8 0 R >>", b"<< /Title (%s) /Parent 5 0 R /Next 8 0 R /First 7 0 R /Dest [3 0 R /Fit] >>" % n.encode(), b"<< /Title (n%d) /Parent 6 0 R /A << /S /GoTo /D [3 0 R /Fit] >> >>" % k, b"<< /Title (end) /Parent 5 0 R /Dest [4 0 R /Fit] >>"]
            out.append(raw_pdf([b"<< /Type /Catalog /Pages 2 0 R /Outlines 5 0 R >>", b"<< /Type /Pages /Count 2 /Kids [3 0 R 4 0 R] /MediaBox [0 0 600 800] >>", b"<< /Type /Page /Parent 2 0 R >>", b"<< /Type /Page /Parent 2 0 R >>", *marks]))
        return pd.Series(out)

    made = suppliers(spark, d).select("s_suppkey", F.pandas_udf(make, "binary")("s_name", "s_nationkey").alias("content"))
    return reader.open_table(made, "s_suppkey", "content", "pdf").bookmarks


@query("pdf_annotations", "SELECT s_suppkey AS doc_id, 1 AS page, i::INTEGER AS annot_idx, CASE WHEN i = 0 THEN 'link' ELSE 'text' END AS type, CASE WHEN i = 0 THEN 'http://x/' || s_nationkey END AS uri, CASE WHEN i = 1 THEN s_name END AS contents FROM supplier, generate_series(0, 1) AS g(i)")
def pdf_annotations(spark, d):
    def make(names: pd.Series, nations: pd.Series) -> pd.Series:
        notes = lambda n, k: b"[<< /Subtype /Link /Rect [0 0 9 9] /A << /S /URI /URI (http://x/%d) >> >> << /Subtype /Text /Rect [1 1 2 2] /Contents (%s) >>]" % (k, n.encode())
        return pd.Series([raw_pdf([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 1 /Kids [3 0 R] /MediaBox [0 0 600 800] >>", b"<< /Type /Page /Parent 2 0 R /Annots %s >>" % notes(n, k)]) for n, k in zip(names, nations)])

    made = suppliers(spark, d).select("s_suppkey", F.pandas_udf(make, "binary")("s_name", "s_nationkey").alias("content"))
    return reader.open_table(made, "s_suppkey", "content", "pdf").annotations.select("doc_id", "page", "annot_idx", "type", "uri", "contents")


@query("pdf_tables", "SELECT p_partkey AS doc_id, 1 AS page, r::INTEGER AS row, c::INTEGER AS col, CASE WHEN r = 0 THEN CASE c WHEN 0 THEN 'name' ELSE 'brand' END WHEN c = 0 THEN p_name ELSE p_brand END AS text FROM part, generate_series(0, 1) AS a(r), generate_series(0, 1) AS b(c)")
def pdf_tables(spark, d):
    """A ruled table of two rows and columns on a page."""

    def make(names: pd.Series, brands: pd.Series) -> pd.Series:
        rules = [(72, y, 472, y) for y in (625, 605, 585)] + [(x, 585, x, 625) for x in (72, 272, 472)]
        cells = lambda a, b: [{"text": t, "x": 80 + 200 * c, "y": 610 - 20 * r, "font_size": 10} for r, row in enumerate((("name", "brand"), (a, b))) for c, t in enumerate(row)]
        return pd.Series([pdf.write([{"spans": cells(a, b), "segments": rules}]) for a, b in zip(names, brands)])

    made = parts(spark, d).select("p_partkey", F.pandas_udf(make, "binary")("p_name", "p_brand").alias("content"))
    return reader.open_table(made, "p_partkey", "content", "pdf").cells.select("doc_id", "page", "row", "col", "text")


# --- Office and EPUB -------------------------------------------------------------------------------------


def _books(spark, d):
    """A DOCX file for each nation: a heading, a list, and a table of its suppliers."""

    def make(names: pd.Series, suppliers: pd.Series) -> pd.Series:
        blocks = lambda n, s: [{"type": "heading", "text": n, "level": 2}, *({"type": "list_item", "text": x["s_name"]} for x in s), {"type": "table", "text": "", "rows": [[str(x["s_suppkey"]), x["s_name"]] for x in s]}]
        return pd.Series([convert.docx_bytes(blocks(n, s), {"title": n}) for n, s in zip(names, suppliers)])

    s = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("s"))
    both = read(spark, d, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"))
    return reader.open_table(both.select("n_nationkey", F.pandas_udf(make, "binary")("n_name", "s").alias("content")), "n_nationkey", "content")


@query("docx_text", "SELECT n_nationkey AS doc_id, n_name || chr(10) || string_agg('• ' || s_name, chr(10) ORDER BY s_suppkey) || chr(10) || string_agg(s_suppkey || chr(10) || s_name, chr(10) ORDER BY s_suppkey) AS text FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def docx_text(spark, d):
    return _books(spark, d).texts


@query("docx_cells", "SELECT n_nationkey AS doc_id, (row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1)::INTEGER AS row, c::INTEGER AS col, CASE c WHEN 0 THEN s_suppkey::VARCHAR ELSE s_name END AS text FROM (SELECT * FROM nation JOIN supplier ON s_nationkey = n_nationkey) JOIN (VALUES (0)) AS z(c) ON true UNION ALL SELECT n_nationkey, (row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1)::INTEGER, 1, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def docx_cells(spark, d):
    return _books(spark, d).cells.select("doc_id", "row", "col", "text")


@query("docx_metadata", "SELECT n_nationkey AS doc_id, 'title' AS field, n_name AS value FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def docx_metadata(spark, d):
    return _books(spark, d).metadata


def _epubs(spark, d):
    """An EPUB for each region, a chapter for each nation."""

    def make(names: pd.Series, nations: pd.Series) -> pd.Series:
        return pd.Series([convert.epub_bytes([(x["n_name"], f"<h1>{x['n_name']}</h1>\n<p>key {x['n_nationkey']}</p>\n") for x in ns], {"title": n}) for n, ns in zip(names, nations)])

    n = read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    both = read(spark, d, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey"))
    return reader.open_table(both.select("r_regionkey", F.pandas_udf(make, "binary")("r_name", "n").alias("content")), "r_regionkey", "content")


@query("epub_text", "SELECT n_regionkey AS doc_id, string_agg('--- ' || n_name || ' ---' || chr(10) || n_name || chr(10) || n_name || chr(10) || chr(10) || 'key ' || n_nationkey, chr(10) || chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def epub_text(spark, d):
    return _epubs(spark, d).texts


@query("epub_toc", "SELECT n_regionkey AS doc_id, (row_number() OVER w - 1)::INTEGER AS ord, n_name AS title, (row_number() OVER w)::INTEGER AS page, 1 AS level FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)")
def epub_toc(spark, d):
    return _epubs(spark, d).bookmarks


@query("epub_blocks", "SELECT n_regionkey AS doc_id, (row_number() OVER w)::INTEGER AS page, b.type, CASE b.type WHEN 'heading' THEN n_name ELSE 'key ' || n_nationkey END AS text FROM nation CROSS JOIN (VALUES ('heading'), ('paragraph')) AS b(type) WINDOW w AS (PARTITION BY n_regionkey, b.type ORDER BY n_nationkey)")
def epub_blocks(spark, d):
    return _epubs(spark, d).blocks.select("doc_id", "page", "type", "text")


# --- files in folders, pipelines -------------------------------------------------------------------------


@query("glob_files", "SELECT 'n' || n_nationkey || '.md' AS name, 'markdown' AS format, '# ' || n_name || chr(10) AS text FROM nation WHERE n_nationkey % 2 = 0")
def glob_files(spark, d):
    """Files of two kinds in a folder, of which a glob names one."""
    folder = storage.new_folder(spark, "glob")
    put = F.pandas_udf(lambda paths, texts: pd.Series([storage.put(p, t.encode()) or 1 for p, t in zip(paths, texts)]), "int").asNondeterministic()
    ext = F.when(F.col("n_nationkey") % 2 == 0, "md").otherwise("txt")
    read(spark, d, "nation").select(put(F.concat(F.lit(f"{folder}/n"), F.col("n_nationkey"), F.lit("."), ext), F.concat(F.lit("# "), F.col("n_name"), F.lit("\n"))).alias("n")).agg(F.sum("n")).collect()
    found = reader.open_files(spark, f"{folder}/*.md").get("format", "text")
    return found.select(F.substring_index("doc_id", "/", -1).alias("name"), "doc.format", "doc.text")


def _runs(spark, d, builder):
    p = builder.build()
    pages = F.concat(F.lit("<html><h1>"), F.col("p_name"), F.lit("</h1><p>"), F.col("p_type"), F.lit("</p><table><tr><td>k</td><td>"), F.col("p_partkey"), F.lit("</td></tr></table></html>"))
    bad = F.when(F.col("p_partkey") % 10 == 9, "x").otherwise(pages)
    files = parts(spark, d).select(F.concat(F.lit("in/p"), F.col("p_partkey"), F.lit(".bin")).alias("path"), bad.cast("binary").alias("content"))
    return pipeline.run_table(files, p)


@query("pipeline_steps", """SELECT 'in/p' || p_partkey || '.bin' AS path, CASE WHEN p_partkey % 10 = 9 THEN 'failed' ELSE 'success' END AS status, CASE WHEN p_partkey % 10 = 9 THEN 0 END AS step,
  CASE WHEN p_partkey % 10 < 9 THEN '# ' || p_name || chr(10) || chr(10) || p_type || chr(10) || chr(10) || '| k   | ' || rpad(p_partkey::VARCHAR, greatest(3, strlen(p_partkey::VARCHAR))::INTEGER, ' ') || ' |' || chr(10) || '| --- | ' || repeat('-', greatest(3, strlen(p_partkey::VARCHAR))::INTEGER) || ' |' || chr(10) END AS markdown FROM part""")  # fmt: skip
def pipeline_steps(spark, d):
    builder = pipeline.Builder("b", "in").on_error("collect_errors").extract_text().extract_tables().extract_structure().convert("docx").to_markdown()
    return _runs(spark, d, builder).select("path", "status", "step", "markdown")


@query("pipeline_skip", "SELECT CASE WHEN p_partkey % 10 = 9 THEN 'skipped' ELSE 'success' END AS status, count(*) AS n FROM part GROUP BY 1")
def pipeline_skip(spark, d):
    return _runs(spark, d, pipeline.Builder("b", "in").on_error("skip").extract_text()).groupBy("status").agg(F.count("*").alias("n"))


@query("pipeline_pdf_only", "SELECT 'in/p' || p_partkey || '.bin' AS path, CASE WHEN p_partkey % 10 = 9 THEN 0 ELSE 1 END AS step FROM part")
def pipeline_pdf_only(spark, d):
    """Redaction is for PDF files: every page fails there, and what can't be read fails before."""
    return _runs(spark, d, pipeline.Builder("b", "in").on_error("collect_errors").extract_text().redact("x")).filter("status = 'failed'").select("path", "step")


@query("pipeline_progress", "SELECT 'in/p' || p_partkey || '.bin' AS path, s::INTEGER AS step FROM part, generate_series(0, 2) AS g(s) WHERE p_partkey % 10 < 9 OR s = 0")
def pipeline_progress(spark, d):
    return pipeline.progress(_runs(spark, d, pipeline.Builder("b", "in").on_error("collect_errors").extract_text().to_markdown().extract_tables()), 3)


@query("pipeline_save", "SELECT 'p' || p_partkey || '.txt' AS name, p_name || chr(10) || chr(10) || p_type AS text FROM part WHERE p_partkey % 10 < 9")
def pipeline_save(spark, d):
    folder = storage.new_folder(spark, "saved")
    done = _runs(spark, d, pipeline.Builder("b", "in").on_error("collect_errors").extract_text().save(f"{folder}/{{stem}}.txt"))
    pipeline.write(done)
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.col("content").cast("string").alias("text"))


@query("pipeline_definitions", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'unknown step: no' WHEN 1 THEN 'convert needs format' WHEN 2 THEN 'there are no steps' WHEN 3 THEN 'input is empty' END AS error,
  CASE WHEN p_partkey % 5 = 4 THEN '{"name": "' || p_name || '", "input": "in/*", "steps": [{"type": "to_markdown"}, {"type": "save", "path": "' || p_size || '"}], "parallel": false, "on_error": "skip"}' END AS written FROM part""")  # fmt: skip
def pipeline_definitions(spark, d):
    """Definitions read, checked and written again."""

    def check(keys: pd.Series, names: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        rows = []
        for k, n, s in zip(keys, names, sizes):
            steps = [[{"type": "no"}], [{"type": "convert"}], [], [{"type": "to_markdown"}], [{"type": "to_markdown"}, {"type": "save", "path": str(s)}]][k % 5]
            try:
                p = pipeline.Pipeline.parse(json.dumps({"name": n, "input": "" if k % 5 == 3 else "in/*", "steps": steps, "on_error": "skip"}))
                rows.append((None, pipeline.Pipeline.parse(p.to_json()).to_json()))
            except pipeline.PipelineError as e:
                rows.append((str(e), None))
        return pd.DataFrame(rows, columns=["error", "written"])

    found = F.pandas_udf(check, "error string, written string")("p_partkey", "p_name", "p_size")
    return parts(spark, d).select("p_partkey", found.alias("f")).select("p_partkey", "f.*")


@query("pipeline_builder", "SELECT o_custkey, string_agg(CASE o_orderkey % 3 WHEN 0 THEN 'extract_text' WHEN 1 THEN 'to_markdown' ELSE 'optimize' END, ',' ORDER BY o_orderkey) AS steps FROM orders GROUP BY o_custkey")
def pipeline_builder(spark, d):
    """Pipelines built by methods, a step for each order."""

    def make(found: pd.Series) -> pd.Series:
        out = []
        for keys in found:
            b = pipeline.Builder("b", "in").parallel()
            for k in keys:
                b = getattr(b, ("extract_text", "to_markdown", "optimize")[k % 3])()
            out.append(",".join(s.type for s in b.build().steps))
        return pd.Series(out)

    keys = read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    return keys.select("o_custkey", F.pandas_udf(make, "string")("k").alias("steps"))


# --- page sets and edits of PDF files ---------------------------------------------------------------------


def _pdfs(spark, d):
    """A PDF file for each supplier, of s_suppkey % 3 + 1 pages that say which they are."""

    def make(keys: pd.Series, names: pd.Series) -> pd.Series:
        page_ = lambda n, i: {"width": 600, "height": 800, "spans": [{"text": f"{n} p{i}", "x": 72, "y": 700, "font_size": 12}, {"text": "secret", "x": 72, "y": 600, "font_size": 12}]}
        return pd.Series([pdf.write([page_(n, i) for i in range(1, k % 3 + 2)], {"title": n}) for k, n in zip(keys, names)])

    return suppliers(spark, d).select(F.col("s_suppkey").alias("doc_id"), "s_nationkey", F.pandas_udf(make, "binary")("s_suppkey", "s_name").alias("content"))


PAGES = "pages AS (SELECT s_suppkey AS doc_id, s_nationkey, s_name, i::INTEGER AS page, s_name || ' p' || i || chr(10) || 'secret' AS text FROM supplier, generate_series(1, s_suppkey % 3 + 1) AS g(i))"


def _texts(files, key="doc_id"):
    return reader.open_table(files, key, "content", "pdf").texts


@query("pdf_merge_files", f"WITH {PAGES} SELECT s_nationkey AS doc_id, string_agg(text, chr(10) ORDER BY doc_id, page) AS text FROM pages GROUP BY s_nationkey")
def pdf_merge_files(spark, d):
    return _texts(pdfsets.merged(_pdfs(spark, d), "s_nationkey", "doc_id"), "s_nationkey")


@query("pdf_split_files", f"WITH {PAGES} SELECT doc_id, 0 AS part, text FROM pages WHERE page = 1 UNION ALL SELECT doc_id, 1, string_agg(text, chr(10) ORDER BY page DESC) FROM pages GROUP BY doc_id")
def pdf_split_files(spark, d):
    """The first page of each file, and all its pages backwards."""
    n = (F.col("doc_id") % 3 + 1).cast("int")
    ranges = F.array(F.array(F.lit(1)), F.sequence(n, F.lit(1), F.lit(-1)))
    back = F.when(n == 1, F.array(F.array(F.lit(1)), F.array(F.lit(1)))).otherwise(ranges)
    parts = pdfsets.split(_pdfs(spark, d).withColumn("ranges", back), "ranges").withColumn("doc_id", F.struct("doc_id", "part"))
    return _texts(parts).select("doc_id.doc_id", "doc_id.part", "text")


@query("pdf_blank_pages", "SELECT s_suppkey AS doc_id, i::INTEGER AS page, CASE WHEN i = 2 THEN 100.0::DOUBLE ELSE 600.0::DOUBLE END AS width, CASE WHEN i = 2 THEN 0 ELSE 270 END AS rotation FROM supplier, generate_series(1, s_suppkey % 3 + 2) AS g(i)")
def pdf_blank_pages(spark, d):
    """Pages turned by a quarter to the left, then a blank one after the first."""
    turned = pdfsets.edited(_pdfs(spark, d), pdfedit.rotate, degrees=-90)
    made = pdfsets.edited(turned.drop("error"), pdfedit.insert_blank, after=[1], size=(100.0, 50.0))
    return reader.open_table(made, "doc_id", "content", "pdf").pages.select("doc_id", "page", "width", "rotation")


@query("pdf_watermarks", f"WITH {PAGES} SELECT doc_id, page, 'n' || s_nationkey AS text, 50.0::DOUBLE AS x, 50.0::DOUBLE AS y FROM pages")
def pdf_watermarks(spark, d):
    made = pdfsets.edited(_pdfs(spark, d), pdfedit.watermark, text=F.concat(F.lit("n"), F.col("s_nationkey")), size=20, angle=0, position="bottom_left")
    return reader.open_table(made, "doc_id", "content", "pdf").part("spans").filter("span_idx = 2").select("doc_id", "page", "text", "x", "y")


@query("pdf_redacted", "SELECT s_suppkey AS doc_id, string_agg(s_name || ' p' || i, chr(10) ORDER BY i) AS text FROM supplier, generate_series(1, s_suppkey % 3 + 1) AS g(i) GROUP BY s_suppkey")
def pdf_redacted(spark, d):
    return _texts(pdfsets.edited(_pdfs(spark, d), pdfedit.redact, pattern="SECRET"))


@query("pdf_bookmarks_set", f"WITH {PAGES} SELECT doc_id, page - 1 AS ord, 'to ' || page AS title, page, page AS level FROM pages")
def pdf_bookmarks_set(spark, d):
    n = F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")), lambda i: F.struct(F.concat(F.lit("to "), i).alias("title"), i.alias("page"), i.alias("level")))
    made = pdfsets.edited(_pdfs(spark, d), pdfedit.set_bookmarks, items=n)
    return reader.open_table(made, "doc_id", "content", "pdf").bookmarks


@query("pdf_metadata_set", "SELECT s_suppkey AS doc_id, f.field, CASE f.field WHEN 'title' THEN s_name WHEN 'author' THEN 'n' || s_nationkey ELSE '1.7' END AS value FROM supplier CROSS JOIN (VALUES ('title'), ('author'), ('pdf_version')) AS f(field)")
def pdf_metadata_set(spark, d):
    made = pdfsets.edited(_pdfs(spark, d), pdfedit.set_metadata, updates=F.struct(F.concat(F.lit("n"), F.col("s_nationkey")).alias("author")))
    return reader.open_table(made, "doc_id", "content", "pdf").metadata


def _acting(spark, d):
    """A PDF file for each part, that runs scripts if p_size is even, has a link if it is a multiple of 3, and metadata if of 5."""

    def make(sizes: pd.Series) -> pd.Series:
        out = []
        for s in sizes:
            root = b"<< /Type /Catalog /Pages 2 0 R %s %s >>" % (b"/OpenAction << /S /JavaScript /JS (x) >>" if s % 2 == 0 else b"", b"/Metadata 5 0 R" if s % 5 == 0 else b"")
            link = b"/Annots [<< /Subtype /Link /Rect [0 0 1 1] /A << /S /URI /URI (http://x) >> >>]" if s % 3 == 0 else b""
            out.append(raw_pdf([root, b"<< /Type /Pages /Count 1 /Kids [3 0 R] /MediaBox [0 0 9 9] >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R %s >>" % link, stream(b"BT ET"), stream(b"<x><part>2</part></x>")]))
        return pd.Series(out)

    return parts(spark, d).select(F.col("p_partkey").alias("doc_id"), F.pandas_udf(make, "binary")("p_size").alias("content"))


@query("pdf_sanitized", "SELECT p_partkey AS doc_id, 0::BIGINT AS scripts, 0::BIGINT AS links FROM part")
def pdf_sanitized(spark, d):
    """What is left of scripts and links: nothing."""
    made = pdfsets.edited(_acting(spark, d), pdfedit.sanitize)
    scripts = pdfsets.issues(made).filter("rule LIKE 'javascript%'").groupBy("doc_id").agg(F.count("*").alias("scripts"))
    links = reader.open_table(made, "doc_id", "content", "pdf").links.groupBy("doc_id").agg(F.count("*").alias("links"))
    return made.select("doc_id").join(scripts, "doc_id", "left").join(links, "doc_id", "left").na.fill(0)


@query("pdf_archive_issues", """WITH r AS (SELECT p_partkey AS doc_id, unnest([CASE WHEN p_size % 2 = 0 THEN 'javascript.open_action' END, CASE WHEN p_size % 5 = 0 THEN 'xmp.part_mismatch' ELSE 'xmp.missing' END, CASE WHEN p_size % 5 = 0 THEN 'xmp.no_pdfaid_conformance' END, 'output_intent.missing']) AS rule FROM part)
SELECT doc_id, rule, CASE WHEN rule IN ('javascript.open_action', 'xmp.missing') THEN 'error' ELSE 'warning' END AS severity FROM r WHERE rule IS NOT NULL""")  # fmt: skip
def pdf_archive_issues(spark, d):
    return pdfsets.issues(_acting(spark, d), "pdf_a", "1b").select("doc_id", "rule", "severity")


@query("pdf_access_issues", """WITH r AS (SELECT p_partkey AS doc_id, unnest(['ua.mark_info.missing', 'ua.lang.missing', 'ua.display_doc_title', 'ua.struct_tree.missing', 'ua.tab_order', 'ua.tagged_content', CASE WHEN p_size % 3 = 0 THEN 'ua.annotation.no_alt' END]) AS rule FROM part)
SELECT doc_id, rule, CASE WHEN rule IN ('ua.tab_order', 'ua.tagged_content', 'ua.annotation.no_alt') THEN 1 END AS page FROM r WHERE rule IS NOT NULL""")  # fmt: skip
def pdf_access_issues(spark, d):
    return pdfsets.issues(_acting(spark, d), "pdf_ua").select("doc_id", "rule", "page")


@query("pdf_archived", "SELECT p_partkey AS doc_id, 0::BIGINT AS errors FROM part")
def pdf_archived(spark, d):
    """Errors that are left after conversion to an archive file."""
    made = pdfsets.edited(_acting(spark, d), pdffacts.to_pdf_a, level="1b")
    left = pdfsets.issues(made).filter("severity = 'error'").groupBy("doc_id").agg(F.count("*").alias("errors"))
    return made.select("doc_id").join(left, "doc_id", "left").na.fill(0)


@query("pdf_forms_filled", "SELECT p_partkey AS doc_id, f.t, CASE WHEN f.t = 'name' THEN p_name WHEN f.t = 'locked' THEN 'old' END AS value FROM part CROSS JOIN (VALUES ('top'), ('name'), ('locked')) AS f(t)")
def pdf_forms_filled(spark, d):
    def make(keys: pd.Series) -> pd.Series:
        objects = [b"<< /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [4 0 R] >> >>", b"<< /Type /Pages /Count 1 /Kids [3 0 R] /MediaBox [0 0 9 9] >>", b"<< /Type /Page /Parent 2 0 R >>", b"<< /T (top) /Kids [5 0 R 6 0 R] >>", b"<< /T (name) /FT /Tx /Parent 4 0 R >>", b"<< /T (locked) /FT /Tx /Ff 1 /V (old) /Parent 4 0 R >>"]
        return pd.Series([raw_pdf(objects)] * len(keys))

    p = parts(spark, d).select(F.col("p_partkey").alias("doc_id"), "p_name", F.pandas_udf(make, "binary")("p_partkey").alias("content"))
    made = pdfsets.edited(p, pdfedit.fill_form, values=F.struct(F.col("p_name").alias("top.name"), F.lit("no").alias("top.locked")))
    return reader.open_table(made, "doc_id", "content", "pdf").part("fields").select("doc_id", "t", "value")


@query("pdf_signatures", "SELECT s_suppkey AS doc_id, s_name AS name, s_suppkey % 2 = 0 AS integrity_ok, true AS covers_whole_file, 'CN=signer' AS subject, s_suppkey AS serial, true AS self_signed, s_suppkey % 3 > 0 AS date_valid FROM supplier")
def pdf_signatures(spark, d):
    """Signed files, every second of which was changed afterwards; every third certificate isn't valid yet."""

    def make(found: pd.DataFrame) -> pd.Series:
        out = []
        for k, n, c in zip(found["doc_id"], found["name"], found["content"]):
            made = sign.sign(bytes(c), *sign.identity("signer", begins=-3600 if k % 3 else 864_000, serial=int(k)), name=n)
            out.append(made if k % 2 == 0 else made.replace(b"/Count", b"/Cuont"))
        return pd.Series(out)

    names = read(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("name"))
    files = storage.spread(_pdfs(spark, d).join(names, "doc_id"), "doc_id").select("doc_id", F.pandas_udf(make, "binary")(F.struct("doc_id", "name", "content")).alias("content"))
    found = security.certificate_status(pdfsets.signatures(files).drop("self_signed")).select("doc_id", "name", "integrity_ok", "covers_whole_file", "subject", "serial", "self_signed", "date_valid")
    return found


@query("pdf_rendered", "SELECT s_suppkey AS doc_id, i::INTEGER AS page, 1250 AS width, 1667 AS height, true AS is_png FROM supplier, generate_series(1, s_suppkey % 3 + 1) AS g(i)")
def pdf_rendered(spark, d):
    """Pages as pictures at 150 dots an inch."""
    out = render.rendered(_pdfs(spark, d))
    return out.select("doc_id", "page", "width", "height", (F.substring("png", 2, 3).cast("string") == "PNG").alias("is_png"))


@query("pdf_visual_diff", "SELECT s_suppkey AS doc_id, i::INTEGER AS page, i = 1 AS changed, 480000 AS total FROM supplier, generate_series(1, s_suppkey % 3 + 1) AS g(i)")
def pdf_visual_diff(spark, d):
    """Files against the same with a mark on the first page."""
    files = _pdfs(spark, d)
    marked = pdfsets.edited(files, pdfedit.watermark, text="X", on=[1])
    return render.compared(files, marked).select("doc_id", "page", (F.col("changed") > 0).alias("changed"), "total")
