"""Queries on the parts of documents: workbooks, slides, images, forms, signatures, names, and small functions.

Where the tables hold no such parts, rows of orders, parts and line items stand for them by a fixed rule.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import geometry, names, text as T
from quire.operators import compare, convert, forms, markdown, metrics, mutate, pageset, render, search, security, structure, tables, validate
from quire.operators.lines import PAGE, joined, lines_of
from quire import pipeline, storage
from quire.plans import mapped
from quire.sources import htmltree, office, pdf, reader

QUERIES = []


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES.append((name, fn, sql))
        return fn

    return add


def read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


# --- workbooks and slides ---------------------------------------------------


def _cells(spark, d):
    """Nations as a workbook: a sheet for each region, three cells a row."""
    n = read(spark, d, "nation")
    cells = F.array(F.col("n_nationkey").cast("string"), F.col("n_name"), F.col("n_regionkey").cast("string"))
    return n.select(F.concat(F.lit("R"), F.col("n_regionkey")).alias("sheet"), F.col("n_nationkey").alias("row"), F.posexplode(cells).alias("col", "text"))


def _workbook(spark, d):
    """The same as an XLSX file, read again."""

    def make(found: pd.Series) -> pd.Series:
        out = []
        for rows in found:
            sheets: dict[str, list] = {}
            for r in rows:
                sheets.setdefault(f"R{r['n_regionkey']}", []).append([str(r["n_nationkey"]), r["n_name"], str(r["n_regionkey"])])
            out.append(convert.xlsx_bytes(list(sheets.items()), {}))
        return pd.Series(out)

    rows = F.array_sort(F.collect_list(F.struct("n_regionkey", "n_nationkey", "n_name")))
    one = read(spark, d, "nation").agg(rows.alias("r")).select(F.lit(1).alias("id"), F.pandas_udf(make, "binary")("r").alias("content"))
    return reader.open_table(one, "id", "content", "xlsx")


@query("xlsx_text", r"SELECT string_agg(t, chr(10) ORDER BY s) AS text FROM (SELECT 'R' || n_regionkey AS s, '=== Sheet: R' || n_regionkey || ' ===' || chr(10) || string_agg(n_nationkey || chr(9) || n_name || chr(9) || n_regionkey || chr(10), '' ORDER BY n_nationkey) AS t FROM nation GROUP BY n_regionkey)")
def xlsx_text(spark, d):
    return _workbook(spark, d).texts.select("text")


@query("xlsx_lines", "SELECT 'R' || n_regionkey AS sheet, (dense_rank() OVER (ORDER BY n_regionkey) - 1) * 10000 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS y, n_nationkey || chr(9) || n_name || chr(9) || n_regionkey AS text FROM nation")
def xlsx_lines(spark, d):
    book = _workbook(spark, d).stored()
    rows = book.cells.groupBy("doc_id", "page", "row").agg(joined(F.col("text"), ["col"], "\t").alias("text"))
    names_ = book.blocks.filter("type = 'heading'").select("doc_id", "page", F.col("text").alias("sheet"))
    return rows.join(names_, ["doc_id", "page"]).select("sheet", ((F.col("page") - 1) * 10000 + F.col("row")).cast("bigint").alias("y"), "text")


@query("xlsx_structure", "SELECT (row_number() OVER (ORDER BY n_regionkey))::INTEGER AS page, 'R' || n_regionkey AS text, 'heading' AS type, 1 AS level FROM nation GROUP BY n_regionkey UNION ALL SELECT (row_number() OVER (ORDER BY n_regionkey))::INTEGER, '', 'table', NULL FROM nation GROUP BY n_regionkey")
def xlsx_structure(spark, d):
    return _workbook(spark, d).blocks.select("page", "text", "type", "level")


@query("xlsx_cell", "SELECT o_orderkey, CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE v::VARCHAR END AS text FROM (SELECT o_orderkey, (o_orderkey % 8) / 4.0::DOUBLE AS v FROM orders)")
def xlsx_cell(spark, d):
    shown = F.pandas_udf(lambda raw: raw.map(lambda x: office.cell_text(None, x, [])), "string")
    return read(spark, d, "orders").select("o_orderkey", shown((F.col("o_orderkey") % 8 / 4.0).cast("string")).alias("text"))


@query("sheet_names", "SELECT DISTINCT 'R' || n_regionkey AS sheet FROM nation")
def sheet_names(spark, d):
    return _workbook(spark, d).blocks.filter("type = 'heading'").select(F.col("text").alias("sheet"))


@query("table_rows", "SELECT n_regionkey AS t, count(*) AS rows, 3 AS cols, max(n_name) FILTER (WHERE rn = 1) AS cell FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation) GROUP BY n_regionkey")
def table_rows(spark, d):
    c = _cells(spark, d).withColumn("t", F.substring("sheet", 2, 9).cast("int"))
    rows = tables.to_rows(c, ["t"])
    return rows.groupBy("t").agg(F.count("*").alias("rows"), F.max(F.size("cells")).alias("cols"), F.min_by(F.col("cells")[1], "row").alias("cell"))


@query("pptx_text", """WITH s AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS slide, o_orderpriority AS title, o_orderstatus AS body, CASE WHEN o_orderkey % 3 = 0 THEN 'n' || o_orderkey END AS notes FROM orders)
SELECT doc_id, string_agg('--- Slide ' || slide || ' ---' || chr(10) || title || chr(10) || body || chr(10) || CASE WHEN notes IS NULL THEN '' ELSE chr(10) || 'Notes:' || chr(10) || notes || chr(10) END, chr(10) || chr(10) ORDER BY slide) AS text FROM s GROUP BY doc_id""")  # fmt: skip
def pptx_text(spark, d):
    return _decks(spark, d).texts


def _decks(spark, d):
    """A deck for each customer, a slide for each order; every third order has notes."""

    def make(found: pd.Series) -> pd.Series:
        out = []
        for slides in found:
            notes = [(f"ppt/notesSlides/notesSlide{i}.xml", f'<p:notes xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>n{s["o"]}</a:t></a:r></a:p></p:notes>') for i, s in enumerate(slides, 1) if s["o"] % 3 == 0]
            out.append(convert.pptx_bytes([(s["title"], [s["body"]]) for s in slides], {}, notes))
        return pd.Series(out)

    each = F.struct(F.col("o_orderkey").alias("o"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("body"))
    decks = storage.spread(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"), "o_custkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list(each)).alias("s")).select("o_custkey", F.pandas_udf(make, "binary")("s").alias("content"))
    return reader.open_table(decks, "o_custkey", "content", "pptx")


@query("pptx_structure", "SELECT o_custkey AS doc_id, (row_number() OVER w)::INTEGER AS page, x.type, x.level, CASE WHEN x.type = 'heading' THEN o_orderpriority ELSE o_orderstatus END AS text FROM orders CROSS JOIN (VALUES ('heading', 1), ('paragraph', NULL)) AS x(type, level) WINDOW w AS (PARTITION BY o_custkey, x.type ORDER BY o_orderkey)")
def pptx_structure(spark, d):
    return _decks(spark, d).blocks.select("doc_id", "page", "type", "level", "text")


@query("pptx_markdown", """WITH s AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS slide, o_orderpriority AS title, o_orderstatus AS body, CASE WHEN o_orderkey % 3 = 0 THEN 'n' || o_orderkey END AS notes FROM orders)
SELECT doc_id, string_agg('## Slide ' || slide || ': ' || title || chr(10) || chr(10) || body || CASE WHEN notes IS NULL THEN '' ELSE chr(10) || chr(10) || '> **Notes:** ' || notes END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY slide) || chr(10) AS markdown FROM s GROUP BY doc_id""")  # fmt: skip
def pptx_markdown(spark, d):
    return _decks(spark, d).markdown()


@query("heading_style", "SELECT p_partkey, CASE WHEN regexp_matches(s, '^heading[1-9]$') THEN right(s, 1)::INTEGER END AS level FROM (SELECT p_partkey, lower(replace('Heading ' || (p_size % 12), ' ', '')) AS s FROM part)")
def heading_style(spark, d):
    level = F.pandas_udf(lambda style: pd.Series([office.heading_style(x) for x in style], dtype="Int32"), "int")
    return read(spark, d, "part").select("p_partkey", level(F.concat(F.lit("Heading "), F.col("p_size") % 12)).alias("level"))


# --- HTML parts ---------------------------------------------------------------


@query("html_metadata", "SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 0 THEN 'author' ELSE 'keywords' END AS field, p_name AS value FROM part")
def html_metadata(spark, d):
    p = read(spark, d, "part")
    name = F.when(F.col("p_size") % 2 == 0, "Author").otherwise("keywords")
    html = F.concat(F.lit('<html><meta name="'), name, F.lit('" content=" '), F.col("p_name"), F.lit(' "><p>x</html>'))
    return reader.open_table(p.withColumn("html", html), "p_partkey", "html", "html").metadata


@query("html_images", "SELECT p_partkey AS doc_id, p_size AS width, CASE WHEN p_size % 2 = 0 THEN 'RGB' END AS color_space, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS data FROM part")
def html_images(spark, d):
    p = read(spark, d, "part")
    src = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("p_name").cast("binary")))).otherwise("far.png")
    html = F.concat(F.lit('<p><img width="'), F.col("p_size"), F.lit('" src="'), src, F.lit('">'))
    out = reader.open_table(p.withColumn("html", html), "p_partkey", "html", "html").images
    return out.select("doc_id", "width", "color_space", F.col("data").cast("string").alias("data"))


@query("html_tables", "SELECT p_partkey AS doc_id, r.row, r.col, CASE r.k WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE p_type END AS text, CASE r.k WHEN 0 THEN 2 ELSE 1 END AS col_span FROM part CROSS JOIN (VALUES (0, 0, 0), (1, 0, 1), (1, 1, 2)) AS r(row, col, k)")
def html_tables(spark, d):
    p = read(spark, d, "part")
    html = F.concat(F.lit("<table><tr><th colspan=2>"), F.col("p_name"), F.lit("<tr><td>"), F.col("p_brand"), F.lit("<td>"), F.col("p_type"), F.lit("</table>"))
    return reader.open_table(p.withColumn("html", html), "p_partkey", "html", "html").part("cells").select("doc_id", "row", "col", "text", "col_span")


@query("data_uri", "SELECT p_partkey, p_name AS data FROM part")
def data_uri(spark, d):
    uri = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.col("p_name").cast("binary")))
    decoded = F.pandas_udf(lambda src: src.map(lambda x: htmltree.data_uri(x)[1].decode()), "string")
    return read(spark, d, "part").select("p_partkey", decoded(uri).alias("data"))


# --- geometry -----------------------------------------------------------------


@query("page_info", "SELECT s_suppkey AS doc_id, i::INTEGER AS page, 600.0::DOUBLE + s_nationkey AS width, 800.0::DOUBLE + i AS height, 0 AS rotation FROM supplier, generate_series(1, s_suppkey % 3 + 1) AS g(i)")
def page_info(spark, d):
    make = F.pandas_udf(lambda keys, nations: pd.Series([pdf.write([{"width": 600 + n, "height": 800 + i} for i in range(1, k % 3 + 2)]) for k, n in zip(keys, nations)]), "binary")
    made = storage.spread(read(spark, d, "supplier"), "s_suppkey").select("s_suppkey", make("s_suppkey", "s_nationkey").alias("content"))
    return reader.open_table(made, "s_suppkey", "content", "pdf").pages


@query("rectangle_segments", f"WITH {mapped.RECTS} SELECT doc_id, page, x AS ax, y AS ay, x + w AS bx, y AS by FROM rects UNION ALL SELECT doc_id, page, x + w, y, x + w, y + h FROM rects UNION ALL SELECT doc_id, page, x + w, y + h, x, y + h FROM rects UNION ALL SELECT doc_id, page, x, y + h, x, y FROM rects")
def rectangle_segments(spark, d):
    return tables.rectangle_segments(mapped.rects(spark, d))


@query("dominant_size", f"WITH {mapped.SPANS} SELECT doc_id, page, line_idx, size, first_x FROM (SELECT doc_id, page, line_idx, font_size AS size, first_value(x) OVER (PARTITION BY doc_id, page, line_idx ORDER BY span_idx) AS first_x, row_number() OVER (PARTITION BY doc_id, page, line_idx ORDER BY strlen(text) DESC, span_idx DESC) AS rn FROM spans) WHERE rn = 1")
def dominant_size(spark, d):
    return lines_of(mapped.spans(spark, d)).select(*PAGE, "line_idx", "size", "first_x")


HIT = "r.doc_id = s.doc_id AND r.page = s.page AND s.x < r.x + r.w AND r.x < s.x + s.width AND s.y < r.y + r.h AND r.y < s.y + s.font_size"


def _regions(spark, d):
    spans = mapped.spans(spark, d).withColumns({"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x") + F.col("width"), "y1": F.col("y") + F.col("font_size")})
    r = mapped.rects(spark, d).select(*PAGE, F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    return spans, r


@query("redact_overlap", f"WITH {mapped.SPANS}, {mapped.RECTS} SELECT doc_id, page, line_idx, span_idx, text FROM spans s WHERE EXISTS (SELECT 1 FROM rects r WHERE {HIT})")
def redact_overlap(spark, d):
    return security.redact_regions(*_regions(spark, d))[1].select(*PAGE, "line_idx", "span_idx", "text")


@query("redact_survivors", f"WITH {mapped.SPANS}, {mapped.RECTS} SELECT doc_id, page, count(*) AS n FROM spans s WHERE NOT EXISTS (SELECT 1 FROM rects r WHERE {HIT}) GROUP BY doc_id, page")
def redact_survivors(spark, d):
    return security.redact_regions(*_regions(spark, d))[0].groupBy(*PAGE).agg(F.count("*").alias("n"))


@query("redact_spans", f"WITH {mapped.SPANS}, b AS (SELECT *, y - font_size * 0.3::DOUBLE AS lo, y + font_size * 0.8::DOUBLE AS hi FROM spans) SELECT doc_id, page, line_idx, span_idx, text FROM b s WHERE EXISTS (SELECT 1 FROM b r WHERE contains(r.text, '77') AND r.doc_id = s.doc_id AND r.page = s.page AND s.x < r.x + r.width AND r.x < s.x + s.width AND s.lo < r.hi AND r.lo < s.hi)")
def redact_spans(spark, d):
    return security.redact_text(mapped.spans(spark, d), "77")[1].select(*PAGE, "line_idx", "span_idx", "text")


@query("interleave_tables", f"""WITH {mapped.LINES}, {mapped.RECTS}, u AS (SELECT doc_id, page, 'paragraph' AS type, y1, 0 AS o, line_idx AS i FROM lines UNION ALL SELECT doc_id, page, 'table', y + h, 1, (x * 10 + y)::INTEGER FROM rects)
SELECT doc_id, page, type, row_number() OVER (PARTITION BY doc_id, page ORDER BY y1 DESC, o, i) - 1 AS block_idx, y1 FROM u""")  # fmt: skip
def interleave_tables(spark, d):
    b = mapped.lines(spark, d).select(*PAGE, F.col("line_idx").alias("block_idx"), F.lit("paragraph").alias("type"), "text", F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("indent_level"), *geometry.BOX)
    r = mapped.rects(spark, d).select(*PAGE, (F.col("x") * 10 + F.col("y")).cast("int").alias("table_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    return structure.interleave(b, r).select(*PAGE, "type", F.col("block_idx").cast("bigint").alias("block_idx"), "y1")


@query("matrix_multiply", "SELECT o_orderkey, s * 2.0::DOUBLE AS a, 0.0::DOUBLE AS b, s * 10 + 5 AS e FROM (SELECT o_orderkey, (o_orderkey % 7)::DOUBLE AS s FROM orders)")
def matrix_multiply(spark, d):
    s, zero = (F.col("o_orderkey") % 7).cast("double"), F.lit(0.0)
    m = geometry.multiply([F.lit(2.0), zero, zero, F.lit(2.0), F.lit(10.0), F.lit(3.0)], [s, zero, zero, s, F.lit(5.0), zero])
    return read(spark, d, "orders").select("o_orderkey", m[0].alias("a"), m[1].alias("b"), m[4].alias("e"))


@query("render_size", "SELECT p_partkey, round((600.0::DOUBLE + p_size) * 150 / 72)::INTEGER AS w, round(800.0::DOUBLE * 150 / 72)::INTEGER AS h, round((600.0::DOUBLE + p_size) * least(300 / (600.0::DOUBLE + p_size), 300 / 800.0::DOUBLE))::INTEGER AS fw FROM part")
def render_size(spark, d):
    width, height = F.lit(600.0) + F.col("p_size"), F.lit(800.0)
    w, h = render.image_size(width, height)
    return read(spark, d, "part").select("p_partkey", w.alias("w"), h.alias("h"), render.image_size(width, height, to_width=300, to_height=300)[0].alias("fw"))


# --- annotations, forms, signatures, objects -----------------------------------


@query("annotation_filter", "SELECT l_orderkey AS doc_id, l_linenumber AS annot_idx, l_returnflag AS type FROM lineitem WHERE NOT (lower(l_returnflag) = 'a' AND l_linenumber IN (1, 2))")
def annotation_filter(spark, d):
    a = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("annot_idx"), F.col("l_returnflag").alias("type"))
    return mutate.remove_annotations(a, ["A"], [1, 2])


@query("form_names", "SELECT n.n_regionkey AS doc_id, n.n_nationkey + 100 AS id, r.r_name || '.' || n.n_name AS name, coalesce(CASE WHEN n.n_nationkey % 3 = 0 THEN 'Btn' END, 'Tx') AS ft FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def form_names(spark, d):
    top = read(spark, d, "region").select(F.col("r_regionkey").alias("doc_id"), F.col("r_regionkey").alias("id"), F.lit(None).cast("int").alias("parent"), F.col("r_name").alias("t"), F.lit("Tx").alias("ft"), F.lit(1).alias("ff"))
    kids = read(spark, d, "nation").select(F.col("n_regionkey").alias("doc_id"), (F.col("n_nationkey") + 100).alias("id"), F.col("n_regionkey").alias("parent"), F.col("n_name").alias("t"), F.when(F.col("n_nationkey") % 3 == 0, "Btn").alias("ft"), F.lit(None).cast("int").alias("ff"))
    return forms.qualified(top.unionByName(kids)).select("doc_id", "id", "name", "ft")


def _fields(spark, d):
    c = read(spark, d, "customer")
    return c.select((F.col("c_custkey") % 50).alias("doc_id"), F.col("c_name").alias("name"), F.lit("text").alias("type"), F.when(F.col("c_custkey") % 4 == 0, 1).otherwise(0).alias("ff"), F.col("c_mktsegment").alias("value"))


@query("form_fill", "SELECT c_custkey % 50 AS doc_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 <> 0 THEN 'new' ELSE c_mktsegment END AS value FROM customer")
def form_fill(spark, d):
    f = _fields(spark, d)
    values = read(spark, d, "customer").filter("c_custkey % 3 = 0").select((F.col("c_custkey") % 50).alias("doc_id"), F.col("c_name").alias("name"), F.lit("new").alias("value"))
    return forms.fill(f, values)[0].select("doc_id", "name", "value")


@query("form_not_found", "SELECT c_custkey % 50 AS doc_id, c_name AS name FROM customer WHERE c_custkey % 12 = 0")
def form_not_found(spark, d):
    values = read(spark, d, "customer").filter("c_custkey % 3 = 0").select((F.col("c_custkey") % 50).alias("doc_id"), F.col("c_name").alias("name"), F.lit("new").alias("value"))
    return forms.fill(_fields(spark, d), values)[1].select("doc_id", "name")


@query("form_modify", "SELECT c_custkey % 50 AS doc_id, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 9 ELSE CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END END AS ff, c_mktsegment AS value FROM customer")
def form_modify(spark, d):
    new = read(spark, d, "customer").filter("c_custkey % 5 = 0").select((F.col("c_custkey") % 50).alias("doc_id"), F.col("c_name").alias("name"), F.lit(9).alias("ff"), F.lit(None).cast("string").alias("value"))
    return forms.modify(_fields(spark, d), new, ["ff", "value"]).select("doc_id", "name", "ff", "value")


@query("form_create", "SELECT s_suppkey AS doc_id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'no such page' WHEN s_suppkey % 5 = 0 THEN 'unknown type' END AS error FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 5 = 0")
def form_create(spark, d):
    s = read(spark, d, "supplier")
    k = F.col("s_suppkey")
    new = s.select(k.alias("doc_id"), F.col("s_name").alias("name"), F.when(k % 5 == 0, "unknown").otherwise("text").alias("type"), F.when(k % 3 == 0, 9).otherwise(1).alias("page"))
    none = spark.createDataFrame([], "doc_id bigint, name string, type string, page int")
    return forms.create(none, new, s.select(k.alias("doc_id"), F.lit(1).alias("page")))[1].select("doc_id", "name", "error")


@query("has_form", "SELECT n_nationkey AS doc_id, n_nationkey IN (SELECT s_nationkey FROM supplier) AS has_form FROM nation")
def has_form(spark, d):
    return forms.has_form(read(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id")), read(spark, d, "supplier").select(F.col("s_nationkey").alias("doc_id")))


@query("signature_flags", "SELECT p_partkey, (p_size % 2 = 0) AND (p_size % 3 = 0 OR p_size % 5 = 0) AS ltv, p_size * 2 = 60 AS covers_whole_file FROM part")
def signature_flags(spark, d):
    s = F.col("p_size")
    p = read(spark, d, "part").select("p_partkey", (s % 2 == 0).alias("has_timestamp"), (s % 3 == 0).alias("has_crl"), (s % 5 == 0).alias("has_ocsp"), F.lit(0).alias("a"), s.alias("la"), s.alias("b"), s.alias("lb"), F.lit(60).alias("size"))
    return security.covers_all(security.long_term(p)).select("p_partkey", "ltv", "covers_whole_file")


@query("certificate_dates", "SELECT o_orderkey, o_custkey % 2 = 0 AS self_signed, TIMESTAMP '1998-01-01' BETWEEN o_orderdate AND o_orderdate + INTERVAL 365 DAY AS date_valid FROM orders")
def certificate_dates(spark, d):
    at = F.col("o_orderdate").cast("timestamp")
    c = read(spark, d, "orders").select("o_orderkey", F.lit("s").alias("subject"), F.when(F.col("o_custkey") % 2 == 0, "s").otherwise("i").alias("issuer"), at.alias("not_before"), (at + F.expr("INTERVAL 365 DAYS")).alias("not_after"))
    return security.certificate_status(c, F.expr("timestamp'1998-01-01 00:00:00'")).select("o_orderkey", "self_signed", "date_valid")


@query("signed_digest", "SELECT c_custkey, sha256(':k' || sha256('k:' || c_name)) AS digest FROM customer")
def signed_digest(spark, d):
    return security.sign_column(read(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "k").select("c_custkey", "digest")


@query("content_hashes", "SELECT conv_id, turn, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM conversations")
def content_hashes(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query("sanitize_report", "SELECT 'javascript' AS category, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'action', count(*) FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'link', count(*) FROM lineitem WHERE l_returnflag = 'A'")
def sanitize_report(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "JavaScript").when(F.col("l_returnflag") == "A", "URI").otherwise("Page")
    return security.sanitize_objects(read(spark, d, "lineitem").select(kind.alias("kind")))[1].groupBy("category").agg(F.count("*").alias("n"))


@query("optimized_objects", """WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS src, ((n_nationkey * 3 + 1) % 25)::BIGINT AS dst FROM nation), r AS (SELECT 0::BIGINT AS id UNION SELECT e.dst FROM e JOIN r ON e.src = r.id)
SELECT min(n_nationkey)::BIGINT AS id, n_regionkey AS stream FROM nation WHERE n_nationkey IN (SELECT id FROM r) GROUP BY n_regionkey""")  # fmt: skip
def optimized_objects(spark, d):
    n = read(spark, d, "nation")
    e = n.select(F.col("n_nationkey").cast("bigint").alias("src"), ((F.col("n_nationkey") * 3 + 1) % 25).cast("bigint").alias("dst"))
    objects = n.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").cast("string").alias("content"), F.lit("F").alias("filter"), F.col("n_regionkey").alias("stream"))
    return mutate.optimize(objects, e, spark.range(1)).select("id", "stream")


@query("struct_tree", """WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS src, ((n_nationkey * 3 + 1) % 25)::BIGINT AS dst FROM nation), r AS (SELECT 0::BIGINT AS id UNION SELECT e.dst FROM e JOIN r ON e.src = r.id)
SELECT id, (n_nationkey % 9)::INTEGER AS level FROM nation JOIN r ON n_nationkey = id WHERE n_nationkey % 9 BETWEEN 1 AND 6""")  # fmt: skip
def struct_tree(spark, d):
    n = read(spark, d, "nation")
    e = n.select(F.col("n_nationkey").cast("bigint").alias("src"), ((F.col("n_nationkey") * 3 + 1) % 25).cast("bigint").alias("dst"))
    elements = n.select(F.col("n_nationkey").cast("bigint").alias("id"), F.concat(F.lit("H"), F.col("n_nationkey") % 9).alias("s"), F.lit(None).cast("string").alias("alt"))
    return validate.struct_tree(elements, e, spark.range(1))[1].select("id", "level")


FLAGS = "f AS (SELECT c_custkey AS doc_id, c_custkey % 2 = 0 AS encrypted, CASE WHEN c_custkey % 3 = 0 THEN 'pdfaid:part pdfaid:conformance' WHEN c_custkey % 3 = 1 THEN 'rdf' END AS xmp, c_custkey % 5 <> 0 AS output_intent, c_custkey % 7 = 0 AS transparency, c_custkey % 11 = 0 AS javascript FROM customer)"


def _flags(spark, d):
    k = F.col("c_custkey")
    xmp = F.when(k % 3 == 0, "pdfaid:part pdfaid:conformance").when(k % 3 == 1, "rdf")
    return read(spark, d, "customer").select(k.alias("doc_id"), (k % 2 == 0).alias("encrypted"), xmp.alias("xmp"), (k % 5 != 0).alias("output_intent"), (k % 7 == 0).alias("transparency"), (k % 11 == 0).alias("javascript"))


@query("pdf_a_issues", f"""WITH {FLAGS} SELECT doc_id, 'encryption' AS rule, 'error' AS severity FROM f WHERE encrypted UNION ALL SELECT doc_id, 'xmp.missing', 'error' FROM f WHERE xmp IS NULL UNION ALL SELECT doc_id, 'xmp.no_pdfaid_part', 'error' FROM f WHERE NOT contains(xmp, 'pdfaid:part')
UNION ALL SELECT doc_id, 'xmp.no_pdfaid_conformance', 'warning' FROM f WHERE NOT contains(xmp, 'pdfaid:conformance') UNION ALL SELECT doc_id, 'output_intent.missing', 'warning' FROM f WHERE NOT output_intent UNION ALL SELECT doc_id, 'transparency.group', 'error' FROM f WHERE transparency UNION ALL SELECT doc_id, 'javascript.action', 'error' FROM f WHERE javascript""")  # fmt: skip
def pdf_a_issues(spark, d):
    return validate.pdf_a(_flags(spark, d)).select("doc_id", "rule", "severity")


@query("pdf_a_report", f"WITH {FLAGS} SELECT doc_id, NOT (encrypted OR xmp IS NULL OR NOT contains(xmp, 'pdfaid:part') OR transparency OR javascript) AS compliant FROM f")
def pdf_a_report(spark, d):
    docs = _flags(spark, d)
    return validate.report(docs, validate.pdf_a(docs)).select("doc_id", "compliant")


@query("pdf_a_fixed", f"WITH {FLAGS} SELECT count(*) FILTER (WHERE encrypted) AS encryption, count(*) FILTER (WHERE xmp IS NULL OR NOT contains(xmp, 'pdfaid:part')) AS metadata, count(*) FILTER (WHERE transparency) AS transparency, true AS compliant FROM f")
def pdf_a_fixed(spark, d):
    fixed, actions = validate.fixes(_flags(spark, d))
    n = actions.agg(*[F.count_if(F.col("category") == c).alias(c) for c in ("encryption", "metadata", "transparency")])
    return n.crossJoin(validate.report(fixed, validate.pdf_a(fixed)).agg(F.bool_and("compliant").alias("compliant")))


@query("pdf_ua_issues", "SELECT c_custkey AS doc_id, 'ua.mark_info.not_marked' AS rule FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'ua.lang.missing' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'ua.display_doc_title' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'ua.struct_tree.missing' FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 'ua.tagged_content' FROM customer WHERE c_custkey % 11 = 0")
def pdf_ua_issues(spark, d):
    k = F.col("c_custkey")
    docs = read(spark, d, "customer").select(k.alias("doc_id"), (k % 2 != 0).alias("marked"), F.when(k % 3 == 0, " ").otherwise("en").alias("lang"), (k % 5 != 0).alias("display_title"), (k % 7 != 0).alias("struct_tree"), (k % 11 != 0).alias("tagged_content"))
    return validate.issues(docs, validate.PDF_UA).select("doc_id", "rule")


@query("font_issues", "SELECT l_orderkey AS doc_id, l_linenumber AS page, 'not embedded: F' || l_suppkey AS message FROM lineitem WHERE l_returnflag = 'R'")
def font_issues(spark, d):
    f = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.concat(F.lit("F"), F.col("l_suppkey")).alias("name"), (F.col("l_returnflag") != "R").alias("embedded"))
    return validate.font_issues(f).select("doc_id", "page", "message")


@query("require_pdf", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN 'redact is for PDF files, not ' || CASE p_size % 3 WHEN 1 THEN 'html' ELSE 'docx' END END AS error FROM part")
def require_pdf(spark, d):
    fmt = F.when(F.col("p_size") % 3 == 0, "pdf").when(F.col("p_size") % 3 == 1, "html").otherwise("docx")
    return validate.require_format(read(spark, d, "part").select("p_partkey", fmt.alias("format")), "redact").select("p_partkey", "error")


@query("bookmarks_set", "SELECT n_nationkey AS doc_id, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE n_name END AS title FROM nation WHERE n_nationkey % 2 = 1 OR n_nationkey % 3 <> 0")
def bookmarks_set(spark, d):
    k = F.col("n_nationkey")
    n = read(spark, d, "nation")
    old = n.select(k.alias("doc_id"), F.col("n_name").alias("title"), F.lit(1).alias("page"))
    new = n.filter(k % 2 == 0).select(k.alias("doc_id"), F.lit("new").alias("title"), F.when(k % 3 == 0, 9).otherwise(1).alias("page"))
    return mutate.set_bookmarks(old, new, n.select(k.alias("doc_id"), F.lit(1).alias("page")))[0].select("doc_id", "title")


@query("annotation_add", "SELECT l_orderkey AS doc_id, count(*) AS n, max(l_linenumber) + 1 AS last FROM lineitem GROUP BY l_orderkey")
def annotation_add(spark, d):
    a = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("n"), F.max("l_linenumber").alias("annot_idx"))
    notes = a.select("doc_id", F.lit(1).alias("page"), "annot_idx", F.lit("text").alias("type"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"))
    added = mutate.add_annotation(notes, notes.select("doc_id", "page"), notes.drop("annot_idx"))
    return added.groupBy("doc_id").agg(F.max("annot_idx").cast("bigint").alias("last")).join(a.select("doc_id", "n"), "doc_id")


@query("merge_fields", "SELECT c_custkey, CASE WHEN c_custkey % 4 + 1 > 1 THEN 'doc' || (c_custkey % 4 + 1) || '_' ELSE '' END || c_name AS name FROM customer")
def merge_fields(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), (F.col("c_custkey") % 4 + 1).alias("nth"))
    return pageset.merge_fields(c, "nth").select("c_custkey", "name")


@query("stamp_pages", "SELECT n_nationkey AS doc_id, 1 AS page, 0 AS z, 1.0::DOUBLE AS x, 't' AS text FROM nation UNION ALL SELECT n_nationkey, 1, 1, 12.0::DOUBLE, 's' FROM nation")
def stamp_pages(spark, d):
    p = read(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("z"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"), F.lit("t").alias("text"))
    overlay = spark.createDataFrame([(0, 1, 0, 1.0, 1.0, 1.0, 1.0, "s")], "doc_id int, page int, z int, x double, y double, width double, height double, text string")
    return pageset.stamp(p, overlay, x=10.0, scale=2.0).select("doc_id", "page", "z", "x", "text")


# --- names and small functions --------------------------------------------------


@query("annotation_names", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'free_text' WHEN 1 THEN 'strike_out' WHEN 2 THEN 'link' ELSE 'Odd' END AS type FROM part")
def annotation_names(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("FreeText", "StrikeOut", "Link", "Odd")]), F.col("p_size") % 4 + 1)
    return read(spark, d, "part").select("p_partkey", names.annotation_type(raw).alias("type"))


@query("option_names", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'jpg' WHEN 1 THEN 'bmp' ELSE 'png' END AS image, CASE p_size % 3 WHEN 0 THEN 'top_left' WHEN 1 THEN 'bottom_right' ELSE 'center' END AS position, CASE WHEN p_size % 4 = 1 THEN 90 WHEN p_size % 4 = 2 THEN 180 WHEN p_size % 4 = 0 THEN 0 END AS rotation FROM part")
def option_names(spark, d):
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("p_size") % len(xs) + 1)
    return read(spark, d, "part").select("p_partkey", names.named(pick(["JPEG", "bmp", "tiff"]), names.IMAGES, "png").alias("image"), names.named(pick(["TopLeft", "bottom_right", "?"]), names.POSITIONS, "center").alias("position"), names.rotation(pick([0, 90, 180, 45])).alias("rotation"))


@query("escape_attributes", """SELECT p_partkey, '&lt;' || replace(p_name, ' ', '&quot;') || '&amp;' AS attr, 'a\\|b ' || p_name AS pipe FROM part""")
def escape_attributes(spark, d):
    raw = F.concat(F.lit("<"), F.replace("p_name", F.lit(" "), F.lit('"')), F.lit("&"))
    return read(spark, d, "part").select("p_partkey", T.escape_attribute(raw).alias("attr"), T.escape_pipe(F.concat(F.lit(" a|b\n"), F.col("p_name"))).alias("pipe"))


@query("byte_lengths", "SELECT conv_id, turn, strlen(text)::INTEGER AS bytes, length(text)::INTEGER AS chars FROM conversations")
def byte_lengths(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.bytes_of(F.col("text")).alias("bytes"), F.length("text").alias("chars"))


@query("file_names", "SELECT page_id, 'p' || page_id || '.tar.gz' AS filename, 'p' || page_id || '.tar' AS stem, 'gz' AS ext FROM pages")
def file_names(spark, d):
    told = F.pandas_udf(lambda paths: pd.DataFrame([pipeline.names(p) for p in paths], columns=["filename", "stem", "ext"]), "filename string, stem string, ext string")
    found = told(F.concat(F.lit("in/dir/p"), F.col("page_id"), F.lit(".tar.gz")))
    return read(spark, d, "pages").select("page_id", found.alias("n")).select("page_id", "n.*")


@query("document_score", """WITH s AS (SELECT l_orderkey AS t, l_linenumber / 8.0::DOUBLE AS p FROM lineitem) SELECT round(avg(p), 6) AS precision, round(avg(p), 6) AS recall, round(avg(p), 6) AS f1 FROM s""")
def document_score(spark, d):
    p = F.col("l_linenumber") / 8.0
    per = read(spark, d, "lineitem").select(p.alias("precision"), p.alias("recall"), p.alias("f1"))
    return metrics.averages(per).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("cell_rows", "SELECT n_regionkey AS table_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS row, 0 AS col, n_name AS text FROM nation")
def cell_rows(spark, d):
    rows = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_name"]))
    return metrics.cell_rows(read(spark, d, "nation").groupBy(F.col("n_regionkey").alias("table_id")).agg(rows.alias("rows")))


@query("select_pages", "SELECT conv_id, turn AS page FROM conversations WHERE turn IN (1, 2, 3, 5)")
def select_pages(spark, d):
    return search.select_pages(read(spark, d, "conversations").select("conv_id", F.col("turn").alias("page")), "1-3, 5")


@query("line_lcs_bound", "SELECT 0 AS below")
def line_lcs_bound(spark, d):
    """How many pages change less than the lines that only one side has would allow: none."""
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    split = lambda x: x.select(*PAGE, F.posexplode(F.split("text", "\n", -1)).alias("line_idx", "text"))
    a, b = split(c), split(c.withColumn("text", F.when(F.col("page") % 2 == 0, F.concat(F.lit("x\n"), F.reverse("text"))).otherwise(F.col("text"))))
    ops = compare.diff_lines(a, b).groupBy(*PAGE).agg(F.sum(F.when(F.col("kind") == "changed", 2).otherwise(1)).alias("n"))
    only = a.select(*PAGE, "text").exceptAll(b.select(*PAGE, "text")).groupBy(*PAGE).agg(F.count("*").alias("m"))
    return only.join(ops, PAGE, "left").agg(F.count_if(F.coalesce("n", F.lit(0)) < F.col("m")).cast("int").alias("below"))


@query("office_round_trip", "SELECT p_partkey AS doc_id, p_name AS heading, p_brand AS body FROM part")
def office_round_trip(spark, d):
    """A slide deck for each part, written and read again."""
    def trip(names_: pd.Series, brands: pd.Series) -> pd.DataFrame:
        found = [office.slides(convert.pptx_bytes([(n, [b])], {}))[0] for n, b in zip(names_, brands)]
        return pd.DataFrame([(s["title"], s["blocks"][-1]["text"]) for s in found], columns=["heading", "body"])

    out = storage.spread(read(spark, d, "part"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), F.pandas_udf(trip, "heading string, body string")("p_name", "p_brand").alias("x"))
    return out.select("doc_id", "x.heading", "x.body")


@query("markdown_numbers", "SELECT o_custkey AS doc_id, string_agg(CASE WHEN rn > 1 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || '<!-- page ' || rn || ' -->' || chr(10) || chr(10) || o_orderpriority, '' ORDER BY rn) || chr(10) AS markdown FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) GROUP BY o_custkey")
def markdown_numbers(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    b = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), n.alias("page"), F.lit(0).alias("block_idx"), F.lit("paragraph").alias("type"), F.col("o_orderpriority").alias("text"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("indent_level"))
    return markdown.render(b, page_numbers="<!-- page {n} -->")
