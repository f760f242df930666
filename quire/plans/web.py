"""Queries on the HTML pages, and on documents as files, slides, chapters and prints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire import pipeline
from quire.operators import convert, markdown, mutate
from quire.operators.lines import joined
from quire.sources import archive, detect, reader
from quire.streaming import sessions

QUERIES = []


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES.append((name, fn, sql))
        return fn

    return add


def read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


def _pages(spark, d):
    return reader.open_table(read(spark, d, "pages"), "page_id", "html", "html")


@query("detect_ext", r"""WITH e AS (SELECT page_id, lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '\.([^./\\]+)$', 1)) AS ext FROM pages)
SELECT page_id, CASE WHEN ext IN ('pdf', 'docx', 'xlsx', 'pptx', 'epub') THEN ext WHEN ext IN ('html', 'htm') THEN 'html' WHEN ext IN ('md', 'markdown') THEN 'markdown' ELSE 'unknown' END AS format FROM e""")  # fmt: skip
def detect_ext(spark, d):
    path = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    return read(spark, d, "pages").select("page_id", detect.by_extension(path).alias("format"))


@query("detect_magic", "SELECT page_id, CASE WHEN starts_with(html, '%PDF') THEN 'pdf' WHEN starts_with(html, '<?xml') OR starts_with(html, '<!DOCTYPE html') OR starts_with(html, '<html') THEN 'html' ELSE 'unknown' END AS format FROM pages")
def detect_magic(spark, d):
    return read(spark, d, "pages").select("page_id", detect.by_magic(F.col("html").cast("binary")).alias("format"))


@query("detect_html", "SELECT page_id, regexp_matches(lower(substr(html, 1, 1024)), '<!doctype html|<html|<head|<body') AS is_html FROM pages")
def detect_html(spark, d):
    return read(spark, d, "pages").select("page_id", detect.looks_like_html(F.col("html")).alias("is_html"))


@query("format_facts", """SELECT * FROM (VALUES ('pdf', 'pdf', 'application/pdf', 'PDF'), ('docx', 'docx', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'Word document'), ('xlsx', 'xlsx', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet', 'Excel workbook'),
  ('pptx', 'pptx', 'application/vnd.openxmlformats-officedocument.presentationml.presentation', 'PowerPoint presentation'), ('html', 'html', 'text/html', 'HTML'), ('epub', 'epub', 'application/epub+zip', 'EPUB'), ('markdown', 'md', 'text/markdown', 'Markdown'), ('unknown', '', 'application/octet-stream', 'unknown')) AS f(format, extension, mime, name)""")  # fmt: skip
def format_facts(spark, d):
    return detect.facts(spark)


HEADS = r"heads AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>')) AS tag, generate_subscripts(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>'), 1) - 1 AS ord FROM pages)"


@query("html_headings", rf"WITH {HEADS} SELECT page_id, ord::INTEGER AS ord, regexp_extract(tag, '(?i)<h([1-6])', 1)::INTEGER AS level, trim(replace(replace(replace(regexp_replace(tag, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title FROM heads")
def html_headings(spark, d):
    return _pages(spark, d).bookmarks.select(F.col("doc_id").alias("page_id"), "ord", "level", "title")


@query("html_title", r"SELECT page_id, trim(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title FROM pages")
def html_title(spark, d):
    return _pages(spark, d).get("metadata").select(F.col("doc_id").alias("page_id"), F.col("doc.metadata")["title"].alias("title"))


LINK = r"""'(?is)<a\s[^>]*?href="?([^" >]+)'"""


@query("html_links", f"SELECT page_id, i - 1 AS ord, uri FROM (SELECT page_id, unnest(regexp_extract_all(html, {LINK}, 1)) AS uri, generate_subscripts(regexp_extract_all(html, {LINK}, 1), 1) AS i FROM pages)")
def html_links(spark, d):
    return _pages(spark, d).links.select(F.col("doc_id").alias("page_id"), F.col("annot_idx").cast("bigint").alias("ord"), "uri")


#: The elements of a page that hold text, in order, with their text. A paragraph ends where the next begins.
ELEMENTS = r"""found AS (SELECT page_id, regexp_extract_all(replace(replace(html, '<p>', '</p><p>'), '</article>', '</p></article>'), '(?s)<title>.*?</title>|<li>.*?</li>|<div class="ad">.*?</div>|<h1>.*?</h1>|<p>.*?</p>|<footer>.*?</footer>') AS x FROM pages
), tags AS (SELECT page_id, unnest(x) AS tag, generate_subscripts(x, 1) AS i FROM found
), elements AS (SELECT page_id AS doc_id, i, regexp_extract(tag, '^<([a-z0-9]+)', 1) AS kind, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(tag, '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), ' ' || chr(10)) AS text FROM tags
), blocks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS block_idx, CASE kind WHEN 'h1' THEN 'heading' WHEN 'li' THEN 'list_item' ELSE 'paragraph' END AS type, text, CASE WHEN kind = 'h1' THEN 1 END AS level, CASE WHEN kind = 'li' THEN 0 END AS indent_level FROM elements WHERE kind IN ('h1', 'li', 'p') AND text <> '')"""


@query("html_text", f"WITH {ELEMENTS} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text FROM elements WHERE text <> '' GROUP BY doc_id")
def html_text(spark, d):
    return _pages(spark, d).get("text").select("doc_id", "doc.text")


@query("html_blocks", f"WITH {ELEMENTS} SELECT doc_id, 1 AS page, block_idx, type, text, level, indent_level, NULL::INTEGER AS table_id FROM blocks")
def html_blocks(spark, d):
    return _pages(spark, d).part("blocks")


@query("html_markdown", f"""WITH {ELEMENTS}, p AS (SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY block_idx) AS b FROM blocks)
SELECT doc_id, string_agg(CASE WHEN b IS NULL THEN '' WHEN b = 'list_item' AND type = 'list_item' THEN chr(10) ELSE chr(10) || chr(10) END || CASE type WHEN 'heading' THEN '# ' WHEN 'list_item' THEN '- ' ELSE '' END || text, '' ORDER BY block_idx) || chr(10) AS markdown FROM p GROUP BY doc_id""")
def html_markdown(spark, d):
    return _pages(spark, d).markdown()


@query("html_bookmarks", f"WITH {ELEMENTS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) - 1)::INTEGER AS ord, text AS title, 1 AS page, level, NULL::BIGINT AS parent FROM blocks WHERE type = 'heading'")
def html_bookmarks(spark, d):
    marks = _pages(spark, d).bookmarks
    return mutate.parents(marks, ["doc_id"], "ord")


@query("html_rewritten", f"""WITH {ELEMENTS}, p AS (SELECT doc_id, block_idx, type, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t, lag(type) OVER w AS b, lead(type) OVER w AS a FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)
), x AS (SELECT doc_id, block_idx, CASE WHEN type = 'list_item' AND coalesce(b, '') <> type THEN '  <ul>' || chr(10) ELSE '' END || CASE WHEN b = 'list_item' AND type <> b THEN '  </ul>' || chr(10) ELSE '' END || CASE type WHEN 'heading' THEN '  <h1>' || t || '</h1>' WHEN 'list_item' THEN '    <li>' || t || '</li>' ELSE '  <p>' || t || '</p>' END || chr(10) || CASE WHEN type = 'list_item' AND a IS NULL THEN '  </ul>' || chr(10) ELSE '' END AS x FROM p)
SELECT doc_id, '<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10) || '  <meta charset="utf-8">' || chr(10) || '  <title>Document</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || string_agg(x, '' ORDER BY block_idx) || '</body>' || chr(10) || '</html>' || chr(10) AS html FROM x GROUP BY doc_id""")  # fmt: skip
def html_rewritten(spark, d):
    docs = _pages(spark, d).stored()
    return convert.html(docs.blocks, cells=docs.cells)


@query("convert_docx_and_back", f"WITH {ELEMENTS} SELECT doc_id, block_idx, CASE WHEN type = 'heading' THEN type ELSE 'paragraph' END AS type, CASE WHEN type = 'list_item' THEN '• ' || text ELSE text END AS text, level FROM blocks")
def convert_docx_and_back(spark, d):
    made = convert.convert(_pages(spark, d).get("blocks", "cells", "metadata", "error"), "docx").select("doc_id", "content")
    return reader.open_table(made, "doc_id", "content").part("blocks").select("doc_id", "block_idx", "type", "text", "level")


@query("convert_report", f"WITH {ELEMENTS} SELECT page_id AS doc_id, (SELECT count(*) FROM blocks WHERE doc_id = page_id)::INTEGER AS blocks, 0 AS tables, NULL::VARCHAR AS error FROM pages")
def convert_report(spark, d):
    return convert.convert(_pages(spark, d).get("blocks", "cells", "metadata", "error"), "epub").select("doc_id", "blocks", "tables", "error")


# --- logical forms of blocks: an order is a block, a customer a document -----


def _blocks(spark, d):
    o = read(spark, d, "orders")
    n = F.substring("o_orderpriority", 1, 1).cast("int")
    idx = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    kind = F.when(n <= 2, "heading").when(n == 3, "list_item").otherwise("paragraph")
    return o.select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page"), idx.cast("int").alias("block_idx"), kind.alias("type"), F.concat(F.lit("B <"), F.col("o_orderkey"), F.lit("> "), F.col("o_orderpriority")).alias("text"), F.when(n <= 2, n).alias("level"), F.when(n == 3, (F.col("o_orderkey") % 3).cast("int")).alias("indent_level"))


BLOCKS = """blocks AS (SELECT o_custkey AS doc_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS block_idx, substr(o_orderpriority, 1, 1)::INTEGER AS n,
  'B <' || o_orderkey || '> ' || o_orderpriority AS text, (o_orderkey % 3)::INTEGER AS indent FROM orders)"""


@query("epub_chapters", f"""WITH {BLOCKS}, s AS (SELECT *, (n = 1)::INTEGER AS h FROM blocks)
SELECT doc_id, block_idx, (sum(h) OVER w - first_value(h) OVER w)::INTEGER AS chapter FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)""")
def epub_chapters(spark, d):
    return convert.chapters(_blocks(spark, d)).select("doc_id", "block_idx", "chapter")


@query("slides_from_blocks", f"""WITH {BLOCKS}, s AS (SELECT *, (n <= 2)::INTEGER AS h FROM blocks), p AS (SELECT *, (sum(h) OVER w + 1 - first_value(h) OVER w)::INTEGER AS slide FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx))
SELECT doc_id, slide, max(text) FILTER (WHERE h = 1) AS title, coalesce(string_agg(CASE WHEN n = 3 THEN '• ' || text ELSE text END, chr(10) ORDER BY block_idx) FILTER (WHERE h = 0), '') AS body FROM p GROUP BY doc_id, slide""")  # fmt: skip
def slides_from_blocks(spark, d):
    return convert.slides(_blocks(spark, d))


@query("blocks_html", f"""WITH {BLOCKS}, d AS (SELECT *, CASE WHEN n = 3 THEN indent + 1 ELSE 0 END AS d, row_number() OVER w = count(*) OVER (PARTITION BY doc_id) AS last FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)
), b AS (SELECT *, coalesce(lag(d) OVER (PARTITION BY doc_id ORDER BY block_idx), 0) AS b, replace(replace(text, '<', '&lt;'), '>', '&gt;') AS t FROM d
), p AS (SELECT doc_id, block_idx, coalesce(array_to_string([repeat('  ', k) || '<ul>' || chr(10) FOR k IN range(b + 1, d + 1)], ''), '') || coalesce(array_to_string([repeat('  ', k) || '</ul>' || chr(10) FOR k IN range(b, d, -1)], ''), '') ||
  CASE WHEN n <= 2 THEN '  <h' || n || '>' || t || '</h' || n || '>' || chr(10) WHEN n = 3 THEN repeat('  ', d + 1) || '<li>' || t || '</li>' || chr(10) ELSE '  <p>' || t || '</p>' || chr(10) END ||
  CASE WHEN last THEN coalesce(array_to_string([repeat('  ', k) || '</ul>' || chr(10) FOR k IN range(d, 0, -1)], ''), '') ELSE '' END AS x FROM b)
SELECT doc_id, '<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10) || '  <meta charset="utf-8">' || chr(10) || '  <title>Document</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || string_agg(x, '' ORDER BY block_idx) || '</body>' || chr(10) || '</html>' || chr(10) AS html FROM p GROUP BY doc_id""")  # fmt: skip
def blocks_html(spark, d):
    return convert.html(_blocks(spark, d))


@query("pdf_paginate", f"""WITH {BLOCKS}, l AS (SELECT doc_id, n, block_idx * 2 + k AS line, CASE k WHEN 1 THEN '' WHEN 0 THEN CASE WHEN n = 3 THEN repeat('  ', indent) || '• ' || text ELSE text END END AS text FROM blocks, generate_series(0, 1) AS g(k))
SELECT doc_id, line::INTEGER AS line, (line // 50 + 1)::INTEGER AS page, CASE WHEN text = '' THEN '' ELSE trim(text) END AS text, CASE n WHEN 1 THEN 20.0::DOUBLE WHEN 2 THEN 16.0::DOUBLE ELSE 12.0::DOUBLE END AS font_size, n <= 2 AS bold FROM l""")
def pdf_paginate(spark, d):
    return convert.print_lines(_blocks(spark, d))


@query("sheet_rows", f"WITH {BLOCKS} SELECT doc_id, 'Content' AS sheet, block_idx AS row, 0 AS col, text FROM blocks")
def sheet_rows(spark, d):
    none = spark.createDataFrame([], "doc_id bigint, page int, table_id int, row int, col int, text string")
    return convert.sheet_rows(_blocks(spark, d), none)


@query("archive_limits", """WITH e AS (SELECT o_custkey AS archive, o_orderkey AS entry_idx, (o_totalprice * 700)::BIGINT AS bytes, (CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice * 3 ELSE o_totalprice * 100 END)::BIGINT AS packed FROM orders
), t AS (SELECT *, sum(bytes) OVER w AS total, row_number() OVER w AS nth FROM e WINDOW w AS (PARTITION BY archive ORDER BY entry_idx))
SELECT archive, entry_idx, total::BIGINT AS total, CASE WHEN nth > 10000 THEN 'too_many_entries' WHEN bytes > 104857600 THEN 'entry_too_large' WHEN packed > 0 AND bytes / packed > 100 THEN 'ratio_too_high' WHEN total > 524288000 THEN 'archive_too_large' END AS broken FROM t""")  # fmt: skip
def archive_limits(spark, d):
    o = read(spark, d, "orders")
    p = F.col("o_totalprice")
    rows = o.select(F.col("o_custkey").alias("archive"), F.col("o_orderkey").alias("entry_idx"), F.round(p * 700).cast("bigint").alias("bytes"), F.round(F.when(F.col("o_orderkey") % 50 == 0, p * 3).otherwise(p * 100)).cast("bigint").alias("packed"))
    return archive.audit(rows).select("archive", "entry_idx", "total", "broken")


@query("pipeline_rollup", "SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 7 <> 0) AS success, count(*) FILTER (WHERE doc_id % 7 = 0) AS failed, 0::BIGINT AS skipped FROM documents")
def pipeline_rollup(spark, d):
    rows = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("success").alias("status"))
    return pipeline.rollup(rows)


@query("pipeline_fail_fast", "WITH r AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS path, doc_id % 97 = 50 AS bad FROM documents) SELECT path, CASE WHEN bad THEN 'failed' ELSE 'success' END AS status FROM r WHERE path <= coalesce((SELECT min(path) FROM r WHERE bad), path)")
def pipeline_fail_fast(spark, d):
    rows = read(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.when(F.col("doc_id") % 97 == 50, "failed").otherwise("success").alias("status"))
    return pipeline.stopped(rows, "fail_fast")


@query("pipeline_run", f"WITH {ELEMENTS} SELECT doc_id || '.html' AS path, 'success' AS status, NULL::INTEGER AS step, NULL::VARCHAR AS error, string_agg(CASE WHEN type = 'list_item' THEN '• ' || text ELSE text END, chr(10) || chr(10) ORDER BY block_idx) AS text FROM blocks GROUP BY doc_id")
def pipeline_run(spark, d):
    p = pipeline.Builder("pages", "unused").on_error("collect_errors").extract_structure().to_markdown().convert("docx").extract_text().build()
    files = read(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    return pipeline.run_table(files, p).select("path", "status", "step", "error", "text")


@query("save_names", "SELECT page_id, 'out/p' || page_id || '.txt' AS path FROM pages")
def save_names(spark, d):
    fill = F.pandas_udf(lambda paths: paths.map(lambda p: pipeline.fill_names("out/{stem}.txt", p)), "string")
    return read(spark, d, "pages").select("page_id", fill(F.concat(F.lit("in/p"), F.col("page_id"), F.lit(".html"))).alias("path"))


@query("events_sessions", """WITH g AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 3600000000, false)::INTEGER AS n FROM events
), s AS (SELECT *, (sum(n) OVER (PARTITION BY user_id ORDER BY ts))::INTEGER AS session FROM g) SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY user_id, session""")  # fmt: skip
def events_sessions(spark, d):
    return sessions.sessions(read(spark, d, "events"))


@query("copies_listed", "SELECT md5(text) AS h, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def copies_listed(spark, d):
    out = read(spark, d, "documents").groupBy(F.md5("text").alias("h")).agg(joined(F.col("doc_id").cast("string"), ["doc_id"], ",").alias("ids"), F.count("*").alias("n"))
    return out.filter("n > 1").drop("n")
