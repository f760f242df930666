"""Queries on lines, layout, structure and tables over the mapped spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import layout, markdown, structure, tables
from quire.operators.lines import PAGE, group_spans, lines_of, page_texts
from quire.plans import mapped
from quire.plans.mapped import HEIGHT, LINES, RECTS, SPANS, WIDTH

QUERIES = []


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES.append((name, fn, sql))
        return fn

    return add


@query("line_text", f"WITH {LINES} SELECT doc_id, page, line_idx, text, x0, y0, x1, y1 FROM lines")
def line_text(spark, d):
    return mapped.lines(spark, d).select(*PAGE, "line_idx", "text", "x0", "y0", "x1", "y1")


@query("page_text", f"WITH {LINES} SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line_idx) AS text FROM lines GROUP BY doc_id, page")
def page_text(spark, d):
    return page_texts(mapped.lines(spark, d))


@query("group_spans", f"WITH {SPANS} SELECT doc_id, page, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY y DESC) - 1 AS line_idx, row_number() OVER (PARTITION BY doc_id, page, y ORDER BY x) - 1 AS span_idx, text, x, y FROM spans")
def grouped(spark, d):
    out = group_spans(mapped.spans(spark, d))
    return out.select(*PAGE, F.col("line_idx").cast("bigint").alias("line_idx"), F.col("span_idx").cast("bigint").alias("span_idx"), "text", "x", "y")


ZONES = f"""{LINES}, raw AS (
  SELECT *, CASE WHEN (y0 + y1) / 2 > {HEIGHT} * (1 - 0.08) THEN 'header' WHEN (y0 + y1) / 2 < {HEIGHT} * 0.08 THEN 'footer' ELSE 'body' END AS z FROM lines
), counted AS (
  SELECT *, count(*) FILTER (WHERE z = 'header') OVER w AS nh, count(*) FILTER (WHERE z = 'footer') OVER w AS nf, count(*) FILTER (WHERE z = 'body') OVER w AS nb
  FROM raw WINDOW w AS (PARTITION BY doc_id, page)
), zoned AS (
  SELECT * EXCLUDE (z, nh, nf, nb), CASE WHEN z = 'header' AND nh > ceil(greatest(nb, 1) * 0.05::DOUBLE) + 3 THEN 'body' WHEN z = 'footer' AND nf > ceil(greatest(nb, 1) * 0.05::DOUBLE) + 3 THEN 'body' ELSE z END AS zone FROM counted
), body AS (SELECT * FROM zoned WHERE zone = 'body')"""


@query("header_footer", f"WITH {ZONES} SELECT doc_id, page, line_idx, zone FROM zoned")
def header_footer(spark, d):
    return layout.zones(mapped.lines(spark, d), HEIGHT).select(*PAGE, "line_idx", "zone")


PROJECTION = f"""{ZONES}, hit AS (
  SELECT doc_id, page, unnest(range(greatest(floor(x0), 0)::BIGINT, least(ceil(x1), {WIDTH})::BIGINT)) AS bin FROM body
), counts AS (SELECT doc_id, page, bin, count(*) AS n FROM hit GROUP BY doc_id, page, bin
), profile AS (
  SELECT p.doc_id, p.page, b.bin::INTEGER AS bin, coalesce(c.n, 0) AS n
  FROM (SELECT DISTINCT doc_id, page FROM body) p CROSS JOIN (SELECT unnest(range({int(WIDTH)})) AS bin) b
  LEFT JOIN counts c ON c.doc_id = p.doc_id AND c.page = p.page AND c.bin = b.bin
)"""


def _body(spark, d):
    return layout.zones(mapped.lines(spark, d), HEIGHT).filter("zone = 'body'")


def _laid(spark, d):
    return layout.page_layout(layout.zones(mapped.lines(spark, d), HEIGHT), WIDTH)


@query("x_projection", f"WITH {PROJECTION} SELECT doc_id, page, bin, n FROM profile")
def x_projection(spark, d):
    return layout.projection(_body(spark, d), WIDTH)


GUTTERS = f"""{PROJECTION}, low AS (
  SELECT p.doc_id, p.page, p.bin, p.bin - row_number() OVER (PARTITION BY p.doc_id, p.page ORDER BY p.bin) AS run
  FROM profile p JOIN (SELECT doc_id, page, count(*) AS total FROM body GROUP BY doc_id, page) t USING (doc_id, page)
  WHERE p.bin >= 30 AND p.bin < {int(WIDTH) - 30} AND p.n <= ceil(t.total * 0.02::DOUBLE)
), gutters AS (
  SELECT doc_id, page, min(bin)::DOUBLE AS g0, (max(bin) + 1)::DOUBLE AS g1, (min(bin)::DOUBLE + max(bin) + 1) / 2 AS center FROM low GROUP BY doc_id, page, run HAVING max(bin) + 1 - min(bin) >= 20
)"""


@query("gutters", f"WITH {GUTTERS} SELECT doc_id, page, g0, g1, center FROM gutters")
def gutters(spark, d):
    return layout.gutters(_laid(spark, d))


COLUMNS = f"""{GUTTERS}, totals AS (SELECT doc_id, page, count(*) AS total FROM body GROUP BY doc_id, page
), bands AS (
  SELECT doc_id, page, coalesce(lag(c) OVER (PARTITION BY doc_id, page ORDER BY c), 0.0)::DOUBLE AS c0, c AS c1
  FROM (SELECT doc_id, page, center AS c FROM gutters UNION ALL SELECT doc_id, page, {WIDTH}::DOUBLE FROM totals)
), held AS (
  SELECT b.doc_id, b.page, b.c0, b.c1, count(*) AS n FROM bands b JOIN body l ON l.doc_id = b.doc_id AND l.page = b.page AND (l.x0 + l.x1) / 2 >= b.c0 AND (l.x0 + l.x1) / 2 < b.c1
  WHERE (b.doc_id, b.page) IN (SELECT (doc_id, page) FROM gutters) GROUP BY b.doc_id, b.page, b.c0, b.c1
), ok AS (
  SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY c0) - 1 AS col, c0, c1 FROM held JOIN totals USING (doc_id, page) WHERE n >= floor(greatest(total * 0.1::DOUBLE, 1.0))
), cols AS (
  SELECT doc_id, page, col::INTEGER AS col, c0, c1 FROM ok WHERE col < 4
  UNION ALL SELECT doc_id, page, 0, 0.0, {WIDTH}::DOUBLE FROM totals WHERE (doc_id, page) NOT IN (SELECT (doc_id, page) FROM ok)
)"""


@query("columns", f"WITH {COLUMNS} SELECT doc_id, page, col, c0, c1 FROM cols")
def columns(spark, d):
    return layout.columns(_laid(spark, d))


ASSIGNED = f"""{COLUMNS}, near AS (
  SELECT l.doc_id, l.page, l.line_idx, c.col, row_number() OVER (PARTITION BY l.doc_id, l.page, l.line_idx ORDER BY abs((c.c0 + c.c1) / 2 - (l.x0 + l.x1) / 2), c.col) AS rn
  FROM body l JOIN cols c ON c.doc_id = l.doc_id AND c.page = l.page
), crossing AS (
  SELECT DISTINCT l.doc_id, l.page, l.line_idx FROM body l JOIN gutters g ON g.doc_id = l.doc_id AND g.page = l.page
  WHERE l.x0 < g.center AND l.x1 > g.center AND g.g0 - l.x0 > 20 AND l.x1 - g.g1 > 20
), placed AS (
  SELECT l.*, n.col, (m.k > 1 AND (l.x1 - l.x0 > {WIDTH} * 0.7 OR x.line_idx IS NOT NULL)) AS is_full
  FROM body l JOIN near n ON n.doc_id = l.doc_id AND n.page = l.page AND n.line_idx = l.line_idx AND n.rn = 1
  JOIN (SELECT doc_id, page, count(*) AS k FROM cols GROUP BY doc_id, page) m ON m.doc_id = l.doc_id AND m.page = l.page
  LEFT JOIN crossing x ON x.doc_id = l.doc_id AND x.page = l.page AND x.line_idx = l.line_idx
)"""


@query("column_assign", f"WITH {ASSIGNED} SELECT doc_id, page, line_idx, col, is_full FROM placed")
def column_assign(spark, d):
    return layout.placed(_laid(spark, d), WIDTH).filter("zone = 'body'").select(*PAGE, "line_idx", "col", "is_full")


ORDERED = f"""{ASSIGNED}, parts AS (
  SELECT doc_id, page, line_idx, text, y1, is_full, col, CASE WHEN is_full THEN 'full_width' ELSE 'body_column' END AS region,
         sum(is_full::INTEGER) OVER (PARTITION BY doc_id, page ORDER BY y1 DESC, line_idx) * 2 - is_full::INTEGER AS section FROM placed
  UNION ALL SELECT doc_id, page, line_idx, text, y1, false, 0, zone, CASE WHEN zone = 'header' THEN -1 ELSE 1 << 30 END FROM zoned WHERE zone <> 'body'
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY section, CASE WHEN is_full THEN 0 ELSE col END, y1 DESC, line_idx) - 1 AS ord FROM parts
)"""


@query("reading_order", f"WITH {ORDERED} SELECT doc_id, page, line_idx, region, ord FROM ordered")
def reading_order(spark, d):
    return layout.analyze(mapped.lines(spark, d), WIDTH, HEIGHT).select(*PAGE, "line_idx", "region", F.col("ord").cast("bigint").alias("ord"))


@query("layout_text", f"WITH {ORDERED} SELECT doc_id, page, string_agg(text, chr(10) ORDER BY ord) AS text, greatest(count(DISTINCT col) FILTER (WHERE region = 'body_column'), 1) AS columns FROM ordered GROUP BY doc_id, page")
def layout_text(spark, d):
    return layout.layout_text(layout.analyze(mapped.lines(spark, d), WIDTH, HEIGHT))


# --- structure -------------------------------------------------------------

BODY = f"""{LINES}, buckets AS (
  SELECT doc_id, page, round(font_size * 2)::INTEGER AS b, sum(strlen(text)) AS n, min(font_size) AS size FROM spans GROUP BY ALL
), bodies AS (SELECT doc_id, page, size AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, b) AS rn FROM buckets) WHERE rn = 1
), levels AS (
  SELECT doc_id, page, b, least(row_number() OVER (PARTITION BY doc_id, page ORDER BY b DESC), 6) AS level
  FROM (SELECT DISTINCT doc_id, page, round(font_size * 2)::INTEGER AS b FROM spans JOIN bodies USING (doc_id, page) WHERE font_size >= body * 1.2::DOUBLE)
)"""


@query("body_font_size", f"WITH {BODY} SELECT doc_id, page, body FROM bodies")
def body_font_size(spark, d):
    return structure.page_sizes(mapped.spans(spark, d)).select(*PAGE, "body")


@query("heading_levels", f"WITH {BODY} SELECT doc_id, page, b, level::INTEGER AS level FROM levels")
def heading_levels(spark, d):
    return structure.heading_levels(structure.page_sizes(mapped.spans(spark, d)))


CLASSIFIED = f"""{BODY}, dom AS (
  SELECT doc_id, page, line_idx, size, font, first_x FROM (
    SELECT doc_id, page, line_idx, font_size AS size, font_name AS font, first_value(x) OVER (PARTITION BY doc_id, page, line_idx ORDER BY span_idx) AS first_x,
           row_number() OVER (PARTITION BY doc_id, page, line_idx ORDER BY strlen(text) DESC, span_idx DESC) AS rn FROM spans) WHERE rn = 1
), margins AS (
  SELECT doc_id, page, greatest(min(first_x), 0.0) AS margin FROM dom JOIN bodies USING (doc_id, page) WHERE abs(size - body) < 1 GROUP BY doc_id, page
), lowest AS (SELECT doc_id, page, max(level) AS lowest FROM levels GROUP BY doc_id, page
), joined AS (
  SELECT l.*, d.size, d.font, d.first_x, b.body, m.margin, w.lowest, v.level AS sized,
         regexp_matches(l.text, '^\\s*([-*•‣◦⁃–—]|[0-9]+[.)]|[A-Za-z][.)]) ') AS item,
         contains(lower(d.font), 'bold') AND abs(d.size - b.body) < 1 AND strlen(l.text) < 100 AND trim(l.text) <> '' AS bold
  FROM lines l JOIN dom d USING (doc_id, page, line_idx) JOIN bodies b USING (doc_id, page) LEFT JOIN margins m USING (doc_id, page) LEFT JOIN lowest w USING (doc_id, page)
  LEFT JOIN levels v ON v.doc_id = l.doc_id AND v.page = l.page AND v.b = round(d.size * 2)::INTEGER
), classed AS (
  SELECT doc_id, page, line_idx, text, x0, y0, x1, y1, body, CASE WHEN sized IS NOT NULL OR bold THEN 'heading' WHEN item THEN 'list_item' ELSE 'paragraph' END AS kind,
         (CASE WHEN sized IS NOT NULL THEN sized WHEN bold THEN least(coalesce(lowest, 0) + 1, 6) END)::INTEGER AS level,
         (CASE WHEN sized IS NULL AND NOT bold AND item THEN round(greatest(first_x - margin, 0.0) / 36) END)::INTEGER AS indent_level
  FROM joined
)"""


@query("left_margin", f"WITH {CLASSIFIED} SELECT DISTINCT doc_id, page, margin FROM lines LEFT JOIN margins USING (doc_id, page)")
def left_margin(spark, d):
    sized = lines_of(mapped.spans(spark, d)).join(structure.page_sizes(mapped.spans(spark, d)), PAGE)
    return sized.withColumn("margin", structure.left_margin(sized)).select(*PAGE, "margin").distinct()


@query("classify_lines", f"WITH {CLASSIFIED} SELECT doc_id, page, line_idx, kind, level, indent_level, text FROM classed")
def classify_lines(spark, d):
    return structure.classified(mapped.spans(spark, d)).select(*PAGE, "line_idx", "kind", "level", "indent_level", "text")


BLOCKS = f"""{CLASSIFIED}, marked AS (
  SELECT *, CASE WHEN lag(kind) OVER w = kind AND ((kind = 'heading' AND lag(level) OVER w = level) OR (kind = 'paragraph' AND abs(lag((y0 + y1) / 2) OVER w - (y0 + y1) / 2) <= body * 2)) THEN 0 ELSE 1 END AS new
  FROM classed WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_idx)
), blocks AS (
  SELECT doc_id, page, block_idx::INTEGER AS block_idx, first(kind) AS type, string_agg(text, ' ' ORDER BY line_idx) AS text, first(level) AS level, first(indent_level) AS indent_level,
         min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
  FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY line_idx) - 1 AS block_idx FROM marked) GROUP BY doc_id, page, block_idx
)"""


@query("structure_blocks", f"WITH {BLOCKS} SELECT * FROM blocks")
def structure_blocks(spark, d):
    return structure.extract(mapped.spans(spark, d))


@query("spans_markdown", f"""WITH {BLOCKS}, pieces AS (
  SELECT *, lag(page) OVER w AS bp, lag(type) OVER w AS bt, row_number() OVER w AS rn,
         CASE type WHEN 'heading' THEN repeat('#', level) || ' ' || trim(text)
                   WHEN 'list_item' THEN repeat('  ', indent_level) || '- ' || regexp_replace(text, '^\\s*([-*•‣◦⁃–—]|[0-9]+[.)]|[A-Za-z][.)]) ', '') ELSE trim(text) END AS body
  FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY page, block_idx)
)
SELECT doc_id, string_agg((CASE WHEN bp IS NULL THEN '' WHEN bp = page AND type = 'list_item' AND bt = 'list_item' THEN chr(10) ELSE chr(10) || chr(10) END)
       || (CASE WHEN bp <> page THEN '---' || chr(10) || chr(10) ELSE '' END) || body, '' ORDER BY page, block_idx) || chr(10) AS markdown
FROM pieces GROUP BY doc_id""")  # fmt: skip
def spans_markdown(spark, d):
    return markdown.render(structure.extract(mapped.spans(spark, d)))


# --- tables ----------------------------------------------------------------

POINTS = f"""{RECTS}, {SPANS}, sides AS (
  SELECT doc_id, page, x AS ax, y AS ay, x + w AS bx, y AS by FROM rects UNION SELECT doc_id, page, x, y + h, x + w, y + h FROM rects
  UNION SELECT doc_id, page, x, y, x, y + h FROM rects UNION SELECT doc_id, page, x + w, y, x + w, y + h FROM rects
), points AS (
  SELECT DISTINCT f.doc_id, f.page, round(u.ax / 3) * 3 AS px, round(f.ay / 3) * 3 AS py FROM sides f JOIN sides u ON f.doc_id = u.doc_id AND f.page = u.page
  WHERE f.ay = f.by AND u.ax = u.bx AND u.ax BETWEEN f.ax - 3 AND f.bx + 3 AND f.ay BETWEEN u.ay - 3 AND u.by + 3
)"""


def _points(spark, d):
    return tables.intersections(tables.rectangle_segments(mapped.rects(spark, d)))


@query("intersections", f"WITH {POINTS} SELECT doc_id, page, px, py FROM points")
def intersections(spark, d):
    return _points(spark, d)


#: Points that share a place on either axis are of one table; the cells between the lines of each.
LATTICE = f"""{POINTS}, reach AS (
  SELECT doc_id, page, px, py, px AS qx, py AS qy FROM points
  UNION SELECT r.doc_id, r.page, r.px, r.py, p.px, p.py FROM reach r JOIN points p ON p.doc_id = r.doc_id AND p.page = r.page AND (p.px = r.qx OR p.py = r.qy)
), comps AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, page, c) AS n FROM (SELECT doc_id, page, px, py, min(qx * 100000 + qy) AS c FROM reach GROUP BY doc_id, page, px, py)
), ex AS (
  SELECT *, row_number() OVER w - 1 AS col, lead(px) OVER w AS nx FROM (SELECT DISTINCT doc_id, page, c, px FROM comps WHERE n >= 4) WINDOW w AS (PARTITION BY doc_id, page, c ORDER BY px)
), ey AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page, c ORDER BY py DESC) - 2 AS row, lead(py) OVER (PARTITION BY doc_id, page, c ORDER BY py) AS ny FROM (SELECT DISTINCT doc_id, page, c, py FROM comps WHERE n >= 4)
), lcells AS (
  SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY c) - 1 AS table_id FROM (
    SELECT ex.doc_id, ex.page, ex.c, row, col, px AS x0, py AS y0, nx AS x1, ny AS y1, max(row) OVER w AS r, max(col) OVER w AS k FROM ex JOIN ey ON ex.doc_id = ey.doc_id AND ex.page = ey.page AND ex.c = ey.c WHERE nx IS NOT NULL AND ny IS NOT NULL WINDOW w AS (PARTITION BY ex.doc_id, ex.page, ex.c))
  WHERE r >= 1 AND k >= 1
), ltexts AS (
  SELECT c.doc_id, c.page, c.table_id, c.row, c.col, string_agg(s.text, ' ' ORDER BY s.line_idx, s.span_idx) AS text FROM lcells c JOIN spans s ON s.doc_id = c.doc_id AND s.page = c.page
  AND s.x + s.width / 2 BETWEEN c.x0 AND c.x1 AND s.y BETWEEN c.y0 AND c.y1 GROUP BY ALL
), lattice AS (
  SELECT c.doc_id, c.page, c.table_id::INTEGER AS table_id, c.row::INTEGER AS row, c.col::INTEGER AS col, coalesce(trim(t.text), '') AS text, c.x0, c.y0, c.x1, c.y1 FROM lcells c LEFT JOIN ltexts t USING (doc_id, page, table_id, row, col)
)"""


@query("lattice_cells", f"WITH RECURSIVE {LATTICE} SELECT * FROM lattice")
def lattice_cells(spark, d):
    return tables.lattice(tables.rectangle_segments(mapped.rects(spark, d)), mapped.spans(spark, d))


@query("cells_from_spans", f"""WITH {POINTS}, ex AS (SELECT doc_id, page, px, lead(px) OVER (PARTITION BY doc_id, page ORDER BY px) AS nx, row_number() OVER (PARTITION BY doc_id, page ORDER BY px) - 1 AS col FROM (SELECT DISTINCT doc_id, page, px FROM points)
), ey AS (SELECT doc_id, page, py, lead(py) OVER (PARTITION BY doc_id, page ORDER BY py) AS ny, row_number() OVER (PARTITION BY doc_id, page ORDER BY py DESC) - 2 AS row FROM (SELECT DISTINCT doc_id, page, py FROM points)
), cells AS (SELECT ex.doc_id, ex.page, row, col, px AS x0, py AS y0, nx AS x1, ny AS y1 FROM ex JOIN ey USING (doc_id, page) WHERE nx IS NOT NULL AND ny IS NOT NULL
), texts AS (SELECT c.doc_id, c.page, c.row, c.col, string_agg(s.text, ' ' ORDER BY s.line_idx, s.span_idx) AS text FROM cells c JOIN spans s ON s.doc_id = c.doc_id AND s.page = c.page
  AND s.x + s.width / 2 BETWEEN c.x0 AND c.x1 AND s.y BETWEEN c.y0 AND c.y1 GROUP BY ALL)
SELECT c.doc_id, c.page, c.row::INTEGER AS row, c.col::INTEGER AS col, c.x0, c.y0, c.x1, c.y1, coalesce(trim(t.text), '') AS text FROM cells c LEFT JOIN texts t USING (doc_id, page, row, col)""")  # fmt: skip
def cells_from_spans(spark, d):
    one = _points(spark, d).withColumn("table_id", F.lit(0))  # the whole page as one grid: clusters have no SQL
    return tables.fill(tables.grid(one), mapped.spans(spark, d)).drop("table_id")


WORDS = f"""{SPANS}, wgaps AS (
  SELECT *, x - lag(x + width) OVER w AS gap FROM spans WINDOW w AS (PARTITION BY doc_id, page, line_idx ORDER BY span_idx)
), wnew AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line_idx ORDER BY span_idx) - 1 AS word_idx FROM wgaps
), words AS (
  SELECT doc_id, page, line_idx, word_idx::INTEGER AS word_idx, arg_min(x, span_idx) AS w0, arg_max(x + width, span_idx) AS w1,
         string_agg((CASE WHEN gap <= 10 AND gap > font_size * 0.25 THEN ' ' ELSE '' END) || text, '' ORDER BY span_idx) AS text FROM wnew GROUP BY doc_id, page, line_idx, word_idx
), modal AS (
  SELECT doc_id, page, n::INTEGER AS cols FROM (SELECT doc_id, page, n, row_number() OVER (PARTITION BY doc_id, page ORDER BY count(*) DESC, n DESC) AS rn
    FROM (SELECT doc_id, page, line_idx, count(*) AS n FROM words GROUP BY ALL) GROUP BY doc_id, page, n) WHERE rn = 1
)"""


@query("stream_words", f"WITH {WORDS} SELECT * FROM words")
def stream_words(spark, d):
    return tables.words(mapped.spans(spark, d))


@query("stream_mode_cols", f"WITH {WORDS} SELECT * FROM modal")
def stream_mode_cols(spark, d):
    return tables.modal_columns(tables.words(mapped.spans(spark, d)))


BOUNDS = f"""{WORDS}, edges AS (
  SELECT doc_id, page, w0, cols, row_number() OVER (PARTITION BY doc_id, page ORDER BY w0, line_idx) - 1 AS rn, count(*) OVER (PARTITION BY doc_id, page) // cols AS size
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, page, line_idx) AS n FROM words) JOIN modal USING (doc_id, page) WHERE n = cols
), bounds AS (SELECT doc_id, page, (rn // size)::INTEGER AS col, avg(w0) AS b FROM edges WHERE rn // size < cols GROUP BY ALL
), aligned AS (
  SELECT doc_id, page, line_idx, count(*) AS n, count(*) FILTER (WHERE near) AS k FROM (
    SELECT w.doc_id, w.page, w.line_idx, w.word_idx, coalesce(bool_or(abs(w.w0 - b.b) < 20), false) AS near FROM words w LEFT JOIN bounds b ON b.doc_id = w.doc_id AND b.page = w.page GROUP BY ALL) GROUP BY ALL
), fine AS (
  SELECT doc_id, page, line_idx, rn - row_number() OVER (PARTITION BY doc_id, page ORDER BY line_idx) AS run FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_idx) AS rn FROM aligned) WHERE n >= 2 AND k / n > 0.5
), runs AS (
  SELECT doc_id, page, line_idx, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY run) - 1 AS table_id, row_number() OVER (PARTITION BY doc_id, page, run ORDER BY line_idx) - 1 AS row FROM (
    SELECT *, count(*) OVER (PARTITION BY doc_id, page, run) AS rows FROM fine) WHERE rows >= 2
)"""


@query("stream_boundaries", f"WITH {BOUNDS} SELECT doc_id, page, col, round(b, 6) AS b FROM bounds")
def stream_boundaries(spark, d):
    found = tables.words(mapped.spans(spark, d))
    return tables.boundaries(found, tables.modal_columns(found)).withColumn("b", F.round("b", 6))


STREAM = f"""{BOUNDS}, hit AS (
  SELECT r.doc_id, r.page, r.table_id, r.row, w.word_idx, w.text, coalesce(max(b.col) FILTER (WHERE (w.w0 + w.w1) / 2 >= b.b - 10), 0) AS col
  FROM words w JOIN runs r USING (doc_id, page, line_idx) JOIN bounds b ON b.doc_id = w.doc_id AND b.page = w.page GROUP BY ALL
), stexts AS (SELECT doc_id, page, table_id, row, col, string_agg(text, ' ' ORDER BY word_idx) AS text FROM hit GROUP BY ALL
), stream AS (SELECT r.doc_id, r.page, r.table_id::INTEGER AS table_id, r.row::INTEGER AS row, b.col, coalesce(t.text, '') AS text
  FROM runs r JOIN bounds b ON b.doc_id = r.doc_id AND b.page = r.page LEFT JOIN stexts t ON t.doc_id = r.doc_id AND t.page = r.page AND t.table_id = r.table_id AND t.row = r.row AND t.col = b.col
)"""


@query("stream_tables", f"WITH {STREAM} SELECT * FROM stream")
def stream_tables(spark, d):
    return tables.stream(mapped.spans(spark, d))


@query("table_strategy", f"""WITH RECURSIVE {LATTICE}, {STREAM[len(SPANS) + 2:]} SELECT doc_id, page, table_id, row, col, text, 'lattice' AS strategy FROM lattice
UNION ALL SELECT doc_id, page, table_id, row, col, text, 'stream' FROM stream s WHERE NOT EXISTS (SELECT 1 FROM lattice l WHERE l.doc_id = s.doc_id AND l.page = s.page)""")
def table_strategy(spark, d):
    return tables.detect(tables.rectangle_segments(mapped.rects(spark, d)), mapped.spans(spark, d)).select(*PAGE, "table_id", "row", "col", "text", "strategy")
