"""Queries on texts, page sets, differences, metadata, security, forms and rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import compare, forms, lines, markdown, metrics, mutate, pageset, search, security, tables, validate

QUERIES = []


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES.append((name, fn, sql))
        return fn

    return add


def read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


LINES = "split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), lines AS (SELECT doc_id, i::INTEGER AS line_idx, text FROM split)"


def _lines(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_idx", "text"))


@query("doc_lines", f"WITH {LINES} SELECT doc_id, line_idx, text, (row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) * 14 - 14)::DOUBLE AS y, (strlen(text) * 7)::DOUBLE AS width FROM lines WHERE trim(text) <> ''")
def doc_lines(spark, d):
    return lines.text_lines(read(spark, d, "documents"))


@query("conversation_text", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def conversation_text(spark, d):
    return lines.page_texts(read(spark, d, "conversations"), ["conv_id"], "turn")


@query("search_literal", f"WITH {LINES} SELECT doc_id, line_idx + 1 AS line, text FROM lines WHERE contains(text, 'the ')")
def search_literal(spark, d):
    return search.hits(_lines(spark, d), "the ").select("doc_id", (F.col("line_idx") + 1).alias("line"), "text")


@query("search_icase", f"WITH {LINES} SELECT doc_id, line_idx + 1 AS line, text FROM lines WHERE contains(lower(text), 'tion')")
def search_icase(spark, d):
    return search.hits(_lines(spark, d), "TION", case_sensitive=False).select("doc_id", (F.col("line_idx") + 1).alias("line"), "text")


EMAIL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}"


@query("search_regex", f"WITH {LINES} SELECT doc_id, line_idx + 1 AS line, text FROM lines WHERE regexp_matches(text, '{EMAIL}')")
def search_regex(spark, d):
    return search.hits(_lines(spark, d), EMAIL, regex=True).select("doc_id", (F.col("line_idx") + 1).alias("line"), "text")


@query("search_topk", f"WITH {LINES} SELECT doc_id, line_idx, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) AS r FROM lines WHERE contains(text, 'en')) WHERE r <= 3")
def search_topk(spark, d):
    return search.first_hits(search.hits(_lines(spark, d), "en"), ["doc_id"], ["line_idx"], 3)


@query("page_ranges", "SELECT n_nationkey, unnest(list_sort(list_distinct(list_concat(range(1, n_regionkey + 2), [n_nationkey + 3], range(n_regionkey + 1, n_regionkey + 4)))))::INTEGER AS page FROM nation")
def page_ranges(spark, d):
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    text = F.format_string("1-%d, %d,%d - %d", r + 1, n + 3, r + 1, r + 3)
    return read(spark, d, "nation").select("n_nationkey", F.explode(search.page_numbers(text)).alias("page"))


MARKER = T.MARKER.replace("'", "''")


@query("list_marker", f"WITH {LINES} SELECT doc_id, line_idx, text FROM lines WHERE regexp_matches(text, '{MARKER}')")
def list_marker(spark, d):
    return _lines(spark, d).filter(T.is_list_item(F.col("text")))


@query("strip_marker", f"WITH {LINES} SELECT doc_id, line_idx, CASE WHEN regexp_matches(text, '{MARKER}') THEN regexp_replace(text, '{MARKER}', '') ELSE ltrim(text) END AS text FROM lines")
def strip_marker(spark, d):
    return _lines(spark, d).select("doc_id", "line_idx", T.strip_marker(F.col("text")).alias("text"))


@query("wrap_text", r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM conversations WHERE text IS NOT NULL
), l AS (SELECT conv_id, turn, string_split(CASE WHEN len(words) = 0 THEN '' ELSE list_reduce(words, lambda acc, x: acc || CASE WHEN strlen(regexp_extract(acc, '[^\n]*$')) + 1 + strlen(x) <= 80 THEN ' ' ELSE chr(10) END || x) END, chr(10)) AS lines FROM w)
SELECT conv_id, turn, (generate_subscripts(lines, 1) - 1)::INTEGER AS line_idx, unnest(lines) AS line FROM l""")
def wrap_text(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.wrap(F.col("text"))).alias("line_idx", "line"))


@query("escapes", """SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html, replace(replace(replace(text, '\\', '\\\\'), '(', '\\('), ')', '\\)') AS pdf FROM documents""")
def escapes(spark, d):
    return read(spark, d, "documents").select("doc_id", T.escape_html(F.col("text")).alias("html"), T.escape_pdf(F.col("text")).alias("pdf"))


@query("format_number", "SELECT p_partkey, regexp_replace(regexp_replace(printf('%.6f', p_retailprice / 7), '0+$', ''), '[.]$', '') AS n FROM part")
def format_number(spark, d):
    return read(spark, d, "part").select("p_partkey", T.format_number(F.col("p_retailprice") / 7).alias("n"))


# --- tables as text --------------------------------------------------------


def _nation_cells(spark, d):
    n = read(spark, d, "nation")
    cells = F.array(F.col("n_nationkey").cast("string"), F.col("n_name"), F.concat(F.lit("a|b "), F.col("n_regionkey").cast("string")))
    return n.select(F.col("n_regionkey").alias("table_id"), F.col("n_nationkey").alias("row"), F.posexplode(cells).alias("col", "text"))


@query("pipe_table", r"""WITH c AS (SELECT n_regionkey AS t, n_nationkey AS row, [n_nationkey::VARCHAR, n_name, 'a\|b ' || n_regionkey] AS x FROM nation
), w AS (SELECT t, greatest(3, max(strlen(x[1]))) AS a, greatest(3, max(strlen(x[2]))) AS b, greatest(3, max(strlen(x[3]))) AS c FROM c GROUP BY t
), l AS (SELECT c.t, c.row, '| ' || rpad(x[1], a::INTEGER, ' ') || ' | ' || rpad(x[2], b::INTEGER, ' ') || ' | ' || rpad(x[3], w.c::INTEGER, ' ') || ' |' AS line,
  '| ' || repeat('-', a) || ' | ' || repeat('-', b) || ' | ' || repeat('-', w.c) || ' |' AS rule, row_number() OVER (PARTITION BY c.t ORDER BY c.row) AS rn FROM c JOIN w ON c.t = w.t)
SELECT t AS table_id, string_agg(line || CASE WHEN rn = 1 THEN chr(10) || rule ELSE '' END, chr(10) ORDER BY row) || chr(10) AS "table" FROM l GROUP BY t""")  # fmt: skip
def pipe_table(spark, d):
    return markdown.pipe_tables(_nation_cells(spark, d), ["table_id"])


@query("html_table", """WITH r AS (SELECT n_regionkey AS t, n_nationkey AS row, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn, [n_nationkey::VARCHAR, n_name, 'a|b ' || n_regionkey] AS x FROM nation
), l AS (SELECT t, row, CASE WHEN rn = 1 THEN 'th' ELSE 'td' END AS g, x FROM r)
SELECT t AS table_id, '<table>' || chr(10) || string_agg('  <tr>' || chr(10) || array_to_string([('    <' || g || '>' || v || '</' || g || '>' || chr(10)) FOR v IN x], '') || '  </tr>' || chr(10), '' ORDER BY row) || '</table>' || chr(10) AS "table" FROM l GROUP BY t""")  # fmt: skip
def html_table(spark, d):
    return markdown.html_tables(_nation_cells(spark, d), ["table_id"])


@query("table_csv", "SELECT n_regionkey AS table_id, string_agg(n_nationkey || ',' || n_name || ',a|b ' || n_regionkey, chr(10) ORDER BY n_nationkey) || chr(10) AS csv FROM nation GROUP BY n_regionkey")
def table_csv(spark, d):
    return tables.to_csv(_nation_cells(spark, d), ["table_id"])


# --- page sets: a conversation is a document, a turn a page -----------------


def _pages(spark, d):
    c = read(spark, d, "conversations")
    w = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return c.select(F.col("conv_id").alias("doc_id"), w.alias("page"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit(0).alias("rotation"), "role", "text")


PAGES = "pages_ AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)::INTEGER AS page, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, 0 AS rotation, role, text FROM conversations)"


@query("merge_docs", f"WITH {PAGES} SELECT doc_id // 3 AS merged, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id, page)::INTEGER AS page, doc_id, text FROM pages_")
def merge_docs(spark, d):
    p = _pages(spark, d).withColumn("merged", F.floor(F.col("doc_id") / 3)).withColumn("_old", F.col("page"))
    return pageset.merge(p, "merged", ["doc_id", "_old"]).select("merged", "page", "doc_id", "text")


@query("split_ranges", f"WITH {PAGES} SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id, part ORDER BY page)::INTEGER AS page, text FROM pages_ JOIN (VALUES (0, 1, 2), (1, 2, 4), (2, 5, 99)) AS r(part, a, b) ON page BETWEEN a AND b")
def split_ranges(spark, d):
    return pageset.split(_pages(spark, d), [(1, 2), (2, 4), (5, 99)]).select("doc_id", "part", "page", "text")


@query("reorder_pages", f"WITH {PAGES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INTEGER AS page, text FROM pages_ JOIN (VALUES (0, 3), (1, 1), (2, 1), (3, 2)) AS o(pos, p) ON page = p")
def reorder_pages(spark, d):
    return pageset.reorder(_pages(spark, d), [3, 1, 1, 2]).select("doc_id", "page", "text")


@query("missing_pages", f"WITH {PAGES} SELECT DISTINCT d.doc_id, n.p AS page FROM pages_ d CROSS JOIN (VALUES (1), (3), (7)) AS n(p) WHERE NOT EXISTS (SELECT 1 FROM pages_ x WHERE x.doc_id = d.doc_id AND x.page = n.p)")
def missing_pages(spark, d):
    return pageset.missing(_pages(spark, d), [3, 7, 1])


@query("delete_pages", f"""WITH {PAGES}, k AS (SELECT *, count(*) FILTER (WHERE page NOT IN (1, 2)) OVER (PARTITION BY doc_id) AS n FROM pages_)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page)::INTEGER AS page, text, CASE WHEN n = 0 THEN 'at least one page must remain' END AS error FROM k WHERE page NOT IN (1, 2) OR n = 0""")  # fmt: skip
def delete_pages(spark, d):
    return pageset.delete(_pages(spark, d), [1, 2]).select("doc_id", "page", "text", "error")


@query("insert_blank", f"""WITH {PAGES}, n AS (SELECT DISTINCT p.doc_id, b.a, b.i FROM pages_ p CROSS JOIN (VALUES (0, 0), (2, 1), (2, 2)) AS b(a, i) WHERE b.a <= (SELECT max(page) FROM pages_ q WHERE q.doc_id = p.doc_id)
), u AS (SELECT doc_id, page AS a, -100 AS i, text, false AS blank FROM pages_ UNION ALL SELECT doc_id, a, -i, NULL, true FROM n)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, i)::INTEGER AS page, text, blank FROM u""")  # fmt: skip
def insert_blank(spark, d):
    return pageset.insert_blank(_pages(spark, d), [(0, 612, 792), (2, 612, 792), (2, 100, 100)]).select("doc_id", "page", "text", "blank")


@query("rotate_pages", f"WITH {PAGES} SELECT doc_id, page, coalesce(CASE page WHEN 1 THEN 90 WHEN 3 THEN 270 END, rotation) AS rotation FROM pages_")
def rotate_pages(spark, d):
    return pageset.rotate(_pages(spark, d), [(1, 90), (3, 270)]).select("doc_id", "page", "rotation")


@query("reachable_objects", """WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS src, ((n_nationkey * 3 + 1) % 25)::BIGINT AS dst FROM nation), r AS (SELECT 0::BIGINT AS id UNION SELECT e.dst FROM e JOIN r ON e.src = r.id) SELECT id FROM r""")
def reachable_objects(spark, d):
    e = read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("src"), ((F.col("n_nationkey") * 3 + 1) % 25).cast("bigint").alias("dst"))
    return pageset.closure(e, spark.range(1))


# --- differences -----------------------------------------------------------


def _two(spark, d):
    p = _pages(spark, d)
    a = p.filter(~((F.col("doc_id") % 5 == 0) & (F.col("page") == 1)))
    b = p.filter(~((F.col("doc_id") % 7 == 0) & (F.col("page") == 2))).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    ls = lambda x: x.select("doc_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("line_idx", "text"))
    return a, b, ls(a), ls(b)


@query("diff_lines", f"""WITH RECURSIVE {PAGES}, a AS (SELECT doc_id, page, text FROM pages_ WHERE NOT (doc_id % 5 = 0 AND page = 1)
), b AS (SELECT doc_id, page, CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END AS text FROM pages_ WHERE NOT (doc_id % 7 = 0 AND page = 2)
), both_ AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page, b.page) AS page, coalesce(string_split(a.text, chr(10)), []) AS x, coalesce(string_split(b.text, chr(10)), []) AS y FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.page = b.page
), cut AS (SELECT *, coalesce(list_min([i FOR i IN range(1, least(len(x), len(y)) + 1) IF x[i] <> y[i]]) - 1, least(len(x), len(y))) AS s FROM both_
), q AS (SELECT doc_id, page, s, x[s + 1 :] AS x, y[s + 1 :] AS y, len(x) - s AS n, len(y) - s AS m FROM cut WHERE len(x) + len(y) > 2 * s
), lengths(doc_id, page, i, best) AS (
  SELECT doc_id, page, 0::BIGINT, [0::BIGINT FOR k IN range(m + 1)] FROM q
  UNION ALL SELECT r.doc_id, r.page, r.i + 1, list_prepend(0::BIGINT, [list_max([greatest(r.best[t + 1], r.best[t] + (q.x[r.i + 1] = q.y[t])::BIGINT) FOR t IN range(1, k + 1)]) FOR k IN range(1, q.m + 1)])
  FROM lengths r JOIN q ON q.doc_id = r.doc_id AND q.page = r.page WHERE r.i < q.n
), back(doc_id, page, step, i, j, kind, ta, tb, la, lb) AS (
  SELECT doc_id, page, 0::BIGINT, n, m, 'same', NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT FROM q
  UNION ALL SELECT doc_id, page, step + 1, CASE WHEN mv = 'added' THEN i ELSE i - 1 END, CASE WHEN mv = 'removed' THEN j ELSE j - 1 END, mv, CASE WHEN mv = 'removed' THEN x[i] END, CASE WHEN mv = 'added' THEN y[j] END, CASE WHEN mv = 'removed' THEN s + i - 1 END, CASE WHEN mv = 'added' THEN s + j - 1 END
  FROM (SELECT t.doc_id, t.page, t.step, t.i, t.j, q.x, q.y, q.s, CASE WHEN t.i > 0 AND t.j > 0 AND q.x[t.i] = q.y[t.j] THEN 'same' WHEN t.j > 0 AND (t.i = 0 OR r1.best[t.j] >= r0.best[t.j + 1]) THEN 'added' ELSE 'removed' END AS mv
    FROM back t JOIN q ON q.doc_id = t.doc_id AND q.page = t.page JOIN lengths r1 ON r1.doc_id = t.doc_id AND r1.page = t.page AND r1.i = t.i LEFT JOIN lengths r0 ON r0.doc_id = t.doc_id AND r0.page = t.page AND r0.i = t.i - 1 WHERE t.i + t.j > 0)
), ops AS (SELECT *, lead(kind) OVER w AS k2, lead(tb) OVER w AS y, lead(lb) OVER w AS ly FROM back WHERE kind <> 'same' WINDOW w AS (PARTITION BY doc_id, page ORDER BY step DESC)
), same_ AS (SELECT *, coalesce(list_min([c FOR c IN range(1, least(length(ta), length(y)) + 1) IF substr(ta, c, 1) <> substr(y, c, 1)]) - 1, least(length(ta), length(y))) AS c FROM ops
), marked AS (SELECT *, coalesce(kind = 'removed' AND k2 = 'added' AND least(strlen(ta), strlen(y)) > 0 AND c / least(strlen(ta), strlen(y)) >= 0.3::DOUBLE, false) AS hit FROM same_
), eaten AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY doc_id, page ORDER BY step DESC), false) AS gone FROM marked)
SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY step DESC) - 1)::INTEGER AS op_idx, CASE WHEN hit THEN 'changed' ELSE kind END AS kind, ta AS text_a, CASE WHEN hit THEN y ELSE tb END AS text_b, la::INTEGER AS line_a, (CASE WHEN hit THEN ly ELSE lb END)::INTEGER AS line_b
FROM eaten WHERE NOT gone""")  # fmt: skip
def diff_lines(spark, d):
    _, _, a, b = _two(spark, d)
    return compare.diff_lines(a, b)


@query("diff_pages", f"""WITH {PAGES}, a AS (SELECT doc_id, page, text FROM pages_ WHERE NOT (doc_id % 5 = 0 AND page = 1)
), b AS (SELECT doc_id, page, CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END AS text FROM pages_ WHERE NOT (doc_id % 7 = 0 AND page = 2)
), j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.text AS x, b.text AS y FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.page = b.page)
SELECT doc_id, count(*) FILTER (WHERE x <> y) AS pages_changed, count(*) FILTER (WHERE x IS NULL) AS pages_added, count(*) FILTER (WHERE y IS NULL) AS pages_removed FROM j GROUP BY doc_id""")  # fmt: skip
def diff_pages(spark, d):
    a, b, la, lb = _two(spark, d)
    return compare.summary(compare.diff_lines(la, lb), a, b).drop("additions", "removals", "changes")


@query("diff_merge_changes", """WITH o AS (SELECT o_orderkey // 8 AS g, o_orderkey % 8 AS i, CASE WHEN o_orderkey % 2 = 0 THEN 'removed' ELSE 'added' END AS kind, o_orderpriority AS t FROM orders
), w AS (SELECT *, lead(kind) OVER x AS k2, lead(t) OVER x AS y FROM o WINDOW x AS (PARTITION BY g ORDER BY i)
), s AS (SELECT *, coalesce(list_min([n FOR n IN range(1, least(length(t), length(y)) + 1) IF substr(t, n, 1) <> substr(y, n, 1)]) - 1, least(length(t), length(y))) AS c FROM w
), m AS (SELECT *, coalesce(kind = 'removed' AND k2 = 'added' AND c / least(strlen(t), strlen(y)) >= 0.3::DOUBLE, false) AS m FROM s
), e AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY g ORDER BY i), false) AS eaten FROM m)
SELECT g, i AS op_idx, CASE WHEN m THEN 'changed' ELSE kind END AS kind, CASE WHEN kind = 'removed' THEN t END AS text_a, CASE WHEN m THEN y WHEN kind = 'added' THEN t END AS text_b FROM e WHERE NOT eaten""")  # fmt: skip
def diff_merge_changes(spark, d):
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    gone = k % 2 == 0
    ops = o.select(F.floor(k / 8).alias("g"), (k % 8).alias("op_idx"), F.when(gone, "removed").otherwise("added").alias("kind"), F.when(gone, F.col("o_orderpriority")).alias("text_a"), F.when(~gone, F.col("o_orderpriority")).alias("text_b"))
    return compare.merge_changes(ops, ["g"])


@query("visual_similarity", """WITH p AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (ORDER BY vec_id) AS b FROM embeddings
), c AS (SELECT vec_id, len(list_filter(list_zip(a, b), lambda v: abs(v[1] - v[2]) > 0.1::FLOAT)) AS changed, len(a) AS total FROM p WHERE b IS NOT NULL)
SELECT vec_id, changed::INTEGER AS changed, round(1.0::DOUBLE - changed / total, 6) AS similarity FROM c""")  # fmt: skip
def visual_similarity(spark, d):
    v = read(spark, d, "embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))  # ids follow each other
    changed = compare.changed_pixels(F.col("embedding"), F.col("b"), F.lit(0.1).cast("float"))
    both = v.join(nxt, "vec_id").select("vec_id", changed.alias("changed"), F.size("embedding").alias("total"))
    return both.select("vec_id", "changed", F.round(compare.similarity(F.col("changed"), F.col("total")), 6).alias("similarity"))


# --- metadata, tables of contents, optimisation ------------------------------


@query("set_metadata", "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'T' || c_custkey ELSE c_name END AS title, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS subject FROM customer")
def set_metadata(spark, d):
    c = read(spark, d, "customer")
    docs = c.select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("subject"))
    k = F.col("c_custkey")
    new = c.filter((k % 3 == 0) | (k % 4 == 0)).select(k.alias("doc_id"), (k % 3 == 0).alias("set_title"), F.concat(F.lit("T"), k).alias("title"), (k % 4 == 0).alias("set_subject"), F.lit(None).cast("string").alias("subject"))
    return mutate.set_metadata(docs, new, ["title", "subject"])


@query("toc_hierarchy", """WITH h AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord, substr(o_orderpriority, 1, 1)::INTEGER AS level, o_orderkey AS title FROM orders
) SELECT a.doc_id, a.ord, a.level, a.title, (SELECT max(b.ord) FROM h b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level) AS parent FROM h a""")  # fmt: skip
def toc_hierarchy(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey"), F.lit("heading").alias("type"), F.substring("o_orderpriority", 1, 1).cast("int").alias("level"), F.col("o_orderkey").alias("text"), F.lit(1).alias("page"))
    return mutate.toc(o, ["doc_id"], "o_orderkey").select("doc_id", F.col("ord").cast("bigint").alias("ord"), "level", "title", "parent")


@query("watermark_place", "SELECT p_partkey, round(612.0::DOUBLE / 2 - strlen(p_name) * 60.0::DOUBLE * 0.5::DOUBLE * cos(radians(45)) / 2, 6) AS x, round((700.0::DOUBLE + p_size) / 2 - strlen(p_name) * 60.0::DOUBLE * 0.5::DOUBLE * sin(radians(45)) / 2, 6) AS y FROM part")
def watermark_place(spark, d):
    x, y = mutate.watermark_place(F.lit(612.0), F.lit(700.0) + F.col("p_size"), F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("dedupe_docs", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents")
def dedupe_docs(spark, d):
    return mutate.dedupe(read(spark, d, "documents"), "doc_id", "text")


@query("reduction_percent", "SELECT p_partkey, round(CASE WHEN p_size > 20 THEN (1 - 20.0::DOUBLE / p_size) * 100 ELSE 0.0 END, 6) AS pct FROM part")
def reduction_percent(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(mutate.reduction(F.col("p_size"), F.least(F.col("p_size"), F.lit(20.0))), 6).alias("pct"))


# --- security, forms, rules ------------------------------------------------


@query("redact_text", f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '█', 'g') AS text, len(regexp_extract_all(text, '{EMAIL}')) AS n_redacted FROM documents")
def redact_text(spark, d):
    return security.redact_matches(read(spark, d, "documents").select("doc_id", "text"), EMAIL)


@query("sanitize_html", """SELECT page_id, regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g') AS html, len(regexp_extract_all(html, '(?is)<script\\b[^>]*>.*?</script\\s*>')) AS n_javascript FROM pages""")
def sanitize_html(spark, d):
    return security.sanitize_html(read(spark, d, "pages"), remove_links=False).select("page_id", "html", "n_javascript")


@query("permissions_mask", """SELECT p_partkey, (4294963200 + 192 + CASE WHEN p_size % 2 = 0 THEN 4 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 8 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 16 ELSE 0 END + 32 + 256 + 512 + 1024 + 2048 - 4294967296)::INTEGER AS mask FROM part""")
def permissions_mask(spark, d):
    s = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", security.permission_mask(print=s % 2 == 0, modify=s % 3 == 0, copy=s % 5 == 0).alias("mask"))


@query("encrypt_round_trip", "SELECT conv_id, turn, text FROM conversations")
def encrypt_round_trip(spark, d):
    return security.decrypt_column(security.encrypt_column(read(spark, d, "conversations").select("conv_id", "turn", "text"), "text", "secret"), "text", "secret")


@query("classify_field", """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'text' WHEN 1 THEN CASE WHEN (p_partkey * 4096) & 65536 <> 0 THEN 'push_button' WHEN (p_partkey * 4096) & 32768 <> 0 THEN 'radio_button' ELSE 'checkbox' END
 WHEN 2 THEN CASE WHEN (p_partkey * 4096) & 131072 <> 0 THEN 'combo_box' ELSE 'list_box' END WHEN 3 THEN 'signature' ELSE 'unknown' END AS type FROM part""")  # fmt: skip
def classify_field(spark, d):
    ft = F.element_at(F.array(*[F.lit(x) for x in ("Tx", "Btn", "Ch", "Sig", "Zz")]), F.col("p_size") % 5 + 1)
    return read(spark, d, "part").select("p_partkey", forms.field_type(ft, F.col("p_partkey") * 4096).alias("type"))


@query("heading_skip", """WITH h AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, substr(o_orderpriority, 1, 1)::INTEGER AS level FROM orders), w AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY ord) AS b FROM h)
SELECT doc_id, 'H' || b || ' is followed by H' || level AS message FROM w WHERE level > b + 1""")  # fmt: skip
def heading_skip(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.substring("o_orderpriority", 1, 1).cast("int").alias("level"))
    return validate.heading_skips(o).select("doc_id", "message")


@query("html_rules", """WITH i AS (SELECT page_id, 'lang.missing' AS rule, 'error' AS severity FROM pages WHERE NOT regexp_matches(html, '(?i)<html[^>]*\\slang=')
 UNION ALL SELECT page_id, 'title.missing', 'error' FROM pages WHERE trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)) = ''
 UNION ALL SELECT page_id, 'heading.missing', 'warning' FROM pages WHERE NOT regexp_matches(html, '(?i)<h1[ >]')
 UNION ALL SELECT page_id, 'figure.no_alt', 'error' FROM pages WHERE len(regexp_extract_all(html, '(?i)<img\\b')) > len(regexp_extract_all(html, '(?i)<img\\b[^>]*\\salt='))
 UNION ALL SELECT page_id, 'javascript.action', 'warning' FROM pages WHERE regexp_matches(html, '(?i)<script\\b'))
SELECT page_id AS doc_id, rule, severity FROM i""")  # fmt: skip
def html_rules(spark, d):
    return validate.issues(read(spark, d, "pages"), validate.HTML, "page_id").select("doc_id", "rule", "severity")


@query("action_category", "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'metadata' WHEN 1 THEN 'color' WHEN 2 THEN 'encryption' WHEN 3 THEN 'transparency' WHEN 4 THEN 'actions' ELSE 'other' END AS category FROM part")
def action_category(spark, d):
    said = F.element_at(F.array(*[F.lit(x) for x in ("Wrote XMP", "Added output intent", "Removed encryption", "Dropped transparency", "Removed JavaScript", "Renamed")]), F.col("p_size") % 6 + 1)
    return read(spark, d, "part").select("p_partkey", validate.action_category(said).alias("category"))


# --- metrics ---------------------------------------------------------------


def _cells(spark, d, shift):
    n = F.col("l_linenumber")
    li = read(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("t"), n.alias("row"), ((F.col("l_partkey") + shift) % 4).alias("col"), (F.col("l_suppkey") % 2 + 1).alias("row_span"), F.lit(1).alias("col_span"), F.concat(F.lit(" W  "), ((F.col("l_suppkey") + shift) % 9).cast("string")).alias("text"))


def _scores(sign, key):
    side = lambda s: f"SELECT l_orderkey AS t, l_linenumber AS row, (l_partkey + {s}) % 4 AS col, l_suppkey % 2 + 1 AS rs, 'w ' || (l_suppkey + {s}) % 9 AS text, count(*) AS n FROM lineitem GROUP BY ALL"
    return f"""WITH f AS (SELECT t, {sign}, sum(n) AS a FROM ({side(0)}) GROUP BY ALL), g AS (SELECT t, {sign}, sum(n) AS b FROM ({side(1)}) GROUP BY ALL),
j AS (SELECT t, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM f FULL JOIN g USING (t, {sign})), s AS (SELECT t, sum(least(a, b)) AS hit, sum(a) AS x, sum(b) AS y FROM j GROUP BY t)
SELECT t, round(hit / x, 6) AS precision, round(hit / y, 6) AS recall, round(CASE WHEN hit > 0 THEN 2 * (hit / x) * (hit / y) / (hit / x + hit / y) ELSE 0.0 END, 6) AS f1 FROM s"""


@query("grits_cells", _scores("text", "t"))
def grits_cells(spark, d):
    out = metrics.cell_scores(_cells(spark, d, 0), _cells(spark, d, 1), ["t"])
    return out.select("t", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("grits_topology", _scores("row, col, rs", "t"))
def grits_topology(spark, d):
    out = metrics.topology_scores(_cells(spark, d, 0), _cells(spark, d, 1), ["t"])
    return out.select("t", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _boxes(spark, d, shift):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(F.floor(k / 8).alias("doc_id"), F.lit(1).alias("page"), k.alias("id"), (k % 4 * 20.0 + shift).alias("x0"), (F.floor(k / 4) % 2 * 30.0).alias("y0"), (k % 4 * 20.0 + 25.0).alias("x1"), (F.floor(k / 4) % 2 * 30.0 + 25.0).alias("y1"))


IOU = """b AS (SELECT o_orderkey // 8 AS doc_id, o_orderkey AS id, (o_orderkey % 4) * 20.0::DOUBLE AS x, (o_orderkey // 4) % 2 * 30.0::DOUBLE AS y FROM orders
), p AS (SELECT f.doc_id, f.id AS f, t.id AS t, least(f.x + 25, t.x + 25) - greatest(f.x, t.x + 3) AS w, least(f.y + 25, t.y + 25) - greatest(f.y, t.y) AS h FROM b f JOIN b t ON f.doc_id = t.doc_id
), i AS (SELECT doc_id, f, t, w * h / (25 * 25 + 22 * 25 - w * h) AS iou FROM p WHERE w > 0 AND h > 0)"""


@query("bbox_iou", f"WITH {IOU} SELECT doc_id, f, t, round(iou, 6) AS iou FROM i")
def bbox_iou(spark, d):
    return metrics.overlaps(_boxes(spark, d, 0.0), _boxes(spark, d, 3.0)).select("doc_id", "f", "t", F.round("iou", 6).alias("iou"))


@query("greedy_match", f"""WITH RECURSIVE {IOU}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY iou DESC, f, t) AS n FROM i WHERE iou >= 0.5
), m AS (SELECT doc_id, 0::BIGINT AS n, []::BIGINT[] AS fs, []::BIGINT[] AS ts, false AS hit, NULL::BIGINT AS f, NULL::BIGINT AS t, NULL::DOUBLE AS iou FROM k WHERE n = 1
  UNION ALL SELECT k.doc_id, k.n, CASE WHEN ok THEN list_append(fs, k.f) ELSE fs END, CASE WHEN ok THEN list_append(ts, k.t) ELSE ts END, ok, k.f, k.t, k.iou
  FROM (SELECT m.*, k.f AS kf, k.t AS kt, NOT list_contains(m.fs, k.f) AND NOT list_contains(m.ts, k.t) AS ok FROM m JOIN k ON k.doc_id = m.doc_id AND k.n = m.n + 1) x JOIN k ON k.doc_id = x.doc_id AND k.n = x.n + 1)
SELECT doc_id, 1 AS page, f, t, round(iou, 6) AS iou FROM m WHERE hit""")
def greedy_match(spark, d):
    return metrics.match(metrics.overlaps(_boxes(spark, d, 0.0), _boxes(spark, d, 3.0))).withColumn("iou", F.round("iou", 6))
