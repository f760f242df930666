"""From blocks to other formats: the logical form as columns, the bytes by one Arrow function."""

from __future__ import annotations

import struct
import zlib
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.kept import Kept
from quire.operators import markdown
from quire.operators.lines import joined
from quire.sources.archive import Limits

#: Font sizes of headings by level; deeper ones have the last.
HEADING_SIZES = (20.0, 16.0, 14.0, 12.0)
LINES_PER_PAGE = 50


# --- logical forms ---------------------------------------------------------


def chapters(blocks: DataFrame, key: str = "doc_id", order: str = "block_idx") -> DataFrame:
    """blocks with chapter: a new one begins at each heading of level 1."""
    w = Window.partitionBy(key).orderBy(order)
    begins = F.coalesce((F.col("type") == "heading") & (F.col("level") == 1), F.lit(False)).cast("int")
    first = F.first(begins).over(w)
    return blocks.withColumn("chapter", (F.sum(begins).over(w) - first).cast("int"))


def slides(blocks: DataFrame, key: str = "doc_id", order: str = "block_idx") -> DataFrame:
    """(key, slide, title, body): every heading begins a slide; other blocks are lines of its body."""
    w = Window.partitionBy(key).orderBy(order)
    head = F.coalesce(F.col("type") == "heading", F.lit(False))
    placed = blocks.withColumn("_h", head.cast("int")).withColumn("slide", (F.sum("_h").over(w) + 1 - F.first("_h").over(w)).cast("int"))
    line = F.when(F.col("type") == "list_item", F.concat(F.lit("• "), F.col("text"))).otherwise(F.col("text"))
    return placed.groupBy(key, "slide").agg(F.max(F.when(F.col("_h") == 1, F.col("text"))).alias("title"), joined(F.when(F.col("_h") == 0, line), [order], "\n").alias("body"))


def sheet_rows(blocks: DataFrame, cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sheet, row, col, text): a sheet for each table; documents without tables have one of their blocks' texts."""
    from_tables = cells.select(key, F.concat(F.lit("Sheet"), (F.dense_rank().over(Window.partitionBy(key).orderBy("page", "table_id"))).cast("string")).alias("sheet"), "row", "col", "text")
    rest = blocks.join(cells.select(key).distinct(), key, "left_anti").filter(F.col("text") != "")
    nth = F.row_number().over(Window.partitionBy(key).orderBy("block_idx")) - 1
    return from_tables.unionByName(rest.select(key, F.lit("Content").alias("sheet"), nth.alias("row"), F.lit(0).alias("col"), "text"))


def print_lines(blocks: DataFrame, key: str = "doc_id", order: str = "block_idx", width: int = 80) -> DataFrame:
    """(key, line, page, text, font_size, bold): blocks wrapped to width bytes, an empty line after each, 50 a page."""
    text = F.when(F.col("type") == "list_item", F.concat(F.repeat(F.lit("  "), F.coalesce("indent_level", F.lit(0))), F.lit("• "), F.col("text"))).otherwise(F.col("text"))
    size = F.lit(HEADING_SIZES[-1])
    for n, s in enumerate(HEADING_SIZES, 1):
        size = F.when(F.col("level") == n, F.lit(s)).otherwise(size)
    head = F.coalesce(F.col("type") == "heading", F.lit(False))
    parts = blocks.select(key, order, F.when(head, size).otherwise(F.lit(12.0)).alias("font_size"), head.alias("bold"), F.posexplode(F.array_append(T.wrap(text, width), F.lit(""))).alias("_i", "text"))
    line = (F.row_number().over(Window.partitionBy(key).orderBy(order, "_i")) - 1).cast("int")
    return parts.withColumn("line", line).select(key, "line", (F.floor(F.col("line") / LINES_PER_PAGE) + 1).cast("int").alias("page"), "text", "font_size", "bold")


def html(blocks: DataFrame, key: str = "doc_id", order: str = "block_idx", title: Column | None = None, table: str | None = None, cells: DataFrame | None = None) -> DataFrame:
    """(key, html): a page of the blocks; lists open and close as the indent of items goes up and down.

    title is a column of blocks, the same in all rows of a document (else Document). Table blocks are
    rendered from cells (key, page, table_id, row, col, text), or table names a column with their markup.
    """
    if cells is not None:
        at = [key, "page", "table_id"]
        blocks, table = blocks.join(markdown.html_tables(cells, at).withColumnRenamed("table", "_table"), at, "left"), "_table"
    w = Window.partitionBy(key).orderBy(order)
    depth = F.when(F.col("type") == "list_item", F.coalesce("indent_level", F.lit(0)) + 1).otherwise(0)
    before = F.coalesce(F.lag(depth).over(w), F.lit(0))
    last = F.lead("type").over(w).isNull()
    pad = lambda n: F.repeat(F.lit("  "), n)
    up = F.array_join(F.transform(F.sequence(F.col("_b") + 1, F.col("_d")), lambda n: F.concat(pad(n), F.lit("<ul>\n"))), "")
    down = F.array_join(F.transform(F.sequence(F.col("_b"), F.col("_d") + 1, F.lit(-1)), lambda n: F.concat(pad(n), F.lit("</ul>\n"))), "")
    end = F.array_join(F.transform(F.sequence(F.col("_d"), F.lit(1), F.lit(-1)), lambda n: F.concat(pad(n), F.lit("</ul>\n"))), "")
    level = F.greatest(F.lit(1), F.least(F.col("level"), F.lit(6))).cast("string")
    said = T.escape_html(F.coalesce("text", F.lit("")))
    body = (
        F.when(F.col("type") == "heading", F.concat(F.lit("  <h"), level, F.lit(">"), said, F.lit("</h"), level, F.lit(">\n")))
        .when(F.col("type") == "list_item", F.concat(pad(F.col("_d") + 1), F.lit("<li>"), said, F.lit("</li>\n")))
        .when(F.col("type") == "table", F.coalesce(F.col(table), F.lit("")) if table else F.lit(""))
        .otherwise(F.concat(F.lit("  <p>"), said, F.lit("</p>\n")))
    )
    moves = F.when(F.col("_d") > F.col("_b"), up).when(F.col("_d") < F.col("_b"), down).otherwise("")
    closing = F.when(F.col("_last") & (F.col("_d") > 0), end).otherwise("")
    named = blocks.withColumns({"_d": depth, "_b": before, "_last": last, "_t": F.lit("Document") if title is None else F.coalesce(title, F.lit("Document"))})
    out = named.withColumn("_p", F.concat(moves, body, closing)).groupBy(key).agg(F.first("_t").alias("_t"), joined(F.col("_p"), [order], "").alias("_p"))
    head = F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n  <meta charset="utf-8">\n  <title>')
    return out.select(key, F.concat(head, T.escape_html(F.col("_t")), F.lit("</title>\n</head>\n<body>\n"), F.col("_p"), F.lit("</body>\n</html>\n")).alias("html"))


# --- bytes -----------------------------------------------------------------


def _packed(text: str, stored: bool) -> tuple[bytes, bytes]:
    """(what an archive's two heads say of an entry, its bytes as they lie there)."""
    raw = text.encode()
    body = raw
    if not stored:
        z = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
        body = z.compress(raw) + z.flush()
        if len(raw) > Limits.ratio * len(body):  # readers refuse what packs so well
            body, stored = raw, True
    return struct.pack("<HHHLLL", 0 if stored else 8, 0, 33, zlib.crc32(raw), len(body), len(raw)), body


#: Parts that are the same in most files are packed once.
_same = Kept(lambda part: _packed(*part), 256)


def _zip(entries: list[tuple[str, str]], stored: int = 0) -> bytes:
    """An archive, as zipfile writes it; its first `stored` entries aren't compressed, nor those that would break
    the limit of readers on the ratio. Dates are fixed, so bytes repeat."""
    out, listed = bytearray(), []
    for i, (name, text) in enumerate(entries):
        said, body = _same[text, i < stored] if len(text) <= SAME and name in _STEADY else _packed(text, i < stored)
        raw = name.encode()
        flags = 0 if raw.isascii() else 0x800
        listed.append(struct.pack("<4sHHH", b"PK\1\2", 0x314, 20, flags) + said + struct.pack("<5H2L", len(raw), 0, 0, 0, 0, 0o600 << 16, len(out)) + raw)
        out += struct.pack("<4sHH", b"PK\3\4", 20, flags) + said + struct.pack("<HH", len(raw), 0) + raw + body
        if len(body) >= 1 << 31 or len(out) >= 1 << 31 or i >= 1 << 16:
            raise ValueError("an archive of over 2 GB or 65,536 entries")
    at = len(out)
    for x in listed:
        out += x
    return bytes(out + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(listed), len(listed), len(out) - at, at, 0))


_STEADY = {"[Content_Types].xml", "_rels/.rels", "word/_rels/document.xml.rels", "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "ppt/presentation.xml", "ppt/_rels/presentation.xml.rels", "mimetype", "META-INF/container.xml"}
SAME = 8192


_X = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"


_UNSEEN = {c: None for c in range(32) if chr(c) not in "\t\n\r"}


def _clean(s: str | None) -> str:
    return s if s and s.isprintable() else (s or "").translate(_UNSEEN)


def _package(main: str, kind: str, parts: list[tuple[str, str, str]], rels: list[tuple[str, str, str]], folder: str, meta: dict[str, str], more: list[tuple[str, str]] = []) -> bytes:
    types = "".join(f'<Override PartName="/{n}" ContentType="{t}"/>' for n, t, _ in parts)
    core = "".join(f"<{t}>{escape(_clean(meta[f]))}</{t}>" for f, t in (("title", "dc:title"), ("author", "dc:creator"), ("subject", "dc:subject")) if meta.get(f))
    entries = [
        ("[Content_Types].xml", f'{_X}<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>'),
        ("_rels/.rels", f'{_X}<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="{main}"/></Relationships>'),
        ("docProps/core.xml", f'{_X}<cp:coreProperties xmlns:cp="{_PKG}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">{core}</cp:coreProperties>'),
        *[(n, _X + x) for n, _, x in parts],
    ]
    if rels:
        body = "".join(f'<Relationship Id="{i}" Type="{_REL}/{t}" Target="{x}"/>' for i, t, x in rels)
        entries.append((f"{folder}/_rels/{main.rpartition('/')[2]}.rels", f'{_X}<Relationships xmlns="{_PKG}/relationships">{body}</Relationships>'))
    return _zip([*entries, *more])


def docx_bytes(blocks: list[dict], meta: dict[str, str]) -> bytes:
    def p(text: str, style: str = "") -> str:
        s = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        runs = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(_clean(x))}</w:t>' for x in (text or "").split("\n"))
        return f"<w:p>{s}<w:r>{runs}</w:r></w:p>"

    out = []
    for b in blocks:
        if b["type"] == "heading":
            out.append(p(b["text"], f"Heading{b['level']}"))
        elif b["type"] == "list_item":
            out.append(p(f"• {b['text']}"))
        elif b.get("rows"):
            out.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in b["rows"]) + "</w:tbl>")
        elif b["type"] != "table":
            out.append(p(b["text"]))
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{ns}"><w:body>{"".join(out)}</w:body></w:document>'
    return _package("word/document.xml", "docx", [("word/document.xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml", xml)], [], "word", meta)


def xlsx_bytes(sheets: list[tuple[str, list[list[str]]]], meta: dict[str, str]) -> bytes:
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"

    def ref(c: int) -> str:
        s = ""
        c += 1
        while c:
            c, r = divmod(c - 1, 26)
            s = chr(65 + r) + s
        return s

    kind, parts, names = "application/vnd.openxmlformats-officedocument.spreadsheetml", [], []
    for i, (name, rows) in enumerate(sheets, 1):
        body = "".join(f'<row r="{r}">' + "".join(f'<c r="{ref(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(_clean(x))}</t></is></c>' for c, x in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
        parts.append((f"xl/worksheets/sheet{i}.xml", f"{kind}.worksheet+xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>'))
        names.append(f'<sheet name={quoteattr(_clean(name)[:31] or f"Sheet{i}")} sheetId="{i}" r:id="rId{i}"/>')
    book = f'<workbook xmlns="{ns}" xmlns:r="{_REL}"><sheets>{"".join(names)}</sheets></workbook>'
    return _package("xl/workbook.xml", "xlsx", [("xl/workbook.xml", f"{kind}.sheet.main+xml", book), *parts], [(f"rId{i}", "worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(sheets) + 1)], "xl", meta)


def pptx_bytes(slides_: list[tuple[str | None, list[str]]], meta: dict[str, str], more: list[tuple[str, str]] = []) -> bytes:
    """more: entries (name, text) that come after the others, such as notes."""
    p, a = "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main"

    def shape(i: int, kind: str, lines: list[str]) -> str:
        body = "".join(f"<a:p><a:r><a:t>{escape(_clean(x))}</a:t></a:r></a:p>" for x in lines)
        return f'<p:sp><p:nvSpPr><p:cNvPr id="{i}" name="{kind}"/><p:cNvSpPr/><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/>{body}</p:txBody></p:sp>'

    kind, parts, ids = "application/vnd.openxmlformats-officedocument.presentationml", [], []
    for i, (title, lines) in enumerate(slides_ or [(None, [])], 1):
        tree = (shape(2, "title", [title]) if title else "") + (shape(3, "body", lines) if lines else "")
        parts.append((f"ppt/slides/slide{i}.xml", f"{kind}.slide+xml", f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>'))
        ids.append(f'<p:sldId id="{255 + i}" r:id="rId{i}"/>')
    main = f'<p:presentation xmlns:p="{p}" xmlns:r="{_REL}"><p:sldIdLst>{"".join(ids)}</p:sldIdLst></p:presentation>'
    return _package("ppt/presentation.xml", "pptx", [("ppt/presentation.xml", f"{kind}.presentation.main+xml", main), *parts], [(f"rId{i}", "slide", f"slides/slide{i}.xml") for i in range(1, len(parts) + 1)], "ppt", meta, more)


def epub_bytes(chapters_: list[tuple[str, str]], meta: dict[str, str]) -> bytes:
    """chapters_: (title, body markup)."""
    page = lambda t, b: f'{_X}<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(t)}</title></head><body>\n{b}</body></html>'
    n = range(1, len(chapters_) + 1)
    items = "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in n) + '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
    spine = "".join(f'<itemref idref="c{i}"/>' for i in n)
    tags = "".join(f"<dc:{t}>{escape(_clean(meta[f]))}</dc:{t}>" for f, t in (("title", "title"), ("author", "creator"), ("subject", "subject")) if meta.get(f))
    points = "".join(f'<navPoint id="p{i}" playOrder="{i}"><navLabel><text>{escape(_clean(t))}</text></navLabel><content src="c{i}.xhtml"/></navPoint>' for i, (t, _) in zip(n, chapters_))
    return _zip(
        [
            ("mimetype", "application/epub+zip"),
            ("META-INF/container.xml", f'{_X}<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'),
            ("OEBPS/content.opf", f'{_X}<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{tags}</metadata><manifest>{items}</manifest><spine toc="ncx">{spine}</spine></package>'),
            ("OEBPS/toc.ncx", f'{_X}<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><navMap>{points}</navMap></ncx>'),
            *[(f"OEBPS/c{i}.xhtml", page(_clean(t), b)) for i, (t, b) in zip(n, chapters_)],
        ],
        stored=1,
    )


def _markup(b: dict) -> str:
    t = escape(_clean(b["text"]))
    if b["type"] == "heading":
        return f"<h{b['level']}>{t}</h{b['level']}>\n"
    if b["type"] == "list_item":
        return f"<ul><li>{t}</li></ul>\n"
    if b.get("rows"):
        return "<table>" + "".join("<tr>" + "".join(f"<td>{escape(_clean(c))}</td>" for c in r) + "</tr>" for r in b["rows"]) + "</table>\n"
    return f"<p>{t}</p>\n"


def generate(blocks: list[dict], target: str, meta: dict[str, str] | None = None) -> bytes:
    """A file of the target format from blocks (type, text, level, indent_level, rows)."""
    from quire.sources import pdf

    meta = meta or {}
    if target == "docx":
        return docx_bytes(blocks, meta)
    if target == "xlsx":
        found = [(f"Sheet{i}", b["rows"]) for i, b in enumerate((b for b in blocks if b.get("rows")), 1)]
        return xlsx_bytes(found or [("Content", [[b["text"]] for b in blocks])], meta)
    if target == "pptx":
        out: list[tuple[str | None, list[str]]] = []
        for b in blocks:
            if b["type"] == "heading":
                out.append((b["text"], []))
                continue
            if not out:
                out.append((None, []))
            out[-1][1].extend([" | ".join(r) for r in b["rows"]] if b.get("rows") else [("• " if b["type"] == "list_item" else "") + b["text"]])
        return pptx_bytes(out, meta)
    if target == "epub":
        parts: list[tuple[str, str]] = []
        for b in blocks:
            if not parts or (b["type"] == "heading" and b["level"] == 1):
                parts.append((b["text"] if b["type"] == "heading" else meta.get("title") or "Chapter", ""))
            parts[-1] = (parts[-1][0], parts[-1][1] + _markup(b))
        return epub_bytes(parts, meta)
    if target == "html":
        title = escape(_clean(meta.get("title") or "Document"))
        return f'<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>{title}</title>\n</head>\n<body>\n{"".join(map(_markup, blocks))}</body>\n</html>\n'.encode()
    if target == "markdown":
        return markdown.text(blocks, "markdown").encode()
    if target == "pdf":
        lines: list[tuple[str, float, bool]] = []
        for b in blocks:
            head = b["type"] == "heading"
            size = HEADING_SIZES[int(min(b.get("level") or 1, 4)) - 1] if head else 12.0
            said = ["  |  ".join(r) for r in b["rows"]] if b.get("rows") else [("• " if b["type"] == "list_item" else "") + (b["text"] or "")]
            lines += [(x, size, head) for s in said for x in wrap_words(s, 80)] + [("", size, False)]
        return pdf.write(pdf.paginate(lines, LINES_PER_PAGE), meta)
    raise ValueError(f"can't write {target}")


def wrap_words(text: str, width: int) -> list[str]:
    out, now = [], ""
    for w in text.split():
        if now and len(now.encode()) + 1 + len(w.encode()) > width:
            out.append(now)
            now = w
        else:
            now = f"{now} {w}" if now else w
    return [*out, now]


def convert(parsed: DataFrame, target: str) -> DataFrame:
    """(doc_id, content, blocks, tables, error) of parsed documents (reader.parse_column) in another format."""
    text = F.struct("doc.blocks", "doc.cells", "doc.metadata")

    def run(docs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for bs, cs, meta in zip(docs["blocks"], docs["cells"], docs["metadata"]):
            try:
                rows.append((generate(nested(list(bs), list(cs)), target, dict(meta) if meta is not None else {}), None))
            except ValueError as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["content", "error"])

    udf = F.pandas_udf(run, "content binary, error string")
    out = parsed.select("doc_id", "doc", udf(text).alias("o"))
    count = F.size(F.filter("doc.blocks", lambda b: b["type"] == "table"))
    return out.select("doc_id", "o.content", F.size("doc.blocks").alias("blocks"), count.alias("tables"), F.coalesce("o.error", "doc.error.message").alias("error"))


def _whole(x) -> int | None:
    """Arrow gives whole numbers beside nulls as floats."""
    return None if x is None or x != x else int(x)


def nested(blocks: list, cells: list) -> list[dict]:
    """Blocks as dicts, table blocks with rows of texts."""
    rows: dict[int, dict[int, dict[int, str]]] = {}
    for c in cells:
        rows.setdefault(_whole(c["table_id"]), {}).setdefault(c["row"], {})[c["col"]] = c["text"] or ""
    out = []
    for b in blocks:
        d = {"page": _whole(b["page"]), "type": b["type"], "text": b["text"] or "", "level": _whole(b["level"]), "indent_level": _whole(b["indent_level"])}
        if b["type"] == "table" and _whole(b["table_id"]) in rows:
            t = rows[_whole(b["table_id"])]
            d["rows"] = [[r[c] for c in sorted(r)] for _, r in sorted(t.items())]
        out.append(d)
    return out


def convert_blocks(blocks: DataFrame, target: str, key: str = "doc_id", cells: DataFrame | None = None) -> DataFrame:
    """(key, content) from blocks as rows (page, block_idx, type, text, level, indent_level), and cells where
    blocks have a table_id."""
    if "table_id" not in blocks.columns:
        blocks = blocks.withColumn("table_id", F.lit(None).cast("int"))
    packed = blocks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("page", "block_idx", "type", "text", "level", "indent_level", "table_id"))).alias("b"))
    if cells is None:
        packed = packed.withColumn("c", F.expr("array() :: array<struct<table_id int, row int, col int, text string>>"))
    else:
        packed = packed.join(cells.groupBy(key).agg(F.collect_list(F.struct("table_id", "row", "col", "text")).alias("c")), key, "left")

    def run(all_: pd.Series, cells: pd.Series) -> pd.Series:
        return pd.Series([generate(nested(list(bs), [] if cs is None else list(cs)), target) for bs, cs in zip(all_, cells)])

    return packed.select(key, F.pandas_udf(run, "binary")("b", "c").alias("content"))
