"""Markdown of blocks and tables."""

from __future__ import annotations

import re
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.lines import joined

_MARKER = re.compile(T.MARKER)


def render(
    blocks: DataFrame,
    key: str = "doc_id",
    order: list[str] | None = None,
    page: str = "page",
    separator: str = "---",
    page_numbers: str | None = None,
    heading_offset: int = 0,
    strip_markers: bool = True,
    table: str | None = None,
    cells: DataFrame | None = None,
    html: bool = False,
    header: bool = True,
) -> DataFrame:
    """(key, markdown): the blocks of each document in order.

    Headings have their level plus heading_offset, from 1 to 6. Items that follow each other are
    one list, two blanks deeper a level of indent. Where a block is on another page than the one
    before, separator stands between them, and page_numbers ({n} in it) after that; pages without
    blocks leave no trace. Table blocks are rendered from cells (key, page, table_id, row, col, text),
    as pipe tables, with header or an empty head, or as HTML; or table names a column with their
    rendered text. A document without blocks isn't in the result.
    """
    if cells is not None:
        at = [key, page, "table_id"]
        drawn = (html_tables(cells, at) if html else pipe_tables(cells, at, header)).withColumnRenamed("table", "_table")
        blocks, table = blocks.join(drawn, at, "left"), "_table"
    order = order or [page, "block_idx"]
    w = Window.partitionBy(key).orderBy(*order)
    text = F.trim(F.coalesce("text", F.lit("")))
    level = F.greatest(F.lit(1), F.least(F.col("level") + heading_offset, F.lit(6)))
    item = T.strip_marker(F.coalesce("text", F.lit(""))) if strip_markers else text
    body = (
        F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
        .when(F.col("type") == "list_item", F.concat(F.repeat(F.lit("  "), F.coalesce("indent_level", F.lit(0))), F.lit("- "), item))
        .when(F.col("type") == "table", F.regexp_replace(F.coalesce(F.col(table), F.lit("")) if table else F.lit(""), r"\s+$", ""))
        .otherwise(text)
    )
    turned = F.coalesce(F.lag(page).over(w) != F.col(page), F.lit(False))
    first = F.lag(page).over(w).isNull()
    head = F.when(turned & F.lit(bool(separator)), F.lit(f"{separator}\n\n")).otherwise("")
    if page_numbers:
        head = F.concat(head, F.when(turned | first, F.concat(F.replace(F.lit(page_numbers), F.lit("{n}"), F.col(page).cast("string")), F.lit("\n\n"))).otherwise(""))
    tight = (F.col("type") == "list_item") & (F.lag("type").over(w) == "list_item") & ~turned
    before = F.when(first, "").when(F.coalesce(tight, F.lit(False)), "\n").otherwise("\n\n")
    pieces = blocks.withColumn("_piece", F.concat(before, head, body))
    out = pieces.groupBy(key).agg(joined(F.col("_piece"), order, "").alias("markdown"))
    return out.withColumn("markdown", F.concat(F.regexp_replace("markdown", r"\s+$", ""), F.lit("\n")))


def pipe_rows(rows: list[list[str]], header: bool = True) -> str:
    """One table as pipe_tables() renders it."""
    cells = [[(c or "").strip(" ").replace("|", "\\|").replace("\n", " ") for c in r] for r in rows]
    wide = [max(3, *(len(r[j].encode()) for r in cells if j < len(r))) for j in range(max(map(len, cells)))]
    line = lambda r: "|" + "".join(f" {c}{' ' * (w - len(c.encode()))} |" for c, w in zip(r, wide))
    rule = lambda r: "|" + "".join(f" {'-' * w} |" for _, w in zip(r, wide))
    lines = [*map(line, cells)]
    lines[:1] = [lines[0], rule(cells[0])] if header else ["|" + "".join(f" {' ' * w} |" for w in wide), rule(cells[0]), lines[0]]
    return "\n".join(lines)


def html_rows(rows: list[list[str]]) -> str:
    """One table as html_tables() renders it, without spans."""
    tag = lambda i: "th" if i == 0 else "td"
    cell = lambda i, c: f"    <{tag(i)}>{escape(c or '')}</{tag(i)}>\n"
    return "<table>\n" + "".join("  <tr>\n" + "".join(cell(i, c) for c in r) + "  </tr>\n" for i, r in enumerate(rows)) + "</table>"


def text(
    blocks: list[dict],
    format: str = "pdf",
    notes: dict[int, str] | None = None,
    separator: str = "---",
    page_numbers: str | None = None,
    heading_offset: int = 0,
    strip_markers: bool | None = None,
    html: bool = False,
    header: bool = True,
) -> str:
    """The blocks (page, type, text, level, indent_level, rows) of one document, as render() has those of many.

    Formats have customs of their own: a deck's slides begin with "## Slide n" and their title and end
    with their notes; items of DOCX files aren't indented; list markers are stripped in PDFs only, by default.
    """
    strip_markers = format == "pdf" if strip_markers is None else strip_markers
    out: list[str] = []
    before, item, deck, notes = None, False, format == "pptx", notes or {}

    def close() -> None:
        if deck and before in notes:
            out.append(f"\n\n> **Notes:** {notes[before]}")

    for b in blocks:
        page, kind, said = b.get("page", 1), b["type"], (b["text"] or "").strip(" ")
        turned = before is not None and page != before
        head = []
        if turned:
            close()
        if turned and separator:
            head.append(separator)
        if page_numbers and page != before:
            head.append(page_numbers.replace("{n}", str(page)))
        if deck and page != before:
            level = max(1, min(2 + heading_offset, 6))
            head.append(f"{'#' * level} Slide {page}" + (f": {said}" if kind == "heading" else ""))
        if deck and page != before and kind == "heading":
            body = None
        elif kind == "heading":
            body = "#" * max(1, min((b["level"] or 1) + heading_offset, 6)) + " " + said
        elif kind == "list_item":
            body = "  " * (0 if format == "docx" else b["indent_level"] or 0) + "- " + (_MARKER.sub("", b["text"] or "").lstrip(" ") if strip_markers else said)
        elif kind == "table":
            body = (html_rows(b["rows"]) if html else pipe_rows(b["rows"], header)) if b.get("rows") else ""
        else:
            body = said
        tight = item and kind == "list_item" and not turned
        out.append(("" if before is None else "\n" if tight else "\n\n") + "\n\n".join([*head, *([] if body is None else [body])]))
        before, item = page, kind == "list_item"
    close()
    whole = "".join(out).rstrip()
    return f"{whole}\n" if whole else ""


def pipe_tables(cells: DataFrame, key: list[str], header: bool = True) -> DataFrame:
    """(key, table): cells (key, row, col, text) as pipe tables.

    Every column is as wide in bytes as its widest cell, 3 at least. Without header, the head is empty.
    """
    escaped = cells.withColumn("text", T.escape_pipe(F.coalesce("text", F.lit(""))))
    wide = escaped.withColumn("w", F.greatest(F.lit(3), F.max(F.octet_length("text")).over(Window.partitionBy(*key, "col"))))
    cell = F.concat(F.lit(" "), T.padded(F.col("text"), F.col("w")), F.lit(" |"))
    rule = F.concat(F.lit(" "), F.repeat(F.lit("-"), F.col("w")), F.lit(" |"))
    blank = F.concat(F.lit(" "), F.repeat(F.lit(" "), F.col("w")), F.lit(" |"))
    rows = wide.groupBy(*key, "row").agg(
        F.concat(F.lit("|"), joined(cell, ["col"], "")).alias("line"), F.concat(F.lit("|"), joined(rule, ["col"], "")).alias("rule"), F.concat(F.lit("|"), joined(blank, ["col"], "")).alias("blank")
    )
    first = F.row_number().over(Window.partitionBy(*key).orderBy("row")) == 1
    line = F.when(F.col("first"), F.concat_ws("\n", "line", "rule") if header else F.concat_ws("\n", "blank", "rule", "line")).otherwise(F.col("line"))
    return rows.withColumn("first", first).withColumn("line", line).groupBy(*key).agg(F.concat(joined(F.col("line"), ["row"], "\n"), F.lit("\n")).alias("table"))


def html_tables(cells: DataFrame, key: list[str]) -> DataFrame:
    """(key, table): cells as HTML; the first row is the head; spans over 1 become attributes."""

    def span(name: str, column: str) -> Column:
        return F.when(F.col(column) > 1, F.concat(F.lit(f' {name}="'), F.col(column).cast("string"), F.lit('"'))).otherwise("") if column in cells.columns else F.lit("")

    first = F.dense_rank().over(Window.partitionBy(*key).orderBy("row")) == 1
    tagged = cells.withColumn("tag", F.when(first, "th").otherwise("td"))
    cell = F.concat(F.lit("    <"), F.col("tag"), span("colspan", "col_span"), span("rowspan", "row_span"), F.lit(">"), T.escape_html(F.coalesce("text", F.lit(""))), F.lit("</"), F.col("tag"), F.lit(">\n"))
    rows = tagged.groupBy(*key, "row").agg(F.concat(F.lit("  <tr>\n"), joined(cell, ["col"], ""), F.lit("  </tr>\n")).alias("line"))
    return rows.groupBy(*key).agg(F.concat(F.lit("<table>\n"), joined(F.col("line"), ["row"], ""), F.lit("</table>\n")).alias("table"))
