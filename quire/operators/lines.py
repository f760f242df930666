"""From spans to lines to page texts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType

PAGE = ["doc_id", "page"]
#: Pages that are Python objects at a time; the rest of a batch stays as Arrow has it.
PAGES_AT_ONCE = 128


def sliced(fold: Callable[..., list[dict]], type_: pa.DataType, *columns: pa.Array) -> pa.Array:
    """fold of each row of the columns, as an array of type_; few rows at a time become Python objects."""
    out = [
        pa.array([fold(*row) for row in zip(*(c.slice(at, PAGES_AT_ONCE).to_pylist() for c in columns))], type=type_)
        for at in range(0, len(columns[0]), PAGES_AT_ONCE)
    ]
    return pa.concat_arrays(out) if out else pa.array([], type=type_)


def joined(value: Column, order: list[str], sep: str) -> Column:
    """An aggregate: the values in the order of the columns, with sep between them.

    Sorted inside the group, so no global order is needed; null values are left out.
    """
    pairs = F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in order], value.alias("_v"))))
    return F.array_join(F.transform(pairs, lambda p: p["_v"]), sep)


def line_texts(spans: DataFrame, key: list[str]) -> DataFrame:
    """One row a line: its text, with a blank where the gap between spans is wide.

    Wide is over a quarter of the font size of the span before (2 points if that has none). Spans
    are in the order of span_idx. The text of a null span is empty.
    """
    return spans.withColumn("_piece", _piece(key)).groupBy(*key).agg(joined(F.col("_piece"), ["span_idx"], "").alias("text"))


def _piece(key: list[str]) -> Column:
    w = Window.partitionBy(*key).orderBy("span_idx")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    size = F.lag("font_size").over(w)
    wide = gap > F.when(size > 0, size * 0.25).otherwise(2.0)
    return F.concat(F.when(wide, " ").otherwise(""), F.coalesce("text", F.lit("")))


def page_texts(lines: DataFrame, key: list[str] = PAGE, order: str = "line_idx", text: str = "text", sep: str = "\n") -> DataFrame:
    """One row a page: the lines in order, joined by sep."""
    return lines.groupBy(*key).agg(joined(F.col(text), [order], sep).alias("text"))


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The non-blank lines of plain text with the geometry that flowing text has: 14 points down
    a line, 7 points wide a byte, font size 12."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_idx", "text"))
    return lines.filter(F.trim("text") != "").select(
        key,
        "line_idx",
        "text",
        (F.row_number().over(Window.partitionBy(key).orderBy("line_idx")) * 14 - 14).cast("double").alias("y"),
        (F.octet_length("text") * 7).cast("double").alias("width"),
    )


def fold_lines(spans: list[dict]) -> list[dict]:
    """Spans of one page into lines, top first.

    Spans are taken from the top down, left to right; each joins the first line whose leftmost span
    is less than half a font size away in y (12 points stand in for a size of 0), else begins a new one.
    """
    lines: list[list[dict]] = []
    for s in sorted(spans, key=lambda s: (-s["y"], s["x"])):
        near = (s["font_size"] or 12.0) * 0.5
        home = next((line for line in lines if abs(line[0]["y"] - s["y"]) < near), None)
        if home is None:
            lines.append([s])
        else:
            at = next((i for i, t in enumerate(home) if t["x"] > s["x"]), len(home))
            home.insert(at, s)
    boxes = []
    for line in lines:
        box = (min(s["x"] for s in line), min(s["y"] for s in line), max(s["x"] + s["width"] for s in line), max(s["y"] + s["font_size"] for s in line))
        boxes.append({"spans": line, "box": box})
    return sorted(boxes, key=lambda b: -b["box"][1])


def group_spans(spans: DataFrame, key: list[str] = PAGE) -> DataFrame:
    """(key, line_idx, span_idx, text, x, y, width, font_size, font_name): spans with their line.

    Which line a span joins depends on those before it, so each page is folded in one go. Spans of
    the same place are taken in the order of their texts.
    """
    cols = ["text", "x", "y", "width", "font_size", "font_name"]
    types = {f.name: f.dataType.simpleString() for f in spans.schema.fields}

    schema = ArrayType(StructType.fromDDL("line_idx int, span_idx int, " + ", ".join(f"{c} {types[c]}" for c in cols)))
    arrow = to_arrow_type(schema)

    def fold(page: list[dict]) -> list[dict]:
        lines = fold_lines(sorted(page, key=lambda s: (s["text"] or "", s["font_name"] or "")))
        return [{"line_idx": i, "span_idx": j} | {c: s[c] for c in cols} for i, line in enumerate(lines) for j, s in enumerate(line["spans"])]

    udf = F.arrow_udf(lambda pages: sliced(fold, arrow, pages), schema).asNondeterministic()
    pages = spans.groupBy(*key).agg(F.collect_list(F.struct(*cols)).alias("_s"))
    return pages.select(*key, F.explode(udf("_s")).alias("_l")).select(*key, "_l.*")


def lines_of(spans: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row a line: text, box, and of its longest span (the last of equals) size and font; first_x.

    All in one aggregation. Spans are brought together by page, which is enough for the lines and
    for what is done by page afterwards: there is no other shuffle.
    """
    key = key or [*PAGE, "line_idx"]
    by_page = spans.repartition(*[c for c in PAGE if c in key]) if set(PAGE) <= set(key) else spans
    longest = F.struct(F.octet_length("text"), F.col("span_idx"))
    return by_page.withColumn("_piece", _piece(key)).groupBy(*key).agg(
        joined(F.col("_piece"), ["span_idx"], "").alias("text"),
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("font_size")).alias("y1"),
        F.max_by("font_size", longest).alias("size"), F.max_by("font_name", longest).alias("font"), F.min_by("x", "span_idx").alias("first_x"),
    )
