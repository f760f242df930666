"""Metadata, bookmarks, tables of contents, watermarks, optimisation."""

from __future__ import annotations

from math import cos, radians, sin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_metadata(docs: DataFrame, updates: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """Sets, clears or leaves each field. updates has for each field f a column set_f (whether it is
    touched) and f (the new value; null clears)."""
    new = updates.select(key, *[F.col(f"set_{f}").alias(f"_s_{f}") for f in fields], *[F.col(f).alias(f"_n_{f}") for f in fields])
    out = docs.join(new, key, "left")
    return out.withColumns({f: F.when(F.coalesce(F.col(f"_s_{f}"), F.lit(False)), F.col(f"_n_{f}")).otherwise(F.col(f)) for f in fields}).select(*docs.columns)


def parents(items: DataFrame, key: list[str], order: str, level: str = "level") -> DataFrame:
    """items with parent: the order of the last item before with a lower level, or null.

    Levels are any numbers; items without a level have no parent and are none. One pass over the
    items of a key in their order keeps those that can still be parents.
    """

    def fold(places: pd.Series, levels: pd.Series) -> pd.Series:
        out = []
        for at, ls in zip(places, levels):
            held: list[tuple[int, int]] = []
            rows = []
            for o, n in zip(at, ls):
                if n is None or n != n:
                    rows.append(None)
                    continue
                while held and held[-1][1] >= n:
                    held.pop()
                rows.append(int(held[-1][0]) if held else None)
                held.append((o, n))
            out.append(rows)
        return pd.Series(out)

    by_place = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    rest = [c for c in items.columns if c not in key]
    packed = items.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(level).alias("l"), F.struct(*rest).alias("r"))), by_place).alias("_s"))
    found = packed.withColumn("_p", F.pandas_udf(fold, "array<bigint>")("_s.o", "_s.l"))
    each = found.select(*key, F.explode(F.arrays_zip(F.col("_s.r").alias("r"), F.col("_p").alias("p"))).alias("_z"))
    return each.select(*[F.col(c) if c in key else F.col("_z.r")[c].alias(c) for c in items.columns], F.col("_z.p").alias("parent"))


def toc(blocks: DataFrame, key: list[str], order: str, depth: int = 6) -> DataFrame:
    """(key, ord, title, level, page, parent): headings down to depth, with the one they are under."""
    heads = blocks.filter((F.col("type") == "heading") & (F.col("level") <= depth))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1
    items = heads.select(*key, nth.alias("ord"), F.col("text").alias("title"), "level", "page")
    return parents(items, key, "ord")


def set_bookmarks(bookmarks: DataFrame, new: DataFrame, pages: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(bookmarks, rejected): documents named in new lose their old bookmarks; a new one on a page that
    isn't there is rejected. A new row without a title only clears."""
    fine = new.join(pages.select(key, "page"), [key, "page"], "left_semi")
    rejected = new.filter(F.col("title").isNotNull()).join(pages.select(key, "page"), [key, "page"], "left_anti")
    kept = bookmarks.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(fine.select(*bookmarks.columns)), rejected


def watermark_place(width: Column, height: Column, text: Column, size: float = 60.0, angle: float = 45.0, position: str = "center", margin: float = 50.0) -> tuple[Column, Column]:
    """x and y of a watermark; its text counts half the size for each byte of width."""
    wide = F.octet_length(text) * size * 0.5
    if position == "center":
        return width / 2 - wide * cos(radians(angle)) / 2, height / 2 - wide * sin(radians(angle)) / 2
    if position not in ("top_left", "top_right", "bottom_left", "bottom_right"):
        raise ValueError(f"not a position: {position}")
    side, end = position.split("_")
    y = height - margin - size if side == "top" else F.lit(margin)
    return (F.lit(margin) if end == "left" else width - margin - wide), y


def watermark(pages: DataFrame, text: str, on: list[int] | None = None, size: float = 60.0, angle: float = 45.0, opacity: float = 0.3, position: str = "center", over: bool = True) -> DataFrame:
    """pages (width, height) with watermark, a struct of what is drawn, on the pages named (null: all)."""
    x, y = watermark_place(F.col("width"), F.col("height"), F.lit(text), size, angle, position)
    mark = F.struct(F.lit(text).alias("text"), x.alias("x"), y.alias("y"), F.lit(size).alias("font_size"), F.lit(angle).alias("angle"), F.lit(opacity).alias("opacity"), F.lit("over" if over else "under").alias("layer"))
    return pages.withColumn("watermark", mark if on is None else F.when(F.col("page").isin(on), mark))


def add_annotation(annotations: DataFrame, pages: DataFrame, new: DataFrame) -> DataFrame:
    """annotations and those of new whose page is there, numbered after the others of the page."""
    fine = new.join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    last = annotations.groupBy("doc_id", "page").agg(F.max("annot_idx").alias("_last"))
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("type", "x0", "y0"))
    placed = fine.join(last, ["doc_id", "page"], "left").withColumn("annot_idx", (F.coalesce("_last", F.lit(-1)) + n).cast("int")).drop("_last")
    return annotations.unionByName(placed.select(*annotations.columns), allowMissingColumns=True)


def remove_annotations(annotations: DataFrame, types: list[str] | None = None, indices: list[int] | None = None) -> DataFrame:
    """annotations but those of the types and the places named; null names all."""
    hit = F.lit(True)
    if types is not None:
        hit &= F.lower("type").isin([t.lower() for t in types])
    if indices is not None:
        hit &= F.col("annot_idx").isin(indices)
    return annotations.filter(~hit)


def dedupe(items: DataFrame, item_id: str, content: str, also: list[str] | None = None) -> DataFrame:
    """(item_id, canonical): the least id with the same content (and the same `also` columns).

    Found by a hash, 256 bits wide; contents themselves aren't shuffled. Null contents are alike.
    """
    key = F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit(b"\0null")), 256)
    hashed = items.select(F.col(item_id), key.alias("_h"), *(also or []))
    return hashed.withColumn("canonical", F.min(item_id).over(Window.partitionBy("_h", *(also or [])))).select(item_id, "canonical")


def optimize(objects: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """objects (id, content, filter) that roots reach, without repeated streams."""
    from quire.operators.pageset import closure

    used = objects.join(closure(edges, roots), "id", "left_semi")
    first = dedupe(used, "id", "content", ["filter"])
    return used.join(first.filter(F.col("id") == F.col("canonical")).select("id"), "id", "left_semi")


def reduction(before: Column, after: Column) -> Column:
    """Percent saved; 0 where there was nothing."""
    return F.when(before > 0, (1 - after / before) * 100).otherwise(0.0)
