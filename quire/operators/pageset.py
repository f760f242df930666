"""Algebra on sets of pages: merge, split, reorder, delete, insert, rotate, stamp.

Pages are rows (doc_id, page, ...); every operation renumbers from 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire import storage


def _renumbered(pages: DataFrame, key: list[str], order: list) -> DataFrame:
    return pages.withColumn("page", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def merge(pages: DataFrame, into: str, order: list[str]) -> DataFrame:
    """All pages of one value of `into` become one document; order ends with the old page."""
    return _renumbered(pages, [into], [F.col(c) for c in order])


def merge_documents(*docs: DataFrame) -> DataFrame:
    """Pages of several single documents, one after the other. No document is an error."""
    if not docs:
        raise ValueError("merge needs a document")
    parts = [d.withColumn("_d", F.lit(i)) for i, d in enumerate(docs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return merge(out.withColumn("doc_id", F.lit(0)), "doc_id", ["_d", "page"]).drop("_d")


def merge_fields(fields: DataFrame, nth: str) -> DataFrame:
    """Names of form fields of merged documents: those of the second and later get docN_ before them."""
    return fields.withColumn("name", F.when(F.col(nth) > 1, F.concat(F.lit("doc"), F.col(nth).cast("string"), F.lit("_"), F.col("name"))).otherwise(F.col("name")))


def split(pages: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """pages with part: one new document for each range, ends counted. Pages that aren't there are
    skipped; ranges may overlap."""
    parts = pages.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ranges)], "part int, a int, b int")
    hit = pages.join(F.broadcast(parts), F.col("page").between(F.col("a"), F.col("b"))).drop("a", "b")  # as many rows as ranges are given
    return _renumbered(hit, ["doc_id", "part"], [F.col("page")])


def reorder(pages: DataFrame, order: list[int]) -> DataFrame:
    """The named pages of each document in this order; a page may come again, or not at all."""
    wanted = pages.sparkSession.createDataFrame(list(enumerate(order)), "_pos int, page int")
    return _renumbered(pages.join(F.broadcast(wanted), "page"), ["doc_id"], [F.col("_pos")]).drop("_pos").select(*pages.columns)


def missing(pages: DataFrame, order: list[int]) -> DataFrame:
    """(doc_id, page): what reorder() or rotate() names and a document doesn't have."""
    wanted = pages.sparkSession.createDataFrame([(p,) for p in sorted(set(order))], "page int")
    return pages.select("doc_id").distinct().crossJoin(F.broadcast(wanted)).join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_anti")


def delete(pages: DataFrame, gone: list[int]) -> DataFrame:
    """The other pages. Of a document that would lose all, all stay, with error set."""
    hit = F.col("page").isin(gone)
    left = F.sum((~hit).cast("int")).over(Window.partitionBy("doc_id"))
    kept = pages.withColumn("_left", left).filter(~hit | (F.col("_left") == 0))
    kept = kept.withColumn("error", F.when(F.col("_left") == 0, "at least one page must remain"))
    return _renumbered(kept, ["doc_id"], [F.col("page")]).drop("_left")


def insert_blank(pages: DataFrame, blanks: list[tuple[int, float, float]]) -> DataFrame:
    """Blank pages (after, width, height); after 0 is the front. Of several at one place the later
    named comes first."""
    new = pages.sparkSession.createDataFrame([(a, float(w), float(h), -i) for i, (a, w, h) in enumerate(blanks)], "_after int, width double, height double, _n int")
    old = pages.withColumns({"_after": F.col("page"), "_n": F.lit(-(1 << 30)), "blank": F.lit(False)})
    docs = pages.groupBy("doc_id").agg(F.max("page").alias("_last"))
    added = docs.crossJoin(F.broadcast(new)).filter(F.col("_after") <= F.col("_last")).drop("_last").withColumn("blank", F.lit(True))
    return _renumbered(old.unionByName(added, allowMissingColumns=True), ["doc_id"], [F.col("_after"), F.col("_n")]).drop("_after", "_n")


def rotate(pages: DataFrame, turns: list[tuple[int, int]]) -> DataFrame:
    """Sets the rotation of pages to 0, 90, 180 or 270."""
    if bad := [r for _, r in turns if r not in (0, 90, 180, 270)]:
        raise ValueError(f"not a rotation: {bad[0]}")
    new = pages.sparkSession.createDataFrame(list(turns), "page int, _turn int")
    return pages.join(F.broadcast(new), "page", "left").withColumn("rotation", F.coalesce("_turn", "rotation")).select(*pages.columns)


#: Things drawn on an overlay page, at most.
MOST_DRAWN = 10_000


def stamp(pages: DataFrame, overlay: DataFrame, on: list[int] | None = None, x: float = 0.0, y: float = 0.0, scale: float = 1.0, opacity: float = 1.0, over: bool = True) -> DataFrame:
    """The things drawn on pages (doc_id, page, z, ...) and those of an overlay page on each target.

    The overlay's x, y, width and height are scaled, then moved; it is above all else, or below.
    """
    targets = pages.select("doc_id", "page").distinct()
    if on is not None:
        targets = targets.filter(F.col("page").isin(on))
    top = pages.groupBy("doc_id", "page").agg(F.max("z").alias("_top"), F.min("z").alias("_low"))
    placed = overlay.withColumns({"x": F.col("x") * scale + x, "y": F.col("y") * scale + y, "width": F.col("width") * scale, "height": F.col("height") * scale, "opacity": F.lit(float(opacity))})
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("z"))
    drawn = [c for c in placed.columns if c not in ("doc_id", "page")]
    whole = placed.limit(MOST_DRAWN + 1).agg(F.collect_list(F.struct(*drawn)).alias("_o")).first()["_o"]
    if len(whole) > MOST_DRAWN:
        raise ValueError(f"an overlay has {MOST_DRAWN} things drawn at most")
    one = overlay.sparkSession.createDataFrame([(whole,)], placed.agg(F.collect_list(F.struct(*drawn)).alias("_o")).schema)
    added = targets.join(top, ["doc_id", "page"]).join(F.broadcast(one)).select("*", F.inline("_o")).drop("_o")  # one row, bounded
    added = added.withColumn("z", F.col("_top") + n if over else F.col("_low") - 1 - n).drop("_top", "_low")
    return pages.unionByName(added, allowMissingColumns=True)


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id): all that roots (id) lead to along edges (src, dst), themselves included.

    Rounds of a join on the frontier, each cut in the shared folder.
    """
    seen = front = storage.cut(roots.select("id").distinct())
    while True:
        front = storage.cut(front.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
