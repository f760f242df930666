"""Tables from rule lines (lattice) and from the alignment of words (stream)."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType

from quire.functions import geometry
from quire.operators.lines import PAGE, joined, sliced

SNAP, MIN_ROWS, MIN_COLS, MIN_GAP = 3.0, 2, 2, 10.0
NEAR_BOUNDARY, SLACK = 20.0, 10.0


# --- lattice ---------------------------------------------------------------


def rectangle_segments(rects: DataFrame) -> DataFrame:
    """(page, ax, ay, bx, by): the four sides of each rectangle (x, y, w, h)."""
    x, y, r, t = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    sides = [(x, y, r, y), (r, y, r, t), (r, t, x, t), (x, t, x, y)]
    side = F.explode(F.array(*[F.struct(*[c.alias(n) for c, n in zip(s, ("ax", "ay", "bx", "by"))]) for s in sides]))
    return rects.select(*PAGE, side.alias("s")).select(*PAGE, "s.*")


def snapped(x: Column, snap: float) -> Column:
    return F.round(x / snap) * snap


def intersections(segments: DataFrame, snap: float = SNAP) -> DataFrame:
    """(page, px, py): where horizontal and vertical segments meet within snap, on the grid of snap.

    A join on the page with the conditions on the coordinates left to it; points on one grid place
    count once.
    """
    flat = segments.filter(F.abs(F.col("ay") - F.col("by")) < snap).select(*PAGE, ((F.col("ay") + F.col("by")) / 2).alias("hy"), (F.least("ax", "bx") - snap).alias("h0"), (F.greatest("ax", "bx") + snap).alias("h1"))
    up = segments.filter(F.abs(F.col("ax") - F.col("bx")) < snap)
    up = up.select(*PAGE, ((F.col("ax") + F.col("bx")) / 2).alias("vx"), (F.least("ay", "by") - snap).alias("v0"), (F.greatest("ay", "by") + snap).alias("v1"))
    met = flat.distinct().join(up.distinct(), PAGE).filter(F.col("vx").between(F.col("h0"), F.col("h1")) & F.col("hy").between(F.col("v0"), F.col("v1")))
    return met.select(*PAGE, snapped(F.col("vx"), snap).alias("px"), snapped(F.col("hy"), snap).alias("py")).distinct()


def cluster_points(points: list[tuple[float, float]], snap: float = SNAP) -> list[int]:
    """A label for each point: points are linked when they share x or y within snap."""
    up = list(range(len(points)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for axis in (0, 1):
        order = sorted(range(len(points)), key=lambda i: points[i][axis])
        for a, b in zip(order, order[1:]):
            if points[b][axis] - points[a][axis] < snap:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(points))]


def clusters(points: DataFrame, snap: float = SNAP) -> DataFrame:
    """points with table_id, for clusters of four or more; ids follow the least (px, py) of each."""

    def fold(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            at = [(p["px"], p["py"]) for p in page]
            labels = cluster_points(at, snap)
            sizes = Counter(labels)
            ids: dict[int, int] = {}
            out.append([{"table_id": ids.setdefault(k, len(ids)), "px": x, "py": y} for (x, y), k in zip(at, labels) if sizes[k] >= 4])
        return pd.Series(out)

    udf = F.pandas_udf(fold, "array<struct<table_id int, px double, py double>>")
    pages = points.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("px", "py"))).alias("p"))
    return pages.select(*PAGE, F.explode(udf("p")).alias("c")).select(*PAGE, "c.*")


def axis(values: Column, snap: float = SNAP) -> Column:
    """Sorted values without those less than snap beyond the last one kept."""
    start = F.array().cast("array<double>")
    keep = lambda acc, v: F.when((F.size(acc) > 0) & (v - F.element_at(acc, -1) < snap), acc).otherwise(F.array_append(acc, v))
    return F.aggregate(F.array_sort(values), start, keep)


def grid(points: DataFrame, snap: float = SNAP) -> DataFrame:
    """(page, table_id, row, col, box): the cells between the lines of each cluster, rows from the top."""
    axes = points.groupBy(*PAGE, "table_id").agg(axis(F.collect_set("px"), snap).alias("xs"), axis(F.collect_set("py"), snap).alias("ys"))
    some = axes.filter((F.size("xs") >= 2) & (F.size("ys") >= 2))
    rows = some.select("*", F.explode(F.sequence(F.lit(0), F.size("ys") - 2)).alias("row"))
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("xs") - 2)).alias("col"))
    at = lambda a, i: F.element_at(a, i.cast("int"))
    low = F.size("ys") - 1 - F.col("row")
    return cells.select(*PAGE, "table_id", "row", "col", at("xs", F.col("col") + 1).alias("x0"), at("ys", low).alias("y0"), at("xs", F.col("col") + 2).alias("x1"), at("ys", low + 1).alias("y1"))


def fill(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """cells with text: the spans whose middle and baseline are inside, edges counted, joined by blanks.

    A span on an edge is in both cells.
    """
    mid = F.col("x") + F.col("width") / 2
    placed = spans.select(*PAGE, "line_idx", "span_idx", "text", mid.alias("cx"), F.col("y").alias("cy"))
    inside = F.col("cx").between(F.col("x0"), F.col("x1")) & F.col("cy").between(F.col("y0"), F.col("y1"))
    found = cells.join(placed, PAGE).filter(inside).groupBy(*PAGE, "table_id", "row", "col").agg(joined(F.col("text"), ["line_idx", "span_idx"], " ").alias("text"))
    return cells.join(found, [*PAGE, "table_id", "row", "col"], "left").withColumn("text", F.trim(F.coalesce("text", F.lit(""))))


# --- stream ----------------------------------------------------------------


def words(spans: DataFrame, min_gap: float = MIN_GAP) -> DataFrame:
    """(page, line_idx, word_idx, w0, w1, text): spans merged unless the gap between them is over min_gap."""
    key = [*PAGE, "line_idx"]
    w = Window.partitionBy(*key).orderBy("span_idx")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    cut = spans.withColumn("gap", gap).withColumn("new", F.when(F.col("gap").isNull() | (F.col("gap") > min_gap), 1).otherwise(0))
    cut = cut.withColumn("word_idx", F.sum("new").over(w).cast("int") - 1)
    piece = F.concat(F.when((F.col("new") == 0) & (F.col("gap") > F.col("font_size") * 0.25), " ").otherwise(""), F.col("text"))
    return cut.withColumn("piece", piece).groupBy(*key, "word_idx").agg(
        F.min_by("x", "span_idx").alias("w0"), F.max_by(F.col("x") + F.col("width"), "span_idx").alias("w1"), joined(F.col("piece"), ["span_idx"], "").alias("text")
    )


def modal_columns(found: DataFrame) -> DataFrame:
    """(page, cols): how many words most lines have; the larger of equally frequent numbers."""
    per = found.groupBy(*PAGE, "line_idx").agg(F.count("*").alias("n")).groupBy(*PAGE, "n").agg(F.count("*").alias("c"))
    return per.groupBy(*PAGE).agg(F.max_by("n", F.struct("c", "n")).cast("int").alias("cols"))


def boundaries(found: DataFrame, modal: DataFrame) -> DataFrame:
    """(page, col, b): the left edges of the words of modal lines, in order, as cols equal parts; b is
    the mean of a part, and what doesn't fill the last part is left out."""
    w = Window.partitionBy(*PAGE, "line_idx")
    edges = found.withColumn("n", F.count("*").over(w)).join(modal, PAGE).filter(F.col("n") == F.col("cols"))
    p = Window.partitionBy(*PAGE)
    ranked = edges.withColumns({"rn": F.row_number().over(p.orderBy("w0", "line_idx")) - 1, "size": F.floor(F.count("*").over(p) / F.col("cols"))})
    part = F.floor(F.col("rn") / F.col("size")).cast("int")
    return ranked.withColumn("col", part).filter(F.col("col") < F.col("cols")).groupBy(*PAGE, "col").agg(F.avg("w0").alias("b"))


def stream_lines(found: DataFrame, bounds: DataFrame, min_rows: int = MIN_ROWS, min_cols: int = MIN_COLS) -> DataFrame:
    """(page, line_idx, table_id, row): runs of lines that have columns' words, more than half of
    them within 20 points of a boundary."""
    near = found.select(*PAGE, "line_idx", "word_idx", "w0").join(bounds, PAGE, "left").groupBy(*PAGE, "line_idx", "word_idx").agg(F.coalesce(F.max(F.abs(F.col("w0") - F.col("b")) < NEAR_BOUNDARY), F.lit(False)).alias("near"))
    lines = near.groupBy(*PAGE, "line_idx").agg(F.count("*").alias("n"), F.sum(F.col("near").cast("int")).alias("k"))
    ok = (F.col("n") >= min_cols) & (F.col("k") / F.col("n") > 0.5)
    w = Window.partitionBy(*PAGE).orderBy("line_idx")
    ranked = lines.withColumn("ok", ok).withColumn("rn", F.row_number().over(w)).filter("ok")
    runs = ranked.withColumn("run", F.col("rn") - F.row_number().over(w)).withColumn("rows", F.count("*").over(Window.partitionBy(*PAGE, "run"))).filter(F.col("rows") >= min_rows)
    row = F.row_number().over(Window.partitionBy(*PAGE, "run").orderBy("line_idx")) - 1
    return runs.select(*PAGE, "line_idx", (F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("run")) - 1).alias("table_id"), row.alias("row"))


def stream_cells(found: DataFrame, bounds: DataFrame, placed: DataFrame) -> DataFrame:
    """(page, table_id, row, col, text): each word in the last column that begins at most 10 points
    right of its middle (else the first), words of a cell joined by blanks; empty cells too."""
    mid = (F.col("w0") + F.col("w1")) / 2
    inside = found.join(placed, [*PAGE, "line_idx"]).select(*PAGE, "table_id", "row", "word_idx", "text", mid.alias("mid"))
    hit = inside.join(bounds, PAGE).groupBy(*PAGE, "table_id", "row", "word_idx").agg(F.first("text").alias("text"), F.coalesce(F.max(F.when(F.col("mid") >= F.col("b") - SLACK, F.col("col"))), F.lit(0)).alias("col"))
    texts = hit.groupBy(*PAGE, "table_id", "row", "col").agg(joined(F.col("text"), ["word_idx"], " ").alias("text"))
    every = placed.select(*PAGE, "table_id", "row").join(bounds.select(*PAGE, "col"), PAGE)
    return every.join(texts, [*PAGE, "table_id", "row", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))


# --- whole pages -------------------------------------------------------------

CELL = "table_id int, row int, col int, text string, strategy string, x0 double, y0 double, x1 double, y1 double"


def detect(segments: DataFrame | None, spans: DataFrame, strategy: str = "auto", snap: float = SNAP, min_gap: float = MIN_GAP, min_rows: int = MIN_ROWS, min_cols: int = MIN_COLS) -> DataFrame:
    """(page, CELL) of the tables of pages: lattice by rule lines, stream by how words are aligned. auto: ruled
    tables, and stream tables of the pages that have none ruled. Cells of stream tables have no box.

    All that a page has is brought together once and folded; the functions above have the same steps as joins.
    """
    if strategy not in ("auto", "lattice", "stream"):
        raise ValueError(f"not a strategy: {strategy}")
    pages = spans.groupBy(*PAGE).agg(F.collect_list(F.struct("line_idx", "span_idx", "text", "x", "y", "width", "font_size")).alias("_s"))
    if segments is None:
        pages = pages.withColumn("_g", F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>"))
    else:
        pages = pages.join(segments.groupBy(*PAGE).agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("_g")), PAGE, "full")
    schema = ArrayType(StructType.fromDDL(CELL))
    arrow = to_arrow_type(schema)

    def fold(s: list[dict] | None, g: list[dict] | None) -> list[dict]:
        from quire.sources import pagefold

        lines = pagefold.given_lines(s or [])
        found = [(t, "lattice") for t in pagefold.ruled([(x["ax"], x["ay"], x["bx"], x["by"]) for x in g or []], lines, snap, min_rows, min_cols)] if strategy != "stream" else []
        if strategy == "stream" or strategy == "auto" and not found:
            found = [(t, "stream") for t in pagefold.aligned(lines, min_gap, min_rows, min_cols)]
        cells = []
        for i, (t, how) in enumerate(found):
            for r, row in enumerate(t["rows"]):
                for c, text in enumerate(row):
                    box = (t["xs"][c], t["ys"][-2 - r], t["xs"][c + 1], t["ys"][-1 - r]) if how == "lattice" else (None,) * 4
                    cells.append(dict(zip(("table_id", "row", "col", "text", "strategy", *geometry.BOX), (i, r, c, text, how, *box))))
        return cells

    udf = F.arrow_udf(lambda spans_, segments_: sliced(fold, arrow, spans_, segments_), schema).asNondeterministic()
    return pages.select(*PAGE, F.explode(udf("_s", "_g")).alias("_c")).select(*PAGE, "_c.*")


def lattice(segments: DataFrame, spans: DataFrame, **how) -> DataFrame:
    """The cells of ruled tables of at least min_rows x min_cols, with their boxes."""
    return detect(segments, spans, "lattice", **how).drop("strategy")


def stream(spans: DataFrame, **how) -> DataFrame:
    """The cells of tables without rules, from how words are aligned."""
    return detect(None, spans, "stream", **how).select(*PAGE, "table_id", "row", "col", "text")


def to_rows(cells: DataFrame, key: list[str]) -> DataFrame:
    """(key, row, cells array<string>): the texts of each row from left to right."""
    return cells.groupBy(*key, "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]).alias("cells"))


def to_csv(cells: DataFrame, key: list[str], delimiter: str = ",") -> DataFrame:
    """(key, csv): each table as delimited text; fields with quotes, delimiters or line ends are quoted."""
    f = F.coalesce("text", F.lit(""))
    special = f.contains('"') | f.contains(delimiter) | f.contains("\n") | f.contains("\r")
    field = F.when(special, F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(f)
    rows = cells.groupBy(*key, "row").agg(joined(field, ["col"], delimiter).alias("line"))
    return rows.groupBy(*key).agg(F.concat(joined(F.col("line"), ["row"], "\n"), F.lit("\n")).alias("csv"))


def boxes(cells: DataFrame) -> DataFrame:
    """(page, table_id, box) around the cells."""
    return cells.groupBy(*PAGE, "table_id").agg(*geometry.union_of())
