"""Search in lines, page ranges, and hit limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hits(lines: DataFrame, query: str, regex: bool = False, case_sensitive: bool = True, text: str = "text") -> DataFrame:
    """The lines that hold query; one hit a line. As a regex it must do without look-around and back-references."""
    t = F.col(text)
    if regex:
        return lines.filter(t.rlike(query if case_sensitive else f"(?i){query}"))
    return lines.filter(t.contains(query) if case_sensitive else F.lower(t).contains(query.lower()))


def first_hits(found: DataFrame, key: list[str], order: list[str], most: int = 0) -> DataFrame:
    """At most `most` hits of each key, in order; 0 keeps all."""
    if not most:
        return found
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return found.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


def page_numbers(ranges: Column) -> Column:
    """'1-5,8,10-12' as the sorted different pages; null where a part is malformed or runs backwards."""
    parts = F.transform(F.split(ranges, ","), lambda p: F.trim(p))
    fine = F.forall(parts, lambda p: p.rlike("^[0-9]{1,9}( *- *[0-9]{1,9})?$"))
    ends = F.transform(parts, lambda p: F.transform(F.split(p, "-"), lambda n: F.trim(n).cast("int")))
    forward = F.forall(ends, lambda e: F.element_at(e, 1) <= F.element_at(e, -1))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(ends, lambda e: F.sequence(F.element_at(e, 1), F.element_at(e, -1))))))
    return F.when(fine, F.when(forward, pages))


def select_pages(pages: DataFrame, ranges: str, page: str = "page") -> DataFrame:
    """The pages that ranges name. Raises for malformed ranges."""
    one = pages.sparkSession.range(1).select(page_numbers(F.lit(ranges)).alias("p")).first().p
    if one is None:
        raise ValueError(f"not a page range: {ranges!r}")
    return pages.filter(F.col(page).isin(one))
