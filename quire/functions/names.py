"""Names of the kinds that options and results have, and what unknown input falls back to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANNOTATIONS = {"Text": "text", "Link": "link", "FreeText": "free_text", "Highlight": "highlight", "Underline": "underline", "StrikeOut": "strike_out", "Square": "square", "Circle": "circle", "Line": "line", "Stamp": "stamp"}
IMAGES = {"jpeg": "jpg", "jpg": "jpg", "bmp": "bmp", "png": "png"}
POSITIONS = {**{p: p for p in ("center", "top_left", "top_right", "bottom_left", "bottom_right")}, "topleft": "top_left", "topright": "top_right", "bottomleft": "bottom_left", "bottomright": "bottom_right"}
LEVELS = {"1a": "1a", "1b": "1b", "2b": "2b"}
LAYERS = {"over": "over", "under": "under"}
SEVERITIES = {"error": "error", "warning": "warning", "info": "info"}


def named(value: Column, names: dict[str, str], default: Column | str, fold: bool = True) -> Column:
    """The name that stands for value, or the default; letters are compared in lower case if fold."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(value) if fold else value), default if isinstance(default, Column) else F.lit(default))


def annotation_type(name: Column) -> Column:
    """From a PDF subtype; one not known is passed on as it is."""
    return named(name, ANNOTATIONS, name, fold=False)


def rotation(degrees: Column) -> Column:
    """0, 90, 180 or 270; null for any other."""
    return F.when(degrees.isin(0, 90, 180, 270), degrees)
