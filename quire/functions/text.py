"""Scalar text functions on columns; every one stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What begins a list item: a bullet, or a number or one letter with a point or bracket; then a blank.
BULLETS = "-*•‣◦⁃–—"
MARKER = rf"^\s*([{BULLETS}]|[0-9]+[.)]|[A-Za-z][.)]) "


def is_list_item(text: Column) -> Column:
    """Whether a line begins with a list marker; false for null."""
    return F.coalesce(text.rlike(MARKER), F.lit(False))


def strip_marker(text: Column) -> Column:
    """The line without blanks before it and without its list marker."""
    return F.when(text.rlike(MARKER), F.regexp_replace(text, MARKER, "")).otherwise(F.ltrim(text))


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_html(text: Column) -> Column:
    return _replaced(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])


def escape_attribute(text: Column) -> Column:
    return _replaced(escape_html(text), [('"', "&quot;")])


def escape_xml(text: Column) -> Column:
    return _replaced(escape_attribute(text), [("'", "&apos;")])


def escape_pipe(text: Column) -> Column:
    """A cell of a pipe table: trimmed, bars escaped, line ends as blanks."""
    return _replaced(F.trim(text), [("|", "\\|"), ("\n", " ")])


def escape_pdf(text: Column) -> Column:
    """The inside of a PDF literal string."""
    return _replaced(text, [("\\", "\\\\"), ("(", "\\("), (")", "\\)")])


def format_number(x: Column) -> Column:
    """At most six decimals, without trailing zeros."""
    fixed = F.format_string("%.6f", x.cast("double"))
    return F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")


def padded(text: Column, width: Column) -> Column:
    """text and blanks up to a width in bytes (rpad counts characters)."""
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(0), (width - F.octet_length(text)).cast("int"))))


def wrap(text: Column, width: int = 80) -> Column:
    """Lines of words, filled greedily up to width bytes; an empty text gives one empty line.

    A word that is longer than the width has a line of its own.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, w: Column) -> Column:
        fits = (acc["now"] == "") | (F.octet_length(acc["now"]) + 1 + F.octet_length(w) <= width)
        now = F.when(acc["now"] == "", w).when(fits, F.concat(acc["now"], F.lit(" "), w)).otherwise(w)
        done = F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["now"]))
        return F.struct(done.alias("done"), now.alias("now"))

    return F.aggregate(words, start, step, lambda a: F.array_append(a["done"], a["now"]))


def xlsx_cell(number: Column) -> Column:
    """A number as a spreadsheet shows it: whole ones without decimals."""
    return F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(number.cast("string"))


def bytes_of(text: Column) -> Column:
    return F.octet_length(text)
