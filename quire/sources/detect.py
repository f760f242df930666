"""Which format a file has: by name, by first bytes, by what an archive holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.archive import Archive, ArchiveError

#: format: extensions, MIME type, name.
FORMATS = {
    "pdf": (("pdf",), "application/pdf", "PDF"),
    "docx": (("docx",), "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "Word document"),
    "xlsx": (("xlsx",), "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "Excel workbook"),
    "pptx": (("pptx",), "application/vnd.openxmlformats-officedocument.presentationml.presentation", "PowerPoint presentation"),
    "html": (("html", "htm"), "text/html", "HTML"),
    "epub": (("epub",), "application/epub+zip", "EPUB"),
    "markdown": (("md", "markdown"), "text/markdown", "Markdown"),
    "unknown": ((), "application/octet-stream", "unknown"),
}
EXTENSIONS = {e: f for f, (es, _, _) in FORMATS.items() for e in es}


def extension(path: Column) -> Column:
    """The part after the last point of the last part of a path, in lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def by_extension(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


def by_magic(content: Column) -> Column:
    """By the very first bytes; archives are unknown, and HTML is told by exact prefixes only."""
    head = F.decode(F.substring(content, 1, 15), "ISO-8859-1")
    web = head.startswith("<?xml") | head.startswith("<!DOCTYPE html") | head.startswith("<html")
    return F.when(head.startswith("%PDF"), "pdf").when(web, "html").otherwise("unknown")


def looks_like_html(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 1024))
    return head.contains("<!doctype html") | head.contains("<html") | head.contains("<head") | head.contains("<body")


def of_bytes(content: bytes | None) -> str:
    """By content: an archive's entries tell which kind it is, and HTML may begin with anything."""
    if not content:
        return "unknown"
    if content[:4] == b"%PDF":
        return "pdf"
    if content[:4] == b"PK\x03\x04":
        try:
            a = Archive(content)
            if "mimetype" in a.names() and a.text("mimetype").strip() == FORMATS["epub"][1]:
                return "epub"
        except ArchiveError:
            return "unknown"
        kinds = {"word/": "docx", "xl/": "xlsx", "ppt/": "pptx"}
        return next((k for n in a.names() for p, k in kinds.items() if n.lower().startswith(p)), "unknown")
    head = content[:1024].lower()
    return "html" if any(m in head for m in (b"<!doctype html", b"<html", b"<head", b"<body")) else "unknown"


def facts(spark: SparkSession) -> DataFrame:
    """(format, extension, mime, name) of all formats."""
    return spark.createDataFrame([(f, es[0] if es else "", m, n) for f, (es, m, n) in FORMATS.items()], "format string, extension string, mime string, name string")
