"""Documents of any format into one set of DataFrames. Every file is parsed once, in one Arrow pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from quire import storage
from quire.operators import convert, markdown
from quire.operators.lines import group_spans, lines_of
from quire.sources import detect, htmltree, office, pagefold, pdf

#: What a parsed document has, with its type.
FIELDS = {
    "format": "string",
    "page_count": "int",
    "text": "string",
    "metadata": "map<string,string>",
    "error": "struct<code:string,message:string>",
    "blocks": "array<struct<page:int,block_idx:int,type:string,text:string,level:int,indent_level:int,table_id:int>>",
    "cells": "array<struct<page:int,table_id:int,row:int,col:int,text:string,col_span:int,row_span:int>>",
    "images": "array<struct<page:int,width:int,height:int,bits:int,color_space:string,filters:array<string>,data:binary>>",
    "bookmarks": "array<struct<title:string,page:int,level:int>>",
    "pages": "array<struct<page:int,width:double,height:double,rotation:int>>",
    "spans": "array<struct<page:int,span_idx:int,text:string,x:double,y:double,width:double,font_size:double,font_name:string>>",
    "segments": "array<struct<page:int,ax:double,ay:double,bx:double,by:double>>",
    "annotations": "array<struct<page:int,annot_idx:int,type:string,rect:array<double>,contents:string,author:string,uri:string,target_page:int,text:string>>",
    "fields": "array<struct<id:int,parent:int,t:string,ft:string,ff:int,value:string>>",
    "notes": "array<struct<page:int,text:string>>",
}
#: Computed from the others where it is asked for.
DERIVED = {"markdown": "string"}
PARSED = ", ".join(f"{k} {t}" for k, t in FIELDS.items())
PARTS = [k for k, t in FIELDS.items() if t.startswith("array")]
_KEYS = {
    "blocks": ("page", "block_idx", "type", "text", "level", "indent_level", "table_id"),
    "cells": ("page", "table_id", "row", "col", "text", "col_span", "row_span"),
    "images": ("page", "width", "height", "bits", "color_space", "filters", "data"),
    "bookmarks": ("title", "page", "level"),
    "pages": ("page", "width", "height", "rotation"),
    "spans": ("page", "span_idx", "text", "x", "y", "width", "font_size", "font_name"),
    "segments": ("page", "ax", "ay", "bx", "by"),
    "annotations": ("page", "annot_idx", "type", "rect", "contents", "author", "uri", "target_page", "text"),
    "fields": ("id", "parent", "t", "ft", "ff", "value"),
    "notes": ("page", "text"),
}


def html_dict(content: bytes, want: set[str]) -> dict:
    """Only what is in want: links, images and tables are walks of the tree of their own."""
    root = htmltree.parse(content.decode("utf-8"))
    out: dict = {"page_count": 1}
    if want & {"blocks", "cells", "bookmarks", "markdown"}:
        out["blocks"] = blocks = htmltree.blocks_of(root)
        out["bookmarks"] = [{"title": b["text"], "page": 1, "level": b["level"]} for b in blocks if b["type"] == "heading"]
    if "text" in want:
        out["text"] = htmltree.text_of(root)
    if "metadata" in want:
        out["metadata"] = htmltree.metadata_of(root)
    if "images" in want:
        out["images"] = htmltree.images_of(root)
    if want & {"cells", "markdown"}:
        out["tables"] = htmltree.tables_of(root)
    if "annotations" in want:
        out["annotations"] = [{"page": 1, "annot_idx": i, "type": "link", "uri": x["uri"], "text": x["text"]} for i, x in enumerate(htmltree.links_of(root))]
    return out


def markdown_dict(content: bytes) -> dict:
    """Headings, items and paragraphs of plain Markdown."""
    import re

    blocks, para, text = [], [], content.decode("utf-8")
    for line in [*text.split("\n"), ""]:
        head, item = re.match(r"(#{1,6}) +(.*?)\s*#*$", line), re.match(r"( *)[-*+] +(.*)", line)
        if para and (head or item or not line.strip()):
            blocks.append({"type": "paragraph", "text": " ".join(para)})
            para = []
        if head:
            blocks.append({"type": "heading", "text": head[2], "level": len(head[1])})
        elif item:
            blocks.append({"type": "list_item", "text": item[2], "indent_level": len(item[1]) // 2})
        elif line.strip():
            para.append(line.strip())
    return {"page_count": 1, "text": text, "metadata": {}, "blocks": blocks}


READERS = {"pdf": pdf.read, "docx": office.docx, "xlsx": office.xlsx, "pptx": office.pptx, "epub": office.epub, "html": html_dict, "markdown": markdown_dict}
#: Bytes of an error's message that are kept.
MESSAGE = 500


def fold_pages(doc: dict) -> None:
    """Adds text and blocks to a PDF file as pdf.read() gives it."""
    spans: dict[int, list] = {}
    rules: dict[int, list] = {}
    for into, name in ((spans, "spans"), (rules, "segments")):
        for x in doc[name]:
            into.setdefault(x["page"], []).append(x)
    pages = [(p["page"], *pagefold.page_of(spans.get(p["page"], []), rules.get(p["page"], []))) for p in doc["pages"]]
    doc["text"] = "\n".join(t for nr, t, _ in pages if nr in spans) if spans else ""
    doc["blocks"] = [b | {"page": nr, "rows": [[{"text": c, "col_span": 1, "row_span": 1} for c in r] for r in b["rows"]]} if "rows" in b else b | {"page": nr} for nr, _, bs in pages for b in bs]


def parse(content: bytes | None, fmt: str | None, password: str | None = None, want: set[str] | None = None) -> dict:
    """One document as a dict of FIELDS, or those of want; what goes wrong is in error, with its code and
    the first MESSAGE characters of its message. fmt is the format; with ? before it, only where the content
    doesn't tell."""
    want = set(FIELDS) if want is None else want
    named = fmt.removeprefix("?") if fmt else None
    fmt = fmt if fmt in READERS else detect.of_bytes(content)
    fmt = named if fmt not in READERS and named in READERS and content else fmt
    out: dict = {k: None for k in ("page_count", "text", "metadata", "error")} | {"format": fmt} | {p: [] for p in PARTS}
    try:
        if not content:
            raise ValueError("there is no content")
        if fmt not in READERS:
            raise ValueError("the format isn't known")
        if password is not None and fmt != "pdf":
            raise ValueError("only PDF files have passwords")
        if fmt == "pdf":
            doc = pdf.read(content, password)
            if want & {"text", "blocks", "cells", "markdown"}:
                fold_pages(doc)
        else:
            doc = html_dict(content, want) if fmt == "html" else READERS[fmt](content)
    except Exception as e:  # a bad file is a row with an error, never a failed job
        return out | {"error": {"code": getattr(e, "code", "malformed"), "message": str(e)[:MESSAGE]}}
    out |= {k: doc.get(k) for k in ("page_count", "text", "metadata")}
    cells, blocks, n = [], [], 0
    for i, b in enumerate(doc.get("blocks", [])):
        table = None
        if "rows" in b:
            table = n
            cells += [{"page": b.get("page", 1), "table_id": table, "row": r, "col": c} | x for r, row in enumerate(b["rows"]) for c, x in enumerate(row)]
        n += b["type"] == "table"
        blocks.append({"page": b.get("page", 1), "block_idx": i, "type": b["type"], "text": b["text"], "level": b.get("level"), "indent_level": b.get("indent_level"), "table_id": table})
    inside = doc.get("tables", [])[n:] if len(doc.get("tables", [])) > n else []
    for t, rows in enumerate(inside, n):  # tables inside tables come after the others
        cells += [{"page": 1, "table_id": t, "row": r, "col": c} | x for r, row in enumerate(rows) for c, x in enumerate(row)]
    out |= {"blocks": blocks, "cells": cells, "notes": [{"page": i, "text": x} for i, x in enumerate(doc.get("notes", []), 1) if x]}
    out |= {p: doc[p] for p in PARTS if p in doc and p not in ("blocks", "cells", "notes")}
    for p in PARTS:
        out[p] = [{"page": 1} | x if "page" in _KEYS[p] else x for x in out[p]]
    return out


def markdown_of(doc: dict, **how) -> str | None:
    """The Markdown of a parsed document, by the custom of its format; null where it has an error."""
    if doc["error"] is not None:
        return None
    return markdown.text(convert.nested(doc["blocks"], doc["cells"]), doc["format"], {n["page"]: n["text"] for n in doc["notes"]}, **how)


def parse_column(df: DataFrame, content: str = "content", fmt: str | None = None, password: str | None = None, only: list[str] | None = None, **how) -> DataFrame:
    """df with doc, a struct of FIELDS of each content, or of those named (DERIVED ones too).

    What isn't named isn't built. how: what markdown.text() takes, for markdown.
    """
    names = list(FIELDS) if only is None else only
    schema = ", ".join(f"{n} {(FIELDS | DERIVED)[n]}" for n in names)
    arrow = to_arrow_type(StructType.fromDDL(schema))
    want = set(names)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for contents, formats in batches:
            rows = []
            for c, f in zip(contents, formats):
                r = parse(c.as_py(), f.as_py(), password, want)
                if "markdown" in want:
                    r["markdown"] = markdown_of(r, **how)
                for p in want.intersection(PARTS):
                    r[p] = [{k: x.get(k) for k in _KEYS[p]} for x in r[p]]
                r["metadata"] = None if r["metadata"] is None else list(r["metadata"].items())
                rows.append({n: r[n] for n in names})
            yield pa.array(rows, type=arrow)

    udf = F.arrow_udf(run, StructType.fromDDL(schema)).asNondeterministic()  # else a filter or an explode above it runs it again
    return df.withColumn("doc", udf(F.col(content), F.lit(None).cast("string") if fmt is None else F.col(fmt)))


def plain(row: dict) -> dict:
    """A parsed document as Arrow gives it, with null instead of NaN and lists instead of arrays."""
    lists = {p: [dict(x) for x in row[p]] if row[p] is not None else [] for p in ("blocks", "cells", "notes")}
    return {"format": row["format"], "error": row["error"] if isinstance(row["error"], dict) else None} | lists


@dataclass
class Documents:
    """Documents; every property is a DataFrame keyed by doc_id, and parses the files once for what it needs.

    Who needs several properties calls stored() first: it parses once for all of them.
    """

    source: DataFrame
    password: str | None = None
    done: bool = False

    def get(self, *names: str, **how) -> DataFrame:
        """(doc_id, doc) with these of FIELDS and DERIVED in doc; how as in parse_column()."""
        if not self.done:
            return parse_column(self.source, fmt="_fmt", password=self.password, only=list(names), **how).select("doc_id", "doc")
        if "markdown" not in names:
            return self.source
        run = F.pandas_udf(lambda docs: pd.Series([markdown_of(plain(r), **how) for r in docs.to_dict("records")], dtype=object), "string")
        return self.source.withColumn("doc", F.struct("doc.*", run(F.struct("doc.format", "doc.error", "doc.blocks", "doc.cells", "doc.notes")).alias("markdown")))

    @property
    def parsed(self) -> DataFrame:
        """(doc_id, doc) with all of FIELDS."""
        return self.get(*FIELDS)

    def stored(self) -> "Documents":
        """The same, parsed now and read from the shared folder, of which each property reads its own columns."""
        return self if self.done else Documents(storage.stored(self.parsed, "parsed"), done=True)

    def part(self, name: str) -> DataFrame:
        return self.get(name).select("doc_id", F.explode(f"doc.{name}").alias("x")).select("doc_id", "x.*")

    @property
    def files(self) -> DataFrame:
        return self.get("format", "page_count", "metadata", "error").select("doc_id", "doc.format", "doc.page_count", "doc.metadata", "doc.error")

    @property
    def errors(self) -> DataFrame:
        return self.files.filter("error IS NOT NULL").select("doc_id", "format", "error.code", "error.message")

    @property
    def spans(self) -> DataFrame:
        """The spans of PDF pages, with their lines."""
        return group_spans(self.part("spans"))

    @property
    def texts(self) -> DataFrame:
        """(doc_id, text) of every format; lines and pages of a PDF are joined by a line feed."""
        return self.get("text").select("doc_id", F.col("doc.text").alias("text")).filter("text IS NOT NULL")

    @property
    def lines(self) -> DataFrame:
        return lines_of(self.spans).select("doc_id", "page", "line_idx", "text", "x0", "y0", "x1", "y1")

    @property
    def blocks(self) -> DataFrame:
        """Blocks of every format; those of PDFs come from the fonts and places of their text. A table is
        a block with a table_id; its cells are in cells."""
        return self.part("blocks")

    @property
    def cells(self) -> DataFrame:
        """Cells of tables of every format; those of PDFs from rules, or from how words are aligned."""
        return self.part("cells")

    def markdown(self, **how) -> DataFrame:
        """(doc_id, markdown) with the tables in it; how: what markdown.text() takes. Files with an error have none."""
        return self.get("markdown", **how).select("doc_id", F.col("doc.markdown").alias("markdown")).filter("markdown IS NOT NULL")

    @property
    def images(self) -> DataFrame:
        return self.part("images")

    @property
    def bookmarks(self) -> DataFrame:
        return self.get("bookmarks").select("doc_id", F.posexplode("doc.bookmarks").alias("ord", "x")).select("doc_id", "ord", "x.*")

    @property
    def pages(self) -> DataFrame:
        return self.part("pages")

    @property
    def annotations(self) -> DataFrame:
        return self.part("annotations")

    @property
    def links(self) -> DataFrame:
        return self.annotations.filter("type = 'link'")

    @property
    def metadata(self) -> DataFrame:
        return self.get("metadata").select("doc_id", F.explode("doc.metadata").alias("field", "value"))


def open_files(spark: SparkSession, path: str, fmt: str | None = None, password: str | None = None) -> Documents:
    """The files that a path or glob names; no match is an error of Spark. Content tells the format before the name does, but for Markdown."""
    files = spark.read.format("binaryFile").load(path)
    by_name = detect.by_extension(F.col("path"))
    hint = F.lit(fmt) if fmt else F.when(by_name == "markdown", by_name).otherwise(F.concat(F.lit("?"), by_name))
    return Documents(files.select(F.col("path").alias("doc_id"), "content", hint.alias("_fmt")), password)


def open_table(df: DataFrame, key: str, content: str, fmt: str | None = None, password: str | None = None) -> Documents:
    """Documents that lie in a column, as text or bytes."""
    return Documents(df.select(F.col(key).alias("doc_id"), F.col(content).cast("binary").alias("content"), F.lit(fmt).cast("string").alias("_fmt")), password)
