"""python -m quire.cli COMMAND PATH ...: the operators on files, as text or JSON.

Exit code 1: wrong use or nothing found; 2: a file can't be processed.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import pipeline, storage
from quire.operators import compare, convert, forms, mutate, pdfsets, render, search, security, validate
from quire.sources import pdfedit, pdffacts, reader, sign

TABLES = {"info": "files", "text": "texts", "structure": "blocks", "tables": "cells", "images": "images", "bookmarks": "bookmarks", "annotations": "annotations", "links": "links", "metadata": "metadata", "pages": "pages", "spans": "spans"}


_ON = (("--pages",), {"help": "page ranges, as 1-3,5; else all"})
#: Commands that write PDF files: what they do, and their options.
EDITS: dict[str, tuple[str, list]] = {
    "merge": ("the files in the order of their names as one", []),
    "split": ("a file for each range; {part} in output counts them", [(("ranges",), {"help": "as 1-3,5"})]),
    "reorder": ("the pages named, in this order", [(("order",), {"help": "as 3,1,2"})]),
    "delete": ("all pages but those named", [(("ranges",), {})]),
    "rotate": ("by 90, 180 or 270 degrees", [(("degrees",), {"type": int}), _ON]),
    "watermark": ("text over the pages", [(("text",), {}), (("--size",), {"type": float, "default": 60.0}), (("--angle",), {"type": float, "default": 45.0}), (("--opacity",), {"type": float, "default": 0.3}), (("--position",), {"default": "center"}), _ON]),
    "stamp": ("the first page of another file over the pages", [(("overlay",), {}), (("--x",), {"type": float, "default": 0.0}), (("--y",), {"type": float, "default": 0.0}), (("--scale",), {"type": float, "default": 1.0}), _ON]),
    "redact": ("without the text that holds a pattern", [(("pattern",), {}), (("--regex",), {"action": "store_true"}), (("--case-sensitive",), {"action": "store_true"})]),
    "sanitize": ("without scripts, actions, embedded files and links", [(("--keep-links",), {"action": "store_true"})]),
    "optimize": ("without what is unused or repeated", [(("--strip-metadata",), {"action": "store_true"})]),
    "encrypt": ("with a password", [(("password",), {}), (("--owner",), {}), (("--algorithm",), {"choices": ["rc4", "aes128", "aes256"], "default": "aes128"})]),
    "sign": ("signed by a key and a certificate (DER files)", [(("key",), {}), (("certificate",), {}), (("--reason",), {}), (("--name",), {})]),
    "archive": ("as an archive file", [(("--level",), {"choices": ["1a", "1b", "2b"], "default": "1b"})]),
    "fill": ("form fields set", [(("values",), {"nargs": "+", "help": "name=value"})]),
}


def _pages(spark: SparkSession, ranges: str) -> list[int]:
    found = spark.range(1).select(search.page_numbers(F.lit(ranges)).alias("p")).first().p
    if found is None:
        raise ValueError(f"not a page range: {ranges}")
    return found


def edit(spark: SparkSession, a: argparse.Namespace) -> int:
    """Runs one of EDITS on the files of a.path, on the executors."""
    files = spark.read.format("binaryFile").load(a.path).select("path", "content")
    on = _pages(spark, a.pages) if getattr(a, "pages", None) else None
    part = F.lit("0")
    if a.command == "merge":
        made = pdfsets.merged(files.withColumn("k", F.lit(1)), "k", "path").withColumn("path", F.lit("merged.pdf"))
    elif a.command == "split":
        ranges = [_pages(spark, r) for r in a.ranges.split(",")]
        made = pdfsets.split(files.withColumn("r", F.array(*[F.array(*map(F.lit, r)) for r in ranges])), "r", "path")
        part = (F.col("part") + 1).cast("string")
    elif a.command == "delete":
        gone = set(_pages(spark, a.ranges))
        made = pdfsets.edited(files, lambda c: pdfedit.select(c, [p.number for p in pdfedit.pages_of(pdfedit.Pdf(c)) if p.number not in gone]))
    elif a.command == "stamp":
        made = pdfsets.edited(files, pdfedit.stamp, overlay=storage.get(a.overlay), x=a.x, y=a.y, scale=a.scale, on=on)
    else:
        edits = {
            "reorder": lambda: (pdfedit.select, {"numbers": [int(n) for n in a.order.split(",")]}), "rotate": lambda: (pdfedit.rotate, {"degrees": a.degrees, "on": on}),
            "watermark": lambda: (pdfedit.watermark, {"text": a.text, "size": a.size, "angle": a.angle, "opacity": a.opacity, "position": a.position, "on": on}),
            "redact": lambda: (pdfedit.redact, {"pattern": a.pattern, "regex": a.regex, "case_sensitive": a.case_sensitive}), "sanitize": lambda: (pdfedit.sanitize, {"links": not a.keep_links}),
            "optimize": lambda: (pdfedit.optimize, {"strip_metadata": a.strip_metadata}), "encrypt": lambda: (pdfedit.encrypt, {"user": a.password, "owner": a.owner, "algorithm": a.algorithm}),
            "sign": lambda: (sign.sign, {"key": storage.get(a.key), "cert": storage.get(a.certificate), "reason": a.reason, "name": a.name}), "archive": lambda: (pdffacts.to_pdf_a, {"level": a.level}), "fill": lambda: (pdfedit.fill_form, {"values": dict(v.split("=", 1) for v in a.values)}),
        }
        fn, options = edits[a.command]()
        made = pdfsets.edited(files, fn, **options)
    template = os.path.abspath(a.output) if "://" not in a.output else a.output

    def write(path: str, content, part: str) -> str:
        to = pipeline.fill_names(template, path).replace("{part}", part)
        storage.put(to, bytes(content))
        return to

    put = F.pandas_udf(lambda paths, contents, parts: pd.Series([None if c is None else write(p, c, n) for p, c, n in zip(paths, contents, parts)], dtype=object), "string").asNondeterministic()
    done = made.select("path", "error", put("path", "content", part).alias("to")).collect()  # a row a file, without its bytes
    for r in done:
        print(r.to if r.error is None else f"{r.path}: {r.error}", file=sys.stdout if r.error is None else sys.stderr)
    return 2 if any(r.error is not None for r in done) else 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    p.add_argument("--json", action="store_true", help="one JSON object a line")
    sub = p.add_subparsers(dest="command", required=True)
    for name in TABLES:
        sub.add_parser(name).add_argument("path")
    sub.add_parser("markdown").add_argument("path")
    s = sub.add_parser("search")
    s.add_argument("path")
    s.add_argument("query")
    s.add_argument("--regex", action="store_true")
    s.add_argument("--ignore-case", action="store_true")
    s.add_argument("--max-results", type=int, default=0)
    s = sub.add_parser("convert")
    s.add_argument("path")
    s.add_argument("target", help="format, or a file whose ending names it")
    s = sub.add_parser("diff")
    s.add_argument("a")
    s.add_argument("b")
    s = sub.add_parser("validate")
    s.add_argument("path")
    s.add_argument("--standard", choices=["headings", "pdf_a", "pdf_ua"], default="headings")
    s.add_argument("--level", choices=["1a", "1b", "2b"], default="1b")
    sub.add_parser("form").add_argument("path")
    s = sub.add_parser("render", help="pages as PNG files; {stem} and {page} in output")
    s.add_argument("path")
    s.add_argument("output")
    s.add_argument("--dpi", type=float, default=150.0)
    s.add_argument("--pages")
    sub.add_parser("verify", help="the signatures of files").add_argument("path")
    sub.add_parser("toc").add_argument("path")
    for name, (help_, options) in EDITS.items():
        s = sub.add_parser(name, help=help_)
        s.add_argument("path")
        s.add_argument("output", help="a file; {stem} in it stands for the name of the file read")
        for flags, kw in options:
            s.add_argument(*flags, **kw)
    sub.add_parser("run", help="a pipeline from a YAML or JSON file").add_argument("path")
    return p


def show(df: DataFrame, as_json: bool) -> int:
    n = 0
    for r in df.toLocalIterator():
        n += 1
        d = {k: f"{len(v)} bytes" if isinstance(v, (bytes, bytearray)) else v for k, v in r.asDict(recursive=True).items()}
        print(json.dumps(d, ensure_ascii=False, default=str) if as_json else "\t".join("" if v is None else str(v) for k, v in d.items() if k != "doc_id"))
    return n


def _lines(docs: reader.Documents) -> DataFrame:
    return docs.texts.select("doc_id", F.lit(1).alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("line_idx", "text"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    spark = spark or SparkSession.builder.master(os.environ.get("QUIRE_MASTER", "local[*]")).config("spark.ui.enabled", "false").getOrCreate()
    if a.command == "run":
        try:
            with open(a.path) as f:
                p = pipeline.Pipeline.parse(f.read())
        except (OSError, pipeline.PipelineError) as e:
            print(e, file=sys.stderr)
            return 1
        done = pipeline.run(spark, p).persist()
        pipeline.write(done)
        show(done.select("path", "status", "error"), a.json)
        return 2 if done.filter("status = 'failed'").count() else 0
    for path in [a.a, a.b] if a.command == "diff" else [a.path]:
        if not any(c in path for c in "*?[:") and not os.path.exists(path):
            print(f"there is no {path}", file=sys.stderr)
            return 1
    if a.command in EDITS:
        try:
            return edit(spark, a)
        except (ValueError, OSError) as e:
            print(e, file=sys.stderr)
            return 1
    docs = reader.open_files(spark, a.a if a.command == "diff" else a.path)
    docs = docs.stored()
    for e in docs.errors.collect():
        print(f"{e.doc_id}: {e.message}", file=sys.stderr)
        if a.command != "info":
            return 2
    if a.command in TABLES:
        show(getattr(docs, TABLES[a.command]), a.json)
    elif a.command == "markdown":
        show(docs.markdown(), a.json)
    elif a.command == "search":
        found = search.hits(_lines(docs), a.query, a.regex, not a.ignore_case)
        return 0 if show(search.first_hits(found, ["doc_id"], ["line_idx"], a.max_results).select("doc_id", (F.col("line_idx") + 1).alias("line"), "text"), a.json) else 1
    elif a.command == "convert":
        ext = a.target.rpartition(".")[2]
        many = docs.files.count() > 1
        if many and "." in a.target and "{" not in a.target:
            print("several files need {stem} in the target", file=sys.stderr)
            return 1
        for r in convert.convert(docs.parsed, ext).toLocalIterator():
            storage.put(pipeline.fill_names(os.path.abspath(a.target), r.doc_id) if "." in a.target else f"{os.path.splitext(r.doc_id.removeprefix('file:'))[0]}.{ext}", r.content)
    elif a.command == "diff":
        one = lambda d: _lines(d).withColumn("doc_id", F.lit(0))
        show(compare.diff_lines(one(docs), one(reader.open_files(spark, a.b))).drop("page"), a.json)
    elif a.command == "form":
        show(forms.qualified(docs.part("fields")).join(docs.part("fields").select("doc_id", "id", "value"), ["doc_id", "id"]), a.json)
    elif a.command == "toc":
        show(mutate.toc(docs.blocks.withColumn("o", F.col("page") * 1_000_000 + F.col("block_idx")), ["doc_id"], "o"), a.json)
    elif a.command == "render":
        files = spark.read.format("binaryFile").load(a.path).select("path", "content")
        to = os.path.abspath(a.output)
        put = F.pandas_udf(lambda paths, pages, pngs: pd.Series([storage.put(pipeline.fill_names(to, p).replace("{page}", str(n)), bytes(x)) or 1 for p, n, x in zip(paths, pages, pngs)]), "int").asNondeterministic()
        print(render.rendered(files, a.dpi, _pages(spark, a.pages) if a.pages else None, "path").select(put("path", "page", "png").alias("n")).agg(F.sum("n")).first()[0], "pages")
    elif a.command == "verify":
        files = spark.read.format("binaryFile").load(a.path).select(F.col("path").alias("doc_id"), "content")
        return 0 if show(security.certificate_status(pdfsets.signatures(files).drop("self_signed")), a.json) else 1
    elif a.command == "validate" and a.standard != "headings":
        files = spark.read.format("binaryFile").load(a.path).select(F.col("path").alias("doc_id"), "content")
        show(pdfsets.issues(files, a.standard, a.level), a.json)
    elif a.command == "validate":
        heads = docs.bookmarks.select("doc_id", F.col("ord"), "level")
        show(validate.heading_skips(heads), a.json)
    return 0


if __name__ == "__main__":
    sys.exit(main())
