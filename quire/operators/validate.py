"""Validation: every rule is a filter that gives issues; a report adds them up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ISSUE = ["doc_id", "severity", "rule", "message", "page"]

#: Rules on one row a document: rule, severity, what must not hold, message.
PDF_A: tuple[tuple[str, str, Callable[[], Column], str], ...] = (
    ("encryption", "error", lambda: F.col("encrypted"), "an archive file must not be encrypted"),
    ("xmp.missing", "error", lambda: F.col("xmp").isNull(), "there is no XMP metadata"),
    ("xmp.no_pdfaid_part", "error", lambda: F.col("xmp").isNotNull() & ~F.col("xmp").contains("pdfaid:part"), "XMP names no part"),
    ("xmp.no_pdfaid_conformance", "warning", lambda: F.col("xmp").isNotNull() & ~F.col("xmp").contains("pdfaid:conformance"), "XMP names no conformance"),
    ("output_intent.missing", "warning", lambda: ~F.col("output_intent"), "there is no output intent"),
    ("transparency.group", "error", lambda: F.col("transparency"), "transparency isn't allowed at this level"),
    ("javascript.action", "error", lambda: F.col("javascript"), "JavaScript isn't allowed"),
)
PDF_UA: tuple[tuple[str, str, Callable[[], Column], str], ...] = (
    ("ua.mark_info.not_marked", "error", lambda: ~F.col("marked"), "the document isn't marked as tagged"),
    ("ua.lang.missing", "error", lambda: F.coalesce(F.trim("lang"), F.lit("")) == "", "no language is named"),
    ("ua.display_doc_title", "warning", lambda: ~F.col("display_title"), "the title isn't displayed"),
    ("ua.struct_tree.missing", "error", lambda: ~F.col("struct_tree"), "there is no structure tree"),
    ("ua.tagged_content", "warning", lambda: ~F.col("tagged_content"), "content isn't tagged"),
)
#: The same for HTML.
HTML: tuple[tuple[str, str, Callable[[], Column], str], ...] = (
    ("lang.missing", "error", lambda: ~F.col("html").rlike("(?i)<html[^>]*\\slang="), "no language is named"),
    ("title.missing", "error", lambda: F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title", 1)) == "", "there is no title"),
    ("heading.missing", "warning", lambda: ~F.col("html").rlike("(?i)<h1[ >]"), "there is no main heading"),
    ("figure.no_alt", "error", lambda: F.regexp_count("html", F.lit("(?i)<img\\b")) > F.regexp_count("html", F.lit("(?i)<img\\b[^>]*\\salt=")), "an image has no text"),
    ("javascript.action", "warning", lambda: F.col("html").rlike("(?i)<script\\b"), "the page runs scripts"),
)


def issues(docs: DataFrame, rules, key: str = "doc_id", skip: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, severity, rule, message, page) for each rule that a document breaks; a flag that is null is false.

    One pass over docs: the rules are an array of what is broken, not a union of scans.
    """
    broken = [F.when(F.coalesce(bad(), F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"), F.lit(m).alias("message"))) for r, s, bad, m in rules if r not in skip]
    found = docs.select(F.col(key).alias("doc_id"), F.explode(F.filter(F.array(*broken), lambda x: x.isNotNull())).alias("i"))
    return found.select("doc_id", "i.*", F.lit(None).cast("int").alias("page"))


def font_issues(fonts: DataFrame) -> DataFrame:
    """Fonts (doc_id, page, name, embedded) that aren't embedded."""
    return fonts.filter(~F.coalesce("embedded", F.lit(False))).select("doc_id", F.lit("error").alias("severity"), F.lit("font.not_embedded").alias("rule"), F.concat(F.lit("not embedded: "), F.col("name")).alias("message"), "page")


def heading_skips(headings: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """A warning for each heading more than one level below the one before."""
    before = F.lag("level").over(Window.partitionBy(key).orderBy(order))
    found = headings.withColumn("_b", before).filter(F.col("level") > F.col("_b") + 1)
    message = F.concat(F.lit("H"), F.col("_b").cast("string"), F.lit(" is followed by H"), F.col("level").cast("string"))
    return found.select(F.col(key).alias("doc_id"), F.lit("warning").alias("severity"), F.lit("heading.skip").alias("rule"), message.alias("message"), F.lit(None).cast("int").alias("page"))


def report(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a document: errors, warnings, and compliant, which is having no error."""
    n = found.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = docs.select(F.col(key).alias("doc_id")).join(n, "doc_id", "left").na.fill(0, ["errors", "warnings"])
    return out.withColumn("compliant", F.col("errors") == 0)


def pdf_a(docs: DataFrame, level: str = "1b") -> DataFrame:
    """The issues of documents under an archive level; transparency is judged at level 1 only."""
    return issues(docs, PDF_A, skip=() if level.startswith("1") else ("transparency.group",))


def fixes(docs: DataFrame, level: str = "1b") -> tuple[DataFrame, DataFrame]:
    """(docs made archivable, actions taken): what a rule objects to is taken off or put in."""
    part, conformance = level[0], level[1:].upper() or "B"
    xmp = F.lit(f'<rdf:Description pdfaid:part="{part}" pdfaid:conformance="{conformance}"/>')
    changes = [
        ("encrypted", F.col("encrypted"), F.lit(False), "removed encryption"),
        ("xmp", F.col("xmp").isNull() | ~F.col("xmp").contains("pdfaid:part"), xmp, "wrote XMP metadata"),
        ("output_intent", ~F.col("output_intent"), F.lit(True), "added an output intent with a color profile"),
        ("javascript", F.col("javascript"), F.lit(False), "removed a JavaScript action"),
    ]
    if part == "1":
        changes.append(("transparency", F.col("transparency"), F.lit(False), "removed a transparency group"))
    log = F.filter(F.array(*[F.when(F.coalesce(need, F.lit(False)), what) for _, need, _, what in changes]), lambda x: x.isNotNull())
    out = docs.withColumns({c: F.when(F.coalesce(need, F.lit(False)), new).otherwise(F.col(c)) for c, need, new, _ in changes})
    actions = docs.select("doc_id", F.explode(log).alias("action"))
    return out, actions.withColumn("category", action_category(F.col("action")))


def action_category(action: Column) -> Column:
    """What an action of fixes() is about, by the first word found."""
    t = F.lower(action)
    kinds = [("metadata", ["xmp", "metadata"]), ("color", ["color", "output intent"]), ("encryption", ["encrypt"]), ("transparency", ["transparency"]), ("actions", ["action", "javascript"])]
    out = F.lit("other")
    for name, words in reversed(kinds):
        hit = F.lit(False)
        for w in words:
            hit |= t.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def struct_tree(elements: DataFrame, edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(elements reached, their headings with level, figures without text) of a structure tree.

    elements (id, s, alt) and edges (src, dst); what roots don't lead to doesn't count, and an
    element that is reached twice counts once.
    """
    from quire.operators.pageset import closure

    reached = elements.join(closure(edges, roots), "id", "left_semi")
    headings = reached.filter(F.col("s").rlike("^H[1-6]$")).withColumn("level", F.substring("s", 2, 1).cast("int"))
    return reached, headings, reached.filter((F.col("s") == "Figure") & F.col("alt").isNull())


def require_format(files: DataFrame, step: str, format: str = "pdf") -> DataFrame:
    """files (format) with error where a step is for another format."""
    message = F.concat(F.lit(f"{step} is for {format.upper()} files, not "), F.col("format"))
    return files.withColumn("error", F.when(F.col("format") != format, message))
