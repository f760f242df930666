"""Redaction, sanitising, permissions, encryption of payloads, digests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry
from quire.operators.lines import PAGE

#: What a page may hold that acts: name, pattern, and what takes its place.
HTML_RULES = (
    ("javascript", r"(?is)<script\b[^>]*>.*?</script\s*>", ""),
    ("embedded", r"(?is)<(?:object|embed|iframe)\b[^>]*>", ""),
    ("action", r"""(?i)\son[a-z]+\s*=\s*("[^"]*"|'[^']*')""", ""),
    ("link", r"""(?i)\shref\s*=\s*("\s*javascript:[^"]*"|'\s*javascript:[^']*')""", ""),
)
PERMISSIONS = {"print": 2, "modify": 3, "copy": 4, "annotate": 5, "fill_forms": 8, "accessibility": 9, "assemble": 10, "print_high_quality": 11}


def redact_matches(docs: DataFrame, pattern: str, regex: bool = True, case_sensitive: bool = True, replacement: str = "█", text: str = "text") -> DataFrame:
    """docs with every match in the text replaced, and n_redacted. A literal pattern is quoted."""
    p = pattern if regex else re.escape(pattern)
    p = p if case_sensitive else f"(?i){p}"
    n = F.coalesce(F.regexp_count(F.col(text), F.lit(p)), F.lit(0)).cast("bigint")
    return docs.withColumn("n_redacted", n).withColumn(text, F.regexp_replace(text, p, replacement))


def span_boxes(spans: DataFrame) -> DataFrame:
    """spans with the box that hides them: 0.3 of the size below the baseline, 0.8 above."""
    size = F.col("font_size")
    return spans.withColumns({"x0": F.col("x"), "y0": F.col("y") - size * 0.3, "x1": F.col("x") + F.col("width"), "y1": F.col("y") + size * 0.8})


def redact_regions(spans: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) spans with boxes: a span goes as a whole if it shares area with a region of its page."""
    boxed = regions.select(*PAGE, *[F.col(c).alias(f"r_{c}") for c in geometry.BOX])
    hit = [*[boxed[c] == spans[c] for c in PAGE], geometry.overlaps([spans[c] for c in geometry.BOX], [boxed[f"r_{c}"] for c in geometry.BOX])]
    cond = hit[0]
    for c in hit[1:]:
        cond = cond & c
    return spans.join(boxed, cond, "left_anti"), spans.join(boxed, cond, "left_semi")


def redact_text(spans: DataFrame, pattern: str, regex: bool = False, case_sensitive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): spans that hold the pattern go as a whole, with all that they overlap."""
    p = pattern if regex else re.escape(pattern)
    boxed = span_boxes(spans)
    return redact_regions(boxed, boxed.filter(F.col("text").rlike(p if case_sensitive else f"(?i){p}")))


def sanitize_html(pages: DataFrame, html: str = "html", remove_links: bool = True) -> DataFrame:
    """pages without what acts, and how often each rule removed something, counted in the order of the rules."""
    out = pages
    for name, pattern, new in HTML_RULES:
        if name == "link" and not remove_links:
            continue
        out = out.withColumn(f"n_{name}", F.coalesce(F.regexp_count(F.col(html), F.lit(pattern)), F.lit(0)).cast("bigint")).withColumn(html, F.regexp_replace(html, pattern, new))
    return out


def sanitize_objects(objects: DataFrame, javascript: bool = True, embedded: bool = True, actions: bool = True, links: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept, removed with category) of objects (kind); an object may be counted by several rules."""
    rules = [("javascript", javascript, ["javascript", "js"]), ("embedded_file", embedded, ["filespec", "embeddedfile"]), ("action", actions, ["launch", "submitform", "importdata", "openaction", "javascript"]), ("link", links, ["uri", "gotor"])]
    parts = [objects.filter(F.lower("kind").isin(kinds)).withColumn("category", F.lit(name)) for name, on, kinds in rules if on]
    gone = [k for _, on, kinds in rules if on for k in kinds]
    removed = parts[0] if parts else objects.filter("false").withColumn("category", F.lit(""))
    for p in parts[1:]:
        removed = removed.unionByName(p)
    return objects.filter(~F.lower("kind").isin(gone)), removed


def permission_mask(**allowed: Column) -> Column:
    """The signed 32-bit number of a PDF's permissions."""
    p = F.lit(0xFFFFF000 | 0xC0)
    for name, bit in PERMISSIONS.items():
        p = p + F.when(allowed.get(name, F.lit(True)), 1 << bit).otherwise(0)
    return (p - (1 << 32)).cast("int")


def encrypt_column(docs: DataFrame, column: str, password: str) -> DataFrame:
    """column as AES-256-GCM bytes under a key hashed from the password; nonces are random."""
    return docs.withColumn(column, F.aes_encrypt(F.col(column).cast("binary"), F.unhex(F.sha2(F.lit(password), 256)), F.lit("GCM")))


def decrypt_column(docs: DataFrame, column: str, password: str) -> DataFrame:
    """The bytes again, as text; null where the password is wrong or the bytes were touched."""
    return docs.withColumn(column, F.try_aes_decrypt(F.col(column), F.unhex(F.sha2(F.lit(password), 256)), F.lit("GCM")).cast("string"))


def sign_column(docs: DataFrame, column: str, key: str) -> DataFrame:
    """docs with digest, a keyed SHA-256 of the column; a certificate's signature needs more than is here."""
    return docs.withColumn("digest", keyed_digest(F.col(column), key))


def keyed_digest(content: Column, key: str) -> Column:
    inner = F.sha2(F.concat(F.lit(key + ":"), content), 256)
    return F.sha2(F.concat(F.lit(":" + key), inner), 256)


def verify(docs: DataFrame, column: str, key: str, not_before: str = "not_before", not_after: str = "not_after", at: Column | None = None) -> DataFrame:
    """docs with integrity_ok, certificate_valid (by dates) and message."""
    now = F.current_timestamp() if at is None else at
    same = keyed_digest(F.col(column), key) == F.col("digest")
    dated = now.between(F.col(not_before), F.col(not_after))
    message = F.when(~same, "the signed bytes were changed").when(~dated, "the certificate isn't valid now").otherwise("valid")
    return docs.withColumns({"integrity_ok": same, "certificate_valid": dated, "message": message})


def certificate_status(certs: DataFrame, at: Column | None = None) -> DataFrame:
    """certs (subject, issuer, not_before, not_after) with self_signed and date_valid (at a time, else now)."""
    now = F.current_timestamp() if at is None else at
    return certs.withColumns({"self_signed": F.col("subject") == F.col("issuer"), "date_valid": now.between(F.col("not_before"), F.col("not_after"))})


def long_term(signatures: DataFrame) -> DataFrame:
    """signatures (has_timestamp, has_crl, has_ocsp) with ltv: a timestamp and one kind of revocation data."""
    return signatures.withColumn("ltv", F.col("has_timestamp") & (F.col("has_crl") | F.col("has_ocsp")))


def covers_all(signatures: DataFrame) -> DataFrame:
    """signatures (a, la, b, lb, size) with covers_whole_file: two ranges from 0 to the end with one hole."""
    return signatures.withColumn("covers_whole_file", (F.col("a") == 0) & (F.col("a") + F.col("la") <= F.col("b")) & (F.col("b") + F.col("lb") == F.col("size")))
