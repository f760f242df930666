"""Line dedup: lines that too many different documents share are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh

#: A line goes when more than this many different documents have it.
MAX_DOCS = 20


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[ \t\r\f]+", " ")))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normalised(line))


def _key(docs: DataFrame, text: str, doc_id: str, count: str) -> Column:
    """What counts as one document: rows of the same id and text, or of the same text whatever their id.

    A null text has no lines; its key only spreads such rows over the tasks of the join.
    """
    if count not in ("documents", "texts"):
        raise ValueError(f"can't count {count}")
    if count == "documents":
        return F.xxhash64(doc_id, text)
    return F.when(F.col(text).isNotNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id) if doc_id in docs.columns else F.lit(0).cast("bigint"))


def hot_lines(docs: DataFrame, text: str = "text", max_docs: int = MAX_DOCS, doc_id: str = "doc_id", count: str = "documents") -> DataFrame:
    """(k, drop): for each document that has lines over the threshold, their hashes.

    k is the document's 64-bit key. Only 16 bytes a line are shuffled. The (document, line) pairs
    are made distinct first, so the count for a hot line is already combined on the map side.
    """
    pairs = (
        docs.filter(F.col(text).isNotNull())
        .select(_key(docs, text, doc_id, count).alias("k"), F.explode(F.split(text, "\n", -1)).alias("line"))
        .select("k", normalised(F.col("line")).alias("line"))
        .filter("line <> ''")
        .select("k", F.xxhash64("line").alias("h"))
        .distinct()
    )
    hot = pairs.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > max_docs).select("h")
    return pairs.join(hot, "h").groupBy("k").agg(F.collect_set("h").alias("drop"))


def line_dedup(docs: DataFrame, text: str = "text", max_docs: int = MAX_DOCS, dropped: str | None = None, doc_id: str = "doc_id", count: str = "documents") -> DataFrame:
    """docs with each text freed of the lines that more than max_docs different documents have.

    Lines end at a line feed. They are compared in lower case, trimmed, with runs of blanks as
    one. The remaining lines keep their wording and their order. dropped names a column for the
    number of lines dropped, if wanted.

    * Rows alike in id (null included) and text are one document. With count="texts", documents of the
      same text are one too, whatever their ids: then a document isn't emptied for being copied, which
      is for where copies are sorted out afterwards.
    * A line that a document repeats counts once for that document; all its places are dropped.
    * Blank lines never count and always stay.
    * A null text stays null (0 lines dropped); an empty one stays empty. A text that loses every
      line becomes the empty text; its row stays.
    * Repeated rows, null ids and all other columns are passed on as they are.
    * An empty table gives an empty table.
    """
    k, drop, kept = fresh(docs, "_k", "_drop", "_kept")
    gone = hot_lines(docs, text, max_docs, doc_id, count).select(F.col("k").alias(k), F.col("drop").alias(drop))
    joined = docs.withColumn(k, _key(docs, text, doc_id, count)).join(gone, k, "left")
    stays = F.filter(F.split(text, "\n", -1), lambda x: (normalised(x) == "") | ~F.array_contains(F.col(drop), line_hash(x)))
    joined = joined.withColumn(kept, F.when(F.col(drop).isNotNull() & F.col(text).isNotNull(), stays))
    if dropped:
        joined = joined.withColumn(
            dropped, F.when(F.col(kept).isNull(), 0).otherwise(F.size(F.split(text, "\n", -1)) - F.size(kept)).cast("bigint")
        )
    joined = joined.withColumn(text, F.when(F.col(kept).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
    return joined.select(*docs.columns, *([dropped] if dropped else []))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs, dropped="n_dropped")


SQL = rf"""
WITH docs AS (
  SELECT doc_id, text, row_number() OVER () AS k FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
), lines AS (
  SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs
), norm AS (
  SELECT k, pos, line, lower(trim(regexp_replace(line, '[ \t\r\f]+', ' ', 'g'))) AS n FROM lines
), hot AS (
  SELECT n FROM norm WHERE n <> '' GROUP BY n HAVING count(DISTINCT k) > {MAX_DOCS}
), cleaned AS (
  SELECT k, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE n NOT IN (SELECT n FROM hot)), '') AS text,
         count(*) FILTER (WHERE n IN (SELECT n FROM hot)) AS n_dropped
  FROM norm GROUP BY k
)
SELECT d.doc_id, c.text, coalesce(c.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN docs x ON d.text = x.text AND d.doc_id IS NOT DISTINCT FROM x.doc_id LEFT JOIN cleaned c ON c.k = x.k
"""
