"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, fresh, n_tokens

SEED = "mix-1"
#: Target weights of the production mix; any other source, and a null one, has DEFAULT_WEIGHT.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0}
DEFAULT_WEIGHT = 1.0
#: The total budget, as a share of the tokens there are.
BUDGET_SHARE = 0.5
#: Rows in a range that one task adds up, on average; there are as many ranges as that takes.
RANGE = 100_000


def weight_of(source: Column, weights: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for name, w in weights.items():
        out = F.when(source == name, F.lit(float(w))).otherwise(out)
    return out


def _prefix(df: DataFrame, by: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """df with out = the sum of value over the rows up to this one, in (bucket, order), per by.

    bucket is monotone in order. Sums of buckets are added up first, a small table; then each
    bucket is added up on its own, so no task holds a whole source.
    """
    sums = df.groupBy(*by, bucket).agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, bucket, F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_run", F.sum(value).over(inner))
        .join(sums, [*by, bucket])
        .withColumn(out, F.col("_before") + F.col("_run"))
        .drop("_run", "_before")
    )


def fair_queue(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    default: float = DEFAULT_WEIGHT,
    budget_share: float = BUDGET_SHARE,
    budget: int | None = None,
    seed: str = SEED,
    ranges: int | None = None,
) -> DataFrame:
    """(doc_id, source, th, n_tokens, finish, total) for the documents that the mix takes.

    See mix() for the cases. ranges, which prefix sums are split into, follow from the number of rows
    and change no result. total counts the tokens taken up to and with this document.
    """
    weights = WEIGHTS if weights is None else weights
    narrow = docs.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("th"), n_tokens(F.col("text")).alias("n_tokens"))
    queue = (
        narrow.groupBy("doc_id", "source", "th")
        .agg(F.sum("n_tokens").alias("n_tokens"))
        .withColumn("src", F.coalesce("source", F.lit("")))
        .withColumn("null_src", F.col("source").isNull())
        .withColumn("key", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("th"))))
    )
    queue = cut(queue)  # all that needs the texts
    ranges = max(1, -(-queue.count() // RANGE)) if ranges is None else ranges
    queue = queue.withColumn("b", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * ranges / F.lit(float(1 << 32))).cast("int"))
    queue = _prefix(queue, ["src", "null_src"], "b", ["key"], "n_tokens", "cum")
    queue = cut(queue.withColumn("finish", F.col("cum") / weight_of(F.col("source"), weights, default)).drop("b", "cum"))
    top, tokens = queue.agg(F.max("finish"), F.sum("n_tokens")).first()
    budget = int((tokens or 0) * budget_share) if budget is None else budget
    width = (top or 1.0) / ranges or 1.0
    queue = queue.withColumn("_all", F.lit(0)).withColumn("b", F.floor(F.col("finish") / width).cast("int"))
    queue = _prefix(queue, ["_all"], "b", ["finish", "key", "src", "null_src"], "n_tokens", "total")
    return queue.filter(F.col("total") <= budget).select("doc_id", "source", "th", "n_tokens", "finish", "total")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The documents that a mix to target weights takes, within the total budget of tokens.

    Documents of a source are shuffled by a hash of seed, id and text; a document's virtual finish
    time is its source's tokens up to and with it, over the source's weight. In order of finish
    time over all sources, documents are taken as long as the budget holds.

    * Tokens are what white space separates; a null or empty text has none and costs nothing.
    * A null source is a source of its own, with the default weight.
    * Rows alike in doc_id (null included), source and text are one entry of the queue, with the
      sum of their tokens; they are taken or left together, whatever their other columns hold.
    * Equal finish times are ordered by the shuffle hash, then the source.
    * An empty table gives an empty table. All columns are passed on.
    """
    doc, src, th = fresh(docs, "_doc", "_src", "_th")
    taken = fair_queue(docs, **how)
    key = lambda d, s, t: F.xxhash64(F.coalesce(d.cast("string"), F.lit("\0")), F.coalesce(s, F.lit("\0")), t)
    taken = taken.select(key(F.col("doc_id"), F.col("source"), F.col("th")).alias(doc))
    with_key = docs.withColumn(doc, key(F.col("doc_id"), F.col("source"), F.md5(F.coalesce("text", F.lit("")))))
    return with_key.join(taken, doc, "left_semi").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return fair_queue(docs).select("doc_id", "source", "n_tokens", F.round("finish", 6).alias("finish"), "total")


_CASES = " ".join(f"WHEN source = '{s}' THEN {w:.1f}::DOUBLE" for s, w in WEIGHTS.items())
SQL = rf"""
WITH n AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS th,
         len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+')) AS tok
  FROM documents
), q AS (
  SELECT doc_id, source, th, sum(tok)::BIGINT AS n_tokens, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || th) AS key
  FROM n GROUP BY doc_id, source, th
), f AS (
  SELECT *, (sum(n_tokens) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING))::BIGINT::DOUBLE
            / (CASE {_CASES} ELSE {DEFAULT_WEIGHT:.1f}::DOUBLE END) AS finish
  FROM q
), t AS (
  SELECT *, (sum(n_tokens) OVER (ORDER BY finish, key, coalesce(source, ''), source IS NULL ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM f
)
SELECT doc_id, source, n_tokens, round(finish, 6) AS finish, total FROM t
WHERE total <= (SELECT floor(sum(n_tokens) * {BUDGET_SHARE})::BIGINT FROM q)
"""
