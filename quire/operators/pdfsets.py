"""Page sets and edits of PDF files that lie in a column; files come out."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources import pdfedit, pdffacts, sign

ISSUES = "array<struct<severity:string,rule:string,message:string,page:int>>"


def edited(files: DataFrame, edit: Callable[..., bytes], content: str = "content", **options) -> DataFrame:
    """files with content after an edit of pdfedit, and error where it failed (content is then null).

    options are passed on; a value that is a Column is another one for each file (structs come as dicts).
    """
    from pyspark.sql import Column

    each = {k: v for k, v in options.items() if isinstance(v, Column)}
    same = {k: v for k, v in options.items() if k not in each}
    names = list(each)

    def run(found: pd.Series, *values: pd.Series) -> pd.DataFrame:
        rows = []
        values = [v.to_dict("records") if isinstance(v, pd.DataFrame) else v.tolist() for v in values]
        for i, c in enumerate(found):
            try:
                if c is None:
                    raise ValueError("there is no content")
                given = {n: v[i].tolist() if hasattr(v[i], "tolist") else v[i] for n, v in zip(names, values)}
                made = edit(bytes(c), **same, **given)
                rows.append((made[0] if isinstance(made, tuple) else made, None))
            except Exception as e:  # a bad file is a row with an error
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["content", "error"])

    udf = F.pandas_udf(run, "content binary, error string").asNondeterministic()
    out = files.withColumn("_e", udf(content, *each.values()))
    return out.withColumn(content, F.col("_e.content")).withColumn("error", F.col("_e.error")).drop("_e")


def merged(files: DataFrame, into: str, order: str, content: str = "content") -> DataFrame:
    """(into, content): all files of one value of `into` as one, in order. A file that can't be read fails
    its group: error tells. A group is one new file, made by one task."""

    def run(key, pdf_: pd.DataFrame) -> pd.DataFrame:
        try:
            made, error = pdfedit.merge([bytes(c) for c in pdf_.sort_values("_o")["_c"]]), None
        except Exception as e:
            made, error = None, str(e)
        return pd.DataFrame({"_k": [key[0]], "content": [made], "error": [error]})

    kind = files.schema[into].dataType.simpleString()
    out = files.select(F.col(into).alias("_k"), F.col(order).alias("_o"), F.col(content).alias("_c")).groupBy("_k").applyInPandas(run, f"_k {kind}, content binary, error string")
    return out.withColumnRenamed("_k", into)


def split(files: DataFrame, ranges: str, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, part, content): a file for each range of the column ranges, an array of arrays of page numbers."""
    each = files.select(key, content, F.posexplode(ranges).alias("part", "_p"))
    return edited(each, pdfedit.select, content, numbers=F.col("_p")).drop("_p")


def issues(files: DataFrame, standard: str = "pdf_a", level: str = "1b", key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, severity, rule, message, page): what breaks the rules of pdf_a (at a level) or pdf_ua."""
    if standard not in ("pdf_a", "pdf_ua"):
        raise ValueError(f"not a standard: {standard}")
    check = (lambda c: pdffacts.pdf_a(c, level)) if standard == "pdf_a" else pdffacts.pdf_ua

    def run(found: pd.Series) -> pd.Series:
        out = []
        for c in found:
            try:
                rows = check(bytes(c))
            except Exception as e:
                rows = [("error", "unreadable", str(e), None)]
            out.append([dict(zip(("severity", "rule", "message", "page"), r)) for r in rows])
        return pd.Series(out)

    return files.select(key, F.explode(F.pandas_udf(run, ISSUES)(content)).alias("i")).select(key, "i.*")


SIGNATURE = (
    "array<struct<field:string,name:string,reason:string,location:string,date:string,covers_whole_file:boolean,integrity_ok:boolean,has_timestamp:boolean,has_crl:boolean,has_ocsp:boolean,"
    "subject:string,issuer:string,serial:bigint,not_before:double,not_after:double,self_signed:boolean>>"
)


def signatures(files: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, SIGNATURE's fields) of the signatures of files; a file that can't be read has none. security.certificate_status()
    and security.long_term() judge them further."""

    def run(found: pd.Series) -> pd.Series:
        out = []
        for c in found:
            try:
                out.append([{k: v.timestamp() if isinstance(v, datetime) else v for k, v in s.items()} for s in sign.signatures(bytes(c))])
            except Exception:
                out.append([])
        return pd.Series(out)

    found = files.select(key, F.explode(F.pandas_udf(run, SIGNATURE)(content)).alias("s")).select(key, "s.*")
    return found.withColumns({c: F.timestamp_seconds(c) for c in ("not_before", "not_after")})
