"""What the corpus operators share: the shared folder, free column names, token counts."""

from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.storage import cut, new_folder, shared_dir

__all__ = ["cut", "fresh", "n_tokens", "new_folder", "shared", "shared_dir"]


def shared(spark: SparkSession, value) -> Callable[[], object]:
    """A function that gives value on any executor. It travels as bytes that hold the code of this
    package's classes too. For what is small, or grows far slower than the data."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    held: list = []

    def get():
        if not held:
            held.append(pickle.loads(sent.value))
        return held[0]

    return get


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of names that df doesn't have yet, in either case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: What separates tokens; the same in Java, RE2 and Python.
SPACE = r" \t\n\r\f"


def n_tokens(text: Column) -> Column:
    """Tokens between white space, as bigint; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")
