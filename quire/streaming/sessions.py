"""Sessions of users, in batch and as a stream, and a stream of files through the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GAP_SECONDS = 3600


def sessions(events: DataFrame, gap: int = GAP_SECONDS, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(user, session, started, ended, events): a new session begins after more than gap seconds of silence."""
    w = Window.partitionBy(user).orderBy(ts)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    quiet = at - F.lag(at).over(w) > gap * 1_000_000
    numbered = events.withColumn("_n", F.coalesce(quiet, F.lit(False)).cast("int")).withColumn("session", F.sum("_n").over(w).cast("int"))
    return numbered.groupBy(user, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("events"))


def session_stream(events: DataFrame, gap: int = GAP_SECONDS, late: str = "10 minutes", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """The same as a stream: a session is given out once no event can belong to it any more."""
    found = events.withWatermark(ts, late).groupBy(F.session_window(ts, f"{gap} seconds"), user).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("events"))
    return found.drop("session_window")


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files as they arrive in a folder, parsed; see reader.PARSED. Each is read once, in any trigger."""
    from quire.sources.reader import parse_column

    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder)
    return parse_column(files.select(F.col("path").alias("doc_id"), "content")).drop("content")
