"""The same calls for coroutines: each runs in a thread of its own, under a job group that its cancellation cancels."""

from __future__ import annotations

import asyncio
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from quire.sources import reader


async def call(spark: SparkSession, fn: Callable[..., Any], *args, **options) -> Any:
    """fn(*args, **options) in a thread; where the coroutine is cancelled, so are its jobs."""
    loop, done, group = asyncio.get_running_loop(), asyncio.Event(), uuid.uuid4().hex
    out: list = []

    def run() -> None:
        spark.sparkContext.setJobGroup(group, getattr(fn, "__name__", "call"), interruptOnCancel=True)
        try:
            out.append((fn(*args, **options), None))
        except BaseException as e:
            out.append((None, e))
        loop.call_soon_threadsafe(done.set)

    InheritableThread(target=run, session=spark).start()
    try:
        await done.wait()
    except asyncio.CancelledError:
        spark.sparkContext.cancelJobGroup(group)
        raise
    value, error = out[0]
    if error is not None:
        raise error
    return value


async def collect(df: DataFrame) -> list:
    return await call(df.sparkSession, df.collect)


async def open_files(spark: SparkSession, path: str, **options) -> reader.Documents:
    """The files, parsed and stored."""
    return await call(spark, lambda: reader.open_files(spark, path, **options).stored())


async def texts(spark: SparkSession, path: str, **options) -> list:
    return await collect(reader.open_files(spark, path, **options).texts)


async def markdown(spark: SparkSession, path: str, **options) -> list:
    return await collect(reader.open_files(spark, path).markdown(**options))


async def save(df: DataFrame, path: str, format: str = "parquet", mode: str = "error") -> None:
    await call(df.sparkSession, lambda: df.write.format(format).mode(mode).save(path))
