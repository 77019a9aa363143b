"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only in local mode may a session name none: then a temporary one is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif re.match(r"local(\[|$)", sc.master):
            base = "file://" + tempfile.mkdtemp(prefix="helixmap-")
            sc.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and cuts its lineage through the shared checkpoint folder.

    The shuffle files of the run that wrote the checkpoint are of no more use; they are removed at its end.
    """
    spark = df.sparkSession
    shared_root(spark)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan takes the setting when it is made
    finally:
        spark.conf.set(name, before)


def whole_text(name: str = "text") -> Column:
    """The text of a row; a null text counts as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of ``df`` bears (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def inline(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small bounded table, carried by the plan as one JSON literal."""
    import json

    text = json.dumps(rows, separators=(",", ":"))
    return (
        spark.range(1)
        .select(F.explode(F.from_json(F.lit(text), f"array<struct<{schema}>>")).alias("r"))
        .select("r.*")
    )


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system, as workers live on between stages."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


#: Rows of an Arrow batch at most: ten thousand texts, Spark's own bound, are too many for a small worker and its JVM.
BATCH_ROWS = 1_000


def tidy(run: Callable) -> Callable:
    """``run``, a function of one partition's batches, of one table or of two, with ``release`` at its end.

    From here on batches of the session have at most ``BATCH_ROWS`` rows, unless it asks for fewer.
    """
    spark = SparkSession.getActiveSession()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and not 0 < int(spark.conf.get(name, "0")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def over_batches(batches):
            try:
                yield from run(batches)
            finally:
                release()

        return over_batches
    if len(inspect.signature(run).parameters) == 2:

        @functools.wraps(run)
        def over_tables(left, right):
            try:
                return run(left, right)
            finally:
                release()

        return over_tables

    @functools.wraps(run)
    def over_table(table):
        try:
            return run(table)
        finally:
            release()

    return over_table
