"""The folder that driver and executors share, for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in spark.checkpoint.dir; a folder of this machine is set only where that is unset (tests)."""
    context = df.sparkSession.sparkContext
    if context.getConf().get("spark.checkpoint.dir") is None and context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tracewell-"))
    return df.checkpoint()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, or below a folder of this machine where that is unset (tests)."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if base is None:
        held = context._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tracewell-"))
            held = context._jsc.sc().getCheckpointDir()
        base = held.get()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below spark.checkpoint.dir and read again; ``release`` removes it."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing reads any more; others are left alone."""
    for df in tables:
        path = df.__dict__.pop("_written_at", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
