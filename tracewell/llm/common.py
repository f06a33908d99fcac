"""Helpers shared by the training-data operators: shared storage, bounded broadcasts, Arrow passes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of a table that may be broadcast; larger ones are joined by a shuffle
BROADCAST_ROWS = 20_000
#: most bits of a filter that is broadcast: 16 MB
BITMAP = 27
#: Spark removes the shuffle files of a query when it ends
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: rows that a pass works on at once
BATCH_ROWS = 2_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent (tests on one machine) is a temporary folder set as its value.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = getattr(spark.sparkContext, "_tracewell_dir", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="tracewell-")
            spark.sparkContext._tracewell_dir = base
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again: cuts lineage and survives lost executors. What the write
    has shuffled is removed when it ends, not when the driver next collects garbage.

    ``batch_rows``: rows of the Arrow batches of this write, where rows are wide; the session's settings come back.
    """
    path, conf, settings = shared_dir(df.sparkSession, name), df.sparkSession.conf, {_CLEANUP: "true"}
    if batch_rows:
        settings["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch_rows)
    held = {s: conf.get(s) for s in settings}
    try:
        for s, value in settings.items():
            conf.set(s, value)
        df.write.parquet(path)
    finally:
        for s, value in held.items():
            conf.set(s, value)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._written_at = path
    return written


def release(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` has written and that nothing reads any more; other tables are left alone."""
    for df in tables:
        path = df.__dict__.pop("_written_at", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def join_small(left: DataFrame, small: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table that is usually tiny: broadcast only when it has at most ``limit`` rows, else let AQE plan it."""
    return left.join(F.broadcast(small) if small.limit(limit + 1).count() <= limit else small, on, how)


def arrow_pass(df: DataFrame, fn, schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` over batches of at most ``rows`` rows; ``fn(batches)`` yields RecordBatches.

    Spark itself ends a batch at ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB), so very long texts stay bounded.
    """

    def run(batches):
        return fn(batch.slice(k, rows) for batch in batches for k in range(0, len(batch), rows))

    return df.mapInArrow(run, schema)


def bitmap(values: DataFrame) -> np.ndarray:
    """Bits of the low part of each value (long) of the one column, as words: about 32 bits a value, at most 2**BITMAP.

    A filter that lets all of ``values`` pass and, up to a hundred million values, few others.
    """
    (name,) = values.columns
    bits, n = 16, values.count()
    while bits < BITMAP and 1 << bits < 32 * n:
        bits += 1
    low = F.col(name).bitwiseAND(F.lit((1 << bits) - 1))
    words = values.groupBy(F.shiftrightunsigned(low, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{name}` & 63 as int))")).alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["at"].to_numpy()] = words["word"].to_numpy()
    return out


def has(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values & np.int64(len(words) * 64 - 1)
    return (words[low >> 6] >> (low & 63)) & 1 > 0


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null text as empty; columns of other names are left out, so none can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
