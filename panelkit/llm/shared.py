"""Small helpers that several operators share."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's checkpoint folder, or a temporary one where none is set (local tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="panelkit-checkpoint-"))


#: Rows of a small table that one file of it holds, where how many it has is known.
FILE_ROWS = 50_000


def pinned(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared checkpoint folder: later reads don't recompute it, and survive lost executors.

    ``rows``, a bound of the rows, spares a small table hundreds of files.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(max(2, -(-rows // FILE_ROWS)))).checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete what nothing refers to any more, as shuffle files whose result is pinned; else they stay until the driver happens to collect its garbage."""
    # What one round finds unreachable, and the cleaner then takes apart, holds more that the next one finds.
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def boxed(docs: DataFrame, *kept: str) -> DataFrame:
    """``docs`` with numbered columns, but for the kept ones, so that no name of its own gets in the way."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in kept else f"_c{i}") for i, c in enumerate(docs.columns)))


def unboxed(rows: DataFrame, names: list[str], *kept: str, **changed: F.Column) -> DataFrame:
    """The columns of boxed rows under their names again, some of them changed; changed ones of other names come last."""
    own = [changed.pop(n, F.col(n if n in kept else f"_c{i}")).alias(n) for i, n in enumerate(names)]
    return rows.select(*own, *(column.alias(n) for n, column in changed.items()))


#: Rows of an Arrow batch for texts: a batch is counted in rows, and documents are long.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, read for operators that hand whole texts to Arrow: batches are kept short."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_hex(column) -> F.Column:
    return F.lower(F.sha2(column, 256))
