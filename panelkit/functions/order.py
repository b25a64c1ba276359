"""Exact order statistics of a column whose values fit no single task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """``df`` in the session's checkpoint folder, or a temporary one where none is set (local tests)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="panelkit-checkpoint-"))
    return df.checkpoint(eager=True)


def percentiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """The percentiles of a column at some shares, between neighbours by linear interpolation; none where it has no value.

    Equal values are counted map-side, distinct ones dealt out by range. Only the counts of the ranges, and the few values
    at the places asked for, come to the driver.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranged = written(counted.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    sizes = sorted((r.part, r.n) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in sizes)
    if not total:
        return []
    spots = [s * (total - 1) for s in shares]
    places = sorted({int(x) for x in spots} | {min(total - 1, int(x) + 1) for x in spots})
    before, wanted = 0, []
    for part, n in sizes:
        wanted += [(part, p - before, p) for p in places if before <= p < before + n]
        before += n
    rows = ranged.where(F.col("part").isin(sorted({w[0] for w in wanted})))
    rows = rows.withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy("v")))
    hit = F.lit(False)
    for part, at, _ in wanted:
        hit |= (F.col("part") == part) & (F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)
    found = rows.where(hit).collect()
    value = {p: next(r.v for r in found if r.part == part and r.upto - r.n <= at < r.upto) for part, at, p in wanted}
    out = []
    for x in spots:
        low, high = int(x), min(total - 1, int(x) + 1)
        out.append(value[low] if value[low] == value[high] else (int(x) + 1 - x) * value[low] + (x - int(x)) * value[high])
    return out
