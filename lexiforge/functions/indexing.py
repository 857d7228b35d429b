"""Dense row numbers and running sums without a global window over the data.

A global ``row_number()`` over an unpartitioned window moves every row into one
task. Here rows are first placed in buckets that respect the wanted order (for
seeded shuffles the bucket is the hash prefix, so buckets are uniform in size);
each bucket is numbered by a window partitioned by bucket, and bucket offsets come
from a one-row-per-bucket count table whose size is fixed by the bucket count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HASH_BUCKET_HEX = 4  # 16**4 = 65,536 buckets at most


def dense_index_by_hash(df: DataFrame, hash_col: str, out: str, tie_cols: list[str] | None = None,
                        group_cols: list[str] | None = None, total: str | None = None) -> DataFrame:
    """0-based index of each row in the order (group_cols, hex string ``hash_col``,
    tie_cols). With ``group_cols`` the index restarts at 0 in every group. ``total`` names a
    column for the number of rows (of the group), which the bucket counts give for free."""
    tie_cols = tie_cols or []
    group_cols = group_cols or []
    b = F.substring(F.col(hash_col), 1, HASH_BUCKET_HEX)
    with_b = df.withColumn("_bucket", b)
    bkeys = [*group_cols, "_bucket"]
    counts = with_b.groupBy(*bkeys).agg(F.count(F.lit(1)).alias("_n"))
    w_all = Window.orderBy(*bkeys).rowsBetween(Window.unboundedPreceding, -1)
    if group_cols:
        w_all = Window.partitionBy(*group_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    w_sum = Window.partitionBy(*group_cols)
    extra = [] if total is None else [F.sum("_n").over(w_sum).cast("long").alias(total)]
    offsets = counts.select(*bkeys, F.coalesce(F.sum("_n").over(w_all), F.lit(0)).alias("_off"), *extra)
    w = Window.partitionBy(*bkeys).orderBy(F.col(hash_col), *[F.col(c) for c in tie_cols])
    numbered = with_b.withColumn("_rn", F.row_number().over(w))
    return (
        numbered.join(offsets, bkeys)
        .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("long"))
        .drop("_bucket", "_rn", "_off")
    )


def exclusive_running_sum(df: DataFrame, order_cols: list[str], value_col: str, out: str,
                          partition_cols: list[str] | None = None) -> DataFrame:
    """Sum of ``value_col`` over all earlier rows (by ``order_cols``) of the same
    partition. Intended for small per-file / per-document tables."""
    w = Window.orderBy(*order_cols)
    if partition_cols:
        w = Window.partitionBy(*partition_cols).orderBy(*order_cols)
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value_col).over(w), F.lit(0)).cast("long"))


def ordered_running_sum(df: DataFrame, order_cols: list[str], value_col: str, out: str) -> DataFrame:
    """Exclusive running sum over the whole table in ``order_cols`` order without a
    single-partition window: the table is range-partitioned on the order, written (so the
    partition of each row is fixed), each partition's total comes from a one-row-per-partition
    table, and the running sum inside a partition is a window over that partition only."""
    from ..session import cut_lineage

    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    r = cut_lineage(df.repartitionByRange(parts, *order_cols).withColumn("_pid", F.spark_partition_id()))
    tot = r.groupBy("_pid").agg(F.sum(value_col).alias("_t"))
    w_p = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    poff = tot.select("_pid", F.coalesce(F.sum("_t").over(w_p), F.lit(0)).alias("_poff"))
    inner = exclusive_running_sum(r, order_cols, value_col, "_in", partition_cols=["_pid"])
    return (inner.join(F.broadcast(poff), "_pid")
            .withColumn(out, (F.col("_poff") + F.col("_in")).cast("long")).drop("_pid", "_poff", "_in"))
