"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage, scratch_path
from ..session import prepare as _prepare

__all__ = ["prepare", "scratch_path", "cut_lineage", "read_docs", "release", "parallelism", "components", "star_forest",
           "running_sums", "word_bounds", "SPACE"]

#: Lookup by byte: true for 0x20 and 0x09-0x0D, the white space of every contract here.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: Rows of an Arrow batch: texts are long, and a Python worker holds a batch as objects.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> SparkSession:
    """What a job of this subpackage needs from the session: the library's own needs, and
    Arrow batches of no more than ``BATCH_ROWS`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return _prepare(spark)


def release() -> None:
    """Give freed memory back to the system at the end of a task: Python workers live on
    between tasks, and what their allocators keep adds up over the stages of a job."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def read_docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Partitions for explicit repartitions: the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of bytes that are not white space."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = ~SPACE[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate(([0], edge))
    if word[-1]:
        edge = np.concatenate((edge, [len(data)]))
    return edge[0::2], edge[1::2]


def star_forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Component label (smallest index) of each of ``n`` nodes under the edges (u, v):
    min-label hooking with pointer jumping, in whole-array steps."""
    label = np.arange(n)
    while len(u):
        lu, lv = label[u], label[v]
        open_ = lu != lv
        if not open_.any():
            break
        u, v, lu, lv = u[open_], v[open_], lu[open_], lv[open_]
        np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table of longs -> (node, component), where the
    component is the smallest node reachable. Nodes without an edge are not returned;
    null ends and loops are ignored.

    Alternating large-star and small-star rounds: each is an aggregate (combined before
    the shuffle) and a join that adaptive execution may split where one node is in very
    many edges. Each round is written to the shared checkpoint folder.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u > v")
    e = cut_lineage(e.distinct())

    def state(df: DataFrame):
        # The sum wraps on purpose: a bitwise aggregate gives the same check without overflow.
        row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        return row["n"], row["x"]

    now = state(e)
    while now[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = cut_lineage(large.distinct())
        low = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        e = cut_lineage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        was, now = now, state(e)
        if was == now:
            break
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def running_sums(df: DataFrame, group: list[str], unit: str, order: list[str], value: str, out: str,
                 per_bucket: int = 512) -> DataFrame:
    """Exclusive running sum of ``value`` (long) within ``group`` in the order (``unit``,
    ``order``), with no task that holds a whole group.

    ``unit`` is a double in [0, 1] that rises with the order (a keyed random number, or a
    hash). It is cut into n x n nested ranges, where n follows the group's row count, so
    that a range holds about ``per_bucket`` rows. Sums of ranges are small aggregates;
    only rows of one fine range meet in a window. ``df`` is read twice.
    """
    counts = df.groupBy(*group).agg(F.ceil(F.sqrt(F.count("*") / F.lit(per_bucket))).cast("long").alias("_n"))
    on = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    x = df.alias("l").join(counts.alias("r"), cond, "left").select("l.*", "r._n")
    fine = F.least(F.floor(F.col(unit) * F.col("_n") * F.col("_n")), F.col("_n") * F.col("_n") - 1).cast("long")
    x = x.withColumn("_f", fine).withColumn("_c", F.floor(F.col("_f") / F.col("_n")).cast("long"))
    sums = x.groupBy(*group, "_c", "_f").agg(F.sum(value).alias("_s"))
    coarse = sums.groupBy(*group, "_c").agg(F.sum("_s").alias("_cs"))
    wc = W.partitionBy(*group).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    coarse = coarse.select(*group, "_c", F.coalesce(F.sum("_cs").over(wc), F.lit(0)).alias("_c0"))
    wf = W.partitionBy(*group, "_c").orderBy("_f").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*group, "_c", "_f", F.coalesce(F.sum("_s").over(wf), F.lit(0)).alias("_f0"))

    def same(cols):
        c = F.lit(True)
        for g in cols:
            c = c & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
        return c

    starts = sums.alias("l").join(coarse.alias("r"), same([*group, "_c"])).select("l.*", "r._c0")
    wr = W.partitionBy(*group, "_c", "_f").orderBy(unit, *order).rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("_r0", F.coalesce(F.sum(value).over(wr), F.lit(0)))
    x = x.alias("l").join(starts.alias("r"), same([*group, "_c", "_f"])).select(
        "l.*", (F.col("r._c0") + F.col("r._f0") + F.col("l._r0")).cast("long").alias(out))
    return x.drop("_n", "_c", "_f", "_r0")


def keyed_unit(seed: int, purpose: str, *keys: Column) -> Column:
    """A uniform double in [0, 1) from the first 52 bits of md5 over seed, purpose and
    keys (a null key counts as the text ``\\N``)."""
    parts = [F.lit(str(seed)), F.lit(purpose)] + [F.coalesce(k.cast("string"), F.lit("\\N")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def sql_keyed_unit(seed: int, purpose: str, *keys: str) -> str:
    parts = [f"'{seed}'", f"'{purpose}'"] + [f"coalesce(CAST({k} AS VARCHAR), '\\N')" for k in keys]
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13)) AS BIGINT) / 4503599627370496.0)"
