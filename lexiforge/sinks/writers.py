"""Sinks (B1-B7). Every writer takes a DataFrame and a target folder; when no folder
is given a fresh one under the shared checkpoint folder is used. Writes are
overwrite-mode and task-parallel; ordered text outputs are range-partitioned on
their order key, so part files concatenate in order without one writing task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def _path(spark: SparkSession, name: str, path: str | None) -> str:
    return path or scratch_path(spark, name)


def write_pretraining(df: DataFrame, spark: SparkSession, name: str = "pretraining", path: str | None = None,
                      int64: bool = True) -> str:
    """B1: records round-robin over shards (``shard`` = instance index mod n), one
    folder per shard. Integer arrays are stored as int64 like the reference's records."""
    p = _path(spark, name, path)
    # range-partitioned on the instance order: every task writes a contiguous slice of
    # every shard (one shard is never funnelled through one task), and part files read
    # in name order keep the instance order inside each shard folder; made int64 after the shuffle
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(parts, "inst_index").sortWithinPartitions("inst_index")
    if int64:
        for c in ["input_ids", "input_mask", "segment_ids", "masked_lm_positions", "masked_lm_ids",
                  "next_sentence_labels"]:
            if c in out.columns:
                out = out.withColumn(c, F.col(c).cast("array<bigint>"))
    out.write.mode("overwrite").partitionBy("shard").parquet(p)
    return p


def write_features(df: DataFrame, spark: SparkSession, name: str = "features", path: str | None = None) -> str:
    """B2: classifier records (int64 on disk)."""
    p = _path(spark, name, path)
    out = df
    for c in ["input_ids", "input_mask", "segment_ids"]:
        if c in out.columns:
            out = out.withColumn(c, F.col(c).cast("array<bigint>"))
    for c in ["label_ids", "is_real_example"]:
        if c in out.columns:
            out = out.withColumn(c, F.col(c).cast("bigint"))
    out.write.mode("overwrite").parquet(p)
    return p


def write_token_vectors(df: DataFrame, spark: SparkSession, name: str = "vectors", path: str | None = None) -> str:
    """One JSON object per line: linex_index, features[token, layers[index, values]]. The files are
    compressed: the numbers take up to 80 KB a line."""
    p = _path(spark, name, path)
    df.write.mode("overwrite").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").json(p)
    return p


def write_tsv(df: DataFrame, spark: SparkSession, name: str = "labelled", path: str | None = None) -> str:
    """Tab-separated with a header, minimal quoting (a field holding a quote,
    tab or newline is quoted, inner quotes doubled), no index column."""
    p = _path(spark, name, path)
    (df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", '"')
     .option("escape", '"').option("escapeQuotes", True).csv(p))
    return p


def write_predictions(df: DataFrame, spark: SparkSession, name: str = "predictions", path: str | None = None,
                      expected_rows: int | None = None) -> str:
    """Probabilities as headerless TSV, real rows only, in row order; the count is checked."""
    p = _path(spark, name, path)
    real = df.filter(F.col("is_real_example")) if "is_real_example" in df.columns else df
    if expected_rows is not None:
        n = real.count()
        if n != expected_rows:
            raise AssertionError(f"{n} prediction rows, expected {expected_rows}")
    line = F.array_join(F.transform("probabilities", lambda x: x.cast("string")), "\t")
    real.repartitionByRange("row_id").sortWithinPartitions("row_id").select(line.alias("value")).write.mode(
        "overwrite").text(p)
    return p


def write_metrics(df: DataFrame, spark: SparkSession, name: str = "metrics", path: str | None = None) -> str:
    """``name = value`` lines sorted by name (a handful of rows: one file)."""
    p = _path(spark, name, path)
    df.orderBy("name").select(F.format_string("%s = %s", F.col("name"), F.col("value").cast("string")).alias(
        "value")).coalesce(1).write.mode("overwrite").text(p)
    return p


def concat_by_dir(df: DataFrame, spark: SparkSession, name: str = "concat", path: str | None = None) -> str:
    """Cleaned lines concatenated per directory; overwrite, so a rerun does not
    double the text."""
    p = _path(spark, name, path)
    (df.repartitionByRange("dir", "part", "file", "line_no").sortWithinPartitions("dir", "part", "file", "line_no")
     .select("dir", F.col("line").alias("value")).write.mode("overwrite").partitionBy("dir").text(p))
    return p
