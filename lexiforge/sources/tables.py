"""Table sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import overall_numbers, read_lines


def read_tsv_raw(spark: SparkSession, path: str) -> DataFrame:
    """A3: tab-separated, header resolved by name, no quoting: quote characters
    stay in the text. All columns are strings."""
    return (spark.read.option("sep", "\t").option("header", True).option("quote", "")
            .option("escape", "").option("inferSchema", False).csv(path))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A4: tab-separated with standard quoting (a quoted field may hold tabs, newlines
    and doubled quotes)."""
    return (spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", True).option("inferSchema", False).csv(path))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files under ``path`` with one overall 0-based number in file-name order."""
    return overall_numbers(read_lines(spark, path)).select(F.col("overall").alias("line_no"), "line")


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """A5: ``piece<TAB>score`` per line, id = line index; a repeated piece keeps its
    last id in lookups (see ``vocab.vocab_dict``)."""
    from ..operators.vocab import parse_vocab

    return parse_vocab(numbered_lines(spark, path))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Headerless numeric TSV -> (row_id, probabilities array<double>) in file order."""
    lines = numbered_lines(spark, path)
    return lines.filter(F.col("line") != "").select(
        F.col("line_no").alias("row_id"),
        F.transform(F.split("line", "\t"), lambda x: x.cast("double")).alias("probabilities"),
    )


def read_records(spark: SparkSession, paths, arrays: dict[str, int], scalars: list[str] | None = None,
                 extra: dict[str, str] | None = None) -> DataFrame:
    """Fixed-schema records from a folder, glob or comma list; int64 narrowed to
    int32 and every array checked against its fixed length."""
    if isinstance(paths, str):
        paths = [p for p in paths.split(",") if p]
    fields = [T.StructField(k, T.ArrayType(T.LongType())) for k in arrays]
    fields += [T.StructField(k, T.LongType()) for k in (scalars or [])]
    for k, t in (extra or {}).items():
        fields.append(T.StructField(k, T._parse_datatype_string(t)))
    df = spark.read.schema(T.StructType(fields)).parquet(*paths)
    cols = []
    for k, n in arrays.items():
        c = F.col(k).cast("array<int>")
        cols.append(F.when(F.size(c) == n, c).otherwise(
            F.raise_error(F.lit(f"{k} does not have length {n}")).cast("array<int>")).alias(k))
    cols += [F.col(k).cast("int").alias(k) for k in (scalars or [])]
    cols += [F.col(k) for k in (extra or {})]
    return df.select(*cols)


def read_pretraining(spark: SparkSession, paths, max_seq_length: int = 128, max_predictions: int = 20) -> DataFrame:
    """A8 for pretraining records: fixed lengths checked, int64 narrowed, weights as floats;
    with the instance number and the shard (0 where the folder is not sharded)."""
    arrays = {c: max_seq_length for c in ("input_ids", "input_mask", "segment_ids")}
    arrays |= {c: max_predictions for c in ("masked_lm_positions", "masked_lm_ids")} | {"next_sentence_labels": 1}
    out = read_records(spark, paths, arrays, extra={"masked_lm_weights": "array<float>", "inst_index": "bigint", "shard": "int"})
    w = F.col("masked_lm_weights")
    wrong = F.raise_error(F.lit(f"masked_lm_weights does not have length {max_predictions}")).cast("array<float>")
    return out.withColumns({"masked_lm_weights": F.when(F.size(w) == max_predictions, w).otherwise(wrong),
                            "shard": F.coalesce("shard", F.lit(0))})


TOKEN_VECTOR_SCHEMA = T.StructType([
    T.StructField("linex_index", T.LongType()),
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("token", T.StringType()),
        T.StructField("layers", T.ArrayType(T.StructType([
            T.StructField("index", T.IntegerType()),
            T.StructField("values", T.ArrayType(T.DoubleType())),
        ]))),
    ]))),
])


def read_token_vectors(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of per-token vectors with a fixed nested schema."""
    return spark.read.schema(TOKEN_VECTOR_SCHEMA).json(path)
