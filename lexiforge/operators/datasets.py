"""Labelled datasets, classification features and batching.

Row order is always an explicit column. Shuffles are seeded hash orders numbered
with ``dense_index_by_hash`` (no global window); exact splits compare that index
with sizes computed by one count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.indexing import dense_index_by_hash
from ..functions.text import ws_tokens
from ..session import cut_lineage
from . import sequences
from . import vocab as V

MAX_LABELS = 100_000  # a label list above this is not broadcast


def categories(df: DataFrame, label_col: str = "label") -> DataFrame:
    """G1: sorted distinct labels with their position (label, label_id)."""
    from .vocab import bounded_collect

    labels = df.select(F.col(label_col).alias("label")).distinct()
    rows = sorted(r["label"] for r in bounded_collect(labels, MAX_LABELS))
    spark = df.sparkSession
    return spark.createDataFrame([(lab, i) for i, lab in enumerate(rows)], "label string, label_id int")


#: Column with the number of rows that ``shuffle_rows`` has numbered.
TOTAL = "row_total"


def shuffle_rows(df: DataFrame, seed: int, key_cols: list[str], out: str = "row_index") -> DataFrame:
    """Seeded full shuffle with a new dense row index, and the number of rows in
    ``row_total`` (from the counts that the index needs anyway). The keyed rows are written once, since they are
    counted before they are numbered."""
    keyed = cut_lineage(df.withColumn("_h", rng.sort_key(seed, "rows", *[F.col(c) for c in key_cols])))
    return dense_index_by_hash(keyed, "_h", out, key_cols, total=TOTAL).drop("_h")


def split_226(df: DataFrame, index_col: str = "row_index") -> DataFrame:
    """Exact split by position: test [0, n/5), dev [n/5, 2n/5), train the rest. Rows that
    G3 did not number (no ``row_total``) are counted."""
    if TOTAL not in df.columns:
        df = df.withColumn(TOTAL, F.lit(df.count()).cast("long"))
    i, n = F.col(index_col), F.col(TOTAL)
    fifth, two_fifths = F.floor(n / 5), F.floor(n * 2 / 5)
    return df.withColumn("split", F.when(i < fifth, "test").when(i < two_fifths, "dev").otherwise("train")).withColumn(
        "split_index", F.when(i < fifth, i).when(i < two_fifths, i - fifth).otherwise(i - two_fifths)).drop(TOTAL)


def subsample(df: DataFrame, frac: float, seed: int, key_cols: list[str], out: str = "sample_index") -> DataFrame:
    """Exactly round(frac * n) rows (half to even), chosen by a second seeded order; the rows are written once."""
    keyed = cut_lineage(df.withColumn("_h", rng.sort_key(seed, "sample", *[F.col(c) for c in key_cols])))
    numbered = dense_index_by_hash(keyed, "_h", out, key_cols, total="_total").drop("_h")
    return numbered.filter(F.col(out) < F.rint(F.lit(float(frac)) * F.col("_total"))).drop("_total")


def example_ids(df: DataFrame, set_type: str, index_col: str) -> DataFrame:
    """``{set}-{i}`` with i from 1 in file order (0-based ``index_col``)."""
    return df.withColumn("guid", F.format_string(f"{set_type}-%d", F.col(index_col) + 1))


def encode_label(df: DataFrame, labels: DataFrame, label_col: str = "label") -> DataFrame:
    """Label -> position in the sorted list; a label outside the list is an error."""
    n = labels.count()
    if n > MAX_LABELS:
        raise ValueError(f"{n} labels is above the bound {MAX_LABELS}")
    j = df.join(F.broadcast(labels.select(F.col("label").alias("_lab"), "label_id")),
                F.col(label_col) == F.col("_lab"), "left").drop("_lab")
    return j.withColumn("label_id", F.when(
        F.col("label_id").isNotNull(), F.col("label_id")
    ).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.col(label_col).cast("string")))).cast("int"))


def union_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Train + dev, duplicates kept."""
    return a.unionByName(b)


def pad_to_batch(features: DataFrame, batch: int, seq_len: int, index_col: str = "row_index") -> DataFrame:
    """Dummy rows (zeros, label 0, not real) so the row count is a multiple of ``batch``. The features are written
    once, then counted."""
    cols = [index_col, "input_ids", "input_mask", "segment_ids", "label_ids", "is_real_example"]
    features = cut_lineage(features.select(*cols))
    n = features.count()
    k = (batch - n % batch) % batch
    spark = features.sparkSession
    zeros = F.array_repeat(F.lit(0), seq_len)
    dummy = spark.range(k).select(
        (F.col("id") + F.lit(n)).cast("long").alias(index_col),
        zeros.alias("input_ids"), zeros.alias("input_mask"), zeros.alias("segment_ids"),
        F.lit(0).alias("label_ids"), F.lit(0).alias("is_real_example"),
    )
    return features.unionByName(dummy)


def single_features(df: DataFrame, text_a: str, text_b: str | None, vocab: dict, max_seq_length: int,
                    tokenize=None) -> DataFrame:
    """G10 / G12 body: tokenise (E3, ``ws`` by default), truncate (F9 for a pair,
    F10 for one text), assemble (F11), ids (E4), pad (F12)."""
    tok = tokenize or ws_tokens
    x = df.withColumn("_ta", tok(F.col(text_a)))
    if text_b is not None:
        has_b = F.col(text_b).isNotNull() & (F.col(text_b) != F.lit(""))
        x = x.withColumn("_tb", F.when(has_b, tok(F.col(text_b))).otherwise(F.array().cast("array<string>")))
        pa, pb = sequences.truncate_pair("_ta", "_tb", max_seq_length - 3)
        is_pair = F.size("_tb") > 0
        x = x.withColumn("_a", F.when(is_pair, pa).otherwise(sequences.truncate_single("_ta", max_seq_length)))
        x = x.withColumn("_b", F.when(is_pair, pb).otherwise(F.array().cast("array<string>")))
        toks, seg = sequences.assemble(F.col("_a"), F.col("_b"), "[CLS]", "[SEP]")
    else:
        x = x.withColumn("_a", sequences.truncate_single("_ta", max_seq_length))
        toks, seg = sequences.assemble(F.col("_a"), None, "[CLS]", "[SEP]")
    x = x.withColumn("tokens", toks).withColumn("_seg", seg)
    x = x.withColumn("_ids", V.tokens_to_ids(F.col("tokens"), vocab))
    x = x.withColumn("input_ids", sequences.pad(F.col("_ids"), max_seq_length))
    x = x.withColumn("input_mask", sequences.mask_of(F.col("_ids"), max_seq_length))
    x = x.withColumn("segment_ids", sequences.pad(F.col("_seg"), max_seq_length))
    return x.drop("_ta", "_tb", "_a", "_b", "_seg", "_ids")


def classification_features(examples: DataFrame, vocab: dict, labels: DataFrame, max_seq_length: int,
                            text_col: str = "text", label_col: str = "label", tokenize=None,
                            text_b_col: str | None = None) -> DataFrame:
    """Features of one text, or of a pair where ``text_b_col`` is given, with label ids
    and ``is_real_example = 1``."""
    f = single_features(examples, text_col, text_b_col, vocab, max_seq_length, tokenize)
    f = encode_label(f, labels, label_col)
    return f.withColumn("label_ids", F.col("label_id")).withColumn("is_real_example", F.lit(1))


def pair_features(pairs: DataFrame, vocab: dict, max_seq_length: int, tokenize=None) -> DataFrame:
    """Features of (unique_id, text_a, text_b) for extraction, no label."""
    f = single_features(pairs, "text_a", "text_b", vocab, max_seq_length, tokenize)
    return f.withColumnRenamed("segment_ids", "input_type_ids")


def plan_steps(df: DataFrame, batch: int, epochs: float, warmup_proportion: float) -> DataFrame:
    """int(n / batch * epochs) training steps and int(steps * proportion) warm-up."""
    steps = F.floor(F.count(F.lit(1)) / F.lit(batch) * F.lit(float(epochs))).cast("long")
    return df.agg(steps.alias("num_train_steps")).withColumn(
        "num_warmup_steps", F.floor(F.col("num_train_steps") * F.lit(float(warmup_proportion))).cast("long"))


def epochs(df: DataFrame, k: int) -> DataFrame:
    """H1: the feed repeated ``k`` times (finite epochs), no join."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def epoch_shuffle(df: DataFrame, seed: int, key_cols: list[str], out: str = "position") -> DataFrame:
    """H2: a fresh seeded order in every epoch; ``position`` restarts per epoch."""
    keyed = df.withColumn("_h", rng.sort_key(seed, "epoch", F.col("epoch"), *[F.col(c) for c in key_cols]))
    return dense_index_by_hash(keyed, "_h", out, key_cols, group_cols=["epoch"]).drop("_h")


def batches(df: DataFrame, batch: int, index_col: str, drop_last: bool, group_cols: list[str] | None = None) -> DataFrame:
    """H3: batch id = index div batch; with ``drop_last`` the partial last batch goes."""
    out = df.withColumn("batch_id", F.floor(F.col(index_col) / batch).cast("long"))
    if not drop_last:
        return out
    group_cols = group_cols or []
    if group_cols:
        n = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(n, group_cols)
    else:
        out = out.withColumn("_n", F.lit(df.count()))
    return out.filter(F.col(index_col) < F.col("_n") - F.col("_n") % batch).drop("_n")
