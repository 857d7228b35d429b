"""Scoring and metrics over prediction tables.

Per-row math is array expressions (``transform``/``aggregate``), metrics are
aggregates with partial aggregation; the per-class report and the confusion matrix
come from one count per (true, predicted) pair. Only the class list (bounded) is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .datasets import MAX_LABELS
from .vocab import bounded_collect


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(x) -> Column:
    """Softmax over an array, with the maximum subtracted first."""
    x = _c(x)
    m = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / s)


def log_softmax(x) -> Column:
    """Log-softmax over an array."""
    x = _c(x)
    m = F.array_max(x)
    lse = F.log(F.aggregate(F.transform(x, lambda v: F.exp(v - m)), F.lit(0.0), lambda acc, v: acc + v)) + m
    return F.transform(x, lambda v: v - lse)


def nll(log_probs, label) -> Column:
    """-log p[label] (labels are 0-based)."""
    return -F.element_at(_c(log_probs), _c(label) + 1)


def mean_loss(df: DataFrame, loss_col: str) -> DataFrame:
    """I4."""
    return df.agg(F.avg(loss_col).alias("loss"))


def masked_loss(df: DataFrame, loss_col: str, weight_col: str) -> DataFrame:
    """Training loss sum(w * l) / (sum(w) + 1e-5)."""
    return df.agg((F.sum(F.col(weight_col) * F.col(loss_col)) / (F.sum(weight_col) + F.lit(1e-5))).alias("loss"))


def weighted_accuracy_and_loss(df: DataFrame, pred: str, label: str, loss: str, weight: str | None,
                               acc_name: str, loss_name: str) -> DataFrame:
    """Shared body of I6-I8: weighted accuracy and weighted mean loss (no epsilon)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    hit = (F.col(pred) == F.col(label)).cast("double")
    return df.agg(
        (F.sum(w * hit) / F.sum(w)).alias(acc_name),
        (F.sum(w * F.col(loss)) / F.sum(w)).alias(loss_name),
    )


def masked_lm_metrics(rows: DataFrame) -> DataFrame:
    """Rows (masked_lm_ids, masked_lm_weights, example_loss, predictions) arrays
    per instance; padded predictions carry weight 0 and do not count."""
    z = rows.select(F.explode(F.arrays_zip("masked_lm_ids", "masked_lm_weights", "example_loss", "predictions")).alias("z"))
    z = z.select("z.masked_lm_ids", "z.masked_lm_weights", "z.example_loss", "z.predictions")
    return weighted_accuracy_and_loss(z, "predictions", "masked_lm_ids", "example_loss", "masked_lm_weights",
                                      "masked_lm_accuracy", "masked_lm_loss")


def nsp_metrics(rows: DataFrame) -> DataFrame:
    """Next-sentence accuracy and mean loss."""
    return weighted_accuracy_and_loss(rows, "nsp_prediction", "nsp_label", "nsp_loss", None,
                                      "next_sentence_accuracy", "next_sentence_loss")


def classifier_metrics(rows: DataFrame) -> DataFrame:
    """I8: accuracy and loss weighted by ``is_real_example``."""
    return weighted_accuracy_and_loss(rows, "prediction", "label_ids", "per_example_loss", "is_real_example",
                                      "eval_accuracy", "eval_loss")


def argmax(x) -> Column:
    """Index of the largest value, the first one on ties (0-based)."""
    x = _c(x)
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def argmax_label(df: DataFrame, probs: str, labels: DataFrame, out: str = "predict") -> DataFrame:
    """Argmax mapped to the label name through the (bounded) label list."""
    if labels.count() > MAX_LABELS:
        raise ValueError("label list above the broadcast bound")
    idx = df.withColumn("_k", argmax(probs))
    lab = F.broadcast(labels.select(F.col("label_id").alias("_k"), F.col("label").alias(out)))
    return idx.join(lab, "_k", "left").drop("_k")


def join_by_position(preds: DataFrame, table: DataFrame, pos_col: str = "row_id") -> DataFrame:
    """Predictions and the test table side by side; a position that only one of them
    holds is an error. The check is part of the position column that is returned."""
    both = preds.withColumn("_p", F.lit(True)).join(table.withColumn("_t", F.lit(True)), pos_col, "full_outer")
    wrong = F.raise_error(F.concat(F.lit("only one table holds position "), F.col(pos_col).cast("string")))
    whole = F.when(F.col("_p") & F.col("_t"), F.col(pos_col)).otherwise(wrong.cast(preds.schema[pos_col].dataType))
    return both.withColumn(pos_col, whole).drop("_p", "_t")


def accuracy(df: DataFrame, label: str = "label", predict: str = "predict") -> DataFrame:
    """I13."""
    return df.agg(F.avg((F.col(label) == F.col(predict)).cast("double")).alias("accuracy"))


def classification_report(df: DataFrame, label: str = "label", predict: str = "predict") -> DataFrame:
    """Per class precision, recall, F1 and support; 0 where a denominator is 0."""
    hit = F.when(F.col(label) == F.col(predict), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    cells = df.groupBy(label, predict).agg(F.count(F.lit(1)).alias("n"))  # one pass; at most classes x classes rows
    sides = cells.select(F.inline(F.array(
        F.struct(F.col(label).alias("class"), F.col("n").alias("support"), zero.alias("predicted"), hit.cast("long").alias("tp")),
        F.struct(F.col(predict).alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")))))
    j = sides.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    j = j.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return j.withColumn("f1", f1).select("class", "precision", "recall", "f1", F.col("support").cast("long"), "tp",
                                         F.col("predicted").cast("long"))


def report_averages(report: DataFrame) -> DataFrame:
    """Micro, macro and weighted averages of the per-class report."""
    tot = report.agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("n"), F.sum("predicted").alias("np"),
        F.avg("precision").alias("macro_p"), F.avg("recall").alias("macro_r"), F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("w_p"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("w_r"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("w_f1"),
    )
    micro_p = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0)
    micro_r = F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(0.0)
    micro_f1 = F.when(micro_p + micro_r > 0, 2 * micro_p * micro_r / (micro_p + micro_r)).otherwise(0.0)
    rows = F.array(
        F.struct(F.lit("micro avg").alias("average"), micro_p.alias("precision"), micro_r.alias("recall"),
                 micro_f1.alias("f1")),
        F.struct(F.lit("macro avg").alias("average"), F.col("macro_p").alias("precision"),
                 F.col("macro_r").alias("recall"), F.col("macro_f1").alias("f1")),
        F.struct(F.lit("weighted avg").alias("average"), F.col("w_p").alias("precision"), F.col("w_r").alias("recall"),
                 F.col("w_f1").alias("f1")),
    )
    return tot.select(F.inline(rows), F.col("n").cast("long").alias("support"))


def confusion_matrix(df: DataFrame, label: str = "label", predict: str = "predict",
                     classes: list | None = None) -> DataFrame:
    """I16: rows = true class, one column per predicted class, classes sorted, zero
    cells present (a class seen only among predictions gets an all-zero row)."""
    cells = cut_lineage(df.groupBy(F.col(label).alias("actual"), F.col(predict).alias("_predict")).agg(F.count(F.lit(1)).alias("n")))
    if classes is None:
        cl = cells.select(F.inline(F.array(F.struct(F.col("actual").alias("c")), F.struct(F.col("_predict").alias("c"))))).distinct()
        classes = sorted(r["c"] for r in bounded_collect(cl, MAX_LABELS))
    counts = cells.groupBy("actual").pivot("_predict", classes).agg(F.sum("n")).fillna(0)
    spark = df.sparkSession
    all_rows = spark.createDataFrame([(c,) for c in classes], df.select(F.col(label).alias("actual")).schema)
    out = all_rows.join(counts, "actual", "left").fillna(0)
    return out.select("actual", *[F.col(f"`{c}`").cast("long").alias(f"p_{c}") for c in classes])


def gather_positions(seq, positions) -> Column:
    """Items of ``seq`` at 0-based ``positions``."""
    s = _c(seq)
    return F.transform(_c(positions), lambda p: s[p])


def linear_scores(x, weights: list[list[float]], bias: list[float]) -> Column:
    """W x + b per class; W (classes x dims) is a bounded parameter. A batch is one matrix, added up dimension by
    dimension, so a row's scores do not depend on its batch. A null vector, one of another length and one with a
    null entry have null scores."""
    w, b = np.array(weights, np.float64), np.array(bias, np.float64)

    @F.pandas_udf("array<double>")
    def scores(s: pd.Series) -> pd.Series:
        out = pd.Series([[None] * len(b)] * len(s), dtype=object)
        fine = [i for i, v in enumerate(s) if v is not None and len(v) == w.shape[1] and None not in v]
        x = np.array([s.iloc[i] for i in fine], np.float64).reshape(len(fine), w.shape[1])
        total = np.repeat(b[None, :], len(fine), axis=0)
        for d in range(w.shape[1]):
            total += x[:, d, None] * w[:, d]
        out[fine] = pd.Series(list(total), index=fine, dtype=object)
        return out

    return scores(_c(x))
