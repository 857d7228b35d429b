"""TF-IDF baseline and head fitting (K1-K5).

K2 is aggregates and joins: term frequencies with partial aggregation, the top-k
term list (bounded by ``max_features``) broadcast, document frequencies, idf with
the smoothing of the reference's library (ln((1+n)/(1+df)) + 1), and an L2 norm per
row from a per-row sum of squares. K3 is in ``boosting``; K5 uses a Spark ML estimator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ws_tokens

# Fixed value: a term is a run of at least two word characters (letters, digits, _).
TERM_PATTERN = "[\\p{L}\\p{N}_]{2,}"


def segment_words(df: DataFrame, text_col: str = "text", out: str = "words") -> DataFrame:
    """K1 (re-aimed): words of a spaced-language text column (the ``ws`` tokenizer);
    a subword tokenizer (``vocab.tokenize_subword``) can be passed instead downstream."""
    return df.withColumn(out, ws_tokens(F.col(text_col)))


def terms(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Terms of each row: lowercased runs of two or more word characters."""
    return df.withColumn("_terms", F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TERM_PATTERN), 0))


def fit_tfidf(fit: DataFrame, key: str, text_col: str = "text", max_features: int = 750) -> DataFrame:
    """K2 fit: (term, term_index, idf) of the ``max_features`` most frequent terms
    (ties by term); term_index follows term order as in the reference's library."""
    t = terms(fit, text_col).select(key, "_terms")
    n = t.select(key).count()
    # Counted per (row, term) first: a term's row count needs no distinct.
    per = t.select(key, F.explode("_terms").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = per.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))
    top = stats.orderBy(F.col("tf").desc(), F.col("term")).limit(max_features)
    w = Window.orderBy("term")  # over at most max_features rows
    return top.select(
        "term",
        (F.row_number().over(w) - 1).cast("int").alias("term_index"),
        (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"),
    )


def transform_tfidf(df: DataFrame, model: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """K2 apply: long form (key, term, term_index, value), rows L2-normalised."""
    t = terms(df, text_col).select(key, F.explode("_terms").alias("term"))
    # The model has at most ``max_features`` rows.
    tf = t.join(F.broadcast(model), "term").groupBy(key, "term", "term_index", "idf").agg(
        F.count(F.lit(1)).alias("tf"))
    v = tf.withColumn("raw", F.col("tf") * F.col("idf"))
    norm = v.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("_norm"))
    return v.join(norm, key).select(key, "term", "term_index", (F.col("raw") / F.col("_norm")).alias("value"))


def sparse_features(long: DataFrame, rows: DataFrame, key: str, dims: int, out: str = "features") -> DataFrame:
    """Long (key, term_index, value) -> one ML vector per row of ``rows`` (empty where a row has no term), by
    native expressions: each value behind the zeros since the one before it, then the vector, kept
    sparse where that is smaller."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    g = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term_index", "value"))).alias("_t"))
    x = rows.join(g, key, "left").withColumn("_t", F.coalesce("_t", F.array().cast("array<struct<term_index:int,value:double>>")))
    zeros = "array_repeat(0D, {})".format
    before = "_t[i - 1].term_index"
    steps = f"transform(_t, (x, i) -> concat({zeros(f'x.term_index - if(i = 0, -1, {before}) - 1')}, array(x.value)))"
    rest = zeros(f"{dims} - 1 - coalesce(try_element_at(_t, -1).term_index, -1)")
    x = x.withColumn("_v", array_to_vector(F.expr(f"concat(flatten({steps}), {rest})"))).drop("_t")
    return VectorAssembler(inputCols=["_v"], outputCol=out).transform(x).drop("_v")


def train_baseline(train: DataFrame, label_col: str = "label_index", features: str = "features",
                   validation_col: str | None = "is_validation", max_iter: int = 200, tol: float = 0.01, patience: int = 5):
    """K3: boosted trees with softmax loss, up to ``max_iter`` rounds of one tree per class; stops when the
    loss of the validation rows has not become lower by ``tol`` over ``patience`` rounds."""
    from . import boosting

    return boosting.fit(train, label_col, features, validation_col, boosting.Settings(rounds=max_iter, tol=tol, patience=patience))


def train_head(df: DataFrame, features_col: str = "embedding", label_col: str = "label", max_iter: int = 100):
    """K5 (re-aimed): softmax regression on fixed vectors."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = df.withColumn("_features", array_to_vector(F.col(features_col).cast("array<double>")))
    lr = LogisticRegression(featuresCol="_features", labelCol=label_col, family="multinomial", maxIter=max_iter)
    return lr.fit(x), x
