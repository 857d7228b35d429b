"""Queries for scoring, metrics, vectors and their sinks.

Prediction tables stand in as the scores of 10 classes over all 64 values of ``embeddings``
(I18 with weights by a fixed rule; truth = ``label``); masked-LM evaluation rows are the pretraining records with
keyed stand-in model outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..operators import metrics as I
from ..operators import vectors as J
from ..sinks import writers
from ..sources import tables
from . import sqlparts as S
from .catalog import T, register, with_ctes
from .q_corpus import SEED
from .q_datasets import _PAIR_FEAT_SQL, pair_feature_table

N_CLASSES = 10
ROUND = 6


def logits(spark, sf) -> DataFrame:
    W, b = head_weights()
    e = T(spark, sf, "embeddings")
    return e.select("vec_id", "label", r6a(I.linear_scores(F.col("embedding").cast("array<double>"), W, b)).alias("x"))


def r6(c):
    return F.round(c, ROUND)


def r6a(c):
    return F.transform(c, lambda v: F.round(v, ROUND))


_LOGITS = [
    f"""lg AS (SELECT vec_id, label, list(round(score, 6) ORDER BY c) AS x FROM (
  SELECT e.vec_id, e.label, w.c, sum(CAST(e.v AS DOUBLE) * w.w) + (w.c - 5) / 10.0 AS score
  FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(64)) AS d FROM embeddings) e
  JOIN (SELECT c, d, ((((c + 1) * (d + 3)) % 11) - 5) / 10.0 AS w FROM range({N_CLASSES}) t1(c), range(64) t2(d)) w ON w.d = e.d
  GROUP BY e.vec_id, e.label, w.c) _s GROUP BY vec_id, label)""",
    "lm AS (SELECT *, list_max(x) AS m FROM lg)",
    "ls AS (SELECT *, list_sum(list_transform(x, lambda v: exp(v - m))) AS s FROM lm)",
    "lp AS (SELECT *, ln(s) + m AS lse, list_position(x, list_max(x)) - 1 AS k FROM ls)",
    "pr AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(k AS VARCHAR) AS predict FROM lp)",
]


@register("i1_softmax", with_ctes(_LOGITS, "SELECT vec_id, list_transform(x, lambda v: round(exp(v - m) / s, 6)) AS probs FROM lp"))
def i1_softmax(spark, sf):
    return logits(spark, sf).select("vec_id", r6a(I.softmax("x")).alias("probs"))


@register("i2_log_softmax", with_ctes(_LOGITS, "SELECT vec_id, list_transform(x, lambda v: round(v - lse, 6)) AS log_probs FROM lp"))
def i2_log_softmax(spark, sf):
    return logits(spark, sf).select("vec_id", r6a(I.log_softmax("x")).alias("log_probs"))


@register("i3_nll", with_ctes(_LOGITS, "SELECT vec_id, round(-(x[label + 1] - lse), 6) AS loss FROM lp"))
def i3_nll(spark, sf):
    return logits(spark, sf).select("vec_id", r6(I.nll(I.log_softmax("x"), F.col("label"))).alias("loss"))


@register("i4_mean_loss", with_ctes(_LOGITS, "SELECT round(avg(-(x[label + 1] - lse)), 6) AS loss FROM lp"))
def i4_mean_loss(spark, sf):
    l = logits(spark, sf).select(I.nll(I.log_softmax("x"), F.col("label")).alias("l"))
    return I.mean_loss(l, "l").select(r6(F.col("loss")).alias("loss"))


@register("i8_classifier_metrics", with_ctes(_LOGITS, """SELECT round(avg(CAST(k = label AS DOUBLE)), 6) AS eval_accuracy,
  round(avg(-(x[label + 1] - lse)), 6) AS eval_loss FROM lp"""))
def i8_classifier_metrics(spark, sf):
    """Real rows padded to a batch of 8 with weight-0 dummies (G9), which must not count."""
    lg = logits(spark, sf)
    real = lg.select(I.argmax("x").alias("prediction"), F.col("label").alias("label_ids"),
                     I.nll(I.log_softmax("x"), F.col("label")).alias("per_example_loss"), F.lit(1).alias("is_real_example"))
    n = real.count()
    k = (8 - n % 8) % 8
    dummy = spark.range(k).select(F.lit(0).alias("prediction"), F.lit(0).alias("label_ids"),
                                  F.lit(0.0).alias("per_example_loss"), F.lit(0).alias("is_real_example"))
    m = I.classifier_metrics(real.unionByName(dummy))
    return m.select(r6(F.col("eval_accuracy")).alias("eval_accuracy"), r6(F.col("eval_loss")).alias("eval_loss"))


def predictions(spark, sf) -> DataFrame:
    """(vec_id, label, predict) with label names as text."""
    from ..operators.datasets import categories

    lg = logits(spark, sf).withColumn("label", F.col("label").cast("string"))
    return I.argmax_label(lg, "x", categories(lg)).select("vec_id", "label", "predict")


@register("i10_argmax_label", with_ctes(_LOGITS, "SELECT vec_id, predict FROM pr"))
def i10_argmax_label(spark, sf):
    return predictions(spark, sf).select("vec_id", "predict")


@register("i13_accuracy", with_ctes(_LOGITS, "SELECT avg(CAST(label = predict AS DOUBLE)) AS accuracy FROM pr"))
def i13_accuracy(spark, sf):
    return I.accuracy(predictions(spark, sf))


_REPORT = _LOGITS + [
    """rep AS (SELECT class, precision, recall,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1, support, tp, predicted FROM (
  SELECT class, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support, tp, predicted FROM (
    SELECT coalesce(a.class, p.class) AS class, coalesce(a.support, 0) AS support, coalesce(p.predicted, 0) AS predicted,
           coalesce(t.tp, 0) AS tp
    FROM (SELECT label AS class, count(*) AS support FROM pr GROUP BY 1) a
    FULL OUTER JOIN (SELECT predict AS class, count(*) AS predicted FROM pr GROUP BY 1) p ON a.class = p.class
    LEFT JOIN (SELECT label AS class, count(*) AS tp FROM pr WHERE label = predict GROUP BY 1) t ON t.class = coalesce(a.class, p.class)
  ) _c) _d)""",
]


@register("i14_classification_report", with_ctes(_REPORT, """SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM rep"""))
def i14_classification_report(spark, sf):
    r = I.classification_report(predictions(spark, sf))
    return r.select("class", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"),
                    r6(F.col("f1")).alias("f1"), "support")


@register("i15_report_averages", with_ctes(_REPORT, """SELECT average, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, support FROM (
  SELECT 'micro avg' AS average, mp AS precision, mr AS recall, CASE WHEN mp + mr > 0 THEN 2 * mp * mr / (mp + mr) ELSE 0.0 END AS f1, n AS support
  FROM (SELECT CASE WHEN sum(predicted) > 0 THEN sum(tp) / sum(predicted) ELSE 0.0 END AS mp,
               CASE WHEN sum(support) > 0 THEN sum(tp) / sum(support) ELSE 0.0 END AS mr, CAST(sum(support) AS BIGINT) AS n FROM rep) _m
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM rep
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM rep) _a"""))
def i15_report_averages(spark, sf):
    a = I.report_averages(I.classification_report(predictions(spark, sf)))
    return a.select("average", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"),
                    r6(F.col("f1")).alias("f1"), "support")


_CLASSES = [str(i) for i in range(N_CLASSES)]


@register("i16_confusion_matrix", with_ctes(_LOGITS, "SELECT c.actual, " + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN p.predict = '{c}' THEN 1 ELSE 0 END), 0) AS BIGINT) AS p_{c}" for c in _CLASSES)
    + " FROM (SELECT DISTINCT label AS actual FROM pr UNION SELECT DISTINCT predict FROM pr) c LEFT JOIN pr p ON p.label = c.actual GROUP BY c.actual"))
def i16_confusion_matrix(spark, sf):
    return I.confusion_matrix(predictions(spark, sf))


@register("i17_gather_positions", """SELECT vec_id, list_transform([label % 4, (label + 1) % 4, 3],
  lambda p: list_transform(embedding[p * 16 + 1: p * 16 + 16], lambda v: round(CAST(v AS DOUBLE), 6))) AS gathered FROM embeddings""")
def i17_gather_positions(spark, sf):
    e = T(spark, sf, "embeddings")
    seq = F.array(*[F.slice("embedding", 16 * k + 1, 16) for k in range(4)])
    pos = F.array(F.col("label") % 4, (F.col("label") + 1) % 4, F.lit(3))
    g = I.gather_positions(seq, pos)
    return e.select("vec_id", F.transform(g, lambda v: F.transform(v, lambda x: F.round(x.cast("double"), ROUND))).alias("gathered"))


def head_weights(n_classes: int = N_CLASSES, dims: int = 64):
    """Stand-in head parameters from a fixed rule (W[c][d] and b[c])."""
    W = [[(((c + 1) * (d + 3)) % 11 - 5) / 10.0 for d in range(dims)] for c in range(n_classes)]
    b = [(c - 5) / 10.0 for c in range(n_classes)]
    return W, b


@register("i18_linear_scores", f"""SELECT vec_id, list(round(score, 6) ORDER BY c) AS scores FROM (
  SELECT e.vec_id, w.c, sum(CAST(e.v AS DOUBLE) * w.w) + (w.c - 5) / 10.0 AS score
  FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS d FROM embeddings) e
  JOIN (SELECT c, d, ((((c + 1) * (d + 3)) % 11) - 5) / 10.0 AS w FROM range({N_CLASSES}) t1(c), range(64) t2(d)) w ON w.d = e.d
  GROUP BY e.vec_id, w.c) _s GROUP BY vec_id""")
def i18_linear_scores(spark, sf):
    W, b = head_weights()
    e = T(spark, sf, "embeddings")
    return e.select("vec_id", r6a(I.linear_scores(F.col("embedding").cast("array<double>"), W, b)).alias("scores"))


# --- prediction file round trip (B5 -> A7) and join by position (I11) ----------------

def _pred_file(spark, sf) -> str:
    lg = logits(spark, sf).select(F.col("vec_id").alias("row_id"), F.col("x").alias("probabilities"),
                                  F.lit(True).alias("is_real_example"))
    return writers.write_predictions(lg, spark, "predictions", expected_rows=T(spark, sf, "embeddings").count())


@register("b5_a7_predictions_round_trip", with_ctes(_LOGITS, "SELECT vec_id AS row_id, x AS probabilities FROM lg"))
def b5_a7_predictions_round_trip(spark, sf):
    return tables.read_predictions(spark, _pred_file(spark, sf))


@register("i11_join_by_position", with_ctes(_LOGITS, "SELECT vec_id AS row_id, label, predict FROM pr"))
def i11_join_by_position(spark, sf):
    from ..operators.datasets import categories

    preds = tables.read_predictions(spark, _pred_file(spark, sf))
    truth = T(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("label"))
    j = I.join_by_position(preds, truth)
    return I.argmax_label(j, "probabilities", categories(truth)).select("row_id", "label", "predict")


@register("b6_metrics_report", with_ctes(_LOGITS, """SELECT line FROM (
  SELECT 'eval_accuracy = ' || CAST(round(avg(CAST(k = label AS DOUBLE)), 6) AS VARCHAR) AS line FROM lp
  UNION ALL SELECT 'eval_loss = ' || CAST(round(avg(-(x[label + 1] - lse)), 6) AS VARCHAR) FROM lp) _m"""))
def b6_metrics_report(spark, sf):
    lg = logits(spark, sf)
    rows = lg.select(I.argmax("x").alias("prediction"), F.col("label").alias("label_ids"),
                     I.nll(I.log_softmax("x"), F.col("label")).alias("per_example_loss"), F.lit(1).alias("is_real_example"))
    m = I.classifier_metrics(rows)
    long = m.select(F.inline(F.array(
        F.struct(F.lit("eval_loss").alias("name"), r6(F.col("eval_loss")).alias("value")),
        F.struct(F.lit("eval_accuracy").alias("name"), r6(F.col("eval_accuracy")).alias("value")),
    )))
    path = writers.write_metrics(long, spark, "metrics")
    return spark.read.text(path).select(F.col("value").alias("line"))


# --- masked-LM / next-sentence evaluation rows (I5, I6, I7, I9) ------------------------

def eval_rows(spark, sf) -> DataFrame:
    """Pretraining records with keyed stand-in model outputs per prediction slot."""
    from .q_sequences import _records

    r = _records(spark, sf)
    k = F.col("inst_index")
    preds = F.transform("masked_lm_ids", lambda x, i: F.when(rng.u(SEED, "mlmpred", k, i) < 0.7, x).otherwise(x + 1))
    loss = F.transform("masked_lm_ids", lambda x, i: rng.u(SEED, "mlmloss", k, i) * 3.0)
    nsp_label = F.col("next_sentence_labels")[0]
    return r.select(
        "inst_index", "masked_lm_ids", "masked_lm_weights", loss.alias("example_loss"), preds.alias("predictions"),
        nsp_label.alias("nsp_label"),
        F.when(rng.u(SEED, "nsppred", k) < 0.9, nsp_label).otherwise(1 - nsp_label).alias("nsp_prediction"),
        rng.u(SEED, "nsploss", k).alias("nsp_loss"),
    )


def _eval_sql():
    from .q_sequences import _records_sql

    u = lambda p, *k: S.u(SEED, p, *k)
    return _records_sql() + [
        f"""ev AS (SELECT inst_index, next_sentence_labels[1] AS nsp_label,
  CASE WHEN {u('nsppred', 'inst_index')} < 0.9 THEN next_sentence_labels[1] ELSE 1 - next_sentence_labels[1] END AS nsp_prediction,
  {u('nsploss', 'inst_index')} AS nsp_loss FROM recs)""",
        f"""evp AS (SELECT inst_index, i, masked_lm_ids[i + 1] AS id, CAST(masked_lm_weights[i + 1] AS DOUBLE) AS w,
  {u('mlmloss', 'inst_index', 'i')} * 3.0 AS loss,
  CASE WHEN {u('mlmpred', 'inst_index', 'i')} < 0.7 THEN masked_lm_ids[i + 1] ELSE masked_lm_ids[i + 1] + 1 END AS pred
  FROM (SELECT *, unnest(range(len(masked_lm_ids))) AS i FROM recs) _r)""",
    ]


def _rec(ctes, final):
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + final


@register("i5_masked_loss", _rec(_eval_sql(), "SELECT round(sum(w * loss) / (sum(w) + 1e-5), 6) AS loss FROM evp"))
def i5_masked_loss(spark, sf):
    z = eval_rows(spark, sf).select(F.explode(F.arrays_zip("masked_lm_weights", "example_loss")).alias("z"))
    z = z.select(F.col("z.masked_lm_weights").cast("double").alias("w"), F.col("z.example_loss").alias("l"))
    return I.masked_loss(z, "l", "w").select(r6(F.col("loss")).alias("loss"))


@register("i6_masked_lm_metrics", _rec(_eval_sql(), """SELECT round(sum(w * CAST(pred = id AS DOUBLE)) / sum(w), 6) AS masked_lm_accuracy,
  round(sum(w * loss) / sum(w), 6) AS masked_lm_loss FROM evp"""))
def i6_masked_lm_metrics(spark, sf):
    m = I.masked_lm_metrics(eval_rows(spark, sf))
    return m.select(r6(F.col("masked_lm_accuracy")).alias("masked_lm_accuracy"), r6(F.col("masked_lm_loss")).alias("masked_lm_loss"))


@register("i7_nsp_metrics", _rec(_eval_sql(), """SELECT round(avg(CAST(nsp_prediction = nsp_label AS DOUBLE)), 6) AS next_sentence_accuracy,
  round(avg(nsp_loss), 6) AS next_sentence_loss FROM ev"""))
def i7_nsp_metrics(spark, sf):
    m = I.nsp_metrics(eval_rows(spark, sf))
    return m.select(r6(F.col("next_sentence_accuracy")).alias("next_sentence_accuracy"),
                    r6(F.col("next_sentence_loss")).alias("next_sentence_loss"))


@register("i9_total_loss", _rec(_eval_sql(), """SELECT round(m.l + n.l, 6) AS total_loss FROM
  (SELECT sum(w * loss) / (sum(w) + 1e-5) AS l FROM evp) m, (SELECT avg(nsp_loss) AS l FROM ev) n"""))
def i9_total_loss(spark, sf):
    ev = eval_rows(spark, sf)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)
    weighted = F.zip_with("masked_lm_weights", "example_loss", lambda w, l: w.cast("double") * l)
    per_row = ev.select(add(weighted).alias("wl"), add(F.transform("masked_lm_weights", lambda w: w.cast("double"))).alias("w"), "nsp_loss")
    total = F.sum("wl") / (F.sum("w") + F.lit(1e-5)) + F.avg("nsp_loss")
    return per_row.agg(r6(total).alias("total_loss"))


# --- per-token vectors (J1-J3, I12, B3, A9) ---------------------------------------------

LAYERS = [-1, -2, -3, -4]


def layer_outputs(spark, sf) -> DataFrame:
    """Stand-in encoder output joined to the pair features by unique id (I12): layer k
    for token t is the k-th 16-value slice of the embedding with that id, times (t + 1)."""
    feats = pair_feature_table(spark, sf)
    e = T(spark, sf, "embeddings").select(F.col("vec_id").alias("unique_id"), "embedding")
    j = feats.join(e, "unique_id")  # I12: inner join on the unique id
    n = F.size("tokens")
    def layer(k):
        sl = F.slice("embedding", 16 * k + 1, 16)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.transform(sl, lambda v: v.cast("double") * (t + 1)))

    layers = F.array(*[layer(k) for k in range(4)])
    return j.select("unique_id", "tokens", layers.alias("all_layers"))


def _vec_sql() -> list[str]:
    return _PAIR_FEAT_SQL + [
        """jf AS (SELECT f.unique_id, f.tokens, e.embedding FROM pfeat f JOIN embeddings e ON e.vec_id = f.unique_id)""",
        """tv AS (SELECT unique_id, t, tok, li, lidx,
  list_transform(embedding[lidx * 16 + 1: lidx * 16 + 16], lambda v: round(CAST(v AS DOUBLE) * (t + 1), 6)) AS vals
  FROM (SELECT unique_id, embedding, t, tokens[t + 1] AS tok FROM (SELECT *, unnest(range(len(tokens))) AS t FROM jf) _a) _b,
       (SELECT * FROM (VALUES (-1, 3, 0), (-2, 2, 1), (-3, 1, 2), (-4, 0, 3)) v(li, lidx, ord)) _l)""",
        """tvr AS (SELECT unique_id, t, tok, list({'index': li, 'values': vals} ORDER BY ord) AS layers FROM (
  SELECT tv.*, CASE li WHEN -1 THEN 0 WHEN -2 THEN 1 WHEN -3 THEN 2 ELSE 3 END AS ord FROM tv) _o GROUP BY unique_id, t, tok)""",
        """recsv AS (SELECT CAST(unique_id AS BIGINT) AS linex_index, list({'token': tok, 'layers': layers} ORDER BY t) AS features
  FROM tvr GROUP BY unique_id)""",
    ]


def token_vector_table(spark, sf) -> DataFrame:
    return J.token_vectors(layer_outputs(spark, sf), "unique_id", "tokens", "all_layers", LAYERS)


@register("j1_j2_token_vectors", with_ctes(_vec_sql(), "SELECT linex_index, features FROM recsv"))
def j1_j2_token_vectors(spark, sf):
    return token_vector_table(spark, sf)


@register("i12_join_features", with_ctes(_vec_sql(), """SELECT unique_id, tokens,
  list_transform(embedding, lambda v: round(CAST(v AS DOUBLE), 6)) AS encoded FROM jf"""))
def i12_join_features(spark, sf):
    """The features of every input line beside the encoder output of its unique id: the first
    token's layers are the stored values themselves."""
    first = F.flatten(F.transform("all_layers", lambda layer: layer[0]))
    return layer_outputs(spark, sf).select("unique_id", "tokens", r6a(first).alias("encoded"))


@register("b3_a9_j3_vector_lookup", with_ctes(_vec_sql(), """SELECT linex_index, features[4].token AS token,
  features[4].layers[1]['values'] AS "values" FROM recsv WHERE len(features) >= 4"""))
def b3_a9_j3_vector_lookup(spark, sf):
    """B3 write as JSON lines, A9 read with the fixed nested schema, J3 lookup of
    ``features[3].layers[0].values`` (the token after [CLS] and the first piece)."""
    path = writers.write_token_vectors(token_vector_table(spark, sf), spark, "vectors")
    back = tables.read_token_vectors(spark, path).filter(F.size("features") >= 4)
    return J.vector_of(back, 3, 0)
