"""Queries for labelled datasets, features and batching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import translate_controls
from ..operators import clean, datasets as G
from ..operators import vocab as V
from ..sources import tables
from ..sinks import writers
from ..session import cut_lineage
from . import sqlparts as S
from .catalog import T, register, with_ctes
from .q_corpus import _PAIR_LINES_SQL, _VOCAB_SQL, SEED, pair_lines, sentence_vocab
from ..sources import text as src

SEQ = 128
BATCH = 8
TRAIN_BATCH, EPOCHS, WARMUP = 32, 3, 0.1


def labelled(spark, sf) -> DataFrame:
    """documents joined to labels: (doc_id, text with controls translated, label)."""
    d = T(spark, sf, "documents")
    lab = T(spark, sf, "labels")
    return d.join(lab, "doc_id").select("doc_id", translate_controls("text").alias("text"),
                                        F.col("quality").cast("string").alias("label"))


def split_table(spark, sf) -> DataFrame:
    return G.split_226(G.shuffle_rows(labelled(spark, sf), SEED, ["doc_id"]))


def word_dict(spark, sf) -> dict:
    return V.vocab_tables(sentence_vocab(spark, sf))[0]


_LAB_SQL = """lab AS (SELECT d.doc_id, replace(replace(replace(d.text, chr(10), ''), chr(9), '　'), chr(13), '') AS text,
  CAST(l.quality AS VARCHAR) AS label FROM documents d JOIN labels l USING (doc_id))"""
_SHUF_SQL = f"""shuf AS (SELECT *, CAST(row_number() OVER (ORDER BY {S.sort_key(SEED, 'rows', 'doc_id')}, doc_id) - 1 AS BIGINT) AS row_index
  FROM lab)"""
_SPLIT_SQL = """spl AS (SELECT *, CASE WHEN row_index < n // 5 THEN 'test' WHEN row_index < (n * 2) // 5 THEN 'dev' ELSE 'train' END AS split,
  CAST(CASE WHEN row_index < n // 5 THEN row_index WHEN row_index < (n * 2) // 5 THEN row_index - n // 5
       ELSE row_index - (n * 2) // 5 END AS BIGINT) AS split_index
  FROM shuf, (SELECT count(*) AS n FROM lab) c)"""
_CAT_SQL = "cats AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM (SELECT DISTINCT label FROM lab) _l)"
_BASE = [_LAB_SQL, _SHUF_SQL, _SPLIT_SQL, _CAT_SQL]


@register("g1_categories", with_ctes(_BASE, "SELECT label, label_id FROM cats"))
def g1_categories(spark, sf):
    return G.categories(labelled(spark, sf))


@register("g3_shuffle_rows", with_ctes(_BASE, "SELECT doc_id, row_index FROM shuf"))
def g3_shuffle_rows(spark, sf):
    return G.shuffle_rows(labelled(spark, sf), SEED, ["doc_id"]).select("doc_id", "row_index")


@register("g4_split_226", with_ctes(_BASE, "SELECT doc_id, split, split_index FROM spl"))
def g4_split_226(spark, sf):
    return split_table(spark, sf).select("doc_id", "split", "split_index")


@register("g5_subsample", with_ctes(_BASE, f"""SELECT doc_id, sample_index FROM (
  SELECT doc_id, CAST(row_number() OVER (ORDER BY {S.sort_key(SEED, 'sample', 'doc_id')}, doc_id) - 1 AS BIGINT) AS sample_index,
         (SELECT count(*) FROM spl WHERE split = 'train') AS n
  FROM spl WHERE split = 'train') _s WHERE sample_index < round_even(n * 0.2, 0)"""))
def g5_subsample(spark, sf):
    train = split_table(spark, sf).filter(F.col("split") == "train")
    return G.subsample(train, 0.2, SEED, ["doc_id"]).select("doc_id", "sample_index")


@register("g6_example_ids", with_ctes(_BASE, "SELECT doc_id, split || '-' || CAST(split_index + 1 AS VARCHAR) AS guid FROM spl"))
def g6_example_ids(spark, sf):
    t = split_table(spark, sf)
    sets = [G.example_ids(t.filter(F.col("split") == x), x, "split_index") for x in ("train", "dev", "test")]
    return sets[0].unionByName(sets[1]).unionByName(sets[2]).select("doc_id", "guid")


@register("g7_encode_label", with_ctes(_BASE, "SELECT l.doc_id, c.label_id FROM lab l JOIN cats c USING (label)"))
def g7_encode_label(spark, sf):
    lab = labelled(spark, sf)
    return G.encode_label(lab, G.categories(lab)).select("doc_id", "label_id")


@register("g8_union_train_dev", with_ctes(_BASE, "SELECT doc_id, split FROM spl WHERE split IN ('train', 'dev')"))
def g8_union_train_dev(spark, sf):
    t = split_table(spark, sf)
    return G.union_sets(t.filter(F.col("split") == "train"), t.filter(F.col("split") == "dev")).select("doc_id", "split")


def _features(spark, sf) -> DataFrame:
    lab = labelled(spark, sf)
    return G.classification_features(lab, word_dict(spark, sf), G.categories(lab), SEQ)


def _feat_sql() -> list[str]:
    return _VOCAB_SQL + _BASE + [
        f"""tk AS (SELECT doc_id, list_concat(['[CLS]'], list_slice({S.ws_tokens('text')}, 1, {SEQ - 2}), ['[SEP]']) AS tokens FROM lab)""",
        S.ids_of("tk", ["doc_id"], "tokens", "vocab", "ids", "fid"),
        f"""feat AS (SELECT f.doc_id,
  CAST(list_concat(f.ids, list_transform(range({SEQ} - len(f.ids)), lambda x: 0)) AS INTEGER[]) AS input_ids,
  CAST(list_concat(list_transform(f.ids, lambda x: 1), list_transform(range({SEQ} - len(f.ids)), lambda x: 0)) AS INTEGER[]) AS input_mask,
  CAST(list_transform(range({SEQ}), lambda x: 0) AS INTEGER[]) AS segment_ids,
  c.label_id AS label_ids, 1 AS is_real_example
  FROM fid f JOIN lab l USING (doc_id) JOIN cats c USING (label))""",
    ]


_FEAT_COLS = "doc_id, input_ids, input_mask, segment_ids, label_ids, is_real_example"


@register("g10_classification_features", with_ctes(_feat_sql(), f"SELECT {_FEAT_COLS} FROM feat"))
def g10_classification_features(spark, sf):
    return _features(spark, sf).select(*[c.strip() for c in _FEAT_COLS.split(",")])


@register("c14_check_seq_len", with_ctes(_feat_sql(), "SELECT doc_id, len(input_ids) AS n FROM feat"))
def c14_check_seq_len(spark, sf):
    f = clean.check_seq_len(_features(spark, sf), ["input_ids", "input_mask", "segment_ids"], SEQ)
    return f.select("doc_id", F.size("input_ids").alias("n"))


@register("c15_preview", with_ctes(_feat_sql(), """SELECT doc_id, array_to_string(list_transform(input_ids,
  lambda x: CAST(x AS VARCHAR)), ' ') AS preview FROM feat ORDER BY doc_id LIMIT 5"""))
def c15_preview(spark, sf):
    f = clean.preview(_features(spark, sf), ["doc_id"], 5)
    return f.select("doc_id", F.array_join("input_ids", " ").alias("preview"))


@register("b2_a8_feature_records", with_ctes(_feat_sql(), f"SELECT {_FEAT_COLS} FROM feat"))
def b2_a8_feature_records(spark, sf):
    """B2 write (int64 on disk) then A8 read with the fixed schema and int32 narrowing."""
    f = _features(spark, sf).select(*[c.strip() for c in _FEAT_COLS.split(",")])
    path = writers.write_features(f, spark, "features")
    back = tables.read_records(spark, path, {"input_ids": SEQ, "input_mask": SEQ, "segment_ids": SEQ},
                               scalars=["label_ids", "is_real_example"], extra={"doc_id": "bigint"})
    return back.select(*[c.strip() for c in _FEAT_COLS.split(",")])


@register("g9_pad_to_batch", with_ctes(_feat_sql(), f"""SELECT row_index, is_real_example, label_ids, input_ids FROM (
  SELECT s.split_index AS row_index, f.is_real_example, f.label_ids, f.input_ids FROM feat f JOIN spl s USING (doc_id) WHERE s.split = 'test'
  UNION ALL
  SELECT CAST(n + i AS BIGINT), 0, 0, CAST(list_transform(range({SEQ}), lambda x: 0) AS INTEGER[])
  FROM (SELECT count(*) AS n FROM spl WHERE split = 'test') c, range(({BATCH} - n % {BATCH}) % {BATCH}) t(i)) _u"""))
def g9_pad_to_batch(spark, sf):
    f = _features(spark, sf)
    test = split_table(spark, sf).filter(F.col("split") == "test").select("doc_id", F.col("split_index").alias("row_index"))
    padded = G.pad_to_batch(f.join(test, "doc_id"), BATCH, SEQ)
    return padded.select("row_index", "is_real_example", "label_ids", "input_ids")


@register("g11_plan_steps", with_ctes(_BASE, f"""SELECT CAST(floor(count(*) / {TRAIN_BATCH} * {float(EPOCHS)}) AS BIGINT) AS num_train_steps,
  CAST(floor(floor(count(*) / {TRAIN_BATCH} * {float(EPOCHS)}) * {WARMUP}) AS BIGINT) AS num_warmup_steps FROM spl WHERE split = 'train'"""))
def g11_plan_steps(spark, sf):
    train = split_table(spark, sf).filter(F.col("split") == "train")
    return G.plan_steps(train, TRAIN_BATCH, EPOCHS, WARMUP)


_PAIR_FEAT_SQL = _VOCAB_SQL + [
    _PAIR_LINES_SQL,
    f"""pp AS (SELECT CAST(line_no AS BIGINT) AS unique_id,
  CASE WHEN regexp_matches(s, '^(.*) \\|\\|\\| (.*)$') THEN regexp_extract(s, '^(.*) \\|\\|\\| (.*)$', 1) ELSE s END AS text_a,
  CASE WHEN regexp_matches(s, '^(.*) \\|\\|\\| (.*)$') THEN regexp_extract(s, '^(.*) \\|\\|\\| (.*)$', 2) END AS text_b
  FROM (SELECT line_no, {S.strip('line')} AS s FROM pl) _p)""",
    f"""pt AS (SELECT unique_id, {S.ws_tokens('text_a')} AS ta,
  CASE WHEN text_b IS NOT NULL AND text_b <> '' THEN {S.ws_tokens('text_b')} ELSE [] END AS tb FROM pp)""",
    f"""pk AS (SELECT unique_id, ta, tb, len(ta) AS la, len(tb) AS lb, {SEQ - 3} AS m FROM pt)""",
    f"""pc AS (SELECT unique_id,
  CASE WHEN lb = 0 THEN list_slice(ta, 1, {SEQ - 2})
       WHEN la + lb <= m THEN ta WHEN lb <= m // 2 THEN list_slice(ta, 1, m - lb)
       WHEN la <= m - m // 2 THEN ta ELSE list_slice(ta, 1, m - m // 2) END AS a,
  CASE WHEN lb = 0 THEN []
       WHEN la + lb <= m THEN tb WHEN lb <= m // 2 THEN tb
       WHEN la <= m - m // 2 THEN list_slice(tb, 1, m - la) ELSE list_slice(tb, 1, m // 2) END AS b FROM pk)""",
    """ptk AS (SELECT unique_id, CASE WHEN len(b) > 0 THEN list_concat(['[CLS]'], a, ['[SEP]'], b, ['[SEP]'])
  ELSE list_concat(['[CLS]'], a, ['[SEP]']) END AS tokens,
  CASE WHEN len(b) > 0 THEN list_concat(list_transform(range(len(a) + 2), lambda x: 0), list_transform(range(len(b) + 1), lambda x: 1))
  ELSE list_transform(range(len(a) + 2), lambda x: 0) END AS seg FROM pc)""",
    S.ids_of("ptk", ["unique_id"], "tokens", "vocab", "ids", "pid"),
    f"""pfeat AS (SELECT t.unique_id, t.tokens,
  CAST(list_concat(p.ids, list_transform(range({SEQ} - len(p.ids)), lambda x: 0)) AS INTEGER[]) AS input_ids,
  CAST(list_concat(list_transform(p.ids, lambda x: 1), list_transform(range({SEQ} - len(p.ids)), lambda x: 0)) AS INTEGER[]) AS input_mask,
  CAST(list_concat(t.seg, list_transform(range({SEQ} - len(t.seg)), lambda x: 0)) AS INTEGER[]) AS input_type_ids
  FROM ptk t JOIN pid p USING (unique_id))""",
]


def pair_feature_table(spark, sf) -> DataFrame:
    return G.pair_features(src.parse_pairs(pair_lines(spark, sf)), word_dict(spark, sf), SEQ)


@register("g12_pair_features", with_ctes(_PAIR_FEAT_SQL, "SELECT unique_id, tokens, input_ids, input_mask, input_type_ids FROM pfeat"))
def g12_pair_features(spark, sf):
    return pair_feature_table(spark, sf).select("unique_id", "tokens", "input_ids", "input_mask", "input_type_ids")


_PAIR_LABELS = """pl2 AS (SELECT unique_id, CASE WHEN text_b IS NULL THEN 'one' ELSE 'two' END AS label FROM pp),
pc2 AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM (SELECT DISTINCT label FROM pl2) _l)"""


@register("g10_pair_classification", with_ctes(_PAIR_FEAT_SQL + [_PAIR_LABELS], """SELECT f.unique_id, f.input_ids, f.input_mask,
  f.input_type_ids AS segment_ids, c.label_id AS label_ids, 1 AS is_real_example
  FROM pfeat f JOIN pl2 l USING (unique_id) JOIN pc2 c USING (label)"""))
def g10_pair_classification(spark, sf):
    """G10 for two texts: the label says whether the line held a second one."""
    pairs = src.parse_pairs(pair_lines(spark, sf))
    pairs = pairs.withColumn("label", F.when(F.col("text_b").isNull(), "one").otherwise("two"))
    f = G.classification_features(pairs, word_dict(spark, sf), G.categories(pairs), SEQ, "text_a", text_b_col="text_b")
    return f.select("unique_id", "input_ids", "input_mask", "segment_ids", "label_ids", "is_real_example")


@register("h1_epochs", with_ctes(_BASE, "SELECT doc_id, CAST(e AS INTEGER) AS epoch FROM spl, range(3) t(e) WHERE split = 'train'"))
def h1_epochs(spark, sf):
    train = split_table(spark, sf).filter(F.col("split") == "train")
    return G.epochs(train, 3).select("doc_id", "epoch")


_EPOCH_SQL = _BASE + [f"""ep AS (SELECT doc_id, CAST(e AS INTEGER) AS epoch,
  CAST(row_number() OVER (PARTITION BY e ORDER BY {S.sort_key(SEED, 'epoch', 'e', 'doc_id')}, doc_id) - 1 AS BIGINT) AS position
  FROM spl, range(3) t(e) WHERE split = 'train')"""]


def _epoch_table(spark, sf):
    train = split_table(spark, sf).filter(F.col("split") == "train").select("doc_id")
    return G.epoch_shuffle(G.epochs(train, 3), SEED, ["doc_id"])


@register("h2_epoch_shuffle", with_ctes(_EPOCH_SQL, "SELECT doc_id, epoch, position FROM ep"))
def h2_epoch_shuffle(spark, sf):
    return _epoch_table(spark, sf).select("doc_id", "epoch", "position")


@register("h3_batches", with_ctes(_EPOCH_SQL, f"""SELECT doc_id, epoch, CAST(floor(position / {TRAIN_BATCH}) AS BIGINT) AS batch_id
  FROM ep, (SELECT count(*) AS n FROM spl WHERE split = 'train') c WHERE position < n - n % {TRAIN_BATCH}"""))
def h3_batches(spark, sf):
    return G.batches(_epoch_table(spark, sf), TRAIN_BATCH, "position", True, ["epoch"]).select("doc_id", "epoch", "batch_id")


# --- TSV round trips (B4 -> A3 / A4) --------------------------------------------------

def _tsv_path(spark, sf) -> str:
    t = split_table(spark, sf).select("doc_id", "text", "label")
    return writers.write_tsv(t, spark, "labelled")


@register("b4_a4_tsv_round_trip", with_ctes(_BASE, "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, label FROM lab"))
def b4_a4_tsv_round_trip(spark, sf):
    return tables.read_tsv(spark, _tsv_path(spark, sf)).select("doc_id", "text", "label")


@register("a3_tsv_raw", with_ctes(_BASE, """SELECT CAST(doc_id AS VARCHAR) AS doc_id,
  CASE WHEN contains(text, '"') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS text, label FROM lab"""))
def a3_tsv_raw(spark, sf):
    """Written with quoting, read without: quotes stay in the text (the reference's flaw)."""
    return tables.read_tsv_raw(spark, _tsv_path(spark, sf)).select("doc_id", "text", "label")
