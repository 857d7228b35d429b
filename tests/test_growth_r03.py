"""Steps whose time, disk or memory grew faster than the input."""

import os

import pytest
from pyspark.sql import functions as F

from lexiforge.functions.text import ws_tokens
from lexiforge.operators import vocab
from lexiforge.sources import text as src


@pytest.fixture
def conf(spark):
    before = {}

    def put(key, value):
        before.setdefault(key, spark.conf.get(key))
        spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.set(key, value)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_numbered_where_they_are(spark, conf, tmp_path):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("".join(f"{i} {k}\n" for k in range(50)))
    lines = src.overall_numbers(src.read_lines(spark, str(tmp_path / "*.txt")))
    assert "SortMergeJoin" not in plan(lines)
    got = sorted((r.overall, r.line_no, r.line) for r in lines.collect())
    assert got == [(50 * i + k, k, f"{i} {k}") for i in range(3) for k in range(50)]


def test_vocabulary_lines_are_put_in_order_before_they_are_cut_into_words(spark, tmp_path):
    from lexiforge.plans import q_corpus

    rows = [(3, "c d\nc"), (1, "a b\n\na"), (None, "n"), (2, None), (3, "c e")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = q_corpus.vocab_file_lines(spark, str(tmp_path))
    p = plan(lines)
    assert "rangepartitioning(part" in p and p.index("posexplode(CASE") < p.index("rangepartitioning(part")
    got = {r.piece: r.id for r in q_corpus.a5_read_vocab(spark, str(tmp_path)).collect()}
    assert got["n"] == 0 and got["b"] == 2 and got["a"] == 3 and {got["d"], got["e"]} == {6, 7} and got["c"] == 8


def test_small_files_share_tasks(spark, conf, tmp_path):
    conf("spark.sql.files.maxPartitionBytes", "16m")
    usual = spark.conf.get(src.OPEN_COST)
    for label in ("a", "b c"):
        os.makedirs(tmp_path / label)
        for i in range(150):
            (tmp_path / label / f"{label}-{i}.txt").write_text(f"é {label}\n{i}")
    (tmp_path / "a" / "other.txt").write_text("x")
    got = src.read_labelled_folders(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(src.OPEN_COST) == usual
    assert sorted(got.collect()) == sorted((x, f"{x}-{i}.txt", f"é {x}\n{i}") for x in ("a", "b c") for i in range(150))


def test_stream_input_is_written_by_many_tasks(spark, monkeypatch):
    from lexiforge.plans import q_train
    from lexiforge.streaming import featurize

    seen = {}

    def fake(spark, source, schema, *args, max_files_per_trigger, **kwargs):
        seen.update(files=sum(f.startswith("part-") for f in os.listdir(source.removeprefix("file:"))), batch=max_files_per_trigger,
                    rows=spark.read.parquet(source).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("_metadata.file_path").alias("f")).select("n", "f").distinct().collect())
        raise InterruptedError

    monkeypatch.setattr(featurize, "featurize_stream", fake)
    with pytest.raises(InterruptedError):
        q_train.l1_featurize_stream(spark, "/root/testdata/sf0.001")
    assert seen["files"] > 4 and seen["batch"] * 4 >= seen["files"] and seen["rows"] == [(2, 2)]


def test_token_vectors_are_compressed_on_disk(spark, tmp_path):
    from lexiforge.sinks import writers
    from lexiforge.sources import tables

    df = spark.range(200).select(F.col("id").alias("linex_index"), F.expr(
        "transform(sequence(1, 20), t -> named_struct('token', concat('t', t), 'layers', array(named_struct('index', -1, 'values', array(rand(7), id / 3D)))))").alias("features"))
    df = spark.createDataFrame(df.collect(), tables.TOKEN_VECTOR_SCHEMA)
    path = writers.write_token_vectors(df, spark, path=str(tmp_path / "v"))
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
    assert sorted(tables.read_token_vectors(spark, path).collect()) == sorted(df.collect())


def test_words_are_counted_by_batch(spark):
    rows = [("a  B\tb\r\n c",), (None,), ("",), (" \f ",), ("İ ΑΣ b\x0bc a",), ("é　x y a ",)]
    df = spark.createDataFrame(rows, "line string")
    for lower in (True, False):
        got = vocab.word_counts(df, "line", lower)
        old = df.select(F.explode(ws_tokens("line", lower)).alias("word")).groupBy("word").count()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, old.collect()))
    assert "MapInArrow" in plan(got) and "explode" not in plan(got)
