"""Hand-made edge cases of FIXTURES.md, one test per row."""

import os

import pytest
from pyspark.sql import functions as F

from line_tables import lines_df
from lexiforge.functions.text import infer_value, strip_unicode
from lexiforge.operators import clean, datasets, documents, masking, metrics, sequences, vectors, vocab
from lexiforge.sources import tables, text as src


def col(df, c):
    return [r[c] for r in df.collect()]


def test_c2_header_and_title_dropped(spark):
    out = clean.first_pass(lines_df(spark, ["<doc id=1>", "title", "body"]))
    assert col(out.orderBy("line_no"), "line") == ["body"]


def test_c4_d1_space_line_is_document_boundary(spark):
    c = clean.clean_corpus(lines_df(spark, ["a", "   ", "b"]), lower=False)
    s = documents.to_documents(c)
    rows = s.orderBy("doc_key").select("doc_key", "sentence").collect()
    assert [r.sentence for r in rows] == ["a", "b"]
    assert rows[0].doc_key != rows[1].doc_key


C5_IN = "あ。い。」う。。え。 お。"


def test_c5_consuming_sentence_break(spark):
    out = clean.split_sentences(lines_df(spark, [C5_IN]))
    assert col(out.orderBy("sub_no"), "line") == ["あ。", "い。」う。", "。え。", " お。"]


def test_c7_line_starting_with_delimiter_dropped(spark):
    out = clean.drop_leading_delim(clean.split_sentences(lines_df(spark, [C5_IN])))
    assert col(out.orderBy("sub_no"), "line") == ["あ。", "い。」う。", " お。"]


def test_c9_strip_unicode(spark):
    df = spark.createDataFrame([("　 a 　",)], "t string")
    assert df.select(strip_unicode("t").alias("s")).first().s == "a"


def test_c13_infer_value(spark):
    df = spark.createDataFrame([("gelu",), ("768",), ("0.1",), ("-1",)], "v string")
    got = [(r.t.kind, r.t.str_value, r.t.int_value, r.t.float_value) for r in df.select(infer_value("v").alias("t")).collect()]
    assert got == [("str", "gelu", None, None), ("int", None, 768, None), ("float", None, None, 0.1),
                   ("float", None, None, -1.0)]


def test_a3_a4_quoted_cell(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text('text\tlabel\n"he said ""x"""\ta\n', encoding="utf-8")
    assert tables.read_tsv_raw(spark, str(p)).first().text == '"he said ""x"""'
    assert tables.read_tsv(spark, str(p)).first().text == 'he said "x"'


def test_a5_last_duplicate_wins(spark, tmp_path):
    p = tmp_path / "v.vocab"
    lines = [f"p{i}\t0" for i in range(10)]
    lines[3] = "dup\t0"
    lines[9] = "dup\t0"
    p.write_text("\n".join(lines) + "\n", encoding="utf-8")
    d = vocab.vocab_dict(tables.read_vocab(spark, str(p)))
    assert d["dup"] == 9


def test_a6_pairs(spark):
    df = spark.createDataFrame([(0, "a ||| b ||| c"), (1, "")], "line_no long, line string")
    rows = src.parse_pairs(df).orderBy("unique_id").collect()
    assert (rows[0].text_a, rows[0].text_b) == ("a ||| b", "c")
    assert (rows[1].text_a, rows[1].text_b) == ("", None)


def test_d1_documents_span_files(spark, tmp_path):
    (tmp_path / "f1.txt").write_text("one\ntwo\n", encoding="utf-8")
    (tmp_path / "f2.txt").write_text("three\n\nfour\n", encoding="utf-8")
    lines = src.read_lines(spark, str(tmp_path / "*.txt"))
    s = documents.to_documents(lines)
    docs = {}
    for r in s.collect():
        docs.setdefault(r.doc_key, []).append((r.sent_no, r.sentence))
    got = sorted([x for _, x in sorted(v)] for v in docs.values())
    assert got == [["four"], ["one", "two", "three"]]


def test_e4_unknown_token_is_zero(spark):
    df = spark.createDataFrame([(["a", "zz"],)], "t array<string>")
    assert df.select(vocab.tokens_to_ids(F.col("t"), {"a": 7}).alias("i")).first().i == [7, 0]


def test_f2_one_sentence_document_is_random_next():
    rows = sequences.walk_document([5], 0, 1, 3, 1, 125, 0.0)
    assert len(rows) == 1 and rows[0][5] is True


def test_f5_single_document_corpus_draws_itself():
    rows = sequences.walk_document([5, 6, 7], 0, 2, 1, 1, 125, 0.0)
    assert all(r[6] == 0 for r in rows if r[5])


def test_f9_closed_form(spark):
    df = spark.createDataFrame([(list(range(5)), list(range(3)), 6), (list(range(2)), list(range(9)), 6),
                                (list(range(9)), list(range(9)), 5)], "a array<int>, b array<int>, m int")
    got = []
    for r, m in zip(df.collect(), [6, 6, 5]):
        one = spark.createDataFrame([(r.a, r.b)], "a array<int>, b array<int>")
        a, b = sequences.truncate_pair("a", "b", m)
        x = one.select(F.size(a).alias("la"), F.size(b).alias("lb")).first()
        got.append((x.la, x.lb))
    assert got == [(3, 3), (2, 4), (3, 2)]


def test_f12_mask(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],)], "t array<int>")
    assert df.select(sequences.mask_of(F.col("t"), 8).alias("m")).first().m == [1, 1, 1, 1, 1, 0, 0, 0]


def test_f14_number_to_mask(spark):
    df = spark.createDataFrame([(10,), (30,), (50,), (200,)], "n int")
    got = col(df.select(masking.num_to_mask(F.col("n"), 0.15, 20).alias("k")), "k")
    assert got == [2, 4, 8, 20]


def test_g4_split_sizes(spark):
    df = spark.range(11).withColumnRenamed("id", "row_index")
    s = datasets.split_226(df)
    c = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert c == {"test": 2, "dev": 2, "train": 7}


def test_g7_unknown_label_is_error(spark):
    df = spark.createDataFrame([("x",)], "label string")
    labels = spark.createDataFrame([("a", 0)], "label string, label_id int")
    with pytest.raises(Exception):
        datasets.encode_label(df, labels).collect()


def test_g9_pad_to_batch(spark):
    f = spark.range(10).select(F.col("id").alias("row_index"), F.array_repeat(F.lit(1), 4).alias("input_ids"),
                               F.array_repeat(F.lit(1), 4).alias("input_mask"), F.array_repeat(F.lit(0), 4).alias("segment_ids"),
                               F.lit(1).alias("label_ids"), F.lit(1).alias("is_real_example"))
    p = datasets.pad_to_batch(f, 8, 4)
    assert p.count() == 16 and p.filter("is_real_example = 0").count() == 6


def test_g11_steps(spark):
    r = datasets.plan_steps(spark.range(100), 32, 3, 0.1).first()
    assert (r.num_train_steps, r.num_warmup_steps) == (9, 0)


def test_h3_drop_last(spark):
    b = datasets.batches(spark.range(10).withColumnRenamed("id", "i"), 4, "i", True)
    assert b.count() == 8 and b.select("batch_id").distinct().count() == 2


def test_i10_first_max(spark):
    df = spark.createDataFrame([([0.1, 0.5, 0.5],)], "p array<double>")
    assert df.select(metrics.argmax("p").alias("k")).first().k == 1


def test_i14_never_predicted_class(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "label string, predict string")
    r = {x["class"]: x for x in metrics.classification_report(df).collect()}
    assert r["b"].precision == 0.0 and r["b"].f1 == 0.0


def test_i16_zero_column_kept(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "label string, predict string")
    m = metrics.confusion_matrix(df)
    assert set(m.columns) == {"actual", "p_a", "p_b"}
    assert {r.actual: (r.p_a, r.p_b) for r in m.collect()} == {"a": (1, 0), "b": (1, 0)}


def test_j2_padding_left_out(spark):
    layers = [[[1.0, 2.0], [3.0, 4.0], [0.0, 0.0]]]  # one layer, three positions, the last is padding
    df = spark.createDataFrame([(0, ["[CLS]", "x"], layers)], "id long, tokens array<string>, l array<array<array<double>>>")
    r = vectors.token_vectors(df, "id", "tokens", "l", [-1]).first()
    assert [f.token for f in r.features] == ["[CLS]", "x"]
    assert r.features[1].layers[0]["values"] == [3.0, 4.0]


def test_a2_labelled_folders_from_disk(spark, tmp_path):
    for cat, names in {"news": ["news1.txt", "news2.txt", "other.txt"], "sport": ["sport9.txt"]}.items():
        (tmp_path / cat).mkdir()
        for n in names:
            (tmp_path / cat / n).write_text(f"http://x/{n}\n2020-01-01\n  body {n} \n\nmore\t{n}\n", encoding="utf-8")
    files = src.read_labelled_folders(spark, str(tmp_path))
    got = sorted((r.label, r.file_name) for r in files.collect())
    assert got == [("news", "news1.txt"), ("news", "news2.txt"), ("sport", "sport9.txt")]
    t = {r.file_name: r.text for r in src.labelled_texts(files).collect()}
    assert t["news1.txt"] == "body news1.txtmore　news1.txt"


def test_b1_shards_round_robin_and_order(spark):
    from lexiforge.sinks import writers

    df = spark.range(103).select(F.col("id").alias("inst_index"), (F.col("id") % 4).cast("int").alias("shard"),
                                 F.array(F.col("id").cast("int")).alias("input_ids"))
    path = writers.write_pretraining(df, spark, "shards-test")
    back = spark.read.parquet(path)
    assert dict(back.groupBy("shard").count().collect()) == {0: 26, 1: 26, 2: 26, 3: 25}
    assert dict(back.dtypes)["input_ids"] == "array<bigint>"
    one = spark.read.parquet(f"{path}/shard=1").withColumn("_f", F.input_file_name())
    rows = [r.inst_index for r in one.collect()]
    assert sorted(rows) == list(range(1, 103, 4))
    files = sorted({r._f for r in one.collect()})
    in_order = []
    for f in files:
        in_order += [r.inst_index for r in spark.read.parquet(f).collect()]
    assert in_order == sorted(in_order)
