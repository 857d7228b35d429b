"""Hand-made cases: reader and check behaviour that the test tables do not show."""

import os

import pytest
from pyspark.sql import functions as F

from line_tables import lines_df
from lexiforge.functions.text import ltrim_spaces, rtrim_spaces
from lexiforge.operators import clean, metrics, vocab
from lexiforge.sources import tables
from lexiforge.sources import text as src


def lines_of(df):
    return [r.line for r in df.orderBy("line_no").collect()]


def test_title_is_the_next_line_that_is_not_empty(spark):
    raw = ["<doc id=1>", "", "body1", "body2", "</doc>", "<doc id=2>", "<doc id=3>", "kept", "<doc id=4>", "", "", "title", "x"]
    assert lines_of(clean.first_pass(lines_df(spark, raw))) == ["body2", "", "kept", "x"]


def test_pairs_keep_text_around_odd_line_ends(spark):
    odd = ["a\rb ||| c d", "x\x85y ||| z ||| w\r v", "no delimiter\r here", ""]
    got = [(r.text_a, r.text_b) for r in src.parse_pairs(lines_df(spark, odd)).orderBy("unique_id").collect()]
    assert got == [("a\rb", "c d"), ("x\x85y ||| z", "w\r v"), ("no delimiter\r here", None), ("", None)]


def test_folder_names_come_back_as_they_are(spark, tmp_path):
    for label in ("it life", "50% off", "a+b", "話題"):
        (tmp_path / label).mkdir()
        (tmp_path / label / f"{label}-1.txt").write_text("one\ntwo\n")
        (tmp_path / label / "LICENSE.txt").write_text("no")
    got = sorted((r.label, r.file_name, r.content) for r in src.read_labelled_folders(spark, str(tmp_path)).collect())
    assert got == sorted((x, f"{x}-1.txt", "one\ntwo\n") for x in ("it life", "50% off", "a+b", "話題"))


def test_length_check_runs_whichever_column_is_used(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 3, 4, 5])], "a array<int>, b array<int>")
    assert clean.check_seq_len(df, ["b"], 5).select("b").count() == 1
    for use in ("a", "b"):
        checked = clean.check_seq_len(df, ["a", "b"], 5 if use == "a" else 3)
        with pytest.raises(Exception, match="has not length"):
            checked.select(use).collect()
    with pytest.raises(Exception, match="has not length"):
        clean.check_seq_len(spark.createDataFrame([(None,)], "a array<int>"), ["a"], 5).collect()


def test_positions_of_one_table_only_are_an_error(spark):
    three = spark.createDataFrame([(i, f"l{i}") for i in range(3)], "row_id long, label string")
    assert metrics.join_by_position(three.select("row_id"), three).count() == 3
    for preds in (three.where("row_id < 2"), three.union(spark.createDataFrame([(9, "x")], three.schema))):
        with pytest.raises(Exception, match="only one table"):
            metrics.join_by_position(preds.select("row_id"), three).collect()


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    want = [f"line {i} " + "x" * (i % 97) + ("\r" if i % 5 == 0 else "") for i in range(20_000)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "big one.txt").write_bytes("\n".join(want).encode())
    (tmp_path / "a" / "empty").write_bytes(b"")
    (tmp_path / "a" / "zz").write_bytes(b"last\n\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        lines = src.read_lines(spark, str(tmp_path / "a"))
        assert spark.read.text(str(tmp_path / "a")).rdd.getNumPartitions() > 8
        got = lines.collect()
        all_ = src.overall_numbers(lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    big = {r.line_no: r.line for r in got if r.file.endswith("big one.txt")}
    assert [big[i] for i in range(len(want))] == want and len(got) == len(want) + 2
    assert [r.line for r in sorted(all_, key=lambda r: r.overall)] == [*want, "last", ""]


def test_vocabulary_file(spark, tmp_path):
    (tmp_path / "v").write_text("▁a\t-1.5\nb\t-2\n▁a\t-3\n")
    v = tables.read_vocab(spark, str(tmp_path / "v"))
    assert vocab.vocab_dict(v) == {"▁a": 2, "b": 1}


def test_trims_only_ascii_spaces(spark):
    df = spark.createDataFrame([("  a b \t  ",), ("　 x　 ",), ("   ",)], "s string")
    assert [tuple(r) for r in df.select(ltrim_spaces("s"), rtrim_spaces("s")).collect()] == [
        ("a b \t  ", "  a b \t"), ("　 x　 ", "　 x　"), ("", "")]


def best_score(word, scores):
    best = [0.0] + [float("-inf")] * len(word)
    for j in range(1, len(word) + 1):
        best[j] = max([best[i] + scores[word[i:j]] for i in range(j) if word[i:j] in scores], default=float("-inf"))
    return best[-1]


def test_unigram_keeps_all_characters_and_splits_best(spark):
    text = [(" ".join(chr(0x3042 + i) + chr(0x3042 + (i * 7) % 80) for i in range(80)),)] + [("low lower lowest newest widest " * 5,)] * 6
    s = spark.createDataFrame(text, "sentence string")
    chars = set("".join(t for t, in text)) - {" "} | {"▁"}
    v = vocab.train_unigram(s, size=len(chars) + 40).cache()
    scores = {r.piece: r.score for r in v.collect()}
    assert chars <= set(scores) and len(scores) == len(chars) + 40
    with pytest.raises(ValueError, match="distinct characters"):
        vocab.train_unigram(s, size=len(chars))
    got = s.distinct().select("sentence", vocab.tokenize_subword(F.col("sentence"), v).alias("p")).collect()
    for r in got:
        assert "".join(r.p) == "".join("▁" + w for w in r.sentence.split())
        total = sum(scores[p] for p in r.p)
        assert total == pytest.approx(sum(best_score("▁" + w, scores) for w in r.sentence.split()))


def test_long_pieces_are_used(spark):
    v = spark.createDataFrame([("▁internationalization", -1.0, 7), *[(c, -5.0, 8 + i) for i, c in enumerate("▁internatiolz")]], "piece string, score double, id int")
    s = spark.createDataFrame([("internationalization",)], "t string")
    assert s.select(vocab.tokenize_subword(F.col("t"), v)).first()[0] == ["▁internationalization"]


def test_replayed_batch_replaces_its_rows(spark, tmp_path):
    from lexiforge.operators import datasets as G
    from lexiforge.streaming.featurize import featurize_stream, stream_paths

    lab = spark.createDataFrame([(i, "a b c", "x") for i in range(20)], "doc_id long, text string, label string")
    base = str(tmp_path / "s")
    source, out, chk = stream_paths(base)
    lab.repartition(3).write.parquet(source)
    d = {p: i for i, p in enumerate([*vocab.RESERVED, "a", "b", "c"])}

    def run():
        featurize_stream(spark, source, lab.schema, out, chk, d, G.categories(lab), 8)

    run()
    assert spark.read.parquet(out).count() == 20
    commits = os.path.join(chk, "commits")
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):  # as if the driver had died before the commit
        os.remove(os.path.join(commits, f))
    run()  # the last batch runs again
    assert spark.read.parquet(out).count() == 20


def test_subword_records_hold_what_the_pieces_say(spark):
    """Lengths are fixed, masked labels restore the pieces, and pieces rebuild the words."""
    from lexiforge.plans import q_corpus as Q
    from lexiforge.plans.pretraining import PretrainingConfig, build_pretraining

    s = Q.doc_sentences(spark, "/root/testdata/sf0.001").where("doc_key < 20")  # whole documents
    s = s.select("doc_key", "sent_no", "sentence")
    v = vocab.train_unigram(s, size=600).cache()
    pieces = s.select("doc_key", "sent_no", "sentence", vocab.tokenize_subword(F.col("sentence"), v).alias("tokens")).cache()
    words = {"".join("▁" + w for w in vocab.normalize_text(r.sentence, True).split("▁")[1:]) for r in pieces.collect()}
    assert {"".join(r.tokens) for r in pieces.collect()} == words
    records = build_pretraining(pieces.drop("sentence").withColumn("n_tokens", F.size("tokens")), v, PretrainingConfig(dupe_factor=2)).collect()
    name = {r.id: r.piece for r in v.collect()}
    known = [t for r in pieces.orderBy("doc_key", "sent_no").collect() for t in r.tokens]
    runs = {tuple(known[i : i + 2]) for i in range(len(known) - 1)}
    assert records
    unknown = total = 0
    for r in records:
        assert len(r.input_ids) == len(r.input_mask) == len(r.segment_ids) == 128 and len(r.masked_lm_positions) == 20
        ids, n = list(r.input_ids), sum(r.input_mask)
        for p, i, w in zip(r.masked_lm_positions, r.masked_lm_ids, r.masked_lm_weights):
            if w:
                ids[p] = i
        back = [name[i] for i in ids[:n]]
        assert back[0] == "[CLS]" and back[-1] == "[SEP]" and back.count("[SEP]") == 2
        a = back[1 : back.index("[SEP]")]
        assert "<unk>" in a or all(pair in runs for pair in zip(a, a[1:]))
        unknown, total = unknown + ids[:n].count(0), total + n
    assert unknown < 0.02 * total


def test_reports_agree_with_sql_over_the_stored_predictions(spark):
    """K4, K5: every figure of the reports again in DuckDB, from the predictions themselves."""
    import duckdb

    from lexiforge.operators import baseline, datasets
    from pyspark.ml.functions import array_to_vector

    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    split = datasets.split_226(datasets.shuffle_rows(e, 5, ["vec_id"]))
    model, _ = baseline.train_head(split.where("split <> 'test'"))
    test = split.where("split = 'test'").withColumn("_features", array_to_vector(F.col("embedding").cast("array<double>")))
    pred = model.transform(test).select(F.col("label").cast("string").alias("label"), F.col("prediction").cast("int").cast("string").alias("predict"))
    p = pred.toPandas()  # noqa: F841  (read by the SQL)
    rows = duckdb.sql("""SELECT c AS class, coalesce(sum((label = c AND predict = c)::INT) / nullif(sum((predict = c)::INT), 0), 0) AS p,
        coalesce(sum((label = c AND predict = c)::INT) / nullif(sum((label = c)::INT), 0), 0) AS r, sum((label = c)::INT) AS n
        FROM p, (SELECT label AS c FROM p UNION SELECT predict FROM p) GROUP BY c""").fetchall()
    got = {r["class"]: r for r in metrics.classification_report(pred).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, precision, recall, n in rows:
        assert got[c].precision == pytest.approx(precision) and got[c].recall == pytest.approx(recall) and got[c].support == n
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0
        assert got[c].f1 == pytest.approx(f1)


def test_boosted_trees_beat_the_majority(spark):
    """K3 on terms that carry the label, with sparse rows, and a row without any term."""
    from lexiforge.operators import baseline

    rows = [(i, ("good fine nice " if i % 3 else "bad poor ugly ") + f"filler{i % 7}", "train" if i % 5 else "dev", float(i % 3 > 0)) for i in range(150)] + [(999, "", "train", 1.0)]
    df = spark.createDataFrame(rows, "k long, text string, split string, label_index double").withColumn("is_validation", F.col("split") == "dev")
    model = baseline.fit_tfidf(df, "k", max_features=12)
    assert model.count() == 12
    x = baseline.sparse_features(baseline.transform_tfidf(df, model, "k"), df, "k", 12)
    assert x.where("k = 999").first().features.numNonzeros() == 0
    fit = baseline.train_baseline(x, max_iter=5)
    assert fit.transform(x).where("prediction = label_index").count() >= 149


def test_substrings_of_long_words(spark):
    """Every substring of up to four characters counts, also across the blocks of a long word."""
    from collections import Counter

    rows = [("abcabc", 2), ("x", 5), ("".join("abcd"[i * i % 4] for i in range(2500)), 1)]
    want = Counter()
    for w, n in rows:
        w = "▁" + w
        for i in range(len(w)):
            for k in range(1, min(4, len(w) - i) + 1):
                want[w[i : i + k]] += n
    got = vocab.candidate_substrings(spark.createDataFrame(rows, "word string, n long"), max_len=4).collect()
    assert {r.piece: r.n for r in got} == want
