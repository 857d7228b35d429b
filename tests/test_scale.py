"""What a job writes and moves: tables of compressed columns, no grouping by pair, no documents where words are counted."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.operators import documents, sequences
from lexiforge.session import ensure_checkpoint_dir


def stored(spark) -> int:
    path = re.sub("^file:", "", ensure_checkpoint_dir(spark))
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_document_assembly_writes_less_than_its_text(spark):
    text = F.concat_ws(" ", *[F.concat(F.lit(w), (F.col("id") * (i + 7) % 9973).cast("string")) for i, w in enumerate(["some", "word", "or", "other", "is", "here"])])
    lines = spark.range(20000).select((F.col("id") % 50).alias("part"), F.lit("").alias("file"), F.floor(F.col("id") / 50).alias("line_no"), text.alias("line"))
    size = lines.agg(F.sum(F.length("line"))).first()[0]
    before = stored(spark)
    assert documents.to_documents(lines).where(F.size("tokens") == F.col("n_tokens")).count() == 20000
    assert stored(spark) - before < size


@pytest.mark.parametrize("M", [13, 40])
def test_pairs_equal_brute_force_without_grouping(spark, M):
    """Chunks and random B that go on in the next block of their document, and at its end."""
    rng = np.random.default_rng(3)
    docs = [[rng.integers(0, 1000, n).tolist() for n in rng.integers(1, 4, k)] for k in (1, 2, M - 1, M, M + 1, 2 * M, 5 * M + 3)]
    s = spark.createDataFrame([(d, i, x, len(x)) for d, sents in enumerate(docs) for i, x in enumerate(sents)], "doc_index long, sent_no long, ids array<int>, n_tokens int")
    table = spark.createDataFrame([(d, len(x)) for d, x in enumerate(docs)], "doc_index long, n_sent long")
    rows = [r for d, sents in enumerate(docs) for r in sequences.walk_document(np.array([len(x) for x in sents]), d, 3, len(docs), 5, M, 0.3)]
    plan = spark.createDataFrame([tuple(None if v is None else v if isinstance(v, bool) else int(v) for v in r) for r in rows], sequences.PLAN_SCHEMA)
    got = sequences.assemble_pairs(plan, s, table, 5, max_target=M)
    assert not re.search(r"Aggregate \[[^\]]*\brep#", plan_of(got))
    pairs = {(r.rep, r.doc_index, r.start): (r.ids_a, r.ids_b) for r in got.collect()}
    assert len(pairs) == len(rows)
    for rep, doc, start, end, cut, rand, other, _, tb in rows:
        a, b = sum(docs[doc][start:start + cut], []), sum(docs[doc][start + cut:end + 1], [])
        if rand:
            b, at = [], sequences.py_randint(0, len(docs[other]) - 1, 5, "rstart", rep, doc, start)
            while not b or (len(b) < tb and at < len(docs[other])):
                b, at = b + docs[other][at], at + 1
        assert pairs[rep, doc, start] == (a, b)


def test_word_dictionary_puts_no_documents_together(spark, tmp_path):
    """The vocabulary of the sentences, also of lines with white space of other kinds and texts without a key."""
    from lexiforge.operators import vocab
    from lexiforge.plans import q_corpus as Q

    rows = [(1, "One two　\n two three. Three"), (1, "one"), (2, " \n.x gone"), (None, "lost words"), (3, None), (4, "a　b  one\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = stored(spark)
    got = vocab.vocab_tables(Q.sentence_vocab(spark, str(tmp_path)))
    assert stored(spark) == before
    assert got == vocab.vocab_tables(Q.doc_vocab(spark, str(tmp_path), Q.doc_sentences(spark, str(tmp_path))))
    assert "two" in got[0] and "lost" not in got[0]


def test_documents_put_together_without_writing_their_lines(spark, tmp_path):
    """The pretraining job writes the columns that it reads, and no copy of the lines."""
    from lexiforge.plans import q_corpus as Q
    from lexiforge.plans import q_sequences as P

    spark.createDataFrame([(i, f"some words. more words {i}\n\nother words here") for i in range(30)], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    tables = os.path.join(re.sub("^file:", "", ensure_checkpoint_dir(spark)), "tables")
    before = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    assert P._plan(spark, str(tmp_path))[3].count() > 0
    new = sorted(set(os.listdir(tables)) - before)
    assert not [n for n in new if n.startswith("lines-")]
    [sentences] = [n for n in new if n.startswith("sentences-")]
    assert spark.read.parquet(os.path.join(tables, sentences)).columns == Q.SENTENCE_TOKENS


def test_texts_of_one_key_keep_all_their_sentences(spark):
    """Lines of equal numbers, blank in one text only, are counted and numbered in the same order."""
    rows = [(7, "", n, f"w{t} {n}" if (t + n) % 3 else "") for t in range(40) for n in range(25)]
    lines = spark.createDataFrame(rows, "part long, file string, line_no long, line string")
    for again in (False, True):
        s = documents.to_documents(lines.repartition(5), again=again).select("doc_key", "sent_no", "sentence").collect()
        assert sorted(r["sentence"] for r in s) == sorted(r[3] for r in rows if r[3])
        by_doc = {}
        for r in s:
            by_doc.setdefault(r["doc_key"], []).append(r["sent_no"])
        assert all(sorted(v) == list(range(len(v))) for v in by_doc.values())


def test_token_lookups_on_odd_arrays(spark):
    """Null and empty arrays, null and unknown tokens keep their place."""
    from lexiforge.operators import vocab

    rows = [(0, ["a", "x", None]), (1, None), (2, []), (3, ["b", "b"])]
    df = spark.createDataFrame(rows, "k int, t array<string>").coalesce(1)
    ids = vocab.tokens_to_ids(F.col("t"), {"a": 3, "b": 1})
    got = df.select("k", ids.alias("i")).orderBy("k").collect()
    assert [r["i"] for r in got] == [[3, 0, 0], None, [], [1, 1]]
    back = spark.createDataFrame([(0, [3, 0, 9, -1, None]), (1, None), (2, [])], "k int, i array<int>").coalesce(1)
    back = back.select("k", vocab.ids_to_tokens(F.col("i"), {"a": 3, "b": 1}).alias("t")).orderBy("k").collect()
    assert [r["t"] for r in back] == [["a", "<unk>", "<unk>", "<unk>", "<unk>"], None, []]
