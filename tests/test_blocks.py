"""Cleaning and document assembly over blocks of a file's lines: any block size gives the same rows,
and one large file is many tasks."""

import random

import pytest
from line_tables import lines_df
from pyspark.sql import functions as F

from lexiforge.operators import clean, documents


def raw(seed, n):
    """Lines with runs of headers, empty lines, lines of spaces and texts of several sentences."""
    rng = random.Random(seed)
    kinds = ["<doc id=1>", "<doc id=2>", "", "   ", "a b. c d! e", "</doc>", "word", "x.", " y z"]
    return [rng.choice(kinds) for _ in range(n)]


def brute_headers(lines):
    """The range rule line by line: a line with ``<doc id`` opens, the next line that is not empty closes."""
    out, inside = [], False
    for t in lines:
        if t == "":
            continue
        if inside:
            inside = False
        elif "<doc id" in t:
            inside = True
        else:
            out.append(t)
    return out


def files(spark, sizes=(60, 1, 33)):
    df = None
    for k, n in enumerate(sizes):
        d = lines_df(spark, raw(k, n), part=k, file=f"f{k}")
        df = d if df is None else df.unionByName(d)
    return df


@pytest.mark.parametrize("block", [1, 2, 3, 7, clean.BLOCK_LINES])
def test_headers_do_not_depend_on_blocks(spark, block):
    sizes = (60, 1, 33)
    got = clean.drop_doc_header(files(spark, sizes), block).orderBy("part", "line_no").collect()
    for k, n in enumerate(sizes):
        assert [r.line for r in got if r.part == k] == brute_headers(raw(k, n))


@pytest.mark.parametrize("block", [1, 4, 9])
def test_numbers_and_documents_do_not_depend_on_blocks(spark, block):
    split = clean.split_sentences(clean.first_pass(files(spark)), ".!").cache()
    want = clean.renumber(split).orderBy("part", "line_no").collect()
    assert clean.renumber(split, block).orderBy("part", "line_no").collect() == want
    for k in range(3):
        assert [r.line_no for r in want if r.part == k] == list(range(sum(r.part == k for r in want)))
    cols = ["doc_key", "sent_no", "part", "file", "line_no", "sentence", "tokens", "n_tokens"]
    docs = documents.to_documents(clean.renumber(split)).select(*cols).orderBy(*cols[:2]).collect()
    assert documents.to_documents(clean.renumber(split, block), block=block).select(*cols).orderBy(*cols[:2]).collect() == docs
    # The rule line by line: an empty line ends a document, wherever it stands.
    key, n, brute = 0, 0, []
    for r in want:
        t = r.line.strip()
        if not t:
            key, n = key + 1, 0
        elif t.split():
            brute.append((key, n, t))
            n += 1
    assert [(r.doc_key, r.sent_no, r.sentence) for r in docs] == brute


def test_one_large_file_is_many_tasks(spark):
    lines = spark.range(40_000).select(F.lit(0).cast("long").alias("part"), F.lit("big").alias("file"), F.col("id").alias("line_no"),
                                       F.when(F.col("id") % 50 == 0, "").otherwise(F.concat(F.lit("w "), F.col("id").cast("string"))).alias("line"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = clean.renumber(lines.withColumn("sub_no", F.lit(0)), 1000).withColumn("task", F.spark_partition_id())
        per = [r["count"] for r in out.groupBy("task").count().collect()]
        assert sum(per) == 40_000 and len(per) >= 4 and max(per) < 30_000
        docs = documents.to_documents(lines, block=1000)
        assert docs.count() == 39_200 and docs.agg(F.countDistinct("doc_key")).first()[0] == 800
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "part long, file string, line_no long, line string")
    assert clean.clean_corpus(none).count() == 0 and documents.to_documents(none).count() == 0
