"""Training-sequence construction.

Planner (F1-F5, F7): the reference's per-document loop only carries the first
sentence of the current chunk, so it is replayed on sentence lengths
alone (no tokens pass through Python). Every random choice is keyed by
(seed, purpose, repeat, document, chunk start), so the plan is the same whatever
the partitioning and can be recomputed by the SQL oracle. Documents of any size take one path: they are
planned block by block, and where the loop enters a block comes from a table of the exits of the
blocks before it (see ``plan_chunks``); a document of one block has none before.

Assembly (F6, F8-F12) is joins on exact (document, sentence) keys plus array
functions; nothing is collected.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.rng import py_randint, py_u

PLAN_SCHEMA = ("rep int, doc_index long, start long, end long, cut long, is_random_next boolean, "
               "other_doc long, target long, target_b long")
OTHER_DRAWS = 10  # Fixed value: tries to find a random document other than the current one


def target_length(seed: int, rep, doc, max_num_tokens: int, short_seq_prob: float) -> int:
    """one target per (repeat, document)."""
    if py_u(seed, "short", rep, doc) < short_seq_prob:
        return py_randint(2, max_num_tokens, seed, "target", rep, doc)
    return max_num_tokens


def _step(P: list[int], base: int, n_total: int, doc: int, rep: int, T: int, s: int, n_docs: int,
          seed: int) -> tuple[tuple, int]:
    """One chunk of the document loop starting at sentence ``s``: its plan row and the
    next start. ``P`` holds prefix sums of sentence lengths from sentence ``base`` on
    and must reach at least ``T`` sentences past ``s`` (or the document end)."""
    k = bisect_left(P, P[s - base] + T) + base
    end = min(max(k - 1, s), n_total - 1)
    nchunk = end - s + 1
    cut = 1 if nchunk == 1 else py_randint(1, nchunk - 1, seed, "cut", rep, doc, s)
    rand = nchunk == 1 or py_u(seed, "next", rep, doc, s) < 0.5
    if rand:
        # first of the keyed draws that is not this document, else the last draw;
        # later draws are only computed when needed (same result as drawing all)
        for k2 in range(OTHER_DRAWS):
            other = py_randint(0, n_docs - 1, seed, "other", rep, doc, s, k2)
            if other != doc:
                break
        tb = T - (P[s + cut - base] - P[s - base])
        return (rep, doc, s, end, cut, True, other, T, tb), s + cut
    return (rep, doc, s, end, cut, False, None, T, None), end + 1


def _next_start(P, base, n_total, doc, rep, T, s, n_docs, seed) -> int:
    """Only the successor of start ``s`` (no draws for the other document)."""
    k = bisect_left(P, P[s - base] + T) + base
    end = min(max(k - 1, s), n_total - 1)
    nchunk = end - s + 1
    if nchunk == 1:
        return s + 1
    cut = py_randint(1, nchunk - 1, seed, "cut", rep, doc, s)
    return s + cut if py_u(seed, "next", rep, doc, s) < 0.5 else end + 1


def walk_document(lens: np.ndarray, doc: int, reps: int, n_docs: int, seed: int, max_num_tokens: int,
                  short_seq_prob: float) -> list[tuple]:
    """F1-F5, F7 for one document in one step: the loop as it is defined, for documents at hand."""
    n = len(lens)
    P = [0, *accumulate(np.asarray(lens).tolist())]
    rows = []
    for rep in range(reps):
        T = target_length(seed, rep, doc, max_num_tokens, short_seq_prob)
        s = 0
        while s < n:
            row, s = _step(P, 0, n, doc, rep, T, s, n_docs, seed)
            rows.append(row)
    return rows


BLOCK_SENTENCES = 1 << 16  # sentences of a document that one step plans

PLAN_COLS = ["rep", "doc_index", "start", "end", "cut", "is_random_next", "other_doc", "target", "target_b"]


PLAN = pa.schema([(c, pa.int32() if c == "rep" else pa.bool_() if c == "is_random_next" else pa.int64()) for c in PLAN_COLS])
EXITS = pa.schema([("rep", pa.int32()), ("doc_index", pa.int64()), ("block", pa.int64()), ("exits", pa.list_(pa.int64()))])


@dataclass
class Block:
    """A block of a document: the prefix sums of its sentence lengths, and of as many sentences after
    it as a chunk that starts in it can reach."""

    doc: int
    number: int
    n_total: int
    base: int
    stop: int
    P: list[int]
    entries: list[int] | None = None  # where the loop enters it in each repeat, if not at its first sentence


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[Block]:
    """Each block of a sorted partition; one cut by a batch edge is carried on. Rows before the first sentence are the
    entries, the last repeat first: their ``n_sent`` is the sentence."""
    names = ("doc_index", "block", "sent_no", "n_tokens", "n_sent")
    rest: list[np.ndarray] | None = None

    def made(cols: list[np.ndarray], lo: int, hi: int) -> Block:
        doc, number = int(cols[0][lo]), int(cols[1][lo])
        entries = cols[4][lo:hi][cols[2][lo:hi] < 0].tolist()[::-1]
        lo += len(entries)
        base, total = number * block, int(cols[4][lo])
        return Block(doc, number, total, base, min(base + block, total), [0, *accumulate(cols[3][lo:hi].tolist())], entries or None)

    for b in batches:
        if not len(b):
            continue
        cols = [b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
        cols = cols if rest is None else [np.concatenate(c) for c in zip(rest, cols)]
        edge = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
        bounds = [0, *edge.tolist()]
        for lo, hi in zip(bounds, bounds[1:]):
            yield made(cols, lo, hi)
        rest = [c[bounds[-1] :] for c in cols]
    if rest is not None:
        yield made(rest, 0, len(rest[0]))


def plan_chunks(sent_lengths: DataFrame, n_docs: int, reps: int, seed: int, max_seq_length: int,
                short_seq_prob: float, block_sentences: int = BLOCK_SENTENCES) -> DataFrame:
    """(doc_index, sent_no, n_tokens, n_sent) -> plan rows (``PLAN_SCHEMA``).

    A chunk spans at most ``T <= max_seq_length - 3`` sentences (every sentence has a token), so the
    loop enters a block at one of its first ``T`` sentences. (1) Each block that another follows: for
    every possible entry, the start at which the loop leaves the block (loops from different entries merge
    quickly and are remembered). (2) Per repeat and document, these exits chained block by block give the
    entry of every block (one small row per block). (3) Each block: the loop from its entry, with the
    chunks that start in it; the first block is entered at its first sentence.

    Blocks are neighbours in sorted partitions and streamed; only lengths pass through Python."""
    M, block = max_seq_length - 3, block_sentences
    if block < M:
        raise ValueError(f"block of {block} sentences is shorter than the longest chunk ({M})")
    number = F.floor(F.col("sent_no") / block).cast("long")
    rows = sent_lengths.select("doc_index", "sent_no", "n_tokens", "n_sent", number.alias("block"))
    # The first sentences of a block also end the block before it.
    copies = F.when((F.col("block") > 0) & (F.col("sent_no") % block < M), F.array(F.col("block"), F.col("block") - 1)).otherwise(F.array("block"))
    blocks = rows.withColumn("block", F.explode(copies))
    # An explicit partition count: few bytes, but heavy in Python work.
    parts = cpu_partitions(sent_lengths.sparkSession)

    def spread(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "doc_index", "block").sortWithinPartitions("doc_index", "block", "sent_no")

    def exits(batches):
        for b in _blocks(batches, block):
            out = []
            for rep in range(reps):
                T = target_length(seed, rep, b.doc, M, short_seq_prob)
                memo: dict[int, int] = {}
                found = []
                for e in [0] if b.number == 0 else range(b.base, b.base + M):
                    path, s = [], e
                    while s < b.stop and s not in memo:
                        path.append(s)
                        s = _next_start(b.P, b.base, b.n_total, b.doc, rep, T, s, n_docs, seed)
                    final = memo.get(s, s)
                    memo.update((v, final) for v in path)
                    found.append(final)
                out.append((rep, b.doc, b.number, found))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["rep", "doc_index", "block", "exits"]), EXITS, preserve_index=False)

    left = spread(blocks.filter(F.col("n_sent") > (F.col("block") + 1) * block))
    tables = left.mapInArrow(exits, "rep int, doc_index long, block long, exits array<long>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        rep, doc = int(pdf["rep"].iloc[0]), int(pdf["doc_index"].iloc[0])
        e, out = 0, []
        for blk, table in zip(pdf["block"].tolist(), pdf["exits"].tolist()):
            e = int(table[e - blk * block])
            out.append((rep, doc, blk + 1, e))
        return pd.DataFrame(out, columns=["rep", "doc_index", "block", "entry"])

    entries = tables.groupBy("rep", "doc_index").applyInPandas(chain, "rep int, doc_index long, block long, entry long")
    # Entries come as rows of their block: joined, they could be broadcast, and Spark would take the partitions of the
    # join for those asked for here, but read them otherwise. (Null lists cost a pass over their batch for each row.)
    entries = entries.select("doc_index", (-1 - F.col("rep")).cast("long").alias("sent_no"), F.lit(0).cast(rows.schema["n_tokens"].dataType).alias("n_tokens"),
                             F.col("entry").alias("n_sent"), "block")

    def emit(batches):
        out: list[tuple] = []
        for b in _blocks(batches, block):
            for rep in range(reps):
                T = target_length(seed, rep, b.doc, M, short_seq_prob)
                s = 0 if b.entries is None else b.entries[rep]
                while s < b.stop:
                    row, s = _step(b.P, b.base, b.n_total, b.doc, rep, T, s, n_docs, seed)
                    out.append(row)
            if len(out) > 10_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return spread(blocks.unionByName(entries)).mapInArrow(emit, PLAN_SCHEMA)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PLAN)], schema=PLAN)


def cpu_partitions(spark) -> int:
    """Partitions for Python-heavy stages: at least the cluster's parallelism."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def assemble_pairs(plan: DataFrame, sentences: DataFrame, docs: DataFrame, seed: int,
                   carry: list[str] | None = None, max_target: int = 125) -> DataFrame:
    """F6 + chunk assembly: plan rows -> (rep, doc_index, start, is_random_next, *carry, ids_a, ids_b).

    ``sentences``: (doc_index, sent_no, ids, ...); ``docs``: (doc_index, n_sent).
    A = chunk sentences before the cut; B = the rest of the chunk, or, for a random
    next, sentences of ``other_doc`` from a random start until B reaches
    ``target_b`` tokens (at least one sentence; ``target_b`` is at most ``max_target``). Every
    sentence has a token, so a side has at most ``max_target`` sentences: ids are packed by blocks of
    that many sentences of a document, each with those of the next block, and one row serves any start in it.
    A pair finds its chunk in one such row, and a random B in one of the other document, to
    which A goes along. No document is gathered in one place, and nothing is grouped by pair."""
    key = ["rep", "doc_index", "start"]
    extra = ["is_random_next", *(carry or [])]
    size = F.lit(max_target).cast("long")
    block = F.floor(F.col("sent_no") / size)
    packs = sentences.select(F.col("doc_index").alias("src_doc"), "sent_no", "ids", F.explode(F.array(block, block - 1)).alias("block"))
    packs = packs.where("block >= 0").groupBy("src_doc", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sent_no", "ids"))), lambda x: x["ids"]).alias("_ids"))

    def found(rows: DataFrame, doc: str, first: str) -> DataFrame:
        at = rows.withColumns({"src_doc": F.col(doc), "block": F.floor(F.col(first) / size)})
        return at.join(packs, ["src_doc", "block"])

    def ids_from(first: Column, n: Column) -> Column:
        return F.flatten(F.slice("_ids", (first - F.col("block") * size + 1).cast("int"), n.cast("int")))

    ids_a = ids_from(F.col("start"), F.col("cut"))
    own = found(plan.where(~F.col("is_random_next")), "doc_index", "start")
    own = own.select(*key, *extra, ids_a.alias("ids_a"), ids_from(F.col("start") + F.col("cut"), F.col("end") - F.col("start") - F.col("cut") + 1).alias("ids_b"))
    rnd = plan.where("is_random_next").join(docs.select(F.col("doc_index").alias("other_doc"), F.col("n_sent").alias("other_n")), "other_doc")
    rnd = rnd.withColumn("rstart", rng.randint(0, F.col("other_n") - 1, seed, "rstart", *[F.col(c) for c in key]))
    rnd = found(rnd, "doc_index", "start").select(*key, *extra, "other_doc", "rstart", "target_b", ids_a.alias("ids_a"))
    rnd = found(rnd, "other_doc", "rstart")
    ahead = F.transform(F.slice("_ids", (F.col("rstart") - F.col("block") * size + 1).cast("int"), F.greatest(F.col("target_b"), F.lit(1)).cast("int")), F.size)
    count = F.aggregate(
        ahead, F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("t")),
        lambda acc, x: F.when((acc["n"] == 0) | (acc["t"] < F.col("target_b")),
                              F.struct((acc["n"] + 1).alias("n"), (acc["t"] + x).alias("t"))).otherwise(acc),
        lambda acc: acc["n"])
    rnd = rnd.withColumn("_n", count)
    return own.unionByName(rnd.select(*key, *extra, "ids_a", ids_from(F.col("rstart"), F.col("_n")).alias("ids_b")))


def truncate_pair_random(a: str, b: str, max_num_tokens: int, seed: int, keys: list[Column]) -> tuple[Column, Column]:
    """F8: while too long, drop one token of the longer list (B on a tie), from the
    front or the back with probability 1/2 each; the draw of step t is keyed by t.
    Which list loses a token at step t has a closed form (after |la-lb| steps on the
    longer list the two alternate), so the removals per side are counted directly, and
    only the draws are looked at one by one, without the tokens."""
    la, lb = F.size(a), F.size(b)
    steps = F.greatest(la + lb - F.lit(max_num_tokens), F.lit(0))
    a_first = la > lb
    d = F.when(a_first, la - lb).otherwise(lb - la + 1)
    extra = F.greatest(steps - d, F.lit(0))
    ra = F.when(a_first, F.least(steps, d) + F.floor(extra / 2)).otherwise(F.floor((extra + 1) / 2)).cast("int")
    rb = steps - ra
    half = int(rng.hex_threshold(0.5), 16)

    @F.arrow_udf("a int, b int")
    def fronts(pre: pa.Array, steps: pa.Array, d: pa.Array, a_first: pa.Array) -> pa.Array:
        n, of_a, of_b = steps.to_numpy(zero_copy_only=False), np.zeros(len(steps), np.int32), np.zeros(len(steps), np.int32)
        for i in np.flatnonzero(n > 0).tolist():
            head = md5(pre[i].as_py().encode() + b"|")
            m, first, both = int(n[i]), a_first[i].as_py(), d[i].as_py()
            for t in range(m):
                h = head.copy()
                h.update(b"%d" % t)
                if int.from_bytes(h.digest()[:4], "big") < half:
                    if first if t < both else (t - both) % 2 == first:
                        of_a[i] += 1
                    else:
                        of_b[i] += 1
        return pa.StructArray.from_arrays([pa.array(of_a), pa.array(of_b)], ["a", "b"])

    front = fronts(rng.prefix(seed, "trunc", *keys), steps, d, a_first)
    new_a = F.slice(F.col(a), front["a"] + 1, la - ra)
    new_b = F.slice(F.col(b), front["b"] + 1, lb - rb)
    return new_a, new_b


def truncate_pair(a: str, b: str, max_len: int) -> tuple[Column, Column]:
    """longest-first truncation from the tail, in closed form."""
    la, lb = F.size(a), F.size(b)
    half_lo = F.lit(max_len // 2)
    half_hi = F.lit(max_len - max_len // 2)
    over = la + lb > max_len
    keep_a = F.when(~over, la).when(lb <= half_lo, F.lit(max_len) - lb).when(la <= half_hi, la).otherwise(half_hi)
    keep_b = F.when(~over, lb).when(lb <= half_lo, lb).when(la <= half_hi, F.lit(max_len) - la).otherwise(half_lo)
    return F.slice(F.col(a), 1, keep_a), F.slice(F.col(b), 1, keep_b)


def truncate_single(a: str, max_seq_length: int) -> Column:
    """keep the head, ``max_seq_length - 2`` items."""
    return F.slice(F.col(a), 1, max_seq_length - 2)


def assemble(a: Column, b: Column | None, cls, sep) -> tuple[Column, Column]:
    """[CLS] A [SEP] (B [SEP]); segment 0 up to the first [SEP], 1 after.
    An empty or missing B means a single text."""
    cls_c, sep_c = F.array(F.lit(cls)), F.array(F.lit(sep))
    single = F.concat(cls_c, a, sep_c)
    seg_single = F.array_repeat(F.lit(0), F.size(a) + 2)
    if b is None:
        return single, seg_single
    has_b = F.coalesce(F.size(b), F.lit(0)) > 0
    pair = F.concat(cls_c, a, sep_c, b, sep_c)
    seg_pair = F.concat(F.array_repeat(F.lit(0), F.size(a) + 2), F.array_repeat(F.lit(1), F.size(b) + 1))
    return F.when(has_b, pair).otherwise(single), F.when(has_b, seg_pair).otherwise(seg_single)


def pad(col: Column, n: int, value=0) -> Column:
    """Right-pad an array to ``n`` items."""
    return F.concat(col, F.array_repeat(F.lit(value), F.lit(n) - F.size(col)))


def mask_of(col: Column, n: int) -> Column:
    """1 on real items, 0 on padding."""
    return pad(F.array_repeat(F.lit(1), F.size(col)), n)
