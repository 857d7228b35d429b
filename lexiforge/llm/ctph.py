"""Context-triggered piecewise hashing of documents (operator 8).

A rolling hash over seven bytes cuts a text wherever it hits the block size's trigger
value, so cuts depend on nearby content only; each chunk gives one character of a
signature. A fingerprint holds the signatures at the block size that the text's length asks
for and at twice that, ``size:signature:signature``; two fingerprints are compared by edit
distance where their block sizes meet (equal, or one twice the other), else they
are unlike. The whole text goes in. Text that repeats itself hits the trigger again and again, so its block size is
doubled until the signature has no more than ``MOST`` characters, which also bounds the cost of a
comparison.

Each document is also compared with its successor by ``doc_id`` and with a version of itself
that ends in the successor's beginning. For that, documents are dealt to nested id ranges and
read in order; a range also gets the first document of the next one, so a text is
moved once and no range needs another.

Defined results: null text is empty; empty text has the fingerprint ``4::``; rows
without an id come after all others; rows with equal ids are ordered by a hash of their
text; a single document is its own successor; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parallelism

LEAST = 4
WINDOW = 7
AIM = 64
FEWEST = 16
MOST = 256
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Block sizes stay below the range of the hash (a window triggers at this size once in 2^30).
LARGEST = 1 << 30
#: Bytes hashed at a time; longer texts go block by block.
STEP = 1 << 22


def _rolling(data: np.ndarray) -> np.ndarray:
    """Mixed 32-bit hash of the seven bytes that end at each position from the seventh on."""
    n = len(data) - WINDOW + 1
    wide = data.astype(np.uint32)
    h = wide[:n].copy()
    for k in range(1, WINDOW):
        h *= np.uint32(0x01000193)
        h += wide[k : k + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def _signature(raw: np.ndarray, sizes: tuple[int, ...]) -> list[str]:
    """One signature per block size (powers of two)."""
    sums: list[list[np.ndarray]] = [[] for _ in sizes]
    open_ = [np.zeros(1, np.uint32) for _ in sizes]
    some = [False for _ in sizes]
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint8), raw])
    for at in range(0, len(raw), STEP):
        h = _rolling(padded[at : at + STEP + WINDOW - 1])
        part = h * np.uint32(0x297A2D39)
        for k, size in enumerate(sizes):
            ends = np.flatnonzero((h & np.uint32(size - 1)) == size - 1) + 1
            total = np.add.reduceat(part, np.concatenate([[0], ends[ends < len(h)]]), dtype=np.uint32)
            total[:1] += open_[k]
            if len(ends) and ends[-1] == len(h):
                sums[k].append(total)
                open_[k], some[k] = np.zeros(1, np.uint32), False
            else:
                sums[k].append(total[:-1])
                open_[k], some[k] = total[-1:], True
    out = []
    for k in range(len(sizes)):
        v = np.concatenate(sums[k] + [open_[k]] * some[k])
        v = (v ^ (v >> np.uint32(16))) * np.uint32(0x7FEB352D)
        out.append(ALPHABET[v >> np.uint32(26)].tobytes().decode("ascii"))
    return out


def fingerprint(text: str) -> str:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return f"{LEAST}::"
    size = LEAST
    while size * AIM < len(raw):
        size *= 2
    one, two = _signature(raw, (size, 2 * size))
    if len(one) > MOST:
        while len(one) > MOST and size < LARGEST:
            size *= 2
            one, two = two, _signature(raw, (2 * size,))[0]
        return f"{size}:{one}:{two}"
    while len(one) < FEWEST and size > LEAST:  # few triggers: a finer cut
        finer = _signature(raw, (size // 2,))[0]
        if len(finer) > MOST:
            break
        size, one, two = size // 2, finer, one
    return f"{size}:{one}:{two}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprint strings: 1 - edit distance / longer length of the
    signatures at a common block size (the better one if both sizes agree), else 0."""
    pa, pb = F.split(a, ":"), F.split(b, ":")
    sa, sb = pa[0].cast("long"), pb[0].cast("long")

    def sim(x: Column, y: Column) -> Column:
        longer = F.greatest(F.length(x), F.length(y))
        return F.when(longer > 0, 1.0 - F.levenshtein(x, y) / longer).otherwise(F.lit(0.0))

    return (F.when(a == b, F.lit(1.0))
            .when(sa == sb, F.greatest(sim(pa[1], pb[1]), sim(pa[2], pb[2])))
            .when(sa == 2 * sb, sim(pa[1], pb[2]))
            .when(sb == 2 * sa, sim(pa[2], pb[1]))
            .otherwise(F.lit(0.0)).cast("double"))


def by_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """(bucket, guest, doc_id, text): rows in id ranges, each with the rows of the next
    range's first id as guests (after the last range: of the first)."""
    spark = docs.sparkSession
    x = docs.select("doc_id", "text")
    probs = [i / ranges for i in range(1, ranges)]
    cuts = x.agg(F.percentile_approx("doc_id", probs, 10 * ranges).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []))
    bucket = F.lit(0)
    if cuts:
        bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("doc_id")))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(bucket)
    x = x.withColumn("bucket", bucket.cast("int"))
    firsts = x.groupBy("bucket").agg(F.min("doc_id").alias("first")).collect()  # a row for each range
    firsts = sorted(((r["bucket"], r["first"]) for r in firsts), key=lambda r: r[0])
    if not firsts:
        return x.select("bucket", F.lit(0).alias("guest"), "doc_id", "text")
    host = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    hosts = spark.createDataFrame(host, f"first {id_type}, host int")
    guests = x.join(F.broadcast(hosts), F.col("doc_id").eqNullSafe(F.col("first"))).select(
        F.col("host").alias("bucket"), F.lit(1).alias("guest"), "doc_id", "text")
    return x.select("bucket", F.lit(0).alias("guest"), "doc_id", "text").union(guests)


def _edited(text: str, after: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def with_successors(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint)."""
    parts = parallelism(docs.sparkSession)
    x = by_ranges(docs, 4 * parts).withColumn("_h", F.xxhash64("text"))
    x = x.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_last(), "_h")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # (bucket, guest, doc_id, text, fingerprint)
        for b in batches:
            out = []
            for bucket, guest, doc, text in zip(b["bucket"], b["guest"], b["doc_id"], b["text"]):
                text = "" if text is None else text
                if held is not None and held[0] == bucket and held[1]:
                    continue  # the range is done with its first guest
                fp = fingerprint(text)
                if held is not None and held[0] == bucket:
                    edited = _edited(held[3], text)
                    digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
                    out.append((held[2], len(held[3]), digest, held[4], fingerprint(edited), fp))
                held = (bucket, guest, doc, text, fp)
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"])

    return x.select("bucket", "guest", "doc_id", "text").mapInPandas(
        run, f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")


def compare_successors(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and the likeness of its own
    to the edited text's and to the next document's."""
    x = with_successors(docs)
    near = lambda c: F.round(likeness(F.col("fingerprint"), F.col(c)), 12)
    return x.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                    near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))
