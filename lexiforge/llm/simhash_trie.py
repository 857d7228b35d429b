"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a binary-trie
self-join (operator 9).

Fingerprints are computed per text with a C hash per shingle and a bit count per text.
The join walks pairs of trie nodes together. It is spread over Spark in two ways:

* Four tries hold the fingerprint rotated so that each 16-bit block comes first once. Two
  fingerprints within 3 bits agree on one block at least, so in each trie only node
  pairs that agree on the first 16 levels are followed; the others are met in another
  rotation. Each such node is a task unit.
* A unit with too many pairs is opened four levels further: its rows go to the child
  node pairs whose differing bits are within the budget, again until it is small.

Inside a unit the walk goes on level by level over whole arrays of node pairs.
Equal fingerprints are one trie entry, and a unit returns a spanning forest of its links,
so a group of thousands of near copies makes as many rows as it has members.

Defined results: null text counts as no words; null ``doc_id`` rows get a fingerprint and
the component of the documents that they link with (null if none has an id); repeated
rows give repeated result rows; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut_lineage, parallelism, release, star_forest

BLOCK_BITS = 16
#: Pairs of a node pair beyond which it is opened further.
MAX_PAIRS = 1 << 19
#: Shingles hashed at a time.
CHUNK = 1 << 16


def simhash(text: str | None, n: int = 3, seed: int = 42) -> int:
    """Fingerprint of one text as a signed 64-bit integer."""
    from itertools import repeat

    from xxhash import xxh64_digest

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    if len(words) < n:
        words, n = [b" ".join(words)], 1
    total = len(words) - n + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        part = words[at : at + CHUNK + n - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(n)))) if n > 1 else part[: total - at]
        raw = np.frombuffer(b"".join(map(xxh64_digest, shingles, repeat(seed))), np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total).view(">i8")[0])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row."""

    @F.pandas_udf("long")
    def fp(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([simhash(t, n) for t in texts], dtype="int64")
        release()

    return docs.select("doc_id", fp("text").alias("fp"))


def _rotated(fp, k: int):
    """The fingerprint with block ``k`` moved to the top (bits rotated left)."""
    s = BLOCK_BITS * k
    return fp if not s else F.shiftleft(fp, s).bitwiseOR(F.shiftrightunsigned(fp, 64 - s))


def walk(keys: np.ndarray, lo_a, hi_a, lo_b, hi_b, depth: np.ndarray, diff: np.ndarray, budget: int, levels: int = 64):
    """Pairs (i, j) of indexes into the sorted uint64 ``keys`` within ``budget`` bits, from
    the given node pairs. A node is the range [lo, hi) of the keys that share its prefix of
    ``depth`` bits; a node paired with itself gives i < j. Each step goes one level down
    and drops a pair once its differing bits are over the budget; pairs of single leaves
    are closed by comparing what is left of them."""
    out_i, out_j = [], []
    while len(lo_a):
        own = lo_a == lo_b
        single = (hi_a - lo_a == 1) & (hi_b - lo_b == 1)
        if single.any():
            i, j = lo_a[single & ~own], lo_b[single & ~own]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            out_i.append(i[near])
            out_j.append(j[near])
            go = ~single
            lo_a, hi_a, lo_b, hi_b, depth, diff, own = lo_a[go], hi_a[go], lo_b[go], hi_b[go], depth[go], diff[go], own[go]
            if not len(lo_a):
                break
        bit = np.uint64(1) << (np.uint64(levels - 1) - depth.astype(np.uint64))
        mid_a, mid_b = _split(keys, lo_a, hi_a, bit), _split(keys, lo_b, hi_b, bit)
        d = depth + 1
        parts = [(lo_a, mid_a, lo_b, mid_b, d, diff, None), (mid_a, hi_a, mid_b, hi_b, d, diff, None),
                 (lo_a, mid_a, mid_b, hi_b, d, diff + 1, None), (mid_a, hi_a, lo_b, mid_b, d, diff + 1, ~own)]
        kept = []
        for p in parts:
            ok = (p[0] < p[1]) & (p[2] < p[3]) & (p[5] <= budget)
            ok = ok if p[6] is None else ok & p[6]
            kept.append([x[ok] for x in p[:6]])
        lo_a, hi_a, lo_b, hi_b, depth, diff = (np.concatenate([k[c] for k in kept]) for c in range(6))
    none = np.empty(0, np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)


def _split(keys, lo, hi, bit):
    """First index in each sorted range [lo, hi) whose key has ``bit`` set."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        go = lo < hi
        if not go.any():
            return lo
        mid = (lo + hi) // 2
        one = (keys[np.minimum(mid, len(keys) - 1)] & bit) != 0
        hi = np.where(go & one, mid, hi)
        lo = np.where(go & ~one, mid + 1, lo)


def _join_units(rows: pd.DataFrame, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fp, smallest fp of its local component) of whole units."""
    rows = rows.assign(u=rows["fpr"].to_numpy().view(np.uint64))
    # Within a unit the two sides are two sorted runs; side 1 is empty for a node with itself.
    rows = rows.sort_values(["k", "depth", "pa", "pb", "side", "u"], kind="stable")
    unit = np.flatnonzero((rows[["k", "depth", "pa", "pb"]].diff().fillna(1) != 0).any(axis=1).to_numpy())
    ends = np.append(unit[1:], len(rows))
    side, keys, fp = rows["side"].to_numpy(), rows["u"].to_numpy(), rows["fp"].to_numpy()
    mid = unit + np.add.reduceat(side == 0, unit)
    depth, diff = rows["depth"].to_numpy()[unit].astype(np.int64), rows["diff"].to_numpy()[unit].astype(np.int64)
    own = (rows["pa"] == rows["pb"]).to_numpy()[unit]
    lo_b, hi_b = np.where(own, unit, mid), np.where(own, ends, ends)
    got_a, got_b = [], []
    # Whole units at a time, with a bound on the pairs that they can make.
    cost = np.where(own, (ends - unit) ** 2 // 2, (mid - unit) * (ends - mid))
    group = np.cumsum(cost) // (4 * MAX_PAIRS)
    filled = (np.where(own, ends, mid) > unit) & (ends > lo_b)
    for g in np.unique(group):
        m = (group == g) & filled
        i, j = walk(keys, unit[m], np.where(own, ends, mid)[m], lo_b[m], hi_b[m], depth[m], diff[m], budget)
        if len(i):
            nodes, inverse = np.unique(fp[np.concatenate([i, j])], return_inverse=True)
            label = star_forest(len(nodes), inverse[: len(i)], inverse[len(i) :])
            child = np.flatnonzero(label != np.arange(len(nodes)))
            got_a.append(nodes[child])
            got_b.append(nodes[label[child]])
    none = np.empty(0, np.int64)
    return (np.concatenate(got_a), np.concatenate(got_b)) if got_a else (none, none)


def _open(rows: DataFrame, budget: int) -> DataFrame:
    """Hot node pairs opened four levels: each row goes to the pairs of child nodes that
    its own child is in and whose differing bits are within the budget."""
    child = F.expr("cast(shiftrightunsigned(shiftleft(fpr, depth), 60) as int)")
    x = rows.withColumn("c", child)
    mine, other = F.col("c"), F.col("o")
    x = x.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(15))))
    x = x.withColumn("diff", F.col("diff") + F.bit_count(mine.bitwiseXOR(other)).cast("int")).where(F.col("diff") <= budget)
    own = F.col("pa") == F.col("pb")
    low, high = F.least(mine, other), F.greatest(mine, other)
    a = F.when(own, low).when(F.col("side") == 0, mine).otherwise(other)
    b = F.when(own, high).when(F.col("side") == 0, other).otherwise(mine)
    side = F.when(own, (mine > other).cast("int")).otherwise(F.col("side"))
    return x.select("k", (F.shiftleft("pa", 4).bitwiseOR(a.cast("long"))).alias("pa"),
                    (F.shiftleft("pb", 4).bitwiseOR(b.cast("long"))).alias("pb"), side.alias("side"),
                    (F.col("depth") + 4).alias("depth"), "diff", "fpr", "fp")


def trie_links(fps: DataFrame, budget: int = 3) -> DataFrame:
    """Spanning links (a, b) of distinct fingerprints ``fp`` (long) within ``budget`` bits:
    their connected components are those of all such pairs."""
    if budget > 64 // BLOCK_BITS - 1:
        raise ValueError(f"{64 // BLOCK_BITS} rotations find pairs within {64 // BLOCK_BITS - 1} bits at most")
    spark = fps.sparkSession
    rot = F.array(*[F.struct(F.lit(k).alias("k"), _rotated(F.col("fp"), k).alias("fpr")) for k in range(64 // BLOCK_BITS)])
    rows = fps.select("fp", F.explode(rot).alias("r")).select(
        F.col("r.k").alias("k"), F.shiftrightunsigned("r.fpr", 64 - BLOCK_BITS).alias("pa"),
        F.shiftrightunsigned("r.fpr", 64 - BLOCK_BITS).alias("pb"), F.lit(0).alias("side"),
        F.lit(BLOCK_BITS).alias("depth"), F.lit(0).alias("diff"), F.col("r.fpr").alias("fpr"), "fp")
    ready = []
    key = ["k", "depth", "pa", "pb"]
    while True:
        sizes = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum("side").alias("nb"))
        pairs = F.when(F.col("pa") == F.col("pb"), F.col("n") * F.col("n") / 2).otherwise((F.col("n") - F.col("nb")) * F.col("nb"))
        hot = cut_lineage(sizes.where((pairs > MAX_PAIRS) & (F.col("depth") <= 60)).select(*key))
        if hot.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(hot, key, "left_anti"))
        rows = cut_lineage(_open(rows.join(hot, key, "left_semi"), budget))
    out = None
    for r in ready:
        out = r if out is None else out.unionByName(r)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = b[["k", "pa", "pb", "depth"]].iloc[-1]
            tail = ((b["pa"] == last["pa"]) & (b["pb"] == last["pb"]) & (b["k"] == last["k"]) & (b["depth"] == last["depth"])).to_numpy()
            cut = len(b) - int(np.argmin(tail[::-1])) if not tail.all() else 0
            rest = b.iloc[cut:]
            if cut:
                a_, b_ = _join_units(b.iloc[:cut], budget)
                yield pd.DataFrame({"a": a_, "b": b_})
        if rest is not None and len(rest):
            a_, b_ = _join_units(rest, budget)
            yield pd.DataFrame({"a": a_, "b": b_})
        release()

    placed = out.repartition(parallelism(spark), "k", "depth", "pa", "pb").sortWithinPartitions("k", "depth", "pa", "pb")
    return placed.mapInPandas(join, "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fp long, component_id) per row of ``docs`` (doc_id, text)."""
    fps = cut_lineage(fingerprints(docs, shingle))
    classes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = cut_lineage(trie_links(classes.select("fp"), max_bits))
    comp = components(links)
    linked = classes.join(comp, classes.fp == comp.node).select("fp", "component", "rep")
    low = linked.groupBy("component").agg(F.min("rep").alias("low"))
    linked = cut_lineage(linked.join(low, "component").select("fp", "low"))
    per_fp = classes.join(linked, "fp", "left").select("fp", F.coalesce("low", "rep").alias("component_id"))
    return fps.join(cut_lineage(per_fp), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is the smallest of its component (its own
    columns only). Rows without an id stay; of rows that repeat an id and are the first of
    their component, all stay."""
    comp = simhash_components(docs.select("doc_id", "text"), shingle, max_bits)
    gone = comp.where("doc_id is not null and component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
