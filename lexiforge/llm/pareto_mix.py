"""Mixing sources to target weights by Pareto order sampling (operator 5).

Every document of a source is expected in the mix ``target / source_size`` times. The
whole part of that number is taken for certain; for the rest the documents are ranked by
random odds over inclusion odds, ``(u / (1 - u)) / (p / (1 - p))`` with ``u`` a keyed
uniform number, and taken in that order until the words still missing are reached (the
document at the edge is taken if that comes nearer). A ``weight`` column makes the expected
copies unequal inside a source, in proportion to it.

Running sums go over nested ranges (``common.running_sums``) of ``u`` where all documents of a
source have one weight, so a source that holds a third of all rows is spread; with a
``weight`` they go over ranges of the rank, which may be uneven.

Defined results: null text has size 0; a null source is a source of its own, placed last;
a source of size 0 takes nothing; rows that share id, source, size (and weight) are one draw
and get the same number of copies; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut_lineage, keyed_unit, running_sums, sql_keyed_unit

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
SEED = 42


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from rows (source, size): the total of all sizes
    shared by the repeating weights, no target above ``max_copies`` times its source.

    Sharing the excess again and again ends where ``target = min(cap, level * weight)`` for one
    level; sorted by ``cap / weight`` the capped sources come first, which gives the level
    from running sums. One row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), "source")
    i = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (i + 1).cast("int"))
    x = per.withColumn("w", w).withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    after = by.rowsBetween(W.currentRow, W.unboundedFollowing)
    x = (x.withColumn("total", F.sum("source_size").over(W.partitionBy()))
         .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("open_w", F.sum("w").over(after)))
    x = x.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_w"))
    # The first source (in this order) that its level does not fill is where capping ends.
    fits = F.col("level") * F.col("w") <= F.col("cap")
    x = x.withColumn("final", F.first(F.when(fits, F.col("level")), ignorenulls=True).over(
        by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.coalesce(F.least("cap", F.col("final") * F.col("w")), F.col("cap"))
    return x.select("source", "source_size", target.alias("target"))


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draws(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED,
          weight: str | None = None) -> DataFrame:
    """(doc_id, source, size, own, n, source_size, target, copies), a row for each distinct
    (doc_id, source, size, own), which stands for ``n`` rows of ``docs`` (doc_id, text,
    source[, weight])."""
    own = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    sized = docs.select("doc_id", "source", word_count().alias("size"), own.alias("own"))
    sized = cut_lineage(sized.groupBy("doc_id", "source", "size", "own").agg(F.count("*").alias("n")))
    sized = sized.withColumn("all", F.col("n") * F.col("size"))
    targets = source_targets(sized.select("source", F.col("all").alias("size")), weights, max_copies)
    scale = sized.groupBy("source").agg(F.sum(F.col("own") * F.col("all")).alias("own_size"))
    targets = targets.alias("a").join(scale.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.own_size")
    targets = cut_lineage(targets)
    x = sized.alias("l").join(targets.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select(
        "l.*", "r.source_size", "r.target", "r.own_size")
    expected = F.when(F.col("own_size") > 0, F.least(F.col("target") * F.col("own") / F.col("own_size"), F.lit(float(max_copies)))).otherwise(F.lit(0.0))
    x = x.withColumn("whole", F.floor(expected).cast("long")).withColumn("p", expected - F.floor(expected))
    odds = (F.col("u") * (1 - F.col("p"))) / ((1 - F.col("u")) * F.col("p"))
    # q / (1 + q) keeps the order of the odds and lies in [0, 1); p = 0 ranks last.
    x = x.withColumn("u", keyed_unit(seed, "pareto", F.col("doc_id")))
    x = x.withColumn("rank", F.when(F.col("p") > 0, odds / (1 + odds)).otherwise(F.lit(1.0)))
    x = cut_lineage(x.withColumn("certain", F.col("whole") * F.col("all")))
    certain = x.groupBy("source").agg(F.sum("certain").alias("certain_size"))
    # Equal chances in a source: the draw itself has the order of the ranks, and spreads evenly
    # over the ranges, which ranks do not (near 0 or 1 where p is near 1 or 0, all 1 where it is 0).
    # Without a rest (p = 0) nothing is drawn, so such rows need no sum.
    drawn = running_sums(x.where("p > 0"), ["source"], "u" if weight is None else "rank", ["doc_id", "size", "own"], "all", "before")
    x = drawn.unionByName(x.where("p = 0").withColumn("before", F.lit(0).cast("long")))
    x = x.alias("l").join(certain.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select("l.*", "r.certain_size")
    more = (F.col("p") > 0) & (F.col("before") + F.col("all") / 2 <= F.col("target") - F.col("certain_size"))
    return x.select("doc_id", "source", "size", "own", "n", "source_size", "target", (F.col("whole") + more.cast("long")).alias("copies"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per row of ``docs``."""
    x = draws(docs, **settings).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return x.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it (its own columns only)."""
    weight = settings.get("weight")
    drawn = draws(docs, **settings)
    own = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    x = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", word_count().alias("size"), own.alias("own"))
    hit = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("l.source").eqNullSafe(F.col("r.source")) \
        & (F.col("l.size") == F.col("r.size")) & (F.col("l.own") == F.col("r.own"))
    x = x.alias("l").join(drawn.where("copies > 0").alias("r"), hit).select("l.row", "r.copies")
    return x.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def oracle() -> str:
    """DuckDB SQL for ``mix`` with equal weights inside a source."""
    w = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(WEIGHTS))
    return f"""
WITH rows_ AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sized AS (SELECT doc_id, source, size, count(*) AS n FROM rows_ GROUP BY ALL),
per AS (SELECT source, CAST(sum(n * size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST(CASE CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} AS INTEGER) {w} END AS DOUBLE) AS w,
    CAST(source_size * {MAX_COPIES} AS DOUBLE) AS cap FROM per),
levels AS (
  SELECT *, (CAST((SELECT sum(source_size) FROM per) AS DOUBLE)
     - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
     / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
     row_number() OVER (ORDER BY cap / w, source IS NULL, source) AS rn FROM weighed),
final AS (SELECT level AS f FROM levels WHERE level * w <= cap ORDER BY rn LIMIT 1),
targets AS (SELECT source, source_size, coalesce(least(cap, (SELECT f FROM final) * w), cap) AS target FROM levels),
rated AS (
  SELECT s.doc_id, s.source, s.size, s.n, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, {float(MAX_COPIES)}) ELSE 0.0 END AS e,
    {sql_keyed_unit(SEED, 'pareto', 's.doc_id')} AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
ranked AS (
  SELECT *, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS p,
    coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rated)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN p > 0 AND before + n * size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked, generate_series(1, n) AS g(i)"""
