"""URL filters by path-template trees (operator 1).

Rules on host and path prefix come first (the longest that fits). Other urls are judged by
the template of their path. Templates grow level by level, from the host down, over counts of
distinct paths (never over urls, and never a host at a time):

1. Generalise: a segment that is a number, a hash or the like becomes ``{n}``; under a node
   with many children, none of them common, all become ``{*}``.
2. Merge: literal siblings whose next segments are spread like those of all siblings
   and whose share of good labels does not differ from theirs beyond chance become ``{=}``.
3. Judge: a template's purity is its share of good among labelled urls, smoothed
   towards its host's, which is smoothed towards that of all; below ``purity`` it is rejected.

Segments beyond ``depth`` are one tail segment, so the number of steps is bounded. Hosts and
templates of any number are rows, and counts are combined before each shuffle, so a host with
a third of all urls is one row of sums, not one task.

Defined results: a null url or one without ``://`` has empty host and path and is judged like
other urls of the empty host; equal urls get equal verdicts; an empty table gives an empty
table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


#: The rules of the query's contract.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


@dataclass(frozen=True)
class Settings:
    """``children``, ``share``: a node with at least so many children of which none holds more
    than this share is variable; ``spread``: most difference (half the sum of absolute
    differences) of next-segment shapes, and ``z`` of label shares, at which siblings
    merge; ``alpha``: weight of the prior; ``purity``: least purity that is allowed."""

    depth: int = 6
    children: int = 24
    share: float = 0.2
    spread: float = 0.25
    z: float = 2.5
    alpha: float = 5.0
    purity: float = 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def apply_rules(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Rule text (``host`` + path) and verdict of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host, r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, F.lit(r.host + r.path)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def segments(path: Column, depth: int) -> Column:
    """Non-empty path segments; those from ``depth`` on joined into one."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    head = F.slice(parts, 1, depth - 1)
    tail = F.array_join(F.slice(parts, depth, 1 << 30), "/")
    return F.when(F.size(parts) < depth, parts).otherwise(F.concat(head, F.array(tail)))


#: Shapes that vary by nature: numbers (with a file ending), hashes, dates, mixed ids.
VARIABLE = r"^(\d+(\.\w+)?|[0-9a-fA-F]{8,}|\d[\d._-]*\d|[^/]*\d{4,}[^/]*)$"


def shape(segment: Column) -> Column:
    return F.when(segment.isNull(), F.lit("end")).when(segment.rlike(VARIABLE), F.lit("variable")).otherwise(F.lit("word"))


def templates(paths: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(host, segs, template) of distinct rows (host, segs, n, labelled, good)."""
    x = paths.withColumn("template", F.lit(""))
    deepest = paths.agg(F.max(F.size("segs"))).first()[0] or 0
    for d in range(deepest):
        seg, after = F.get("segs", F.lit(d)), F.get("segs", F.lit(d + 1))
        node = ["host", "template"]
        live = x.where(F.size("segs") > d).select(*node, seg.alias("seg"), shape(after).alias("next"), "n", "labelled", "good")
        is_next = lambda v: F.sum(F.when(F.col("next") == v, F.col("n")).otherwise(0))
        child = live.groupBy(*node, "seg").agg(
            F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("good").alias("g"),
            is_next("end").alias("e"), is_next("variable").alias("v"), is_next("word").alias("w"))
        child = child.withColumn("varies", F.col("seg").rlike(VARIABLE))
        words = child.where(~F.col("varies")).groupBy(*node).agg(
            F.count("*").alias("k"), F.max("n").alias("top"), F.sum("n").alias("pn"), F.sum("l").alias("pl"), F.sum("g").alias("pg"),
            F.sum("e").alias("pe"), F.sum("v").alias("pv"), F.sum("w").alias("pw"))
        y = child.join(words, node, "left")
        many = (F.col("k") >= s.children) & (F.col("top") <= s.share * F.col("pn"))
        off = sum((F.abs(F.col(a) / F.col("n") - F.col("p" + a) / F.col("pn")) for a in ("e", "v", "w")), F.lit(0.0)) / 2
        # Two-proportion z of the label share against the siblings', both smoothed by one half.
        share, other = (F.col("g") + 0.5) / (F.col("l") + 1), (F.col("pg") + 0.5) / (F.col("pl") + 1)
        apart = F.abs(share - other) / F.sqrt(other * (1 - other) * (1 / (F.col("l") + 1) + 1 / (F.col("pl") + 1)))
        alike = (F.col("k") > 1) & (off <= s.spread) & (apart <= s.z)
        name = F.when(F.col("varies"), F.lit("{n}")).when(many, F.lit("{*}")).when(alike, F.lit("{=}")).otherwise(F.col("seg"))
        y = y.select(*node, "seg", name.alias("_name"))
        on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in node] + [F.get("l.segs", F.lit(d)) == F.col("r.seg")]
        x = x.alias("l").join(y.alias("r"), on[0] & on[1] & on[2], "left").select(
            "l.host", "l.segs", "l.n", "l.labelled", "l.good",
            F.when(F.col("r._name").isNull(), F.col("l.template")).otherwise(F.concat("l.template", F.lit("/"), "r._name")).alias("template"))
        x = cut_lineage(x)
    return x


def judge(trees: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(host, template, labelled, good, purity, verdict) per template."""
    t = trees.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    h = t.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("good").alias("hg"))
    total = h.agg(F.sum("hl").alias("l"), F.sum("hg").alias("g")).first()
    prior = (total["g"] + 1.0) / (total["l"] + 1.0) if total["l"] else 1.0  # nothing labelled: nothing rejected
    h = h.select("host", ((F.col("hg") + s.alpha * prior) / (F.col("hl") + s.alpha)).alias("host_purity"))
    purity = (F.col("good") + s.alpha * F.col("host_purity")) / (F.col("labelled") + s.alpha)
    t = t.join(h, "host").withColumn("purity", F.least(purity, F.lit(1.0)))
    return t.withColumn("verdict", F.when(F.col("purity") >= s.purity, F.lit("allow")).otherwise(F.lit("block"))).drop("host_purity")


def filter_urls(urls: DataFrame, rules: tuple[Rule, ...] = RULES, s: Settings = Settings()) -> DataFrame:
    """``urls`` (page_id, url, good: 1, 0 or null) -> (page_id, host, path, rule, verdict,
    template, purity) per row."""
    host, path = split_url(F.col("url"))
    x = urls.select("page_id", "good", host.alias("host"), path.alias("path")).withColumn("segs", segments(F.col("path"), s.depth))
    rule, fixed = apply_rules(F.col("host"), F.col("path"), rules)
    x = cut_lineage(x.withColumn("rule", rule).withColumn("fixed", fixed))
    paths = x.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("good").alias("labelled"),
                                          F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"))
    trees = cut_lineage(templates(cut_lineage(paths), s))
    verdicts = judge(trees, s)
    on = (F.col("l.host") == F.col("r.host")) & (F.col("l.template") == F.col("r.template"))
    known = trees.alias("l").join(verdicts.alias("r"), on).select("l.host", "l.segs", "l.template", "r.purity", "r.verdict")
    on = (F.col("l.host") == F.col("r.host")) & (F.col("l.segs") == F.col("r.segs"))
    return x.alias("l").join(known.alias("r"), on).select(
        "l.page_id", "l.host", "l.path", "l.rule", F.coalesce("l.fixed", "r.verdict").alias("verdict"), "r.template", F.round("r.purity", 9).alias("purity"))


def oracle(rules: tuple[Rule, ...] = RULES, s: Settings = Settings()) -> str:
    """DuckDB SQL for the query: ``filter_urls`` over ``pages`` with the labels of the documents
    that they show. One block of tables per level, down to the greatest depth."""
    var = "'" + VARIABLE + "'"
    kind = lambda x: f"CASE WHEN {x} IS NULL THEN 'end' WHEN regexp_matches({x}, {var}) THEN 'variable' ELSE 'word' END"
    fit = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    ordered = sorted(rules, key=lambda r: (-len(r.host) - len(r.path), r.host, r.path))
    rule = " ".join(f"WHEN {fit(r)} THEN '{r.host}{r.path}'" for r in ordered)
    verdict = " ".join(f"WHEN {fit(r)} THEN '{r.verdict}'" for r in ordered)
    d = s.depth
    ctes = [
        """good AS (SELECT doc_id, min(CAST(coalesce(quality = 1 AND coalesce(toxic, 0) = 0, NULL) AS INTEGER)) AS good
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id)""",
        """rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages)""",
        r"""parts AS (SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest)""",
        r"""numbered AS (SELECT *, TRY_CAST(nullif(regexp_extract(path, '/(\d{1,18})(\.\w+)?/*$', 1), '') AS BIGINT) AS shown,
  list_filter(string_split(path, '/'), lambda x: x <> '') AS a FROM parts)""",
        f"""pg AS (SELECT page_id, host, path, good, CASE {rule} END AS rule, CASE {verdict} END AS fixed,
  CASE WHEN len(a) < {d} THEN a ELSE list_append(list_slice(a, 1, {d - 1}), array_to_string(list_slice(a, {d}, len(a)), '/')) END AS segs
  FROM numbered LEFT JOIN good ON shown = doc_id)""",
        "x0 AS (SELECT host, segs, count(*) AS n, count(good) AS labelled, coalesce(sum(good), 0) AS good, '' AS template FROM pg GROUP BY host, segs)",
    ]
    for i in range(d):
        ctes += [
            f"""c{i} AS (SELECT host, template, segs[{i + 1}] AS seg, sum(n) AS n, sum(labelled) AS l, sum(good) AS g,
  sum(CASE WHEN nx = 'end' THEN n ELSE 0 END) AS e, sum(CASE WHEN nx = 'variable' THEN n ELSE 0 END) AS v, sum(CASE WHEN nx = 'word' THEN n ELSE 0 END) AS w
  FROM (SELECT *, {kind(f"segs[{i + 2}]")} AS nx FROM x{i} WHERE len(segs) > {i}) _a GROUP BY host, template, segs[{i + 1}])""",
            f"""p{i} AS (SELECT host, template, count(*) AS k, max(n) AS top, sum(n) AS pn, sum(l) AS pl, sum(g) AS pg, sum(e) AS pe, sum(v) AS pv, sum(w) AS pw
  FROM c{i} WHERE NOT regexp_matches(seg, {var}) GROUP BY host, template)""",
            f"""n{i} AS (SELECT host, template, seg, CASE WHEN regexp_matches(seg, {var}) THEN '{{n}}'
  WHEN k >= {s.children} AND top <= {s.share} * pn THEN '{{*}}'
  WHEN k > 1 AND (abs(e / n - pe / pn) + abs(v / n - pv / pn) + abs(w / n - pw / pn)) / 2 <= {s.spread}
    AND abs((g + 0.5) / (l + 1) - (pg + 0.5) / (pl + 1)) / sqrt((pg + 0.5) / (pl + 1) * (1 - (pg + 0.5) / (pl + 1)) * (1.0 / (l + 1) + 1.0 / (pl + 1))) <= {s.z}
  THEN '{{=}}' ELSE seg END AS name FROM c{i} LEFT JOIN p{i} USING (host, template))""",
            f"""x{i + 1} AS (SELECT x.host, x.segs, x.n, x.labelled, x.good, CASE WHEN m.name IS NULL THEN x.template ELSE x.template || '/' || m.name END AS template
  FROM x{i} x LEFT JOIN n{i} m ON m.host = x.host AND m.template = x.template AND m.seg = x.segs[{i + 1}])""",
        ]
    ctes += [
        f"t AS (SELECT host, template, sum(labelled) AS labelled, sum(good) AS good FROM x{d} GROUP BY host, template)",
        f"""h AS (SELECT host, (sum(good) + {s.alpha} * (SELECT CASE WHEN sum(labelled) > 0 THEN (sum(good) + 1.0) / (sum(labelled) + 1.0) ELSE 1.0 END FROM t))
  / (sum(labelled) + {s.alpha}) AS hp FROM t GROUP BY host)""",
        f"j AS (SELECT host, template, least((good + {s.alpha} * hp) / (labelled + {s.alpha}), 1.0) AS purity FROM t JOIN h USING (host))",
    ]
    return "WITH " + ",\n".join(ctes) + f"""
SELECT pg.page_id, pg.host, pg.path, pg.rule, coalesce(pg.fixed, CASE WHEN j.purity >= {s.purity} THEN 'allow' ELSE 'block' END) AS verdict,
  x.template, round(j.purity, 9) AS purity
FROM pg JOIN x{d} x ON x.host = pg.host AND x.segs = pg.segs JOIN j ON j.host = x.host AND j.template = x.template"""
