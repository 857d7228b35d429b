import random

from conftest_llm import brute_components
from pyspark.sql import functions as F

from lexiforge.llm import common


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)]
    edges += [(i, i + 1) for i in range(1000, 1064)] + [(5000, 6000 + i) for i in range(50)] + [(3, 3)]
    df = spark.createDataFrame(edges + [(None, 4)], "a long, b long")
    got = {r.node: r.component for r in common.components(df).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    want = brute_components(nodes, [e for e in edges if e[0] != e[1]])
    assert got == want
    assert common.components(df.limit(0)).count() == 0


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([0.0, 1.0, rng.random()]), i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, u double, id long, v long")
    got = {r.id: r.before for r in common.running_sums(df, ["g"], "u", ["id"], "v", "before", per_bucket=7).collect()}
    for g in ("a", "b", None):
        total = 0
        for _, u, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            assert got[i] == total
            total += v
    assert common.running_sums(df.where(F.lit(False)), ["g"], "u", ["id"], "v", "before").count() == 0
