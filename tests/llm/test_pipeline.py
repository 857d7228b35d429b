import random

import pytest

import corpus_pipeline as cp
from lexiforge.llm import simhash_trie

SF = "/root/testdata/sf0.001"


def stage(name):
    return dict(cp.STAGES)[name]


def test_stages_chain(spark, tmp_path):
    docs = cp.read_docs(spark, SF)
    before = docs.columns
    kept = {}
    for i, (name, f) in enumerate(cp.STAGES):
        out = f(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        last, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        if i + 1 < len(cp.STAGES):
            assert docs.columns == before
        kept[name] = (last, docs)
    first, second = kept["language_id"]
    assert second.count() >= 0.98 * first.count()
    first, second = kept["simhash_dedup"]
    comp = simhash_trie.simhash_components(first).collect()
    assert sorted(r.doc_id for r in second.collect()) == sorted({r.component_id for r in comp})
    first, second = kept["mix_sources"]
    assert {r.doc_id for r in second.collect()} <= {r.doc_id for r in first.collect()}
    first, packed = kept["bestfit_packing"]
    rows = packed.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in first.collect()}
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in used.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= 2048


def test_rejects_texts_without_language(spark, frame):
    rng = random.Random(1)
    words = {"x": ["the", "and", "tion", "ing"], "y": ["sch", "ung", "keit", "der"]}
    rows = [(i, " ".join(rng.choice(words["xy"[i % 2]]) for _ in range(40)), "xy"[i % 2], "s") for i in range(80)]
    rows += [(100, None, "x", "s"), (101, "123 456 !!", "x", "s"), (102, "", None, None), (None, rows[0][1], "x", "s")]
    out = stage("language_id")(spark, frame(rows, "score lang_pred _row"), SF)
    got = [r.doc_id for r in out.collect()]
    assert len(got) == 81 and not {100, 101, 102} & set(got) and out.collect()[0]["lang_pred"] == "own lang_pred"


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_empty_table(spark, frame, name):
    assert stage(name)(spark, frame([]), SF).count() == 0
