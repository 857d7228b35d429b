"""Registered queries against their DuckDB SQL on the smallest scale (a fast subset;
``python tests/oracle_check.py`` runs all of them at sf0.01)."""

import pytest

from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
FAST = ["a1_read_lines", "a10_extract_pages", "c1_c3_first_pass", "c4_c8_clean_corpus", "c5_c8_documents",
        "c11_article_body", "c13_infer_value", "d1_d2_documents", "d3_index_documents", "e2_assign_ids",
        "e4_tokens_to_ids", "a6_read_pairs", "g4_split_226", "g10_classification_features", "g12_pair_features",
        "h3_batches", "i1_softmax", "i14_classification_report", "i16_confusion_matrix", "i18_linear_scores",
        "j1_j2_token_vectors", "k2_tfidf", "f1_f7_plan", "f19_pretraining_records"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    import __spark_entry__ as E

    ok, info, _ = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert ok, info


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["doc_key", "sent_no", "ids"]
