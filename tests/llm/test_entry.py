from __spark_entry__ import oracle_sql, queries
from concord.llm.queries import ORACLES, QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert {n.split("_")[0] for n in set(QUERIES) - set(ORACLES)} == {"op1", "op4", "op5", "op7", "op10", "op11", "op13"}


def test_results_have_the_contract_columns(spark):
    folder = "/root/testdata/sf0.001"
    want = {
        "op2_top_k": "query_id rank vec_id score", "op3_license_scan": "doc_id", "op5_quality_classifier": "doc_id held_out score predicted",
        "op6_mixing": "doc_id size source_size target taken", "op7_token_counts": "doc_id n_bytes n_tokens over_limit",
        "op13_spellings": "word form root n n_near form_n", "op12_collocations": "lang rank phrase a l r n score", "op11_languages": "doc_id held_out lang_pred score", "op9_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    }
    for name, columns in want.items():
        df = QUERIES[name](spark, folder)
        assert set(columns.split()) <= set(df.columns), name
        assert all(kind in ("bigint", "boolean", "double", "int", "string") for _, kind in df.dtypes), name
