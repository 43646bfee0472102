"""The registered queries: contract, and agreement with their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connection

SF = "/root/testdata/sf0.001"
AGREE = ("profile_histogram", "top_frequencies", "missing_patterns", "number_text", "label_collapse", "safe_ratio", "entity_features", "rfm_scores", "rfm_segments", "abc_bands",
         "cohort_months", "event_gaps", "basket_pairs", "masked_names", "sentence_bounds", "lexicon_matches", "previous_runs", "monthly_series", "stratified_folds", "autocorrelation")


def test_contract():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert oracles.keys() <= queries.keys() and len(queries) > 130 and all(callable(q) for q in queries.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", AGREE)
def test_agrees_with_sql(spark, name):
    result = compare(connection(SF), entry.queries()[name](spark, SF), entry.oracle_sql()[name])
    assert result.startswith("ok"), result
