import pytest
from oracle import same

from ledgerlens.plans import catalog

ORACLE = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, sf_dir, name):
    same(spark, QUERIES[name], ORACLE[name], sf_dir)


@pytest.mark.parametrize("name", ["c4_betweenness", "c7_core_numbers", "c9_communities", "m4_calibrate", "n1_isolation_forest", "n3_density_deviation", "q5_sequence_anomaly", "z13_simulate", "z1_accounts", "z6_inject", "h3_path_attribution", "m3_importance", "q4_sequence_codes", "s13_feature_entries"])
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
