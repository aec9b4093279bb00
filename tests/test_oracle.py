"""Every registered query of the library against its SQL, as the driver compares them."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from scanloom.plans import registry

from . import test_grids, test_operators, test_samples

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return ""
        if isinstance(v, (float, np.floating)):
            return f"{v:.6g}"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, np.integer)):
            return f"{float(v):.6g}" if abs(int(v)) < 10**6 else str(int(v))
        return str(v)

    return sorted(tuple(one(v) for v in row) for row in df.itertuples(index=False, name=None))


#: Queries that SQL doesn't express, and the tests that hold their operators against brute force or made values.
BRUTE = {
    "j16_greedy_match": "test_matching_strategies_differ_as_they_should",
    "j17_match_by_prediction": "test_matching_strategies_differ_as_they_should",
    "j18_maximal_match": "test_matching_strategies_differ_as_they_should",
    "v_components": "test_components_are_those_of_a_flood_fill",
    "v_noise": "test_places_as_in_numpy",
    "v_random_twins": "test_random_rows_and_twins",
    "v_probability_peaks": "test_peaks_of_the_query_are_those_of_brute_force",
}


def test_every_query_has_sql_or_a_named_test():
    assert set(registry.queries()) == set(registry.oracle_sql()) | set(BRUTE)
    assert not set(registry.oracle_sql()) & set(BRUTE)
    assert all(any(callable(getattr(m, name, None)) for m in (test_grids, test_operators, test_samples)) for name in BRUTE.values())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, sf_dir, db, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    if name not in registry.oracle_sql():
        assert name in BRUTE and len(got) > 0
        return
    want = db.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0 or len(want) == 0
    assert canonical(got) == canonical(want)
