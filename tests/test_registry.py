import pytest

from quillon.plans import registry

from . import oracle


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, data, con, name):
    oracle.compare(registry.QUERIES[name](spark, data), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    assert df.columns
    df.collect()


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())


QUANTILES = ["numeric_profile", "quantiles", "univariate_mad", "outlier_modified_z", "outlier_adjusted_boxplot", "information_gain", "psi_drift", "plot_box", "impute_median", "mahalanobis_top6", "regularised_series", "histogram_auto", "trimmed_mean", "stacked_profile", "kde_160"]


@pytest.mark.parametrize("name", QUANTILES)
def test_narrowing_instead_of_one_buffer(spark, data, con, name, monkeypatch):
    """Tables above the limit give the same results."""
    from quillon.operators import quantiles

    monkeypatch.setattr(quantiles, "SINGLE_PASS_VALUES", 100)
    monkeypatch.setattr(quantiles, "LISTED", 50)
    oracle.compare(registry.QUERIES[name](spark, data), con, registry.ORACLES[name])


def test_no_window_holds_a_table(spark, data):
    """Windows without a key stand on one row a bucket only."""
    import re

    for name in ("spearman_matrix", "ecdf", "fold_stability", "psi_drift", "even_sample", "slope_stability", "lag_difference", "cumulative_sum", "average_ranks"):
        plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if re.search(r"^\W*Window ", line) and "windowspecdefinition(__block#" not in line and re.search(r"windowspecdefinition\([a-z_]+#\d+L? ASC", line):
                assert "bucket#" in line, (name, line)


@pytest.mark.parametrize("case, spacing", [("even", "i * 400000"), ("one second", "i"), ("no rows", "i"), ("no times", "NULL::BIGINT")])
def test_regularised_series_on_any_steps(spark, tmp_path, case, spacing):
    """Steps that are mostly the same, or none at all, are put on the grid too."""
    import duckdb

    con = duckdb.connect()
    rows = 0 if case == "no rows" else 200
    con.execute(f"COPY (SELECT i AS event_id, make_timestamp(1704067200000000 + {spacing}) AS ts, (i * 37 % 101) / 4 AS value FROM range({rows}) r(i)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    oracle.compare(registry.QUERIES["regularised_series"](spark, str(tmp_path)), con, registry.ORACLES["regularised_series"])


def test_even_steps_stay(spark):
    """The operator itself leaves rows at even steps as they are."""
    from quillon.operators import temporal

    d = spark.sql("SELECT timestamp_millis(1704067200000 + id * 400) AS ts, double(id) AS value FROM range(50)")
    assert temporal.regularised(d, "value", "ts").count() == 50 and temporal.regularised(d, "value", "ts", uneven_only=False).count() == 20
