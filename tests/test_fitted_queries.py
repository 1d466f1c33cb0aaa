import numpy as np
import pytest
from pyspark.sql import functions as F

from contract import registry
from plotwise.operators import model, stumps

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scored(spark):
    return [r.asDict() for r in registry.scored_of(spark, SF)[1].collect()]


def rows_of(spark, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, SF).collect()]


def test_metrics_of_the_fitted_model(spark, scored):
    actual, predicted = (np.array([r[c] for r in scored], float) for c in ("actual", "predicted"))
    miss = predicted - actual
    [got] = rows_of(spark, "fitted_metrics")
    assert got["n"] == len(scored) > 0
    assert got["mae"] == pytest.approx(np.abs(miss).mean(), rel=1e-3)
    assert got["rmse"] == pytest.approx(np.sqrt((miss ** 2).mean()), rel=1e-3)
    assert got["r_squared"] == pytest.approx(1 - (miss ** 2).sum() / ((actual - actual.mean()) ** 2).sum(), abs=1e-3)
    assert got["mape"] is not None


def test_rows_of_the_fitted_model(spark, scored):
    worst = rows_of(spark, "fitted_worst_predictions")
    order = sorted(scored, key=lambda r: (-abs(r["residual"]), r["sale_id"]))[:10]
    assert [r["sale_id"] for r in worst] == [r["sale_id"] for r in order]
    assert [r["residual"] for r in worst] == pytest.approx([r["residual"] for r in order])
    bins = rows_of(spark, "fitted_residual_histogram")
    misses = [r["residual"] for r in scored]
    assert sum(b["count"] for b in bins) == len(scored)
    assert (bins[0]["min_residual"], bins[-1]["max_residual"]) == pytest.approx((min(misses), max(misses)))


def test_values_and_shares_of_the_fitted_model(spark):
    values = rows_of(spark, "fitted_predictions")
    assert len(values) == len(rows_of(spark, "ml_predictions")) > 0
    assert all(v["predicted_value"] > 0 for v in values) and len({v["predicted_value"] for v in values}) > 10
    shares = rows_of(spark, "fitted_importance")
    assert {s["feature"] for s in shares} == set(registry.MODEL_FEATURES)
    assert sum(s["importance"] for s in shares) == pytest.approx(100, abs=0.1)


def test_stumps_equal_a_plain_search(spark):
    rng = np.random.default_rng(3)
    n = 300
    a, b = rng.integers(0, 6, n), rng.integers(0, 40, n)
    y = 1000 * (a > 2) + 30 * b + rng.integers(0, 50, n)
    lost = rng.random(n) < 0.1
    rows = [(int(v), None if m else int(x), int(z)) for v, x, z, m in zip(y, a, b, lost)] + [(None, 1, 1)]
    fitted = stumps.fit(spark.createDataFrame(rows, "y bigint, a int, b int"), "y", ["a", "b"], 5)
    table = {"a": np.where(lost, -1, a), "b": b}
    pred = np.full(n, int(np.floor(y.sum() / n)))
    assert fitted.base == pred[0] and len(fitted.stumps) == 5
    for stump in fitted.stumps:
        r = y - pred

        def gain(f, cut):
            left = table[f] <= cut
            return sum(float(r[m].sum()) ** 2 / m.sum() for m in (left, ~left)) - float(r.sum()) ** 2 / n

        tried = {(f, c): gain(f, c) for f in ("a", "b") for c in range(40) if c in table[f] and (table[f] > c).any()}
        assert tried[stump.feature, stump.cut] == pytest.approx(max(tried.values())) == pytest.approx(stump.gain)
        left = table[stump.feature] <= stump.cut
        assert (stump.left, stump.right) == tuple(int(np.floor(r[m].sum() / (2 * m.sum()))) for m in (left, ~left))
        pred = pred + np.where(left, stump.left, stump.right)
    got = stumps.score(fitted, spark.createDataFrame(rows[:-1], "y bigint, a int, b int")).collect()
    assert [r["predicted"] for r in got] == pred.tolist()
    nothing = stumps.fit(spark.createDataFrame([], "y bigint, a int, b int"), "y", ["a", "b"])
    assert nothing.stumps == () and nothing.base == 0
    flat = stumps.fit(spark.createDataFrame([(5, 1, None)] * 4, "y bigint, a int, b int"), "y", ["a", "b"])
    assert flat.stumps == () and flat.base == 5


def test_a_row_does_not_see_its_own_label(spark):
    rows = [(i, "a" if i % 3 else "b", float(i)) for i in range(12)] + [(12, None, 50.0), (13, "z", 9.0)]
    df = spark.createDataFrame(rows, "sale_id bigint, c string, y double")
    got = {r["sale_id"]: r["c__mean"] for r in model.means_of_other_folds(df, "c", "y", 7.0, F.pmod("sale_id", F.lit(4))).collect()}
    for i, c, _ in rows:
        others = [y for j, d, y in rows if d == c and j % 4 != i % 4]
        assert got[i] == pytest.approx((sum(others) + 70) / (len(others) + 10))
