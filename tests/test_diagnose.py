"""Score equations and separable training rows."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from connlearn import SeparableError, Workflow, fit_checked, fit_logistic, parse_records, score_equations, separation
from connlearn.operators.model import logistic
from tests.fixtures import CONN_SCHEMA, TRAIN_LINES, lines_df


def noisy(spark, n=400, k=3, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = rng.integers(0, k, n)
    return spark.createDataFrame([(float(c), Vectors.dense([*v, 0.0])) for c, v in zip(y, x)], ["class", "features"]), x, y


@pytest.mark.parametrize("k", [2, 3])
def test_score_equations_hold_at_the_optimum_only(spark, k):
    df, x, y = noisy(spark, k=k)
    model = fit_logistic(df, tol=1e-12)
    rows = {(r["class"], r.feature): r for r in score_equations(model.transform(df), k, ["a", "b", "zero"]).collect()}
    assert set(rows) == {(c, f) for c in range(k) for f in ("a", "b", "zero")}
    for (c, f), r in rows.items():
        want = 0.0 if f == "zero" else float(x[y == c, "ab".index(f)].sum() / len(y))
        assert r.observed == pytest.approx(want, abs=1e-12) and r.n == 400
        assert r.relative < 1e-6 and r.expected == pytest.approx(want, abs=1e-6)
    early = fit_logistic(df, max_iter=0)
    assert max(r.relative for r in score_equations(early.transform(df), k, ["a", "b", "zero"]).collect()) > 1e-3
    none = score_equations(model.transform(df.limit(0)), k, ["a", "b", "zero"])
    assert none.count() == 0


def test_separable_rows_are_found_before_the_weights_run_off(spark):
    df = spark.createDataFrame([(float(i % 2), Vectors.dense([(-1.0) ** i * (1 + i / 7), float(i % 3)])) for i in range(60)],
                               ["class", "features"])
    lr = logistic(tol=1e-12)
    with pytest.raises(SeparableError, match="60 training rows are separable"):
        fit_checked(lr, df, "error", probe_iter=5)
    model, found = fit_checked(lr, df, "flag", probe_iter=5)
    assert found.separable and found.rows == 60 and found.least_margin > 0
    full, none = fit_checked(lr, df, "ignore")
    assert none is None
    assert abs(model.coefficients.toArray()).max() < abs(full.coefficients.toArray()).max()
    with pytest.raises(ValueError, match="on_separable"):
        fit_checked(lr, df, "maybe")


def test_rows_that_are_not_separable_are_fitted_to_the_end(spark):
    df, *_ = noisy(spark)
    full = fit_logistic(df, tol=1e-12)
    model, found = fit_checked(logistic(tol=1e-12), df, "error", probe_iter=2)
    assert not found.separable and found.wrong > 0
    assert np.allclose(model.coefficientMatrix.toArray(), full.coefficientMatrix.toArray(), atol=1e-9)
    model, found = fit_checked(logistic(tol=1e-12), df, "error")
    assert found is None and np.allclose(model.coefficientMatrix.toArray(), full.coefficientMatrix.toArray(), atol=1e-9)
    empty = separation(model.transform(df.limit(0)))
    assert empty.rows == 0 and not empty.separable


def test_workflow_flags_or_refuses(spark):
    tr = parse_records(lines_df(spark, TRAIN_LINES * 3), CONN_SCHEMA)
    flow = Workflow(CONN_SCHEMA, categorical=True, classes="binary", tol=1e-12)
    flow.fit(tr)
    assert flow.separation is not None and flow.separation.separable
    with pytest.raises(SeparableError):
        Workflow(CONN_SCHEMA, categorical=True, classes="binary", tol=1e-12, on_separable="error").fit(tr)
    mixed = tr.unionByName(tr.replace("normal.", "scan.", "label"))
    flow = Workflow(CONN_SCHEMA, categorical=True, classes="binary", tol=1e-12, on_separable="error")
    eq = flow.score_equations(flow.fit(mixed), mixed).collect()
    assert len(eq) == 2 * len(flow.feature_names(flow.fit(mixed))) and max(r.relative for r in eq) < 1e-5
