import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from connlearn import fit_logistic, load_model, lr_weights, save_model, score_with_weights
from connlearn.operators.model import build_pipeline
from connlearn.plans.workflow import Workflow
from tests.fixtures import CONN_SCHEMA, TEST_LINES, TRAIN_LINES, lines_df
from connlearn import parse_records


def newton_binary(X, y, iters=50):
    w = np.zeros(X.shape[1])
    for _ in range(iters):
        p = 1 / (1 + np.exp(-X @ w))
        g = X.T @ (p - y)
        H = X.T @ (X * (p * (1 - p))[:, None])
        w -= np.linalg.solve(H, g)
    return w


def newton_multi(X, y, k, iters=60):
    """Pivoted softmax (class 0 margin fixed at 0), full Newton steps."""
    n, d = X.shape
    W = np.zeros((k - 1, d))
    Y = np.eye(k)[y][:, 1:]
    for _ in range(iters):
        M = np.hstack([np.zeros((n, 1)), X @ W.T])
        P = np.exp(M - M.max(1, keepdims=True))
        P /= P.sum(1, keepdims=True)
        P1 = P[:, 1:]
        g = ((P1 - Y).T @ X).ravel()
        H = np.zeros(((k - 1) * d, (k - 1) * d))
        for a in range(k - 1):
            for b in range(k - 1):
                c = P1[:, a] * ((a == b) - P1[:, b])
                H[a * d:(a + 1) * d, b * d:(b + 1) * d] = X.T @ (X * c[:, None])
        W -= np.linalg.solve(H, g).reshape(k - 1, d)
    return W


def _data(seed, n=400, d=3, k=2):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d))
    true = rng.normal(size=(k, d))
    M = X @ true.T
    P = np.exp(M - M.max(1, keepdims=True))
    P /= P.sum(1, keepdims=True)
    y = np.array([rng.choice(k, p=p) for p in P])
    return X, y


def test_binomial_weights_match_newton(spark):
    X, y = _data(1)
    df = spark.createDataFrame([(Vectors.dense(x.tolist()), float(t)) for x, t in zip(X, y)], ["features", "class"])
    model = fit_logistic(df, tol=1e-10, max_iter=500)
    assert np.allclose(model.coefficients.toArray(), newton_binary(X, y.astype(float)), atol=1e-4)
    w = lr_weights(model, spark).orderBy("feature").collect()
    assert [r["class"] for r in w] == [1, 1, 1]


def test_multinomial_pivoted_weights_and_predictions(spark):
    k = 3
    X, y = _data(2, k=k)
    df = spark.createDataFrame([(Vectors.dense(x.tolist()), float(t)) for x, t in zip(X, y)], ["features", "class"])
    model = fit_logistic(df, tol=1e-10, max_iter=500)
    W = newton_multi(X, y, k)
    got = {(r["class"], r["feature"]): r["weight"] for r in lr_weights(model, spark).collect()}
    for c in range(1, k):
        for j in range(X.shape[1]):
            assert got[(c, f"f{j}")] == pytest.approx(W[c - 1, j], abs=1e-3)
    pred = [r["prediction"] for r in model.transform(df).collect()]
    margins = np.hstack([np.zeros((len(X), 1)), X @ W.T])
    assert np.mean(np.array(pred) == margins.argmax(1)) > 0.99


def test_score_with_weights_matches_model(spark):
    X, y = _data(3)
    cols = ["a", "b", "c"]
    df = spark.createDataFrame([(*map(float, x), float(t)) for x, t in zip(X, y)], [*cols, "class"])
    w = newton_binary(X, y.astype(float))
    scored = score_with_weights(df, cols, [w.tolist()]).collect()
    for r, x in zip(scored, X):
        p = 1 / (1 + np.exp(-(x @ w)))
        assert r["probability"] == pytest.approx(p, abs=1e-12)
        assert r["prediction"] == float(p > 0.5)


def test_score_with_weights_ties_go_to_lowest_class(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (-1.0, 0.0)], "x double, y double")
    W = [[1.0, 0.0], [0.0, 1.0]]                          # class 1 margin x, class 2 margin y
    got = [r["prediction"] for r in score_with_weights(df, ["x", "y"], W, probability_col=None).collect()]
    assert got == [0.0, 1.0, 0.0]


def test_pipeline_save_load_scores_equal(spark, tmp_dir):
    tr = parse_records(lines_df(spark, TRAIN_LINES), CONN_SCHEMA, keep=("id",))
    ts = parse_records(lines_df(spark, TEST_LINES), CONN_SCHEMA, keep=("id",))
    model = build_pipeline(CONN_SCHEMA, categorical=True, classes="all").fit(tr)
    path = save_model(model, tmp_dir + "/m")
    save_model(model, path)                                  # overwrite works
    again = load_model(path)
    a = model.transform(ts).select("id", "prediction", "probability").orderBy("id").collect()
    b = again.transform(ts).select("id", "prediction", "probability").orderBy("id").collect()
    assert a == b and len(a) == 5                            # unseen label row dropped
    # the reloaded model scores raw, unlabelled records
    assert again.transform(ts.drop("label")).count() == 6


def test_unseen_category_scores_as_none_of_known(spark):
    tr = parse_records(lines_df(spark, TRAIN_LINES), CONN_SCHEMA, keep=("id",))
    ts = parse_records(lines_df(spark, TEST_LINES), CONN_SCHEMA, keep=("id",))
    flow = Workflow(CONN_SCHEMA, categorical=True, classes="binary")
    model = flow.fit(tr)
    names = flow.feature_names(model)
    assert names[-1] == "flag=<unseen>" and "service=<unseen>" in names
    feats = model.transform(ts).filter(F.col("id") == 2).select("features").collect()[0][0].toArray()
    # the unseen slot was constant (0) in training: it scales to 0.0
    assert feats[names.index("service=<unseen>")] == 0.0


def test_logistic_curve(spark):
    from connlearn.functions import logistic_curve

    rows = logistic_curve(spark).orderBy("x").collect()
    xs = np.linspace(-10, 10, 1000)
    assert len(rows) == 1000
    assert np.allclose([r["x"] for r in rows], xs, atol=1e-12)
    assert np.allclose([r["y"] for r in rows], 1 / (1 + np.exp(-0.5 * xs)), atol=1e-12)


def test_versions_survive_a_save_that_is_cut_off(spark, tmp_dir, monkeypatch):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import Bucketizer

    from connlearn import drop_versions, model_versions

    def made(cut):
        return Pipeline(stages=[Bucketizer(splits=[-1.0, cut, 9.0], inputCol="x", outputCol="y")]).fit(
            spark.createDataFrame([(1.0,)], "x double"))

    def cut_of(model):
        return model.stages[0].getSplits()[1]
    path = f"{tmp_dir}/store"
    save_model(made(1.0), path)
    save_model(made(2.0), path)
    assert model_versions(path) == [1, 2] and cut_of(load_model(path)) == 2.0 and cut_of(load_model(path, 1)) == 1.0

    class Broken(PipelineModel):
        def write(self):
            raise RuntimeError("lost")
    with pytest.raises(RuntimeError, match="lost"):
        save_model(Broken([]), path)
    assert model_versions(path) == [1, 2] and cut_of(load_model(path)) == 2.0
    save_model(made(4.0), path)                              # takes the next free number
    assert model_versions(path) == [1, 2, 4] and cut_of(load_model(path)) == 4.0
    with pytest.raises(ValueError, match="version 3"):
        load_model(path, 3)
    assert drop_versions(path) == [1, 2] and model_versions(path) == [4]
    plain = f"{tmp_dir}/plain"
    made(3.0).write().save(plain)
    assert cut_of(load_model(plain)) == 3.0
