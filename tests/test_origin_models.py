"""Learners at every origin: fits against plain versions, the fold against a month-by-month loop, the candidate registry."""

from __future__ import annotations

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from funnelcast.operators import features as FE
from funnelcast.operators import forecast as FC
from funnelcast.operators import growers as G
from funnelcast.operators import origin_models as OM
from funnelcast.plans import training as TR
from funnelcast.sources import sinks as SK

SMALL = {"random_forest": {"n_estimators": 12, "max_depth": 3}, "gradient_boosting": {"n_estimators": 15}, "xgboost": {"n_estimators": 15}}


def walk(model, x):
    out = np.full(len(x), model["intercept"], float)
    for root in model["roots"]:
        for i in range(len(x)):
            node = root
            while model["feature"][node] >= 0:
                node = model["left"][node] + (x[i, model["feature"][node]] > model["threshold"][node])
            out[i] += model["value"][node]
    return out


def best_split(x, y, w, penalty=0.0):
    """Every border of every column, tried one by one."""
    found = []
    for f in range(x.shape[1]):
        v = np.unique(x[w > 0, f])
        for a, b in itertools.pairwise(v):
            low = x[:, f] <= (a + b) / 2
            found.append((sum((w[s] @ y[s]) ** 2 / (w[s].sum() + penalty) for s in (low, ~low)) - (w @ y) ** 2 / (w.sum() + penalty), f, (a + b) / 2))
    return max(found, key=lambda c: c[0])


# --------------------------------------------------------------------------- in-task fits
def test_linear_meets_its_normal_equations():
    rng = np.random.default_rng(1)
    x, y = rng.normal(5, 3, (30, 6)), rng.normal(100, 20, 30)
    x[:, 4] = 2 * x[:, 0] - x[:, 1]  # collinear
    x[:, 5] = 7.0  # no spread
    z = (x - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), 1)
    for alpha in (0.0, 1.0):
        m = G.linear(x, y, alpha)
        residual = y - m["intercept"] - x @ m["weights"]
        assert np.abs(z.T @ residual - alpha * m["weights"] * m["deviations"]).max() < 1e-8
        assert abs(residual.sum()) < 1e-8 and m["weights"][5] == pytest.approx(0)


def test_fewer_rows_than_columns_take_the_smallest_solution():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(5, 9)), rng.normal(size=5)
    m = G.linear(x, y)
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.pinv(z) @ (y - y.mean())
    assert np.allclose(m["weights"] * m["deviations"], beta) and np.allclose(m["intercept"] + x @ m["weights"], y)


def test_missing_cells_take_the_median():
    x = np.array([[1.0, np.nan, np.nan], [3.0, 4.0, np.nan], [np.nan, 6.0, np.nan], [9.0, 9.0, np.nan]])
    filled, medians = G.impute(x)
    assert medians.tolist() == [3.0, 6.0, 0.0] and filled.tolist() == [[1, 6, 0], [3, 4, 0], [3, 6, 0], [9, 9, 0]]


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(3)
    for trial in range(20):
        x, y = rng.normal(size=(15, 4)).round(1), rng.normal(size=15)
        w, penalty = rng.integers(0, 3, 15).astype(float), float(trial % 2)
        w[0] = 1.0
        trees, gains = G.Trees(), np.zeros((1, 4))
        tree = np.zeros(15, int)
        order = G.sorted_rows(x, tree)
        order = order[(w > 0)[order]].reshape(4, -1)
        fitted = G.grow(trees, x, y, w, order, tree, np.zeros(1, int), 1, penalty, 1.0, gains)
        cut, f, border = best_split(x, y, w, penalty)
        own = trees.own(0)
        assert gains.sum() == pytest.approx(cut, abs=1e-6) and own["feature"][0] == f and own["threshold"][0] == pytest.approx(border)
        for side in (x[:, f] <= border, x[:, f] > border):
            assert np.allclose(fitted[side], (w[side] @ y[side]) / (w[side].sum() + penalty))


def test_trees_grown_together_equal_trees_grown_alone():
    rng = np.random.default_rng(4)
    xs, ys = [rng.normal(size=(n, 5)) for n in (30, 12, 21)], [rng.normal(size=n) for n in (30, 12, 21)]
    together = G.boosting(xs, ys, 20, 3, 0.1, [1])
    for x, y, model in zip(xs, ys, together):
        (alone,) = G.boosting([x], [y], 20, 3, 0.1, [1])
        assert np.allclose(walk(model, x), walk(alone, x)) and np.allclose(model["importance"], alone["importance"], atol=1e-6)
        plain, fitted = np.full(len(y), y.mean()), y.mean()
        assert np.abs(y - walk(model, x)).sum() < np.abs(y - plain).sum() and fitted == model["intercept"]


def test_forest_stays_within_the_targets_and_depth():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(25, 3)), rng.normal(size=25)
    m = G.forest(x, y, 40, 3, [1], at_once=7)
    p = walk(m, rng.normal(size=(50, 3)) * 3)
    assert len(m["roots"]) == 40 and y.min() <= p.min() and p.max() <= y.max()
    assert m["importance"].sum() == pytest.approx(1) and len(m["feature"]) <= 40 * 15
    same = G.forest(x, np.full(25, 3.0), 5, 3, [1])
    assert np.allclose(walk(same, x), 3.0) and (same["feature"] == -1).all()


# --------------------------------------------------------------------------- all origins of all series
@pytest.fixture(scope="module")
def rows(spark, panel_small):
    return OM.learner_rows(panel_small, series_keys=("product",), share_product="BUILDING").cache()


@pytest.fixture(scope="module")
def models(rows):
    return OM.fit_origins(rows, ("product",), initial=70, params=SMALL).cache()


def series(rows, product):
    r = sorted(rows.where(F.col("product") == product).collect(), key=lambda r: r.rn)
    x = np.array([[np.nan if r[c] is None else r[c] for c in FE.FEATURE_COLUMNS] for r in r], float)
    return np.array([r.rn for r in r]), x, np.array([r.y for r in r]), r


def test_every_series_model_and_origin_has_a_fit(rows, models):
    last = {r["product"]: r["n"] for r in rows.groupBy("product").agg(F.max("rn").alias("n")).collect()}
    want = {(p, m, o) for p, n in last.items() for m in OM.LEARNERS for o in range(70, n + 1)}
    assert {(r["product"], r.model, r.origin) for r in models.select("product", "model", "origin").collect()} == want
    assert OM.fit_failures(rows, models, ("product",), initial=70).count() == 0


def test_one_step_scores_equal_plain_fits(rows, models):
    got = {(r["product"], r.model, r.origin): r for r in OM.one_step_forecasts(models, rows, ("product",), SMALL).collect()}
    rn, x, y, _ = series(rows, "BUILDING")
    for origin in (70, 75):
        train = (rn > 12) & (rn <= origin)
        filled, _ = G.impute(x[train])
        serve = np.nan_to_num(x[rn == origin + 1], nan=0.0)
        plain = {"ridge": G.linear(filled, y[train], 1.0), "linear_regression": G.linear(filled, y[train]),
                 "random_forest": G.forest(filled, y[train], 12, 3, [42, origin])}
        for name, m in plain.items():
            want = m["intercept"] + (serve @ m["weights"])[0] if "weights" in m else walk(m, serve)[0]
            assert got["BUILDING", name, origin].y_pred == pytest.approx(max(want, 0), rel=1e-9)
            assert got["BUILDING", name, origin].y_true == y[rn == origin + 1][0]
    last = F.max("origin").over(Window.partitionBy("product"))
    assert len(got) == models.withColumn("last", last).where("origin < last").count() > 0


def test_future_rows_do_not_change_an_origin(rows, models):
    cut = OM.fit_origins(rows.where("rn <= 72"), ("product",), initial=70, params=SMALL)
    a = {(r["product"], r.model, r.origin): r for r in cut.where("origin <= 71 and model in ('ridge', 'random_forest')").collect()}
    b = {(r["product"], r.model, r.origin): r for r in models.where("origin <= 71 and model in ('ridge', 'random_forest')").collect()}
    assert a.keys() == b.keys() and all(a[k] == b[k] for k in a)


def test_fold_features_equal_window_features(spark, rows, panel_small):
    history = FC.history_series(panel_small, series_keys=("product",))
    whole = history.groupBy("product").agg(F.array_sort(F.collect_list(F.struct("rn", "y"))).alias("r"), F.min("date").alias("start"))
    whole = whole.select("product", "start", F.transform("r", lambda r: r["y"]).alias("ys"))
    ops = F.struct(*[F.col(c) for c in FE.OPERATIONAL_FEATURES])
    j = rows.where("rn >= 14").join(whole, "product").select(
        "product", "rn", F.array(*FE.FEATURE_COLUMNS).alias("window"),
        OM.feature_array(F.slice("ys", 1, F.col("rn") - 1), F.col("date"), F.col("start"), ops).alias("fold"))
    for r in j.collect():
        for name, w, f in zip(FE.FEATURE_COLUMNS, r.window, r.fold):
            assert f == pytest.approx(0.0 if w is None else w, rel=1e-9, abs=1e-7), (name, r.rn)


def test_fold_equals_a_month_by_month_loop(spark, rows, models, panel_small):
    history = FC.history_series(panel_small, series_keys=("product",))
    own = models.where("origin = 75")
    got = {(r["product"], r.model, r.step): r for r in OM.recursive_forecast(own, rows, history, ("product",), 4, SMALL).collect()}
    assert len(got) == own.count() * 4
    fit = {r.model: r.asDict() for r in own.where("product = 'BUILDING'").collect()}
    rn, x, _, r = series(rows, "BUILDING")
    past = {h.rn: h for h in history.where("product = 'BUILDING'").collect()}
    ops = {c: np.nanmean([np.nan if r[c] is None else r[c] for r in r if 63 < r.rn <= 75]) for c in FE.OPERATIONAL_FEATURES}
    for name in ("ridge", "gradient_boosting"):
        work = [(past[i].date, past[i].y) for i in range(1, 76)]
        for step in range(1, 5):
            date = (work[-1][0].replace(day=28) + dt.timedelta(days=5)).replace(day=1)
            frame = spark.createDataFrame([*work, (date, None)], "date date, y double")
            f = FE.history_features(FE.time_features(frame)).where(F.col("date") == F.lit(date)).first().asDict() | ops
            at = np.array([[f[c] or 0.0 for c in FE.FEATURE_COLUMNS]], float)
            m = fit[name]
            want = m["intercept"] + (at @ np.array(m["weights"]))[0] if m["weights"] else walk(m, at)[0]
            assert got["BUILDING", name, step].y_pred == pytest.approx(max(want, 0), rel=1e-7), (name, step)
            assert got["BUILDING", name, step].date == date
            work.append((date, float(max(want, 0.0))))


def test_importances_are_shares(models):
    sums = OM.importances(models, ("product",)).groupBy("product", "model", "origin").agg(F.sum("importance").alias("s"), F.min("importance").alias("m"), F.count("*").alias("n")).collect()
    assert all(r.n == len(FE.FEATURE_COLUMNS) and r.m >= 0 for r in sums)
    assert all(r.s == pytest.approx(1) for r in sums if r.model not in ("ridge", "linear_regression"))


def test_audit_is_zero_at_the_optimum(rows, models):
    worst = OM.linear_audit(models, rows, ("product",)).agg(F.max("gradient")).first()[0]
    assert worst < 1e-8


# --------------------------------------------------------------------------- registry
def test_short_series_get_a_status_row(spark, panel_small):
    panel = panel_small.where("product = 'BUILDING' or (product = 'MACHINERY' and date < '1996-09-01') or (product = 'FURNITURE' and date < '1997-06-01')")
    run = TR.train_and_select(panel, series_keys=("product",), models=("seasonal_naive", "naive_last", "ridge"), share_product="BUILDING")
    status = {(r["product"], r.model): r for r in run["status"].collect()}
    assert len(status) == 9
    assert status["MACHINERY", "ridge"].status == "too_few_origins" and status["MACHINERY", "ridge"].months == 20 and status["MACHINERY", "ridge"].origins == 0
    assert status["FURNITURE", "naive_last"].status == "too_few_origins" and status["FURNITURE", "naive_last"].evaluated == 5
    assert "29 months" in status["FURNITURE", "naive_last"].reason
    assert all(status["BUILDING", m].status == "ok" and status["BUILDING", m].reason is None for m in ("ridge", "seasonal_naive", "naive_last"))
    assert {r["product"] for r in run["selection"].collect()} == {"BUILDING"}


def test_too_short_to_fit_is_a_failure_row(rows):
    short = rows.where("rn <= 6")
    fits = OM.fit_origins(short, ("product",), ("ridge",), initial=24)
    failures = OM.fit_failures(short, fits, ("product",), ("ridge",), initial=24).collect()
    assert fits.count() == 0 and {(r.model, r.origin) for r in failures} == {("ridge", 6)} and all("training rows" in r.reason for r in failures)


def test_learner_winner_is_saved_and_serves_again(spark, panel_small, tmp_path):
    panel = panel_small.where("product = 'BUILDING'")
    run = TR.forecast_year(panel, 2002, models=("ridge",), checkpoint_stages=True, share_product="BUILDING")
    assert run["table"].count() == 12 and run["table"].select("model").distinct().first()[0] == "ridge"
    saved = TR.refitted_winners(run)
    SK.save_artifacts(str(tmp_path), saved)
    back, _ = SK.load_artifacts(spark, str(tmp_path), list(saved))
    assert back["winner_fits"].count() == 1
    again = OM.recursive_forecast(back["winner_fits"], back["feature_rows"], back["history"], (), run["forecast"].count())
    want = {r.date: r.y_pred for r in run["forecast"].collect()}
    assert want and {r.date: r.y_pred for r in again.collect()} == pytest.approx(want)
