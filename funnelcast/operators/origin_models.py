"""Feature-based learners at every origin of every series in one job.

Every series has its own models, refitted at each origin on its rows up to there (expanding window). Training
rows of a series are bounded by the calendar, so a series travels as one row of arrays; ``fit_origins`` explodes it
into (series, model, origins) jobs, deals these over the cluster and fits each with a small in-task
function. There is no driver loop over origins, series or models. Everything else is Spark SQL: features, the
walk through the trees, 1-step scores, the recursive forecast (one fold over the steps) and importances.

* Warm-up: the first ``min(12, max(3, origin // 3))`` months of a series do not train.
* Missing cells: median of the origin's training rows, 0 where a column has none; 0 when serving.
* A fit needs four training rows; fewer give a failure row from :func:`fit_failures`, never silence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.pandas.types import to_arrow_schema

from funnelcast.functions import vocab
from funnelcast.functions.columns import literal_map
from funnelcast.operators import features as FE
from funnelcast.operators import growers as G
from funnelcast.operators.evaluation import keyed_join
from funnelcast.session import share_package
from funnelcast.spec import DEFAULT_SPEC, FunnelSpec

# fixed values: candidate hyper-parameters of the source configuration
LEARNERS = {
    "linear_regression": {},
    "ridge": {"alpha": 1.0},
    "random_forest": {"n_estimators": 500, "max_depth": 6},
    "gradient_boosting": {"n_estimators": 400, "max_depth": 3, "learning_rate": 0.05},
    "xgboost": {"n_estimators": 600, "max_depth": 3, "learning_rate": 0.05, "subsample": 0.9},
}
MIN_TRAINING_ROWS = 4
ORIGINS_AT_ONCE = {"linear_regression": 1 << 20, "ridge": 1 << 20, "random_forest": 1}  # others: boosting rounds of 8 origins run side by side
MODEL = ("model string, origin int, n_train int, medians array<double>, intercept double, weights array<double>, "
         "means array<double>, deviations array<double>, importance array<double>, "
         "roots array<int>, feature array<int>, threshold array<double>, `left` array<int>, value array<double>")


def _keys(series_keys) -> list[str]:
    return list(series_keys or ())


def warm_up(origin: int) -> int:
    return min(12, max(3, origin // 3))


def learner_rows(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC, series_keys=(), share_product: str | None = None) -> DataFrame:
    """``(keys..., date, rn, y, features)``: the training matrix from the fourth month on, with the month's number."""
    keys = _keys(series_keys)
    matrix = FE.training_matrix(panel, spec, keys, min_history_months=3, share_product=share_product)
    return matrix.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("date")) + 3)


# --------------------------------------------------------------------------- fits
def _jobs(origins: Column, models: Sequence[str]) -> Column:
    """Array of (model, origins): the origins that one job fits."""

    def jobs(model: str) -> Column:
        n = ORIGINS_AT_ONCE.get(model, 8)
        last = F.floor((F.size(origins) - 1) / n).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.lit(model).alias("model"), F.slice(origins, i * n + 1, n).alias("origins")))

    return F.concat(*[jobs(m) for m in models])


def _fits(model: str, params: dict, origins: list[int], xs: list[np.ndarray], ys: list[np.ndarray], seed: int) -> list[dict]:
    none = {"weights": [], "means": [], "deviations": [], "roots": [], "feature": [], "threshold": [], "left": [], "value": []}
    if model in ("linear_regression", "ridge"):
        found = [G.linear(x, y, params.get("alpha", 0.0)) for x, y in zip(xs, ys)]
    elif model == "random_forest":
        found = [G.forest(x, y, params["n_estimators"], params["max_depth"], [seed, o]) for o, x, y in zip(origins, xs, ys)]
    else:
        found = G.boosting(xs, ys, params["n_estimators"], params["max_depth"], params["learning_rate"], [seed, origins[0]],
                           params.get("subsample", 1.0), 1.0 if model == "xgboost" else 0.0)
    return [none | one for one in found]


def _fitter(keys: list[str], schema: StructType, params: dict[str, dict], seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    width, arrow = len(FE.FEATURE_COLUMNS), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                model = row["model"].as_py()
                rn, y = row["rns"].values.to_numpy(zero_copy_only=False), row["ys"].values.to_numpy(zero_copy_only=False)
                x = row["xs"].values.to_numpy(zero_copy_only=False).reshape(-1, width)
                rows = {o: (rn > warm_up(o)) & (rn <= o) & ~np.isnan(y) for o in row["origins"].as_py()}
                origins = [o for o, train in rows.items() if train.sum() >= MIN_TRAINING_ROWS]
                if not origins:
                    continue
                filled, medians = zip(*[G.impute(x[rows[o]]) for o in origins])
                fits = _fits(model, params[model], origins, filled, [y[rows[o]] for o in origins], seed)
                out = [{"model": model, "origin": o, "n_train": int(rows[o].sum()), "medians": m, **f} for o, m, f in zip(origins, medians, fits)]
                columns = [pa.array([row[k].as_py()] * len(out), arrow.field(k).type) for k in keys]
                columns += [pa.array([o[f.name] for o in out], f.type) for f in list(arrow)[len(keys):]]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return run


def fit_origins(rows: DataFrame, series_keys=(), models: Sequence[str] = tuple(LEARNERS), initial: int = 24, step: int = 1,
                params: dict[str, dict] | None = None, seed: int = 42, final_only: bool = False) -> DataFrame:
    """One row per (series, model, origin) with the fitted model; ``rows`` from :func:`learner_rows`.

    Origins are ``initial, initial + step, ...`` and always the last month (the one to forecast from; only that one
    with ``final_only``).
    """
    keys = _keys(series_keys)
    spark = rows.sparkSession
    share_package(spark)
    own = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "rn", F.col("y").cast("double").alias("y"), F.array(*[F.col(c).cast("double") for c in FE.FEATURE_COLUMNS]).alias("x")))).alias("r"))
    last = F.element_at("r", -1)["rn"]
    seen = F.when(last > initial, F.sequence(F.lit(initial), last - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    origins = F.array(last) if final_only else F.array_append(seen, last)
    series = own.select(*keys, F.transform("r", lambda r: r["rn"]).alias("rns"), F.transform("r", lambda r: r["y"]).alias("ys"),
                        F.flatten(F.transform("r", lambda r: r["x"])).alias("xs"), F.explode(_jobs(origins, models)).alias("job"))
    jobs = series.select(*keys, "rns", "ys", "xs", "job.*")
    # a single series must not be fitted by one task; many series need no more tasks than a shuffle has
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    jobs = jobs.repartition(tasks, *keys, "model", "origins")
    schema = StructType([rows.schema[k] for k in keys] + StructType.fromDDL(MODEL).fields)
    schema = StructType([StructField(f.name, f.dataType) for f in schema])
    settings = {m: {**LEARNERS[m], **(params or {}).get(m, {})} for m in models}
    return jobs.mapInArrow(_fitter(keys, schema, settings, seed), schema)


# --------------------------------------------------------------------------- serving
def _predict(x: Column, depth: int) -> Column:
    """The model row's prediction at ``x`` (array of features without nulls): each tree is walked at most ``depth`` splits down."""
    dot = F.aggregate(F.zip_with("weights", x, lambda w, v: w * v), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))

    def down(node: Column, _: Column) -> Column:
        feature = F.get("feature", node)
        return F.when(feature < 0, node).otherwise(F.get("left", node) + (F.get(x, feature) > F.get("threshold", node)).cast("int"))

    leaves = F.aggregate("roots", F.lit(0.0), lambda a, root: a + F.get("value", F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, down)))
    return F.col("intercept") + dot + leaves


def _depth(params: dict[str, dict] | None = None) -> int:
    return max({**LEARNERS[m], **(params or {}).get(m, {})}.get("max_depth", 1) for m in LEARNERS)


def one_step_forecasts(models: DataFrame, rows: DataFrame, series_keys=(), params: dict[str, dict] | None = None) -> DataFrame:
    """``(model, keys..., origin, origin_date, date, step, y_true, y_pred)``: each origin's model at the next observed month.

    The next month's features only read months up to the origin (operational ones are lagged, so known).
    """
    keys = _keys(series_keys)
    served = F.transform(F.array(*FE.FEATURE_COLUMNS), lambda v: F.coalesce(v, F.lit(0.0)))
    target = rows.select(*keys, (F.col("rn") - 1).alias("origin"), "date", F.col("y").alias("y_true"), served.alias("x"))
    served = models.join(target, [*keys, "origin"])
    return served.select("model", *keys, "origin", F.add_months("date", -1).alias("origin_date"), "date", F.lit(1).alias("step"),
                         "y_true", F.greatest(_predict(F.col("x"), _depth(params)), F.lit(0.0)).alias("y_pred"))


def feature_array(ys: Column, date: Column, start: Column, operational: Column) -> Column:
    """The 40 features of month ``date`` for the history ``ys`` (all months since ``start``), as one array.

    The same definitions as the window features of :mod:`funnelcast.operators.features`, for use inside a fold
    where the history grows; months must number 13 at least.
    """
    n, month = F.size(ys), F.month(date)
    def lag(k: int) -> Column:
        return F.get(ys, n - k)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    def window(k: int) -> Column:
        return F.slice(ys, n - k + 1, F.lit(k))

    def deviation(k: int) -> Column:
        mean = total(window(k)) / k
        return F.sqrt(F.aggregate(window(k), F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / (k - 1))

    def growth(a: Column, b: Column) -> Column:
        return F.coalesce((a - b) / F.nullif(b, F.lit(0.0)) * 100.0, F.lit(0.0))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(1.0))

    def flag(months) -> Column:
        return F.when(month.isin(*months), 1.0).otherwise(0.0)

    season = F.element_at(literal_map({k: vocab.SEASON_CODES[v] for k, v in vocab.SEASON_BY_MONTH.items()}), month)
    angle = F.lit(2.0 * 3.141592653589793) * month / 12.0
    index = (F.year(date) - F.year(start)) * 12 + month - F.month(start)
    # months of the history that are a whole number of years before this one
    same = F.filter(ys, lambda _, i: F.pmod(n - i, F.lit(12)) == 0)
    centred = [2 * i - 5 for i in range(6)]  # x - mean(x) of six months, doubled
    slope = sum((lag(6 - i) * c for i, c in enumerate(centred)), F.lit(0.0)) / (sum(c * c for c in centred) / 2)
    columns = {
        "year": F.year(date), "month": month, "quarter": F.quarter(date), "season_code": season, "month_index": index,
        "month_sin": F.sin(angle), "month_cos": F.cos(angle), "month_sin2": F.sin(angle * 2), "month_cos2": F.cos(angle * 2),
        "is_break_season": flag(vocab.BREAK_MONTHS), "is_exam_season": flag(vocab.EXAM_MONTHS),
        "is_semester_start": flag(vocab.SEMESTER_START_MONTHS), "is_year_end": flag((12,)),
        "days_in_month": F.dayofmonth(F.last_day(date)),
        **{f"lag_{k}": lag(k) for k in vocab.LAG_MONTHS},
        **{f"roll_mean_{k}": total(window(k)) / k for k in vocab.ROLLING_WINDOWS},
        **{f"roll_std_{k}": deviation(k) for k in vocab.ROLLING_WINDOWS},
        "roll_max_12": F.array_max(window(12)), "roll_min_12": F.array_min(window(12)),
        "mom_growth": growth(lag(1), lag(2)), "yoy_growth": growth(lag(1), lag(13)),
        "lag1_over_lag12": ratio(lag(1), lag(12)), "lag1_over_roll12": ratio(lag(1), total(window(12)) / 12),
        "trend_slope_6": slope,
        "same_month_mean": total(same) / F.size(same),
        **{c: F.coalesce(operational[c], F.lit(0.0)) for c in FE.OPERATIONAL_FEATURES},
    }
    return F.array(*[columns[c].cast("double") for c in FE.FEATURE_COLUMNS])


def recursive_forecast(models: DataFrame, rows: DataFrame, history: DataFrame, series_keys=(), horizon: int | Column = 12,
                       params: dict[str, dict] | None = None) -> DataFrame:
    """``(keys..., origin, origin_date, step, model, y_pred, date)``: each model's forecast from its origin, fed back month by month.

    One fold over the steps inside the row of a (series, model, origin): the state is the history with the predictions so
    far, and every step computes its features from it. ``horizon`` is an int or a column over ``origin_date``. ``history`` has ``(keys..., rn, date, y)`` of dense series of 13
    months at least. Operational inputs stay at the mean of their last 12 lagged rows up to the origin.
    """
    keys = _keys(series_keys)
    by_month = Window.partitionBy(*keys).orderBy("rn")
    frozen = rows.select(*keys, F.col("rn").alias("origin"), F.struct(
        *[F.avg(c).over(by_month.rowsBetween(-11, 0)).alias(c) for c in FE.OPERATIONAL_FEATURES]).alias("ops"))
    whole = history.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rn", "y"))).alias("_r"), F.min("date").alias("start"))
    whole = whole.select(*keys, "start", F.transform("_r", lambda r: r["y"]).alias("ys"))
    m = keyed_join(models, whole, keys).join(frozen, [*keys, "origin"]).where(F.col("origin") >= 13)
    m = m.withColumn("origin_date", F.expr("add_months(start, origin - 1)"))
    m = m.withColumn("horizon", F.lit(horizon) if isinstance(horizon, int) else horizon)

    def step(ys: Column, k: Column) -> Column:
        date = F.add_months(F.col("start"), F.col("origin") + k - 1)
        x = F.array(feature_array(ys, date, F.col("start"), F.col("ops")))  # one element: bound once, read by every tree
        predicted = F.transform(x, lambda x: _predict(x, _depth(params)))
        return F.concat(ys, F.transform(predicted, lambda p: F.greatest(p, F.lit(0.0))))

    grown = F.aggregate(F.sequence(F.lit(1), F.col("horizon")), F.slice("ys", 1, F.col("origin")), step)
    fan = m.select(*keys, "origin", "origin_date", "model", F.posexplode(F.slice(grown, F.col("origin") + 1, F.col("horizon"))).alias("_i", "y_pred"))
    fan = fan.withColumn("step", F.col("_i") + 1)
    return fan.select(*keys, "origin", "origin_date", "step", "model", "y_pred", F.add_months("origin_date", F.col("step")).alias("date"))


# --------------------------------------------------------------------------- M11, checks, failures
def importances(models: DataFrame, series_keys=()) -> DataFrame:
    """``(keys..., model, origin, feature, importance)``: share of the loss cut (trees) or absolute standardised weight (linear)."""
    keys = _keys(series_keys)
    names = F.array(*[F.lit(c) for c in FE.FEATURE_COLUMNS])
    total = models.select(*keys, "model", "origin", F.inline(F.arrays_zip(names.alias("feature"), F.col("importance").alias("importance"))))
    whole = F.sum("importance").over(Window.partitionBy(*keys, "model", "origin"))
    share = F.when(F.col("model").isin("linear_regression", "ridge"), F.col("importance")).otherwise(
        F.coalesce(F.col("importance") / F.nullif(whole, F.lit(0.0)), F.lit(0.0)))
    return total.withColumn("importance", share)


def linear_audit(models: DataFrame, rows: DataFrame, series_keys=(), params: dict[str, dict] | None = None) -> DataFrame:
    """``(keys..., model, origin, feature, n_rows, median, mean, deviation, gradient)`` of the linear models.

    ``gradient`` is the derivative of the (penalised) squared error by a standardised weight, over the training rows and
    relative to the size of its terms: 0 at the optimum. Every origin meets its own rows only (equal keys and month numbers).
    """
    keys = _keys(series_keys)
    linear = models.where(F.col("model").isin("linear_regression", "ridge")).select(
        *keys, "model", "origin", "medians", "means", "deviations", "intercept", "weights")
    first = F.least(F.lit(12), F.greatest(F.lit(3), F.floor(F.col("origin") / 3).cast("int"))) + 1
    each = linear.withColumn("rn", F.explode(F.sequence(first, F.col("origin"))))
    x = F.array(*[F.col(c).cast("double") for c in FE.FEATURE_COLUMNS])
    data = each.join(rows.select(*keys, "rn", "y", x.alias("raw")), [*keys, "rn"]).where(F.col("y").isNotNull())
    data = data.withColumn("x", F.zip_with("raw", "medians", lambda v, m: F.coalesce(v, m)))
    dot = F.aggregate(F.zip_with("x", "weights", lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v)
    data = data.withColumn("residual", F.col("y") - F.col("intercept") - dot)
    names = F.array(*[F.lit(c) for c in FE.FEATURE_COLUMNS])
    long = data.select(*keys, "model", "origin", "y", "residual", F.inline(F.arrays_zip(
        names.alias("feature"), F.col("x").alias("x"), F.col("medians").alias("median"), F.col("means").alias("mean"),
        F.col("deviations").alias("deviation"), F.col("weights").alias("weight"))))
    z = (F.col("x") - F.col("mean")) / F.col("deviation")
    alpha = F.when(F.col("model") == "ridge", F.lit({**LEARNERS["ridge"], **(params or {}).get("ridge", {})}["alpha"])).otherwise(F.lit(0.0))
    summed = long.groupBy(*keys, "model", "origin", "feature", "median", "mean", "deviation", "weight").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(z * F.col("residual")).alias("g"), F.sum(F.abs(z * F.col("y"))).alias("size"))
    penalty = alpha * F.col("weight") * F.col("deviation")
    return summed.select(*keys, "model", "origin", "feature", "n_rows", "median", "mean", "deviation",
                         (F.abs(F.col("g") - penalty) / (F.col("size") + F.abs(penalty) + 1.0)).alias("gradient"))


def fit_failures(rows: DataFrame, models: DataFrame, series_keys=(), wanted: Sequence[str] = tuple(LEARNERS), initial: int = 24, step: int = 1) -> DataFrame:
    """``(keys..., model, origin, reason)`` for each wanted fit that has no model: the origins' training rows are too few."""
    keys = _keys(series_keys)
    last = rows.groupBy(*keys).agg(F.max("rn").alias("last"))
    seen = F.when(F.col("last") > initial, F.sequence(F.lit(initial), F.col("last") - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    asked = last.select(*keys, F.explode(F.array_append(seen, F.col("last"))).alias("origin"))
    asked = asked.withColumn("model", F.explode(F.array(*[F.lit(m) for m in wanted])))
    return asked.join(models.select(*keys, "model", "origin"), [*keys, "model", "origin"], "left_anti").select(
        *keys, "model", "origin", F.lit(f"fewer than {MIN_TRAINING_ROWS} training rows after warm-up").alias("reason"))
