"""Additive Holt-Winters (M5) with estimated start values, all origins of all series in one job.

The source's estimator minimises the squared one-step errors over the smoothing weights *and* the start
values (level, trend, twelve seasonal values) at every origin. :mod:`funnelcast.operators.smoothing` does
that for one series: start values by linear least squares, weights by a grid and a pattern search. Here a
series travels as one array of its months (bounded by the calendar) and is exploded into jobs of a few
origins each, dealt over the cluster; there is no driver loop over origins or series.

Seasonal fits serve origins of two cycles or more, shorter ones get level and trend only; an origin below
three months has no fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from funnelcast.operators import smoothing
from funnelcast.session import share_package

STATE = "origin int, sse double, alpha double, beta double, gamma double, level double, trend double, season array<double>"
ORIGINS_AT_ONCE = 8


def _fitter(keys: list[str], schema: StructType, period: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fits = smoothing.fit(np.array(row["ys"], float), row["origins"], period)
                if fits:
                    columns = [pa.array([row[k]] * len(fits), arrow.field(k).type) for k in keys]
                    columns += [pa.array([f[c.name] for f in fits], c.type) for c in list(arrow)[len(keys):]]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return run


def holt_winters_states(history: DataFrame, origin_rows: DataFrame, series_keys=(), period: int = 12) -> DataFrame:
    """Fitted state per (series, origin): ``(keys..., origin, origin_date, sse, alpha, beta, gamma, level, trend, season)``.

    ``season`` holds the next ``period`` months' terms. Callers that need several origin sets (backtest origins and the
    final origin) should request them together and reuse the result.
    """
    keys = list(series_keys or ())
    spark = history.sparkSession
    share_package(spark)
    single = not keys
    if single:  # one total series: a constant key, not a literal (the optimizer drops those), keeps every join an equi-join
        keys = ["_series"]
        history, origin_rows = (df.withColumn("_series", F.col("rn") % 1) for df in (history, origin_rows))
    arrays = history.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "y"))), lambda s: s["y"].cast("double")).alias("ys"))
    wanted = origin_rows.select(*keys, F.col("rn").cast("int").alias("origin"), F.col("date").alias("origin_date"))
    asked = wanted.groupBy(*keys).agg(F.array_sort(F.collect_set("origin")).alias("o"))
    last = F.floor((F.size("o") - 1) / ORIGINS_AT_ONCE).cast("int")
    some = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("o", i * ORIGINS_AT_ONCE + 1, ORIGINS_AT_ONCE))
    jobs = arrays.join(asked, keys).select(*keys, "ys", F.explode(some).alias("origins"))
    jobs = jobs.select(*keys, F.slice("ys", 1, F.array_max("origins")).alias("ys"), "origins")  # nothing after the last origin
    # a single series must not be fitted by one task; many series need no more tasks than a shuffle has
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = StructType([StructField(k, history.schema[k].dataType) for k in keys] + StructType.fromDDL(STATE).fields)
    fits = jobs.repartition(tasks, *keys, "origins").mapInArrow(_fitter(keys, schema, period), schema)
    best = fits.join(wanted, [*keys, "origin"])
    return best.drop("_series") if single else best


def holt_winters_from_states(states: DataFrame, series_keys=(), horizon=1, period: int = 12) -> DataFrame:
    """Forecasts ``level + h * trend + season[(h - 1) mod period]`` for steps 1..horizon (int or column)."""
    keys = list(series_keys or ())
    h = F.lit(horizon) if isinstance(horizon, int) else horizon
    fan = states.withColumn("step", F.explode(F.sequence(F.lit(1), h)))
    point = F.col("level") + F.col("step") * F.col("trend") + F.element_at(
        "season", (F.pmod(F.col("step") - 1, F.lit(period)) + 1).cast("int")
    )
    return fan.select(
        *keys, "origin", "origin_date", "step", F.lit("holt_winters").alias("model"),
        F.greatest(point, F.lit(0.0)).alias("y_pred"), "alpha", "beta", "gamma",
    )


def holt_winters_forecasts(
    history: DataFrame, origin_rows: DataFrame, series_keys=(), horizon=1, period: int = 12,
) -> DataFrame:
    """``(keys..., origin, origin_date, step, model, y_pred, alpha, beta, gamma)`` for each requested origin."""
    return holt_winters_from_states(holt_winters_states(history, origin_rows, series_keys, period), series_keys, horizon, period)
