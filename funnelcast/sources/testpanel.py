"""Turn the driver's TPC-H-style tables into funnel panels.

``lineitem ⋈ orders ⋈ customer ⋈ nation`` becomes a monthly panel:

* ``date``      first of the month of ``o_orderdate``
* ``entity``    ``n_name``; ``product`` ``c_mktsegment``
* ``direction`` ``incoming`` for priorities 1-URGENT / 2-HIGH, else ``outgoing``
* stages (nested): APP every line; ACH order status <> 'O'; ACC status = 'F';
  APD and return flag <> 'R'; RE and return flag = 'A'; FI and line status = 'F';
  CO and discount < 0.05.

The ``period`` variant dates RE/FI/CO by ``l_shipdate`` (period-scoped counting:
a row may then show RE > APD while whole-window totals stay ordered).

Plan shape, chosen for scale:

1. lineitem is reduced to per-order counts first (``groupBy(l_orderkey)``); the
   map-side partial aggregate collapses clustered or hot order keys, and the
   aggregate's hash partitioning on the order key is reused by the join.
2. orders joins on the order key (one shuffle of orders), customer on the
   customer key (AQE splits a skewed customer and converts to a broadcast when
   the measured side is small).
3. nation is broadcast behind a bounded row count.
4. the final ``groupBy(date, entity, product, direction)`` partial-aggregates
   map-side, so a hot cell never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelcast.functions.columns import programme_label, with_calendar
from funnelcast.functions.vocab import FUNNEL_STAGES
from funnelcast.sources.tables import bounded_broadcast, read_table

PANEL_KEYS = ("date", "entity", "product", "direction")
PANEL_ORDER = ("date", "year", "month", "month_name", "quarter", "entity", "product", "direction", "programme")

# TPC-H defines exactly 25 nations; the bound is checked, not assumed.
_NATION_BOUND = 1000


def _month(c) -> F.Column:
    return F.trunc(F.col(c).cast("date"), "MM")


def _lineitem_counts(spark: SparkSession, sf_dir: str, by_ship_month: bool) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_returnflag", "l_linestatus", "l_discount", "l_shipdate"])
    kept = F.col("l_returnflag") != "R"
    realized = F.col("l_returnflag") == "A"
    finished = realized & (F.col("l_linestatus") == "F")
    completed = finished & (F.col("l_discount") < 0.05)
    keys = ["l_orderkey"]
    if by_ship_month:
        li = li.withColumn("ship_date", _month("l_shipdate"))
        keys.append("ship_date")
    return li.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(kept).alias("n_kept"),
        F.count_if(realized).alias("n_re"),
        F.count_if(finished).alias("n_fi"),
        F.count_if(completed).alias("n_co"),
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"])
    return o.select(
        "o_orderkey",
        "o_custkey",
        _month("o_orderdate").alias("date"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("incoming"))
        .otherwise(F.lit("outgoing"))
        .alias("direction"),
        (F.col("o_orderstatus") != "O").alias("achieved"),
        (F.col("o_orderstatus") == "F").alias("accepted"),
    )


def _gated(flag: str, count: str) -> F.Column:
    return F.when(F.col(flag), F.col(count)).otherwise(F.lit(0).cast("bigint"))


def order_cells(spark: SparkSession, sf_dir: str, variant: str = "main") -> DataFrame:
    """Stage counts per (date, customer, direction) before the dimension joins."""
    by_ship = variant == "period"
    li = _lineitem_counts(spark, sf_dir, by_ship)
    o = _orders(spark, sf_dir)
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    early = {
        "APP": F.col("n_all"),
        "ACH": _gated("achieved", "n_all"),
        "ACC": _gated("accepted", "n_all"),
        "APD": _gated("accepted", "n_kept"),
    }
    late = {
        "RE": _gated("accepted", "n_re"),
        "FI": _gated("accepted", "n_fi"),
        "CO": _gated("accepted", "n_co"),
    }
    zero = F.lit(0).cast("bigint")
    if not by_ship:
        return j.select("o_custkey", "date", "direction", *[c.alias(k) for k, c in {**early, **late}.items()])
    # Each (order, ship month) group yields an order-dated and a ship-dated row.
    order_dated = F.struct(
        F.col("date").alias("cell_date"),
        *[c.alias(k) for k, c in early.items()],
        *[zero.alias(k) for k in late],
    )
    ship_dated = F.struct(
        F.col("ship_date").alias("cell_date"),
        *[zero.alias(k) for k in early],
        *[c.alias(k) for k, c in late.items()],
    )
    return (
        j.select("o_custkey", "direction", F.inline(F.array(order_dated, ship_dated)))
        .withColumnRenamed("cell_date", "date")
    )


def build_test_panel(spark: SparkSession, sf_dir: str, variant: str = "main") -> DataFrame:
    """The §7.2 panel: one row per (date, entity, product, direction), non-empty cells only."""
    cells = order_cells(spark, sf_dir, variant)
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    nation = bounded_broadcast(read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"]), _NATION_BOUND)
    joined = (
        cells.join(customer, cells["o_custkey"] == customer["c_custkey"])
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    panel = (
        joined.groupBy(
            F.col("date"),
            F.col("n_name").alias("entity"),
            F.col("c_mktsegment").alias("product"),
            F.col("direction"),
        )
        .agg(*[F.sum(s).cast("bigint").alias(s) for s in FUNNEL_STAGES])
        .where(sum((F.col(s) for s in FUNNEL_STAGES), F.lit(0)) > 0)
    )
    panel = with_calendar(panel).withColumn("programme", programme_label("direction", "product"))
    return panel.select(*PANEL_ORDER, *FUNNEL_STAGES)


def build_daily_events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a daily panel: day x (user_id % 25) x event type counts.

    Stages are the event types in funnel order view -> click -> signup -> purchase;
    ``error`` rides along as a diagnostic column.
    """
    ev = read_table(spark, sf_dir, "events", ["ts", "user_id", "event_type"])
    stages = ("view", "click", "signup", "purchase")
    df = ev.groupBy(
        F.to_date("ts").alias("date"),
        F.concat(F.lit("segment_"), F.lpad(F.pmod("user_id", F.lit(25)).cast("string"), 2, "0")).alias("entity"),
        F.lit("events").alias("product"),
        F.lit("incoming").alias("direction"),
    ).agg(
        *[F.count_if(F.col("event_type") == s).cast("bigint").alias(s) for s in stages],
        F.count_if(F.col("event_type") == "error").cast("bigint").alias("error"),
    )
    df = with_calendar(df).withColumn("programme", programme_label("direction", "product"))
    return df.select(*PANEL_ORDER, *stages, "error")
