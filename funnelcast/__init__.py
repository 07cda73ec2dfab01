"""funnelcast — funnel, seasonality and forecasting analytics as Spark DataFrame operators.

Every operator takes DataFrames (usually a *panel*: one row per month x entity x
product x direction with one BIGINT column per funnel stage) and returns a lazy
DataFrame, so Catalyst plans the whole chain and nothing is pulled to the driver.
"""

from funnelcast.spec import FunnelSpec, DEFAULT_SPEC

__all__ = ["FunnelSpec", "DEFAULT_SPEC"]
