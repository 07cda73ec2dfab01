"""Column-expression helpers shared by all operators.

All helpers return ``pyspark.sql.Column`` built from JVM-side functions so they
stay inside whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelcast.functions import vocab


def col_or_name(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """``num / den`` with NULL instead of an error or infinity when den is 0 or NULL."""
    return col_or_name(num).cast("double") / F.nullif(col_or_name(den).cast("double"), F.lit(0.0))


def pct(num, den) -> Column:
    """Percentage ``num / den * 100``; NULL on a zero base."""
    return safe_div(num, den) * F.lit(100.0)


def growth_pct(current, previous) -> Column:
    """``(current / previous - 1) * 100`` (pandas ``pct_change``), NULL on a zero/missing base."""
    return (safe_div(current, previous) - F.lit(1.0)) * F.lit(100.0)


def coerce_bigint(c) -> Column:
    """Tolerant integer: anything unparseable becomes 0."""
    return F.coalesce(col_or_name(c).try_cast("bigint"), F.lit(0).cast("bigint"))


def literal_map(mapping: dict) -> Column:
    """A ``map<k,v>`` literal built from a small fixed dict."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def normalise_direction(c) -> Column:
    """12 direction spellings -> ``incoming`` / ``outgoing``; unknown or NULL -> NULL."""
    key = F.lower(F.trim(col_or_name(c).cast("string")))
    return F.try_element_at(literal_map(vocab.DIRECTION_ALIASES), key)


def stage_of_status(c) -> Column:
    """API status key -> stage code (case-insensitive); NULL when not a stage."""
    return F.try_element_at(literal_map(vocab.STATUS_TO_STAGE), F.lower(F.trim(col_or_name(c))))


def column_of_status(c) -> Column:
    """API status key -> stage code or diagnostic column name; NULL when unknown."""
    merged = dict(vocab.STATUS_TO_STAGE)
    merged.update(vocab.NON_STAGE_STATUSES)
    return F.try_element_at(literal_map(merged), F.lower(F.trim(col_or_name(c))))


def month_name(date_col) -> Column:
    """English three-letter month abbreviation (``%b``)."""
    return F.date_format(col_or_name(date_col), "MMM")


def month_abbr_of_number(month_col) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in vocab.MONTH_ABBR]), col_or_name(month_col).cast("int"))


def programme_label(direction_col, product_col) -> Column:
    """``o``/``i`` prefix + product; any other direction gets no prefix."""
    prefix = F.coalesce(F.try_element_at(literal_map(vocab.DIRECTION_PREFIX), col_or_name(direction_col)), F.lit(""))
    return F.concat(prefix, col_or_name(product_col).cast("string"))


def with_calendar(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Add year, month, month_name, quarter from a first-of-month DATE column."""
    d = F.col(date_col)
    return df.withColumns(
        {
            "year": F.year(d),
            "month": F.month(d),
            "month_name": month_name(d),
            "quarter": F.quarter(d),
        }
    )


def round_doubles(df: DataFrame, scale: int = 6) -> DataFrame:
    """Round every DOUBLE column (report layer / oracle comparison)."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            cols.append(F.round(F.col(f.name), scale).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def bround_doubles(df: DataFrame, scale: int) -> DataFrame:
    """Half-even rounding of every DOUBLE column (numpy-style report rounding)."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            cols.append(F.bround(F.col(f.name), scale).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
