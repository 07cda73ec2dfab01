"""Independent DuckDB SQL for every SQL-expressible query in ``__spark_entry__``.

The SQL is written from the operator definitions, not generated from the Spark
plans, so agreement is evidence of correctness. All views (lineitem, orders,
customer, nation, events, ...) are pre-registered by the checker. Derived DOUBLE
columns are rounded to 6 places on both sides.
"""

from __future__ import annotations

STAGES = ("APP", "ACH", "ACC", "APD", "RE", "FI", "CO")


def _panel_cte(variant: str = "main") -> str:
    """CTE chain ending in ``panel`` (the §7.2 test panel)."""
    if variant == "main":
        cells = """
cells AS (
  SELECT o.o_custkey, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS date,
         CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'incoming' ELSE 'outgoing' END AS direction,
         li.n_all AS APP,
         CASE WHEN o.o_orderstatus <> 'O' THEN li.n_all ELSE 0 END AS ACH,
         CASE WHEN o.o_orderstatus = 'F' THEN li.n_all ELSE 0 END AS ACC,
         CASE WHEN o.o_orderstatus = 'F' THEN li.n_kept ELSE 0 END AS APD,
         CASE WHEN o.o_orderstatus = 'F' THEN li.n_re ELSE 0 END AS RE,
         CASE WHEN o.o_orderstatus = 'F' THEN li.n_fi ELSE 0 END AS FI,
         CASE WHEN o.o_orderstatus = 'F' THEN li.n_co ELSE 0 END AS CO
  FROM li JOIN orders o ON li.l_orderkey = o.o_orderkey
)"""
        li_keys = "l_orderkey"
        li_select = "l_orderkey"
    else:
        cells = """
joined AS (
  SELECT o.o_custkey, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS odate, li.ship_date,
         CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'incoming' ELSE 'outgoing' END AS direction,
         o.o_orderstatus, li.*
  FROM li JOIN orders o ON li.l_orderkey = o.o_orderkey
),
cells AS (
  SELECT o_custkey, odate AS date, direction,
         n_all AS APP,
         CASE WHEN o_orderstatus <> 'O' THEN n_all ELSE 0 END AS ACH,
         CASE WHEN o_orderstatus = 'F' THEN n_all ELSE 0 END AS ACC,
         CASE WHEN o_orderstatus = 'F' THEN n_kept ELSE 0 END AS APD,
         0 AS RE, 0 AS FI, 0 AS CO
  FROM joined
  UNION ALL
  SELECT o_custkey, ship_date AS date, direction, 0, 0, 0, 0,
         CASE WHEN o_orderstatus = 'F' THEN n_re ELSE 0 END,
         CASE WHEN o_orderstatus = 'F' THEN n_fi ELSE 0 END,
         CASE WHEN o_orderstatus = 'F' THEN n_co ELSE 0 END
  FROM joined
)"""
        li_keys = "l_orderkey, CAST(date_trunc('month', l_shipdate) AS DATE)"
        li_select = "l_orderkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS ship_date"
    sums = ",\n         ".join(f"CAST(sum({s}) AS BIGINT) AS {s}" for s in STAGES)
    total = " + ".join(f"sum({s})" for s in STAGES)
    return f"""
li AS (
  SELECT {li_select}, count(*) AS n_all,
         count_if(l_returnflag <> 'R') AS n_kept,
         count_if(l_returnflag = 'A') AS n_re,
         count_if(l_returnflag = 'A' AND l_linestatus = 'F') AS n_fi,
         count_if(l_returnflag = 'A' AND l_linestatus = 'F' AND l_discount < 0.05) AS n_co
  FROM lineitem GROUP BY {li_keys}
),{cells},
grid AS (
  SELECT c.date, n.n_name AS entity, cu.c_mktsegment AS product, c.direction,
         {sums}
  FROM cells c JOIN customer cu ON c.o_custkey = cu.c_custkey
               JOIN nation n ON cu.c_nationkey = n.n_nationkey
  GROUP BY 1, 2, 3, 4
  HAVING {total} > 0
),
panel AS (
  SELECT date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
         strftime(date, '%b') AS month_name, CAST(quarter(date) AS INTEGER) AS quarter,
         entity, product, direction,
         CASE direction WHEN 'outgoing' THEN 'o' WHEN 'incoming' THEN 'i' ELSE '' END || product AS programme,
         {", ".join(STAGES)}
  FROM grid
)"""


def with_panel(body: str, variant: str = "main") -> str:
    return "WITH " + _panel_cte(variant).strip() + ",\n" + body.strip()


def sums(prefix: str = "") -> str:
    return ", ".join(f"CAST(sum({prefix}{s}) AS BIGINT) AS {s}" for s in STAGES)


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


def pct(num: str, den: str) -> str:
    return f"CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0) * 100.0"


def growth(cur: str, prev: str) -> str:
    return f"(CAST({cur} AS DOUBLE) / NULLIF(CAST({prev} AS DOUBLE), 0) - 1.0) * 100.0"
