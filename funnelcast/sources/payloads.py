"""Render a panel back into aggregation payloads (the two shapes the parser reads).

Used to build parser inputs from the driver's tables: the panel built from
lineitem/orders/customer/nation is rendered with ``to_json`` into one page per
(month, office) — flat, or nested buckets in either nesting order — so a parse
must give back exactly the panel (a round trip the oracle checks with a plain
GROUP BY). Each page is bounded (one office's products x directions x stages).

The renderings deliberately carry what the parser must cope with: parent
repeats next to the office node, alias direction spellings, unknown statuses,
mixed-case keys and a diagnostic status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelcast.functions.columns import literal_map
from funnelcast.sources.tables import bounded_broadcast
from funnelcast.spec import DEFAULT_SPEC, FunnelSpec

# stage -> status key used when rendering (any alias of the status map parses back)
STATUS_KEYS = {"APP": "applied", "ACH": "matched", "ACC": "an_accepted", "APD": "approved",
               "RE": "realized", "FI": "finished", "CO": "completed"}


def programme_ids(panel: DataFrame) -> DataFrame:
    """(programme_id, product): a dense id per product name (a bounded vocabulary)."""
    products = panel.select("product").distinct()
    return products.select(F.dense_rank().over(Window.orderBy("product")).cast("int").alias("programme_id"), "product")


def office_names(nation: DataFrame) -> DataFrame:
    """S3 dimension: office id -> name, from the nation table."""
    return nation.select(F.col("n_nationkey").cast("string").alias("office_id"), F.col("n_name").alias("entity"))


# id vocabularies (products, offices) are broadcast only after a bounded count
_VOCAB_BOUND = 100_000


def _long(panel: DataFrame, spec: FunnelSpec, programmes: DataFrame, offices: DataFrame) -> DataFrame:
    stacked = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).cast("bigint").alias("n")) for s in spec.stages])
    long = panel.select("date", "entity", "product", "direction", F.inline(stacked))
    return (
        long.join(bounded_broadcast(programmes, _VOCAB_BOUND), "product")
        .join(bounded_broadcast(offices, _VOCAB_BOUND), "entity")
        .withColumn("status", F.element_at(literal_map(STATUS_KEYS), F.col("stage")))
        .withColumn("month", F.date_format("date", "yyyy-MM"))
    )


def flat_pages(panel: DataFrame, programmes: DataFrame, offices: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """One flat page per (month, office): the office node plus parent repeats at the top level."""
    long = _long(panel, spec, programmes, offices)
    prefix = F.when(F.col("direction") == "incoming", "i").otherwise("o")
    key = F.concat(prefix, F.lit("_"), F.col("status"), F.lit("_"), F.col("programme_id").cast("string"))
    node = F.concat(F.lit('{"doc_count": '), F.col("n").cast("string"), F.lit(', "applicants": {"value": '),
                    F.col("n").cast("string"), F.lit("}}"))
    entry = F.concat(F.lit('"'), key, F.lit('": '), node)
    diag = F.concat(F.lit('"'), prefix, F.lit("_approval_broken_"), F.col("programme_id").cast("string"),
                    F.lit('": {"doc_count": 0}'))
    per_cell = long.select("month", "office_id", entry.alias("e"), F.when(F.col("stage") == spec.first, diag).alias("d"),
                           F.when(F.col("stage") == spec.first, F.col("n")).alias("app"))
    per_page = per_cell.groupBy("month", "office_id").agg(
        F.array_join(F.array_sort(F.collect_list("e")), ", ").alias("cells"),
        F.array_join(F.array_sort(F.collect_list("d")), ", ").alias("diags"),
        F.sum("app").alias("total"),
    )
    total = F.concat(F.lit('"applied_total": {"doc_count": '), F.col("total").cast("string"), F.lit("}"))
    office = F.concat(F.lit("{"), total, F.lit(", "), F.col("cells"), F.lit(", "), F.col("diags"), F.lit("}"))
    # open openings per (product, direction): incoming report seats, outgoing only opportunity counts
    wide = panel.join(bounded_broadcast(programmes, _VOCAB_BOUND), "product").join(
        bounded_broadcast(offices, _VOCAB_BOUND), "entity").select(
        F.date_format("date", "yyyy-MM").alias("month"), "office_id",
        F.concat(F.lit('"open_'), F.when(F.col("direction") == "incoming", "i").otherwise("o"), F.lit("_programme_"),
                 F.col("programme_id").cast("string"), F.lit('": '),
                 F.when(F.col("direction") == "incoming",
                        F.concat(F.lit('{"doc_count": '), F.col("ACC").cast("string"), F.lit(', "total_openings": {"value": '),
                                 F.col("APD").cast("string"), F.lit("}}")))
                 .otherwise(F.concat(F.lit('{"doc_count": '), F.col("ACC").cast("string"), F.lit("}")))).alias("o"))
    opens = wide.groupBy("month", "office_id").agg(F.array_join(F.array_sort(F.collect_list("o")), ", ").alias("opens"))
    page = F.concat(
        F.lit('{"response": {"'), F.col("office_id"), F.lit('": '), office,
        F.lit(", "), total, F.lit(", "), F.col("cells"), F.lit(", "), F.col("opens"), F.lit("}}"),  # parent repeats: ignored
    )
    out = per_page.join(opens, ["month", "office_id"]).select(
        "month", "office_id", F.lit(None).cast("string").alias("record_product"), page.alias("page"))
    return _spread(out)


def _bucket_list(name: str, items: str) -> F.Column:
    return F.struct(F.col(items).alias("buckets")).alias(name)


def nested_pages(panel: DataFrame, programmes: DataFrame, offices: DataFrame, spec: FunnelSpec = DEFAULT_SPEC,
                 order: str = "entity_first") -> DataFrame:
    """One nested-bucket page per (month, office).

    ``entity_first``: offices -> directions -> programmes -> statuses;
    ``direction_first``: types -> committees -> programmes -> stages.
    Directions use alias spellings; each programme carries an unknown status.
    """
    long = _long(panel, spec, programmes, offices)
    long = long.withColumn("dir_key", F.when(F.col("direction") == "incoming", F.lit("Hosting")).otherwise(F.lit("og")))
    status_bucket = F.struct(F.col("status").alias("key"), F.col("n").alias("doc_count"))
    unknown = F.struct(F.lit("withdrawn").alias("key"), F.lit(1).cast("bigint").alias("doc_count"))
    prog = long.groupBy("month", "office_id", "entity", "dir_key", "programme_id", "product").agg(
        F.array_union(F.array_sort(F.collect_list(status_bucket)), F.array(unknown)).alias("st"),
        F.sum(F.when(F.col("stage") == spec.first, F.col("n"))).alias("dc"),
    )
    status_dim = "statuses" if order == "entity_first" else "stages"
    prog_b = F.struct(F.col("programme_id").alias("key"), F.col("product").alias("key_as_string"),
                      F.col("dc").alias("doc_count"), _bucket_list(status_dim, "st"))
    if order == "entity_first":
        d = prog.groupBy("month", "office_id", "entity", "dir_key").agg(
            F.array_sort(F.collect_list(prog_b)).alias("pb"), F.sum("dc").alias("dc"))
        dir_b = F.struct(F.col("dir_key").alias("key"), F.col("dc").alias("doc_count"), _bucket_list("programmes", "pb"))
        o = d.groupBy("month", "office_id", "entity").agg(F.array_sort(F.collect_list(dir_b)).alias("db"), F.sum("dc").alias("dc"))
        off_b = F.struct(F.col("office_id").cast("int").alias("key"), F.col("entity").alias("key_as_string"),
                         F.col("dc").alias("doc_count"), _bucket_list("directions", "db"))
        top = o.select("month", "office_id", F.to_json(F.struct(F.struct(F.struct(F.array(off_b).alias("buckets")).alias("offices")).alias("aggregations"))).alias("page"))
    else:
        e = prog.groupBy("month", "office_id", "entity", "dir_key").agg(
            F.array_sort(F.collect_list(prog_b)).alias("pb"), F.sum("dc").alias("dc"))
        ent_b = F.struct(F.col("office_id").cast("int").alias("key"), F.col("entity").alias("key_as_string"),
                         F.col("dc").alias("doc_count"), _bucket_list("programmes", "pb"))
        dd = e.groupBy("month", "office_id", "dir_key").agg(F.array_sort(F.collect_list(ent_b)).alias("eb"), F.sum("dc").alias("dc"))
        dir_b = F.struct(F.col("dir_key").alias("key"), F.col("dc").alias("doc_count"), _bucket_list("committees", "eb"))
        top = dd.groupBy("month", "office_id").agg(F.array_sort(F.collect_list(dir_b)).alias("db")).select(
            "month", "office_id", F.to_json(F.struct(F.struct(F.col("db").alias("buckets")).alias("types"))).alias("page"))
    return _spread(top.select("month", "office_id", F.lit(None).cast("string").alias("record_product"), "page"))


def _spread(pages: DataFrame) -> DataFrame:
    """Pages hashed by (month, office) over the cluster's parallelism (explicit count, so AQE keeps it):
    the aggregate that renders them is small and would otherwise hand every page to one parsing task."""
    n = pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(n, "month", "office_id").drop("office_id")
