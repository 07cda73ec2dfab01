"""Parsing aggregation payloads into the panel.

Pages arrive as rows ``(month, record_product, page)`` where ``page`` is a JSON
string or VARIANT. Two payload shapes are understood:

* **flat** (P7-P9): ``{"response": {"<office id>": {"applied_total": ..., "<i|o>_<status>_<programme id>": {"doc_count": n}}}}``.
  Only the all-digit child nodes carrying ``applied_total`` are read; the parent
  repeats (``applied_total``, ``i_applied_7`` at top level) are ignored.
* **nested buckets** (P3-P6): ``{"<dimension>": {"buckets": [{key, key_as_string?, doc_count?, "<dimension>": {...}}]}}``
  at any depth and in any order. The walk is unrolled level by level as
  generator steps over VARIANT (objects -> ``map<string, variant>``, arrays ->
  ``array<variant>``), so every page is walked in parallel and nothing is
  collected; the only shuffle is the final cell aggregation.

Both produce long cells ``(month, record_product, entity, product, direction,
column, n, fault)``; ``fault`` says why a count that is present counts 0. Pages that cannot be read are
never lost silently: :func:`quarantine` lists them and :func:`page_audit` counts pages, unreadable pages
and faulty counts per record. :func:`cells_to_panel` applies defaults, collapses duplicates,
drops empty cells and adds the calendar columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelcast.functions import vocab
from funnelcast.functions.columns import (
    column_of_status,
    normalise_direction,
    programme_label,
    stage_of_status,
    with_calendar,
)
from funnelcast.plans.materialize import materialize
from funnelcast.sources.tables import bounded_broadcast
from funnelcast.spec import DEFAULT_SPEC, FunnelSpec

CELL_COLUMNS = ("month", "record_product", "entity", "product", "direction", "column", "n", "fault")
_LOOKUP_BOUND = 100_000  # id -> name dimensions (offices, programmes) are small vocabularies


# --------------------------------------------------------------------------- P1
def month_windows(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Inclusive calendar-month windows clipped to ``[start, end]``; a reversed range raises."""
    s, e = F.to_date(F.col(start)), F.to_date(F.col(end))
    checked = bounds.select(
        F.when(s > e, F.raise_error(F.concat(F.lit("start ("), s.cast("string"), F.lit(") must not be after end ("),
                                             e.cast("string"), F.lit(")"))))
        .otherwise(s).alias("_s"),
        e.alias("_e"),
    )
    firsts = checked.select("_s", "_e", F.explode(F.sequence(F.trunc("_s", "MM"), "_e", F.expr("INTERVAL 1 MONTH"))).alias("_m"))
    return firsts.select(
        F.date_format("_m", "yyyy-MM").alias("month"),
        F.greatest(F.col("_m"), F.col("_s")).alias("window_start"),
        F.least(F.last_day("_m"), F.col("_e")).alias("window_end"),
    )


# --------------------------------------------------------------------------- P2
def redact(text: Column, token: Column) -> Column:
    """Every occurrence of ``token`` replaced by the redaction mark; NULL/empty token is a no-op."""
    return F.when(token.isNull() | (token == ""), text).otherwise(F.replace(text, token, F.lit(vocab.REDACTION_MARK)))


# --------------------------------------------------------------------------- helpers
def _obj(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _arr(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _str(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _integer(v: Column, path: str) -> tuple[Column, Column]:
    """The value at ``path`` and its integer: numbers lose their fraction, strings must spell an integer; NULL if there is none."""
    x = F.try_variant_get(v, path, "variant")
    text = F.trim(F.try_variant_get(x, "$", "string"))
    spelled = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))
    real = F.try_variant_get(x, "$", "double")
    number = F.coalesce(F.try_variant_get(x, "$", "bigint"), F.when(F.abs(real) < float(1 << 63), real.try_cast("bigint")))
    return x, F.when(F.schema_of_variant(x) == "STRING", spelled).otherwise(number)


def _count(v: Column, path: str = "$.doc_count") -> Column:
    """Tolerant integer: malformed or missing -> 0."""
    return F.coalesce(_integer(v, path)[1], F.lit(0).cast("bigint"))


def _count_fault(v: Column, path: str = "$.doc_count") -> Column:
    """Why a count that is there is not counted, else NULL."""
    x, n = _integer(v, path)
    return F.when(x.isNotNull() & ~F.is_variant_null(x) & n.isNull(), F.lit("no integer of 64 bits"))


def _id(text: Column) -> Column:
    """A numeric id as text without leading zeros (ids may exceed any integer type); NULL for anything else."""
    plain = F.regexp_replace(F.trim(text), "^[+]?0*(?=[0-9])", "")
    return F.when(plain.rlike("^-?[0-9]+$"), plain)


def _names(programme_names: DataFrame) -> DataFrame:
    by_id = programme_names.groupBy(F.col("programme_id").cast("string").alias("programme_id"))
    return bounded_broadcast(by_id.agg(F.max("product").alias("_pname")), _LOOKUP_BOUND)


def with_variant_page(pages: DataFrame, page: str = "page") -> DataFrame:
    dt = dict(pages.dtypes)[page]
    return pages if dt == "variant" else pages.withColumn(page, F.try_parse_json(F.col(page)))


def _body(page: Column) -> Column:
    """Entries of ``response`` where the page has one, else of the page; NULL where that is no object."""
    response = F.try_variant_get(page, "$.response", "variant")
    return F.when(response.isNotNull(), _obj(response)).otherwise(_obj(page))


# --------------------------------------------------------------------------- pages that cannot be read
def page_fault(page: Column) -> Column:
    """Why a VARIANT page cannot be read (NULL if it can)."""
    return F.when(page.isNull(), "not JSON").when(_obj(page).isNull() & _arr(page).isNull(), "neither object nor list")


def quarantine(pages: DataFrame) -> DataFrame:
    """``(month, record_product, reason, raw)`` of the pages that cannot be read; ``raw`` is their text as far as it is known."""
    raw = F.col("page") if dict(pages.dtypes)["page"] == "string" else F.to_json("page")
    p = with_variant_page(pages.withColumn("raw", raw)).withColumn("reason", page_fault(F.col("page")))
    return p.where(F.col("reason").isNotNull()).select("month", "record_product", "reason", "raw")


def page_audit(pages: DataFrame, cells: DataFrame) -> DataFrame:
    """Per (month, record_product): pages, unreadable pages, cells and faulty counts."""
    keys = ["month", "record_product"]
    p = with_variant_page(pages).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages"), F.count(page_fault(F.col("page"))).alias("malformed_pages"))
    c = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cells"), F.count("fault").alias("_faulty"))
    same = [p[k].eqNullSafe(c[k]) for k in keys]
    return p.join(c, same[0] & same[1], "left").select(
        p["month"], p["record_product"], "pages", "malformed_pages", F.coalesce("_cells", F.lit(0)).alias("cells"),
        F.coalesce("_faulty", F.lit(0)).alias("faulty_counts"))


# --------------------------------------------------------------------------- P7
def is_flat_payload(page: Column) -> Column:
    """Shape router: the body (``response``, or the page where it has none) has ``applied_total`` or a cell-shaped key."""
    body = _body(page)
    keys = F.map_keys(body)
    return F.coalesce(
        F.map_contains_key(body, F.lit(vocab.FLAT_ENTITY_MARKER))
        | F.exists(keys, lambda k: k.rlike(vocab.FLAT_CELL_PATTERN)),
        F.lit(False),
    )


# --------------------------------------------------------------------------- P8, P9, P12, S3
def flat_cells(pages: DataFrame, programme_names: DataFrame, entity_names: DataFrame | None = None) -> DataFrame:
    """Cells of flat pages: child office nodes only, ``<i|o>_<status>_<id>`` keys, doc_count measure.

    ``programme_names``: (programme_id, product STRING); unknown id, of any size -> ``programme_<id>``.
    ``entity_names``: (office_id STRING, entity STRING); unknown -> ``office <id>``.
    Statuses map to stages or diagnostic columns; unknown statuses are skipped.
    """
    p = with_variant_page(pages)
    offices = p.select("month", "record_product", F.explode(_body(F.col("page"))).alias("office_id", "node"))
    node_map = _obj(F.col("node"))
    offices = offices.where(
        F.col("office_id").rlike("^[0-9]+$") & F.coalesce(F.map_contains_key(node_map, F.lit(vocab.FLAT_ENTITY_MARKER)), F.lit(False))
    ).select("month", "record_product", "office_id", F.explode(node_map).alias("metric", "m"))
    pat = vocab.FLAT_CELL_PATTERN
    cells = offices.where(F.col("metric").rlike(pat)).select(
        "month",
        "record_product",
        "office_id",
        normalise_direction(F.regexp_extract("metric", pat, 1)).alias("direction"),
        _id(F.regexp_extract("metric", pat, 3)).alias("programme_id"),
        column_of_status(F.regexp_extract("metric", pat, 2)).alias("column"),
        _count(F.col("m")).alias("n"),
        _count_fault(F.col("m")).alias("fault"),
    ).where(F.col("column").isNotNull())
    cells = cells.join(_names(programme_names), "programme_id", "left")
    entity = F.concat(F.lit("office "), F.col("office_id"))
    if entity_names is not None:
        ents = bounded_broadcast(entity_names.groupBy(F.col("office_id").cast("string").alias("office_id")).agg(
            F.max("entity").alias("_ename")), _LOOKUP_BOUND)
        cells = cells.join(ents, "office_id", "left")
        entity = F.coalesce(F.nullif(F.col("_ename"), F.lit("")), entity)
    return cells.select(
        "month", "record_product", entity.alias("entity"),
        F.coalesce(F.col("_pname"), F.concat(F.lit("programme_"), F.col("programme_id"))).alias("product"),
        "direction", "column", "n", "fault",
    )


# --------------------------------------------------------------------------- P10
def flat_open_openings(pages: DataFrame, programme_names: DataFrame) -> DataFrame:
    """Open seats per (product, direction) from top-level ``open_<i|o>_programme_<id>`` nodes:
    ``total_openings.value`` (or a scalar ``total_openings``) else ``doc_count``."""
    p = with_variant_page(pages)
    pat = vocab.FLAT_OPEN_PATTERN
    e = p.select("month", F.explode(_body(F.col("page"))).alias("k", "node")).where(
        F.col("k").rlike(pat) & _obj(F.col("node")).isNotNull()
    )
    seats = F.coalesce(F.try_variant_get("node", "$.total_openings.value", "variant"),
                       F.try_variant_get("node", "$.total_openings", "variant"))
    value = F.when(seats.isNotNull() & ~F.is_variant_null(seats),
                   _count(seats, "$")).otherwise(_count(F.col("node")))
    rows = e.select(
        "month",
        F.coalesce(normalise_direction(F.regexp_extract("k", pat, 1)), F.lit("unknown")).alias("direction"),
        F.regexp_extract("k", pat, 2).alias("_raw_id"),
        _id(F.regexp_extract("k", pat, 2)).alias("programme_id"),
        value.alias("open"),
    )
    rows = rows.join(_names(programme_names), "programme_id", "left").withColumn(
        "product", F.coalesce(F.col("_pname"), F.concat(F.lit("programme_"), F.col("_raw_id")))
    )
    return rows.groupBy("month", "product", "direction").agg(F.sum("open").cast("bigint").alias("open_openings"))


# --------------------------------------------------------------------------- P3 - P6
_ITEM = "struct<kind:string,dim:string,v:variant>"


def nested_cells(pages: DataFrame, programme_names: DataFrame | None = None, levels: int = 8) -> DataFrame:
    """Cells of nested-bucket pages, any depth and nesting order (stages only).

    A bucket is a stage leaf when its key (or, under a status dimension, its label)
    is a known status; it adds ``doc_count`` to the cell of the context collected
    from its ancestors and may itself nest further. Other buckets widen the context
    when their dimension name (the parent key of ``buckets``) is an entity,
    direction or product dimension.

    The walk is a linear chain of generator steps (three per level), one frontier
    per level; emitted cells ride along as pass-through rows. ``levels`` steps make
    one pass, whose frontier is checkpointed; passes go on until no node is left, so
    pages of any depth are read whole. Product ids are resolved after the walk with
    one lookup join (``programme_names``: programme_id, product; default: the fixed
    programme table).
    """
    p = with_variant_page(pages)
    null_s = F.lit(None).cast("string")
    ctx = ["month", "record_product", "entity", "pkey", "plabel", "direction"]
    front = p.select("month", "record_product", null_s.alias("entity"), null_s.alias("pkey"), null_s.alias("plabel"),
                     null_s.alias("direction"), F.lit("node").alias("kind"), F.col("page").alias("v"),
                     null_s.alias("column"))
    empty_items = F.array().cast(f"array<{_ITEM}>")

    def item(kind, dim, v):
        return F.struct(kind.alias("kind"), dim.alias("dim"), v.alias("v"))

    def step(front: DataFrame) -> DataFrame:
        v = F.col("v")
        elems = F.coalesce(F.transform(_arr(v), lambda e: item(F.lit("node"), null_s, e)), empty_items)
        entries = F.coalesce(
            F.transform(
                F.map_entries(_obj(v)),
                lambda en: item(
                    F.when(F.try_variant_get(en["value"], "$.buckets", "array<variant>").isNotNull(), F.lit("bk"))
                    .when(_obj(en["value"]).isNotNull() | _arr(en["value"]).isNotNull(), F.lit("node"))
                    .otherwise(F.lit("skip")),
                    F.lower(en["key"]),
                    en["value"],
                ),
            ),
            empty_items,
        )
        children = F.when(F.col("kind") == "cell", F.array(item(F.lit("cell"), null_s, v))).otherwise(F.concat(elems, entries))
        # 1) children of every node (cells pass through); scalars are dropped inside the array
        a = front.select(*ctx, "column", F.explode(F.filter(children, lambda c: c["kind"] != "skip")).alias("c"))
        # 2) a "bk" child fans out into its buckets (non-object buckets dropped inside the array)
        buckets = F.filter(F.try_variant_get(F.col("c.v"), "$.buckets", "array<variant>"), lambda x: _obj(x).isNotNull())
        fan = F.when(F.col("c.kind") == "bk", buckets).otherwise(F.array(F.col("c.v")))
        b = a.select(*ctx, "column", F.col("c.kind").alias("kind0"), F.col("c.dim").alias("dim"), F.explode(fan).alias("v"))
        # 3) classify buckets: leaf (emit a cell, keep walking it) or dimension (widen the context)
        key = F.coalesce(_str(F.col("v"), "$.key"), F.lit("None"))
        label = F.coalesce(F.nullif(_str(F.col("v"), "$.key_as_string"), F.lit("")),
                           F.nullif(_str(F.col("v"), "$.key"), F.lit("")), F.lit(""))
        key_stage = stage_of_status(key)
        stage = F.when(key_stage.isNotNull(), key_stage).when(F.col("dim").isin(*vocab.STATUS_DIMENSIONS), stage_of_status(label))
        is_bk = F.col("kind0") == "bk"
        leaf = is_bk & stage.isNotNull()
        dim = F.col("dim")
        ent_dim, dir_dim, prod_dim = (dim.isin(*vocab.ENTITY_DIMENSIONS), dim.isin(*vocab.DIRECTION_DIMENSIONS),
                                      dim.isin(*vocab.PRODUCT_DIMENSIONS))
        same = [F.col(c).alias(c) for c in ctx]
        widened = [
            F.col("month").alias("month"), F.col("record_product").alias("record_product"),
            F.when(ent_dim, F.nullif(label, F.lit(""))).otherwise(F.col("entity")).alias("entity"),
            F.when(prod_dim, F.trim(key)).otherwise(F.col("pkey")).alias("pkey"),
            F.when(prod_dim, F.nullif(label, F.lit(""))).otherwise(F.col("plabel")).alias("plabel"),
            F.when(dir_dim, F.coalesce(normalise_direction(key), normalise_direction(label))).otherwise(F.col("direction")).alias("direction"),
        ]

        def row(cols, kind, column=null_s, v=F.col("v")):
            return F.struct(*cols, kind.alias("kind"), v.alias("v"), column.alias("column"))

        cell = row(same, F.lit("cell"), stage, F.try_variant_get("v", "$.doc_count", "variant"))  # counted after the walk
        walk_same = row(same, F.lit("node"))
        walk_wide = row(widened, F.lit("node"))
        passthru = row(same, F.col("kind0"), F.col("column"))
        out = F.when(leaf, F.array(cell, walk_same)).when(is_bk, F.array(walk_wide)).otherwise(F.array(passthru))
        return b.select(F.inline(out))

    cells = None
    while True:
        for _ in range(levels):
            front = step(front)
        walked = materialize(front)
        found = walked.where(F.col("kind") == "cell").withColumns({"n": _count(F.col("v"), "$"), "fault": _count_fault(F.col("v"), "$")})
        cells = found if cells is None else cells.unionByName(found)
        front = walked.where(F.col("kind") != "cell")
        if front.isEmpty():
            break
    if programme_names is None:
        spark = pages.sparkSession
        programme_names = spark.createDataFrame(sorted(vocab.PROGRAMME_NAMES.items()), "programme_id int, product string")
    out = cells.withColumn("programme_id", _id(F.col("pkey"))).join(_names(programme_names), "programme_id", "left")
    product = F.when(F.col("programme_id").isNotNull(), F.coalesce(F.col("_pname"), F.col("plabel"))).otherwise(F.col("plabel"))
    return out.select("month", "record_product", "entity", product.alias("product"), "direction", "column", "n", "fault")


# --------------------------------------------------------------------------- P13 - P16
def cells_to_panel(cells: DataFrame, spec: FunnelSpec = DEFAULT_SPEC, default_entity: str | None = None,
                   diagnostics=vocab.DIAGNOSTIC_COLUMNS) -> DataFrame:
    """Defaults, duplicate collapse (P14), long -> wide with zero fill, empty-cell filter (P15), calendar."""
    values = list(spec.stages) + list(diagnostics)
    filled = cells.select(
        F.to_date(F.concat(F.col("month"), F.lit("-01"))).alias("date"),
        F.coalesce(F.nullif(F.col("entity"), F.lit("")), F.lit(default_entity or spec.default_entity)).alias("entity"),
        F.coalesce(F.nullif(F.col("product"), F.lit("")), F.nullif(F.col("record_product"), F.lit("")), F.lit("UNKNOWN")).alias("product"),
        F.coalesce(F.nullif(F.col("direction"), F.lit("")), F.lit("unknown")).alias("direction"),
        "column", "n",
    )
    wide = filled.groupBy("date", "entity", "product", "direction").agg(
        *[F.coalesce(F.sum(F.when(F.col("column") == c, F.col("n"))), F.lit(0)).cast("bigint").alias(c) for c in values]
    )
    wide = wide.where(sum((F.col(c) for c in values), F.lit(0)) > 0)
    wide = with_calendar(wide).withColumn("programme", programme_label("direction", "product"))
    return wide.select("date", "year", "month", "month_name", "quarter", "entity", "product", "direction", "programme", *values)


def envelope_to_panel(pages: DataFrame, programme_names: DataFrame, entity_names: DataFrame | None = None,
                      spec: FunnelSpec = DEFAULT_SPEC, default_entity: str | None = None) -> DataFrame:
    """Pages of an envelope -> panel (routing, both parsers, defaults, collapse, filter, calendar)."""
    return cells_to_panel(payload_cells(pages, programme_names, entity_names), spec, default_entity)


def payload_cells(pages: DataFrame, programme_names: DataFrame, entity_names: DataFrame | None = None) -> DataFrame:
    """P7 routing: flat pages to :func:`flat_cells`, the rest to :func:`nested_cells`.

    Pages are parsed and routed once (checkpointed). A branch the router sends no page to is not planned at all,
    so an all-flat envelope does not pay for planning and running the nested walk.
    """
    p = materialize(with_variant_page(pages).withColumn("_flat", is_flat_payload(F.col("page"))).select("month", "record_product", "page", "_flat"))
    flat_pages, nested_pages = p.where("_flat").drop("_flat"), p.where(~F.col("_flat")).drop("_flat")
    shapes = {r["_flat"] for r in p.select("_flat").distinct().collect()}  # two rows at most
    parts = []
    if True in shapes:
        parts.append(flat_cells(flat_pages, programme_names, entity_names))
    if False in shapes:
        parts.append(nested_cells(nested_pages, programme_names))
    if not parts:
        return flat_cells(flat_pages, programme_names, entity_names)  # empty, with the cell schema
    out = parts[0]
    for extra in parts[1:]:
        out = out.unionByName(extra)
    return out
