"""Operational fact extraction: header ⋈ line ⋈ product.

Every store has a database of its own, and all of them number from 1, so the tables
of a fleet carry the store and every join has it in its key.  A line or product
table that all stores share must be stated as such.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.functions.scalar import compose_occurred_at, record_hash20, to_number


@dataclass(frozen=True)
class FactPlan:
    """Resolved column roles for one store database (or a whole fleet).

    Column names come from ``resolve_fact_plan`` (catalog metadata); only the
    names travel through the driver, never rows.  ``line_store`` and
    ``product_store`` name the store columns of those tables; None states that one
    table serves all stores.
    """

    header_id: str
    header_store: str
    line_store: str | None
    product_store: str | None
    date_col: str
    line_header: str
    line_id: str
    line_product: str
    quantity_col: str
    product_key: str
    product_identity: str
    operation: Column  # expression over the line/header columns -> 'purchase' / 'sale'
    time_col: str | None = None
    destination_col: str | None = None
    pack_size_col: str | None = None
    structural_confidence: float | Column = 0.78
    mapping_verified: bool | Column = False
    tiebreak: tuple[str, ...] = field(default_factory=tuple)
    #: Column of all three tables that tells stacked schemas apart.
    schema: str | None = None


def structural_confidence(*confidences: Column | float) -> Column:
    """min of the plan confidences (header, line, product, joins, identity, quantity)."""
    cols = [c if isinstance(c, Column) else F.lit(float(c)) for c in confidences]
    return F.least(*cols) if len(cols) > 1 else cols[0]


def _number(col: str, df: DataFrame, name: str | None = None) -> Column:
    """``col`` as a double: numeric source columns (``name`` of ``df``) cast directly, text goes through the tolerant parser."""
    return F.col(col).cast("double") if isinstance(df.schema[name or col].dataType, T.NumericType) else to_number(F.col(col))


def extract_line_facts(
    header: DataFrame,
    line: DataFrame,
    product: DataFrame,
    plan: FactPlan,
    limit: int | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Privacy-narrow system-record facts for every (or the newest ``limit``) line.

    ``carry`` names header columns that the plan's confidence or verification refer
    to.  ``limit`` reproduces the poll form (newest N per store and operation, N at
    least 1) through ``row_number`` so Spark plans a per-group limit before the
    shuffle; ``None`` extracts every line (backfill form).
    """
    if limit is not None and limit < 1:
        raise ValueError(f"limit must be at least 1, not {limit}")
    h_cols = [F.col(plan.header_id).alias("_hid"), F.col(plan.header_store).alias("store_id"),
              F.col(plan.date_col).alias("_date"), *[F.col(c) for c in carry]]
    if plan.time_col:
        h_cols.append(F.col(plan.time_col).alias("_time"))
    schema = [F.col(plan.schema).alias("_schema")] if plan.schema else []
    h = header.select(*h_cols, *schema)

    d_cols = [
        F.col(plan.line_header).alias("_lhid"),
        F.col(plan.line_id).alias("_lid"),
        F.col(plan.line_product).alias("_lpid"),
        F.col(plan.quantity_col).alias("_qty"),
        plan.operation.alias("_op"),
    ]
    if plan.line_store:
        d_cols.append(F.col(plan.line_store).alias("_lstore"))
    if plan.destination_col:
        d_cols.append(F.col(plan.destination_col).cast("string").alias("destination_id"))
    d_cols += [F.col(c).alias(f"_tb{i}") for i, c in enumerate(plan.tiebreak)]
    d = line.select(*d_cols, *schema).where(F.col("_op").isin("purchase", "sale"))

    p_cols = [F.col(plan.product_key).alias("_pk"), F.col(plan.product_identity).alias("_pident")]
    if plan.product_store:
        p_cols.append(F.col(plan.product_store).alias("_pstore"))
    if plan.pack_size_col:
        p_cols.append(F.col(plan.pack_size_col).alias("_pack"))
    p = product.select(*p_cols, *schema)

    # Both joins are stated as sort-merge: headers and products grow with the fleet, and what
    # Spark estimates from the compressed files (a product list exploded to every store
    # counts as the list) would send them whole through the driver as a broadcast.
    of_header, of_product = F.col("_lhid") == F.col("_hid"), F.col("_pk") == F.col("_lpid")
    if plan.line_store:
        of_header = of_header & (F.col("_lstore") == F.col("store_id"))
    if plan.product_store:
        of_product = of_product & (F.col("_pstore") == F.col("store_id"))
    if plan.schema:
        h, d, p = h.withColumnRenamed("_schema", "_hs"), d.withColumnRenamed("_schema", "_ds"), p.withColumnRenamed("_schema", "_ps")
        of_header, of_product = of_header & (F.col("_ds") == F.col("_hs")), of_product & (F.col("_ps") == F.col("_ds"))
    j = d.join(h.hint("merge"), of_header).join(p.hint("merge"), of_product)

    date_text = F.date_format(F.col("_date"), "yyyy-MM-dd'T'HH:mm:ss")
    time_text = F.col("_time").cast("string") if plan.time_col else F.lit(None).cast("string")

    if limit is not None:
        order = [F.col("_date").desc()]
        if plan.time_col:
            order.append(F.col("_time").desc())
        order += [F.col("_hid"), F.col("_lid"), F.col("_lpid")]
        if plan.destination_col:
            order.append(F.col("destination_id"))
        order += [F.col("_qty")] + [F.col(f"_tb{i}") for i in range(len(plan.tiebreak))]
        w = Window.partitionBy("store_id", "_op").orderBy(*order)
        j = j.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)

    pack = _number("_pack", product, plan.pack_size_col) if plan.pack_size_col else F.lit(None).cast("double")
    rhash = record_hash20(F.col("_op"), F.col("_hid"), F.col("_lid"))
    conf = plan.structural_confidence
    conf = conf if isinstance(conf, Column) else F.lit(float(conf))
    verified = plan.mapping_verified
    out = j.select(
        "store_id",
        F.concat(F.col("_op"), F.lit("_line")).alias("operation_type"),
        F.concat(F.lit("sql-operation:"), F.col("_op"), F.lit(":"), rhash).alias("external_id"),
        compose_occurred_at(date_text, time_text).alias("occurred_at"),
        F.lit("system_record").alias("kind"),
        conf.alias("confidence"),
        F.trim(F.coalesce(F.col("_pident").cast("string"), F.lit(""))).alias("product_id"),
        _number("_qty", line, plan.quantity_col).alias("quantity"),
        F.when(pack > 0, pack).alias("pack_size"),
        (F.col("destination_id") if plan.destination_col else F.lit(None).cast("string")).alias("destination_id"),
        rhash.alias("source_record_hash"),
        (verified if isinstance(verified, Column) else F.lit(bool(verified))).alias("mapping_verified"),
    )
    return out


PLAN_SHAPE = (
    "operation", "header_table", "line_table", "product_table", "header_id_col", "line_header_col", "line_product_col",
    "product_key_col", "date_col", "time_col", "quantity_col", "product_identity_col", "pack_size_col", "line_id_col",
    "destination_col",
)


def _store_column(tables: dict[str, DataFrame], path: str, shared: frozenset[str]) -> str | None:
    if "store_id" in tables[path].columns:
        return "store_id"
    if path not in shared:
        raise ValueError(f"{path} has no store_id and is not stated to be shared by all stores")
    return None


def _stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def extract_learned_facts(plans: DataFrame, tables: dict[str, DataFrame], limit: int | None = None,
                          shared: frozenset[str] = frozenset()) -> DataFrame:
    """Facts by the plans of ``resolve_fact_plan``, each store by its own.

    ``tables`` are the stores' tables by table path, with ``store_id``; line and
    product tables named in ``shared`` serve all stores and need none.
    Only the distinct plan shapes, that is, the distinct schemas, come to the driver.  Each
    schema's tables are brought to common columns by a projection; the schemas are then
    stacked, so a fleet of many schemas is one join of headers with lines and products
    (one for each combination of shared tables) and not one for each schema.
    Confidence and ``mapping_verified`` are those of the store's plan.
    """
    good = plans.where("plan_ok").withColumn("_plan", F.md5(F.to_json(F.struct(*PLAN_SHAPE))))
    shapes = sorted((r.asDict() for r in good.select("_plan", *PLAN_SHAPE).distinct().collect()), key=lambda r: r["_plan"])
    if not shapes:
        raise ValueError("no store has a plan")
    stores = good.select("store_id", "_plan", F.col("structural_confidence").alias("_conf"), F.col("mapping_verified").alias("_verified"))
    kinds: dict[tuple[bool, bool], list[dict]] = {}
    for shape in shapes:
        own = tuple(_store_column(tables, shape[t], shared) is not None for t in ("line_table", "product_table"))
        kinds.setdefault(own, []).append(shape)
    return _stacked([_facts_of_schemas(members, tables, stores, own, limit) for own, members in sorted(kinds.items())])


def _facts_of_schemas(members: list[dict], tables: dict[str, DataFrame], stores: DataFrame, own: tuple[bool, bool],
                      limit: int | None) -> DataFrame:
    """Facts of schemas whose line and product tables carry the store alike (``own``)."""
    def id_type(*of: tuple[str, str]) -> str:
        """Ids of several schemas meet as longs where all of them are whole numbers, else as text."""
        whole = all(isinstance(tables[s[t]].schema[s[c]].dataType, T.IntegralType) for s in members for t, c in of)
        return "bigint" if whole else "string"

    header_type = id_type(("header_table", "header_id_col"), ("line_table", "line_header_col"))
    product_type = id_type(("line_table", "line_product_col"), ("product_table", "product_key_col"))
    headers, lines, products = [], [], []
    for s in members:
        plan, text = F.lit(s["_plan"]).alias("_plan"), lambda c: (F.col(c).cast("string") if c else F.lit(None).cast("string"))
        header, line, product = (tables[s[t]] for t in ("header_table", "line_table", "product_table"))
        headers.append(header.select("store_id", plan, F.col(s["header_id_col"]).cast(header_type).alias("header"),
                                     F.col(s["date_col"]).cast("timestamp").alias("date"), text(s["time_col"]).alias("time")))
        lines.append(line.select(*(["store_id"] if own[0] else []), plan, F.col(s["line_header_col"]).cast(header_type).alias("header"),
                                 text(s["line_id_col"]).alias("line"), F.col(s["line_product_col"]).cast(product_type).alias("product"),
                                 _number(s["quantity_col"], line).alias("quantity"), text(s["destination_col"]).alias("destination"),
                                 F.lit(s["operation"]).alias("operation")))
        products.append(product.select(*(["store_id"] if own[1] else []), plan, F.col(s["product_key_col"]).cast(product_type).alias("product"),
                                       text(s["product_identity_col"]).alias("identity"),
                                       (_number(s["pack_size_col"], product) if s["pack_size_col"] else F.lit(None).cast("double")).alias("pack")))
    header = _stacked(headers).join(stores, ["store_id", "_plan"])
    plan = FactPlan(
        header_id="header", header_store="store_id", line_store="store_id" if own[0] else None, product_store="store_id" if own[1] else None,
        date_col="date", time_col="time", line_header="header", line_id="line", line_product="product", quantity_col="quantity",
        product_key="product", product_identity="identity", operation=F.col("operation"), destination_col="destination", pack_size_col="pack",
        structural_confidence=F.round("_conf", 2), mapping_verified=F.col("_verified"), schema="_plan")
    return extract_line_facts(header, _stacked(lines), _stacked(products), plan, limit, ("_conf", "_verified"))


def fixture_plan() -> FactPlan:
    """Plan for orders ⋈ lineitem ⋈ part (the driver-table form of a store database)."""
    return FactPlan(
        header_id="header_no",
        header_store="store_id",
        line_store="store_id",
        product_store="store_id",
        date_col="o_orderdate",
        line_header="header_no",
        line_id="l_linenumber",
        line_product="l_partkey",
        quantity_col="l_quantity",
        product_key="p_partkey",
        product_identity="product_no",
        operation=F.when(F.col("l_linestatus") == "O", F.lit("purchase")).otherwise(F.lit("sale")),
        destination_col="l_suppkey",
        pack_size_col="pack_size",
        structural_confidence=0.78,
        mapping_verified=False,
        tiebreak=("l_suppkey", "l_extendedprice"),
    )
