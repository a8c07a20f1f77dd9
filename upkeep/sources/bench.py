"""Bindings of the benchmark star schema onto the maintenance data model.

The driver's tables stand in for the maintenance exports so that every
operator runs over real, growing data:

* repairs   = lineitem (+ supplier -> nation as the location)
              id = l_partkey, date = l_shipdate, hours = l_quantity / 10,
              labor = hours x labor rate, parts = l_extendedprice x l_discount / 1000
* service   = lineitem x orders
              id = l_partkey, scheduled = o_orderdate, completed = l_shipdate when
              l_linestatus = 'F' and not before the order date, status F/O ->
              Completed/Scheduled, description = o_orderpriority
* requests  = events
              work order = event_id, date = ts, requestor = user_id, request = event_type
* assets    = part
              id = p_partkey, name = p_name, type = p_type, maker = p_brand,
              new price = p_retailprice, useful life (years) = p_size when <= 40

Rows keep a total order key (``row_ord``) standing in for file order, so every
first/last-row-wins rule is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep import params as P
from upkeep.functions import labor_cost, month_key
from upkeep.session import materialize, packed, small

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Nation is a fixed 25-row dimension in every scale of the schema, so it is the
# one benchmark table this module broadcasts by hint.
NATION_ROWS_BOUND = 25


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def supplier_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, location): supplier nation name. Supplier grows with scale and is
    never hinted; nation is bounded and broadcast."""
    sup = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = read(spark, sf_dir, "nation").select(F.col("n_nationkey"), F.col("n_name").alias("location"))
    return sup.join(F.broadcast(nat), sup.s_nationkey == nat.n_nationkey, "left") \
              .select("s_suppkey", "location")


def repairs_rows(spark: SparkSession, sf_dir: str, labor_rate: float = P.LABOR_RATE_PER_HOUR) -> DataFrame:
    """Repair rows without location: equip_id, suppkey, date, month_key, hours, labor,
    parts, total, row_ord. Location is attached by callers only where needed
    (usually after aggregation, on far fewer rows)."""
    li = read(spark, sf_dir, "lineitem")
    hours = F.col("l_quantity") / F.lit(10.0)
    parts = F.col("l_extendedprice") * F.col("l_discount") / F.lit(1000.0)
    return li.select(
        F.col("l_partkey").alias("equip_id"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_shipdate").cast("date").alias("date"),
        month_key(F.col("l_shipdate")).alias("month_key"),
        hours.alias("hours"),
        labor_cost(hours, labor_rate).alias("labor"),
        parts.alias("parts"),
        F.struct(F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"),
                 F.col("l_suppkey"), F.col("l_extendedprice")).alias("row_ord"),
    ).withColumn("total", F.col("parts") + F.col("labor"))


def repairs(spark: SparkSession, sf_dir: str, labor_rate: float = P.LABOR_RATE_PER_HOUR) -> DataFrame:
    """Repair rows with their location (a shuffle join on the supplier key)."""
    loc = supplier_location(spark, sf_dir)
    r = repairs_rows(spark, sf_dir, labor_rate)
    return r.join(loc, r.suppkey == loc.s_suppkey, "left").drop("s_suppkey")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("equip_id"),
        F.col("p_name").alias("equipment"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("manufacturer"),
        F.col("p_retailprice").alias("new_price"),
        F.when(F.col("p_size") <= 40, F.col("p_size").cast("double")).alias("life_years"),
    )


def service(spark: SparkSession, sf_dir: str, with_location: bool = False) -> DataFrame:
    """Service-order rows: equip_id, sched_date, completed_date, status, description,
    month_key (of the scheduled date), row_ord (+ location)."""
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus",
        "l_shipdate", "l_extendedprice")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    done = (F.col("l_linestatus") == "F") & (F.col("l_shipdate") >= F.col("o_orderdate"))
    out = j.select(
        F.col("l_partkey").alias("equip_id"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("o_orderdate").cast("date").alias("sched_date"),
        F.when(done, F.col("l_shipdate").cast("date")).alias("completed_date"),
        F.when(F.col("l_linestatus") == "F", F.lit("Completed")).otherwise(F.lit("Scheduled")).alias("status"),
        F.col("o_orderpriority").alias("description"),
        month_key(F.col("o_orderdate")).alias("month_key"),
        F.struct(F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"),
                 F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")).alias("row_ord"),
    )
    if with_location:
        loc = supplier_location(spark, sf_dir)
        out = out.join(loc, out.suppkey == loc.s_suppkey, "left").drop("s_suppkey")
    return out


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("work_order"),
        F.col("ts").cast("date").alias("request_date"),
        F.col("user_id").cast("string").alias("requestor"),
        F.col("event_type").alias("request"),
        month_key(F.col("ts")).alias("month_key"),
        F.col("ts"),
    )


def asset_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equipment summary metadata per id: purchase date = first shipment of the
    part among returned line items (``l_returnflag = 'R'``), depreciation years
    and type from the part row."""
    li = read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    first = li.groupBy(F.col("l_partkey").alias("equip_id")) \
              .agg(F.min(F.col("l_shipdate")).cast("date").alias("purchase_date"))
    a = assets(spark, sf_dir).select("equip_id", "category", "life_years")
    return a.join(first, "equip_id", "left")


def purchase_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase-book rows per part: year of the first shipment among line items
    with ``l_returnflag = 'A'``; the book records no life; type from the part."""
    li = read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "A")
    first = li.groupBy(F.col("l_partkey").alias("equip_id")) \
              .agg(F.year(F.min("l_shipdate")).alias("year"))
    a = assets(spark, sf_dir).select("equip_id", F.col("category").alias("equip_type"))
    return first.join(a, "equip_id", "left").withColumn("life_years", F.lit(None).cast("double")) \
                .withColumn("keyword", F.lit(None).cast("string"))


def life_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual life extensions: parts of size above 45 get ``p_size`` extra months."""
    p = read(spark, sf_dir, "part").where(F.col("p_size") > 45)
    return p.select(F.col("p_partkey").alias("equip_id"),
                    F.least(F.col("p_size").cast("double"), F.lit(240.0)).alias("extra_months"))


# ---- equipment names --------------------------------------------------------
# Fixed vocabulary of this binding: the part name's adjective picks a maker
# word and its noun an equipment kind, so the keyword classifier sees realistic
# names (brands, typos, junk, sizes) derived from every part row.
MAKER_BY_ADJECTIVE = {"blue": "Tennant", "cold": "Pro Team", "hot": "ICE", "large": "Windsor",
                      "new": "Karcker", "old": "Lindhause", "red": "", "small": "storage area"}
KIND_BY_NOUN = {"anvil": "auto scrubber", "bolt": "backpack vac", "gear": "burnisher",
                "gizmo": "wet/dry vacuum", "plate": "carpet extractor", "ring": "ladder",
                "rod": "chemical dispenser", "widget": "floor machine"}


def _lookup(d: dict, c):
    kv = []
    for k, v in d.items():
        kv += [F.lit(k), F.lit(v)]
    return F.coalesce(F.element_at(F.create_map(*kv), c), F.lit(""))


def equipment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(equip_id, equip_name, cost, size) per part."""
    p = read(spark, sf_dir, "part")
    adj = F.substring_index("p_name", " ", 1)
    noun = F.substring_index("p_name", " ", -1)
    name = F.trim(F.concat_ws(" ", _lookup(MAKER_BY_ADJECTIVE, adj), _lookup(KIND_BY_NOUN, noun),
                              F.col("p_size").cast("string")))
    return p.select(F.col("p_partkey").alias("equip_id"), F.regexp_replace(name, "  +", " ").alias("equip_name"),
                    F.col("p_retailprice").alias("cost"), F.col("p_size").alias("size"))


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog price list (model, category, year, price as text, row_ord) from
    returned line items of parts up to size 30: model names follow the equipment
    vocabulary (walk-behind scrubbers as ``<maker> i<size> walk-behind scrubber``)."""
    p = read(spark, sf_dir, "part").where(F.col("p_size") <= 30)
    adj = F.substring_index("p_name", " ", 1)
    noun = F.substring_index("p_name", " ", -1)
    maker = _lookup(MAKER_BY_ADJECTIVE, adj)
    kind = _lookup(KIND_BY_NOUN, noun)
    size = F.col("p_size").cast("string")
    model = F.when(noun == "anvil", F.concat_ws(" ", maker, F.concat(F.lit("i"), size), F.lit("walk-behind scrubber"))) \
             .otherwise(F.concat_ws(" ", maker, kind, size))
    cat = F.when(noun == "anvil", F.lit("Walk-Behind Scrubber")).otherwise(F.initcap(kind))
    p = p.select("p_partkey", F.regexp_replace(F.trim(model), "  +", " ").alias("model"), cat.alias("category"))
    li = read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select("model", "category", F.year("l_shipdate").cast("string").alias("year"),
                    F.concat(F.lit("$"), (F.col("l_extendedprice") / F.col("l_quantity")).cast("string")).alias("price"),
                    F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("row_ord"))


# ---- raw export grids built from line items ----------------------------------------
def _export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    names = equipment_names(spark, sf_dir).select(F.col("equip_id").alias("_pid"), "equip_name")
    loc = supplier_location(spark, sf_dir)
    sup = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("_sid"), "s_name")
    j = li.join(names, li.l_partkey == names._pid, "left").join(loc, li.l_suppkey == loc.s_suppkey, "left") \
          .join(sup, li.l_suppkey == sup._sid, "left")
    hours = F.col("l_quantity") / F.lit(10.0)
    parts = F.col("l_extendedprice") * F.col("l_discount") / F.lit(1000.0)
    labor = F.bround(hours * F.lit(12.5), 2)
    return _spread(j).select("*", hours.alias("_hours"), parts.alias("_parts"), labor.alias("_labor"))


def _spread(rows: DataFrame) -> DataFrame:
    """Line items over as many tasks as there are cores: a small table is read or joined in
    one task, and cleaning a raw row costs far more than moving it."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "l_orderkey", "l_linenumber")


def repairs_export_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned repair exports as a raw grid, one file per ship month. Files up to
    2000 have two preamble rows and a '#' index column; later files have one
    preamble row, no index column and alias headers (Repair Date, Equipment, Asset ID)."""
    r = _export_rows(spark, sf_dir)
    file = F.concat(F.date_format("l_shipdate", "MMMM yyyy"), F.lit(" Repair List.csv"))
    new = F.year("l_shipdate") > 2000
    s = lambda c: F.col(c).cast("string")
    common = [F.coalesce(F.col("equip_name"), F.lit("")), s("l_partkey"), F.coalesce(F.col("location"), F.lit("")),
              F.coalesce(F.col("s_name"), F.lit("")), F.lit("1"), s("_hours"), s("_parts"), s("_labor"),
              (F.col("_parts") + F.col("_labor")).cast("string")]
    date_txt = F.date_format("l_shipdate", "yyyy-MM-dd")
    idx = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")
    cells = F.when(new, F.array(date_txt, *common)).otherwise(F.array(idx, date_txt, *common))
    data = r.select(file.alias("file"), (F.lit(100) + F.monotonically_increasing_id()).alias("row_no"),
                    cells.alias("cells"))
    files = r.select(file.alias("file"), new.alias("new")).distinct()
    old_hdr = list(("#", "Completed Date", "Equipment Name", "Equipment ID", "Location", "Service Vendor",
                    "# of Repairs", "Repair Person-Hrs", "Parts Cost $", "Total Labor $", "Est. Total $"))
    new_hdr = ["Repair Date", "Equipment", "Asset ID"] + old_hdr[4:]
    title = files.select("file", F.lit(0).cast("long").alias("row_no"),
                         F.array(F.concat(F.lit("Equipment Repair Log | "), F.col("file"))).alias("cells"))
    gen = files.where(~F.col("new")).select("file", F.lit(1).cast("long").alias("row_no"),
                                           F.array(F.lit("Generated from row export")).alias("cells"))
    hdr = files.select("file", F.when(F.col("new"), F.lit(1)).otherwise(F.lit(2)).cast("long").alias("row_no"),
                       F.when(F.col("new"), F.array(*[F.lit(h) for h in new_hdr]))
                        .otherwise(F.array(*[F.lit(h) for h in old_hdr])).alias("cells"))
    return title.unionByName(gen).unionByName(hdr).unionByName(data)


def repairs_row_export_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw repair row exports (labelled cells, header on line 0), one file per ship month."""
    r = _export_rows(spark, sf_dir)
    file = F.concat(F.date_format("l_shipdate", "MMMM yyyy"), F.lit(" Repair Export.csv"))
    details = (F.when(F.col("l_returnflag") == "N", F.concat(F.col("_hours").cast("string"), F.lit(" hrs")))
               .when(F.col("l_returnflag") == "A", F.lit("found")))
    cells = F.array(F.concat(F.lit("Equip. Name: "), F.coalesce("equip_name", F.lit(""))),
                    F.concat(F.lit("Equipment Id: "), F.col("l_partkey").cast("string")),
                    F.concat(F.lit("Location: "), F.coalesce("location", F.lit(""))),
                    F.concat(F.lit("Service Vendor: "), F.coalesce("s_name", F.lit(""))),
                    F.date_format("l_shipdate", "M/d/yyyy"),
                    F.concat(F.lit("$"), F.col("_parts").cast("string")), details)
    data = r.select(file.alias("file"), (F.lit(1) + F.monotonically_increasing_id()).alias("row_no"),
                    cells.alias("cells"))
    # the files follow from the line items alone: no join or spreading for them
    hdr = read(spark, sf_dir, "lineitem").select(file.alias("file")).distinct().select(
        "file", F.lit(0).cast("long").alias("row_no"),
        F.array(*[F.lit(h) for h in ("PersonnelId5", "PersonnelId1", "PersonnelId4", "PersonnelId3",
                                     "CompletedDate1", "Textbox38", "Details")]).alias("cells"))
    return hdr.unionByName(data)


def requests_export_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw request exports from events: one file per event type (no month in the
    name), three title rows, the 'Work Order #' header, the rows, and a trailing
    'Total requests' row; 'error' files come without a header row."""
    e = read(spark, sf_dir, "events")
    file = F.concat(F.col("event_type"), F.lit(" requests.csv"))
    data = e.select(file.alias("file"), (F.lit(10) + F.col("event_id")).alias("row_no"),
                    F.array(F.col("event_id").cast("string"), F.date_format("ts", "MM/dd/yyyy"),
                            F.col("user_id").cast("string"), F.col("event_type"),
                            F.format_number("value", 2)).alias("cells"))
    files = e.select(file.alias("file"), F.col("event_type")).distinct()
    titles = files.select("file", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("row_no")) \
                  .withColumn("row_no", F.col("row_no").cast("long")) \
                  .withColumn("cells", F.array(F.lit("Work Request Report")))
    hdr = files.where(F.col("event_type") != "error").select(
        "file", F.lit(3).cast("long").alias("row_no"),
        F.array(*[F.lit(h) for h in ("Work Order #", "Request Date", "Requestor", "Request", "Assigned To")])
        .alias("cells"))
    total = files.select("file", F.lit(10 ** 15).cast("long").alias("row_no"),
                         F.array(F.lit("Total requests"), F.lit("")).alias("cells"))
    return titles.unionByName(hdr).unionByName(data).unionByName(total)


def equipment_export_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equipment list exports from parts: one file per brand (two preamble rows,
    labelled location, blank types above size 40, cost only in 'Current Value'
    for sizes 41-45, names tagged '(Repair)' at size 1) and an archive file
    (header on row 0, other header names, purchase dates one year earlier)."""
    p = read(spark, sf_dir, "part")
    names = equipment_names(spark, sf_dir).select(F.col("equip_id").alias("_pid"), "equip_name")
    meta = asset_meta(spark, sf_dir).select(F.col("equip_id").alias("_mid"), "purchase_date")
    j = p.join(names, p.p_partkey == names._pid).join(meta, p.p_partkey == meta._mid, "left")
    s = lambda c: F.col(c).cast("string")
    brand_file = F.concat(F.col("p_brand"), F.lit(" equipment.csv"))
    name = F.when(F.col("p_size") == 1, F.concat("equip_name", F.lit(" (Repair)"))).otherwise(F.col("equip_name"))
    cost = F.when(F.col("p_size").between(41, 45), F.lit("")).otherwise(
        F.concat(F.lit("$"), F.format_number("p_retailprice", 2)))
    brand_rows = j.select(brand_file.alias("file"), (F.lit(10) + F.col("p_partkey")).alias("row_no"), F.array(
        s("p_partkey"), F.concat(F.lit(" "), s("p_partkey"), F.lit(" ")), name,
        F.concat(F.lit("Location: Hall "), F.col("p_brand")),
        F.when(F.col("p_size") > 40, F.lit("")).otherwise(F.col("p_type")), F.col("p_brand"),
        F.concat(F.lit("SN"), s("p_partkey")), F.coalesce(F.date_format("purchase_date", "M/d/yyyy"), F.lit("")),
        s("p_size"), cost, F.format_number(F.col("p_retailprice") * 0.8, 2)).alias("cells"))
    arch_rows = j.select(F.lit("Archive equipment.csv").alias("file"), (F.lit(1) + F.col("p_partkey")).alias("row_no"),
                         F.array(s("p_partkey"), F.col("equip_name"), F.col("p_type"), F.col("p_brand"),
                                 F.concat(F.lit("SN"), s("p_partkey")),
                                 F.coalesce(F.date_format(F.date_sub("purchase_date", 365), "yyyy-MM-dd"), F.lit("")),
                                 s("p_size"), F.format_number(F.col("p_retailprice") * 0.9, 2)).alias("cells"))
    files = j.select(brand_file.alias("file")).distinct()
    pre = files.select("file", F.lit(0).cast("long").alias("row_no"), F.array(F.lit("Equipment Summary")).alias("cells")) \
        .unionByName(files.select("file", F.lit(1).cast("long").alias("row_no"), F.array(F.lit("")).alias("cells")))
    hdr = files.select("file", F.lit(2).cast("long").alias("row_no"), F.array(*[F.lit(h) for h in (
        "#", "Equipment ID", "Equip. Name", "PersonnelId1", "Equip. Type", "Manufacturer", "Serial Number",
        "Purch. Date", "Depreciation Yrs", "Purch. Cost", "Current Value")]).alias("cells"))
    arch_hdr = spark.range(1).select(F.lit("Archive equipment.csv").alias("file"), F.lit(0).cast("long").alias("row_no"),
                                     F.array(*[F.lit(h) for h in ("EquipmentId", "EquipmentName", "EquipType",
                                                                  "Manufacturer", "SerialNumber", "PurchaseDate",
                                                                  "DepreciationYears", "Cost")]).alias("cells"))
    return pre.unionByName(hdr).unionByName(brand_rows).unionByName(arch_hdr).unionByName(arch_rows)


# Row numbers set aside in a legacy service export for the details under one part's header.
DETAIL_BLOCK = 10 ** 15


def service_export_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service exports from line items x orders. Orders up to 1999 go to
    order-list files named by priority (no month); later orders go to legacy
    'Equipment Details' files per order month, with one equipment header row
    per part followed by its detail rows."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    parts = equipment_names(spark, sf_dir).select(F.col("equip_id").alias("_pid"), "equip_name", "cost")
    loc = small(supplier_location(spark, sf_dir))
    # Line items are dealt once, by the key that orders are joined on, and the joined rows are
    # written with what the exports show of them: every kind of row below reads this table.
    # Parts are joined where a row shows their name: to orders of a list and to header rows.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    old = F.year("o_orderdate") <= 1999
    done = (F.col("l_linestatus") == "F") & (F.col("l_shipdate") >= F.col("o_orderdate"))
    j = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", "l_shipdate", "l_extendedprice", "l_quantity") \
          .repartition(tasks, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(loc, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    j = j.select(
        old.alias("_old"), "l_partkey", F.coalesce("location", F.lit("")).alias("location"), "o_orderpriority", F.col("o_orderdate").cast("date").alias("_sched"),
        F.when(done, F.col("l_shipdate").cast("date")).alias("_comp"), F.when(old, F.col("l_linestatus")).alias("_status"),
        F.when(old, F.col("l_extendedprice") / F.col("l_quantity")).alias("_unit"),
        F.when(old, 1 + F.monotonically_increasing_id()).alias("_no"),
        F.when(~old, F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("_line"))
    with packed(spark):
        j = materialize(j)
    s = lambda c: F.col(c).cast("string")
    sched_t = F.date_format("_sched", "M/d/yyyy")
    comp_t = F.coalesce(F.date_format("_comp", "M/d/yyyy"), F.lit(""))
    ol_file = F.concat(F.lit("Service Orders "), F.col("o_orderpriority"), F.lit(".csv"))
    old_rows, new = j.where("_old"), j.where("not _old")
    ol = old_rows.select("l_partkey", "location", "o_orderpriority", "_sched", "_comp", "_status", "_unit", "_no") \
        .join(parts, F.col("l_partkey") == F.col("_pid"), "left") \
        .select(ol_file.alias("file"), F.col("_no").alias("row_no"),
                F.array(s("l_partkey"), F.coalesce("equip_name", F.lit("")),
                        F.when(F.col("_status") == "F", F.lit("Completed")).otherwise(F.lit("open")),
                        F.col("location"), sched_t, comp_t,
                        F.concat(F.col("o_orderpriority"), F.lit(" - (Repair)")),
                        F.concat(F.lit("$"), s("_unit"))).alias("cells"))
    ol_hdr = old_rows.select(ol_file.alias("file")).distinct().select("file", F.lit(0).cast("long").alias("row_no"), F.array(*[F.lit(h) for h in (
        "EquipmentId1", "EquipmentName1", "Textbox21", "Name", "ScheduledDate", "CompletedDate", "Description",
        "Cost")]).alias("cells"))
    lg_file = lambda c: F.concat(F.date_format(c, "MMMM yyyy"), F.lit(" Equipment Details.csv"))
    # decimal row numbers: DETAIL_BLOCK numbers for each part, so blocks cannot overlap at any scale
    base = (F.col("l_partkey") + 1).cast("decimal(20,0)") * F.lit(DETAIL_BLOCK)
    details = new.select(lg_file("_sched").alias("file"), (base + F.col("_line")).alias("row_no"),
                         F.array(F.lit(""), F.lit(""), F.lit(""), F.lit(""), sched_t, comp_t,
                                 F.col("o_orderpriority")).alias("cells"))
    # a header row for each part and location of a month, found before the part's texts are joined
    heads = new.select("l_partkey", "location", F.trunc("_sched", "month").alias("_month")).distinct() \
               .join(parts, F.col("l_partkey") == F.col("_pid"), "left") \
               .select(lg_file("_month").alias("file"), base.alias("row_no"), F.array(
                   s("l_partkey"), F.coalesce("equip_name", F.lit("")), F.col("location"),
                   F.concat(F.lit("$"), F.format_number("cost", 2)), F.lit(""), F.lit(""), F.lit("")).alias("cells"))
    lg_hdr = new.select(lg_file("_sched").alias("file")).distinct().select("file", F.lit(0).cast("long").alias("row_no"), F.array(
        *[F.lit(h) for h in ("EquipmentId", "Name", "Location", "Cost", "ScheduledDate", "CompletedDate",
                             "Description")]).alias("cells"))
    return ol_hdr.unionByName(ol).unionByName(lg_hdr).unionByName(heads).unionByName(details)
