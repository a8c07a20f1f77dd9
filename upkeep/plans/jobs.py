"""Cleaning and loading jobs for raw exports (grid -> canonical tables).

Inputs are raw grids ``(file, row_no, cells)`` from ``sources.raw_grid`` (or any
DataFrame of that shape); every job is one Spark plan over all files at once.
Per-file decisions (header row, which columns exist) are per-file aggregates
joined back, never a driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upkeep import params as P
from upkeep.functions import (extract_label, labor_cost, month_from_file_name, month_key, norm_equip_id,
                              parse_date, parse_dollar, parse_repair_hours, strip_cell, strip_ws, to_double)
from upkeep.operators.windows import dense_number
from upkeep.session import materialize, packed
from upkeep.sources.raw_grid import field, find_header_rows, name_place, record_map, records_resolved, staged, unique_names

# ---- fixed values: export column names and aliases ---------------------------
REPAIRS_COLUMNS = ("#", "Completed Date", "Equipment Name", "Equipment ID", "Location", "Service Vendor",
                   "# of Repairs", "Repair Person-Hrs", "Parts Cost $", "Total Labor $", "Est. Total $")
REPAIRS_RENAME = {"Completed Date": "date", "Equipment Name": "equipment", "Equipment ID": "equip_id",
                  "Location": "location", "# of Repairs": "repairs", "Repair Person-Hrs": "hours",
                  "Parts Cost $": "parts", "Total Labor $": "labor", "Est. Total $": "total"}
ROW_INDEX_ALIASES = ("#", "no.", "no", "row", "line", "item", "#.")
DATE_ALIASES = ("Completed Date", "Date", "Repair Date", "Completed")
EQUIPMENT_ALIASES = ("Equipment Name", "Equipment", "Description")
DATE_FALLBACK_KEYS = ("completeddate", "repairdate", "completiondate", "dateclosed")
EQUIPMENT_FALLBACK_KEYS = ("equipmentname", "equipment", "item", "description")
ID_FALLBACK_KEYS = ("equipmentid", "equipid", "assetid")
RAW_REPAIR_FIELDS = {"equipment": ("PersonnelId5", "Equip. Name"), "equip_id": ("PersonnelId1", "Equipment Id"),
                     "location": ("PersonnelId4", "Location"), "vendor": ("PersonnelId3", "Service Vendor")}
# ---------------------------------------------------------------------------------


def _key(c: Column) -> Column:
    """Loader key: lower, without spaces and '_' ('#' kept)."""
    return F.translate(F.lower(c), " _", "")


def _has(rec: str, keys) -> Column:
    return F.exists(F.map_keys(F.col(rec)), lambda k: _key(k).isin(*keys))


def _get(rec: str, keys) -> Column:
    """Value of the first alias present (alias order), later duplicate column wins."""
    out = None
    for a in keys:
        hits = F.filter(F.map_entries(F.col(rec)), lambda e: _key(e["key"]) == F.lit(a))
        v = F.when(F.size(hits) > 0, F.try_element_at(hits, F.lit(-1))["value"])
        out = v if out is None else F.coalesce(out, v)
    return out


def _norm_aliases(aliases):
    return tuple("".join(ch for ch in a.lower() if ch not in " _") for a in aliases)


def load_repairs_grid(grid: DataFrame) -> DataFrame:
    """Cleaned repair exports -> canonical repairs rows.

    Header row: first of the first 10 rows whose first cell is '#', else row 1.
    Column aliases are resolved once per file from its header names. Row filter
    per file: with a row-index column keep all-digit index values; else rows with
    a parseable completed date; else rows with an equipment name. Missing numeric
    columns are 0, text columns ''."""
    def names_for(canon):
        return [k for k, v in REPAIRS_RENAME.items() if v == canon]
    spec = {"idx": _norm_aliases(ROW_INDEX_ALIASES), "date_guess": _norm_aliases(DATE_ALIASES),
            "eq_guess": _norm_aliases(EQUIPMENT_ALIASES),
            "date": _norm_aliases(names_for("date")) + DATE_FALLBACK_KEYS,
            "equipment": _norm_aliases(names_for("equipment")) + EQUIPMENT_FALLBACK_KEYS,
            "equip_id": _norm_aliases(names_for("equip_id")) + ID_FALLBACK_KEYS}
    for c in ("location", "repairs", "hours", "parts", "labor", "total"):
        spec[c] = _norm_aliases(names_for(c))
    grid = staged(grid)
    top = grid.where(F.col("row_no") < 10)
    r = records_resolved(grid, find_header_rows(top, "#", 10, 1), spec, _key, top)
    keep = (F.when(F.col("_c_idx").isNotNull(), strip_ws(F.coalesce(field("idx"), F.lit(""))).rlike(r"^\d+$"))
            .when(F.col("_c_date_guess").isNotNull(), parse_date(field("date_guess")).isNotNull())
            .when(F.col("_c_eq_guess").isNotNull(), strip_ws(F.coalesce(field("eq_guess"), F.lit(""))) != "")
            .otherwise(F.lit(True)))
    r = r.where(keep)
    out = r.select(
        "file", "row_no", parse_date(field("date")).alias("date"),
        F.coalesce(field("equipment"), F.lit("")).alias("equipment"),
        F.coalesce(field("equip_id"), F.lit("")).alias("equip_id_raw"),
        F.coalesce(field("location"), F.lit("")).alias("location"),
        *[F.coalesce(to_double(field(c)), F.lit(0.0)).alias(c) for c in ("repairs", "hours", "parts", "labor", "total")])
    return out.withColumn("month_key", month_key("date")).withColumn("equip_id", norm_equip_id("equip_id_raw"))


def clean_repairs_rows(grid: DataFrame, labor_rate: float = P.LABOR_RATE_PER_HOUR) -> DataFrame:
    """Raw repair row exports (header on the first line) -> cleaned repair lines.

    Labelled cells lose their label; rows need a name or an id and a parseable
    completion date; hours come from the details text; labor = hours x rate and
    total = parts + labor, both rounded half-to-even at cents; month from the file
    name. ``#`` numbers a file's kept rows 1..n in file order."""
    top = materialize(grid.where(F.col("row_no") == 0))
    spec = {**{k: (col,) for k, (col, _) in RAW_REPAIR_FIELDS.items()}, "completed": ("CompletedDate1",), "details": ("Details",), "cost": ("Textbox38",)}
    recs = records_resolved(grid, top.select("file", F.lit(0).alias("header_row")), spec, lambda k: k, top)
    # white space goes once a cell, not once a rule
    cells = recs.select("file", "row_no", "cells", "_width", *[strip_cell(field(k)).alias("_" + k) for k in spec])
    vals = {k: extract_label("_" + k, label, stripped=True) for k, (_, label) in RAW_REPAIR_FIELDS.items()}
    row_text = F.concat_ws(" ", F.slice("cells", F.lit(1), F.col("_width")))
    r = cells.select("file", "row_no", parse_date("_completed", stripped=True).alias("completed_date"), vals["equipment"].alias("equipment"),
                    vals["equip_id"].alias("equip_id"), vals["location"].alias("location"), vals["vendor"].alias("vendor"),
                    parse_repair_hours("_details", row_text, stripped=True).alias("hours"),
                    parse_dollar("_cost", stripped=True).alias("parts"))
    # written as parsed, then filtered: a filter would be pushed into the parsing and every
    # cell parsed twice, and numbering reads its input twice
    r = materialize(r).where(((F.col("equipment") != "") | (F.col("equip_id") != "")) & F.col("completed_date").isNotNull())
    r = r.withColumn("vendor", F.when(F.col("vendor") != "", F.col("vendor")).otherwise(F.lit("—")))
    r = r.withColumn("labor", labor_cost("hours", labor_rate)) \
         .withColumn("total", F.bround(F.col("parts") + F.col("labor"), 2)) \
         .withColumn("repairs", F.lit(1))
    months = materialize(top.select("file", month_from_file_name("file").alias("month_key")))  # once per file
    return dense_number(r, "file", "row_no", "#").join(months, "file")


REQUEST_COLUMNS = ("Work Order #", "Request Date", "Requestor", "Request", "Assigned To")


def clean_requests_grid(grid: DataFrame, default_year: int = P.DEFAULT_FILE_YEAR):
    """Raw request exports -> (cleaned rows, rejected files).

    The header row is the first of the first 25 rows whose first cell is
    'Work Order #'; files without one are returned as rejected. Rows need a
    work order that is not blank and does not start with 'total', and a
    parseable request date (written MM/dd/yyyy). Each file's month comes from
    its name, else from the first kept row."""
    grid = staged(grid)
    top = grid.where(F.col("row_no") < 25)
    headers = materialize(find_header_rows(top, "Work Order #", 25, None))
    rejected = headers.where(F.col("header_row").isNull()).select("file")
    spec = {c: (c.strip().lower(),) for c in REQUEST_COLUMNS}
    r = records_resolved(grid, headers.where(F.col("header_row").isNotNull()), spec,
                         lambda k: F.lower(strip_ws(k)), top)
    wo = strip_ws(field("Work Order #"))
    d = parse_date(field("Request Date"))
    r = r.where(wo.isNotNull() & (wo != "") & ~F.lower(wo).startswith("total") & d.isNotNull())
    out = r.select("file", "row_no", wo.alias("work_order"), F.date_format(d, "MM/dd/yyyy").alias("request_date"),
                   field("Requestor").alias("requestor"), field("Request").alias("request"),
                   F.coalesce(field("Assigned To"), F.lit("")).alias("assigned_to"), month_key(d).alias("_m"))
    out = materialize(out)  # read for the files' months and for the rows
    first = out.groupBy("file").agg(F.min_by("_m", "row_no").alias("_first_m"))
    first = first.withColumn("file_month", F.coalesce(month_from_file_name("file", default_year),
                                                      F.col("_first_m")))  # once per file
    out = out.join(materialize(first.select("file", "file_month")), "file").drop("_m")
    return out, rejected


def load_requests_grid(grid: DataFrame) -> DataFrame:
    """Cleaned request exports -> requests (header 'Work Order #' in the first 10
    rows, else row 1; drop rows whose work order is null or starts with 'Total';
    dates M/d/yyyy, bad -> null)."""
    spec = {c: (c,) for c in REQUEST_COLUMNS}
    grid = staged(grid)
    top = grid.where(F.col("row_no") < 10)
    r = records_resolved(grid, find_header_rows(top, "Work Order #", 10, 1), spec, lambda k: strip_ws(k), top)
    wo = field("Work Order #")
    r = r.where(wo.isNotNull() & ~wo.startswith("Total"))
    d = F.try_to_date(strip_ws(field("Request Date")), "M/d/yyyy")
    return r.select("file", "row_no", wo.alias("work_order"), d.alias("request_date"),
                    field("Requestor").alias("requestor"), field("Request").alias("request"),
                    F.coalesce(field("Assigned To"), F.lit("")).alias("assigned_to"), month_key(d).alias("month_key"))


# ---- equipment list ---------------------------------------------------------------
EQUIPMENT_COLUMNS = ("EquipmentId", "Name", "Location", "EquipType", "Manufacturer", "SerialNumber",
                     "PurchaseDate", "DepreciationYears", "Cost", "Age")
# fixed values: export header -> canonical column
EQUIPMENT_RENAME = {"Equipment ID": "EquipmentId", "Equip. Name": "Name", "EquipmentName": "Name",
                    "Equip. Type": "EquipType", "Serial Number": "SerialNumber",
                    "Depreciation Yrs": "DepreciationYears", "Purch. Date": "PurchaseDate",
                    "Purch. Cost": "Cost", "Current Value": "CurrentValue"}


def _canon_header(c: Column) -> Column:
    """Header cell as the list cleaner names it: trimmed, BOM removed, renamed."""
    s = F.regexp_replace(strip_ws(c), "^﻿", "")
    kv = []
    for k, v in EQUIPMENT_RENAME.items():
        kv += [F.lit(k), F.lit(v)]
    return F.coalesce(F.element_at(F.create_map(*kv), s), s)


def clean_equipment_grid(grid: DataFrame, tmap: DataFrame | None, as_of, scan_rows: int = 40):
    """Equipment list exports -> (one row per equipment id, rejected files).

    Header: the first of the first 40 rows holding an 'equipmentid' cell, then
    rows 1 and 0, whichever first yields both EquipmentId and Name. Rows need an
    id and a name without (Repair)/(PM); ids lose spaces; cost falls back to the
    current value; the latest purchase date per id wins (first row on ties);
    blank types come from the type map, then the name rules."""
    from upkeep.functions import age_years, extract_location, parse_list_cost
    from upkeep.operators.category import resolve_category
    from upkeep.operators.windows import latest_per_key
    grid = staged(grid)
    top = grid.where(F.col("row_no") < max(scan_rows, 2))
    found = find_header_rows(top, "equipment id", scan_rows, None, any_column=True)
    tries = found.select("file", F.array_distinct(F.filter(F.array(F.col("header_row"), F.lit(1), F.lit(0)),
                                                          lambda x: x.isNotNull())).alias("t"))
    tries = tries.select("file", F.posexplode("t").alias("rank", "row"))
    hdr_rows = top.select(F.col("file").alias("_gf"), F.col("row_no").alias("_gr"),
                           F.transform("cells", _canon_header).alias("canon"))
    cand = tries.join(hdr_rows, (F.col("file") == F.col("_gf")) & (F.col("row") == F.col("_gr"))) \
                .where(F.array_contains("canon", "EquipmentId") & F.array_contains("canon", "Name"))
    best = materialize(cand.groupBy("file").agg(F.min_by("row", "rank").alias("header_row")))
    rejected = grid.select("file").distinct().join(best, "file", "left_anti")
    h = materialize(best.join(hdr_rows, (F.col("file") == F.col("_gf")) & (F.col("header_row") == F.col("_gr")))
                    .select(F.col("file").alias("_nf"), "header_row", unique_names(F.col("canon")).alias("names")))
    g = grid.join(h, F.col("file") == F.col("_nf")).where(F.col("row_no") > F.col("header_row"))
    g = g.select("file", "row_no", record_map("names", "cells").alias("rec"))

    def cell(name):
        return F.nullif(F.element_at("rec", F.lit(name)), F.lit(""))

    # the stand-in column counts for a location only where the file has no Location
    # column, and for a cost where the cost cell is empty (text that is no number stays null)
    loc = F.when(F.map_contains_key("rec", F.lit("Location")), cell("Location")) \
           .otherwise(extract_location(cell("PersonnelId1")))
    cost = parse_list_cost(F.coalesce(cell("Cost"), cell("CurrentValue")))
    r = g.select("file", "row_no",
                 F.regexp_replace(cell("EquipmentId"), " ", "").alias("_id"), cell("Name").alias("Name"),
                 loc.alias("Location"), cell("EquipType").alias("EquipType"),
                 cell("Manufacturer").alias("Manufacturer"), cell("SerialNumber").alias("SerialNumber"),
                 parse_date(cell("PurchaseDate")).alias("PurchaseDate"),
                 cell("DepreciationYears").alias("DepreciationYears"), cost.alias("Cost"))
    r = r.where(F.col("_id").isNotNull() & F.col("Name").isNotNull() & ~F.col("Name").rlike(r"\(Repair\)|\(PM\)"))
    r = r.withColumn("EquipmentId", strip_ws("_id")).drop("_id") \
         .withColumn("row_ord", F.struct("file", "row_no"))
    latest = latest_per_key(r, "EquipmentId", "PurchaseDate").drop("file", "row_no", "row_ord")
    latest = latest.withColumn("Age", age_years("PurchaseDate", as_of)).withColumn("equip_id", norm_equip_id("EquipmentId"))
    blank = strip_ws(F.coalesce(F.col("EquipType"), F.lit(""))) == ""
    filled = resolve_category(latest.withColumn("_name", F.col("Name")), "_name", tmap, None, out="_cat", default=None)
    # only blank types change; one that neither the map nor the name rules know stays null
    out = filled.withColumn("EquipType", F.when(blank, F.col("_cat")).otherwise(F.col("EquipType")))
    return out.select(*EQUIPMENT_COLUMNS), rejected


# ---- service orders -------------------------------------------------------------
# fixed values: order-list export column names -> logical names
ORDER_LIST_RENAME = {"EquipmentId1": "EquipmentId", "EquipmentName1": "EquipmentName", "Textbox21": "StatusRaw"}


def clean_service_grid(grid: DataFrame, default_year: int = P.DEFAULT_FILE_YEAR,
                       detail_bucket_rows: int = 4096) -> DataFrame:
    """Service exports (header on line 0) -> cleaned service rows.

    Order-list files (an EquipmentId1 / EquipmentName1 column) carry one order
    per row; legacy files carry an equipment header row whose id, name, location
    and cost apply to the following detail rows (forward fill, all four reset
    together). Rows need a scheduled-date text, a real description, an id and a
    parseable date; when the file name gives a month, a row must fall in it by
    scheduled or completed month."""
    from upkeep.functions import (clean_service_description, is_placeholder_description, status_from_hint)
    from upkeep.operators.windows import forward_fill
    # the grid isn't staged: it is read for its first rows, and once more where all rows are parsed
    hdr = grid.where(F.col("row_no") == 0).select(
        F.col("file").alias("_hf"),
        F.transform("cells", lambda c: strip_ws(F.regexp_replace(F.coalesce(c, F.lit("")), "^﻿", ""))).alias("raw"))
    is_ol = F.exists("raw", lambda c: c.isin("EquipmentId1", "EquipmentName1"))
    has_loc = F.array_contains("raw", "Location")
    kv = []
    for k, v in ORDER_LIST_RENAME.items():
        kv += [F.lit(k), F.lit(v)]
    ren = F.create_map(*kv)
    names = F.transform("raw", lambda c: F.when(
        is_ol, F.coalesce(F.element_at(ren, c), F.when((c == "Name") & ~has_loc, F.lit("Location")), c)).otherwise(c))
    hdr = hdr.select("_hf", is_ol.alias("order_list"), unique_names(names).alias("names"),
                     month_from_file_name("_hf", default_year).alias("_fm"))  # once per file
    wanted = ("EquipmentId", "ScheduledDate", "CompletedDate", "Description", "StatusRaw", "EquipmentName", "Name", "Location", "Cost")
    hdr = hdr.select("*", *[F.lit(n).alias("_c_" + n) for n in wanted])
    hdr = materialize(hdr.select("_hf", "order_list", "_fm", *[name_place("names", "_c_" + n) for n in wanted]))
    g = grid.where(F.col("row_no") > 0).join(hdr, F.col("file") == F.col("_hf"))
    g = g.select("file", "row_no", "order_list", "_fm", *[strip_cell(field(n)).alias(n) for n in wanted])
    # every cell is parsed once and written: filters and the forward fill below would
    # else be pushed into the parsing and repeat it
    base = g.select(
        "file", "row_no", "order_list", "_fm", F.coalesce("EquipmentId", F.lit("")).alias("_eid"),
        F.coalesce(F.col("ScheduledDate") != "", F.lit(False)).alias("_has_sched"), is_placeholder_description("Description").alias("_stub"),
        parse_date("ScheduledDate", stripped=True).alias("_sd"), parse_date("CompletedDate", stripped=True).alias("_cd"),
        clean_service_description("Description", stripped=True).alias("_dc"), F.col("StatusRaw").alias("_hint"),
        F.coalesce("EquipmentName", "Name", F.lit("")).alias("_name"),
        F.coalesce("Location", F.lit("")).alias("_loc"), parse_dollar("Cost", stripped=True).alias("_price"))
    with packed(grid.sparkSession):
        base = materialize(base)
    ms, mc = month_key("_sd"), month_key("_cd")
    months_ok = F.col("_fm").isNull() | (ms.isNull() & mc.isNull()) | (F.col("_fm") == ms) | (F.col("_fm") == mc)
    # what a row's own cells decide; only these rows and headers take part in the fill
    keep = (F.col("_has_sched") & ~F.col("_stub") & (F.col("_sd").isNotNull() | F.col("_cd").isNotNull())
            & F.coalesce(months_ok, F.lit(True))
            & (F.col("_dc") != "") & ~F.lower(F.col("_dc")).startswith("delete duplicate"))
    has_id = F.col("_eid") != ""
    ol = base.where(F.col("order_list") & keep)
    own = ["file", "row_no", "_sd", "_cd", "_dc"]
    leg = base.where(~F.col("order_list") & (has_id | keep)).withColumn("_keep", keep)
    leg = forward_fill(leg.select(*own, "_eid", "_name", "_loc", "_price", "_keep"), ["file"], "row_no", has_id,
                       ["_eid", "_name", "_loc", "_price"], bucket_rows=detail_bucket_rows, prefix="ctx", rows=F.col("_keep"), keep=own)
    leg = leg.select(*own, F.lit(None).cast("string").alias("_hint"),
                     F.coalesce(F.col("ctx_eid"), F.lit("")).alias("_eid"),
                     F.coalesce(F.col("ctx_name"), F.lit("")).alias("_name"),
                     F.coalesce(F.col("ctx_loc"), F.lit("")).alias("_loc"),
                     F.coalesce(F.col("ctx_price"), F.lit(0.0)).alias("_price"))
    rows = ol.select(*leg.columns).unionByName(leg)
    out = rows.where(has_id).select(
        "file", "row_no", F.col("_eid").alias("equip_id"), F.col("_name").alias("equipment"),
        F.col("_sd").alias("sched_date"), F.col("_cd").alias("completed_date"), F.col("_loc").alias("location"),
        F.col("_dc").alias("description"), status_from_hint(F.col("_hint"), F.col("_cd")).alias("status"),
        F.when(F.col("_price") > 0, F.col("_price")).alias("estimated_price"))
    return out.withColumn("month_key", month_key("sched_date"))
