"""Cleaning jobs read cells by place and parse each once; odd cells and white space keep their results."""

from pyspark.sql import functions as F

from upkeep.functions import strip_cell, strip_ws
from upkeep.plans import jobs
from upkeep.session import materialize

HEAD = ["PersonnelId5", "PersonnelId1", "PersonnelId4", "PersonnelId3", "CompletedDate1", "Textbox38", "Details"]
GRID = "file string, row_no long, cells array<string>"


def test_strip_cell_is_strip_ws(spark):
    texts = ["", " ", "a", "a b", " a", "a\t", " a", "a ", "é", "aé", "　", "!~", "\x7f", "\n a \n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.a == r.b for r in df.select(strip_cell("t").alias("a"), strip_ws("t").alias("b")).collect())


def _reads_in(monkeypatch):
    """Plans of the tables a job writes that hold cells parsed into columns."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return materialize(df)
    monkeypatch.setattr(jobs, "materialize", seen)
    return plans


def test_repair_cells_by_place(spark, monkeypatch):
    plans = _reads_in(monkeypatch)
    rows = [("May 2024 x.csv", 0, HEAD),
            ("May 2024 x.csv", 1, ["Equip. Name:  Saw ", " Equipment Id: 7", "Location: A:B", "", "5/1/2024", "$1,000.5", "4.5 hrs"]),
            ("May 2024 x.csv", 2, ["Saw", "8", None, None, "5/2/2024 "]),                                        # short row
            ("May 2024 x.csv", 3, ["Saw", "9", "we found it", "V", "5/3/2024", "x", " "]),
            ("May 2024 x.csv", 4, ["Saw", "10", "", "", "5/3/2024", "-3", "", "found"]),                          # beyond the header
            ("May 2024 x.csv", 5, ["", "Equipment Id: ", "", "", "5/3/2024", "3", "1"]),                          # neither name nor id
            ("May 2024 x.csv", 6, ["Saw", "11", "", "", "soon", "3", "1"]),
            ("May 2024 x.csv", 7, ["Saw", "12", "", "", "2024-05-04", "3", "1 5"]),
            ("May 2024 x.csv", 8, ["Saw", "13", "", "", "2024-05-04", "3", "1/0 hours"]),
            ("May 2024 x.csv", 9, ["Saw", "14", "", "", "2024-05-04", "3", "3 / 4hr"]),
            ("May 2024 x.csv", 10, ["Saw", "15", "", "", "2024-05-04", "3", "2,5 Hours"])]
    out = jobs.clean_repairs_rows(spark.createDataFrame(rows, GRID)).orderBy("#").collect()
    assert [(r["#"], r.equipment, r.equip_id, r.location, r.vendor, r.hours, r.parts) for r in out] == [
        (1, "Saw", "7", "A:B", "—", 4.5, 1000.5), (2, "Saw", "8", "", "—", 1.0, 0.0), (3, "Saw", "9", "we found it", "V", .5, 0.0),
        (4, "Saw", "10", "", "—", 1.0, -3.0), (5, "Saw", "12", "", "—", 1.5, 3.0), (6, "Saw", "13", "", "—", 1.0, 3.0),
        (7, "Saw", "14", "", "—", .75, 3.0), (8, "Saw", "15", "", "—", 2.5, 3.0)]
    parsed = [p for p in plans if "completed_date" in p]
    # written as parsed: the filter behind the write can't repeat the parsing; no map is built per row
    assert len(parsed) == 1 and "map_from_arrays" not in parsed[0] and "Filter" not in parsed[0].split("Join")[0]


def test_service_cells_once(spark, monkeypatch):
    plans = _reads_in(monkeypatch)
    rows = [("Orders.csv", 0, ["EquipmentId1", "EquipmentName1", "Textbox21", "Name", "ScheduledDate", "CompletedDate", "Description", "Cost"]),
            ("Orders.csv", 1, [" 7 ", "Saw", "completed", "Hall", "5/1/2024", "", "Oil - (Repair) ", "$2"]),
            ("Orders.csv", 2, ["8", "Saw", "", "Hall", " ", "5/2/2024", "Oil", "$2"]),                     # no scheduled text
            ("Orders.csv", 3, ["9", "Saw", "odd", "Hall", "soon", "5/2/2024", "Oil - (PM)", "x"]),
            ("May 2024 Details.csv", 0, ["EquipmentId", "Name", "Location", "Cost", "ScheduledDate", "CompletedDate", "Description"]),
            ("May 2024 Details.csv", 1, ["1", "Mop", "Hall", "$3"]),
            ("May 2024 Details.csv", 2, ["", "", "", "", "5/1/2024", "5/9/2024", "Wax"]),
            ("May 2024 Details.csv", 3, ["", "", "", "", "6/1/2024", "6/2/2024", "Wax"])]                    # not of the file's month
    out = jobs.clean_service_grid(spark.createDataFrame(rows, GRID)).orderBy("equip_id").collect()
    assert [(r.equip_id, r.equipment, r.location, r.description, r.status, r.estimated_price, r.month_key) for r in out] == [
        ("1", "Mop", "Hall", "Wax", "Completed", 3.0, "2024-05"), ("7", "Saw", "Hall", "Oil", "Completed", 2.0, "2024-05"),
        ("9", "Saw", "Hall", "Oil", "Completed", None, None)]
    parsed = [p for p in plans if "_has_sched" in p]
    assert len(parsed) == 1 and "map_from_arrays" not in parsed[0]
