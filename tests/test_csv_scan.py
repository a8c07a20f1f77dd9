"""CSV files over byte ranges against a reader that goes through a file character by character."""

import gzip
import os
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from upkeep.sources.csv_scan import scan_csv
from upkeep.sources.raw_grid import read_csv_grid
from upkeep.sources.tables import read_csv_table, rejected_files


@pytest.fixture
def ranges(spark):
    """Byte ranges of a few lines, so that records and cells cross them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)

    yield to
    for k, v in old.items():
        spark.conf.set(k, v)


def cells(record):
    """Cells of one record, from outside a quoted cell."""
    out, cell, inside, start, k = [], "", False, True, 0
    while k < len(record):
        c = record[k]
        if inside:
            if c == '"' and record[k + 1:k + 2] == '"':
                cell, k = cell + '"', k + 1
            elif c == '"':
                inside = False
            else:
                cell += c
        elif c == '"' and start:
            inside = True
        elif c == ",":
            out.append(cell)
            cell = ""
        else:
            cell += c
        start = not inside and c == ","
        k += 1
    out = [x or None for x in [*out, cell]]
    while len(out) > 1 and out[-1] is None:
        out.pop()
    return out, inside


def brute(text):
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if lines[-1] == "":
        lines.pop()
    out, k = [], 0
    while k < len(lines):
        if lines[k].strip(" ") == "":
            k += 1
            continue
        for end in range(k, len(lines)):
            got, inside = cells("\n".join(lines[k:end + 1]))
            if not inside:
                break
        else:  # never closed: every line by itself
            out += [cells(x)[0] for x in lines[k:] if x.strip(" ")]
            return out, True
        out.append(got)
        k = end + 1
    return out, False


def random_text(rnd, odd):
    def cell():
        kind = rnd.random()
        if kind < 0.3:
            return rnd.choice(["", "a", "Vac 18", " x ", "é漢"])
        if kind < 0.45 and odd:
            return rnd.choice(['18" scrubber', 'a"b"c', 'x""y', '5"'])
        body = "".join(rnd.choice(["a", ",", '""', "\n", "\n\n", " ", "b\n", '"",""', "\r\n"]) for _ in range(rnd.choice([0, 1, 3, 8])))
        return f'"{body}"' + ("tail" if odd and rnd.random() < 0.1 else "")
    end = rnd.choice(["\n", "\r\n"])
    lines = [",".join(cell() for _ in range(rnd.choice([1, 2, 5]))) if rnd.random() > 0.08 else rnd.choice(["", "  "]) for _ in range(rnd.choice([0, 1, 6, 30]))]
    text = end.join(lines) + rnd.choice(["", end])
    return text + ('x,"never closed\n\n1,2\n"",3' if odd and rnd.random() < 0.2 else "")


@pytest.mark.parametrize("size, odd", [(64, False), (100, True), (1 << 20, True)])
def test_random_files_over_ranges_of_any_size(spark, ranges, size, odd):
    d, want, rnd = tempfile.mkdtemp(), {}, random.Random(size + odd)
    for k in range(14):
        name = f"f {k}+é{'.csv' if k % 3 else '.CSV'}"
        text = random_text(rnd, odd)
        with open(os.path.join(d, name), "w", newline="") as f:
            f.write(text)
        for n, row in enumerate(brute(text)[0]):
            want[name, n] = row
    ranges(size)
    got = read_csv_grid(spark, d).collect()
    assert {(r.file, r.row_no): r.cells for r in got} == want and len(got) == len(want)
    assert any(x and "\n" in x for row in want.values() for x in row)


def test_one_file_is_read_by_many_tasks(spark, ranges):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "big.csv"), "w") as f:
        for i in range(3000):
            f.write(f'{i},"x{i}"\n')
    ranges(4096)
    g = read_csv_grid(spark, d)
    assert g.rdd.getNumPartitions() > 5 and "Exchange hashpartitioning" not in g._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.row_no, r.cells) for r in g.collect()) == [(i, [str(i), f"x{i}"]) for i in range(3000)]


@pytest.mark.parametrize("row", ['a,"' + "," * 30_000 + '",b', ",".join(["x"] * 30_000), ",".join(['"x"'] * 30_000), "a," + '""' * 3, '"' + '""' * 30_000 + '"',
                                 '"' + "line\n" * 20_000 + '",end'], ids=["commas", "cells", "quoted cells", "empty", "doubled quotes", "lines"])
def test_wide_rows_cost_only_themselves(spark, row):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "w.csv"), "w") as f:
        f.write("h1,h2,h3\n" + row + "\n1,2,3\n")
    began = time.time()
    got = [r.cells for r in read_csv_grid(spark, d).orderBy("row_no").collect()]
    assert got == [["h1", "h2", "h3"], cells(row)[0], ["1", "2", "3"]]
    assert time.time() - began < 30


def test_rejects_and_good_rows(spark, ranges):
    d = tempfile.mkdtemp()
    files = {"good.csv": b"id,cost\nA,1\n", "also good.CSV": b"cost,id\n2,\"B\nC\"\n", "empty.csv": b"", "blank.csv": b"\n  \n", "open.csv": b'id,cost\n"A,1\n2,3\n',
             "latin.csv": "id,cost\né,1\n".encode("latin-1"), "binary.csv": b"PK\x03\x04\x00\x00,\n", "other.txt": b"x"}
    for name, data in files.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    packed = gzip.compress(b"id,cost\n" + b"".join(b"%d,%d\n" % (k, k) for k in range(20_000)))
    with open(os.path.join(d, "cut.csv"), "wb") as f:
        f.write(b"id,cost\n9,9\n")
    bad = {r.file: r.reason for r in rejected_files(spark, d).collect()}
    assert bad == {"empty.csv": "empty", "blank.csv": "empty", "open.csv": "open quote", "latin.csv": "not text", "binary.csv": "not text"}
    t = read_csv_table(spark, d, skip_bad=True)
    assert sorted((r.id, r.cost, r.source_file) for r in t.collect()) == [("9", "9", "cut.csv"), ("A", "1", "good.csv"), ("B\nC", "2", "also good.CSV")]
    # part of a broken archive could be read: nothing tells how much, so the job fails
    with open(os.path.join(d, "packed.csv.gz"), "wb") as f:
        f.write(packed[:len(packed) // 2])
    with pytest.raises(Exception, match="(?i)unexpected end|corrupt|EOF"):
        scan_csv(spark, d, glob="*.{csv,csv.gz}", skip_bad=True)


def test_no_files(spark):
    d = tempfile.mkdtemp()
    assert read_csv_grid(spark, d).count() == 0 and rejected_files(spark, d).count() == 0
    assert read_csv_table(spark, d).columns == ["source_file"]


def test_cells_without_a_gap_need_no_lambda(spark):
    from upkeep.sources.csv_scan import filled, record_cells
    records = {"a,b": ["a", "b"], "": [None], ",": [None], "a,": ["a"], ",a,,b": [None, "a", None, "b"], '"x, y",,""': ["x, y"],
               '"",z': [None, "z"], 'a,"': ["a"], '"p""q",1': ['p"q', "1"]}
    df = spark.createDataFrame([(k,) for k in records], "v string")
    out = df.select("v", filled(record_cells(F.col("v"), F.split("v", '"'))).alias("c"))
    assert {r.v: r.c for r in out.collect()} == records
    # the pass over every cell is behind a search for an empty one
    plan = df.select(record_cells(F.col("v"), F.split("v", '"')))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" in plan
