"""Raw export grids with drifting headers.

An export is read as a headerless grid: one row per line with its cells as
``ARRAY<STRING>``, the file name and a 0-based ``row_no``. The header row is
found per file (sentinel in the first cell, or in any cell), its names are
made unique, and every data row becomes a ``MAP<STRING,STRING>`` record keyed
by header name. Any number of files with different headers go through one
plan; no driver loop over files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from upkeep.functions import header_token, norm_col_key, strip_ws
from upkeep.session import materialize
from upkeep.sources.csv_scan import CSV_GLOB, scan_csv

# Cleaning jobs read a grid several times: the top rows for headers, then all rows. They
# stage it first (``staged``): the source is parsed once, and the header search is pushed
# down to the row groups that hold top rows. Per-file tables (header names, resolved
# columns) are written too, so the planner knows their size: it broadcasts them while
# they are small, and splits skewed files in the join beyond that.


def read_csv_grid(spark: SparkSession, path: str | list[str], glob: str = CSV_GLOB, skip_bad: bool = False) -> DataFrame:
    """(file, row_no, cells) from every CSV under ``path``; all cells text, rows of any
    width, cells with line breaks, large files read by many tasks (``csv_scan``)."""
    return scan_csv(spark, path, glob, skip_bad).grid


def grid_from_text(df: DataFrame, file_col: str, text_col: str, sep: str = ",") -> DataFrame:
    """(file, row_no, cells) from a table of whole texts (one text = one file)."""
    lines = df.select(F.col(file_col).alias("file"),
                      F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("row_no", "line"))
    return lines.select("file", "row_no", F.split("line", sep).alias("cells"))


def staged(grid: DataFrame) -> DataFrame:
    """The grid as a Parquet table in the shared folder. A multi-line CSV file is parsed
    by one task, but its staged rows are split over many, row numbers can no longer
    change when a lost task is run again, and every later read is pruned."""
    return materialize(grid)


def find_header_rows(grid: DataFrame, sentinel: str, max_scan: int = 10, default: int | None = 1,
                     any_column: bool = False) -> DataFrame:
    """(file, header_row): first row within ``max_scan`` whose first cell (or any
    cell, token-normalised) equals the sentinel; ``default`` when none (null
    ``default`` = strict: the file has no header row and is reported)."""
    needle = sentinel.strip().lower()
    if any_column:
        tok = "".join(ch for ch in needle.replace("﻿", "") if ch not in "._ ")
        hit = F.exists("cells", lambda c: header_token(c) == tok)
    else:
        hit = F.lower(strip_ws(F.try_element_at("cells", F.lit(1)))) == needle
    cand = grid.where((F.col("row_no") < max_scan) & F.coalesce(hit, F.lit(False))) \
               .groupBy("file").agg(F.min("row_no").alias("_hit"))
    files = grid.select("file").distinct()
    out = files.join(cand, "file", "left")
    d = F.lit(default) if default is not None else F.lit(None).cast("int")
    return out.select("file", F.coalesce("_hit", d).cast("int").alias("header_row"))


def unique_names(names: Column) -> Column:
    """Newlines -> spaces, trimmed; blank -> ``_unnamed_<i>``; the k-th repeat of
    a name -> ``name__k``."""
    base = F.transform(names, lambda x, i: F.coalesce(
        F.nullif(strip_ws(F.regexp_replace(x, "\n", " ")), F.lit("")),
        F.concat(F.lit("_unnamed_"), i.cast("string"))))
    return F.transform(base, lambda x, i: F.when(
        F.size(F.filter(F.slice(base, 1, i), lambda y: y == x)) == 0, x)
        .otherwise(F.concat(x, F.lit("__"), F.size(F.filter(F.slice(base, 1, i), lambda y: y == x)).cast("string"))))


def header_name_rows(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """(file, header_row, pos, name): each header cell with its unique name.
    The repeat counter is a window over (file, name), i.e. over one header
    line's cells, never over data rows."""
    hd = headers.select(F.col("file").alias("_hf"), "header_row")
    h = grid.join(hd, (F.col("file") == F.col("_hf")) & (F.col("row_no") == F.col("header_row")))
    e = h.select("file", "header_row", F.posexplode("cells").alias("pos", "raw"))
    base = F.coalesce(F.nullif(strip_ws(F.regexp_replace("raw", "\n", " ")), F.lit("")),
                      F.concat(F.lit("_unnamed_"), F.col("pos").cast("string")))
    e = e.withColumn("_base", base)
    kth = F.row_number().over(Window.partitionBy("file", "_base").orderBy("pos")) - 1
    e = e.withColumn("_k", kth)
    name = F.when(F.col("_k") == 0, F.col("_base")).otherwise(F.concat("_base", F.lit("__"), F.col("_k").cast("string")))
    return e.select("file", "header_row", "pos", name.alias("name"))


def header_names(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """(file, header_row, names) with unique names per file, in column order."""
    r = header_name_rows(grid, headers)
    return r.groupBy("file", "header_row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))


def records(grid: DataFrame, headers: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """Rows below each file's header as (file, row_no, rec MAP<name, cell>).
    Names are unique, so the first of duplicated columns keeps the plain name.
    ``top``: the rows that header rows are among, where known."""
    names = materialize(header_names(grid if top is None else top, headers).withColumnRenamed("file", "_nf"))
    g = grid.join(names, F.col("file") == F.col("_nf")).where(F.col("row_no") > F.col("header_row"))
    return g.select("file", "row_no", record_map("names", "cells").alias("rec"))


def record_map(names, cells) -> Column:
    """Header name -> cell; short rows are padded with nulls (every header is a
    key on every row), cells beyond the header are dropped."""
    names = F.col(names) if isinstance(names, str) else names
    cells = F.col(cells) if isinstance(cells, str) else cells
    padded = F.transform(names, lambda _n, i: F.try_element_at(cells, (i + 1).cast("int")))
    return F.map_from_arrays(names, padded)


def pick(rec: str | Column, *aliases: str) -> Column:
    """First alias present as a key (keys compared lower-case without space, '_'
    and '#'); presence decides, not the value. When two keys normalise alike
    the later column wins."""
    m = F.col(rec) if isinstance(rec, str) else rec
    entries = F.map_entries(m)
    out = None
    for a in aliases:
        k = "".join(ch for ch in a.lower() if ch not in " _#")
        hits = F.filter(entries, lambda e: norm_col_key(e["key"]) == F.lit(k))
        cond = F.size(hits) > 0
        val = F.try_element_at(hits, F.lit(-1))["value"]
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out if out is not None else F.lit(None).cast("string")


def resolve_columns(names: Column, spec: dict, key_fn) -> list[Column]:
    """For each output in ``spec`` (name -> alias keys in priority order) the
    header name to read, found once per file from its header names: first alias
    present; when two headers normalise alike the later one wins."""
    out = []
    for name, keys in spec.items():
        v = None
        rkeys = F.reverse(F.transform(names, key_fn))
        for k in keys:
            pos = F.array_position(rkeys, F.lit(k))  # 1-based from the end: later header wins
            c = F.when(pos > 0, F.try_element_at(names, (-pos).cast("int")))
            v = c if v is None else F.coalesce(v, c)
        out.append(v.alias("_c_" + name))
    return out


def records_resolved(grid: DataFrame, headers: DataFrame, spec: dict, key_fn, top: DataFrame | None = None) -> DataFrame:
    """Rows below each file's header as (file, row_no, cells) plus one ``_c_<name>`` column
    per spec entry, the place (from 0) of the resolved header name, null when the file lacks
    the column, and ``_width``, the file's number of names. Resolution runs on one row per
    file; rows read their cells by place, so no map is built per row."""
    hn = header_names(grid if top is None else top, headers)
    hn = hn.select(F.col("file").alias("_nf"), "header_row", "names", *resolve_columns(F.col("names"), spec, key_fn))
    hn = materialize(hn.select("_nf", "header_row", F.size("names").alias("_width"), *[name_place("names", "_c_" + k) for k in spec]))
    g = grid.join(hn, F.col("file") == F.col("_nf")).where(F.col("row_no") > F.col("header_row"))
    return g.select("file", "row_no", "cells", "_width", *[F.col("_c_" + k) for k in spec])


def name_place(names: str, name: str) -> Column:
    """Place (from 0) of the header name in column ``name`` among unique ``names``; null when absent."""
    return (F.nullif(F.array_position(F.col(names), F.col(name)).cast("int"), F.lit(0)) - 1).alias(name)


def field(name: str) -> Column:
    """Cell of a resolved column; null when the file has no such column or the row is short."""
    return F.get("cells", F.col("_c_" + name))
