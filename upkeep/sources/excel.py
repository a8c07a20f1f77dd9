"""Excel exports (.xls / .xlsx) as raw grids.

Files are listed with the binary-file source and parsed inside tasks with
``mapInPandas`` (one workbook per row, first sheet, all cells as text), so
the work is spread over executors. Parsing needs a spreadsheet reader package
(openpyxl for .xlsx, xlrd for .xls); without one the source reports itself
unavailable instead of failing inside a task.
"""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame, SparkSession

GRID_SCHEMA = "file string, row_no long, cells array<string>"


def available() -> dict[str, bool]:
    return {"xlsx": importlib.util.find_spec("openpyxl") is not None,
            "xls": importlib.util.find_spec("xlrd") is not None}


def read_excel_grid(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_no, cells) for every .xls/.xlsx under ``path``."""
    have = available()
    if not any(have.values()):
        raise RuntimeError("Excel source unavailable: install openpyxl (.xlsx) or xlrd (.xls)")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xls,xlsx,XLS,XLSX}") \
                 .option("recursiveFileLookup", True).load(path).select("path", "content")

    def parse(batches):
        import io
        import os

        import pandas as pd
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                engine = "openpyxl" if p.lower().endswith("x") else "xlrd"
                sheet = pd.read_excel(io.BytesIO(content), header=None, dtype=str, engine=engine)
                name = os.path.basename(p)
                for i, row in enumerate(sheet.itertuples(index=False)):
                    out.append((name, i, [None if pd.isna(v) else str(v) for v in row]))
            yield pd.DataFrame(out, columns=["file", "row_no", "cells"])

    return files.mapInPandas(parse, GRID_SCHEMA)
