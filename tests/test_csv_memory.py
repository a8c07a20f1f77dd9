"""Records of several lines are put together in bounded shares, and no table of lines carries paths."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F
from test_csv_scan import brute, random_text

from upkeep.sources import csv_scan
from upkeep.sources.raw_grid import read_csv_grid


def _written(monkeypatch):
    seen, real = [], csv_scan.materialize

    def call(df):
        out = real(df)
        seen.append(out)
        return out
    monkeypatch.setattr(csv_scan, "materialize", call)
    return seen


def _two_line_records(n):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("id,text\n")
        f.writelines(f'{i},"x, ""{i}"",\n"\n' for i in range(n))
    return d


def test_lines_carry_no_paths(spark, monkeypatch):
    """40,001 lines in 3 chunks: tables that name files hold a row a chunk, and one table holds the records."""
    seen = _written(monkeypatch)
    d = _two_line_records(20_000)
    got = {(r.row_no, *r.cells) for r in read_csv_grid(spark, d).collect()}
    assert got == {(0, "id", "text")} | {(i + 1, str(i), f'x, "{i}",\n') for i in range(20_000)}
    counts = [(df.count(), "_path" in df.columns) for df in seen]
    assert max(n for n, path in counts if path) <= 3
    assert [n for n, path in counts if not path and n > 3] == [20_001 + 2]  # two records go on in the next chunk


def test_tasks_follow_the_bytes(spark, monkeypatch):
    asked, real = [], csv_scan._told

    def call(lines, chunks, tasks, *columns):
        out = real(lines, chunks, tasks, *columns)
        asked.append((tasks, out.columns))
        return out
    monkeypatch.setattr(csv_scan, "_told", call)
    monkeypatch.setattr(csv_scan, "TASK_BYTES", 1 << 15)
    read_csv_grid(spark, _two_line_records(20_000))
    assert len(asked) == 1 and asked[0][0] > 10 and "_path" not in asked[0][1]


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_records_across_chunks_of_any_size(spark, monkeypatch, bits):
    monkeypatch.setattr(csv_scan, "CHUNK_BITS", bits)
    d, want, rnd = tempfile.mkdtemp(), {}, random.Random(bits)
    texts = [random_text(rnd, k % 2 == 0) for k in range(12)]
    # a cell over many chunks, one after the other; inch marks and whole quoted lines that fix the state
    texts += ['a,"' + "\n" * 40 + '","' + "b\n" * 40 + '"\nc,d\n', '"x","y"\n18" pipe,"z\n"\n"x","y"\n\n5",1\n"p\n"",q"\n' * 8, '1,2\n\n"open\n\n3,"4"\n5\n' + "6\n" * 9]
    for k, text in enumerate(texts):
        with open(os.path.join(d, f"f{k}.csv"), "w", newline="") as f:
            f.write(text)
        want |= {(f"f{k}.csv", n): row for n, row in enumerate(brute(text)[0])}
    got = read_csv_grid(spark, d).collect()
    assert {(r.file, r.row_no): r.cells for r in got} == want and len(got) == len(want)
    good = {f"f{k}.csv" for k, t in enumerate(texts) if not brute(t)[1]}
    got = read_csv_grid(spark, d, skip_bad=True).collect()
    assert {(r.file, r.row_no): r.cells for r in got} == {k: v for k, v in want.items() if k[0] in good}


def test_condition_on_cells_does_not_repeat_the_parsing(spark):
    grid = read_csv_grid(spark, _two_line_records(10))
    kept = grid.where(F.get("cells", F.lit(1)).endswith(",\n") & (F.size("cells") == 2))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert kept.count() == 10 and plan.index("Filter") < plan.index("Generate")
    assert "forall" not in "".join(x for x in plan.splitlines() if "Filter" in x)
