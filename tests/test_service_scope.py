"""Service display against a plain restatement, and how many rows its rules look up."""

import datetime as dt
import random

from upkeep.operators import service_scope
from upkeep.session import materialize

SCHEMA = ("equip_id string, sched_date date, completed_date date, status string, description string, "
          "month_key string, row_ord int")


def _rows(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        sched = dt.date(2026, r.randint(1, 4), r.randint(1, 28))
        comp = sched + dt.timedelta(days=r.randint(-20, 40)) if r.random() < .5 else None
        # ids in several spellings, descriptions that meet under the hard or the soft key only
        out.append((r.choice(["a 1", "A1", "b2", "B2 ", "c3", "", " ", None]), None if r.random() < .03 else sched, comp,
                    r.choice([" completed", "Open", None]), r.choice(["Fix rig", "fix", "Fix - (Repair)", "Oil  closet", "oil", "", None]),
                    None if r.random() < .05 else sched.strftime("%Y-%m"), i))
    return out


def _display(shown, catalog):
    def hard(d):
        d = (d or "").strip().lower()
        d = d[:-len(" - (repair)")] if d.endswith(" - (repair)") else d
        return " ".join(d.split())

    def soft(d):
        return " ".join(w for w in hard(d).split() if w not in ("rig", "closet"))
    ident = lambda x: (x or "").replace(" ", "").upper()
    done = [x for x in catalog if x[5] and x[2]]
    keys = {(ident(x[0]), k(x[4])) for x in done for k in (hard, soft) if ident(x[0])}
    first = {}
    for x in done:
        first[ident(x[0])] = min(first.get(ident(x[0]), x[2]), x[2])
    latest = max(x[5] for x in catalog if x[5])
    groups = {}
    for x in shown:
        if x[2] is None and x[5] < latest:
            continue
        i = ident(x[0])
        hit = i and ((i, hard(x[4])) in keys or (i, soft(x[4])) in keys or (x[1] and i in first and first[i] > x[1]))
        status = "Completed" if hit or (x[3] or "").strip().lower() == "completed" else "Scheduled"
        groups.setdefault((x[0], soft(x[4]), x[1].strftime("%Y-%m") if x[1] else ""), []).append((x, status))
    far, out = dt.date(1, 1, 1), {}
    for g in groups.values():
        if any(x[2] for x, _ in g) and not all(x[2] for x, _ in g):
            g = [min(g, key=lambda p: (p[0][2] is None, p[1] != "Completed", -(p[0][2] or far).toordinal(), -(p[0][1] or far).toordinal(), p[0][6]))]
        out.update({x[6]: s for x, s in g})
    return out


def test_display_of_all_months(spark):
    for seed in (1, 2):
        rows = _rows(300, seed)
        catalog = spark.createDataFrame(rows, SCHEMA)
        shown = [x for x in rows if x[5] and x[6] % 3]
        out = service_scope.prepare_service_for_display(spark.createDataFrame(shown, SCHEMA), "ALL", catalog=catalog).collect()
        assert {r.row_ord: r.status for r in out} == _display(shown, rows)


def test_only_rows_a_rule_can_change_are_looked_up(spark, monkeypatch):
    """1,000 completed rows and 1,000 open ones of earlier months ask for nothing: the tables
    looked up hold the open work of the latest month, and winners of its groups."""
    sched, last = dt.date(2026, 1, 5), dt.date(2026, 4, 6)
    rows = [(f"d{i}", sched, sched, "Open", f"work {i}", "2026-01", i) for i in range(1000)]
    rows += [(f"o{i}", sched, None, "Open", f"work {i}", "2026-01", 1000 + i) for i in range(1000)]
    rows += [("d1", last, None, "Open", "work 1", "2026-04", 2000), ("d2", last, None, "Open", "other", "2026-04", 2001),
             ("d2", last, last, "Open", "other", "2026-04", 2002)]
    sizes = []

    def counted(df):
        out = materialize(df)
        if "row_ord" not in out.columns:
            sizes.append(out.count())
        return out
    monkeypatch.setattr(service_scope, "materialize", counted, raising=False)
    s = spark.createDataFrame(rows, SCHEMA)
    out = {r.row_ord: r.status for r in service_scope.prepare_service_for_display(s, "ALL").collect()}
    assert out == {i: "Completed" for i in [*range(1000), 2000, 2002]}
    assert sizes and max(sizes) <= 5
