"""Drops merged into a keyed state against one rebuild from all rows."""

import datetime as dt
import random
import tempfile

from upkeep.operators.state import KeyedState

SCHEMA = "id string, day date, cost double, row_ord struct<file:string,row_no:int>"


def rebuilt(rows):
    best = {}
    for r in rows:
        if r[0] is None:
            continue
        rank = (r[1] is None, -(r[1] or dt.date.min).toordinal(), r[3])
        if r[0] not in best or rank < best[r[0]][0]:
            best[r[0]] = (rank, r)
    return sorted(map(str, (r for _, r in best.values())))


def test_drops_equal_a_rebuild_and_touch_only_their_buckets(spark):
    rnd, state = random.Random(4), KeyedState(spark, tempfile.mkdtemp() + "/state", SCHEMA, "id", "day", buckets=16)
    rows = []
    assert state.rows().count() == 0
    for k, (n, ids) in enumerate([(400, 60), (0, 1), (6, 60), (300, 90)]):
        drop = [(None if rnd.random() < 0.02 else "hot" if rnd.random() < 0.3 else f"i{rnd.randrange(ids)}", None if rnd.random() < 0.2 else dt.date(2020, 1, 1) + dt.timedelta(rnd.randrange(50)),
                 float(j), (f"f{k}", j)) for j in range(n)]
        before = state.bucket_folders()
        touched = state.merge(spark.createDataFrame(drop, SCHEMA))
        after = state.bucket_folders()
        assert {b for b in after if after[b] != before.get(b)} == set(touched) and (n != 6 or 0 < len(touched) <= 6)
        rows += drop
        got = sorted(str((r.id, r.day, r.cost, tuple(r.row_ord))) for r in state.rows().collect())
        assert got == rebuilt(rows)
    again = state.merge(spark.createDataFrame(rows[:50], SCHEMA))  # a drop that comes twice changes nothing
    assert again and sorted(str((r.id, r.day, r.cost, tuple(r.row_ord))) for r in state.rows().collect()) == rebuilt(rows)
