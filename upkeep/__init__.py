"""upkeep: asset-maintenance analytics as Spark DataFrame operators.

Layout
------
functions/  Column -> Column expressions (ids, text, money, dates, status rules)
sources/    readers: raw export grids with drifting headers, settings JSON,
            and the bindings of the benchmark tables onto maintenance tables
operators/  DataFrame -> DataFrame operators (rollups, windows, joins, matching)
plans/      composed reports (overview, replacement table, rosters, jobs)
streaming/  Structured Streaming ingest and feeds
"""

from upkeep.params import Params
from upkeep.session import build_session, checkpoint_dir

__all__ = ["Params", "build_session", "checkpoint_dir"]
