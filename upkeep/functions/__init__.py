"""Column -> Column building blocks. Every function here is a pure Spark
expression (no Python workers), so it stays inside whole-stage codegen."""

from upkeep.functions.text import *      # noqa: F401,F403
from upkeep.functions.money import *     # noqa: F401,F403
from upkeep.functions.dates import *     # noqa: F401,F403
from upkeep.functions.status import *    # noqa: F401,F403

from pyspark.sql import DataFrame as _DataFrame
from pyspark.sql import functions as _F


def attach_one_row(df: _DataFrame, one_row: _DataFrame) -> _DataFrame:
    """Put the columns of a one-row aggregate (a global total, a latest month,
    a fleet median) next to every row of ``df`` as a scalar subquery: Spark
    computes the aggregate once and inlines the value, so the plan has no join
    (and no cartesian or nested-loop product) at all."""
    cols = one_row.columns
    s = one_row.select(_F.struct(*cols).alias("_one")).scalar()
    return df.select("*", *[s[c].alias(c) for c in cols])
