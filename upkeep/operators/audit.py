"""Export audit log: validated append and paged listing with decoded payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values ------------------------------------------------------------
EVENT_TYPES = ("export.pdf.replacement", "export.pdf.orders", "export.pdf.requests", "export.pdf.overview")
STATUSES = ("ok", "fail")
MAX_PAGE = 1000
# -------------------------------------------------------------------------------


def validate_events(ev: DataFrame) -> DataFrame:
    """The same rows; a row with an unknown event type or status (null included)
    fails the job, so nothing is dropped without a sign."""
    def known(name, values):
        c = F.col(name)
        bad = F.raise_error(F.concat(F.lit(f"unknown {name}: "), F.coalesce(c, F.lit("null"))))
        return F.when(F.coalesce(c.isin(*values), F.lit(False)), c).otherwise(bad.cast("string"))
    return ev.withColumns({"event_type": known("event_type", EVENT_TYPES), "status": known("status", STATUSES)})


def append_events(ev: DataFrame, path: str) -> None:
    validate_events(ev).write.mode("append").parquet(path)


def list_events(ev: DataFrame, *, limit: int = 100, offset: int = 0, ts_col: str = "created_at",
                id_col: str = "id", payload_col: str = "filters_json",
                payload_schema: str = "map<string,string>") -> DataFrame:
    """Newest first, ``limit`` clamped to 1..1000 and ``offset`` >= 0; the JSON
    payload decoded, undecodable text -> empty map."""
    lim = max(1, min(MAX_PAGE, int(limit)))
    off = max(0, int(offset))
    decoded = F.coalesce(F.from_json(F.col(payload_col), payload_schema, {"mode": "PERMISSIVE"}),
                         F.create_map().cast(payload_schema))
    out = ev.withColumn("payload", decoded).orderBy(F.col(ts_col).desc(), F.col(id_col).desc())
    return out.offset(off).limit(lim)
