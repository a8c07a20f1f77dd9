"""Settings: JSON file -> Params (clamped, defaults for bad values) and the
per-month capacity table; URL-safe token codec for settings payloads."""

from __future__ import annotations

import base64
import dataclasses
import json
import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from upkeep.params import Params

# ---- fixed values: settings key -> (Params field, lowest, highest, whole number) ----
SETTINGS_FIELDS = {
    "staffCount": ("staff_count", 1, 500, True),
    "hoursPerDay": ("hours_per_day", 0.25, 24.0, False),
    "workDays": ("work_days", 1, 31, True),
    "baseAvailDays": ("base_avail_days", 1, 3660, True),
    "monthlyPartsBudget": ("monthly_parts_budget", 1, 10_000_000, True),
    "annualPartsBudget": ("annual_parts_budget", 1, 100_000_000, True),
}
MONTH_FIELDS = ("staffCount", "hoursPerDay", "workDays")
SETTINGS_SCHEMA_VERSION = 2
MAX_SCHEMA_VERSION = 10_000
# --------------------------------------------------------------------------------------


def bounded(key: str, value, default):
    """A settings value as a number inside its key's range (whole numbers cut towards
    zero); ``default`` for anything that is no finite number."""
    _, low, high, whole = SETTINGS_FIELDS[key]
    try:
        n = float(value)
    except (TypeError, ValueError):
        return default
    if not math.isfinite(n):
        return default
    n = sorted((low, n, high))[1]
    return int(n) if whole else n


def merge_settings(stored: dict | None, base: Params = Params()) -> dict:
    """Complete settings from a stored document: every number inside its range, blanks
    and bad values from ``base``, the per-month capacity map with its gaps filled from
    the merged globals, and a document of an older schema moved to the current one
    (its budgets return to the default, the monthly one as a twelfth of the annual)."""
    doc = stored if isinstance(stored, dict) else {}
    out = {key: bounded(key, doc.get(key), getattr(base, rule[0])) for key, rule in SETTINGS_FIELDS.items()}
    out["weekStartsOn"] = "monday" if str(doc.get("weekStartsOn", base.week_starts_on)).lower() == "monday" else "sunday"
    by_month = doc.get("staffCapacityByMonth")
    by_month = by_month if isinstance(by_month, dict) else {}
    out["staffCapacityByMonth"] = {
        str(month).strip(): {key: bounded(key, given.get(key), out[key]) for key in MONTH_FIELDS}
        for month, given in by_month.items() if str(month).strip() and isinstance(given, dict)}
    try:
        version = int(doc.get("settingsSchemaVersion", 1))
    except (TypeError, ValueError):
        version = 1
    if version < SETTINGS_SCHEMA_VERSION:
        out["annualPartsBudget"] = int(base.annual_parts_budget)
        out["monthlyPartsBudget"] = max(1, round(out["annualPartsBudget"] / 12))
    out["settingsSchemaVersion"] = min(max(version, SETTINGS_SCHEMA_VERSION), MAX_SCHEMA_VERSION)
    return out


def params_from_settings(settings: dict, base: Params = Params()) -> Params:
    """``merge_settings`` as Params (the month map goes to ``metrics.capacity_table``)."""
    merged = merge_settings(settings, base)
    fields = {rule[0]: merged[key] for key, rule in SETTINGS_FIELDS.items()}
    return dataclasses.replace(base, week_starts_on=merged["weekStartsOn"], **fields)


def read_settings(spark: SparkSession, path: str) -> dict:
    """Settings JSON through Spark's reader (one small document, collected once)."""
    df = spark.read.option("multiLine", True).json(path)
    row = df.first()
    return json.loads(json.dumps(row.asDict(recursive=True))) if row else {}


def encode_token(obj: dict) -> str:
    raw = json.dumps(obj, separators=(",", ":"), sort_keys=True).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def decode_token(token: str) -> dict | None:
    try:
        pad = "=" * (-len(token) % 4)
        out = json.loads(base64.urlsafe_b64decode(token + pad).decode())
        return out if isinstance(out, dict) else None
    except Exception:  # noqa: BLE001 - any malformed token decodes to None
        return None


def decode_token_col(c, schema: str = "map<string,string>") -> Column:
    """Column version: URL-safe base64 JSON object -> map; malformed -> null."""
    s = F.translate(F.col(c) if isinstance(c, str) else c, "-_", "+/")
    padded = F.rpad(s, (F.ceil(F.length(s) / 4) * 4).cast("int"), "=")
    txt = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.from_json(txt, schema, {"mode": "PERMISSIVE"})
