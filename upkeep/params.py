"""Job parameters.

Fixed values that must equal the reference application's defaults so that
results agree (thresholds, rates, capacity defaults, chart order).
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

# ---- fixed values (reference defaults) -------------------------------------
REPLACE_RATIO = 0.80            # repair cost share of new price -> Replace
MONITOR_RATIO = 0.60            # repair cost share of new price -> Monitor
LIFE_REPLACE_RATIO = 1.0        # age / useful life -> Replace
LIFE_MONITOR_RATIO = 0.80       # age / useful life -> Monitor
SALVAGE_PCT = 0.05              # book value floor as share of cost
DEFAULT_USEFUL_LIFE_YEARS = 8
LABOR_RATE_PER_HOUR = 12.5
FOUND_HOURS = 0.5
DEFAULT_HOURS_WHEN_BLANK = 1.0
BASE_AVAIL_DAYS = 311
DEFAULT_STAFF_COUNT = 4
DEFAULT_HOURS_PER_STAFF_DAY = 4
DEFAULT_WORK_DAYS_PER_MONTH = 20
DEFAULT_ANNUAL_PARTS_BUDGET = 80_000
DEFAULT_MONTHLY_PARTS_BUDGET = 6_667   # round(80000 / 12)
DEFAULT_FILE_YEAR = 2026
PAGE_SIZE_DEFAULT = 20
BROADCAST_ROWS = 1_000_000           # most rows of a dimension table that a broadcast is hinted for
TOKEN_MATCH_MIN_SCORE = 0.5
HOLIDAY_RANGE = ("2000-01-01", "2035-12-31")
STATUS_RANK = {"Good": 0, "Monitor": 1, "Replace": 2}
REPAIR_COUNT_BIN_LABELS = ("1 repair", "2 repairs", "3 repairs", "4 repairs", "5+ repairs")
CHART_CLASS_ORDER = (
    "Vacuum", "Backpack Vacuum", "Battery-powered vacuum", "Floor Fan",
    "Chemical Dispenser", "Carpet Cleaning", "Carpet Cleaning Machine",
    "Upholstery Cleaner", "Upholstery machine", "Scrubber", "Burnisher",
    "Buffer", "Kaivac", "Swing Arm", "Ladder", "Chariot", "Agitator", "Other",
)
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Params:
    """Everything a report needs besides its input tables."""

    as_of: _dt.date = _dt.date(2002, 1, 1)          # "today" is never read from the clock
    replace_ratio: float = REPLACE_RATIO
    monitor_ratio: float = MONITOR_RATIO
    life_replace_ratio: float = LIFE_REPLACE_RATIO
    life_monitor_ratio: float = LIFE_MONITOR_RATIO
    salvage_pct: float = SALVAGE_PCT
    default_life_years: float = DEFAULT_USEFUL_LIFE_YEARS
    labor_rate: float = LABOR_RATE_PER_HOUR
    found_hours: float = FOUND_HOURS
    blank_hours: float = DEFAULT_HOURS_WHEN_BLANK
    base_avail_days: float = BASE_AVAIL_DAYS
    staff_count: float = DEFAULT_STAFF_COUNT
    hours_per_day: float = DEFAULT_HOURS_PER_STAFF_DAY
    work_days: float = DEFAULT_WORK_DAYS_PER_MONTH
    monthly_parts_budget: float = DEFAULT_MONTHLY_PARTS_BUDGET
    annual_parts_budget: float = DEFAULT_ANNUAL_PARTS_BUDGET
    default_file_year: int = DEFAULT_FILE_YEAR
    holiday_start: str = HOLIDAY_RANGE[0]
    holiday_end: str = HOLIDAY_RANGE[1]
    week_starts_on: str = "sunday"
    category_order: tuple = field(default=CHART_CLASS_ORDER)
