"""DuckDB SQL for each registered query (independent re-statement of the
contract, run by the correctness check on the same parquet tables)."""

from __future__ import annotations

from upkeep.plans import sqlexpr as X

ORACLE: dict[str, str] = {}

ORACLE["replacement_status"] = f"""
WITH {X.REPAIRS_CTE},
g AS (
  SELECT equip_id, arg_min(suppkey, row_ord) AS first_supp, sum(parts) AS parts,
         sum(labor) AS labor, count(*) AS n_rows
  FROM r WHERE equip_id IS NOT NULL GROUP BY equip_id)
SELECT g.equip_id, p_name AS equipment, p_type AS category,
       {X.normalize_building('loc.location')} AS building,
       round(parts, 2) AS parts_cost, round(labor, 2) AS labor_cost,
       round(labor + parts, 2) AS total_cost, p_retailprice AS new_price, n_rows,
       {X.replace_status('labor', 'parts', 'p_retailprice')} AS status
FROM g LEFT JOIN loc ON g.first_supp = loc.s_suppkey
       LEFT JOIN part ON part.p_partkey = g.equip_id
"""

_REP = f"WITH {X.REPAIRS_CTE}, rs AS (SELECT * FROM r WHERE month_key IS NOT NULL)"
_CHART_RANK = "(CASE category " + " ".join(
    f"WHEN {X.q(c)} THEN {i}" for i, c in enumerate(__import__('upkeep.params', fromlist=['x']).CHART_CLASS_ORDER)
) + " ELSE 18 END)"


def _svc_display_all(scope: str = "true") -> str:
    """Displayed service rows of all months; ``scope`` limits the rows shown, not the catalogue of completions."""
    nd, sd = X.norm_desc("s.description"), X.soft_norm_desc("s.description")
    return f"""
{X.SERVICE_CTE},
cat AS (SELECT * FROM s WHERE month_key IS NOT NULL),
done AS (SELECT * FROM cat WHERE completed_date IS NOT NULL),
keys AS (SELECT DISTINCT equip_id, k FROM (
           SELECT equip_id, {X.norm_desc('description')} AS k FROM done
           UNION ALL SELECT equip_id, {X.soft_norm_desc('description')} AS k FROM done)),
fd AS (SELECT equip_id, min(completed_date) AS first_done FROM done WHERE equip_id IS NOT NULL GROUP BY equip_id),
eff AS (
  SELECT s.equip_id, s.sched_date, s.completed_date, s.description, s.month_key, s.row_ord,
         CASE WHEN kh.k IS NOT NULL OR ks.k IS NOT NULL OR coalesce(fd.first_done > s.sched_date, false)
              THEN 'Completed' ELSE {X.raw_status('s.status')} END AS status
  FROM cat s
  LEFT JOIN keys kh ON kh.equip_id IS NOT DISTINCT FROM s.equip_id AND kh.k = {nd}
  LEFT JOIN keys ks ON ks.equip_id IS NOT DISTINCT FROM s.equip_id AND ks.k = {sd}
  LEFT JOIN fd ON fd.equip_id = s.equip_id),
latest AS (SELECT max(month_key) AS m FROM cat),
kept AS (SELECT eff.* FROM eff, latest WHERE NOT coalesce(completed_date IS NULL AND month_key < latest.m, false)
         AND {scope}),
{_collapse_cte('kept', soft=True)}"""


def _collapse_cte(src: str, soft: bool) -> str:
    key = X.soft_norm_desc("description") if soft else X.norm_desc("description")
    return f"""
g0 AS (SELECT *, {key} AS dk, coalesce(strftime(sched_date, '%Y-%m'), '') AS dm FROM {src}),
g1 AS (SELECT *, count(*) OVER w AS n, count(completed_date) OVER w AS nd,
              row_number() OVER (PARTITION BY equip_id, dk, dm ORDER BY
                 (completed_date IS NOT NULL) DESC, (lower(trim(status)) = 'completed') DESC,
                 coalesce(completed_date, DATE '0001-01-01') DESC, coalesce(sched_date, DATE '0001-01-01') DESC,
                 row_ord ASC) AS rn
       FROM g0 WINDOW w AS (PARTITION BY equip_id, dk, dm)),
disp AS (SELECT * FROM g1 WHERE NOT (nd > 0 AND nd < n) OR rn = 1)"""


_SVC_OUT = "SELECT equip_id, sched_date, completed_date, description, month_key, status FROM disp"

ORACLE["service_display_all"] = f"WITH {_svc_display_all()} {_SVC_OUT}"

ORACLE["service_display_month"] = f"""
WITH {X.SERVICE_CTE},
m AS (SELECT equip_id, sched_date, completed_date, description, month_key, row_ord,
             CASE WHEN completed_date IS NOT NULL AND completed_date >= DATE '1998-07-01' THEN 'Scheduled'
                  ELSE {X.raw_status('status')} END AS status
      FROM s WHERE month_key = '1998-06'),
{_collapse_cte('m', soft=False)}
{_SVC_OUT}"""

ORACLE["stale_collapse"] = f"""
WITH {X.SERVICE_CTE}, {_collapse_cte('s', soft=False)} {_SVC_OUT}"""

ORACLE["kpi_row"] = f"""
WITH {X.REPAIRS_CTE}, {_svc_display_all()}
SELECT (SELECT count(*) FROM events WHERE ts IS NOT NULL) AS total_requests,
       (SELECT count(*) FILTER (WHERE lower(status) = 'completed') FROM disp) AS completed,
       (SELECT count(*) FILTER (WHERE lower(status) = 'scheduled') FROM disp) AS scheduled,
       (SELECT count(*) FILTER (WHERE lower(status) IN ('completed', 'scheduled')) FROM disp) AS total_service,
       (SELECT round(sum(parts), 2) FROM r WHERE month_key IS NOT NULL) AS parts_cost,
       (SELECT round(sum(labor), 2) FROM r WHERE month_key IS NOT NULL) AS labor_cost,
       (SELECT round(sum(parts + labor), 2) FROM r WHERE month_key IS NOT NULL) AS repair_cost
"""

ORACLE["hours_by_category"] = f"""
{_REP}
SELECT category, round(sum(hours), 2) AS repair_hours, {_CHART_RANK} AS chart_rank FROM (
  SELECT CASE WHEN coalesce(trim(p_type), '') = '' THEN 'Other' ELSE p_type END AS category, hours
  FROM rs LEFT JOIN part ON p_partkey = rs.equip_id) GROUP BY category
"""

ORACLE["hours_by_building"] = f"""
{_REP},
b AS (SELECT CASE WHEN {X.normalize_building('loc.location')} = '' THEN 'Unknown'
                  ELSE {X.normalize_building('loc.location')} END AS building, hours
      FROM rs LEFT JOIN loc ON rs.suppkey = loc.s_suppkey)
SELECT building, {X.abbreviate_building('building')} AS building_code, round(sum(hours), 2) AS repair_hours
FROM b GROUP BY building
"""

ORACLE["repair_count_mix"] = f"""
{_REP}
SELECT {X.repair_count_bin('n')} AS bin, count(*) AS n_assets
FROM (SELECT equip_id, count(*) AS n FROM rs WHERE equip_id IS NOT NULL GROUP BY equip_id) GROUP BY 1
"""

ORACLE["request_volume_by_month"] = """
SELECT strftime(ts, '%Y-%m') AS month_key, count(*) AS n_requests FROM events WHERE ts IS NOT NULL GROUP BY 1
"""

ORACLE["request_calendar"] = """
WITH days AS (SELECT CAST(generate_series AS DATE) AS day_date
              FROM generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)),
c AS (SELECT CAST(ts AS DATE) AS day_date, count(*) AS n FROM events
      WHERE strftime(ts, '%Y-%m') = '2024-01' GROUP BY 1),
d AS (SELECT days.day_date, coalesce(c.n, 0) AS n_requests FROM days LEFT JOIN c USING (day_date)),
mx AS (SELECT greatest(max(n_requests), 1) AS mx FROM d),
fc AS (SELECT (isodow(DATE '2024-01-01') - 1 + 1) % 7 AS first_col)
SELECT day_date, day(day_date) AS day, n_requests,
       CASE WHEN n_requests = 0 THEN 0 WHEN n_requests / mx < 0.25 THEN 1 WHEN n_requests / mx < 0.5 THEN 2
            WHEN n_requests / mx < 0.75 THEN 3 ELSE 4 END AS intensity_bucket,
       CAST(floor((day(day_date) - 1 + first_col) / 7) AS INTEGER) AS week_row,
       CAST((day(day_date) - 1 + first_col) % 7 AS INTEGER) AS week_col
FROM d, mx, fc
"""

ORACLE["completion_rate"] = f"""
WITH {_svc_display_all()},
c AS (SELECT count(*) FILTER (WHERE lower(status) = 'completed') AS completed,
             count(*) FILTER (WHERE lower(status) = 'scheduled') AS scheduled FROM disp)
SELECT completed, scheduled,
       round(CASE WHEN completed + scheduled > 0 THEN completed / (completed + scheduled) * 100.0 ELSE 0.0 END, 6) AS rate_pct,
       CASE WHEN completed / (completed + scheduled) * 100.0 >= 80 THEN 'good'
            WHEN completed / (completed + scheduled) * 100.0 >= 50 THEN 'fair' ELSE 'poor' END AS band
FROM c
"""

ORACLE["avg_repair_hours"] = f"""
{_REP},
a AS (SELECT coalesce(sum(hours), 0) AS th, count(*) AS n FROM rs),
b AS (SELECT th, n, CASE WHEN n > 0 THEN th / n ELSE 0.0 END AS av FROM a)
SELECT round(th, 2) AS total_hours, n AS n_repairs, round(av, 6) AS avg_hours,
       CASE WHEN av < greatest(av * 2, 4.0) * 0.5 THEN 'low' WHEN av < greatest(av * 2, 4.0) * 0.75 THEN 'mid'
            ELSE 'high' END AS band
FROM b
"""

ORACLE["staff_capacity"] = f"""
WITH {X.REPAIRS_CTE}, {_svc_display_all()},
months AS (SELECT strftime(ts, '%Y-%m') AS m FROM events WHERE ts IS NOT NULL
           UNION SELECT month_key FROM disp WHERE month_key IS NOT NULL
           UNION SELECT month_key FROM r WHERE month_key IS NOT NULL),
v AS (SELECT greatest(count(*), 1) AS n_months FROM months),
u AS (SELECT coalesce(sum(hours), 0.0) AS used FROM r WHERE month_key IS NOT NULL),
c AS (SELECT n_months, used, 4.0 * 4.0 * CAST(20 * n_months AS DOUBLE) AS cap FROM v, u)
SELECT n_months, round(used, 2) AS used_hours, cap AS capacity_hours,
       round(greatest(cap - used, 0.0), 2) AS remaining_hours,
       round(CASE WHEN cap > 0 THEN used / cap * 100.0 ELSE 0.0 END, 6) AS util_pct
FROM c
"""

ORACLE["staff_capacity_by_month"] = f"""
{_REP},
ov(month_key, staff, hpd, wd) AS (VALUES ('1998-06', 6.0, 5.0, 21.0), ('1999-12', 2.0, 24.0, 31.0)),
u AS (SELECT month_key, sum(hours) AS used FROM rs GROUP BY month_key),
c AS (SELECT u.month_key, used, coalesce(staff, 4.0) * coalesce(hpd, 4.0) * coalesce(wd, 20.0) AS cap
      FROM u LEFT JOIN ov USING (month_key))
SELECT month_key, round(used, 2) AS used_hours, cap AS capacity_hours,
       round(greatest(cap - used, 0.0), 2) AS remaining_hours,
       round(CASE WHEN cap > 0 THEN used / cap * 100.0 ELSE 0.0 END, 6) AS util_pct
FROM c
"""

ORACLE["parts_budget"] = f"""
{_REP},
a AS (SELECT coalesce(sum(parts), 0.0) AS spent, count(DISTINCT substr(month_key, 1, 4)) AS n_years FROM rs),
b AS (SELECT spent, n_years, greatest(80000.0 * greatest(n_years, 1), 0.01) AS budget FROM a)
SELECT round(spent, 2) AS spent, n_years, budget,
       round(greatest(budget - greatest(spent, 0.0), 0.0), 2) AS available,
       round(least(greatest(budget - greatest(spent, 0.0), 0.0) / budget * 100.0, 100.0), 6) AS available_pct,
       greatest(spent, 0.0) > budget AS over_budget
FROM b
"""


def _done_sql() -> str:
    return f"""{_svc_display_all()}, {X.business_calendar_cte()},
dn AS (SELECT disp.*, p_type AS category,
              {X.business_days('disp.sched_date', 'disp.completed_date', 'ca', 'cb')} AS tbd
       FROM disp LEFT JOIN part ON p_partkey = disp.equip_id
       LEFT JOIN cal ca ON ca.cal_date = disp.sched_date
       LEFT JOIN cal cb ON cb.cal_date = disp.completed_date
       WHERE lower(trim(disp.status)) = 'completed' AND disp.sched_date IS NOT NULL
         AND disp.completed_date IS NOT NULL AND disp.completed_date >= disp.sched_date),
done_t AS (SELECT * FROM dn WHERE tbd IS NOT NULL)"""


ORACLE["turnaround_by_category"] = f"""
WITH {_done_sql()}
SELECT category, round(avg(tbd), 6) AS avg_turnaround_bd, {_CHART_RANK} AS chart_rank
FROM done_t GROUP BY category HAVING avg(tbd) > 0
"""

ORACLE["availability_by_category"] = f"""
WITH {_done_sql()},
down AS (SELECT equip_id, sum(tbd) AS dt FROM done_t WHERE equip_id IS NOT NULL GROUP BY equip_id),
mem AS (SELECT p_type AS category, p_partkey AS equip_id FROM part WHERE p_partkey IS NOT NULL AND p_type IS NOT NULL
        UNION SELECT category, equip_id FROM done_t WHERE equip_id IS NOT NULL AND category IS NOT NULL)
SELECT category, round(avg((311.0 - least(coalesce(dt, 0.0), 311.0)) / 311.0) * 100.0, 6) AS availability_pct,
       count(*) AS n_assets
FROM mem LEFT JOIN down USING (equip_id) GROUP BY category
"""

ORACLE["business_days"] = f"""
WITH {X.business_calendar_cte()},
j AS (SELECT {X.business_days('CAST(o_orderdate AS DATE)', 'CAST(l_shipdate AS DATE)', 'ca', 'cb')} AS bd
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      LEFT JOIN cal ca ON ca.cal_date = CAST(o_orderdate AS DATE)
      LEFT JOIN cal cb ON cb.cal_date = CAST(l_shipdate AS DATE))
SELECT bd AS business_days, count(*) AS n_rows FROM j GROUP BY bd
"""


def _dep_sql(src: str) -> str:
    """Depreciation CTEs over an asset source with (equip_id, price, equip_type)."""
    return f"""
meta AS (SELECT p_partkey AS equip_id, CASE WHEN p_size <= 40 THEN CAST(p_size AS DOUBLE) END AS dyears,
                p_type AS mtype, f.pd AS pdate
         FROM part LEFT JOIN (SELECT l_partkey, CAST(min(l_shipdate) AS DATE) AS pd FROM lineitem
                              WHERE l_returnflag = 'R' GROUP BY l_partkey) f ON f.l_partkey = p_partkey),
pb AS (SELECT l_partkey AS equip_id, year(min(l_shipdate)) AS pyear, p_type AS ptype
       FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A' GROUP BY l_partkey, p_type),
pba AS (SELECT *, greatest(0, (2002 - pyear) * 12 + (1 - 7)) AS age_m FROM pb),
bytype AS (SELECT ptype, median(age_m) AS mage, CAST(NULL AS DOUBLE) AS mlife FROM pba
           WHERE ptype IS NOT NULL AND ptype <> '' GROUP BY ptype),
fleet AS (SELECT median(age_m) AS fage, CAST(NULL AS DOUBLE) AS flife FROM pba),
d0 AS (
  SELECT a.*,
    CASE WHEN meta.pdate IS NOT NULL THEN CAST(greatest(0, (2002 - year(meta.pdate)) * 12 + (1 - month(meta.pdate))
              - CASE WHEN 1 < day(meta.pdate) THEN 1 ELSE 0 END) AS DOUBLE) END AS age_d,
    CASE WHEN pb.pyear IS NOT NULL THEN CAST(greatest(0, (2002 - pb.pyear) * 12 + (1 - 7)) AS DOUBLE) END AS age_y,
    CASE WHEN meta.dyears > 0 THEN meta.dyears * 12.0 END AS life_m,
    bt.ptype IS NOT NULL AS ty_hit, bt.mage AS ty_age, bt.mlife AS ty_life, fleet.fage, fleet.flife
  FROM {src} a
  LEFT JOIN meta ON meta.equip_id = a.equip_id
  LEFT JOIN pb ON pb.equip_id = a.equip_id
  LEFT JOIN bytype bt ON bt.ptype = coalesce(nullif(a.equip_type, ''), meta.mtype)
  CROSS JOIN fleet),
d1 AS (
  SELECT d0.*,
    coalesce(age_d, age_y, CASE WHEN ty_hit THEN ty_age END, fage) AS age_months,
    coalesce(life_m, CASE WHEN ty_hit THEN ty_life END, flife, 96.0) AS life0,
    CASE WHEN age_d IS NOT NULL THEN 'summary_date' WHEN age_y IS NOT NULL THEN 'purchase_year'
         WHEN ty_hit AND ty_age IS NOT NULL THEN 'purchase_type_median'
         WHEN fage IS NOT NULL THEN 'purchase_fleet_median' ELSE 'none' END AS age_source,
    CASE WHEN life_m IS NOT NULL THEN 'summary' WHEN ty_hit AND ty_life IS NOT NULL THEN 'purchase_type_median'
         WHEN flife IS NOT NULL THEN 'purchase_fleet_median' ELSE 'default' END AS life_source0
  FROM d0)"""


def _bv(cost: str, age: str, life: str) -> str:
    return f"greatest({cost} * 0.05, {cost} * (1.0 - least(1.0, greatest(0.0, {age} / {life}))))"


ORACLE["depreciation"] = f"""
WITH a AS (SELECT p_partkey AS equip_id, p_retailprice AS price, p_type AS equip_type FROM part),
{_dep_sql('a')}
SELECT equip_id, round(age_months, 4) AS age_months, round(life0, 4) AS useful_life_months,
       CASE WHEN age_months IS NOT NULL AND life0 > 0 AND coalesce(price, 0) > 0
                  THEN {_bv('price', 'age_months', 'life0')} END AS book_value,
       CASE WHEN age_months IS NOT NULL AND life0 > 0 AND coalesce(price, 0) > 0 THEN
            CASE WHEN age_source IN ('summary_date', 'purchase_year') AND life_source0 IN ('purchase_id', 'summary')
                 THEN 'Confirmed' ELSE 'Estimated' END ELSE '—' END AS basis,
       age_source, life_source0 AS life_source
FROM d1
"""

ORACLE["replacement_full"] = f"""
WITH {X.REPAIRS_CTE},
g AS (SELECT equip_id, arg_min(suppkey, row_ord) AS first_supp, sum(parts) AS parts, sum(labor) AS labor
      FROM r WHERE equip_id IS NOT NULL AND month_key IS NOT NULL GROUP BY equip_id),
a AS (SELECT g.*, p_name AS equipment, p_type AS category, p_type AS equip_type, p_retailprice AS price,
             {X.normalize_building('loc.location')} AS building
      FROM g LEFT JOIN part ON p_partkey = g.equip_id LEFT JOIN loc ON loc.s_suppkey = g.first_supp),
{_dep_sql('a')},
ov AS (SELECT p_partkey AS equip_id, least(CAST(p_size AS DOUBLE), 240.0) AS extra FROM part WHERE p_size > 45),
d2 AS (SELECT d1.*, coalesce(ov.extra, 0.0) AS life_adj_months,
              coalesce(ov.extra, 0.0) > 0 AS ext FROM d1 LEFT JOIN ov USING (equip_id)),
d3 AS (SELECT d2.*, CASE WHEN ext THEN life0 + life_adj_months ELSE life0 END AS life,
              age_months IS NOT NULL AND life0 > 0 AND coalesce(price, 0) > 0 AS ok0 FROM d2),
d4 AS (SELECT d3.*,
         CASE WHEN ext THEN (CASE WHEN age_months IS NOT NULL AND life > 0 AND coalesce(price, 0) > 0
                                  THEN {_bv('price', 'age_months', 'life')}
                                  WHEN ok0 THEN {_bv('price', 'age_months', 'life0')} END)
              WHEN ok0 THEN {_bv('price', 'age_months', 'life0')} END AS bv,
         CASE WHEN ext THEN 'Manual' WHEN ok0 THEN
              CASE WHEN age_source IN ('summary_date', 'purchase_year') AND life_source0 IN ('purchase_id', 'summary')
                   THEN 'Confirmed' ELSE 'Estimated' END ELSE '—' END AS basis,
         {X.replace_status('labor', 'parts', 'price')} AS repair_status,
         {X.life_status('age_months', 'life')} AS life_status
       FROM d3)
SELECT equip_id, equipment, category, building, round(parts, 2) AS parts_cost, round(labor, 2) AS labor_cost,
       round(labor + parts, 2) AS total_cost, price AS new_price, round(age_months, 4) AS age_months,
       round(life, 4) AS useful_life_months, life_adj_months, bv AS book_value, basis,
       repair_status, life_status, {X.combine_status('repair_status', 'life_status')} AS status
FROM d4
"""

ORACLE["order_roster"] = f"""
WITH {X.SERVICE_CTE}, {X.business_calendar_cte()}, {X.REPAIRS_CTE.split('loc AS')[0].rstrip().rstrip(',').replace('r AS (', 'r_unused AS (')},
loc AS (SELECT s_suppkey, n_name AS location FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT s.equip_id, sched_date, completed_date, description, month_key, row_ord, l.location,
             CASE WHEN completed_date IS NOT NULL AND completed_date >= DATE '1998-07-01' THEN 'Scheduled'
                  ELSE {X.raw_status('status')} END AS status
      FROM s LEFT JOIN loc l ON l.s_suppkey = s.suppkey WHERE month_key = '1998-06'),
{_collapse_cte('m', soft=False)},
o AS (SELECT coalesce(p_name, '') AS equipment, coalesce(CAST(disp.equip_id AS VARCHAR), '') AS equip_id,
             {X.abbreviate_building('disp.location')} AS building, coalesce(p_type, '') AS category,
             trim(coalesce(status, '')) AS status,
             coalesce(strftime(sched_date, '%Y-%m-%d'), '') AS start_scheduled,
             coalesce(strftime(completed_date, '%Y-%m-%d'), '') AS end_completed,
             CASE WHEN sched_date IS NOT NULL AND completed_date IS NOT NULL AND completed_date >= sched_date
                  AND {X.business_days('sched_date', 'completed_date', 'ca', 'cb')} IS NOT NULL
                  THEN CAST(CAST({X.business_days('sched_date', 'completed_date', 'ca', 'cb')} AS BIGINT) AS VARCHAR)
                  ELSE '' END AS business_days
      FROM disp LEFT JOIN part ON p_partkey = disp.equip_id
      LEFT JOIN cal ca ON ca.cal_date = sched_date LEFT JOIN cal cb ON cb.cal_date = completed_date)
SELECT * FROM o WHERE regexp_matches(lower(status), 'compl') AND contains(upper(replace(equip_id, ' ', '')), '1')
"""

ORACLE["request_roster"] = """
SELECT CAST(event_id AS VARCHAR) AS work_order, coalesce(strftime(CAST(ts AS DATE), '%Y-%m-%d'), '') AS request_date,
       coalesce(CAST(user_id AS VARCHAR), '') AS requestor, coalesce(event_type, '') AS request, '' AS assigned_to
FROM events WHERE day(ts) = 15 AND regexp_matches(lower(event_type), 'view|click')
"""

ORACLE["dedupe_latest"] = """
SELECT equip_id, ship_date, l_orderkey, l_linenumber, l_suppkey FROM (
  SELECT l_partkey AS equip_id, CAST(l_shipdate AS DATE) AS ship_date, l_orderkey, l_linenumber, l_suppkey,
         row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(l_shipdate AS DATE) DESC NULLS LAST,
                            l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rn
  FROM lineitem) WHERE rn = 1
"""

ORACLE["forward_fill_context"] = """
SELECT conv_id, turn, role,
       last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS ctx_turn,
       last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER w AS ctx_text_len
FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""


def _order_texts_sql() -> str:
    return """
t AS (SELECT o_orderkey, o_orderstatus, o_orderdate, o_totalprice, o_orderpriority,
             'Location: ' || o_orderpriority || ' Room ' || CAST(day(o_orderdate) AS VARCHAR) AS location_text
      FROM orders)"""


_MONTHS = "['january','february','march','april','may','june','july','august','september','october','november','december']"

ORACLE["text_functions"] = f"""
WITH {_order_texts_sql()}
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS label,
       CASE WHEN o_orderstatus = 'P' OR o_totalprice <= 0 THEN NULL ELSE o_totalprice END AS amount,
       CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS amount_or_zero,
       year(o_orderdate) AS purchase_year,
       {X.normalize_building('location_text')} AS building,
       {X.abbreviate_building('location_text')} AS building_code,
       CASE WHEN year(o_orderdate) BETWEEN 2000 AND 2099 THEN strftime(o_orderdate, '%Y-%m')
            ELSE '2026-' || strftime(o_orderdate, '%m') END AS file_month,
       CASE WHEN o_orderstatus = 'F' THEN (CASE WHEN o_orderpriority LIKE '1%' THEN 0.5 ELSE 1.0 END)
            WHEN o_orderstatus = 'O' THEN day(o_orderdate) / month(o_orderdate)
            ELSE CAST(day(o_orderdate) AS DOUBLE) + 0.5 END AS hours,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed_date
FROM t
"""

ORACLE["strip_tags"] = f"""
SELECT page_id, length({X.strip_ws("regexp_replace(html, '<[^>]+>', '', 'g')")}) AS text_len FROM pages
"""

ORACLE["dq_bad_dates"] = """
SELECT o_orderpriority AS source_file, count(*) FILTER (WHERE o_orderstatus = 'P') AS bad_dates, count(*) AS n_rows
FROM orders GROUP BY o_orderpriority
"""

ORACLE["union_by_name"] = """
WITH u AS (
  SELECT l_orderkey, l_quantity, l_tax, l_shipdate FROM lineitem WHERE year(l_shipdate) <= 1997
  UNION ALL BY NAME
  SELECT l_shipdate, l_orderkey, l_quantity, l_returnflag AS note FROM lineitem WHERE year(l_shipdate) > 1997)
SELECT year(l_shipdate) AS ship_year, count(*) AS n_rows, count(*) FILTER (WHERE l_tax IS NULL) AS tax_missing,
       count(*) FILTER (WHERE note IS NULL) AS note_missing, sum(l_quantity) AS qty
FROM u GROUP BY 1
"""

ORACLE["row_scope"] = f"""
WITH {X.REPAIRS_CTE}
SELECT loc.location AS building, round(sum(hours), 2) AS repair_hours, count(*) AS n_rows
FROM r LEFT JOIN loc ON loc.s_suppkey = r.suppkey
WHERE loc.location IN (SELECT n_name FROM nation WHERE n_regionkey = 1)
GROUP BY loc.location
"""

ORACLE["override_merge"] = """
WITH base AS (SELECT p_partkey AS equip_id, least(CAST(p_size AS DOUBLE), 240.0) AS m FROM part WHERE p_size > 45),
ch AS (SELECT p_partkey AS equip_id, CAST(p_size - 44 AS DOUBLE) AS m FROM part WHERE p_size BETWEEN 40 AND 48),
u AS (SELECT coalesce(ch.equip_id, base.equip_id) AS equip_id, CASE WHEN ch.equip_id IS NOT NULL THEN ch.m ELSE base.m END AS m
      FROM base FULL OUTER JOIN ch ON base.equip_id = ch.equip_id)
SELECT equip_id, round(least(m, 240.0), 2) AS extra_months FROM u WHERE m > 0
"""

ORACLE["audit_listing"] = """
SELECT event_id, ts, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50
"""

_KW = f"{X.equipment_names_cte()}, {X.keyword_ctes('en', 'equip_name')}"

ORACLE["keyword_extract"] = f"""
WITH {_KW}
SELECT en.equip_id, en.equip_name, kw.keyword, kw.label, kw.equip_type
FROM en LEFT JOIN kw ON kw.name = en.equip_name
"""

_PURCHASE = f"""{_KW},
pb AS (SELECT l_partkey AS equip_id, year(min(l_shipdate)) AS year FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
pr AS (SELECT kw.keyword, pb.year, en.cost FROM en LEFT JOIN kw ON kw.name = en.equip_name
       LEFT JOIN pb ON pb.equip_id = en.equip_id WHERE kw.keyword IS NOT NULL AND en.cost > 0),
pr2 AS (SELECT *, year IS NOT NULL AND 2002 - year <= 5 AS recent,
               max(CASE WHEN year IS NOT NULL AND 2002 - year <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY keyword) AS has
        FROM pr),
pm AS (SELECT keyword, median(cost) AS purchase_price, count(*) AS n_records FROM pr2
       WHERE has = 0 OR recent GROUP BY keyword)"""

ORACLE["median_price_by_keyword"] = f"""
WITH {_PURCHASE}
SELECT keyword, purchase_price AS median_price, n_records FROM pm
"""

ORACLE["valuation_sheet"] = f"""
WITH {_PURCHASE},
sp AS (SELECT kw.keyword, round(l_extendedprice / l_quantity, 2) AS price FROM lineitem
       JOIN en ON en.equip_id = l_partkey LEFT JOIN kw ON kw.name = en.equip_name
       WHERE l_returnflag = 'N' AND kw.keyword IS NOT NULL AND round(l_extendedprice / l_quantity, 2) > 0),
sm AS (SELECT keyword, median(price) AS service_price FROM sp GROUP BY keyword),
j AS (SELECT coalesce(pm.keyword, sm.keyword) AS keyword, coalesce(purchase_price, service_price) AS price,
             CASE WHEN purchase_price IS NOT NULL THEN 'purchase' ELSE 'service' END AS price_source
      FROM pm FULL OUTER JOIN sm ON pm.keyword = sm.keyword),
lab AS (SELECT DISTINCT keyword, label FROM kw WHERE keyword IS NOT NULL)
SELECT j.keyword, price, price_source, lab.label FROM j LEFT JOIN lab USING (keyword)
"""

ORACLE["nearest_year_price"] = """
WITH cat AS (SELECT p_name AS model, year(l_shipdate) AS year, max(l_extendedprice / l_quantity) AS price
             FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2),
t AS (SELECT pb.equip_id, p_name AS model, pb.year AS target_year FROM
        (SELECT l_partkey AS equip_id, year(min(l_shipdate)) AS year FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) pb
        JOIN part ON p_partkey = pb.equip_id),
c AS (SELECT t.*, cat.year AS catalog_year, cat.price,
             row_number() OVER (PARTITION BY t.equip_id, t.model, t.target_year
                                ORDER BY abs(cat.year - t.target_year), cat.year) AS rn
      FROM t LEFT JOIN cat ON cat.model = t.model)
SELECT equip_id, model, target_year, catalog_year, price FROM c WHERE rn = 1
"""

_DOC_GRID = """
lines AS (SELECT doc_id AS file, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS row_no,
                 unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
grid AS (SELECT file, row_no, string_split(line, ' ') AS cells FROM lines),
hit AS (SELECT file, min(row_no) AS h FROM grid
        WHERE row_no < 10 AND lower(regexp_replace(cells[1], '^\\s+|\\s+$', '', 'g')) = 'the' GROUP BY file),
hdr AS (SELECT d.file, coalesce(hit.h, 1) AS header_row FROM (SELECT DISTINCT file FROM grid) d
        LEFT JOIN hit USING (file))"""

ORACLE["header_detect"] = f"WITH {_DOC_GRID} SELECT file AS doc_id, header_row FROM hdr"

ORACLE["unique_headers"] = f"""
WITH {_DOC_GRID},
hn AS (SELECT grid.file, generate_subscripts(cells, 1) - 1 AS pos, unnest(cells) AS raw
       FROM grid JOIN hdr ON grid.file = hdr.file AND grid.row_no = hdr.header_row),
b AS (SELECT file, pos, coalesce(nullif(regexp_replace(replace(raw, chr(10), ' '), '^\\s+|\\s+$', '', 'g'), ''),
                                 '_unnamed_' || CAST(pos AS VARCHAR)) AS base FROM hn),
k AS (SELECT *, row_number() OVER (PARTITION BY file, base ORDER BY pos) - 1 AS kth FROM b)
SELECT file AS doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN kth = 0 THEN base ELSE base || '__' || CAST(kth AS VARCHAR) END AS name
FROM k
"""

ORACLE["stream_daily_volume"] = """
SELECT date_trunc('day', ts) AS day_start, count(*) AS n_requests FROM events WHERE ts IS NOT NULL GROUP BY 1
"""

ORACLE["stream_dedup_feed"] = """
SELECT event_type, count(DISTINCT event_id) AS n_events, count(DISTINCT event_id) AS n_ids FROM events GROUP BY 1
"""

ORACLE["catalog_match"] = f"""
WITH {X.equipment_names_cte()}, {X.catalog_ctes()}, {X.catalog_match_ctes('en', 'equip_name')}
SELECT name AS equip_name, model, match_tier FROM cmatch
"""

ORACLE["catalog_price"] = f"""
WITH {X.equipment_names_cte()}, {X.catalog_ctes()}, {X.catalog_match_ctes('en', 'equip_name')},
pb AS (SELECT l_partkey AS equip_id, year(min(l_shipdate)) AS year FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
t AS (SELECT en.equip_id, cmatch.model, pb.year AS target_year FROM en JOIN cmatch ON cmatch.name = en.equip_name
      JOIN pb ON pb.equip_id = en.equip_id WHERE cmatch.model IS NOT NULL),
c AS (SELECT t.*, cp.year AS catalog_year, cp.price,
             row_number() OVER (PARTITION BY t.equip_id ORDER BY abs(cp.year - t.target_year), cp.year) AS rn
      FROM t LEFT JOIN cp ON cp.model = t.model)
SELECT equip_id, model, target_year, catalog_year, price FROM c WHERE rn = 1
"""

ORACLE["scored_price_lookup"] = f"""
WITH {_KW},
sm AS (SELECT kw.keyword, median(en.cost) AS price FROM en JOIN part ON p_partkey = en.equip_id
       LEFT JOIN kw ON kw.name = en.equip_name WHERE p_size <= 25 AND kw.keyword IS NOT NULL AND en.cost > 0
       GROUP BY kw.keyword),
lab AS (SELECT DISTINCT keyword, label FROM kw WHERE keyword IS NOT NULL),
sheet AS (SELECT sm.keyword, sm.price, lower(lab.label) AS l FROM sm JOIN lab USING (keyword)),
parts AS (SELECT keyword, string_split(keyword, '|')[1] AS cat,
                 list_filter(string_split(keyword, '|')[2:], lambda p: regexp_full_match(p, '\\d+') OR suffix(p, 'ft'))[-1] AS size,
                 list_filter(string_split(keyword, '|')[2:], lambda p: NOT (regexp_full_match(p, '\\d+') OR suffix(p, 'ft')))[-1] AS brand
          FROM (SELECT DISTINCT keyword FROM kw WHERE keyword IS NOT NULL
                UNION SELECT keyword FROM sheet)),
k AS (SELECT DISTINCT kw.keyword, p.cat, p.brand, p.size FROM en JOIN kw ON kw.name = en.equip_name
      JOIN parts p ON p.keyword = kw.keyword WHERE kw.keyword IS NOT NULL),
s AS (SELECT sheet.*, p.cat, p.brand, p.size FROM sheet JOIN parts p USING (keyword)),
br AS (SELECT k.keyword, s.price, row_number() OVER (PARTITION BY k.keyword ORDER BY
              -((CASE WHEN s.cat = k.cat THEN 4 ELSE 0 END) + (CASE WHEN k.size IS NOT NULL AND s.size = k.size THEN 2 ELSE 0 END)),
              s.l, s.keyword) AS rn
       FROM k JOIN s ON s.brand = k.brand
       WHERE k.brand IS NOT NULL AND NOT (k.size IS NOT NULL AND s.size IS NOT NULL AND k.size <> s.size)),
ub AS (SELECT k.keyword, s.price, row_number() OVER (PARTITION BY k.keyword ORDER BY s.l, s.keyword) AS rn
       FROM k JOIN s ON s.cat = k.cat AND s.brand IS NULL
       WHERE k.brand IS NULL AND (k.size IS NULL OR s.size = k.size))
SELECT k.keyword,
       CASE WHEN ex.price IS NOT NULL THEN ex.price WHEN k.brand IS NOT NULL THEN br.price ELSE ub.price END AS price,
       CASE WHEN ex.price IS NOT NULL THEN 'exact'
            WHEN (CASE WHEN k.brand IS NOT NULL THEN br.price ELSE ub.price END) IS NOT NULL
            THEN CASE WHEN k.brand IS NOT NULL THEN 'brand' ELSE 'category' END END AS match
FROM k LEFT JOIN sheet ex ON ex.keyword = k.keyword
LEFT JOIN (SELECT * FROM br WHERE rn = 1) br ON br.keyword = k.keyword
LEFT JOIN (SELECT * FROM ub WHERE rn = 1) ub ON ub.keyword = k.keyword
"""

ORACLE["price_cascade"] = f"""
WITH {_PURCHASE},
ids AS (SELECT DISTINCT l_partkey AS equip_id FROM lineitem WHERE l_partkey IS NOT NULL),
p1 AS (SELECT p_partkey AS equip_id, p_retailprice AS price FROM part WHERE p_size <= 10),
cat AS (SELECT p_name AS model, year(l_shipdate) AS year, max(l_extendedprice / l_quantity) AS price
        FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2),
t AS (SELECT pb.equip_id, p_name AS model, pb.year AS target_year FROM pb JOIN part ON p_partkey = pb.equip_id),
c AS (SELECT t.equip_id, cat.price, row_number() OVER (PARTITION BY t.equip_id
                         ORDER BY abs(cat.year - t.target_year), cat.year) AS rn
      FROM t LEFT JOIN cat ON cat.model = t.model),
p2 AS (SELECT equip_id, price FROM c WHERE rn = 1),
p3 AS ({ORACLE["scored_price_lookup"]}),
p4 AS (SELECT l_partkey AS equip_id,
              arg_min(l_extendedprice / l_quantity, {{'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_suppkey, 'e': l_extendedprice}}) AS price
       FROM lineitem WHERE l_returnflag = 'N' AND l_extendedprice / l_quantity > 0 GROUP BY 1),
a AS (SELECT ids.equip_id, kw.keyword FROM ids LEFT JOIN en ON en.equip_id = ids.equip_id
      LEFT JOIN kw ON kw.name = en.equip_name),
j AS (SELECT a.equip_id,
             CASE WHEN p1.price > 0 THEN p1.price END AS v1, CASE WHEN p2.price > 0 THEN p2.price END AS v2,
             CASE WHEN p3.price > 0 THEN p3.price END AS v3, CASE WHEN p4.price > 0 THEN p4.price END AS v4
      FROM a LEFT JOIN p1 ON p1.equip_id = a.equip_id LEFT JOIN p2 ON p2.equip_id = a.equip_id
      LEFT JOIN p3 ON p3.keyword = a.keyword LEFT JOIN p4 ON p4.equip_id = a.equip_id)
SELECT equip_id, coalesce(v1, v2, v3, v4, 0.0) AS new_price,
       CASE WHEN v1 IS NOT NULL THEN 'purchase' WHEN v2 IS NOT NULL THEN 'custodial'
            WHEN v3 IS NOT NULL THEN 'valuation' WHEN v4 IS NOT NULL THEN 'service' ELSE '' END AS price_source
FROM j
"""

ORACLE["category_resolve"] = f"""
WITH {_KW},
tm AS (SELECT p_partkey AS equip_id, nullif(trim(p_type), '') AS t FROM part WHERE p_size <= 20),
sm AS (SELECT p_partkey AS equip_id, CASE WHEN p_size > 40 THEN 'Other'
                                          ELSE upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) END AS s FROM part)
SELECT en.equip_id,
       coalesce(tm.t, CASE WHEN sm.s <> 'Other' THEN sm.s END, nullif(trim(kw.equip_type), ''), 'Other') AS category,
       coalesce(CASE WHEN sm.s <> 'Other' THEN sm.s END, tm.t, nullif(trim(kw.equip_type), ''), 'Other') AS row_category
FROM en LEFT JOIN tm ON tm.equip_id = en.equip_id LEFT JOIN sm ON sm.equip_id = en.equip_id
LEFT JOIN kw ON kw.name = en.equip_name
"""

ORACLE["repairs_ingest"] = """
WITH r AS (SELECT strftime(l_shipdate, '%Y-%m') AS month_key, l_partkey, l_quantity / 10.0::DOUBLE AS h,
                  l_extendedprice * l_discount / 1000.0::DOUBLE AS p,
                  round_even(l_quantity / 10.0::DOUBLE * 12.5::DOUBLE, 2) AS l FROM lineitem WHERE l_shipdate IS NOT NULL)
SELECT month_key, count(*) AS n_rows, count(DISTINCT l_partkey) AS n_ids, round(sum(h), 2) AS hours,
       round(sum(p), 2) AS parts, round(sum(l), 2) AS labor, round(sum(p + l), 2) AS total
FROM r GROUP BY month_key
"""

ORACLE["repairs_clean"] = """
WITH r AS (SELECT CASE WHEN year(l_shipdate) >= 2000 THEN strftime(l_shipdate, '%Y-%m')
                       ELSE '2026-' || strftime(l_shipdate, '%m') END AS month_key,
                  CASE WHEN l_returnflag = 'N' THEN l_quantity / 10.0::DOUBLE WHEN l_returnflag = 'A' THEN 0.5
                       ELSE 1.0 END AS h,
                  l_extendedprice * l_discount / 1000.0::DOUBLE AS p, s_name,
                  row_number() OVER (PARTITION BY year(l_shipdate), month(l_shipdate)) AS no
           FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE l_shipdate IS NOT NULL)
SELECT month_key, count(*) AS n_rows, max(no) AS last_no, CAST(sum(no) AS BIGINT) AS no_sum, count(*) AS n_numbers, round(sum(h), 2) AS hours, round(sum(p), 2) AS parts,
       round(sum(round_even(h * 12.5::DOUBLE, 2)), 2) AS labor,
       count(*) FILTER (WHERE coalesce(s_name, '') = '') AS no_vendor
FROM r GROUP BY month_key
"""

ORACLE["requests_clean"] = """
SELECT event_type || ' requests.csv' AS file, count(*) AS n_rows,
       strftime(arg_min(ts, event_id), '%Y-%m') AS file_month, count(DISTINCT user_id) AS n_requestors, false AS rejected
FROM events WHERE event_type <> 'error' AND ts IS NOT NULL GROUP BY event_type
UNION ALL
SELECT DISTINCT event_type || ' requests.csv', 0, NULL, 0, true FROM events WHERE event_type = 'error'
"""

ORACLE["requests_load"] = """
SELECT event_type || ' requests.csv' AS file, strftime(ts, '%Y-%m') AS month_key, count(*) AS n_rows
FROM events WHERE event_type <> 'error' GROUP BY 1, 2
"""

ORACLE["equipment_clean"] = f"""
WITH {_KW},
meta AS (SELECT l_partkey, CAST(min(l_shipdate) AS DATE) AS pd FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
j AS (SELECT part.*, en.equip_name, meta.pd, kw.equip_type AS inferred FROM part JOIN en ON en.equip_id = p_partkey
      LEFT JOIN meta ON meta.l_partkey = p_partkey LEFT JOIN kw ON kw.name = en.equip_name),
w AS (SELECT *, pd IS NOT NULL AND p_size <> 1 AS brand_wins FROM j)
SELECT CAST(p_partkey AS VARCHAR) AS EquipmentId, equip_name AS Name,
       CASE WHEN brand_wins THEN 'Hall ' || p_brand END AS Location,
       CASE WHEN NOT brand_wins THEN p_type WHEN p_size <= 40 THEN p_type
            WHEN p_size <= 20 THEN p_type
            WHEN coalesce(inferred, 'Other') <> 'Other' THEN inferred END AS EquipType,
       p_brand AS Manufacturer, 'SN' || CAST(p_partkey AS VARCHAR) AS SerialNumber,
       CASE WHEN brand_wins THEN pd ELSE pd - 365 END AS PurchaseDate,
       CAST(p_size AS VARCHAR) AS DepreciationYears,
       CASE WHEN NOT brand_wins THEN round(p_retailprice * 0.9, 2)
            WHEN p_size BETWEEN 41 AND 45 THEN round(p_retailprice * 0.8, 2) ELSE p_retailprice END AS Cost,
       date_diff('day', CASE WHEN brand_wins THEN pd ELSE pd - 365 END, DATE '2002-01-01') / 365.0 AS Age
FROM w
"""

ORACLE["service_clean"] = """
WITH j AS (SELECT o_orderdate, l_shipdate, l_linestatus, o_orderpriority, l_extendedprice / l_quantity AS unit,
                  p_retailprice, s_suppkey IS NOT NULL AND n_name IS NOT NULL AS has_loc,
                  l_linestatus = 'F' AND l_shipdate >= o_orderdate AS done, year(o_orderdate) <= 1999 AS old
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey
           LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey)
SELECT strftime(o_orderdate, '%Y-%m') AS month_key,
       CASE WHEN old THEN (CASE WHEN l_linestatus = 'F' THEN 'Completed' ELSE 'Scheduled' END)
            ELSE (CASE WHEN done THEN 'Completed' ELSE 'Scheduled' END) END AS status,
       count(*) AS n_rows,
       round(sum(CASE WHEN old THEN (CASE WHEN unit > 0 THEN unit END)
                      ELSE (CASE WHEN p_retailprice > 0 THEN p_retailprice END) END), 2) AS estimated_price,
       count(DISTINCT o_orderpriority) AS n_descriptions,
       count(*) FILTER (WHERE NOT has_loc) AS no_location
FROM j GROUP BY 1, 2
"""

ORACLE["month_options"] = """
SELECT strftime(ts, '%Y-%m') AS month_key FROM events WHERE ts IS NOT NULL
UNION SELECT strftime(o_orderdate, '%Y-%m') FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate IS NOT NULL
UNION SELECT strftime(l_shipdate, '%Y-%m') FROM lineitem WHERE l_shipdate IS NOT NULL
"""

ORACLE["building_options"] = f"""
WITH b AS (SELECT DISTINCT {X.normalize_building('n_name')} AS building
           FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
SELECT building, {X.abbreviate_building('building')} AS building_code FROM b WHERE building <> ''
"""

ORACLE["footer_counts"] = """
SELECT (SELECT count(*) FROM lineitem WHERE l_shipdate IS NOT NULL) AS repair_records,
       (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_shipdate IS NOT NULL) AS assets,
       (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS service_orders,
       (SELECT max(strftime(o_orderdate, '%Y-%m')) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS latest_month
"""

ORACLE["unclassified_count"] = f"""
WITH {_KW}
SELECT count(*) FILTER (WHERE kw.keyword IS NULL) AS unclassified, count(DISTINCT kw.keyword) AS keywords
FROM en LEFT JOIN kw ON kw.name = en.equip_name WHERE en.cost > 0
"""

ORACLE["override_context"] = f"""
WITH {X.REPAIRS_CTE},
g AS (SELECT equip_id, sum(parts) AS parts, sum(labor) AS labor FROM r
      WHERE equip_id IS NOT NULL AND month_key IS NOT NULL GROUP BY equip_id),
a AS (SELECT g.*, p_type AS equip_type, p_retailprice AS price FROM g LEFT JOIN part ON p_partkey = g.equip_id),
{_dep_sql('a')},
ov AS (SELECT p_partkey AS equip_id, least(CAST(p_size AS DOUBLE), 240.0) AS extra FROM part WHERE p_size > 45),
d2 AS (SELECT d1.*, coalesce(ov.extra, 0.0) AS extra_months,
              CASE WHEN coalesce(ov.extra, 0.0) > 0 THEN life0 + ov.extra ELSE life0 END AS elife
       FROM d1 LEFT JOIN ov USING (equip_id)),
d3 AS (SELECT d2.*, {X.replace_status('labor', 'parts', 'price')} AS repair_status,
              {X.life_status('age_months', 'life0')} AS base_life_status,
              {X.life_status('age_months', 'elife')} AS effective_life_status FROM d2)
SELECT equip_id, age_months, life0 AS base_life_months, elife AS effective_life_months, extra_months,
       repair_status, base_life_status, effective_life_status,
       {X.combine_status('repair_status', 'base_life_status')} AS base_status,
       {X.combine_status('repair_status', 'effective_life_status')} AS effective_status
FROM d3
"""

ORACLE["alias_pick"] = f"""
WITH {_DOC_GRID},
hn AS (SELECT grid.file, generate_subscripts(cells, 1) AS pos, unnest(cells) AS raw
       FROM grid JOIN hdr ON grid.file = hdr.file AND grid.row_no = hdr.header_row),
b AS (SELECT file, pos, coalesce(nullif(regexp_replace(replace(raw, chr(10), ' '), '^\\s+|\\s+$', '', 'g'), ''),
                                 '_unnamed_' || CAST(pos - 1 AS VARCHAR)) AS base FROM hn),
u AS (SELECT file, pos, CASE WHEN row_number() OVER (PARTITION BY file, base ORDER BY pos) = 1 THEN base
                             ELSE base || '__' || CAST(row_number() OVER (PARTITION BY file, base ORDER BY pos) - 1 AS VARCHAR) END AS name
      FROM b),
k AS (SELECT file, pos, translate(lower(name), ' _#', '') AS key FROM u),
pick AS (SELECT file, coalesce(max(pos) FILTER (WHERE key = 'the'), max(pos) FILTER (WHERE key = 'a'),
                               max(pos) FILTER (WHERE key = 'le')) AS p FROM k GROUP BY file),
d AS (SELECT grid.file, CASE WHEN pick.p IS NOT NULL AND pick.p <= len(grid.cells) THEN grid.cells[pick.p] END AS v
      FROM grid JOIN hdr ON grid.file = hdr.file AND grid.row_no > hdr.header_row
      JOIN pick ON pick.file = grid.file)
SELECT file AS doc_id, count(*) AS n_rows, count(v) AS n_values, sum(length(v)) AS value_chars FROM d GROUP BY file
"""

ORACLE["enriched_repairs"] = f"""
WITH {_PURCHASE}, {X.catalog_ctes()}, {X.catalog_match_ctes('en', 'equip_name')},
sp AS (SELECT kw.keyword, round(l_extendedprice / l_quantity, 2) AS price FROM lineitem
       JOIN en ON en.equip_id = l_partkey LEFT JOIN kw ON kw.name = en.equip_name
       WHERE l_returnflag = 'N' AND kw.keyword IS NOT NULL AND round(l_extendedprice / l_quantity, 2) > 0),
sm AS (SELECT keyword, median(price) AS service_price FROM sp GROUP BY keyword),
p3 AS (SELECT coalesce(pm.keyword, sm.keyword) AS keyword, coalesce(purchase_price, service_price) AS price
       FROM pm FULL OUTER JOIN sm ON pm.keyword = sm.keyword),
t AS (SELECT en.equip_id, cmatch.model, pb.year AS target_year FROM en JOIN cmatch ON cmatch.name = en.equip_name
      JOIN pb ON pb.equip_id = en.equip_id WHERE cmatch.model IS NOT NULL),
c AS (SELECT t.equip_id, cp.price, row_number() OVER (PARTITION BY t.equip_id
                     ORDER BY abs(cp.year - t.target_year), cp.year) AS rn FROM t LEFT JOIN cp ON cp.model = t.model),
p2 AS (SELECT equip_id, price FROM c WHERE rn = 1),
p1 AS (SELECT p_partkey AS equip_id, p_retailprice AS price FROM part WHERE p_size <= 10),
p4 AS (SELECT l_partkey AS equip_id,
              arg_min(l_extendedprice / l_quantity, {{'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_suppkey, 'e': l_extendedprice}}) AS price
       FROM lineitem WHERE l_returnflag = 'N' AND l_extendedprice / l_quantity > 0 GROUP BY 1),
tm AS (SELECT p_partkey AS equip_id, nullif(trim(p_type), '') AS tt FROM part WHERE p_size <= 20),
sm2 AS (SELECT p_partkey AS equip_id, CASE WHEN p_size > 40 THEN 'Other'
                                            ELSE upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) END AS ss FROM part),
ids AS (SELECT DISTINCT l_partkey AS equip_id FROM lineitem WHERE l_shipdate IS NOT NULL),
a AS (SELECT ids.equip_id,
             coalesce(tm.tt, CASE WHEN sm2.ss <> 'Other' THEN sm2.ss END, nullif(trim(kw.equip_type), ''), 'Other') AS category,
             CASE WHEN p1.price > 0 THEN p1.price END AS v1, CASE WHEN p2.price > 0 THEN p2.price END AS v2,
             CASE WHEN p3.price > 0 THEN p3.price END AS v3, CASE WHEN p4.price > 0 THEN p4.price END AS v4
      FROM ids LEFT JOIN en ON en.equip_id = ids.equip_id LEFT JOIN kw ON kw.name = en.equip_name
      LEFT JOIN tm ON tm.equip_id = ids.equip_id LEFT JOIN sm2 ON sm2.equip_id = ids.equip_id
      LEFT JOIN p1 ON p1.equip_id = ids.equip_id LEFT JOIN p2 ON p2.equip_id = ids.equip_id
      LEFT JOIN p3 ON p3.keyword = kw.keyword LEFT JOIN p4 ON p4.equip_id = ids.equip_id),
b AS (SELECT equip_id, category, coalesce(v1, v2, v3, v4, 0.0) AS new_price,
             CASE WHEN v1 IS NOT NULL THEN 'purchase' WHEN v2 IS NOT NULL THEN 'custodial'
                  WHEN v3 IS NOT NULL THEN 'valuation' WHEN v4 IS NOT NULL THEN 'service' ELSE '' END AS price_source FROM a),
r AS (SELECT strftime(l_shipdate, '%Y-%m') AS month_key, l_partkey AS equip_id,
             l_extendedprice * l_discount / 1000.0::DOUBLE AS parts FROM lineitem WHERE l_shipdate IS NOT NULL)
SELECT month_key, category, price_source, count(*) AS n_rows, count(DISTINCT r.equip_id) AS n_assets,
       round(sum(parts), 2) AS parts, CAST(sum(CAST(new_price AS DECIMAL(20,6))) AS DOUBLE) AS new_price_sum
FROM r LEFT JOIN b USING (equip_id) GROUP BY 1, 2, 3
"""

ORACLE["replacement_filtered"] = f"""
WITH {X.REPAIRS_CTE},
f AS (SELECT r.*, loc.location FROM r LEFT JOIN loc ON loc.s_suppkey = r.suppkey
      LEFT JOIN part ON p_partkey = r.equip_id
      WHERE r.equip_id IS NOT NULL AND p_type = 'ECONOMY' AND {X.normalize_building('loc.location')} = 'NATION_1'),
ids AS (SELECT equip_id FROM f GROUP BY equip_id HAVING count(*) = 2),
g AS (SELECT equip_id, arg_min(location, row_ord) AS location, sum(parts) AS parts, sum(labor) AS labor,
             count(*) AS n_rows FROM f WHERE equip_id IN (SELECT equip_id FROM ids) GROUP BY equip_id)
SELECT g.equip_id, p_name AS equipment, p_type AS category, {X.normalize_building('g.location')} AS building,
       round(parts, 2) AS parts_cost, round(labor, 2) AS labor_cost, round(labor + parts, 2) AS total_cost,
       p_retailprice AS new_price, n_rows, {X.replace_status('labor', 'parts', 'p_retailprice')} AS status
FROM g LEFT JOIN part ON p_partkey = g.equip_id
WHERE regexp_matches(lower(p_name), 'widget|gear') AND contains(CAST(g.equip_id AS VARCHAR), '1')
"""

ORACLE["keyword_key_match"] = f"""
WITH {_KW},
nk AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(strip_accents(label)), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS k
       FROM kw WHERE label IS NOT NULL),
nn AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(strip_accents(equip_name)), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS n
       FROM en),
nn2 AS (SELECT n FROM nn WHERE n IS NOT NULL AND n <> ''),
s1 AS (SELECT n, k, row_number() OVER (PARTITION BY n ORDER BY length(k) DESC, k) AS rn
       FROM nn2, nk WHERE contains(n, k) OR contains(k, n)),
t0 AS (SELECT k, list_filter(string_split(k, ' '), lambda t: length(t) >= 2) AS toks FROM nk),
t1 AS (SELECT n, k, len(list_filter(toks, lambda t: contains(n, t))) / len(toks) AS sc
       FROM nn2, t0 WHERE len(toks) > 0),
s2 AS (SELECT n, k, row_number() OVER (PARTITION BY n ORDER BY sc DESC, length(k) DESC, k) AS rn
       FROM t1 WHERE sc >= 0.5)
SELECT nn2.n AS name, coalesce(a.k, b.k) AS key
FROM nn2 LEFT JOIN (SELECT * FROM s1 WHERE rn = 1) a ON a.n = nn2.n
LEFT JOIN (SELECT * FROM s2 WHERE rn = 1) b ON b.n = nn2.n
"""

ORACLE["name_fold"] = """
SELECT p_partkey AS equip_id,
       trim(regexp_replace(regexp_replace(lower(strip_accents(translate(p_name, 'aeiouyznc', 'áèîõůýźñč'))), '[^\\w\\s]', ' ', 'g'),
                           '\\s+', ' ', 'g')) AS name
FROM part
"""

ORACLE["business_days_any"] = f"""
WITH {X.business_calendar_cte('1600-01-01', '2300-12-31')},
p AS (SELECT CAST(o_orderdate AS DATE) - 110000 AS a, CAST(l_shipdate AS DATE) + 60000 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      UNION ALL
      SELECT CAST(o_orderdate AS DATE) - 110000, CAST(l_shipdate AS DATE) - 110000 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT {X.business_days('a', 'b', 'ca', 'cb')} AS business_days, count(*) AS n_rows
FROM p LEFT JOIN cal ca ON ca.cal_date = a LEFT JOIN cal cb ON cb.cal_date = b GROUP BY 1
"""

ORACLE["blank_id_service"] = f"""
WITH {X.SERVICE_CTE},
t AS (SELECT CASE WHEN row_ord.c % 6 = 3 THEN ' ' WHEN row_ord.c % 3 <> 0 THEN CAST(equip_id AS VARCHAR) END AS raw_id,
             CASE WHEN row_ord.c % 3 <> 0 THEN CAST(equip_id AS VARCHAR) END AS id, sched_date, completed_date, status, description, month_key,
             {X.norm_desc('description')} AS hk, {X.soft_norm_desc('description')} AS sk
      FROM s WHERE month_key IS NOT NULL),
keys AS (SELECT id, hk AS k FROM t WHERE completed_date IS NOT NULL AND id IS NOT NULL
         UNION SELECT id, sk FROM t WHERE completed_date IS NOT NULL AND id IS NOT NULL),
fd AS (SELECT id, min(completed_date) AS first_done FROM t WHERE completed_date IS NOT NULL AND id IS NOT NULL GROUP BY id)
SELECT t.description, t.month_key,
       CASE WHEN a.k IS NOT NULL OR b.k IS NOT NULL OR coalesce(first_done > sched_date, false) THEN 'Completed'
            ELSE {X.raw_status('status')} END AS status,
       count(*) AS n_rows, count(raw_id) AS n_ids
FROM t LEFT JOIN keys a ON a.id = t.id AND a.k = t.hk LEFT JOIN keys b ON b.id = t.id AND b.k = t.sk
LEFT JOIN fd ON fd.id = t.id GROUP BY 1, 2, 3
"""

ORACLE["override_upsert"] = """
WITH ch AS (SELECT p_partkey AS equip_id, round_even((p_size - 44) * 1.5, 0) AS m, (p_size - 44) * 1.5 AS m0,
                   'size ' || CAST(p_size AS VARCHAR) AS note
            FROM part WHERE p_size BETWEEN 40 AND 48)
SELECT equip_id, CAST(m AS DOUBLE) AS extra_months, note, '2002-01-01' AS updated_at FROM ch WHERE m0 > 0
UNION ALL
SELECT p_partkey, CAST(p_size AS DOUBLE), p_brand, '' FROM part WHERE p_size > 48
"""

ORACLE["csv_union_ingest"] = """
SELECT l_partkey AS equip_id, count(*) AS n_rows, round(sum(l_extendedprice), 2) AS cost,
       count(DISTINCT CASE WHEN year(l_shipdate) > 1997 THEN l_suppkey END) AS n_vendors,
       CAST(coalesce(sum(CASE WHEN year(l_shipdate) > 1997 THEN l_linenumber END), 0) AS BIGINT) AS line_sum
FROM lineitem GROUP BY 1
"""

ORACLE["rejected_files"] = """
SELECT 'read' AS outcome, count(*) AS n FROM events WHERE coalesce(event_type, '') NOT IN ('error', 'purchase')
UNION ALL SELECT * FROM (VALUES ('open quote', 1::BIGINT), ('not text', 1::BIGINT), ('empty', 1::BIGINT)) AS t(outcome, n)
"""


def _row_order(descending: bool = False) -> str:
    keys = ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")
    return ", ".join(f"{k} DESC NULLS LAST" if descending else f"{k} ASC NULLS FIRST" for k in keys)


ORACLE["depreciation_cohorts"] = f"""
WITH {_KW},
a AS (SELECT en.equip_id, p_retailprice AS price, kw.keyword, CASE WHEN p_size > 40 THEN '' ELSE p_type END AS etype
      FROM en JOIN part ON p_partkey = en.equip_id LEFT JOIN kw ON kw.name = en.equip_name),
meta AS (SELECT l_partkey AS equip_id, CASE WHEN l_quantity <= 25 THEN CAST(l_shipdate AS DATE) END AS pdate,
                CASE WHEN l_quantity <= 10 THEN l_quantity END AS dyears, CASE WHEN p_size <= 45 THEN p_type END AS mtype
         FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'
         QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY {_row_order(True)}) = 1),
pr AS (SELECT l.*, CASE WHEN l_quantity <= 30 THEN year(l_shipdate) END AS y,
              CASE WHEN l_quantity BETWEEN 20 AND 40 THEN l_quantity END AS life, kw.keyword, p_type AS ptype
       FROM lineitem l JOIN part ON p_partkey = l_partkey JOIN en ON en.equip_id = l_partkey
       LEFT JOIN kw ON kw.name = en.equip_name WHERE l_returnflag = 'A'),
pa AS (SELECT *, CASE WHEN y IS NOT NULL THEN greatest(0, (2002 - y) * 12 + (1 - 7)) END AS age_m, life * 12.0 AS life_m FROM pr),
byid AS (SELECT l_partkey AS equip_id, y, life FROM pr
         QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY {_row_order()}) = 1),
ck AS (SELECT keyword, median(age_m) AS age, median(life_m) AS life FROM pa WHERE keyword <> ''
       GROUP BY keyword HAVING count(age_m) + count(life_m) > 0),
ct AS (SELECT ptype, median(age_m) AS age, median(life_m) AS life FROM pa WHERE ptype <> ''
       GROUP BY ptype HAVING count(age_m) + count(life_m) > 0),
fl AS (SELECT median(age_m) AS age, median(life_m) AS life FROM pa),
d AS (SELECT a.equip_id, a.price,
        CASE WHEN pdate IS NOT NULL THEN greatest(0, (2002 - year(pdate)) * 12 + (1 - month(pdate))
             - CASE WHEN 1 < day(pdate) THEN 1 ELSE 0 END) END AS age_d,
        CASE WHEN byid.y IS NOT NULL THEN greatest(0, (2002 - byid.y) * 12 + (1 - 7)) END AS age_y,
        CASE WHEN ck.keyword IS NOT NULL THEN ck.age ELSE ct.age END AS age_c, fl.age AS age_f,
        CASE WHEN byid.life > 0 THEN byid.life * 12.0 END AS life_p, CASE WHEN dyears > 0 THEN dyears * 12.0 END AS life_s,
        CASE WHEN ck.keyword IS NOT NULL THEN ck.life ELSE ct.life END AS life_c, fl.life AS life_f
      FROM a LEFT JOIN meta USING (equip_id) LEFT JOIN byid USING (equip_id) LEFT JOIN ck ON ck.keyword = a.keyword
      LEFT JOIN ct ON ct.ptype = coalesce(nullif(a.etype, ''), meta.mtype) CROSS JOIN fl),
e AS (SELECT *, CAST(coalesce(age_d, age_y, age_c, age_f) AS DOUBLE) AS age, coalesce(life_p, life_s, life_c, life_f, 96.0) AS life,
        CASE WHEN age_d IS NOT NULL THEN 'summary_date' WHEN age_y IS NOT NULL THEN 'purchase_year'
             WHEN age_c IS NOT NULL THEN 'purchase_type_median' WHEN age_f IS NOT NULL THEN 'purchase_fleet_median' ELSE 'none' END AS age_source,
        CASE WHEN life_p IS NOT NULL THEN 'purchase_id' WHEN life_s IS NOT NULL THEN 'summary' WHEN life_c IS NOT NULL THEN 'purchase_type_median'
             WHEN life_f IS NOT NULL THEN 'purchase_fleet_median' ELSE 'default' END AS life_source FROM d)
SELECT equip_id, round(age, 4) AS age_months, round(life, 4) AS useful_life_months,
       CASE WHEN age IS NOT NULL AND life > 0 AND price > 0 THEN {_bv('price', 'age', 'life')} END AS book_value,
       CASE WHEN age IS NULL OR life <= 0 OR coalesce(price, 0) <= 0 THEN '—'
            WHEN age_source IN ('summary_date', 'purchase_year') AND life_source IN ('purchase_id', 'summary') THEN 'Confirmed'
            ELSE 'Estimated' END AS basis, age_source, life_source
FROM e
"""

ORACLE["scope_open"] = f"""
WITH {X.REPAIRS_CTE}
SELECT loc.location AS building, round(sum(hours), 2) AS repair_hours, count(*) AS n_rows
FROM r LEFT JOIN loc ON loc.s_suppkey = r.suppkey GROUP BY loc.location
"""

ORACLE["price_maps"] = f"""
WITH r AS (SELECT * FROM lineitem WHERE l_returnflag = 'A' AND l_partkey IS NOT NULL),
p AS (SELECT l_partkey AS equip_id, round(l_extendedprice, 2) AS purchase_price FROM r
      WHERE l_quantity <= 20 AND round(l_extendedprice, 2) > 0
      QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY {_row_order()}) = 1),
y AS (SELECT l_partkey AS equip_id, year(l_shipdate) AS purchase_year FROM r WHERE l_quantity <= 30 AND l_shipdate IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY {_row_order()}) = 1)
SELECT CAST(coalesce(p.equip_id, y.equip_id) AS VARCHAR) AS equip_id, purchase_price, purchase_year
FROM p FULL OUTER JOIN y ON p.equip_id = y.equip_id
"""

ORACLE["type_lookup"] = f"""
WITH r AS (SELECT *, p_brand || '-' || CAST(l_linenumber AS VARCHAR) AS t FROM lineitem JOIN part ON p_partkey = l_partkey
           WHERE l_quantity > 25),
a AS (SELECT l_partkey AS equip_id, t FROM r WHERE l_returnflag = 'R'
      QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY {_row_order()}) = 1),
b AS (SELECT l_partkey AS equip_id, t FROM r WHERE l_returnflag = 'A'
      QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY {_row_order(True)}) = 1)
SELECT coalesce(a.equip_id, b.equip_id) AS equip_id, coalesce(a.t, b.t) AS equip_type
FROM a FULL OUTER JOIN b ON a.equip_id = b.equip_id
"""

ORACLE["sheet_merge"] = f"""
WITH {_KW},
n AS (SELECT en.equip_id, p_size AS size, en.cost, coalesce(kw.keyword, trim(regexp_replace(lower(en.equip_name), '[^a-z0-9]+', ' ', 'g'))) AS k
      FROM en JOIN part ON p_partkey = en.equip_id LEFT JOIN kw ON kw.name = en.equip_name),
s1 AS (SELECT k, arg_min(cost, equip_id) AS price FROM n WHERE size <= 25 AND cost > 0 AND k <> '' GROUP BY k),
s2 AS (SELECT k, arg_min(cost / 2, equip_id) AS price FROM n WHERE cost > 0 AND k <> '' GROUP BY k)
SELECT coalesce(s1.k, s2.k) AS keyword, round(coalesce(s1.price, s2.price), 4) AS price
FROM s1 FULL OUTER JOIN s2 ON s1.k = s2.k
"""

ORACLE["display_formats"] = """
WITH x AS (SELECT l_quantity * CASE WHEN l_returnflag = 'R' THEN -1000.0 ELSE 1000.0 END AS m, l_shipdate,
                  CASE WHEN l_quantity < 40 THEN l_quantity * 0.5::DOUBLE END AS h FROM lineitem)
SELECT CASE WHEN m < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(m)::DOUBLE) AS amount,
       CASE WHEN h IS NULL THEN '—' ELSE CAST(CAST(round_even(h, 0) AS BIGINT) AS VARCHAR) || ' mo' END AS life,
       CASE WHEN h - 5 > 0 THEN '+' || CAST(CAST(round_even(h - 5, 0) AS BIGINT) AS VARCHAR) || ' mo' ELSE '—' END AS extension,
       count(*) AS n_rows, max(strftime(l_shipdate, '%m/%d/%Y')) AS us_date, min(strftime(l_shipdate, '%Y-%m-%d')) AS iso_date
FROM x GROUP BY 1, 2, 3
"""

ORACLE["overview_scoped"] = f"""
WITH {X.REPAIRS_CTE},
own AS (SELECT s_suppkey FROM loc WHERE location IN (SELECT n_name FROM nation WHERE n_regionkey = 1)),
rs AS (SELECT r.*, loc.location FROM r JOIN own ON own.s_suppkey = r.suppkey JOIN loc ON loc.s_suppkey = r.suppkey
       WHERE month_key IS NOT NULL),
{_svc_display_all('eff.row_ord.e IN (SELECT s_suppkey FROM own)')},
bins AS (SELECT {X.repair_count_bin('n')} AS bin FROM (SELECT equip_id, count(*) AS n FROM rs WHERE equip_id IS NOT NULL GROUP BY 1))
SELECT 'hours_by_building' AS dataset, {X.normalize_building('location')} AS key, round(sum(hours), 2) AS value FROM rs GROUP BY 2
UNION ALL SELECT 'repair_count_mix', bin, count(*) FROM bins GROUP BY 2
UNION ALL SELECT 'parts_spent', 'ALL', round(coalesce(sum(parts), 0.0), 2) FROM rs
UNION ALL SELECT 'parts_budget', 'ALL', 80000.0 * greatest(count(DISTINCT substr(month_key, 1, 4)), 1) FROM rs
UNION ALL SELECT 'staff_hours', 'ALL', round(coalesce(sum(hours), 0.0), 2) FROM rs
UNION ALL SELECT 'footer', 'repair_records', count(*) FROM rs
UNION ALL SELECT 'footer', 'assets', count(DISTINCT equip_id) FROM rs
UNION ALL SELECT 'footer', 'service_orders', count(*) FROM disp
"""

ORACLE["stream_dedup_late"] = """
SELECT event_type, count(*) AS n_events, count(*) AS n_ids, 0::BIGINT AS n_replaced, CAST(sum(late) AS BIGINT) AS n_late
FROM (SELECT event_type, 0 AS late FROM events UNION ALL SELECT event_type, 1 FROM events WHERE event_id % 5 = 0) GROUP BY 1
"""

ORACLE["status_page"] = f"""
SELECT row_number() OVER (ORDER BY CASE status WHEN 'Replace' THEN 0 WHEN 'Monitor' THEN 1 WHEN 'Good' THEN 2 ELSE 3 END, equip_id) - 1 AS place,
       equip_id, status, n_rows
FROM ({ORACLE["replacement_status"]}) QUALIFY place >= 1000 AND place < 1040
"""

ORACLE["life_rules"] = """
SELECT p_partkey, p_partkey::VARCHAR AS equip_id, CASE WHEN p_size % 7 <> 0 AND p_size > 10 THEN (p_size - 10)::DOUBLE END AS life_years,
       CASE WHEN p_size % 7 = 0 THEN 8.0 ELSE least(30, greatest(1, p_size - 10)) END::DOUBLE AS setting FROM part
"""

ORACLE["category_options"] = """
SELECT DISTINCT trim(p_type) AS category FROM part WHERE p_size % 9 <> 0 AND trim(p_type) <> ''
"""

ORACLE["summary_merge"] = """
SELECT l_partkey AS equip_id, CAST(l_shipdate AS DATE) AS purchase_date, CAST(l_extendedprice AS DOUBLE) AS cost FROM lineitem
WHERE l_returnflag IN ('R', 'A') OR (l_returnflag = 'N' AND l_partkey % 97 = 0)
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(l_shipdate AS DATE) DESC NULLS LAST, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) = 1
"""
