"""The same queries as SQL over the driver's tables."""

from __future__ import annotations

from checks.spark_queries import FILTERED, ON_ORDERS
from eventloom.schema import EVENT_COLUMNS
from eventloom.wording import (
    ADVICE,
    BATCH_INSIGHTS,
    CARD_LABELS,
    COHORT_TEXT,
    LIVE_INSIGHTS,
    REPORT_TEXT,
    SEGMENT_ADVICE,
    SUMMARY_LABELS,
    WARNING_TEXT,
)

# Written out here, so that a wrong list in the package shows.
SEGMENT_DIMENSIONS = (
    "country", "city", "device_type", "os", "traffic_source", "campaign", "subscription", "user_type", "retention_day",
)
COHORT_DAYS = (1, 3, 7, 14, 30)

CLICKS = """
e0 AS (
  SELECT ev.*, CAST(regexp_extract(ev.props, '([0-9]+)', 1) AS INT) AS k,
         c.c_custkey, c.c_mktsegment, n.n_name, r.r_name
  FROM events ev
  JOIN customer c ON ev.user_id = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
), e1 AS (
  SELECT
    'USR_' || CAST(user_id AS STRING) AS user_id,
    'SES_' || CAST(user_id AS STRING) || '_' || CAST(CAST(ts AS DATE) AS STRING) || '_' || CAST(k % 3 + 1 AS STRING) AS session_id,
    CAST(ts AS DATE) AS event_date,
    ts AS event_timestamp,
    n_name AS country,
    CASE WHEN event_id % 50 = 0 THEN NULL ELSE n_name || '_C' || CAST(c_custkey % 4 AS STRING) END AS city,
    CASE WHEN k < 70 THEN 'Mobile' WHEN k < 80 THEN 'Tablet' ELSE 'Desktop' END AS device_type,
    CASE WHEN k < 45 THEN 'Android' WHEN k < 70 THEN 'iOS' WHEN k < 80 THEN 'iPadOS' WHEN k < 94 THEN 'Windows' ELSE 'macOS' END AS os,
    CASE WHEN event_id % 67 = 0 THEN NULL ELSE 'v2.' || CAST(event_id % 5 AS STRING) END AS app_version,
    r_name AS traffic_source,
    CASE WHEN c_custkey % 20 < 7 THEN 'New' ELSE 'Returning' END AS user_type,
    CASE event_type WHEN 'view' THEN 'App Open' WHEN 'click' THEN 'Search' WHEN 'signup' THEN 'Add to Cart'
                    WHEN 'purchase' THEN 'Purchase' ELSE 'Logout' END AS event_name,
    CAST(CASE WHEN event_id % 610 = 7 THEN 86400 ELSE 10 + (event_id * 37) % 600 END AS INT) AS session_duration,
    CAST(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS DECIMAL(18,2)) AS revenue,
    CAST(CASE WHEN event_type = 'click' THEN k % 50 ELSE 0 END AS INT) AS level_completed,
    CAST(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS DECIMAL(18,2)) AS purchase_amount,
    CASE WHEN event_id % 10 < 7 THEN 'Free' WHEN event_id % 10 < 9 THEN 'Monthly' ELSE 'Annual' END AS subscription,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE c_mktsegment END AS campaign,
    CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 7 WHEN 3 THEN 14 WHEN 4 THEN 30 WHEN 5 THEN 60 ELSE 90 END AS retention_day,
    event_id
  FROM e0
), e_raw AS (
  SELECT * FROM e1 UNION ALL SELECT * FROM e1 WHERE event_id % 200 = 0
), ev AS (
  SELECT user_id, session_id, event_date, event_timestamp, country, COALESCE(city, 'Unknown') AS city, device_type, os,
         COALESCE(app_version, 'Unknown') AS app_version, traffic_source, user_type, event_name, session_duration,
         revenue, level_completed, purchase_amount, subscription, COALESCE(campaign, 'None') AS campaign, retention_day
  FROM e_raw
)"""

ORDERS = """
ev AS (
  SELECT
    'USR_' || CAST(od.o_custkey AS STRING) AS user_id,
    'SES_' || CAST(od.o_orderkey AS STRING) AS session_id,
    CAST(od.o_orderdate AS DATE) AS event_date,
    od.o_orderdate AS event_timestamp,
    n.n_name AS country,
    n.n_name || '_C' || CAST(c.c_custkey % 4 AS STRING) AS city,
    CASE WHEN od.o_orderkey % 10 < 7 THEN 'Mobile' WHEN od.o_orderkey % 10 < 8 THEN 'Tablet' ELSE 'Desktop' END AS device_type,
    CASE WHEN od.o_orderkey % 10 < 5 THEN 'Android' WHEN od.o_orderkey % 10 < 8 THEN 'iOS' ELSE 'Windows' END AS os,
    'v2.' || CAST(od.o_orderkey % 5 AS STRING) AS app_version,
    r.r_name AS traffic_source,
    CASE WHEN c.c_custkey % 20 < 7 THEN 'New' ELSE 'Returning' END AS user_type,
    CASE od.o_orderstatus WHEN 'F' THEN 'Purchase' WHEN 'O' THEN 'Add to Cart' ELSE 'Search' END AS event_name,
    CAST(10 + (od.o_orderkey * 37) % 600 AS INT) AS session_duration,
    CAST(CASE WHEN od.o_orderstatus = 'F' THEN od.o_totalprice ELSE 0 END AS DECIMAL(18,2)) AS revenue,
    0 AS level_completed,
    CAST(CASE WHEN od.o_orderstatus = 'F' THEN od.o_totalprice ELSE 0 END AS DECIMAL(18,2)) AS purchase_amount,
    CASE WHEN od.o_orderkey % 10 < 7 THEN 'Free' WHEN od.o_orderkey % 10 < 9 THEN 'Monthly' ELSE 'Annual' END AS subscription,
    od.o_orderpriority AS campaign,
    CASE od.o_orderkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 7 WHEN 3 THEN 14 WHEN 4 THEN 30 WHEN 5 THEN 60 ELSE 90 END AS retention_day
  FROM orders od
  JOIN customer c ON od.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

CLICK_FILTER = (
    "(event_date >= DATE '2024-01-11' AND event_date <= DATE '2024-01-20' AND device_type IN ('Mobile', 'Desktop')"
    " AND subscription IN ('Free', 'Monthly'))"
)
CLICK_RANGE = "(event_date >= DATE '2024-01-11' AND event_date <= DATE '2024-01-20')"
CLICK_RANGE_BEFORE = "(event_date >= DATE '2024-01-01' AND event_date <= DATE '2024-01-10')"
ORDER_FILTER = "(event_date >= DATE '1996-01-01' AND event_date <= DATE '1999-12-31' AND user_type IN ('Returning'))"
ALL = "TRUE"


# Building blocks -----------------------------------------------------------
def rnd(x: str, digits: int = 2) -> str:
    """Half away from zero on the decimal form of a double."""
    return f"CAST(ROUND(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def even(x: str, digits: int) -> str:
    """Scale, round to the even neighbour, scale back."""
    return f"(ROUND_EVEN(({x}) * 1e{digits}, 0) / 1e{digits})"


def exact(x: str, digits: int) -> str:
    return f"CAST(printf('%.{digits}f', CAST(({x}) AS DOUBLE)) AS DOUBLE)"


def six(x: str, digits: int = 6) -> str:
    return f"ROUND(CAST(({x}) AS DOUBLE), {digits})"


def fix(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', CAST(({x}) AS DOUBLE))"


def grp(x: str, digits: int) -> str:
    return f"format('{{:,.{digits}f}}', CAST(({x}) AS DOUBLE))"


def sgn(x: str, digits: int) -> str:
    return f"printf('%+.{digits}f', CAST(({x}) AS DOUBLE))"


def text(template: str, *values: str) -> str:
    """The sentence with its values; null where one is null."""
    quoted = template.replace("'", "''")
    if not values:
        return "'" + quoted.replace("%%", "%") + "'"
    present = " AND ".join(f"({v}) IS NOT NULL" for v in values)
    return f"CASE WHEN {present} THEN printf('{quoted}', {', '.join(values)}) END"


def string(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


REV = "CAST(SUM(revenue) AS DOUBLE)"
USERS = "COUNT(DISTINCT user_id)"
SESSIONS = "COUNT(DISTINCT session_id)"
PAYING = "COUNT(DISTINCT CASE WHEN revenue > 0 THEN user_id END)"
BUYERS = "COUNT(DISTINCT CASE WHEN event_name = 'Purchase' THEN user_id END)"
PAYERS = "COUNT(DISTINCT CASE WHEN event_name = 'Purchase' AND purchase_amount > 0 THEN user_id END)"
ARPU = rnd(f"{REV} / NULLIF({USERS}, 0)")
ARPPU = rnd(f"{REV} / NULLIF({PAYING}, 0)")
CONVERSION = rnd(f"100.0 * CAST({BUYERS} AS DOUBLE) / NULLIF({USERS}, 0)")
MONTH = "strftime(event_date, '%Y-%m')"
WEEK = "strftime(event_date, '%Y-W%W')"
COUNT = "COUNT(*)"
STAGES = "(VALUES (0, 'App Open'), (1, 'Search'), (2, 'Add to Cart'), (3, 'Purchase')) AS t(position, stage)"


def growth(value: str, order: str, part: str = "") -> str:
    lagged = f"LAG({value}) OVER ({part} ORDER BY {order})"
    return f"(CAST({value} AS DOUBLE) / NULLIF({lagged}, 0) - 1) * 100"


def by(keys: str, **columns: str) -> str:
    listed = ", ".join(f"{expression} AS {name}" for name, expression in columns.items())
    return f"SELECT {keys}, {listed} FROM ev WHERE {{w}} GROUP BY {keys}"


def top(keys: str, n: int, **columns: str) -> str:
    return f"{by(keys, **columns)} ORDER BY revenue DESC, {keys} LIMIT {n}"


def keyed(key: str, name: str, **columns: str) -> str:
    listed = ", ".join(f"{expression} AS {column}" for column, expression in columns.items())
    return f"SELECT {key} AS {name}, {listed} FROM ev WHERE {{w}} GROUP BY 1"


# The named queries, with {w} for the filter --------------------------------
NAMED = {
    "dau": keyed("event_date", "date", dau=USERS),
    "wau": keyed(WEEK, "year_week", wau=USERS),
    "mau": keyed(MONTH, "year_month", mau=USERS),
    "stickiness_dau_mau": f"""
        SELECT d.ym AS year_month, {rnd('AVG(d.d)', 1)} AS avg_dau, MAX(m.m) AS mau,
               {rnd('100.0 * AVG(d.d) / NULLIF(MAX(m.m), 0)')} AS stickiness_pct
        FROM (SELECT {MONTH} AS ym, event_date, {USERS} AS d FROM ev WHERE {{w}} GROUP BY 1, 2) d
        JOIN (SELECT {MONTH} AS ym, {USERS} AS m FROM ev WHERE {{w}} GROUP BY 1) m ON d.ym = m.ym
        GROUP BY d.ym""",
    "revenue_trend": keyed("event_date", "date", revenue=REV),
    "monthly_revenue": keyed(
        MONTH, "year_month", total_revenue=REV, total_users=USERS, paying_users=PAYING, arpu=ARPU, arppu=ARPPU
    ),
    "arpu_overall": f"""SELECT {REV} AS total_revenue, {USERS} AS total_users, {PAYING} AS paying_users,
        {ARPU} AS arpu, {ARPPU} AS arppu FROM ev WHERE {{w}}""",
    "revenue_per_session": f"""SELECT {REV} AS total_revenue, {SESSIONS} AS total_sessions,
        {rnd(f'{REV} / NULLIF({SESSIONS}, 0)', 4)} AS revenue_per_session FROM ev WHERE {{w}}""",
    "purchase_frequency": f"""SELECT COUNT(*) AS paying_users, {rnd('AVG(n)')} AS avg_purchase_frequency,
        MAX(n) AS max_purchase_frequency
        FROM (SELECT user_id, COUNT(*) AS n FROM ev WHERE {{w}} AND event_name = 'Purchase' GROUP BY 1)""",
    "revenue_by_country": by("country", revenue=REV, users=USERS, arpu=ARPU),
    "revenue_by_device": by("device_type", revenue=REV, users=USERS, arpu=ARPU),
    "revenue_by_campaign": by("campaign", revenue=REV, users=USERS, arpu=ARPU),
    "revenue_by_traffic_source": by("traffic_source", revenue=REV, users=USERS),
    "revenue_by_subscription": by("subscription", revenue=REV, users=USERS, arpu=ARPU),
    "funnel": f"""
        SELECT stage, users,
               {even('CAST(users AS DOUBLE) / CASE WHEN first = 0 THEN 1 ELSE first END * 100', 2)} AS conversion_from_first_pct,
               CASE WHEN prev IS NULL THEN 100.0 WHEN users = 0 AND prev = 0 THEN 100.0
                    ELSE {even('(CAST(users AS DOUBLE) / NULLIF(prev, 0) - 1) * 100 + 100', 2)} END AS conversion_from_prev_pct
        FROM (SELECT stage, users, FIRST_VALUE(users) OVER (ORDER BY position) AS first, LAG(users) OVER (ORDER BY position) AS prev
              FROM (SELECT position, stage, COALESCE(u, 0) AS users FROM {STAGES}
                    LEFT JOIN (SELECT event_name, {USERS} AS u FROM ev WHERE {{w}} GROUP BY 1) ON event_name = stage))""",
    "retention_by_day_bucket": by("retention_day", users=USERS),
    "retention_overall_rate": f"""
        SELECT COUNT(*) AS total_users, COUNT(r.user_id) AS returning_users,
               {rnd('100.0 * CAST(COUNT(r.user_id) AS DOUBLE) / NULLIF(COUNT(*), 0)')} AS retention_rate_pct
        FROM (SELECT user_id, MIN(event_date) AS first_date FROM ev WHERE {{w}} GROUP BY 1) f
        LEFT JOIN (SELECT DISTINCT e.user_id FROM ev e
                   JOIN (SELECT user_id, MIN(event_date) AS first_date FROM ev WHERE {{w}} GROUP BY 1) s
                   ON e.user_id = s.user_id WHERE e.event_date > s.first_date) r ON f.user_id = r.user_id""",
    "returning_vs_new_users": by("user_type", users=USERS, events=COUNT, revenue=REV),
    "monthly_growth": f"""
        SELECT year_month, active_users, revenue, {even(growth('active_users', 'year_month'), 2)} AS user_growth_pct,
               {even(growth('revenue', 'year_month'), 2)} AS revenue_growth_pct
        FROM (SELECT {MONTH} AS year_month, {USERS} AS active_users, {REV} AS revenue FROM ev WHERE {{w}} GROUP BY 1)""",
    "weekly_growth": f"""
        SELECT year_week, active_users, revenue, {even(growth('active_users', 'year_week'), 2)} AS user_growth_pct,
               {even(growth('revenue', 'year_week'), 2)} AS revenue_growth_pct
        FROM (SELECT {WEEK} AS year_week, {USERS} AS active_users, {REV} AS revenue FROM ev WHERE {{w}} GROUP BY 1)""",
    "campaign_growth": f"""
        SELECT campaign, year_month, revenue,
               {even(growth('revenue', 'year_month', 'PARTITION BY campaign'), 2)} AS revenue_growth_pct
        FROM (SELECT campaign, {MONTH} AS year_month, {REV} AS revenue FROM ev WHERE {{w}} GROUP BY 1, 2)""",
    "top_countries": top("country", 10, revenue=REV, users=USERS),
    "top_cities": top("city, country", 10, revenue=REV, users=USERS),
    "top_campaigns": top("campaign", 10, revenue=REV, users=USERS, arpu=ARPU),
    "traffic_source_analysis": by(
        "traffic_source", users=USERS, sessions=SESSIONS, converters=BUYERS, conversion_rate_pct=CONVERSION, revenue=REV
    ),
    "subscription_analysis": by(
        "subscription", users=USERS, revenue=REV, arpu=ARPU, avg_session_duration=rnd("AVG(session_duration)", 1)
    ),
    "device_breakdown": by("device_type", users=USERS, sessions=SESSIONS, revenue=REV),
    "os_breakdown": by("os", users=USERS, revenue=REV),
    "session_duration_stats": f"""SELECT {SESSIONS} AS total_sessions, {rnd('AVG(session_duration)', 1)} AS avg_duration,
        MIN(session_duration) AS min_duration, MAX(session_duration) AS max_duration FROM ev WHERE {{w}}""",
    "sessions_per_user": f"""SELECT COUNT(*) AS total_users, {rnd('AVG(s)')} AS avg_sessions_per_user, MAX(s) AS max_sessions_per_user
        FROM (SELECT user_id, {SESSIONS} AS s FROM ev WHERE {{w}} GROUP BY 1)""",
    "event_frequency": by("event_name", event_count=COUNT, users=USERS),
    "app_version_breakdown": by("app_version", users=USERS, revenue=REV),
    "country_device_matrix": f"""
        SELECT e.country, e.device_type, CAST(SUM(e.revenue) AS DOUBLE) AS revenue FROM ev e
        JOIN (SELECT country FROM ev WHERE {{w}} GROUP BY 1 ORDER BY SUM(revenue) DESC, country LIMIT 10) t
        ON e.country = t.country GROUP BY 1, 2""",
    "level_progression": by("level_completed", users=USERS),
    "purchase_amount_distribution": """
        SELECT CASE WHEN purchase_amount <= 0 THEN 'No purchase' WHEN purchase_amount < 10 THEN '0-10'
                    WHEN purchase_amount < 25 THEN '10-25' WHEN purchase_amount < 50 THEN '25-50'
                    WHEN purchase_amount < 100 THEN '50-100' ELSE '100+' END AS bucket,
               COUNT(*) AS events, CAST(SUM(purchase_amount) AS DOUBLE) AS total_amount
        FROM ev WHERE {w} GROUP BY 1""",
    "new_user_acquisition_trend": """SELECT first_date AS date, COUNT(*) AS new_users
        FROM (SELECT user_id, MIN(event_date) AS first_date FROM ev WHERE {w} GROUP BY 1) GROUP BY 1""",
    "conversion_rate_by_country": by("country", users=USERS, converters=BUYERS, conversion_rate_pct=CONVERSION),
    "campaign_efficiency": by("campaign", users=USERS, revenue=REV, revenue_per_user=ARPU) + f" HAVING {USERS} > 0",
    "user_level_aggregate": by("user_id", last_event_date="MAX(event_date)", frequency=SESSIONS, monetary=REV),
    "user_first_and_activity_dates": """SELECT DISTINCT e.user_id, f.cohort_date, e.event_date FROM ev e
        JOIN (SELECT user_id, MIN(event_date) AS cohort_date FROM ev WHERE {w} GROUP BY 1) f ON e.user_id = f.user_id""",
    "campaign_device_performance": by("campaign, device_type", revenue=REV, users=USERS),
    "daily_event_volume": keyed("event_date", "date", event_count=COUNT, active_users=USERS),
    "kpi_snapshot": f"""SELECT {USERS} AS total_users, {SESSIONS} AS total_sessions, COUNT(*) AS total_events,
        {REV} AS total_revenue, {ARPU} AS arpu, {ARPPU} AS arppu, {CONVERSION} AS conversion_rate_pct,
        {rnd('AVG(session_duration)', 1)} AS avg_session_duration FROM ev WHERE {{w}}""",
    "campaign_comparison": by("campaign", users=USERS, revenue=REV, arpu=ARPU, conversion_rate_pct=CONVERSION),
}

SQL: dict[str, str] = {}


def add(name: str, view: str, body: str, where: str = ALL, extra: str = "") -> None:
    body = body.replace("{w}", where)
    extra = extra.replace("{w}", where)
    SQL[name] = f"WITH {view.strip()}{', ' + extra.strip() if extra else ''}\n{body.strip()}"


for _name, _body in NAMED.items():
    add(_name, CLICKS, _body)
    if _name in ON_ORDERS:
        add(f"{_name}_orders", ORDERS, _body)
    if _name in FILTERED:
        add(f"{_name}_filtered", CLICKS, _body, CLICK_FILTER)
add("user_first_and_activity_dates_orders_filtered", ORDERS, NAMED["user_first_and_activity_dates"], ORDER_FILTER)
add("top_cities_orders", ORDERS, NAMED["top_cities"])

# Warehouse report queries --------------------------------------------------
add("warehouse_dau", CLICKS, f"SELECT event_date, {USERS} AS dau FROM ev GROUP BY 1")
add(
    "warehouse_wau", ORDERS,
    f"SELECT CAST(isoyear(event_timestamp) * 100 + weekofyear(event_timestamp) AS INT) AS year_week, {USERS} AS wau FROM ev GROUP BY 1",
)
add("warehouse_mau", ORDERS, NAMED["mau"])
add("warehouse_monthly_revenue", ORDERS, NAMED["monthly_revenue"])
add(
    "warehouse_event_funnel", CLICKS,
    f"""SELECT *, {rnd('searches * 100.0::DOUBLE / NULLIF(app_opens, 0)')} AS open_to_search_pct,
        {rnd('add_to_carts * 100.0::DOUBLE / NULLIF(searches, 0)')} AS search_to_cart_pct,
        {rnd('purchases * 100.0::DOUBLE / NULLIF(add_to_carts, 0)')} AS cart_to_purchase_pct,
        {rnd('purchases * 100.0::DOUBLE / NULLIF(app_opens, 0)')} AS overall_conversion_pct
    FROM (SELECT COUNT(*) FILTER (event_name = 'App Open') AS app_opens, COUNT(*) FILTER (event_name = 'Search') AS searches,
                 COUNT(*) FILTER (event_name = 'Add to Cart') AS add_to_carts, COUNT(*) FILTER (event_name = 'Purchase') AS purchases
          FROM ev)""",
)
add(
    "warehouse_cohort_months", ORDERS,
    f"""SELECT f.cohort_month, {MONTH.replace('event_date', 'e.event_date')} AS activity_month, COUNT(DISTINCT e.user_id) AS active_users
    FROM ev e JOIN (SELECT user_id, strftime(MIN(event_date), '%Y-%m') AS cohort_month FROM ev GROUP BY 1) f
    ON e.user_id = f.user_id GROUP BY 1, 2""",
)
add(
    "warehouse_top_channels", CLICKS,
    f"""SELECT traffic_source, campaign, {USERS} AS total_users, {REV} AS total_revenue,
        {rnd(f'{REV} / COUNT(*)')} AS avg_revenue_per_user
    FROM ev GROUP BY 1, 2 ORDER BY total_revenue DESC, 1, 2 LIMIT 10""",
)

# Cleaning ------------------------------------------------------------------
_names = ", ".join(EVENT_COLUMNS)


def order_statistic(source: str, q: float, name: str) -> str:
    """Linear interpolation between the two ranks around ``q``."""
    return f"""(SELECT lo + (hi - lo) * (place - floor(place)) AS {name} FROM (
        SELECT MAX(CASE WHEN rn - 1 = floor(place) THEN v END) AS lo, MAX(CASE WHEN rn - 1 = ceil(place) THEN v END) AS hi, MAX(place) AS place
        FROM (SELECT CAST(session_duration AS DOUBLE) AS v, ROW_NUMBER() OVER (ORDER BY session_duration) AS rn,
                     (COUNT(*) OVER () - 1) * CAST({q} AS DOUBLE) AS place
              FROM {source} WHERE session_duration IS NOT NULL)))"""


DEDUP = f"dd AS (SELECT DISTINCT {_names} FROM ev)"
CAPPED = f"""{DEDUP}, cap AS (SELECT LEAST(p99, 3600.0) AS cap FROM {order_statistic('dd', 0.99, 'p99')}),
cl AS (SELECT dd.* REPLACE (LEAST(GREATEST(CAST(session_duration AS DOUBLE), 0.0), cap) AS session_duration) FROM dd, cap)"""
CLEAN = f"SELECT {_names} FROM cl"
add("clean_for_batch", CLICKS, CLEAN, extra=CAPPED)
add("csv_batch_load", CLICKS, CLEAN, extra=CAPPED)
add("clean_for_dashboard", CLICKS, f"SELECT {_names} FROM ev")
add("csv_dashboard_load", CLICKS, f"SELECT {_names} FROM ev")
add("clean_for_import", CLICKS, f"SELECT {_names} FROM ev")
add("import_events", CLICKS, f"SELECT {_names} FROM ev")
add(
    "import_events_line_breaks", CLICKS,
    """SELECT * REPLACE (coalesce('a "b"' || chr(10) || city || ',' || chr(10) || 'c', 'Unknown') AS city, coalesce(campaign, 'None') AS campaign,
        coalesce(app_version, 'Unknown') AS app_version) FROM (SELECT %s FROM e_raw)""" % _names,
)
_REJECTED = """odd AS (SELECT user_id, strftime(event_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS moment, CAST(session_duration AS VARCHAR) AS s, CAST(revenue AS VARCHAR) AS r,
        session_duration % 10 AS kind FROM e_raw),
rejected AS (
  SELECT user_id, moment, 'session_duration' AS "column", CASE kind WHEN 1 THEN 'too large' WHEN 2 THEN 'fraction cut' ELSE 'unreadable' END AS reason,
         CASE kind WHEN 1 THEN '3000000000' WHEN 2 THEN s || '.7' ELSE 'x' END AS value FROM odd WHERE kind IN (1, 2, 3)
  UNION ALL
  SELECT user_id, moment, 'revenue', CASE kind WHEN 5 THEN 'rounded' WHEN 6 THEN 'too large' ELSE 'unreadable' END,
         CASE kind WHEN 5 THEN r || '4' WHEN 6 THEN '1e30' ELSE '-' END FROM odd WHERE kind IN (5, 6, 7))"""
add(
    "rejected_values", CLICKS,
    """SELECT user_id, CASE WHEN moment LIKE '%.%' THEN rtrim(rtrim(moment, '0'), '.') ELSE moment END AS event_timestamp, "column", reason, value FROM rejected""",
    extra=_REJECTED,
)
add("rejected_counts", CLICKS, 'SELECT "column", reason, COUNT(*) AS n FROM rejected GROUP BY ALL', extra=_REJECTED)
add("import_new_events", CLICKS, f"SELECT {_names} FROM ev WHERE dayofmonth(event_date) % 2 = 1")
add("events_table", CLICKS, f"SELECT {_names} FROM ev")
add("first_present", CLICKS, "SELECT coalesce(campaign, city, 'none') AS first, COUNT(*) AS events FROM e_raw GROUP BY 1")
add("csv_bulk_load", CLICKS, f"SELECT {_names} FROM e_raw")
add(
    "duration_cap", CLICKS, "SELECT cap FROM cap",
    extra=f"dr AS (SELECT DISTINCT {_names} FROM e_raw), cap AS (SELECT LEAST(p99, 3600.0) AS cap FROM {order_statistic('dr', 0.99, 'p99')})",
)
add(
    "cleaning_report", CLICKS,
    """SELECT (SELECT COUNT(*) FROM e_raw) AS rows_in, CAST(0 AS BIGINT) AS dropped_incomplete,
        (SELECT COUNT(*) FROM e_raw) - (SELECT COUNT(*) FROM dd) AS duplicates_removed,
        (SELECT COUNT(*) FROM dd, cap WHERE session_duration > cap) AS durations_capped,
        (SELECT COUNT(*) FROM dd) AS rows_out, """
    + ", ".join(
        f"CAST(0 AS BIGINT) AS unread_{name}"
        for name in ("event_date", "event_timestamp", "session_duration", "revenue", "level_completed", "purchase_amount", "retention_day")
    ),
    extra=CAPPED,
)

# Sources, options, scalar functions ----------------------------------------
add("row_count", CLICKS, "SELECT COUNT(*) AS n FROM ev")
add("ensure_events", CLICKS, "SELECT COUNT(*) AS n FROM ev")
add(
    "filter_options", CLICKS,
    " UNION ".join(
        f"SELECT '{c}' AS dimension, {c} AS value FROM ev WHERE {c} IS NOT NULL"
        for c in ("country", "device_type", "campaign", "user_type", "subscription", "traffic_source")
    ),
)
add("date_bounds", ORDERS, "SELECT MIN(event_date) AS min_date, MAX(event_date) AS max_date FROM ev")
add(
    "calendar_keys", ORDERS,
    f"""SELECT event_date, {MONTH} AS year_month, {WEEK} AS year_week,
        CAST(isoyear(event_date) * 100 + weekofyear(event_date) AS INT) AS iso_week,
        strftime(date_trunc('week', event_date), '%Y-%m-%d') || '/' || strftime(date_trunc('week', event_date) + INTERVAL 6 DAY, '%Y-%m-%d') AS week_span,
        dayname(event_date) AS weekday
    FROM (SELECT DISTINCT event_date FROM ev)""",
)


def number_text(v: str, digits: int, sign: str = "") -> str:
    return f"""CASE WHEN ABS({v}) >= 1000000 THEN {sign} || {fix(f'ABS({v}) / 1000000', 1)} || 'M'
        WHEN ABS({v}) >= 1000 THEN {sign} || {fix(f'ABS({v}) / 1000', 1)} || 'K' ELSE {sign} || {grp(f'ABS({v})', digits)} END"""


def compact_text(v: str) -> str:
    return f"""CASE WHEN ABS({v}) >= 1000000000 THEN {fix(f'{v} / 1000000000', 2)} || 'B'
        WHEN ABS({v}) >= 1000000 THEN {fix(f'{v} / 1000000', 2)} || 'M' WHEN ABS({v}) >= 1000 THEN {fix(f'{v} / 1000', 1)} || 'K'
        WHEN {v} = floor({v}) THEN {grp(v, 0)} ELSE {grp(v, 2)} END"""


add(
    "number_labels", ORDERS,
    f"""SELECT user_id, {number_text('spent', 2, "'$'")} AS currency, {number_text('spent', 0, "''")} AS number,
        {fix('spent / 1000', 2)} || '%' AS percent, '$' || {compact_text('(spent * 100)')} AS compact,
        {compact_text('(spent / 1000)')} || 'K' AS small, CAST(0 AS DOUBLE) AS safe
    FROM (SELECT user_id, {REV} AS spent FROM ev GROUP BY 1)""",
)


# KPIs ----------------------------------------------------------------------
def first_value(column: str, source: str = "ev", where: str = "{w}") -> str:
    return f"""(SELECT user_id, {column} FROM (SELECT user_id, {column},
        ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_timestamp, {column}) AS rn FROM {source} WHERE {where}) WHERE rn = 1)"""


def kpi_facts(name: str, source: str = "ev", where: str = "{w}") -> str:
    """One row of unrounded KPIs."""
    users = f"(SELECT CAST({USERS} AS DOUBLE) FROM {source} WHERE {where})"
    return f"""{name} AS (SELECT {USERS} AS total_users, COUNT(*) AS total_events, {SESSIONS} AS total_sessions,
        (SELECT AVG(d) FROM (SELECT {USERS} AS d FROM {source} WHERE {where} GROUP BY event_date)) AS dau,
        (SELECT AVG(m) FROM (SELECT {USERS} AS m FROM {source} WHERE {where} GROUP BY {MONTH})) AS mau,
        {REV} AS revenue, {REV} / NULLIF({USERS}, 0) AS arpu, {REV} / NULLIF({PAYERS}, 0) AS arppu,
        COALESCE(CAST(SUM(purchase_amount) FILTER (event_name = 'Purchase' AND purchase_amount > 0) AS DOUBLE)
            / NULLIF(COUNT(*) FILTER (event_name = 'Purchase' AND purchase_amount > 0), 0), 0) AS avg_purchase_value,
        {PAYERS} AS paying_users, COUNT(*) FILTER (event_name = 'Purchase' AND purchase_amount > 0) AS total_purchases,
        AVG(session_duration) AS avg_session_duration,
        100.0 * CAST({PAYERS} AS DOUBLE) / NULLIF({USERS}, 0) AS conversion_rate,
        100.0 * CAST(COUNT(*) FILTER (event_name = 'Purchase') AS DOUBLE) / COUNT(*) AS purchase_rate_pct,
        100.0 * CAST((SELECT COUNT(*) FROM {first_value('user_type', source, where)} WHERE user_type = 'Returning') AS DOUBLE) / {users} AS returning_pct,
        (SELECT m FROM {order_statistic(f"(SELECT session_duration FROM {source} WHERE {where})", 0.5, 'm')}) AS median_session_duration
    FROM {source} WHERE {where})"""


BATCH_COLUMNS = {
    "total_users": "total_users", "total_events": "total_events", "total_sessions": "total_sessions", "avg_dau": six("dau"),
    "avg_mau": six("mau"), "total_revenue": six("revenue"), "arpu": six("arpu"), "arppu": six("arppu"),
    "avg_purchase_value": six("avg_purchase_value"), "paying_users": "paying_users",
    "avg_session_duration": six("avg_session_duration"), "median_session_duration": six("median_session_duration"),
    "conversion_rate_pct": six("conversion_rate"), "purchase_rate_pct": six("purchase_rate_pct"),
    "returning_user_pct": six("returning_pct"),
}
DASHBOARD_COLUMNS = {
    "total_users": "total_users", "dau": six("dau"), "mau": six("mau"), "revenue": six("revenue"), "arpu": six("arpu"),
    "conversion_rate": six("conversion_rate"), "avg_purchase_value": six("avg_purchase_value"), "paying_users": "paying_users",
    "total_sessions": "total_sessions", "total_purchases": "total_purchases", "total_events": "total_events",
    "avg_session_duration": six("avg_session_duration"),
}
COMPARED = list(DASHBOARD_COLUMNS)[:10]


def columns(table: dict[str, str]) -> str:
    return ", ".join(f"{expression} AS {name}" for name, expression in table.items())


def rows(table: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS metric, {six(x)} AS value FROM {source}" for name, x in table.items())


add("batch_kpis", CLICKS, f"SELECT {columns(BATCH_COLUMNS)} FROM k", extra=f"{CAPPED}, {kpi_facts('k', 'cl')}")
add("batch_kpis_orders", ORDERS, f"SELECT {columns(BATCH_COLUMNS)} FROM k", extra=kpi_facts("k"))
add("dashboard_kpis", CLICKS, f"SELECT {columns(DASHBOARD_COLUMNS)} FROM k", extra=kpi_facts("k"))
add("dashboard_kpis_filtered", CLICKS, f"SELECT {columns(DASHBOARD_COLUMNS)} FROM k", CLICK_FILTER, extra=kpi_facts("k"))
add("dashboard_kpis_orders", ORDERS, f"SELECT {columns(DASHBOARD_COLUMNS)} FROM k", extra=kpi_facts("k"))
add("summary_metrics_file", ORDERS, rows(BATCH_COLUMNS, "k"), extra=kpi_facts("k"))
add("batch_report_job", CLICKS, rows(BATCH_COLUMNS, "k"), extra=f"{CAPPED}, {kpi_facts('k', 'cl')}")

SERIES = f"""SELECT 'daily_active_users' AS metric, CAST(event_date AS VARCHAR) AS key, CAST({USERS} AS DOUBLE) AS value FROM ev GROUP BY 2
    UNION ALL SELECT 'monthly_active_users', {MONTH}, CAST({USERS} AS DOUBLE) FROM ev GROUP BY 2
    UNION ALL SELECT 'revenue_per_country', country, {REV} FROM ev GROUP BY 2
    UNION ALL SELECT 'revenue_per_device', device_type, {REV} FROM ev GROUP BY 2
    UNION ALL SELECT 'revenue_per_campaign', campaign, {REV} FROM ev GROUP BY 2"""
add("kpi_series", ORDERS, SERIES)
add(
    "analytics_summary_file", ORDERS,
    f"""SELECT metric, CAST(NULL AS VARCHAR) AS key, value FROM ({rows(BATCH_COLUMNS, 'k')})
    UNION ALL SELECT metric, key, {six('value')} FROM ({SERIES})""",
    extra=kpi_facts("k"),
)


def leader(column: str, measure: str, where: str = "{w}", source: str = "ev") -> str:
    """The first of the largest: ``(name, amount)``."""
    return f"""(SELECT {column} AS name, {measure} AS amount FROM {source} WHERE {where} AND {column} IS NOT NULL
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"""


ADVANCED = f"""SELECT {six('100.0 * dau / mau')} AS stickiness, {six('avg_session_duration')} AS avg_session_duration,
    {six('returning_pct')} AS returning_pct, paying_users, {six('revenue / total_sessions')} AS revenue_per_session,
    {six('revenue / total_purchases')} AS revenue_per_purchase,
    (SELECT name FROM {leader('country', REV)}) AS top_country, (SELECT name FROM {leader('device_type', REV)}) AS top_device
    FROM k"""
add("advanced_kpis", CLICKS, ADVANCED, extra=kpi_facts("k"))
add("advanced_kpis_orders", ORDERS, ADVANCED, extra=kpi_facts("k"))

NOW_BEFORE = f"{kpi_facts('k', where=CLICK_RANGE)}, {kpi_facts('b', where=CLICK_RANGE_BEFORE)}"
PLAIN = {name: name for name in COMPARED}
PAIRS = " UNION ALL ".join(
    f"SELECT '{name}' AS metric, CAST(k.{name} AS DOUBLE) AS current, CAST(b.{name} AS DOUBLE) AS previous FROM k, b"
    for name in COMPARED
)
CHANGE = "100.0 * ((current - previous) / NULLIF(previous, 0))"
add(
    "period_comparison", CLICKS,
    f"""SELECT metric, {six('current')} AS current, {six('previous')} AS previous, {six(CHANGE)} AS change_pct,
        CASE WHEN {CHANGE} > 0.05 THEN 'up' WHEN {CHANGE} < -0.05 THEN 'down' ELSE 'flat' END AS direction
    FROM ({PAIRS})""",
    extra=NOW_BEFORE,
)
SUMMARY_COLUMNS = {
    name: x for name, x in BATCH_COLUMNS.items()
    if name not in ("arppu", "paying_users", "purchase_rate_pct", "returning_user_pct")
}
add("filtered_summary_metrics", CLICKS, rows(SUMMARY_COLUMNS, "k"), CLICK_RANGE, extra=kpi_facts("k"))
_cards = [
    number_text("total_users", 0, "''"), number_text("total_revenue", 2, "'$'"), number_text("arpu", 2, "'$'"),
    number_text("arppu", 2, "'$'"), f"{fix('conversion_rate_pct', 1)} || '%'", number_text("avg_session_duration", 0, "''"),
    number_text("total_sessions", 0, "''"), number_text("total_events", 0, "''"),
]
add(
    "kpi_cards", ORDERS,
    " UNION ALL ".join(
        f"SELECT CAST({i + 1} AS INT) AS position, {string(label)} AS label, {value} AS value FROM s"
        for i, (label, value) in enumerate(zip(CARD_LABELS, _cards, strict=True))
    ),
    extra=f"s AS ({NAMED['kpi_snapshot']})",
)

# Segments ------------------------------------------------------------------
SEGMENT = f"{USERS} AS users, COUNT(*) AS events, {six(REV)} AS revenue, {six('AVG(session_duration)')} AS avg_session_duration"
add(
    "segmentation", CLICKS,
    " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS segment, {SEGMENT} FROM ev WHERE {d} IS NOT NULL GROUP BY 2"
        for d in SEGMENT_DIMENSIONS
    ),
)
for _d in ("country", "campaign", "device_type"):
    add(f"segment_summary_{_d}", CLICKS, f"SELECT {_d}, {SEGMENT} FROM ev WHERE {_d} IS NOT NULL GROUP BY 1")
PAID = "event_name = 'Purchase' AND purchase_amount > 0"
for _d in ("country", "campaign", "device_type", "subscription", "traffic_source"):
    add(
        f"summary_table_{_d}", CLICKS,
        f"""SELECT {_d}, {USERS} AS users, {six(REV)} AS revenue, {six(f'{REV} / {USERS}')} AS arpu,
            {six(f'100.0 * CAST({PAYERS} AS DOUBLE) / {USERS}')} AS conversion_rate_pct,
            COALESCE({six(f'CAST(SUM(purchase_amount) FILTER ({PAID}) AS DOUBLE) / NULLIF(COUNT(*) FILTER ({PAID}), 0)')}, 0) AS avg_purchase_value,
            {six(f'100.0 * {REV} / (SELECT {REV} FROM ev)')} AS pct_share
        FROM ev WHERE {_d} IS NOT NULL GROUP BY 1""",
    )
add(
    "monthly_growth_table", ORDERS,
    f"""SELECT month, {six('revenue')} AS revenue, {six('avg_dau')} AS avg_dau,
        {six(growth('revenue', 'month'))} AS revenue_growth_pct, {six(growth('avg_dau', 'month'))} AS dau_growth_pct
    FROM (SELECT strftime(event_date, '%Y-%m') AS month, CAST(SUM(r) AS DOUBLE) AS revenue, AVG(u) AS avg_dau
          FROM (SELECT event_date, SUM(revenue) AS r, {USERS} AS u FROM ev GROUP BY 1) GROUP BY 1)""",
)
add(
    "top_campaign_growth", ORDERS,
    """SELECT g.* FROM g JOIN (SELECT campaign FROM ev GROUP BY 1 ORDER BY SUM(revenue) DESC, campaign LIMIT 5) t
    ON g.campaign = t.campaign""",
    extra=f"g AS ({NAMED['campaign_growth']})",
)

# Cohorts -------------------------------------------------------------------
_rates = ", ".join(
    f"""{exact(f"100.0 * COUNT(DISTINCT CASE WHEN age = {d} THEN user_id END) / COUNT(DISTINCT user_id)", 2)} AS "Day {d}" """
    for d in COHORT_DAYS
)
COHORTS = f"""co AS (SELECT strftime(cohort_date, '%Y-%m') AS cohort_month, COUNT(DISTINCT user_id) AS cohort_size, {_rates}
    FROM (SELECT *, date_diff('day', cohort_date, event_date) AS age FROM ({NAMED['user_first_and_activity_dates']})) GROUP BY 1)"""
add("cohort_table", CLICKS, "SELECT * FROM co", extra=COHORTS)
add("cohort_table_orders", ORDERS, "SELECT * FROM co", extra=COHORTS)
add("cohort_table_filtered", ORDERS, "SELECT * FROM co", ORDER_FILTER, extra=COHORTS)
add(
    "cohort_cells", ORDERS,
    " UNION ALL ".join(f"""SELECT cohort_month, 'Day {d}' AS milestone, "Day {d}" AS retention_pct FROM co""" for d in COHORT_DAYS),
    extra=COHORTS,
)
_best = '(SELECT {} FROM co ORDER BY "Day 30" DESC, cohort_month LIMIT 1)'
add(
    "cohort_insights", ORDERS,
    f"""SELECT CAST(1 AS INT) AS position, {text(COHORT_TEXT['day_1'], fix('(SELECT AVG("Day 1") FROM co)', 1))} AS text
    UNION ALL SELECT 2, {text(COHORT_TEXT['day_30'], fix('(SELECT AVG("Day 30") FROM co)', 1))}
    UNION ALL SELECT 3, {text(COHORT_TEXT['best'], _best.format('cohort_month'), fix(_best.format('"Day 30"'), 1))}""",
    extra=COHORTS,
)


# User segments -------------------------------------------------------------
def score(order: str) -> str:
    """Which fifth the rank falls in: 5(r-1) against steps of n-1."""
    rank = f"(ROW_NUMBER() OVER (ORDER BY {order}, user_id) - 1)"
    return f"CAST(CASE WHEN COUNT(*) OVER () = 1 THEN 3 ELSE GREATEST(1, CEIL(5.0 * {rank} / (COUNT(*) OVER () - 1))) END AS INT)"


def rfm(anchor: str) -> str:
    return f"""u AS ({NAMED['user_level_aggregate']}),
    q AS (SELECT user_id, CAST(date_diff('day', last_event_date, {anchor}) AS INT) AS recency_days, frequency, monetary FROM u),
    sc AS (SELECT *, 6 - {score('recency_days')} AS R, {score('frequency')} AS F, {score('monetary')} AS M FROM q),
    rfm AS (SELECT *, CASE WHEN R >= 4 AND (F + M) / 2.0 >= 4 THEN 'Champions' WHEN R >= 3 AND (F + M) / 2.0 >= 3 THEN 'Loyal Customers'
        WHEN R >= 3 AND (F + M) / 2.0 >= 2 THEN 'Potential Loyalists' WHEN R = 2 AND (F + M) / 2.0 >= 2 THEN 'Need Attention'
        WHEN R <= 2 AND (F + M) / 2.0 >= 2 THEN 'At Risk' ELSE 'Lost Customers' END AS rfm_segment FROM sc)"""


LATEST = "(SELECT MAX(last_event_date) FROM u)"
_advice = " ".join(f"WHEN {string(name)} THEN {string(advice)}" for name, advice in SEGMENT_ADVICE.items())
SEGMENTS = f"""SELECT rfm_segment, COUNT(DISTINCT user_id) AS users, {even('AVG(recency_days)', 1)} AS avg_recency_days,
    {even('AVG(frequency)', 1)} AS avg_frequency, CAST(SUM(CAST(monetary AS DECIMAL(28,2))) AS DOUBLE) AS total_monetary,
    {even('CAST(COUNT(DISTINCT user_id) AS DOUBLE) / (SELECT COUNT(*) FROM rfm) * 100', 1)} AS pct_of_total,
    CASE rfm_segment {_advice} END AS recommendation FROM rfm GROUP BY 1"""
add("rfm_table", ORDERS, "SELECT * FROM rfm", extra=rfm(LATEST))
add("rfm_table_clicks", CLICKS, "SELECT * FROM rfm", extra=rfm(LATEST))
add("rfm_table_snapshot", ORDERS, "SELECT * FROM rfm", extra=rfm("DATE '2000-06-30'"))
add("rfm_table_filtered", ORDERS, "SELECT * FROM rfm", ORDER_FILTER, extra=rfm(LATEST))
add("rfm_segment_summary", ORDERS, SEGMENTS, extra=rfm(LATEST))


# Anomalies -----------------------------------------------------------------
def anomalies(source: str, value: str, labels: str) -> str:
    z = f'(CAST("{value}" AS DOUBLE) - mean) / NULLIF(sd, 0)'
    return f"""SELECT {labels}, "{value}", {even(z, 2)} AS z_score, CASE WHEN {z} > 0 THEN 'spike' ELSE 'drop' END AS direction
    FROM ({source}) s, (SELECT COUNT(*) AS n, AVG(CAST("{value}" AS DOUBLE)) AS mean, STDDEV_POP(CAST("{value}" AS DOUBLE)) AS sd FROM ({source}))
    WHERE n >= 5 AND ABS({z}) >= 2.0"""


REVENUE_A = anomalies(NAMED["revenue_trend"], "revenue", "date")
TRAFFIC_A = anomalies(NAMED["daily_event_volume"], "event_count", "date, active_users")
CAMPAIGN_A = anomalies(
    f"SELECT * FROM ({NAMED['campaign_growth']}) WHERE revenue_growth_pct IS NOT NULL", "revenue_growth_pct", "campaign, year_month"
)
RETENTION_A = anomalies("SELECT * FROM co", "Day 30", "cohort_month, cohort_size")
add("revenue_anomalies", ORDERS, REVENUE_A)
add("revenue_anomalies_clicks", CLICKS, REVENUE_A)
add("traffic_anomalies", ORDERS, TRAFFIC_A)
add("traffic_anomalies_clicks", CLICKS, TRAFFIC_A)
add("campaign_anomalies", ORDERS, CAMPAIGN_A)
add("retention_anomalies", ORDERS, RETENTION_A, extra=COHORTS)

_severity = "CASE WHEN ABS(z_score) >= 3 THEN 'high' ELSE 'medium' END"
_z = sgn("z_score", 2)


def card(kind: str, rank: int, source: str, severity: str, key: str, title: list[str], message: list[str]) -> str:
    return f"""SELECT {rank} AS kind, ABS(z_score) AS size, {key} AS key, {severity} AS severity,
        {text(WARNING_TEXT[kind][0], *title)} AS title, {text(WARNING_TEXT[kind][1], *message)} AS message FROM ({source})"""


_day = "CAST(date AS VARCHAR)"
_found = [
    card("revenue", 0, REVENUE_A, _severity, _day, ["direction", _day], [fix("revenue", 2), _z]),
    card("traffic", 1, TRAFFIC_A, _severity, _day, ["direction", _day], ["CAST(event_count AS VARCHAR)", _z]),
    card(
        "campaign", 2, CAMPAIGN_A, "'medium'", "campaign || '|' || year_month", ["campaign", "year_month"],
        [sgn("revenue_growth_pct", 1), _z],
    ),
]
_kept = card("retention", 3, RETENTION_A, "'medium'", "cohort_month", ["cohort_month"], [fix('"Day 30"', 1), _z])
_none = f"""SELECT 4 AS kind, 0.0 AS size, '' AS key, 'info' AS severity, {string(WARNING_TEXT['none'][0])} AS title,
    {string(WARNING_TEXT['none'][1])} AS message WHERE NOT EXISTS (SELECT 1 FROM found)"""
CARDS = "SELECT severity, title, message FROM (SELECT * FROM found UNION ALL {none})".replace("{none}", _none)
add("warning_cards", ORDERS, CARDS, extra=f"{COHORTS}, found AS ({' UNION ALL '.join([*_found, _kept])})")
add(
    "warning_cards_shown", ORDERS,
    f"SELECT severity, title, message FROM (SELECT * FROM found UNION ALL {_none}) ORDER BY kind, size DESC, key LIMIT 20",
    extra=f"{COHORTS}, found AS ({' UNION ALL '.join([*_found, _kept])})",
)
add("warning_cards_clicks", CLICKS, CARDS, extra=f"found AS ({' UNION ALL '.join(_found)})")

# Distributions and chart data ----------------------------------------------
def heatmap(day: str) -> str:
    week = """strftime(date_trunc('week', event_date), '%Y-%m-%d') || '/' || strftime(date_trunc('week', event_date) + INTERVAL 6 DAY, '%Y-%m-%d')"""
    return f"""SELECT * FROM (WITH d AS (SELECT {week} AS cohort_week, {day} AS retention_day, user_id FROM ev WHERE event_date IS NOT NULL AND {day} IS NOT NULL)
    SELECT w.cohort_week, r.retention_day, COUNT(DISTINCT d.user_id) AS users
    FROM (SELECT DISTINCT cohort_week FROM d) w, (SELECT DISTINCT retention_day FROM d) r
    LEFT JOIN d ON d.cohort_week = w.cohort_week AND d.retention_day = r.retention_day GROUP BY 1, 2)"""


add("retention_heatmap", CLICKS, heatmap("retention_day"))
add("retention_heatmap_day_zero", CLICKS, heatmap("CASE WHEN retention_day = 1 THEN 0 WHEN retention_day <> 90 THEN retention_day END"))
ALL_CAPPED = f"""cap AS (SELECT LEAST(p99, 3600.0) AS cap FROM {order_statistic('ev', 0.99, 'p99')}),
cl AS (SELECT LEAST(GREATEST(CAST(session_duration AS DOUBLE), 0.0), cap) AS v FROM ev, cap)"""
add(
    "duration_histogram", CLICKS,
    f"""SELECT CAST(b.bin AS INT) AS bin, {six('low + b.bin * (span / 40)', 9)} AS lower, {six('low + (b.bin + 1) * (span / 40)', 9)} AS upper,
        COUNT(h.bin) AS events, {six('CAST(COUNT(h.bin) AS DOUBLE) / (MAX(n) * (span / 40))', 9)} AS density
    FROM (SELECT MIN(v) AS low, MAX(v) - MIN(v) AS span, COUNT(*) AS n FROM cl) f, range(40) b(bin)
    LEFT JOIN (SELECT LEAST(floor((v - (SELECT MIN(v) FROM cl)) * 40 / (SELECT MAX(v) - MIN(v) FROM cl)), 39) AS bin FROM cl) h ON h.bin = b.bin
    GROUP BY b.bin, low, span""",
    extra=ALL_CAPPED,
)
add(
    "duration_density", CLICKS,
    f"""SELECT CAST(point AS INT) AS point, {six('MAX(x)', 9)} AS x,
        {six('SUM(c * exp(-0.5 * pow((x - v) / h, 2))) / (MAX(n) * MAX(h) * sqrt(2 * pi()))', 9)} AS density
    FROM (SELECT point, low + point * ((high - low) / 199) AS x, n, h
          FROM (SELECT MIN(session_duration) AS low, MAX(session_duration) AS high, COUNT(*) AS n,
                       1.06 * STDDEV_SAMP(CAST(session_duration AS DOUBLE)) * pow(CAST(COUNT(*) AS DOUBLE), -0.2) AS h FROM ev), range(200) g(point)),
         (SELECT CAST(session_duration AS DOUBLE) AS v, COUNT(*) AS c FROM ev GROUP BY 1)
    GROUP BY point""",
)
add(
    "chart_dau_trend", CLICKS,
    f"""SELECT date, active_users, {six('AVG(active_users) OVER (ORDER BY date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)')} AS smoothed
    FROM (SELECT event_date AS date, {USERS} AS active_users FROM ev GROUP BY 1)""",
)
add("chart_revenue_by_country", CLICKS, f"SELECT country, {REV} AS revenue FROM ev GROUP BY 1")
add("chart_revenue_by_device", CLICKS, f"SELECT device_type, {REV} AS revenue FROM ev GROUP BY 1 HAVING SUM(revenue) > 0")
add("chart_revenue_by_campaign", CLICKS, f"SELECT campaign, {REV} AS revenue FROM ev GROUP BY 1")
add("chart_events_by_device", CLICKS, "SELECT device_type, COUNT(*) AS events FROM ev GROUP BY 1")
add("chart_events_by_traffic_source", CLICKS, "SELECT traffic_source, COUNT(*) AS events FROM ev GROUP BY 1")
add(
    "chart_funnel", CLICKS,
    f"""SELECT CAST(position AS INT) AS position, stage, COALESCE(u, 0) AS users FROM {STAGES}
    LEFT JOIN (SELECT event_name, {USERS} AS u FROM ev GROUP BY 1) ON event_name = stage""",
)
for _c in ("subscription", "user_type", "retention_day"):
    add(f"chart_{_c}_users", CLICKS, f"SELECT {_c}, COUNT(*) AS users FROM {first_value(_c)} GROUP BY 1")


# Texts ---------------------------------------------------------------------
def facts(source: str = "ev", where: str = "{w}") -> str:
    """Leaders and funnel counts as one-row tables."""
    amount = {
        "t_country": ("country", REV, ""), "t_device": ("device_type", REV, ""),
        "t_campaign": ("campaign", REV, " AND campaign <> 'None'"), "t_subscription": ("subscription", REV, ""),
        "t_city": ("city", REV, " AND city <> 'Unknown'"), "t_traffic": ("traffic_source", COUNT, ""),
        "t_event": ("event_name", COUNT, ""), "t_os": ("os", COUNT, ""), "t_weekday": ("dayname(event_date)", COUNT, ""),
    }
    leaders = ", ".join(f"{n} AS {leader(c, m, where + more, source)}" for n, (c, m, more) in amount.items())
    counts = ", ".join(
        f"COUNT(DISTINCT CASE WHEN event_name = '{stage}' THEN user_id END) AS s{i}"
        for i, stage in enumerate(("App Open", "Search", "Add to Cart", "Purchase"))
    )
    return f"{kpi_facts('k', source, where)}, {leaders}, fn AS (SELECT {counts} FROM {source} WHERE {where})"


def name_of(t: str) -> str:
    return f"(SELECT name FROM {t})"


def amount_of(t: str) -> str:
    return f"(SELECT amount FROM {t})"


def of_k(x: str) -> str:
    return f"(SELECT {x} FROM k)"


def of_f(x: str) -> str:
    return f"(SELECT {x} FROM fn)"


def numbered(lines: list[str], most: int = 100) -> str:
    listed = " UNION ALL ".join(f"SELECT {i} AS i, {line} AS text" for i, line in enumerate(lines))
    return f"""SELECT CAST(position AS INT) AS position, text FROM (SELECT ROW_NUMBER() OVER (ORDER BY i) AS position, text
        FROM ({listed}) WHERE text IS NOT NULL) WHERE position <= {most}"""


def batch_lines(source: str) -> str:
    share = f"100.0 * {amount_of('t_country')} / (SELECT {REV} FROM {source})"
    values: list[list[str]] = [
        [name_of("t_country"), grp(amount_of("t_country"), 2), fix(share, 1)],
        [name_of("t_campaign"), grp(amount_of("t_campaign"), 2)],
        [name_of("t_device"), grp(amount_of("t_device"), 2)],
        [name_of("t_traffic"), grp(amount_of("t_traffic"), 0)],
        [fix(of_k("avg_purchase_value"), 2), fix(of_k("arppu"), 2)],
        [fix(of_k("returning_pct"), 1)],
        [name_of("t_weekday")],
        [name_of("t_event"), grp(amount_of("t_event"), 0)],
        [name_of("t_subscription"), grp(amount_of("t_subscription"), 2)],
        [fix(of_k("conversion_rate"), 2)],
        [fix(of_k("avg_session_duration"), 1), fix(of_k("median_session_duration"), 1)],
        [name_of("t_traffic")],
        [name_of("t_campaign")],
        [],
        [],
        [fix(of_k("purchase_rate_pct"), 2)],
        [name_of("t_os"), grp(amount_of("t_os"), 0)],
        [fix(of_k("arpu"), 2), grp(of_k("total_users"), 0)],
        [name_of("t_city")],
        [fix(of_f("100 * (1 - CAST(s3 AS DOUBLE) / s0)"), 1)],
        [grp(of_k("revenue"), 2), grp(of_k("paying_users"), 0), grp(of_k("total_users"), 0)],
        [fix(of_k("mau"), 0), fix(of_k("dau"), 0), fix(of_k("100.0 * dau / mau"), 1)],
        [],
        [],
    ]
    return numbered([text(t, *v) for t, v in zip(BATCH_INSIGHTS, values, strict=True)])


add("batch_insights", CLICKS, batch_lines("cl"), extra=f"{CAPPED}, {facts('cl')}")
add(
    "insights_file", CLICKS,
    f"""SELECT 'PRODUCT ANALYTICS - AUTOMATED BUSINESS INSIGHTS' AS text UNION ALL SELECT repeat('=', 55) UNION ALL SELECT ''
    UNION ALL SELECT text FROM ({batch_lines('ev')})""",
    extra=facts(),
)


def live_lines(where: str) -> str:
    share = f"100.0 * {amount_of('t_country')} / (SELECT {REV} FROM ev WHERE {where})"

    def earning(t: str, line: str) -> str:
        return f"CASE WHEN {amount_of(t)} > 0 THEN {line} END"

    say = LIVE_INSIGHTS
    return numbered(
        [
            earning("t_country", text(say["country"], name_of("t_country"), grp(amount_of("t_country"), 2), fix(share, 1))),
            earning("t_device", text(say["device"], name_of("t_device"), grp(amount_of("t_device"), 2))),
            earning("t_campaign", text(say["campaign"], name_of("t_campaign"), grp(amount_of("t_campaign"), 2))),
            text(say["traffic"], name_of("t_traffic"), grp(amount_of("t_traffic"), 0)),
            text(say["event"], name_of("t_event"), grp(amount_of("t_event"), 0)),
            earning("t_subscription", text(say["subscription"], name_of("t_subscription"), grp(amount_of("t_subscription"), 2))),
            text(say["users"], grp(of_k("total_users"), 0), grp(of_k("revenue"), 2), fix(of_k("arpu"), 2)),
            text(say["conversion"], fix(of_k("conversion_rate"), 2), fix(of_k("avg_purchase_value"), 2)),
            text(say["activity"], fix(of_k("dau"), 0), fix(of_k("mau"), 0)),
            f"CASE WHEN {of_f('s0')} > 0 THEN "
            + text(say["funnel"], fix(of_f("100 * (1 - CAST(s3 AS DOUBLE) / NULLIF(s0, 0))"), 1), "'App Open'", "'Purchase'")
            + " END",
            f"CASE WHEN {of_k('returning_pct')} > 0 THEN {text(say['returning'], fix(of_k('returning_pct'), 1))} END",
            text(say["duration"], fix(of_k("avg_session_duration"), 1), fix(of_k("median_session_duration"), 1)),
        ]
    )


add("live_insights", CLICKS, live_lines(ALL), extra=facts())
add("live_insights_filtered", CLICKS, live_lines(CLICK_FILTER), CLICK_FILTER, extra=facts())
add("live_insights_orders", ORDERS, live_lines(ALL), extra=facts())


def advice_lines(where: str, before: str | None) -> str:
    say = ADVICE

    def when(condition: str, line: str) -> str:
        return f"CASE WHEN {condition} THEN {line} END"

    lines = []
    if before:
        change = f"(SELECT 100.0 * ((k.revenue - b.revenue) / NULLIF(b.revenue, 0)) FROM k, {before} b)"
        conversion = f"(SELECT 100.0 * ((k.conversion_rate - b.conversion_rate) / NULLIF(b.conversion_rate, 0)) FROM k, {before} b)"
        lines += [
            when(f"{change} > 0", text(say["revenue_up"], fix(change, 1))),
            when(f"{change} <= 0", text(say["revenue_down"], fix(f"ABS({change})", 1))),
            when(f"{conversion} < -1", text(say["conversion_down"], fix(f"ABS({conversion})", 1))),
            when(f"{conversion} > 1", text(say["conversion_up"], fix(conversion, 1))),
        ]
    paid = f"ev WHERE {where} AND campaign <> 'None'"
    paid_total = f"(SELECT {REV} FROM {paid})"
    weakest = f"(SELECT campaign FROM {paid} GROUP BY 1 ORDER BY SUM(revenue), campaign DESC LIMIT 1)"
    device = f"""(SELECT {{c}} FROM (SELECT device_type, {BUYERS} AS b, {USERS} AS u FROM ev WHERE {where} AND device_type IS NOT NULL GROUP BY 1)
        WHERE b > 0 ORDER BY CAST(b AS DOUBLE) / u DESC, device_type LIMIT 1)"""
    steps = " UNION ALL ".join(
        f"SELECT {i} AS i, '{a}' AS a, '{z}' AS z, (SELECT 100 * (1 - CAST(s{i} AS DOUBLE) / NULLIF(s{i - 1}, 0)) FROM fn) AS d"
        for i, (a, z) in enumerate((("App Open", "Search"), ("Search", "Add to Cart"), ("Add to Cart", "Purchase")), start=1)
    )
    step = f"(SELECT {{c}} FROM ({steps}) WHERE d > 0 ORDER BY d DESC, i LIMIT 1)"
    stickiness = of_k("100.0 * dau / mau")
    lines += [
        when(f"{paid_total} > 0", text(say["campaign_best"], name_of("t_campaign"), fix(f"100.0 * {amount_of('t_campaign')} / {paid_total}", 1))),
        when(f"{paid_total} > 0 AND (SELECT COUNT(DISTINCT campaign) FROM {paid}) > 1", text(say["campaign_worst"], weakest)),
        when(
            f"{of_k('revenue')} > 0",
            text(say["country"], name_of("t_country"), fix(f"100.0 * {amount_of('t_country')} / {of_k('revenue')}", 1)),
        ),
        text(say["device"], device.format(c="device_type"), fix(device.format(c="CAST(b AS DOUBLE) / u * 100"), 1)),
        when(f"{of_k('returning_pct')} <> 0", text(say["returning"], fix(of_k("returning_pct"), 1))) if before else "NULL",
        text(say["funnel"], fix(step.format(c="d"), 1), step.format(c="a"), step.format(c="z")),
        when(f"{amount_of('t_subscription')} > 0", text(say["subscription"], name_of("t_subscription"))),
        when(f"{stickiness} < 20", text(say["stickiness_low"], fix(stickiness, 1))),
        when(f"{stickiness} >= 20", text(say["stickiness_ok"], fix(stickiness, 1))),
        text(say["traffic"], name_of("t_traffic")),
    ]
    return numbered(lines, 12)


EARLIER = kpi_facts("b0", where=CLICK_RANGE_BEFORE)
add("recommendations", CLICKS, advice_lines(CLICK_RANGE, "b0"), CLICK_RANGE, extra=f"{facts()}, {EARLIER}")
add("recommendations_orders", ORDERS, advice_lines(ALL, None), extra=facts())
add(
    "live_report_text", CLICKS,
    f"""SELECT 'BUSINESS INSIGHTS' AS text UNION ALL SELECT repeat('=', 60) UNION ALL SELECT ''
    UNION ALL SELECT '- ' || text FROM ({live_lines(CLICK_RANGE)})
    UNION ALL SELECT '' UNION ALL SELECT 'EXECUTIVE RECOMMENDATIONS' UNION ALL SELECT repeat('=', 60) UNION ALL SELECT ''
    UNION ALL SELECT '- ' || text FROM ({advice_lines(CLICK_RANGE, 'b0')})""",
    CLICK_RANGE, extra=f"{facts()}, {EARLIER}",
)
_change = "(SELECT 100.0 * ((k.revenue - b0.revenue) / NULLIF(b0.revenue, 0)) FROM k, b0)"
_chips = [
    f"{sgn(_change, 1)} || '%'", name_of("t_country"), name_of("t_campaign"), name_of("t_device"), name_of("t_traffic"),
    name_of("t_subscription"), f"{fix(of_f('100 * (1 - CAST(s3 AS DOUBLE) / s0)'), 1)} || '%'",
    f"{fix(of_k('returning_pct'), 1)} || '%'", f"{fix(of_k('avg_session_duration'), 0)} || 's'",
]
add(
    "executive_summary", CLICKS,
    " UNION ALL ".join(
        f"SELECT CAST({i + 1} AS INT) AS position, {string(label)} AS label, {value} AS value"
        for i, (label, value) in enumerate(zip(SUMMARY_LABELS, _chips, strict=True))
    ),
    CLICK_RANGE, extra=f"{facts()}, {EARLIER}",
)
add(
    "report_insights", ORDERS,
    numbered(
        [
            text(REPORT_TEXT["revenue"], grp("(SELECT total_revenue FROM s)", 2), grp("(SELECT total_users FROM s)", 0)),
            text(REPORT_TEXT["arpu"], grp("(SELECT arpu FROM s)", 2), fix("(SELECT conversion_rate_pct FROM s)", 2)),
            text(REPORT_TEXT["country"], name_of("t_country"), grp(amount_of("t_country"), 2)),
            text(REPORT_TEXT["champions"], fix("(SELECT pct_of_total FROM seg WHERE rfm_segment = 'Champions')", 1)),
        ]
    ),
    extra=f"{rfm(LATEST)}, seg AS ({SEGMENTS}), s AS ({NAMED['kpi_snapshot']}), t_country AS {leader('country', REV)}",
)

# Files ---------------------------------------------------------------------
add(
    "segment_files", CLICKS,
    " UNION ALL ".join(
        f"SELECT '{name}' AS file, {d} AS segment, {USERS} AS users, COUNT(*) AS events, {REV} AS revenue FROM ev WHERE {d} IS NOT NULL GROUP BY 2"
        for name, d in (("top_countries", "country"), ("campaign_performance", "campaign"), ("device_summary", "device_type"))
    ),
)
add(
    "export_bundle", CLICKS,
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{name}' AS file, {d} AS segment, {REV} AS revenue, {USERS} AS users, {ARPU} AS arpu FROM ev GROUP BY 2 {limit})"
        for name, d, limit in (
            ("revenue_by_country", "country", ""),
            ("revenue_by_device", "device_type", ""),
            ("top_campaigns", "campaign", "ORDER BY revenue DESC, segment LIMIT 10"),
        )
    ),
)
_numbers = [
    "stickiness", "avg_session_duration", "returning_pct", "paying_users", "revenue_per_session", "revenue_per_purchase",
]
add(
    "json_report_file", CLICKS,
    f"""SELECT 'kpis' AS section, metric, value, CAST(NULL AS VARCHAR) AS text FROM ({rows(PLAIN, 'k')})
    UNION ALL SELECT 'previous_period_kpis', metric, value, NULL FROM ({rows(PLAIN, 'b0')})
    UNION ALL SELECT 'advanced_kpis', metric, value, NULL FROM ({rows({n: n for n in _numbers}, 'adv')})
    UNION ALL SELECT 'advanced_kpis', 'top_country', NULL, top_country FROM adv
    UNION ALL SELECT 'advanced_kpis', 'top_device', NULL, top_device FROM adv
    UNION ALL SELECT 'business_insights', CAST(position AS VARCHAR), NULL, text FROM ({live_lines(CLICK_RANGE)})
    UNION ALL SELECT 'executive_recommendations', CAST(position AS VARCHAR), NULL, text FROM ({advice_lines(CLICK_RANGE, 'b0')})""",
    CLICK_RANGE, extra=f"{facts()}, {EARLIER}, adv AS ({ADVANCED})",
)
