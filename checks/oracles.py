"""For each registered query, the same result as SQL for DuckDB.

The SQL follows the definitions step by step over row-level joins. It shares no
step with the Spark plans, which pre-aggregate before they join.
"""


def _money(column: str) -> str:
    return f"coalesce(CAST(sum(CAST({column} AS DECIMAL(18, 2))) AS DOUBLE), 0)"


def _same(left: str, right: str, *columns: str) -> str:
    return " AND ".join(f"{left}.{c} IS NOT DISTINCT FROM {right}.{c}" for c in columns)


SAMPLE_INPUTS = """
profiles AS (
  SELECT CAST(c_custkey AS VARCHAR) AS profile_id, c_mktsegment AS acquisition_source,
         n_name AS signup_country_code,
         CASE c_custkey % 3 WHEN 0 THEN 'iOS' WHEN 1 THEN 'Android' ELSE 'Web' END
           AS signup_platform,
         first_activity_time
  FROM customer
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_activity_time
             FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey),
payments AS (
  SELECT CAST(o_custkey - o_custkey % 2 AS VARCHAR) AS profile_id,
         CAST(o_orderdate AS DATE) AS reported_date,
         o_totalprice AS gross_bookings_usd
  FROM orders),
activity AS (
  SELECT CAST(o_custkey AS VARCHAR) AS profile_id, CAST(l_shipdate AS DATE) AS activity_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""

TOUCH_INPUTS = """
customer_orders AS (
  SELECT orders.*, n_name, c_nationkey,
         CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN CAST(o_custkey AS VARCHAR) END AS profile_id
  FROM orders JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey),
profiles AS (
  SELECT profile_id, nullif(o_orderpriority, '4-NOT SPECIFIED') AS acquisition_source,
         nullif(n_name, 'NATION_7') AS signup_country_code,
         CASE WHEN year(o_orderdate) < 1998 THEN 'iOS' ELSE 'Android' END AS signup_platform,
         o_orderdate AS first_activity_time
  FROM customer_orders),
payments AS (
  SELECT CASE WHEN o_custkey % 7 = 0 THEN 'x' || profile_id ELSE profile_id END AS profile_id,
         CAST(o_orderdate AS DATE) AS reported_date,
         round(nullif(o_totalprice, round(o_totalprice, 0)) * c_nationkey, 2) AS gross_bookings_usd
  FROM customer_orders),
activity AS (
  SELECT CASE WHEN o_custkey % 7 = 0 THEN 'x' || profile_id ELSE profile_id END AS profile_id,
         CAST(l_shipdate AS DATE) AS activity_date
  FROM lineitem JOIN customer_orders ON l_orderkey = o_orderkey)
"""

DERIVED = f"""
dim AS (
  SELECT * EXCLUDE (place) FROM (
    SELECT *, CAST(first_activity_time AS DATE) AS first_activity_date,
           count(*) OVER (PARTITION BY profile_id) AS n_profile_rows,
           row_number() OVER (
             PARTITION BY profile_id
             ORDER BY acquisition_source NULLS LAST, signup_country_code NULLS LAST,
                      signup_platform NULLS LAST, first_activity_time NULLS LAST) AS place
    FROM profiles) WHERE place = 1),
profile_dim AS (
  SELECT profile_id, acquisition_source, signup_country_code, signup_platform,
         first_activity_time, first_activity_date, n_profile_rows,
         CAST(1 AS BIGINT) AS n_acquisition_source, CAST(1 AS BIGINT) AS n_country
  FROM dim),
paid AS (
  SELECT p.*, d.acquisition_source, d.signup_country_code, d.signup_platform,
         d.first_activity_date, CAST(date_trunc('week', d.first_activity_date) AS DATE) AS cohort_week,
         CAST(datediff('day', d.first_activity_date, p.reported_date) AS INTEGER) AS day
  FROM payments p LEFT JOIN dim d ON {_same("p", "d", "profile_id")}),
active AS (
  SELECT a.*, d.acquisition_source, d.signup_platform, d.first_activity_date,
         CAST(date_trunc('week', d.first_activity_date) AS DATE) AS cohort_week,
         CAST(datediff('day', d.first_activity_date, a.activity_date) AS INTEGER) AS day
  FROM activity a LEFT JOIN dim d ON {_same("a", "d", "profile_id")}),
paid_weeks AS (
  SELECT *, CAST(floor(day / 7.0) AS INTEGER) AS week_since_install
  FROM paid WHERE floor(day / 7.0) BETWEEN 0 AND 12),
active_weeks AS (
  SELECT *, CAST(floor(day / 7.0) AS INTEGER) AS week_since_install
  FROM active WHERE floor(day / 7.0) BETWEEN 0 AND 12),
installs_by_segment AS (
  SELECT acquisition_source, signup_country_code, count(*) AS installs
  FROM dim GROUP BY ALL),
revenue_by_segment AS (
  SELECT acquisition_source, signup_country_code,
         {_money("gross_bookings_usd")} AS total_revenue_usd
  FROM paid GROUP BY ALL),
segment_rpi AS (
  SELECT i.*, coalesce(r.total_revenue_usd, 0) AS total_revenue_usd,
         coalesce(r.total_revenue_usd, 0) / i.installs AS revenue_per_install_usd
  FROM installs_by_segment i LEFT JOIN revenue_by_segment r
    ON {_same("i", "r", "acquisition_source", "signup_country_code")}),
payer_rate_by_segment AS (
  SELECT acquisition_source, signup_country_code,
         CAST(sum(payer) AS BIGINT) AS payers, avg(payer) AS payer_rate
  FROM (SELECT d.*, CAST(p.payer IS NOT NULL AS INTEGER) AS payer
        FROM dim d LEFT JOIN (SELECT DISTINCT profile_id, 1 AS payer FROM payments) p
          ON {_same("d", "p", "profile_id")})
  GROUP BY ALL),
segment_enhanced AS (
  SELECT s.*, p.payers, p.payer_rate, s.installs / (SELECT sum(installs) FROM segment_rpi)
           AS install_share
  FROM segment_rpi s LEFT JOIN payer_rate_by_segment p
    ON {_same("s", "p", "acquisition_source", "signup_country_code")}),
segment_thresholds AS (
  SELECT median(revenue_per_install_usd) AS rpi_median,
         quantile_cont(CAST(installs AS DOUBLE), 0.75) AS install_q75,
         quantile_cont(CAST(installs AS DOUBLE), 0.25) AS install_q25,
         quantile_cont(revenue_per_install_usd, 0.9) AS rpi_q90
  FROM segment_rpi),
segment_anomalies AS (
  SELECT s.* FROM segment_rpi s, segment_thresholds t
  WHERE (installs >= install_q75 AND revenue_per_install_usd <= rpi_median)
     OR (installs <= install_q25 AND revenue_per_install_usd >= rpi_q90)),
channel_totals AS (
  SELECT acquisition_source, CAST(sum(installs) AS BIGINT) AS installs,
         {_money("total_revenue_usd")} AS total_revenue_usd,
         {_money("total_revenue_usd")} / sum(installs) AS revenue_per_install_usd
  FROM segment_rpi GROUP BY ALL),
channel_efficiency AS (
  SELECT *, CAST(0 AS DOUBLE) AS rpi_std, revenue_per_install_usd AS rpi_min,
         revenue_per_install_usd AS rpi_max FROM channel_totals),
country_units AS (
  SELECT acquisition_source, CAST(installs AS HUGEINT) AS w, revenue_per_install_usd AS rpi,
         CAST(floor(revenue_per_install_usd * 1e9 + 0.5) AS HUGEINT) AS x
  FROM segment_rpi),
country_sums AS (
  SELECT acquisition_source, CAST(sum(w) AS HUGEINT) AS weight, CAST(sum(w * x) AS HUGEINT) AS total,
         min(rpi) AS rpi_min, max(rpi) AS rpi_max
  FROM country_units GROUP BY ALL),
country_squares AS (
  SELECT s.*, total - total // weight * weight AS off,
         CAST(sum(w * (x - total // weight) * (x - total // weight)) AS HUGEINT) AS square
  FROM country_sums s JOIN country_units u ON {_same("s", "u", "acquisition_source")} GROUP BY ALL),
channel_efficiency_per_country AS (
  SELECT c.*, floor(sqrt(greatest(CAST(square AS DOUBLE)
             - CAST(off AS DOUBLE) * CAST(off AS DOUBLE) / CAST(weight AS DOUBLE), 0)
           / CAST(weight AS DOUBLE)) + 0.5) / 1e9 AS rpi_std, rpi_min, rpi_max
  FROM channel_totals c JOIN country_squares s ON {_same("c", "s", "acquisition_source")}),
channel_efficiency_enhanced AS (
  SELECT *, CASE WHEN revenue_per_install_usd > 0 THEN rpi_std / revenue_per_install_usd END AS rpi_cv
  FROM channel_efficiency),
channel_efficiency_enhanced_per_country AS (
  SELECT *, CASE WHEN revenue_per_install_usd > 0 THEN rpi_std / revenue_per_install_usd END AS rpi_cv
  FROM channel_efficiency_per_country),
channel_rank AS (
  SELECT acquisition_source, installs, total_revenue_usd, revenue_per_install_usd, rpi_std, rpi_cv
  FROM channel_efficiency_enhanced),
payer_rate_by_channel AS (
  SELECT acquisition_source, CAST(sum(installs) AS BIGINT) AS installs,
         CAST(sum(payers) AS BIGINT) AS payers, sum(payers) / sum(installs) AS payer_rate
  FROM segment_enhanced GROUP BY ALL),
top_segments AS (
  SELECT *, coalesce(acquisition_source, 'NA') || ' | ' || coalesce(signup_country_code, 'NA')
              AS segment
  FROM segment_rpi
  ORDER BY installs DESC, acquisition_source NULLS LAST, signup_country_code NULLS LAST LIMIT 15),
payments_enriched AS (
  SELECT profile_id, reported_date, gross_bookings_usd, acquisition_source, first_activity_date,
         day AS days_since_first_activity FROM paid),
payments_90 AS (
  SELECT * FROM payments_enriched WHERE days_since_first_activity BETWEEN 0 AND 90),
activity_enriched AS (
  SELECT profile_id, activity_date, acquisition_source, first_activity_date,
         day AS days_since_first_activity FROM active),
payers_90 AS (
  SELECT acquisition_source,
         count(DISTINCT profile_id) + max(CAST(profile_id IS NULL AS INTEGER)) AS payers_90,
         {_money("gross_bookings_usd")} AS revenue_90_usd
  FROM payments_90 GROUP BY ALL),
installs_by_channel AS (
  SELECT acquisition_source, count(*) AS installs FROM dim GROUP BY ALL),
ltv_90 AS (
  SELECT installs_by_channel.*, coalesce(payers_90, 0) AS payers_90,
         coalesce(revenue_90_usd, 0) AS revenue_90_usd,
         coalesce(revenue_90_usd, 0) / installs AS ltv_90_usd,
         coalesce(payers_90, 0) / installs AS payer_rate_90,
         CASE WHEN payers_90 > 0 THEN revenue_90_usd / payers_90 ELSE 0 END AS arppu_90_usd
  FROM installs_by_channel LEFT JOIN payers_90
    ON {_same("installs_by_channel", "payers_90", "acquisition_source")}),
retention_30_37 AS (
  SELECT acquisition_source,
         count(DISTINCT profile_id) + max(CAST(profile_id IS NULL AS INTEGER))
           AS retained_users_30_37
  FROM active WHERE day BETWEEN 30 AND 37 GROUP BY ALL),
ltv_model AS (
  SELECT l.*, coalesce(retained_users_30_37, 0) AS retained_users_30_37,
         coalesce(retained_users_30_37, 0) / installs AS retention_30_37,
         coalesce(retained_users_30_37, 0) / installs * payer_rate_90 * arppu_90_usd
           AS predicted_ltv_retention_arppu
  FROM ltv_90 l LEFT JOIN retention_30_37 r ON {_same("l", "r", "acquisition_source")}),
centred AS (
  SELECT *, ltv_90_usd - avg(ltv_90_usd) OVER () AS y,
         retention_30_37 - avg(retention_30_37) OVER () AS z1,
         payer_rate_90 - avg(payer_rate_90) OVER () AS x2,
         arppu_90_usd - avg(arppu_90_usd) OVER () AS x3
  FROM ltv_model),
second AS (
  SELECT *, x2 - z1 * coalesce(sum(x2 * z1) OVER () / nullif(sum(z1 * z1) OVER (), 0), 0) AS z2
  FROM centred),
third AS (
  SELECT *, x3 - z1 * coalesce(sum(x3 * z1) OVER () / nullif(sum(z1 * z1) OVER (), 0), 0)
               - z2 * coalesce(sum(x3 * z2) OVER () / nullif(sum(z2 * z2) OVER (), 0), 0) AS z3
  FROM second),
ltv_regression AS (
  SELECT * EXCLUDE (y, z1, x2, x3, z2, z3), avg(ltv_90_usd) OVER ()
    + z1 * coalesce(sum(y * z1) OVER () / nullif(sum(z1 * z1) OVER (), 0), 0)
    + z2 * coalesce(sum(y * z2) OVER () / nullif(sum(z2 * z2) OVER (), 0), 0)
    + z3 * coalesce(sum(y * z3) OVER () / nullif(sum(z3 * z3) OVER (), 0), 0)
      AS predicted_ltv_regression
  FROM third),
ltv_rank AS (
  SELECT CAST(row_number() OVER (ORDER BY ltv_90_usd DESC, acquisition_source NULLS LAST) AS INTEGER)
           AS ltv_rank,
         acquisition_source, installs, payers_90, payer_rate_90, arppu_90_usd, revenue_90_usd,
         ltv_90_usd
  FROM ltv_90),
channel_weeks AS (
  SELECT acquisition_source, week_since_install, {_money("gross_bookings_usd")} AS weekly_revenue_usd
  FROM paid_weeks GROUP BY ALL),
cumulative_ltv_curve AS (
  SELECT w.*, i.installs,
         CAST(sum(CAST(weekly_revenue_usd AS DECIMAL(18, 2))) OVER upto AS DOUBLE)
           AS cumulative_revenue_usd,
         CAST(sum(CAST(weekly_revenue_usd AS DECIMAL(18, 2))) OVER upto AS DOUBLE) / i.installs
           AS cumulative_ltv_usd
  FROM channel_weeks w LEFT JOIN installs_by_channel i ON {_same("w", "i", "acquisition_source")}
  WINDOW upto AS (PARTITION BY w.acquisition_source ORDER BY week_since_install
                  ROWS UNBOUNDED PRECEDING)),
ltv_drivers AS (
  SELECT l.*, CASE
      WHEN payer_rate_90 >= m1 AND arppu_90_usd >= m2 THEN 'Strong payer rate and ARPPU'
      WHEN payer_rate_90 >= m1 THEN 'Driven more by payer conversion'
      WHEN arppu_90_usd >= m2 THEN 'Driven more by ARPPU'
      ELSE 'Weak on both drivers' END AS monetization_comment
  FROM ltv_90 l,
       (SELECT median(payer_rate_90) AS m1, median(arppu_90_usd) AS m2 FROM ltv_90)),
cohort_base AS (
  SELECT *, first_activity_date AS install_date,
         CAST(date_trunc('week', first_activity_date) AS DATE) AS cohort_week FROM profile_dim),
cohort_sizes AS (
  SELECT cohort_week, acquisition_source, signup_platform, count(*) AS cohort_users
  FROM cohort_base GROUP BY ALL),
activity_lifecycle AS (
  SELECT profile_id, activity_date, cohort_week, acquisition_source, signup_platform,
         first_activity_date AS install_date, day AS days_since_install, week_since_install
  FROM active_weeks),
retained AS (
  SELECT cohort_week, acquisition_source, signup_platform, week_since_install,
         count(DISTINCT profile_id) + max(CAST(profile_id IS NULL AS INTEGER)) AS retained_users
  FROM active_weeks GROUP BY ALL),
retention_weekly AS (
  SELECT r.*, c.cohort_users, r.retained_users / c.cohort_users AS retention_rate
  FROM retained r LEFT JOIN cohort_sizes c
    ON {_same("r", "c", "cohort_week", "acquisition_source", "signup_platform")}),
payments_weekly AS (
  SELECT cohort_week, acquisition_source, signup_platform, week_since_install,
         {_money("gross_bookings_usd")} AS weekly_revenue_usd
  FROM paid_weeks GROUP BY ALL),
cohort_retention_revenue AS (
  SELECT r.*, coalesce(p.weekly_revenue_usd, 0) AS weekly_revenue_usd,
         coalesce(p.weekly_revenue_usd, 0) / r.retained_users AS avg_revenue_per_retained_user
  FROM retention_weekly r LEFT JOIN payments_weekly p
    ON {_same("r", "p", "cohort_week", "acquisition_source", "signup_platform",
              "week_since_install")}),
retention_channel_summary AS (
  SELECT acquisition_source, signup_platform, week_since_install,
         avg(retention_rate) AS mean_retention_rate,
         avg(avg_revenue_per_retained_user) AS mean_arpru_weekly
  FROM cohort_retention_revenue GROUP BY ALL),
retention_ios_android AS (
  SELECT * FROM retention_channel_summary WHERE signup_platform IN ('iOS', 'Android')),
retention_platform_weighted AS (
  SELECT signup_platform, week_since_install,
         CAST(sum(retained_users) AS BIGINT) AS retained_users_total,
         CAST(sum(cohort_users) AS BIGINT) AS cohort_users_total,
         sum(retained_users) / sum(cohort_users) AS weighted_retention_rate
  FROM retention_weekly GROUP BY ALL),
retention_platform_week1plus AS (
  SELECT * FROM retention_platform_weighted WHERE week_since_install >= 1),
platform_installs AS (
  SELECT acquisition_source, signup_platform, count(*) AS installs FROM dim GROUP BY ALL),
platform_weeks AS (
  SELECT acquisition_source, signup_platform, week_since_install,
         {_money("gross_bookings_usd")} AS weekly_revenue_usd
  FROM paid_weeks GROUP BY ALL),
weekly_rpu AS (
  SELECT w.*, i.installs, w.weekly_revenue_usd / i.installs AS revenue_per_installed_user
  FROM platform_weeks w LEFT JOIN platform_installs i
    ON {_same("w", "i", "acquisition_source", "signup_platform")}),
weekly_rpu_platform AS (
  SELECT signup_platform, week_since_install, avg(revenue_per_installed_user) AS mean_rpu
  FROM weekly_rpu GROUP BY ALL),
week1_scorecard AS (SELECT * FROM retention_channel_summary WHERE week_since_install = 1),
week1_channel_platform AS (SELECT * FROM week1_scorecard),
retention_curve_platform AS (
  SELECT signup_platform, week_since_install, avg(retention_rate) AS mean_retention_rate
  FROM retention_weekly GROUP BY ALL),
arpru_platform AS (
  SELECT signup_platform, week_since_install, avg(avg_revenue_per_retained_user) AS mean_arpru
  FROM cohort_retention_revenue GROUP BY ALL),
retention_heatmap AS (
  SELECT acquisition_source, week_since_install, avg(mean_retention_rate) AS mean_retention_rate
  FROM retention_channel_summary GROUP BY ALL),
summary_q1 AS (
  SELECT acquisition_source, installs, revenue_per_install_usd, rpi_std, rpi_cv FROM channel_rank),
summary_q2 AS (
  SELECT acquisition_source, installs, payer_rate_90, arppu_90_usd, ltv_90_usd FROM ltv_rank),
summary_q3 AS (
  SELECT acquisition_source, signup_platform, mean_retention_rate, mean_arpru_weekly
  FROM week1_scorecard)
"""


def _recommendation(efficiency: str) -> str:
    return f"""
      SELECT l.*, e.revenue_per_install_usd, e.rpi_std,
             CASE WHEN l.acquisition_source IN ('AUTOMOBILE', 'BUILDING')
                    THEN 'Scale gradually (+10% to +20%) with guardrails'
                  WHEN l.acquisition_source IN ('FURNITURE', 'MACHINERY')
                    THEN 'Hold or trim pending diagnosis'
                  ELSE 'Maintain as stable base and test creative/offers' END AS recommendation,
             CASE WHEN e.rpi_std >= (SELECT median(rpi_std) FROM {efficiency})
                    THEN 'High volatility; watch marginal returns'
                  ELSE 'More stable' END AS caution
      FROM ltv_90 l LEFT JOIN {efficiency} e ON {_same("l", "e", "acquisition_source")}"""


# Results that are one of the steps above under the query's own name.
STEPS = [
    "profile_dim",
    "installs_by_segment",
    "revenue_by_segment",
    "segment_rpi",
    "channel_efficiency",
    "channel_efficiency_per_country",
    "segment_thresholds",
    "segment_anomalies",
    "payer_rate_by_segment",
    "segment_enhanced",
    "channel_efficiency_enhanced",
    "channel_efficiency_enhanced_per_country",
    "channel_rank",
    "payer_rate_by_channel",
    "top_segments",
    "payments_enriched",
    "payments_90",
    "activity_enriched",
    "payers_90",
    "installs_by_channel",
    "ltv_90",
    "retention_30_37",
    "ltv_model",
    "ltv_regression",
    "ltv_rank",
    "cumulative_ltv_curve",
    "ltv_drivers",
    "cohort_base",
    "cohort_sizes",
    "activity_lifecycle",
    "retention_weekly",
    "payments_weekly",
    "cohort_retention_revenue",
    "retention_channel_summary",
    "retention_ios_android",
    "retention_platform_weighted",
    "retention_platform_week1plus",
    "weekly_rpu",
    "weekly_rpu_platform",
    "week1_scorecard",
    "retention_curve_platform",
    "arpru_platform",
    "week1_channel_platform",
    "retention_heatmap",
    "summary_q1",
    "summary_q2",
    "summary_q3",
]

OTHERS = {
    "profile_conflicts_detected": f"""
      SELECT d.*, c.n_acquisition_source, c.n_country
      FROM (SELECT * EXCLUDE (n_acquisition_source, n_country) FROM profile_dim) d
      JOIN (SELECT profile_id,
                   count(DISTINCT acquisition_source)
                     + max(CAST(acquisition_source IS NULL AS INTEGER)) AS n_acquisition_source,
                   count(DISTINCT signup_country_code)
                     + max(CAST(signup_country_code IS NULL AS INTEGER)) AS n_country
            FROM profiles GROUP BY profile_id) c ON {_same("d", "c", "profile_id")}
      WHERE n_acquisition_source > 1 OR n_country > 1""",
    "install_correlations": """
      SELECT 'corr_installs_revenue' AS metric, corr(installs, total_revenue_usd) AS value
      FROM segment_rpi
      UNION ALL
      SELECT 'corr_installs_rpi', corr(installs, revenue_per_install_usd) FROM segment_rpi""",
    "channel_recommendation": _recommendation("channel_efficiency"),
    "channel_recommendation_per_country": _recommendation("channel_efficiency_per_country"),
    "summary_q5": f"""
      SELECT acquisition_source, installs, ltv_90_usd, revenue_per_install_usd, recommendation,
             caution FROM ({_recommendation("channel_efficiency")})""",
    "feed_top_installs": "SELECT segment, installs FROM top_segments",
    "feed_channel_rpi": "SELECT acquisition_source, revenue_per_install_usd FROM channel_efficiency",
    "feed_channel_volatility": "SELECT acquisition_source, rpi_std FROM channel_efficiency",
    "feed_payer_rate": "SELECT acquisition_source, payer_rate FROM payer_rate_by_channel",
    "feed_ltv_90": "SELECT acquisition_source, ltv_90_usd FROM ltv_90",
    "feed_installs_vs_rpi": """
      SELECT acquisition_source, signup_country_code, installs, log10(installs) AS log10_installs,
             revenue_per_install_usd FROM segment_rpi""",
    "feed_ltv_vs_installs": """
      SELECT acquisition_source, installs, log10(installs) AS log10_installs, ltv_90_usd
      FROM ltv_90""",
}

SUBSCRIPTIONS = """
subscriptions AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
         o_orderpriority AS subscription_type, count(DISTINCT o_custkey) AS active_subscriptions
  FROM orders GROUP BY ALL),
net_change_by_year AS (
  SELECT year, subscription_type, max(active_subscriptions) FILTER (first = 1) AS start_of_year,
         max(active_subscriptions) FILTER (last = 1) AS end_of_year,
         max(active_subscriptions) FILTER (last = 1) - max(active_subscriptions) FILTER (first = 1)
           AS net_change
  FROM (SELECT CAST(year(date) AS INTEGER) AS year, subscription_type, active_subscriptions,
               row_number() OVER (PARTITION BY year(date), subscription_type ORDER BY date) AS first,
               row_number() OVER (PARTITION BY year(date), subscription_type ORDER BY date DESC)
                 AS last
        FROM subscriptions)
  GROUP BY ALL)
"""

ON_SUBSCRIPTIONS = {
    "current_subscriptions": """
      SELECT max(date) AS date, CAST(sum(active_subscriptions) AS BIGINT) AS total_subscriptions,
             format('{:,}', CAST(sum(active_subscriptions) AS BIGINT)) AS total_text
      FROM subscriptions WHERE date = (SELECT max(date) FROM subscriptions)""",
    "most_popular_type": """
      SELECT subscription_type, CAST(sum(active_subscriptions) AS BIGINT) AS total
      FROM subscriptions GROUP BY ALL ORDER BY total DESC, subscription_type LIMIT 1""",
    "months_tracked": "SELECT count(DISTINCT date) AS months_tracked FROM subscriptions",
    "subscription_trend": """
      SELECT date, subscription_type, active_subscriptions FROM subscriptions""",
    "subscription_trend_one_type": """
      SELECT date, subscription_type, active_subscriptions FROM subscriptions
      WHERE subscription_type = '1-URGENT'
        AND date >= DATE '1997-03-01' AND date <= DATE '1998-06-01'""",
    "net_change_by_year": "SELECT * FROM net_change_by_year",
    "net_change_pivot": """
      SELECT year, max(net_change) FILTER (subscription_type = '1-URGENT') AS "1-URGENT",
             max(net_change) FILTER (subscription_type = '2-HIGH') AS "2-HIGH",
             max(net_change) FILTER (subscription_type = '3-MEDIUM') AS "3-MEDIUM",
             max(net_change) FILTER (subscription_type = '4-NOT SPECIFIED') AS "4-NOT SPECIFIED",
             max(net_change) FILTER (subscription_type = '5-LOW') AS "5-LOW"
      FROM net_change_by_year GROUP BY year""",
    "selector_types": """
      SELECT 'All' AS subscription_type, CAST(NULL AS DATE) AS first_seen
      UNION ALL
      SELECT subscription_type, min(date) FROM subscriptions GROUP BY subscription_type""",
    "selector_years": "SELECT DISTINCT CAST(year(date) AS INTEGER) AS year FROM subscriptions",
}

CARDINALITY = """
  SELECT profile_id, count(*) AS n_rows FROM profiles GROUP BY profile_id HAVING count(*) > 1"""

EXPERIMENT = f"""
WITH {SAMPLE_INPUTS}
SELECT CASE WHEN r_name IN ('AMERICA', 'EUROPE') THEN 'treatment' ELSE 'control' END AS "group",
       CAST(floor(datediff('day', DATE '1995-01-01', CAST(first_activity_time AS DATE)) / 7.0)
            AS INTEGER) AS week,
       CAST(count(*) AS DOUBLE) AS installs, n_name AS geo_cell
FROM profiles JOIN nation ON signup_country_code = n_name JOIN region ON n_regionkey = r_regionkey
WHERE first_activity_time IS NOT NULL
GROUP BY ALL
"""


def marketing_sql(query: str, inputs: str = SAMPLE_INPUTS) -> str:
    """SQL of a marketing query over the given input tables."""
    last = OTHERS.get(query) or f"SELECT * FROM {query}"
    return f"WITH {inputs},{DERIVED} {last}"


def subscription_sql(query: str) -> str:
    return f"WITH {SUBSCRIPTIONS} {ON_SUBSCRIPTIONS[query]}"


def rounded_sql(sql: str, digits: dict[str, int]) -> str:
    """``sql`` with columns rounded just as the Spark side rounds them."""
    if not digits:
        return sql
    rounds = ", ".join(f"round({c} + 1e-{d + 3}, {d}) AS {c}" for c, d in digits.items())
    return f"SELECT * REPLACE ({rounds}) FROM ({sql})"
