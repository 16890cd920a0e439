"""The queries once more as plain SQL over the parquet tables, for checking."""

from __future__ import annotations


def r(expr: str, digits: int) -> str:
    """Decimal half-up rounding of a double, by way of its shortest text."""
    return (
        f"CAST(round(CAST(CAST(CAST(({expr}) AS DOUBLE) AS VARCHAR) AS DECIMAL(38,22)), {digits}) AS DOUBLE)"
    )


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def pct(a: str, b: str, digits: int = 1) -> str:
    return r(f"(CAST(100 AS DOUBLE) * CAST({a} AS DOUBLE)) / nullif(CAST({b} AS DOUBLE), 0)", digits)


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


# Views, each with the views it reads.
VIEWS: dict[str, tuple[list[str], str]] = {
    "ev": (
        [],
        """
        SELECT event_id,
          'DEV_' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS device_id,
          'ERR_' || upper(event_type) || '_' || CAST(100 + event_id % 10 AS VARCHAR) AS error_code,
          ts AS "timestamp",
          CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
          '10.' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS VARCHAR) || '.'
                || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS firmware_version,
          CASE WHEN event_id % 20 < 1 THEN 'critical' WHEN event_id % 20 < 5 THEN 'high'
               WHEN event_id % 20 < 12 THEN 'medium' ELSE 'low' END AS severity,
          CASE user_id % 5 WHEN 0 THEN 'Halo One' WHEN 1 THEN 'Halo Mini' WHEN 2 THEN 'Halo Max'
               WHEN 3 THEN 'Beam Stick' ELSE 'Beam Panel' END AS model,
          user_id, value
        FROM events""",
    ),
    "ev_region": (
        ["ev"],
        """
        SELECT ev.*, region FROM ev LEFT JOIN (
          SELECT c_custkey, r_name AS region FROM customer
          JOIN nation ON c_nationkey = n_nationkey
          JOIN region ON n_regionkey = r_regionkey) ON user_id = c_custkey""",
    ),
    "rel": (
        ["ev"],
        """
        SELECT firmware_version, release_date,
          coalesce(lag(firmware_version) OVER w, '9.9.9') AS previous_version,
          CAST(coalesce(date_diff('day', lag(release_date) OVER w, release_date), 7) AS DOUBLE)
            AS days_since_previous_release
        FROM (SELECT DISTINCT k, firmware_version,
                CAST(DATE '2024-01-01' + CAST(k * 3 // 10 AS INTEGER) AS DATE) AS release_date FROM ev)
        WINDOW w AS (PARTITION BY k // 10 ORDER BY release_date, k)""",
    ),
    "tk": (
        ["ev"],
        """
        SELECT CAST(event_id AS VARCHAR) AS ticket_id, device_id, error_code,
          "timestamp" + to_days(CAST(1 + event_id % 7 AS INTEGER)) AS created_at,
          CAST(1 + (event_id // 3) % 3 AS INTEGER) AS tier,
          CASE WHEN event_id % 7 = 0 THEN 'rma' WHEN (event_id // 3) % 3 = 0 THEN 'fixed'
               WHEN (event_id // 3) % 3 = 1 THEN 'no_issue' ELSE 'workaround' END AS resolution,
          CAST(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS rma_issued
        FROM ev WHERE value >= 50""",
    ),
    "base": (
        [],
        """
        SELECT *,
          CAST(2000 AS DOUBLE) + code_churn_score * 1500
            + (CASE WHEN is_hotfix THEN 1 ELSE 0 END) * 1000
            + (release_seq * 53) % 300 AS error_rate_per_10k
        FROM (
          SELECT *, (CAST(lines_changed AS DOUBLE) / greatest(days_since_previous_release, 1.0::DOUBLE)
                     + CAST(files_changed AS DOUBLE)) / CAST(2000 AS DOUBLE) AS code_churn_score
          FROM (
            SELECT o_orderkey AS release_seq, CAST(o_orderkey AS VARCHAR) AS firmware_version,
              o_orderpriority AS product_line, CAST(o_orderdate AS DATE) AS release_date,
              o_totalprice / 20000 AS patch_size_mb,
              o_orderpriority = '1-URGENT' AS is_hotfix, o_orderpriority = '2-HIGH' AS patch_security,
              CAST(coalesce(date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER w,
                CAST(o_orderdate AS DATE)), 7) AS DOUBLE) AS days_since_previous_release,
              CAST(coalesce(files, 0) AS BIGINT) AS files_changed,
              CAST(coalesce(10 * quantity, 0) AS BIGINT) AS lines_changed,
              CAST(90 + (o_orderkey * 37) % 660 AS DOUBLE) AS avg_device_age_days
            FROM orders LEFT JOIN (
              SELECT l_orderkey, count(*) AS files, sum(l_quantity) AS quantity
              FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
            WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)))""",
    ),
    "patch": (
        ["base"],
        """
        SELECT *, post_errors - pre_errors AS delta_errors,
          CAST(post_errors + 1 AS DOUBLE) / CAST(pre_errors + 1 AS DOUBLE) AS post_pre_ratio,
          CAST(rmas AS DOUBLE) / nullif(CAST(tickets AS DOUBLE), 0) AS rma_rate
        FROM (
          SELECT *, CAST(floor(CAST(tickets AS DOUBLE) * (CAST(release_seq % 10 AS DOUBLE)
                      / CAST(100 AS DOUBLE))) AS BIGINT) AS rmas
          FROM (
            SELECT *,
              coalesce(lag(firmware_version) OVER w, '9.9.9') AS previous_version,
              coalesce(lag(error_rate_per_10k) OVER w, 0) AS previous_version_error_rate,
              (release_seq * 7) % 40 AS pre_errors,
              CAST(floor(error_rate_per_10k / 100) AS BIGINT) AS post_errors,
              CAST(floor(error_rate_per_10k / 50) AS BIGINT) AS error_events,
              CAST(floor(error_rate_per_10k / 100) AS BIGINT) * 4 AS tickets
            FROM base WINDOW w AS (PARTITION BY product_line ORDER BY release_date, release_seq)))""",
    ),
    "scored": (
        ["base"],
        """
        SELECT *, CAST(CASE WHEN risk_score >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS high_risk_flag
        FROM (SELECT *, CAST((release_seq * 101) % 1000 AS DOUBLE) / 1000 AS risk_score FROM base)""",
    ),
    "pred": (
        ["scored"],
        """
        SELECT firmware_version, error_rate_per_10k,
          error_rate_per_10k + (release_seq * 29) % 200 - 100 AS estimate,
          CAST(CASE WHEN error_rate_per_10k >= 3000 THEN 1 ELSE 0 END AS INTEGER) AS label,
          risk_score, high_risk_flag AS predicted FROM scored""",
    ),
    "hist": (["patch"], "SELECT * FROM patch WHERE release_date < DATE '2001-01-01'"),
    "fresh": (["patch"], "SELECT * FROM patch WHERE release_date >= DATE '2001-01-01'"),
    "labelled": (
        ["patch"],
        """
        SELECT *, CAST(CASE WHEN error_rate_per_10k >= (SELECT quantile_cont(error_rate_per_10k, 0.75)
          FROM patch) THEN 1 ELSE 0 END AS INTEGER) AS high_risk_flag FROM patch""",
    ),
    "vpatch": (
        ["patch"],
        """
        SELECT * REPLACE ('10.' || CAST((release_seq % 120) // 10 AS VARCHAR) || '.'
                 || CAST((release_seq % 120) % 10 AS VARCHAR) AS firmware_version) FROM patch""",
    ),
    "qa": (
        ["scored"],
        """
        SELECT *, CASE WHEN QA_priority_score >= 0.85 THEN 'Critical' WHEN QA_priority_score >= 0.65
          THEN 'High' WHEN QA_priority_score >= 0.40 THEN 'Medium' ELSE 'Low' END AS QA_bucket
        FROM (
          SELECT *, 0.6::DOUBLE * risk_score + 0.4::DOUBLE * churn_norm AS QA_priority_score
          FROM (
            SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (code_churn_score - 0.14::DOUBLE)
              / (0.87::DOUBLE - 0.14::DOUBLE + 1e-6::DOUBLE))) AS churn_norm FROM scored))""",
    ),
    "mon": (
        ["scored"],
        """
        SELECT *, CASE WHEN monitoring_priority >= 0.90 THEN 'Immediate Monitoring'
          WHEN monitoring_priority >= 0.65 THEN 'Enhanced Monitoring' ELSE 'Standard Monitoring' END
          AS monitoring_tier
        FROM (
          SELECT *, 0.7::DOUBLE * risk_score + 0.3::DOUBLE * older_device_flag AS monitoring_priority
          FROM (
            SELECT firmware_version, risk_score, avg_device_age_days,
              CAST(CASE WHEN avg_device_age_days >= 600 THEN 1 ELSE 0 END AS INTEGER) AS older_device_flag
            FROM scored))""",
    ),
    "rates": (
        ["ev"],
        f"""
        SELECT firmware_version, count(*) AS error_events,
          {r("(CAST(count(*) AS DOUBLE) / (SELECT count(DISTINCT device_id) FROM ev)) * 10000", 2)}
            AS error_rate_per_10k
        FROM ev GROUP BY firmware_version""",
    ),
    "attributed": (
        ["ev", "tk"],
        """
        SELECT ticket_id, firmware_version, rma_issued FROM (
          SELECT t.ticket_id, e.firmware_version, t.rma_issued, row_number() OVER (
            PARTITION BY t.ticket_id ORDER BY e."timestamp" DESC, e.event_id DESC) AS rn
          FROM tk t JOIN ev e ON t.device_id = e.device_id AND t.error_code = e.error_code
            AND e."timestamp" <= t.created_at) WHERE rn = 1""",
    ),
    "rma_fw": (
        ["attributed"],
        f"""
        SELECT firmware_version, count(*) AS tickets, {big("sum(rma_issued)")} AS rmas,
          {r(ratio("sum(rma_issued)", "count(*)"), 3)} AS rma_rate
        FROM attributed GROUP BY firmware_version""",
    ),
    "daily": (
        ["ev"],
        """
        SELECT error_code, CAST("timestamp" AS DATE) AS day, count(*) AS error_count
        FROM ev GROUP BY ALL""",
    ),
    "prepost": (
        ["ev", "rel"],
        f"""
        SELECT release_version, error_code, pre_errors, post_errors,
          post_errors - pre_errors AS delta_errors,
          CASE WHEN pre_errors > 0 THEN {r(ratio("post_errors", "pre_errors"), 2)} END AS post_pre_ratio
        FROM (
          SELECT rel.firmware_version AS release_version, error_code,
            count(*) FILTER (CAST("timestamp" AS DATE) < release_date) AS pre_errors,
            count(*) FILTER (CAST("timestamp" AS DATE) >= release_date) AS post_errors
          FROM rel JOIN ev ON CAST("timestamp" AS DATE)
            BETWEEN release_date - 14 AND release_date + 14
          GROUP BY ALL)
        WHERE post_errors >= 5""",
    ),
    "stability": (
        ["ev", "rel"],
        """
        SELECT firmware_version, days_since_release, count(*) AS error_count FROM (
          SELECT ev.firmware_version, CAST(trunc(
            epoch_us("timestamp" - CAST(release_date AS TIMESTAMP)) / 86400000000.0) AS INTEGER)
            AS days_since_release
          FROM ev JOIN rel ON ev.firmware_version = rel.firmware_version)
        WHERE days_since_release >= 0 GROUP BY ALL""",
    ),
    "fwrate": (
        ["ev"],
        """
        SELECT firmware_version, count(*) AS error_count, count(DISTINCT device_id) AS device_count,
          CAST(count(*) AS DOUBLE) / count(DISTINCT device_id) AS error_rate
        FROM ev GROUP BY firmware_version""",
    ),
}

VERSION_PAIR = f"""
  {r("a.error_rate", 3)} AS current_error_rate, {r("b.error_rate", 3)} AS previous_error_rate,
  {r("a.error_rate - b.error_rate", 3)} AS rate_change,
  CASE WHEN a.error_rate > b.error_rate * 1.2::DOUBLE THEN 'REGRESSION'
       WHEN a.error_rate < b.error_rate * 0.8::DOUBLE THEN 'IMPROVEMENT' ELSE 'STABLE' END AS status"""


def _histogram(view: str, column: str, bins: int) -> str:
    return f"""
        SELECT bin, {r("lo + bin * width", 6)} AS bin_start, {r("lo + (bin + 1) * width", 6)} AS bin_end, n
        FROM (
          SELECT CAST(least(floor(({column} - lo) / width), {bins - 1}) AS INTEGER) AS bin,
            lo, width, count(*) AS n
          FROM {view}, (SELECT min({column}) AS lo,
            (max({column}) - min({column})) / CAST({bins} AS DOUBLE) AS width FROM {view})
          GROUP BY ALL)"""


def _describe(view: str, column: str) -> str:
    return f"""
        SELECT count({column}) AS n, {r(f"avg({column})", 6)} AS mean,
          {r(f"quantile_cont({column}, 0.5)", 6)} AS median, {r(f"stddev_samp({column})", 6)} AS std,
          {r(f"min({column})", 6)} AS min, {r(f"max({column})", 6)} AS max FROM {view}"""


def _group_quantiles(view: str, group: str, column: str) -> str:
    names = {"0.0": "min", "0.25": "q1", "0.5": "median", "0.75": "q3", "1.0": "max"}
    cols = ", ".join(f"{r(f'quantile_cont({column}, {q})', 6)} AS {n}" for q, n in names.items())
    return f"SELECT {group}, {cols} FROM {view} GROUP BY {group}"


def _spearman(features: list[str], target: str) -> str:
    def one(feature: str) -> str:
        x = f"CAST(CAST({feature} AS INTEGER) AS DOUBLE)" if feature in ("is_hotfix", "patch_security") else feature
        return f"""
          SELECT '{feature}' AS feature, {r("corr(rx, ry)", 6)} AS spearman FROM (
            SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
              rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
            FROM (SELECT {x} AS x, {target} AS y FROM patch))"""

    return " UNION ALL ".join(one(f) for f in features)


PATCH_COLUMNS = [
    "firmware_version", "release_date", "previous_version", "days_since_previous_release",
    "patch_size_mb", "files_changed", "lines_changed", "is_hotfix", "patch_security",
    "code_churn_score", "avg_device_age_days", "previous_version_error_rate", "error_rate_per_10k",
    "pre_errors", "post_errors", "delta_errors", "post_pre_ratio", "tickets", "rmas", "rma_rate",
    "error_events",
]
PATCH_DOUBLES = {
    "patch_size_mb", "code_churn_score", "previous_version_error_rate", "error_rate_per_10k",
    "post_pre_ratio", "rma_rate",
}
PATCH_SELECT = ", ".join(f"{r(c, 6)} AS {c}" if c in PATCH_DOUBLES else c for c in PATCH_COLUMNS)

DRIFT_ROWS = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, (SELECT avg({c}) FROM hist) AS history_mean,
        (SELECT avg({c}) FROM fresh) AS new_mean"""
    for c in ("code_churn_score", "previous_version_error_rate", "avg_device_age_days")
)
DRIFT = f"""
  SELECT *, CASE WHEN history_mean = 0 THEN 0 ELSE abs(new_mean - history_mean) / history_mean * 100 END
    AS drift_pct FROM ({DRIFT_ROWS})"""

# Query name -> views it reads, SQL.
SPEARMAN = _spearman(
    [
        "code_churn_score", "previous_version_error_rate", "avg_device_age_days", "is_hotfix",
        "patch_security", "days_since_previous_release", "patch_size_mb", "files_changed",
        "lines_changed", "pre_errors",
    ],
    "error_rate_per_10k",
)

SQL: dict[str, tuple[list[str], str]] = {
    "required_nulls": (
        ["ev_region", "rel", "tk"],
        " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER (\"{c}\" IS NULL) AS nulls FROM {v}"
            for t, v, columns in (
                ("device_events", "ev_region", ["device_id", "error_code", "timestamp", "firmware_version", "model", "region"]),
                ("firmware_releases", "rel", ["firmware_version", "release_date"]),
                ("support_tickets", "tk", ["ticket_id", "device_id", "error_code", "created_at", "resolution", "rma_issued"]),
            )
            for c in columns
        ),
    ),
    "executive_kpis": (
        ["ev"],
        f"""
        SELECT count(DISTINCT firmware_version) AS total_firmware_versions,
          count(DISTINCT device_id) AS total_devices, count(*) AS total_error_events,
          count(DISTINCT error_code) AS unique_error_codes,
          {r(ratio("count(*)", "count(DISTINCT device_id)"), 2)} AS errors_per_device FROM ev""",
    ),
    "error_rate_by_firmware": (
        ["ev", "rel"],
        f"""
        SELECT ev.firmware_version, release_date, count(DISTINCT device_id) AS affected_devices,
          count(*) AS total_errors, {r(ratio("count(*)", "count(DISTINCT device_id)"), 2)}
            AS error_rate_per_device,
          count(DISTINCT error_code) AS unique_errors
        FROM ev LEFT JOIN rel ON ev.firmware_version = rel.firmware_version
        GROUP BY ev.firmware_version, release_date""",
    ),
    "high_risk_firmware": (
        ["fwrate"],
        f"""
        SELECT firmware_version, error_count, device_count, {r("error_rate", 3)} AS error_rate,
          {r("a", 3)} AS baseline_avg, {r("error_rate / a", 2)} AS risk_multiplier,
          CASE WHEN error_rate > a * 1.5::DOUBLE THEN 'HIGH RISK' WHEN error_rate > a THEN 'MODERATE'
               ELSE 'LOW' END AS risk_tier
        FROM fwrate, (SELECT avg(error_rate) AS a FROM fwrate)""",
    ),
    "error_code_share": (
        ["ev"],
        f"""
        SELECT error_code, count(*) AS occurrence_count, count(DISTINCT device_id) AS affected_devices,
          count(DISTINCT firmware_version) AS firmware_versions_affected,
          {pct("count(*)", "(SELECT count(*) FROM ev)")} AS pct_of_all_errors
        FROM ev GROUP BY error_code ORDER BY occurrence_count DESC, error_code LIMIT 20""",
    ),
    "ticket_summary": (
        ["tk"],
        f"""
        SELECT error_code, count(*) AS ticket_count, {r("avg(tier)", 2)} AS avg_tier,
          {big("sum(rma_issued)")} AS total_rmas, {pct("sum(rma_issued)", "count(*)")} AS rma_rate_pct
        FROM tk GROUP BY error_code""",
    ),
    "rma_rate_joined": (
        ["ev", "tk"],
        f"""
        SELECT firmware_version, count(DISTINCT ticket_id) AS support_tickets,
          {big("sum(rma_issued)")} AS rma_count,
          {pct("sum(rma_issued)", "count(DISTINCT ticket_id)")} AS rma_rate_pct
        FROM ev JOIN tk ON ev.device_id = tk.device_id AND ev.error_code = tk.error_code
        GROUP BY firmware_version HAVING count(DISTINCT ticket_id) >= 5""",
    ),
    "weekly_trend": (
        ["ev"],
        """
        SELECT strftime("timestamp", '%Y-%W') AS year_week, count(*) AS error_count,
          count(DISTINCT device_id) AS unique_devices, count(DISTINCT firmware_version) AS active_versions
        FROM ev GROUP BY ALL""",
    ),
    "by_model": (
        ["ev"],
        f"""
        SELECT model, count(DISTINCT device_id) AS device_count, count(*) AS total_errors,
          {r(ratio("count(*)", "count(DISTINCT device_id)"), 2)} AS errors_per_device,
          count(DISTINCT error_code) AS unique_error_types FROM ev GROUP BY model""",
    ),
    "by_region": (
        ["ev_region"],
        f"""
        SELECT region, count(DISTINCT device_id) AS device_count, count(*) AS total_errors,
          {r(ratio("count(*)", "count(DISTINCT device_id)"), 2)} AS errors_per_device,
          count(DISTINCT firmware_version) AS firmware_versions FROM ev_region GROUP BY region""",
    ),
    "error_cooccurrence": (
        ["ev"],
        f"""
        SELECT a.error_code AS error_1, b.error_code AS error_2,
          count(DISTINCT a.device_id) AS devices_with_both,
          {pct("count(DISTINCT a.device_id)", "(SELECT count(DISTINCT device_id) FROM ev)")}
            AS pct_of_devices
        FROM (SELECT DISTINCT device_id, error_code FROM ev) a
        JOIN (SELECT DISTINCT device_id, error_code FROM ev) b
          ON a.device_id = b.device_id AND a.error_code < b.error_code
        GROUP BY a.error_code, b.error_code HAVING count(DISTINCT a.device_id) >= 5
        ORDER BY devices_with_both DESC, error_1, error_2 LIMIT 15""",
    ),
    "version_regressions": (
        ["fwrate"],
        f"""
        SELECT a.firmware_version AS current_version, b.firmware_version AS previous_version,
          {VERSION_PAIR}
        FROM fwrate a JOIN fwrate b ON a.firmware_version > b.firmware_version
        WHERE abs(a.error_rate - b.error_rate) > 0.1""",
    ),
    "version_regressions_consecutive": (
        ["fwrate"],
        f"""
        SELECT a.firmware_version AS current_version, b.firmware_version AS previous_version,
          {VERSION_PAIR}
        FROM (SELECT *, row_number() OVER (
                ORDER BY list_transform(string_split(firmware_version, '.'), lambda x: CAST(x AS INTEGER))) AS rn
              FROM fwrate) a
        JOIN (SELECT *, row_number() OVER (
                ORDER BY list_transform(string_split(firmware_version, '.'), lambda x: CAST(x AS INTEGER))) AS rn
              FROM fwrate) b ON a.rn = b.rn + 1
        WHERE abs(a.error_rate - b.error_rate) > 0.1""",
    ),
    "escalation": (
        ["tk"],
        f"""
        SELECT error_code, count(*) FILTER (tier = 1) AS tier_1, count(*) FILTER (tier = 2) AS tier_2,
          count(*) FILTER (tier = 3) AS tier_3, count(*) AS total_tickets,
          {pct("count(*) FILTER (tier >= 2)", "count(*)")} AS escalation_rate_pct
        FROM tk GROUP BY error_code HAVING count(*) >= 5""",
    ),
    "release_health": (
        ["ev", "tk"],
        f"""
        SELECT firmware_version, {r("e", 3)} AS error_rate, {r("r", 3)} AS rma_rate,
          {r("t", 2)} AS avg_support_tier,
          {r("100 - (e * 30 + r * 40 + (t - 1) / 2 * 30)", 1)} AS health_score
        FROM (
          SELECT firmware_version, CAST(count(*) AS DOUBLE) / count(DISTINCT ev.device_id) AS e,
            coalesce({ratio("sum(rma_issued)", "count(ticket_id)")}, 0) AS r,
            coalesce({ratio("sum(tier)", "count(tier)")}, 1) AS t
          FROM ev LEFT JOIN tk ON ev.device_id = tk.device_id AND ev.error_code = tk.error_code
          GROUP BY firmware_version)""",
    ),
    "table_counts": (
        ["ev", "rel", "tk"],
        """
        SELECT 'device_events' AS table_name, count(*) AS row_count FROM ev
        UNION ALL SELECT 'firmware_releases', count(*) FROM rel
        UNION ALL SELECT 'support_tickets', count(*) FROM tk""",
    ),
    "cardinalities": (
        ["ev"],
        """
        SELECT count(DISTINCT device_id) AS device_count, count(DISTINCT error_code) AS error_code_count,
          count(DISTINCT severity) AS severity_count, count(DISTINCT firmware_version) AS firmware_count
        FROM ev""",
    ),
    "error_rates": (["rates"], " SELECT * FROM rates"),
    "top_error_rates": (
        ["rates"],
        " SELECT * FROM rates ORDER BY error_rate_per_10k DESC, firmware_version LIMIT 10",
    ),
    "rma_by_error": (
        ["tk"],
        f"""
        SELECT error_code, count(*) AS ticket_count, {big("sum(rma_issued)")} AS rma_count,
          {r(ratio("sum(rma_issued)", "count(*)"), 3)} AS rma_rate FROM tk GROUP BY error_code""",
    ),
    "attributed_tickets": (["attributed"], " SELECT * FROM attributed"),
    "rma_by_firmware": (["rma_fw"], " SELECT * FROM rma_fw"),
    "meaningful_rma": (["rma_fw"], " SELECT * FROM rma_fw WHERE tickets >= 5"),
    "top_rma": (
        ["rma_fw"],
        " SELECT * FROM rma_fw WHERE tickets >= 5 ORDER BY rma_rate DESC, firmware_version LIMIT 10",
    ),
    "error_spikes": (
        ["daily"],
        f"""
        SELECT error_code, day, error_count, {r("t", 6)} AS trailing_7d_avg, spike_ratio FROM (
          SELECT *, {r("error_count / t", 2)} AS spike_ratio FROM (
            SELECT *, avg(error_count) OVER (PARTITION BY error_code ORDER BY day
              ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS t FROM daily) WHERE t IS NOT NULL)
        WHERE spike_ratio >= 1.5""",
    ),
    "error_spikes_calendar": (
        ["daily"],
        f"""
        SELECT error_code, day, error_count, {r("t", 6)} AS trailing_7d_avg, spike_ratio FROM (
          SELECT *, {r("error_count / t", 2)} AS spike_ratio FROM (
            SELECT *, avg(error_count) OVER (PARTITION BY error_code ORDER BY day
              RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS t FROM daily)
          WHERE t IS NOT NULL)
        WHERE spike_ratio >= 1.5""",
    ),
    "pre_post_errors": (["prepost"], " SELECT * FROM prepost"),
    "pre_post_same_version": (
        ["ev", "rel"],
        f"""
        SELECT release_version, error_code, pre_errors, post_errors,
          post_errors - pre_errors AS delta_errors,
          CASE WHEN pre_errors > 0 THEN {r(ratio("post_errors", "pre_errors"), 2)} END AS post_pre_ratio
        FROM (
          SELECT rel.firmware_version AS release_version, error_code,
            count(*) FILTER (CAST("timestamp" AS DATE) < release_date) AS pre_errors,
            count(*) FILTER (CAST("timestamp" AS DATE) >= release_date) AS post_errors
          FROM rel JOIN ev ON rel.firmware_version = ev.firmware_version AND CAST("timestamp" AS DATE)
            BETWEEN release_date - 14 AND release_date + 14
          GROUP BY ALL)
        WHERE post_errors >= 5""",
    ),
    "top_regressions": (
        ["prepost"],
        """
        SELECT * FROM prepost WHERE post_pre_ratio IS NOT NULL
        ORDER BY post_pre_ratio DESC, release_version, error_code LIMIT 10""",
    ),
    "stability_curves": (["stability"], " SELECT * FROM stability"),
    "first_curves": (
        ["stability"],
        """
        SELECT * FROM stability WHERE firmware_version IN (
          SELECT DISTINCT firmware_version FROM stability ORDER BY 1 LIMIT 5)""",
    ),
    "rollup_pre_post": (
        ["prepost"],
        f"""
        SELECT release_version AS firmware_version, {big("sum(pre_errors)")} AS pre_errors,
          {big("sum(post_errors)")} AS post_errors, {big("sum(delta_errors)")} AS delta_errors,
          {r("avg(post_pre_ratio)", 6)} AS post_pre_ratio FROM prepost GROUP BY ALL""",
    ),
    "firmware_releases": (["rel"], " SELECT * FROM rel"),
    "patch_features": (["patch"], f" SELECT {PATCH_SELECT} FROM patch"),
    "gate_input": (
        ["patch"],
        f"""
        SELECT firmware_version, {r("code_churn_score", 6)} AS code_churn_score,
          {r("previous_version_error_rate", 6)} AS previous_version_error_rate, avg_device_age_days,
          is_hotfix, patch_security FROM patch""",
    ),
    "merge_features": (
        ["vpatch", "rates", "rma_fw"],
        f"""
        SELECT p.release_seq, p.firmware_version, {r("p.error_rate_per_10k", 6)} AS error_rate_per_10k,
          p.error_events, p.tickets, p.rmas,
          coalesce(e.error_events, 0) AS error_events_sql,
          coalesce(e.error_rate_per_10k, 0) AS error_rate_per_10k_sql,
          coalesce(m.tickets, 0) AS tickets_sql, coalesce(m.rmas, 0) AS rmas_sql,
          coalesce(m.rma_rate, 0) AS rma_rate_sql
        FROM vpatch p LEFT JOIN rates e ON p.firmware_version = e.firmware_version
        LEFT JOIN rma_fw m ON p.firmware_version = m.firmware_version""",
    ),
    "training_table": (
        ["vpatch", "prepost", "rma_fw"],
        f"""
        SELECT p.release_seq, p.firmware_version, p.pre_errors AS pre_errors_synth,
          CAST(s.pre_errors AS DOUBLE) AS pre_errors_sql,
          CAST(s.post_errors AS DOUBLE) AS post_errors_sql,
          CAST(s.delta_errors AS DOUBLE) AS delta_errors_sql, CAST(m.tickets AS DOUBLE) AS tickets_sql, m.rma_rate AS rma_rate_sql,
          {r("p.error_rate_per_10k", 6)} AS target_error_rate,
          {r("coalesce(s.ratio, 1)", 6)} AS regression_ratio
        FROM vpatch p LEFT JOIN (
          SELECT release_version, {big("sum(pre_errors)")} AS pre_errors,
            {big("sum(post_errors)")} AS post_errors, {big("sum(delta_errors)")} AS delta_errors,
            avg(post_pre_ratio) AS ratio FROM prepost GROUP BY ALL) s
          ON p.firmware_version = s.release_version
        LEFT JOIN rma_fw m ON p.firmware_version = m.firmware_version""",
    ),
    "error_rate_quantile": (
        ["base"],
        f" SELECT {r('quantile_cont(error_rate_per_10k, 0.75)', 6)} AS value FROM base",
    ),
    "churn_bounds": (
        ["base"],
        f"""
        SELECT {r("quantile_cont(code_churn_score, 0.05)", 6)} AS churn_min,
          {r("quantile_cont(code_churn_score, 0.95)", 6)} AS churn_max FROM base""",
    ),
    "describe_risk": (["scored"], _describe("scored", "risk_score")),
    "describe_qa": (["qa"], _describe("qa", "QA_priority_score")),
    "risk_counts": (["scored"], " SELECT high_risk_flag, count(*) AS n FROM scored GROUP BY ALL"),
    "bucket_shares": (
        ["qa"],
        f"""
        SELECT QA_bucket, count(*) AS n, {r("count(*) / CAST((SELECT count(*) FROM qa) AS DOUBLE)", 6)}
          AS share FROM qa GROUP BY ALL""",
    ),
    "bucket_by_hotfix": (
        ["qa"],
        " SELECT is_hotfix, "
        + ", ".join(
            f"count(*) FILTER (QA_bucket = '{b}') AS \"{b}\"" for b in ("Critical", "High", "Medium", "Low")
        )
        + " FROM qa GROUP BY ALL",
    ),
    "tier_by_age": (
        ["mon"],
        " SELECT older_device_flag, "
        + ", ".join(
            f"count(*) FILTER (monitoring_tier = '{t} Monitoring') AS \"{t} Monitoring\""
            for t in ("Immediate", "Enhanced", "Standard")
        )
        + " FROM mon GROUP BY ALL",
    ),
    "risk_histogram": (["scored"], _histogram("scored", "risk_score", 20)),
    "qa_histogram": (["qa"], _histogram("qa", "QA_priority_score", 30)),
    "error_rate_histogram": (["base"], _histogram("base", "error_rate_per_10k", 20)),
    "hotfix_mean": (
        ["base"],
        f" SELECT is_hotfix, {r('avg(error_rate_per_10k)', 6)} AS mean FROM base GROUP BY ALL",
    ),
    "tier_risk_quantiles": (["mon"], _group_quantiles("mon", "monitoring_tier", "risk_score")),
    "tier_priority_quantiles": (
        ["mon"],
        _group_quantiles("mon", "monitoring_tier", "monitoring_priority"),
    ),
    "churn_correlation": (
        ["base"],
        f" SELECT {r('corr(code_churn_score, error_rate_per_10k)', 6)} AS r FROM base",
    ),
    "hotfix_correlation": (
        ["base"],
        f" SELECT {r('corr(CAST(CAST(is_hotfix AS INTEGER) AS DOUBLE), error_rate_per_10k)', 6)} AS r FROM base",
    ),
    "signal_audit": (["patch"], SPEARMAN),
    "signal_audit_pairwise": (["patch"], SPEARMAN),
    "feature_summary": (
        ["patch"],
        f"""
        SELECT count(*) AS versions, min(release_date) AS first_release, max(release_date) AS last_release,
          CAST(date_diff('day', min(release_date), max(release_date)) AS INTEGER) AS span_days,
          {r("avg(error_rate_per_10k)", 6)} AS mean_error_rate,
          count(*) FILTER (is_hotfix) AS hotfixes, {pct("count(*) FILTER (is_hotfix)", "count(*)")}
            AS hotfix_pct,
          {big("sum(rmas)")} AS total_rmas FROM patch""",
    ),
    "quality_report": (
        ["patch"],
        """
        SELECT "check", violations, violations = 0 AS passed FROM (
          SELECT 'no_nulls' AS "check", CAST(sum("""
        + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in PATCH_COLUMNS)
        + """) AS BIGINT) AS violations FROM patch
          UNION ALL SELECT 'error_rate_positive',
            count(*) FILTER (NOT coalesce(error_rate_per_10k > 0, false)) FROM patch
          UNION ALL SELECT 'rma_rate_in_unit_range',
            count(*) FILTER (NOT coalesce(rma_rate BETWEEN 0 AND 1, false)) FROM patch
          UNION ALL SELECT 'dates_in_order', count(*) FILTER (release_date < before) FROM (
            SELECT release_date, lag(release_date) OVER (PARTITION BY product_line ORDER BY release_seq)
              AS before FROM patch))""",
    ),
    "cumulative_share": (
        ["qa"],
        f"""
        SELECT {r("s", 6)} AS QA_priority_score, n, rank, {r("running / total * 100", 6)} AS cumulative_pct
        FROM (
          SELECT s, n, CAST(sum(n) OVER w AS BIGINT) AS rank, sum(n * s) OVER w AS running,
            sum(n * s) OVER () AS total
          FROM (SELECT QA_priority_score AS s, count(*) AS n FROM qa GROUP BY ALL)
          WINDOW w AS (ORDER BY s DESC))""",
    ),
    "gate": (
        ["scored"],
        f"""
        SELECT n_patches, n_high_risk, 0::BIGINT AS n_unscored, {r("a", 6)} AS avg_risk_score,
          CASE WHEN n_high_risk > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict,
          CAST(CASE WHEN n_high_risk > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code
        FROM (SELECT count(*) AS n_patches, count(*) FILTER (high_risk_flag = 1) AS n_high_risk,
                avg(risk_score) AS a FROM scored)""",
    ),
    "qa_sheet": (
        ["qa"],
        f"""
        SELECT firmware_version, {r("code_churn_score", 6)} AS code_churn_score,
          {r("churn_norm", 6)} AS churn_norm, risk_score, high_risk_flag,
          {r("QA_priority_score", 6)} AS QA_priority_score, QA_bucket FROM qa""",
    ),
    "qa_top": (
        ["qa"],
        f"""
        SELECT firmware_version, {r("QA_priority_score", 6)} AS QA_priority_score, QA_bucket FROM qa
        ORDER BY qa.QA_priority_score DESC, firmware_version LIMIT 10""",
    ),
    "monitoring_sheet": (
        ["mon"],
        f"""
        SELECT firmware_version, risk_score, avg_device_age_days, older_device_flag,
          {r("monitoring_priority", 6)} AS monitoring_priority, monitoring_tier FROM mon""",
    ),
    "monitoring_top": (
        ["mon"],
        f"""
        SELECT firmware_version, {r("monitoring_priority", 6)} AS monitoring_priority, monitoring_tier
        FROM mon ORDER BY mon.monitoring_priority DESC, firmware_version LIMIT 3""",
    ),
    "qa_hours": (
        ["scored"],
        f"""
        SELECT w AS hours_with_model, f AS hours_without_model, f - w AS hours_saved,
          {r("(f - w) / f * 100", 6)} AS pct_saved
        FROM (SELECT CAST(4 * count(*) FILTER (high_risk_flag = 1) + count(*) FILTER (high_risk_flag = 0)
                AS DOUBLE) AS w, count(*) * 2.5::DOUBLE AS f FROM scored)""",
    ),
    "drift_report": (
        ["hist", "fresh"],
        f"""
        SELECT feature, {r("history_mean", 6)} AS history_mean, {r("new_mean", 6)} AS new_mean,
          {r("drift_pct", 6)} AS drift_pct, drift_pct > 15 AS drifted FROM ({DRIFT})""",
    ),
    "should_retrain": (
        ["hist", "fresh"],
        f" SELECT bool_or(feature = 'code_churn_score' AND drift_pct > 15) AS retrain FROM ({DRIFT})",
    ),
    "class_balance": (
        ["labelled"],
        f"""
        SELECT side, high_risk_flag, n, {r("n / CAST(sum(n) OVER (PARTITION BY side) AS DOUBLE)", 6)} AS share
        FROM (SELECT CASE WHEN release_date < DATE '2001-01-01' THEN 'history' ELSE 'new' END AS side,
                high_risk_flag, count(*) AS n FROM labelled GROUP BY ALL)""",
    ),
    "append_new": (
        ["hist", "fresh"],
        f"""
        SELECT firmware_version, {r("code_churn_score", 6)} AS code_churn_score FROM hist
        UNION ALL SELECT firmware_version || '.NEW', {r("code_churn_score", 6)} FROM fresh""",
    ),
    "risk_labels": (
        ["labelled"],
        f"""
        SELECT firmware_version, {r("error_rate_per_10k", 6)} AS error_rate_per_10k,
          high_risk_flag AS label FROM labelled""",
    ),
    "regression_metrics": (
        ["pred"],
        f"""
        SELECT {r("sqrt(mse)", 6)} AS rmse, {r("1 - mse / v", 6)} AS r2 FROM (
          SELECT avg((error_rate_per_10k - estimate) * (error_rate_per_10k - estimate)) AS mse,
            var_pop(error_rate_per_10k) AS v FROM pred)""",
    ),
    "classification_metrics": (
        ["pred"],
        f"""
        SELECT {r("(SELECT avg(CASE WHEN label = predicted THEN 1 ELSE 0 END) FROM pred)", 6)} AS accuracy,
          {r("(sum(rk) FILTER (label = 1) - p * (p + 1) / 2.0) / (p * n)", 6)} AS roc_auc
        FROM (SELECT label, rank() OVER (ORDER BY risk_score)
                + (count(*) OVER (PARTITION BY risk_score) - 1) / CAST(2 AS DOUBLE) AS rk FROM pred),
          (SELECT CAST(count(*) FILTER (label = 1) AS DOUBLE) AS p,
             CAST(count(*) FILTER (label = 0) AS DOUBLE) AS n FROM pred)
        GROUP BY p, n""",
    ),
    "classification_report": (
        ["pred"],
        f"""
        SELECT class, {r("p", 6)} AS precision, {r("q", 6)} AS recall, {r("2 * p * q / (p + q)", 6)} AS f1,
          support
        FROM (SELECT c AS class, count(*) FILTER (label = c) AS support,
                count(*) FILTER (label = c AND predicted = c)
                  / CAST(count(*) FILTER (predicted = c) AS DOUBLE) AS p,
                count(*) FILTER (label = c AND predicted = c)
                  / CAST(count(*) FILTER (label = c) AS DOUBLE) AS q
              FROM pred, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS c) GROUP BY c)""",
    ),
    "confusion_matrix": (
        ["pred"],
        """
        SELECT label, count(*) FILTER (predicted = 0) AS predicted_low,
          count(*) FILTER (predicted = 1) AS predicted_high FROM pred GROUP BY label""",
    ),
    "roc_curve": (
        ["pred"],
        f"""
        SELECT risk_score AS threshold, {r("sum(neg) OVER w / CAST(sum(neg) OVER () AS DOUBLE)", 6)} AS fpr,
          {r("sum(pos) OVER w / CAST(sum(pos) OVER () AS DOUBLE)", 6)} AS tpr
        FROM (SELECT risk_score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
              FROM pred GROUP BY ALL)
        WINDOW w AS (ORDER BY risk_score DESC)""",
    ),
    "roc_curve_bins": (
        ["pred"],
        f"""
        SELECT threshold, {r("fpr", 6)} AS fpr, {r("tpr", 6)} AS tpr FROM (
          SELECT risk_score AS threshold, sum(neg) OVER w / CAST(sum(neg) OVER () AS DOUBLE) AS fpr,
            sum(pos) OVER w / CAST(sum(pos) OVER () AS DOUBLE) AS tpr
          FROM (SELECT risk_score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
                FROM pred GROUP BY ALL)
          WINDOW w AS (ORDER BY risk_score DESC))
        QUALIFY row_number() OVER (PARTITION BY ceil((fpr + tpr) * 20) ORDER BY threshold) = 1""",
    ),
    "prediction_band": (
        ["pred"],
        f" SELECT {r('1.96::DOUBLE * stddev_samp(error_rate_per_10k - estimate)', 6)} AS band FROM pred",
    ),
}


def _needed(names: list[str]) -> list[str]:
    found: list[str] = []
    for name in names:
        for view in [*_needed(VIEWS[name][0]), name]:
            if view not in found:
                found.append(view)
    return found

LABELLED = """
  SELECT *, CAST(CASE WHEN error_rate_per_10k >= (SELECT quantile_cont(error_rate_per_10k, 0.75)
    FROM patch) THEN 1 ELSE 0 END AS INTEGER) AS label FROM patch"""


def share(key: str, seed: int) -> str:
    """The number in [0, 1) that decides a row's side."""
    return f"(CAST(('0x' || substr(md5({key} || ':{seed}'), 1, 13))::UBIGINT AS DOUBLE) / 4503599627370496)"


def _stratified(rows: str) -> str:
    return f"""SELECT *, s < quantile_cont(s, 0.2) OVER (PARTITION BY label) AS held
        FROM (SELECT *, {share("firmware_version", 42)} AS s FROM ({rows}))"""


def _sides(kind: str, rows: str) -> str:
    return f"""SELECT '{kind}' AS kind, CASE WHEN held THEN 'test' ELSE 'train' END AS side,
        count(*) AS n, {big("sum(label)")} AS positives FROM ({rows}) GROUP BY ALL"""


PLAIN = f"""SELECT *, {share("firmware_version", 42)} < 0.33 AS held FROM ({LABELLED})"""
TESTED = f"SELECT count(*) AS n_test, {big('sum(label)')} AS positives"
RETRAINED = _stratified(
    f"""SELECT * REPLACE (CASE WHEN release_date >= DATE '2001-01-01' THEN firmware_version || '.NEW'
        ELSE firmware_version END AS firmware_version) FROM ({LABELLED})"""
)

# Learners have no SQL form; these hold what is certain about their results.
SQL |= {
    "split_sizes": (["patch"], _sides("plain", PLAIN) + " UNION ALL " + _sides("stratified", _stratified(LABELLED))),
    "history_sample": (
        ["hist"],
        f"""SELECT firmware_version || '.NEW' AS firmware_version, release_seq FROM hist
            ORDER BY {share("firmware_version", 99)}, firmware_version LIMIT 50""",
    ),
    **{
        name: (["patch"], f"{TESTED}, true AS r2_reached FROM ({PLAIN}) WHERE held")
        for name in ("rf_regressor", "gbt_regressor")
    },
    **{
        name: (["patch"], f"{TESTED}, true AS auc_reached, true AS accuracy_reached FROM ({PLAIN}) WHERE held")
        for name in ("rf_classifier", "gbt_classifier")
    },
    "cross_validation": (
        ["patch"],
        f"SELECT count(*) AS n_train, true AS auc_reached, true AS rmse_reached FROM ({PLAIN}) WHERE NOT held",
    ),
    "feature_importance": (
        [],
        """SELECT unnest(['code_churn_score', 'previous_version_error_rate', 'avg_device_age_days',
             'is_hotfix', 'patch_security']) AS feature, true AS is_share""",
    ),
    "scored_by_model": (
        ["patch"],
        f"SELECT firmware_version, true AS is_probability, true AS is_flagged_right FROM ({PLAIN}) WHERE held",
    ),
    "retrained": (["patch"], f"{TESTED}, true AS auc_reached FROM ({RETRAINED}) WHERE held"),
    "feature_matrix": (
        ["patch"],
        f"""SELECT firmware_version, [{r("code_churn_score", 6)}, {r("previous_version_error_rate", 6)},
              {r("avg_device_age_days", 6)}, CAST(CAST(is_hotfix AS INTEGER) AS DOUBLE),
              CAST(CAST(patch_security AS INTEGER) AS DOUBLE)] AS features FROM patch""",
    ),
    "gate_json": (
        ["scored"],
        f"""SELECT 'patches.csv' AS input_file, count(*) FILTER (high_risk_flag = 1) AS n_high_risk,
              {r("avg(risk_score)", 6)} AS avg_risk_score FROM scored""",
    ),
    "sql_error_rates": (["ev"], "SELECT firmware_version, count(*) AS error_events FROM ev GROUP BY firmware_version"),
}

FEATURE_SUMS = {
    "error_rates": "error_events", "rma_by_error": "ticket_count", "rma_by_firmware": "tickets",
    "error_spikes": "error_count", "pre_post_errors": "post_errors", "stability_curves": "error_count",
}

SQL["drift_from_moments"] = SQL["drift_report"]

# Estimates are near the exact counts; sums are exact.
SQL |= {
    "sketched_kpis": (
        ["ev"],
        "SELECT count(*) AS total_error_events, true AS total_devices_near, true AS unique_error_codes_near, true AS total_firmware_versions_near FROM ev",
    ),
    "sketched_by_model": (["ev"], "SELECT model, count(*) AS total_errors, true AS devices_near FROM ev GROUP BY model"),
}

# What is written and read again is what was there.
SQL |= {
    "raw_tables": (
        ["ev_region", "rel", "tk"],
        """
        SELECT 'device_events' AS source, CAST(event_id AS VARCHAR) AS id,
          strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS at, region AS detail FROM ev_region
        UNION ALL
        SELECT 'firmware_releases', firmware_version, strftime(release_date, '%Y-%m-%d'), previous_version FROM rel
        UNION ALL
        SELECT 'support_tickets', ticket_id, strftime(created_at, '%Y-%m-%d %H:%M:%S'), resolution FROM tk""",
    ),
    "written_checks": (
        ["patch"],
        "SELECT (SELECT count(*) FROM patch) AS rows_there, (SELECT count(*) FROM patch) AS rows, "
        + ", ".join(f"max(violations) FILTER (\"check\" = '{c}') AS {c}" for c in ("no_nulls", "error_rate_positive", "rma_rate_in_unit_range"))
        + f" FROM ({SQL['quality_report'][1]})",
    ),
    "merged_table": (["patch"], f"SELECT firmware_version, is_hotfix, {r('code_churn_score', 6)} AS code_churn_score FROM patch"),
    "scored_file": (
        ["scored"],
        f"""SELECT firmware_version, CAST(is_hotfix AS INTEGER) AS is_hotfix, {r("risk_score", 6)} AS risk_score,
              high_risk_flag, 'scored_patches.csv' AS file_name FROM scored""",
    ),
    "gate_file": (
        ["patch"],
        f"""SELECT firmware_version, {r("code_churn_score", 6)} AS code_churn_score,
              {r("previous_version_error_rate", 6)} AS previous_version_error_rate, avg_device_age_days,
              CAST(is_hotfix AS INTEGER) AS is_hotfix, CAST(patch_security AS INTEGER) AS patch_security,
              0 AS lost_cells, true AS other_is_missing FROM patch""",
    ),
    "dashboard_sheet": (
        ["qa"],
        f"SELECT firmware_version, {r('QA_priority_score', 6)} AS QA_priority_score, QA_bucket, high_risk_flag FROM qa",
    ),
    "device_inventory": (["ev_region"], "SELECT DISTINCT device_id, model, region, true AS is_undated FROM ev_region"),
    "promotions": (
        [],
        """SELECT CAST(seq AS BIGINT) AS seq, version, version = 'v001' AS is_active, (SELECT count(*) FROM orders) AS n_patches
           FROM (VALUES (1, 'v001'), (2, 'v002'), (3, 'v001')) AS t(seq, version)""",
    ),
    "renamed_key": (SQL["pre_post_errors"][0], f"SELECT release_version AS firmware_version, error_code, delta_errors FROM ({SQL['pre_post_errors'][1]})"),
    "existing_columns": (["base"], "SELECT firmware_version, files_changed, lines_changed FROM base"),
    "numeric_sums": (
        ["base"],
        "\nUNION ALL ".join(
            f"SELECT '{c}' AS name, {big(f'sum(CAST(floor({c}) AS BIGINT))')} AS total FROM base"
            for c in ("release_seq", "patch_size_mb", "days_since_previous_release", "files_changed", "lines_changed",
                      "avg_device_age_days", "code_churn_score", "error_rate_per_10k")
        ),
    ),
    "feature_tables": (
        sorted({v for n in FEATURE_SUMS for v in SQL[n][0]}),
        "\nUNION ALL ".join(
            f"SELECT '{n}' AS table_name, count(*) AS n, {big(f'sum({c})')} AS total FROM ({SQL[n][1]})" for n, c in FEATURE_SUMS.items()
        ),
    ),
}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (views, body) in SQL.items():
        ctes = ",\n".join(f"{v} AS ({VIEWS[v][1]})" for v in _needed(views))
        out[name] = f"WITH {ctes}\n{body}" if ctes else body
    return out
