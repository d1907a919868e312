"""The same queries as plain SQL for an independent engine, over the same parquet tables."""

from __future__ import annotations

from ..sources.demo import CLICKS_SQL

CAP = 1_800_000_000
STEPS = ("view", "click", "signup", "purchase")

# Each block reads only the ones above it; an engine skips those a query does not use.
BLOCKS = {
    "clicks": CLICKS_SQL.format(events="events"),
    "ev": r"""
SELECT *, try_cast(create_text AS TIMESTAMP) AS ts,
       split_part(page_url, '#', 1) AS link,
       nullif(regexp_extract(page_url, '-pid-(\d+)', 1), '') AS product_id,
       nullif(regexp_extract(page_url, '/du-lich-([a-zA-Z0-9\-]+)\.aspx', 1), '') AS destination,
       hour(try_cast(create_text AS TIMESTAMP) + INTERVAL 7 HOUR) AS hour_local,
       cast(try_cast(create_text AS TIMESTAMP) + INTERVAL 7 HOUR AS DATE) AS date_local
FROM clicks""",
    "dw0": """
SELECT *, CASE WHEN session_id IS NOT NULL THEN
              lead(ts) OVER (PARTITION BY session_id ORDER BY ts ASC NULLS LAST, id) END AS next_ts
FROM ev""",
    "dw": f"""
SELECT *, epoch_us(next_ts) - epoch_us(ts) AS us,
       CASE WHEN epoch_us(next_ts) - epoch_us(ts) BETWEEN 1 AND {CAP}
            THEN epoch_us(next_ts) - epoch_us(ts) END AS valid_us,
       link IS DISTINCT FROM 'https://shop.example/' AS away
FROM dw0""",
    "sess": """
SELECT session_id,
       {first},
       min(ts) AS started_at, max(ts) AS ended_at,
       count(*) AS num_events, count(DISTINCT link) AS num_unique_links,
       {flags},
       cast(min(ts) AS DATE) AS date_utc, min(date_local) AS date_local,
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0::DOUBLE, 2)
           AS session_duration_min
FROM ev WHERE session_id IS NOT NULL GROUP BY session_id""".format(
        first=",\n       ".join(
            f"first({c} ORDER BY ts ASC NULLS LAST, id) FILTER (WHERE {c} IS NOT NULL) AS {c}"
            for c in "profile_id utm_source utm_medium device_type os_name geo_country geo_city".split()
        ),
        flags=",\n       ".join(f"coalesce(bool_or(name = '{s}'), false) AS had_{s}" for s in STEPS),
    ),
    "named": """
SELECT session_id, id, ts, coalesce(name, 'None') AS step,
       lag(coalesce(name, 'None')) OVER (PARTITION BY session_id ORDER BY ts ASC NULLS LAST, id)
           AS previous
FROM ev WHERE session_id IS NOT NULL""",
    "pat": """
SELECT session_id, string_agg(step, ' > ' ORDER BY ts ASC NULLS LAST, id) AS pattern,
       count(*) AS steps
FROM named WHERE step IS DISTINCT FROM previous GROUP BY session_id""",
    "counted": """
SELECT pattern, count(*) AS sessions,
       round(count(*)::DOUBLE / (SELECT count(*) FROM pat) * 100, 2) AS share_pct
FROM pat GROUP BY pattern""",
    "profiles": """
SELECT profile_id,
       first(utm_source ORDER BY session_id) FILTER (WHERE utm_source IS NOT NULL) AS utm_source,
       first(device_type ORDER BY session_id) FILTER (WHERE device_type IS NOT NULL) AS device_type,
       first(geo_country ORDER BY session_id) FILTER (WHERE geo_country IS NOT NULL) AS geo_country
FROM sess WHERE profile_id IS NOT NULL GROUP BY profile_id""",
    "viewed": """
SELECT profile_id, product_id, count(id) AS views,
       coalesce(sum(valid_us), 0)::BIGINT AS us, count(valid_us) AS measured,
       first(product_name ORDER BY session_id NULLS LAST, ts NULLS LAST, id)
           FILTER (WHERE product_name IS NOT NULL) AS product_name,
       max(ts) AS last_visit
FROM dw WHERE name = 'view' AND away AND product_id IS NOT NULL AND profile_id IS NOT NULL
GROUP BY profile_id, product_id""",
    "pc": """
SELECT v.profile_id, v.product_id, views, us / 1e6::DOUBLE AS total_time,
       CASE WHEN measured > 0 THEN us / 1e6::DOUBLE / measured END AS avg_time,
       product_name, last_visit,
       EXISTS (SELECT 1 FROM ev e WHERE e.name IN ('signup', 'purchase')
               AND e.profile_id = v.profile_id AND e.product_id = v.product_id) AS intent,
       EXISTS (SELECT 1 FROM ev e WHERE e.name = 'purchase'
               AND e.profile_id = v.profile_id AND e.product_id = v.product_id) AS booked,
       utm_source, device_type, geo_country
FROM viewed v LEFT JOIN profiles p ON p.profile_id = v.profile_id""",
    "pcb": """
SELECT *,
       CASE WHEN views = 0 THEN '0' WHEN views = 1 THEN '1' WHEN views = 2 THEN '2'
            WHEN views <= 4 THEN '3-4' WHEN views <= 9 THEN '5-9' ELSE '10+' END AS views_bucket,
       CASE WHEN views = 0 THEN 0 WHEN views = 1 THEN 1 WHEN views = 2 THEN 2
            WHEN views <= 4 THEN 3 WHEN views <= 9 THEN 4 ELSE 5 END AS v_order,
       CASE WHEN total_time = 0 THEN '0 (no duration)' WHEN total_time < 30 THEN '<30s'
            WHEN total_time < 60 THEN '30-60s' WHEN total_time < 180 THEN '1-3min'
            WHEN total_time < 600 THEN '3-10min' ELSE '10min+' END AS time_bucket,
       CASE WHEN total_time = 0 THEN 0 WHEN total_time < 30 THEN 1 WHEN total_time < 60 THEN 2
            WHEN total_time < 180 THEN 3 WHEN total_time < 600 THEN 4 ELSE 5 END AS t_order
FROM pc""",
    "cube": "SELECT date_utc AS date, device_type, utm_source, geo_country, count(*) AS sessions, "
    + ", ".join(f"count(*) FILTER (WHERE had_{s}) AS reached_{s}" for s in STEPS)
    + " FROM sess GROUP BY ALL",
    "hours": """
SELECT date_local, hour_local, count(*) FILTER (WHERE name = 'view') AS page_views,
       count(*) FILTER (WHERE name IN ('signup', 'purchase')) AS intent_events
FROM ev WHERE hour_local IS NOT NULL AND name IN ('view', 'signup', 'purchase')
GROUP BY date_local, hour_local""",
    "dest": """
SELECT destination, device_type, utm_source, count(id) AS views,
       count(DISTINCT session_id) AS sessions, count(DISTINCT profile_id) AS users
FROM ev WHERE destination IS NOT NULL AND name = 'view' GROUP BY ALL""",
    "utm": """
SELECT utm_source, device_type, count(*) AS sessions,
       count(*) FILTER (WHERE had_signup) AS atc_count,
       count(*) FILTER (WHERE had_purchase) AS order_count,
       count(*) FILTER (WHERE had_purchase) AS success_count,
       round(count(*) FILTER (WHERE had_signup)::DOUBLE / count(*) * 100, 3) AS atc_rate_pct,
       round(count(*) FILTER (WHERE had_purchase)::DOUBLE / count(*) * 100, 3) AS order_rate_pct
FROM sess GROUP BY ALL""",
    "dev": """
SELECT device_type, os_name, count(*) AS sessions,
       count(*) FILTER (WHERE had_signup) AS atc_count,
       count(*) FILTER (WHERE had_purchase) AS order_count,
       round(sum(num_events)::DOUBLE / count(*), 2) AS avg_events,
       round(sum(round(session_duration_min * 100)::BIGINT)::DOUBLE
             / count(session_duration_min) / 100, 2) AS avg_duration_min,
       round(count(*) FILTER (WHERE had_signup)::DOUBLE / count(*) * 100, 3) AS atc_rate_pct,
       round(count(*) FILTER (WHERE had_purchase)::DOUBLE / count(*) * 100, 3) AS order_rate_pct
FROM sess GROUP BY ALL""",
    "sizes": "SELECT session_id, count(*) AS n FROM ev WHERE session_id IS NOT NULL GROUP BY ALL",
    "sliced": """
SELECT * FROM sess WHERE device_type = 'mobile'
  AND date_utc BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
    "region": """
SELECT * FROM sess WHERE utm_source = 'src1' AND geo_country = 'US'
  AND date_utc BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'""",
    "steps": """
SELECT session_id, row_number() OVER w AS step, ts AS time, name AS event, type, page_url AS url,
       product_name, us, us / 1e6::DOUBLE AS secs
FROM dw WHERE session_id IS NOT NULL
WINDOW w AS (PARTITION BY session_id ORDER BY ts ASC NULLS LAST, id)""",
}
PREFIX = "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in BLOCKS.items()) + "\n"

TIMELINE = """
       step, time, event, type, url, product_name,
       CASE WHEN secs IS NULL THEN '— (event cuối / không đo được)'
            WHEN secs > 1800 THEN printf('%.0fs (> 30p, outlier)', secs)
            ELSE printf('%.1fs', secs) END AS duration,
       step || '. ' || coalesce(event, 'None') AS step_label,
       CASE WHEN secs > 0 AND secs <= 1800 THEN secs ELSE 0.0::DOUBLE END AS duration_plot
"""
RATES = """
       count(*) AS users,
       round(count(*) FILTER (WHERE intent)::DOUBLE / count(*) * 100, 2) AS intent_rate_pct,
       round(count(*) FILTER (WHERE booked)::DOUBLE / count(*) * 100, 2) AS booked_rate_pct
"""


def _funnel() -> str:
    reach = ", ".join(
        f"count(DISTINCT session_id) FILTER (WHERE name = '{s}') AS r{i}" for i, s in enumerate(STEPS)
    )
    rows = []
    for i, s in enumerate(STEPS):
        drop = (
            f"round((r{i - 1} - r{i})::DOUBLE / nullif(r{i - 1}, 0) * 100, 2)"
            if i
            else "NULL::DOUBLE"
        )
        rows.append(
            f"SELECT {i + 1} AS step_order, '{s}' AS step, r{i} AS sessions_reaching, "
            f"round(r{i}::DOUBLE / total * 100, 2) AS share_of_all_sessions_pct, "
            f"{drop} AS drop_from_previous_pct FROM reach"
        )
    return (
        f", reach AS (SELECT count(DISTINCT session_id) AS total, {reach} FROM ev)\n"
        + " UNION ALL ".join(rows)
    )


def _funnel_filtered() -> str:
    reach = ", ".join(f"count(*) FILTER (WHERE had_{s}) AS r{i}" for i, s in enumerate(STEPS))
    rows = []
    for i, s in enumerate(STEPS):
        earlier = ", ".join(f"nullif(r{j}, 0)" for j in range(i - 1, -1, -1))
        before = f"coalesce({earlier})" if i else "NULL"
        rows.append(
            f"SELECT {i + 1} AS step_order, '{s}' AS step, r{i} AS sessions, "
            f"coalesce(round(({before} - r{i})::DOUBLE / {before} * 100, 1), 0.0::DOUBLE) AS drop_pct "
            "FROM reach"
        )
    return f", reach AS (SELECT {reach} FROM sliced)\n" + " UNION ALL ".join(rows)


def _by_device() -> str:
    return " UNION ALL ".join(
        f"SELECT device_type AS device, {i + 1} AS step_order, '{s}' AS step, "
        f"count(*) FILTER (WHERE had_{s}) AS sessions, "
        f"round(count(*) FILTER (WHERE had_{s})::DOUBLE / count(*) * 100, 2) AS rate_pct "
        "FROM sess WHERE device_type IS NOT NULL GROUP BY device_type"
        for i, s in enumerate(STEPS)
    )


def _daily() -> str:
    return " UNION ALL ".join(
        f"SELECT date, '{s}' AS name, sum(reached_{s})::BIGINT AS count FROM cube "
        f"WHERE date IS NOT NULL GROUP BY date HAVING sum(reached_{s}) > 0"
        for s in STEPS
    )


def _profile() -> str:
    kinds = {"id": "bigint", "session_duration": "double"}
    columns = (
        "id create_text insert_text session_start session_duration session_id profile_id name type "
        "page_url page_title product_name utm_source utm_medium device_type os_name geo_country "
        "geo_city contact_email full_name"
    ).split()
    meanings = {
        "id": "number of the event",
        "session_start": "session: start",
        "session_duration": "session: duration",
        "session_id": "session: id",
        "name": "what happened",
        "page_url": "page: url",
        "page_title": "page: title",
        "product_name": "product: name",
        "utm_source": "campaign attribution: source",
        "utm_medium": "campaign attribution: medium",
        "device_type": "device: type",
        "os_name": "operating system: name",
        "geo_country": "place: country",
        "geo_city": "place: city",
    }
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{kinds.get(c, 'string')}' AS dtype, "
        f"'{meanings.get(c, '(unknown)')}' AS meaning, "
        f"count({c}) AS non_null, count(DISTINCT {c}) AS nunique, "
        f"coalesce(CASE WHEN length(min({c}::VARCHAR)) <= 120 THEN min({c}::VARCHAR) "
        f"ELSE left(min({c}::VARCHAR), 117) || '...' END, '') AS sample FROM clicks"
        for i, c in enumerate(columns)
    )


def _matrix(cell: str) -> str:
    aliases = ("t_none", "t_lt30s", "t_30_60s", "t_1_3min", "t_3_10min", "t_10min_up")
    cells = []
    for i, alias in enumerate(aliases):
        here = f"count(*) FILTER (WHERE t_order = {i})"
        if cell == "users":
            cells.append(f"nullif({here}, 0) AS {alias}")
        else:
            hits = f"count(*) FILTER (WHERE t_order = {i} AND intent)"
            cells.append(f"round({hits}::DOUBLE / nullif({here}, 0) * 100, 2) AS {alias}")
    return (
        "SELECT v_order AS bucket_order, views_bucket, "
        + ", ".join(cells)
        + " FROM pcb GROUP BY v_order, views_bucket"
    )


def _correlation() -> str:
    rows = []
    for metric in ("views", "total_time", "avg_time"):
        x = f"coalesce({metric}, 0)::DOUBLE"
        rows.append(
            f"SELECT '{metric}' AS metric, round(corr(x, y), 4) AS pearson_r, "
            "round(corr(rx, y), 4) AS spearman_r FROM ("
            "SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx "
            f"FROM (SELECT {x} AS x, intent::INT AS y FROM pc))"
        )
    return " UNION ALL ".join(rows)


def _metrics(rows: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS metric, ({expr})::DOUBLE AS value FROM {source}"
        for name, expr in rows.items()
    )


def _pipeline() -> str:
    return " UNION ALL ".join(
        (
            _metrics(
                {
                    "total_events": "count(*)",
                    "computable": "count(us)",
                    "computable_pct": "round(count(us)::DOUBLE / count(*) * 100, 1)",
                    "active_events": "count(*) FILTER (WHERE valid_us IS NOT NULL AND away)",
                    "unique_sessions": "count(DISTINCT session_id)",
                    "unique_profiles": "count(DISTINCT profile_id)",
                    "unique_links": "count(DISTINCT link)",
                },
                "dw",
            ),
            _metrics(
                {
                    "events_per_session_mean": "round(avg(n), 2)",
                    "events_per_session_median": "quantile_cont(n, 0.5)",
                    "events_per_session_max": "max(n)",
                    "sessions_with_1_event": "count(*) FILTER (WHERE n = 1)",
                    "sessions_with_1_event_pct": "round(count(*) FILTER (WHERE n = 1)::DOUBLE / count(*) * 100, 1)",
                },
                "sizes",
            ),
        )
    )


def _summary() -> str:
    def had(step: str) -> str:
        return f"count(*) FILTER (WHERE had_{step})"

    return " UNION ALL ".join(
        (
            _metrics(
                {
                    "total_events": "count(*)",
                    "unique_sessions": "count(DISTINCT session_id)",
                    "unique_profiles": "count(DISTINCT profile_id)",
                },
                "ev",
            ),
            _metrics(
                {
                    "sessions_with_search": had("click"),
                    "sessions_with_cart": had("signup"),
                    "sessions_with_order": had("purchase"),
                    "sessions_with_success": had("purchase"),
                    "cart_rate_pct": f"round({had('signup')}::DOUBLE / count(*) * 100, 3)",
                    "order_rate_pct": f"round({had('purchase')}::DOUBLE / count(*) * 100, 3)",
                    "avg_events_per_session": "round(sum(num_events)::DOUBLE / count(*), 2)",
                    "median_events_per_session": "floor(quantile_cont(num_events, 0.5))",
                    "avg_session_minutes": "round(sum(round(session_duration_min * 100)::BIGINT)::DOUBLE "
                    "/ count(session_duration_min) / 100, 2)",
                },
                "sess",
            ),
            _metrics(
                {
                    "viewed_pairs": "count(*)",
                    "pairs_with_intent": "count(*) FILTER (WHERE intent)",
                    "pairs_booked": "count(*) FILTER (WHERE booked)",
                    "intent_rate_pct": "round(count(*) FILTER (WHERE intent)::DOUBLE / count(*) * 100, 3)",
                    "booking_rate_pct": "round(count(*) FILTER (WHERE booked)::DOUBLE / count(*) * 100, 3)",
                },
                "pc",
            ),
        )
    )


# Over the given tables alone.
PLAIN = {
    "src_parquet": "SELECT event_type, count(*) AS events, max(ts) AS last_ts FROM events GROUP BY 1",
    "repair_text": "SELECT doc_id, text FROM documents",
    "repair_deep_text": "SELECT doc_id, text FROM documents",
    "repair_clean_text": "SELECT doc_id, text, lang FROM documents",
    "canonical_link": "SELECT page_id, split_part(url, '#', 1) AS link, "
    "split_part(split_part(url, '#', 1), '?', 1) AS bare_link FROM pages",
}

# Over the blocks.
ON_CLICKS = {
    "src_csv_roundtrip": "SELECT id, session_id, name, page_url, create_text FROM clicks",
    "src_glob_union": "SELECT cast(strftime(create_ts_raw, '%Y%m%d') AS INT) AS day, "
    "count(*) AS events, count(name) AS named FROM clicks GROUP BY 1",
    "sql_smoke": "SELECT 'sessions' AS source, count(*) AS n, sum(had_signup::INT)::BIGINT AS hits "
    "FROM sess UNION ALL SELECT 'pairs', count(*), sum(intent::INT)::BIGINT FROM pc",
    "filter_metadata": """
SELECT (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT utm_source AS v FROM ev)) AS utm_sources,
       (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT geo_country AS v FROM ev)) AS countries,
       (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT device_type AS v FROM ev)) AS devices,
       min(date_local) AS date_min, max(date_local) AS date_max, count(*) AS total_events,
       count(DISTINCT session_id) AS total_sessions, count(DISTINCT profile_id) AS total_profiles
FROM ev""",
    "filter_values": """
SELECT DISTINCT 'utm_sources' AS dimension, utm_source AS value FROM ev WHERE utm_source IS NOT NULL
UNION ALL SELECT DISTINCT 'countries', geo_country FROM ev WHERE geo_country IS NOT NULL
UNION ALL SELECT DISTINCT 'devices', device_type FROM ev WHERE device_type IS NOT NULL""",
    "project_keep": "SELECT id, session_id, name, page_url, utm_source, "
    "NULL::VARCHAR AS utm_term, contact_email FROM clicks",
    "drop_pii": "SELECT id, session_id, name, page_url, utm_source, NULL::VARCHAR AS utm_term, "
    "'id,session_id,name,page_url,utm_source,utm_term' AS kept_columns FROM clicks",
    "parse_ts": "SELECT id, create_text, try_cast(create_text AS TIMESTAMP) AS ts, "
    "try_cast(create_text AS TIMESTAMP) IS NOT NULL AS parsed FROM clicks",
    "url_extract": "SELECT id, product_id, destination FROM ev",
    "local_time": "SELECT id, hour(create_ts_raw + INTERVAL 7 HOUR)::INT AS hour_local, "
    "cast(create_ts_raw + INTERVAL 7 HOUR AS DATE) AS date_local FROM clicks",
    "column_profile": _profile(),
    "dwell_events": "SELECT id, session_id, profile_id, name, link, ts AS create_ts, next_ts, "
    "us / 1e6::DOUBLE AS duration_sec FROM dw",
    "active_events": "SELECT id, session_id, profile_id, name, type, NULL::VARCHAR AS journey_state, "
    "link, page_title, product_name, NULL::VARCHAR AS product_ref, ts AS create_ts, "
    "us / 1e6::DOUBLE AS duration_sec, utm_source, utm_medium, NULL::VARCHAR AS utm_campaign, "
    "device_type, geo_country, geo_city FROM dw WHERE valid_us IS NOT NULL AND away",
    "link_dwell": """
SELECT link, count(*) AS views, count(DISTINCT session_id) AS unique_sessions,
       count(DISTINCT profile_id) AS unique_users,
       round(sum(us)::BIGINT / 1e6::DOUBLE, 3) AS total_time_sec,
       round(sum(us)::BIGINT / 1e6::DOUBLE / count(*), 3) AS avg_time_sec,
       round(quantile_cont(us, 0.5) / 1e6, 3) AS median_time_sec,
       round(quantile_cont(us, 0.9) / 1e6, 3) AS p90_time_sec
FROM dw WHERE valid_us IS NOT NULL AND away AND link IS NOT NULL GROUP BY link""",
    "event_dwell": """
SELECT name, count(*) AS events_total, count(valid_us) AS events_measured,
       round(coalesce(sum(valid_us)::BIGINT / 1e6::DOUBLE / nullif(count(valid_us), 0), 0), 2) AS avg_sec,
       round(coalesce(quantile_cont(valid_us, 0.5) / 1e6, 0), 2) AS median_sec,
       round(coalesce(quantile_cont(valid_us, 0.9) / 1e6, 0), 2) AS p90_sec,
       round(coalesce(sum(valid_us)::BIGINT / 1e6::DOUBLE, 0), 2) AS total_sec,
       round(count(valid_us)::DOUBLE / count(*) * 100, 1) AS coverage_pct
FROM dw WHERE name IS NOT NULL GROUP BY name""",
    "duration_study": _metrics(
        {
            "rows": "count(*)",
            "unique_session_id": "count(DISTINCT session_id)",
            "unique_profile_id": "count(DISTINCT profile_id)",
            "unique_link": "count(DISTINCT link)",
            "session_duration_min": "min(session_duration)",
            "session_duration_max": "max(session_duration)",
            "session_duration_mean": "round(avg(session_duration), 3)",
            "has_create_ts": "count(ts)",
            "has_insert_ts": "count(try_cast(insert_text AS TIMESTAMP))",
            "has_session_start": "count(try_cast(session_start AS TIMESTAMP))",
        },
        "ev",
    ),
    "pipeline_summary": _pipeline(),
    "session_rollup": "SELECT *, NULL::VARCHAR AS utm_campaign FROM sess",
    "events_per_session": "SELECT session_id, n AS events_per_session FROM sizes",
    "session_explorer": "SELECT session_id, profile_id, num_events, num_unique_links, "
    "session_duration_min, utm_source, device_type, had_signup, had_purchase FROM sess "
    "WHERE num_events >= 3 AND (had_signup OR had_purchase) "
    "ORDER BY num_events DESC, session_id LIMIT 200",
    "session_timeline": f"SELECT session_id, {TIMELINE} FROM steps",
    "session_lookup": f"SELECT session_id, {TIMELINE} FROM steps WHERE session_id = "
    "(SELECT session_id FROM sizes ORDER BY n DESC, session_id LIMIT 1)",
    "session_timeline_totals": f"""
SELECT session_id, count(*) AS events,
       (epoch_us(max(time)) - epoch_us(min(time))) / 60000000.0::DOUBLE AS total_min,
       coalesce(sum(CASE WHEN us > {CAP} THEN {CAP} ELSE us END), 0)::BIGINT / 1e6::DOUBLE
           AS measured_sec
FROM steps GROUP BY session_id""",
    "kpi_filtered": """
SELECT count(*) AS sessions, count(DISTINCT profile_id) AS users,
       coalesce(sum(num_events), 0)::BIGINT AS events,
       count(*) FILTER (WHERE had_signup) AS cart_sessions,
       count(*) FILTER (WHERE had_purchase) AS order_sessions,
       count(*) FILTER (WHERE had_purchase) AS success_sessions,
       coalesce(round(count(*) FILTER (WHERE had_signup)::DOUBLE / nullif(count(*), 0) * 100, 2), 0)
           AS cart_rate_pct,
       coalesce(round(count(*) FILTER (WHERE had_purchase)::DOUBLE / nullif(count(*), 0) * 100, 2), 0)
           AS order_rate_pct
FROM sliced""",
    "event_sequence": "SELECT session_id, count(*) AS items, "
    "string_agg(step, ' > ' ORDER BY ts ASC NULLS LAST, id) AS event_sequence "
    "FROM named GROUP BY session_id",
    "link_sequence": "SELECT session_id, count(link) AS items, "
    "coalesce(string_agg(link, ' > ' ORDER BY ts ASC NULLS LAST, id), '') AS link_sequence "
    "FROM ev WHERE session_id IS NOT NULL GROUP BY session_id",
    "journeys": """
SELECT s.*, NULL::VARCHAR AS utm_campaign, event_sequence, link_sequence
FROM sess s
JOIN (SELECT session_id, string_agg(step, ' > ' ORDER BY ts ASC NULLS LAST, id) AS event_sequence
      FROM named GROUP BY session_id) n ON n.session_id = s.session_id
JOIN (SELECT session_id,
             coalesce(string_agg(link, ' > ' ORDER BY ts ASC NULLS LAST, id), '') AS link_sequence
      FROM ev WHERE session_id IS NOT NULL GROUP BY session_id) l ON l.session_id = s.session_id""",
    "session_pattern": "SELECT session_id, pattern, steps FROM pat",
    "patterns": "SELECT row_number() OVER (ORDER BY sessions DESC, pattern) AS rank, * FROM counted "
    "ORDER BY sessions DESC, pattern LIMIT 1000",
    "pattern_search": "SELECT * FROM (SELECT row_number() OVER (ORDER BY sessions DESC, pattern) "
    "AS rank, * FROM counted) WHERE regexp_matches(pattern, 'SIGNUP > (view|click)', 'i')",
    "pattern_search_totals": "SELECT count(*) AS patterns, coalesce(sum(sessions), 0)::BIGINT "
    "AS sessions FROM counted WHERE regexp_matches(pattern, 'purchase', 'i')",
    "patterns_filtered": """
, kept AS (SELECT * FROM pat SEMI JOIN sliced USING (session_id))
SELECT row_number() OVER (ORDER BY count(*) DESC, pattern) AS rank, pattern, count(*) AS sessions,
       round(count(*)::DOUBLE / (SELECT count(*) FROM kept) * 100, 2) AS share_pct
FROM kept GROUP BY pattern ORDER BY sessions DESC, pattern LIMIT 1000""",
    "funnel": _funnel(),
    "funnel_filtered": _funnel_filtered(),
    "funnel_by_device": _by_device(),
    "funnel_rollup": "SELECT * FROM cube",
    "daily_trend": _daily(),
    "product_conversion": "SELECT * FROM pc",
    "conv_by_views": f"SELECT v_order AS bucket_order, views_bucket, {RATES} FROM pcb GROUP BY 1, 2",
    "conv_by_time": f"SELECT t_order AS bucket_order, time_bucket, {RATES} FROM pcb GROUP BY 1, 2",
    "conv_filtered": f"SELECT v_order AS bucket_order, views_bucket, {RATES} FROM pcb "
    "WHERE device_type = 'mobile' GROUP BY 1, 2",
    "conv_cross": f"SELECT v_order AS views_order, views_bucket, t_order AS time_order, "
    f"time_bucket, {RATES} FROM pcb GROUP BY 1, 2, 3, 4",
    "conv_matrix": _matrix("intent_pct"),
    "conv_matrix_users": _matrix("users"),
    "correlation": _correlation(),
    "top_products": """
SELECT product_id,
       first(product_name ORDER BY views DESC, product_name DESC)
           FILTER (WHERE product_name IS NOT NULL) AS product_name,
       sum(views)::BIGINT AS total_views, count(DISTINCT profile_id) AS unique_users,
       sum(round(total_time * 1e6)::BIGINT)::BIGINT / 1e6::DOUBLE AS total_time,
       count(*) FILTER (WHERE intent) AS intents, count(*) FILTER (WHERE booked) AS bookings,
       round(count(*) FILTER (WHERE intent)::DOUBLE / count(DISTINCT profile_id) * 100, 2) AS conv_pct
FROM pc GROUP BY product_id ORDER BY total_views DESC, product_id LIMIT 200""",
    "top_products_by_name": """
SELECT product_id, product_name,
       sum(views)::BIGINT AS total_views, count(DISTINCT profile_id) AS unique_users,
       sum(round(total_time * 1e6)::BIGINT)::BIGINT / 1e6::DOUBLE AS total_time,
       count(*) FILTER (WHERE intent) AS intents, count(*) FILTER (WHERE booked) AS bookings,
       round(count(*) FILTER (WHERE intent)::DOUBLE / count(DISTINCT profile_id) * 100, 2) AS conv_pct
FROM pc WHERE product_name IS NOT NULL
GROUP BY product_id, product_name ORDER BY total_views DESC, product_id, product_name LIMIT 200""",
    "hourly_activity": "SELECT date_local, hour_local::INT AS hour_local, page_views, intent_events "
    "FROM hours",
    "hour_of_day": "SELECT hour_local::INT AS hour_local, sum(page_views)::BIGINT AS page_views, "
    "sum(intent_events)::BIGINT AS intent_events FROM hours GROUP BY 1",
    "hour_of_day_rate": """
SELECT hour_local::INT AS hour_local, sum(page_views)::BIGINT AS page_views,
       sum(intent_events)::BIGINT AS intent_events,
       round(sum(intent_events)::DOUBLE / nullif(sum(page_views), 0)::DOUBLE * 100, 2)
           AS intent_rate_pct
FROM hours WHERE date_local BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1""",
    "destinations": "SELECT * FROM dest",
    "top_destinations": """
SELECT destination, count(id) AS views, count(DISTINCT session_id) AS unique_sessions,
       count(DISTINCT profile_id) AS unique_users
FROM ev WHERE destination IS NOT NULL AND name = 'view'
GROUP BY 1 ORDER BY views DESC, destination LIMIT 30""",
    "top_destinations_summed": """
SELECT destination, sum(views)::BIGINT AS views, sum(sessions)::BIGINT AS sessions,
       sum(users)::BIGINT AS users
FROM dest WHERE device_type = 'mobile' GROUP BY 1 ORDER BY views DESC, destination LIMIT 15""",
    "geo": """
SELECT geo_country, geo_city, count(DISTINCT session_id) AS sessions, count(id) AS events
FROM ev WHERE geo_country IS NOT NULL AND geo_city IS NOT NULL
GROUP BY 1, 2 ORDER BY sessions DESC, geo_country, geo_city LIMIT 30""",
    "utm_sources": "SELECT * FROM utm",
    "utm_conversion": """
SELECT utm_source, count(*) AS sessions,
       round(count(*) FILTER (WHERE had_signup)::DOUBLE / count(*) * 100, 2) AS atc_rate_pct,
       round(count(*) FILTER (WHERE had_purchase)::DOUBLE / count(*) * 100, 2) AS order_rate_pct,
       round(sum(num_events)::DOUBLE / count(*), 2) AS avg_events
FROM sess GROUP BY 1""",
    "utm_performance": """
SELECT coalesce(utm_source, '(direct / không UTM)') AS utm_source, sessions, atc, "order",
       round(atc::DOUBLE / sessions * 100, 2) AS atc_pct,
       round("order"::DOUBLE / sessions * 100, 2) AS order_pct,
       concat(coalesce(utm_source, '(direct / không UTM)'), ' (', format('{:,}', sessions), ')') AS label
FROM (SELECT utm_source, sum(sessions)::BIGINT AS sessions, sum(atc_count)::BIGINT AS atc,
             sum(order_count)::BIGINT AS "order"
      FROM utm GROUP BY 1 ORDER BY sessions DESC, utm_source NULLS LAST LIMIT 10)""",
    "device_os": "SELECT * FROM dev",
    "device_share": """
SELECT device_type, count(*) AS sessions,
       round(count(*) FILTER (WHERE had_signup)::DOUBLE / count(*) * 100, 3) AS atc_rate_pct,
       round(count(*) FILTER (WHERE had_purchase)::DOUBLE / count(*) * 100, 3) AS order_rate_pct,
       round(sum(num_events)::DOUBLE / count(*), 2) AS avg_events,
       round(sum(round(session_duration_min * 100)::BIGINT)::DOUBLE
             / count(session_duration_min) / 100, 2) AS avg_duration_min,
       round(count(*)::DOUBLE / (SELECT count(*) FROM sess) * 100, 2) AS share_pct
FROM sess GROUP BY 1""",
    "device_share_unweighted": """
SELECT device_type, sum(sessions)::BIGINT AS sessions,
       round(sum(atc_count)::DOUBLE / sum(sessions)::DOUBLE * 100, 3) AS atc_rate_pct,
       round(sum(order_count)::DOUBLE / sum(sessions)::DOUBLE * 100, 3) AS order_rate_pct,
       round(avg(avg_events), 2) AS avg_events, round(avg(avg_duration_min), 2) AS avg_duration_min,
       round(sum(sessions)::DOUBLE / (SELECT count(*) FROM sess) * 100, 2) AS share_pct
FROM dev GROUP BY 1""",
    "os_breakdown": """
SELECT coalesce(os_name, 'Unknown') AS os_name, sum(num_events)::BIGINT AS events,
       count(*) AS sessions
FROM sess GROUP BY sess.os_name ORDER BY sessions DESC, sess.os_name NULLS LAST LIMIT 10""",
    "summary": _summary(),
}
# The filtered queries over the other slice.
ON_CLICKS |= {
    new: ON_CLICKS[old].replace("sliced", "region")
    for new, old in {
        "slice_kpis": "kpi_filtered",
        "slice_funnel": "funnel_filtered",
        "slice_patterns": "patterns_filtered",
    }.items()
}
ON_CLICKS |= {
    "slice_explorer": "SELECT session_id, profile_id, num_events, num_unique_links, "
    "session_duration_min, utm_source, device_type, had_signup, had_purchase FROM region "
    "WHERE num_events >= 2 AND had_purchase ORDER BY num_events DESC, session_id LIMIT 200",
    "slice_conversion": ON_CLICKS["conv_filtered"].replace(
        "device_type = 'mobile'", "utm_source = 'src1' AND geo_country = 'US'"
    ),
    "slice_destinations": ON_CLICKS["top_destinations"].replace(
        "name = 'view'",
        "name = 'view' AND utm_source = 'src1' AND geo_country = 'US' "
        "AND date_local BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'",
    ),
    "slice_sources": ON_CLICKS["utm_performance"].replace(
        "FROM utm GROUP BY", "FROM utm WHERE device_type = 'mobile' GROUP BY"
    ),
    "slice_daily_trend": " UNION ALL ".join(
        f"SELECT date_local AS date, '{s}' AS name, count(*) AS count FROM sess WHERE had_{s} "
        "AND utm_source = 'src1' AND geo_country = 'US' "
        "AND date_local BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' GROUP BY 1"
        for s in STEPS
    ),
    "hour_of_day_views_only": ON_CLICKS["hour_of_day"] + " HAVING sum(page_views) > 0",
    "active_events_everywhere": ON_CLICKS["active_events"].replace(" AND away", ""),
    "link_dwell_null_link": """
SELECT coalesce(link, '(none)') AS link, count(*) AS views, count(DISTINCT session_id) AS unique_sessions,
       count(DISTINCT profile_id) AS unique_users
FROM dw WHERE valid_us IS NOT NULL AND away GROUP BY 1""",
    "product_conversion_ordered": """
, firsts AS (SELECT profile_id, product_id, min(ts) AS seen FROM dw
             WHERE name = 'view' AND away AND product_id IS NOT NULL AND profile_id IS NOT NULL
             GROUP BY ALL)
SELECT v.profile_id, v.product_id, views,
       EXISTS (SELECT 1 FROM ev e WHERE e.name IN ('signup', 'purchase') AND e.ts > f.seen
               AND e.profile_id = v.profile_id AND e.product_id = v.product_id) AS intent,
       EXISTS (SELECT 1 FROM ev e WHERE e.name = 'purchase' AND e.ts > f.seen
               AND e.profile_id = v.profile_id AND e.product_id = v.product_id) AS booked
FROM viewed v JOIN firsts f ON f.profile_id = v.profile_id AND f.product_id = v.product_id""",
    "lookup_sql": "SELECT session_id, num_events, device_type, started_at FROM sess WHERE profile_id = 'u1'",
}
REGION = "utm_source = 'src1' AND geo_country = 'US' AND date_local BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'"
KEYS = ("date", "device_type", "utm_source", "geo_country")


def _grains() -> str:
    sets = {15: "overall", 11: "device", 7: "day", 0: "cube"}
    names = "CASE g " + " ".join(f"WHEN {bits} THEN '{name}'" for bits, name in sets.items()) + " END"
    reached = ", ".join(f"count(*) FILTER (WHERE had_{s}) AS reached_{s}" for s in STEPS)
    return f"""
SELECT {names} AS grain, * EXCLUDE (g) FROM (
  SELECT grouping_id({", ".join(KEYS)}) AS g, {", ".join(KEYS)}, count(*) AS sessions, {reached}
  FROM (SELECT *, date_utc AS date FROM sess)
  GROUP BY GROUPING SETS ((), (device_type), (date), ({", ".join(KEYS)})))"""


def _reach(seconds: int | None) -> str:
    """Steps in order, each level a running maximum of the start times that lead to the level before."""
    parts = [f"l1 AS (SELECT session_id, id, ts, name, CASE WHEN name = '{STEPS[0]}' THEN epoch_us(ts) END AS f1 FROM ev WHERE session_id IS NOT NULL AND ts IS NOT NULL)"]
    for i, step in enumerate(STEPS[1:], 2):
        within = f"AND epoch_us(ts) - b{i} <= {seconds * 1_000_000}" if seconds else ""
        before = f"max(f{i - 1}) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        parts.append(f"l{i} AS (SELECT *, CASE WHEN name = '{step}' {within} THEN b{i} END AS f{i} FROM (SELECT *, {before} AS b{i} FROM l{i - 1}))")
    columns = ", ".join(
        f"first(ts ORDER BY ts, id) FILTER (WHERE f{i} IS NOT NULL) AS at_{s}, first(epoch_us(ts) - f{i} ORDER BY ts, id) FILTER (WHERE f{i} IS NOT NULL) AS us_{s}"
        for i, s in enumerate(STEPS, 1)
    )
    parts.append(f"reach AS (SELECT session_id, {columns} FROM l{len(STEPS)} WHERE name IN {STEPS} GROUP BY session_id)")
    return ", " + ",\n".join(parts) + "\n"


def _in_order(seconds: int | None) -> str:
    rows = []
    for i, s in enumerate(STEPS):
        before = f"round(count(us_{s})::DOUBLE / nullif(count(us_{STEPS[i - 1]}), 0) * 100, 2)" if i else "NULL::DOUBLE"
        rows.append(
            f"SELECT {i + 1} AS step_order, '{s}' AS step, count(us_{s}) AS sessions, round(count(us_{s})::DOUBLE / nullif(count(us_{STEPS[0]}), 0) * 100, 2) AS from_first_pct, "
            f"{before} AS from_previous_pct, quantile_cont(us_{s}::DOUBLE, 0.5) / 1e6 AS median_sec, quantile_cont(us_{s}::DOUBLE, 0.9) / 1e6 AS p90_sec FROM reach"
        )
    return _reach(seconds) + " UNION ALL ".join(rows)


def _windows() -> str:
    """Stretches of a session without a silence of 30 minutes, closed an hour before the newest event."""
    first = ", ".join(
        f"first({c} ORDER BY ts, id) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in "profile_id utm_source utm_medium device_type os_name geo_country geo_city".split()
    )
    flags = ", ".join(f"coalesce(bool_or(name = '{s}'), false) AS had_{s}" for s in STEPS)
    return f"""
, gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM ev
           WHERE session_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY ts, id)),
stretches AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS stretch FROM gaps)
SELECT session_id, {first}, NULL::VARCHAR AS utm_campaign, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS num_events, {flags}, cast(min(ts) AS DATE) AS date_utc,
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0::DOUBLE, 2) AS session_duration_min
FROM stretches GROUP BY session_id, stretch HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ev)"""


ON_CLICKS |= {
    "destination_sketches": "SELECT *, true AS sessions_near, true AS users_near FROM (" + ON_CLICKS["slice_destinations"] + ")",
    "visitor_sketches": " UNION ALL ".join(
        f"SELECT {i} AS step_order, '{s}' AS step, count(*) AS sessions, count(DISTINCT profile_id) AS users, true AS users_near FROM sliced{'' if s == 'all' else f' WHERE had_{s}'}"
        for i, s in enumerate(("all", *STEPS))
    ),
    "link_dwell_sketches": f"""
SELECT link, count(*) AS views, round(sum(valid_us) / 1e6::DOUBLE, 6) AS total_time_sec, true AS median_near, true AS p90_near
FROM dw WHERE valid_us IS NOT NULL AND away AND link IS NOT NULL AND {REGION} GROUP BY link""",
    "event_dwell_sketches": """
SELECT name, count(valid_us) AS views, round(sum(valid_us) / 1e6::DOUBLE, 6) AS total_time_sec, round(sum(valid_us) / 1e6::DOUBLE / count(valid_us), 6) AS avg_time_sec
FROM dw WHERE valid_us IS NOT NULL AND name IS NOT NULL GROUP BY name""",
    "funnel_grains": _grains(),
    "funnel_in_order": _in_order(None),
    "funnel_in_order_within": _in_order(7200),
    "refreshed_sessions": ON_CLICKS["session_rollup"],
    "session_index": ON_CLICKS["session_lookup"],
    "published_funnel": ON_CLICKS["funnel"],
    "routed_slice": "SELECT device_type, count(*) AS sessions, " + ", ".join(f"count(*) FILTER (WHERE had_{s}) AS reached_{s}" for s in STEPS) + " FROM region GROUP BY device_type",
    "quarantine_counts": "SELECT 'unreadable create_text' AS reason, count(*) AS rows FROM ev WHERE ts IS NULL",
    "streamed_hours": """
SELECT cast(h + INTERVAL 7 HOUR AS DATE) AS date_local, hour(h + INTERVAL 7 HOUR)::INT AS hour_local,
       count(*) FILTER (WHERE name = 'view') AS page_views, count(*) FILTER (WHERE name IN ('signup', 'purchase')) AS intent_events
FROM (SELECT *, date_trunc('hour', ts) AS h FROM ev WHERE name IN ('view', 'signup', 'purchase') AND ts IS NOT NULL)
WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ev) GROUP BY h""",
    "streamed_sessions": _windows(),
    "reach_in_order": _reach(86_400) + "SELECT * FROM reach",
}
ORACLES = PLAIN | {name: PREFIX + sql for name, sql in ON_CLICKS.items()}
