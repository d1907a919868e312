"""A click table derived from the shared `events` test table, in SQL both engines understand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..spec import EventSpec, Step

CLICKS_SQL = """
SELECT event_id AS id,
       ts AS create_ts_raw,
       CASE WHEN event_id % 50 = 7 THEN 'not-a-date' ELSE cast(ts AS string) END AS create_text,
       CASE WHEN event_id % 70 = 3 THEN NULL ELSE cast(ts AS string) END AS insert_text,
       cast(cast(ts AS date) AS string) AS session_start,
       value AS session_duration,
       CASE WHEN event_id % 89 = 0 THEN NULL
            ELSE concat('s', user_id, '-', cast(cast(ts AS date) AS string)) END AS session_id,
       CASE WHEN event_id % 83 = 0 THEN NULL ELSE concat('u', user_id) END AS profile_id,
       CASE WHEN event_id % 101 = 0 THEN NULL ELSE event_type END AS name,
       concat('t-', event_type) AS type,
       CASE WHEN event_id % 97 = 0 THEN NULL
            WHEN k % 10 = 0 THEN 'https://shop.example/'
            WHEN k % 10 = 1 THEN concat('https://shop.example/du-lich-place-', k, '.aspx')
            ELSE concat('https://shop.example/item-pid-', k % 20,
                        CASE WHEN event_id % 3 = 0 THEN '#top' ELSE '' END) END AS page_url,
       concat('Page ', k) AS page_title,
       CASE WHEN k % 13 = 0 THEN NULL ELSE concat('Item ', k % 20) END AS product_name,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('src', user_id % 5) END AS utm_source,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('med', user_id % 3) END AS utm_medium,
       CASE user_id % 4 WHEN 0 THEN 'mobile' WHEN 1 THEN 'pc' WHEN 2 THEN 'tablet' END AS device_type,
       CASE user_id % 3 WHEN 0 THEN 'iOS' WHEN 1 THEN 'Windows' END AS os_name,
       CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'VN' ELSE 'US' END AS geo_country,
       CASE WHEN user_id % 11 = 0 THEN NULL ELSE concat('city', user_id % 6) END AS geo_city,
       concat('u', user_id, '@mail.example') AS contact_email,
       concat('User ', user_id) AS full_name
FROM (SELECT event_id, ts, user_id, event_type, value,
             cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k
      FROM {events}) b
"""

CLICKS_SPEC = EventSpec(
    columns={
        "id": "id",
        "session_id": "session_id",
        "profile_id": "profile_id",
        "name": "name",
        "type": "type",
        "created": "create_text",
        "inserted": "insert_text",
        "session_start": "session_start",
        "session_duration": "session_duration",
        "duration_sec": "duration_sec",
        "page_url": "page_url",
        "page_title": "page_title",
        "product_name": "product_name",
        "utm_source": "utm_source",
        "utm_medium": "utm_medium",
        "device_type": "device_type",
        "os_name": "os_name",
        "geo_country": "geo_country",
        "geo_city": "geo_city",
    },
    steps=tuple(Step(n, n) for n in ("view", "click", "signup", "purchase")),
    view_event="view",
    intent_events=("signup", "purchase"),
    booking_events=("purchase",),
    search_key="click",
    cart_key="signup",
    order_key="purchase",
    success_key="purchase",
    homepages=("https://shop.example/",),
)
CLICKS_PII = ("contact_email", "full_name")


def clicks(spark: SparkSession, folder: str) -> DataFrame:
    """The click table over `folder`/events.parquet."""
    return clicks_of(spark, spark.read.parquet(f"{folder.rstrip('/')}/events.parquet"))


def clicks_of(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The click table over an events table, or a stream of it."""
    return spark.sql(CLICKS_SQL, events=events)
