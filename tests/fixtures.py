"""Small literal event tables."""

from __future__ import annotations

from stridelog import EventSpec, Step, canonical_events

SCHEMA = (
    "id long, session_id string, profile_id string, name string, type string, created string, "
    "page_url string, product_name string, utm_source string, device_type string, os_name string, "
    "geo_country string, geo_city string"
)
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]
SPEC = EventSpec(
    columns={c: c for c in COLUMNS},
    steps=tuple(Step(n, n) for n in ("view", "search", "cart", "order", "done")),
    view_event="view",
    intent_events=("cart", "order"),
    booking_events=("order",),
    search_key="search",
    cart_key="cart",
    order_key="order",
    success_key="done",
    homepages=("https://a.example/", "https://a.example", "http://a.example/", "http://a.example"),
)


def at(seconds: float) -> str:
    """ISO time `seconds` after 2024-01-01 10:00 UTC."""
    whole, part = divmod(round(seconds * 1000), 1000)
    return (
        f"2024-01-01T{10 + whole // 3600:02d}:{whole // 60 % 60:02d}:{whole % 60:02d}.{part:03d}Z"
    )


def raw_events(spark, *rows: dict):
    """Rows of the raw table; the id counts up unless given, anything else is null."""
    data = [
        tuple({"id": i + 1, **row}.get(c) for c in COLUMNS) for i, row in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


def events_of(spark, *rows: dict, spec: EventSpec = SPEC):
    return canonical_events(raw_events(spark, *rows), spec)


def records(df, *order: str) -> list[dict]:
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def only(df) -> dict:
    (row,) = records(df)
    return row
