"""What the event table looks like and how the analytics read it.

Everything site-specific is a value of :class:`EventSpec`: column names, event names, URL patterns,
home pages, the local-time offset. Operators take ``(DataFrame, EventSpec)`` and hold no site names.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Logical event columns and their types. The required ones must exist in the source; the others
# become typed nulls when missing, so every derived schema is fixed. duration_sec, the dwell time
# that a clean event table already holds, is only there when the source has it.
REQUIRED_COLUMNS = ("id", "session_id", "created")
EVENT_COLUMNS = {
    "id": None,  # kept in the source's own type, it only breaks ties
    "session_id": "string",
    "profile_id": "string",
    "name": "string",
    "type": "string",
    "journey_state": "string",
    "created": None,
    "inserted": None,
    "session_start": None,
    "session_duration": "double",
    "duration_sec": "double",
    "page_url": "string",
    "page_title": "string",
    "product_name": "string",
    "product_ref": "string",
    "utm_source": "string",
    "utm_medium": "string",
    "utm_campaign": "string",
    "device_type": "string",
    "os_name": "string",
    "geo_country": "string",
    "geo_city": "string",
}


@dataclass(frozen=True)
class Step:
    """One funnel step: the event name in the data and the short key used in column names."""

    name: str
    key: str

    @property
    def had(self) -> str:
        return f"had_{self.key}"

    @property
    def reached(self) -> str:
        return "reached_" + self.name.replace(" ", "_")


@dataclass(frozen=True)
class Limits:
    """Sizes that decide between the plain plan and the one for data too large for one task.

    No limit drops rows. Each one only selects how the same rows are laid out.
    """

    # A session with more rows than this is ordered over many partitions.
    hot_session_rows: int = 2_000_000
    # Rows per range partition of the hot sessions, and the most partitions used for them.
    chunk_rows: int = 1_000_000
    max_chunks: int = 20_000


@dataclass(frozen=True)
class EventSpec:
    """Names, patterns and constants of one site's event table."""

    columns: Mapping[str, str]
    steps: tuple[Step, ...]
    view_event: str
    intent_events: tuple[str, ...]
    booking_events: tuple[str, ...]
    cart_key: str
    order_key: str
    success_key: str
    search_key: str
    homepages: tuple[str, ...] = ()
    product_pattern: str = r"-pid-(\d+)"
    destination_pattern: str = r"/du-lich-([a-zA-Z0-9\-]+)\.aspx"
    utc_offset_hours: int = 7
    cap_seconds: int = 1800
    separator: str = " > "
    # Text that stands for a null event name inside a path.
    null_name: str = "None"
    # Set to a text to count a null link as one link of that name; None leaves it uncounted.
    null_link: str | None = None
    direct_label: str = "(direct / không UTM)"
    unknown_label: str = "Unknown"
    limits: Limits = field(default_factory=Limits)
    # The sessions over the size limit, once `ordering.measured` has looked; None is the plain plan.
    hot: Any = None

    @property
    def cap_us(self) -> int:
        return self.cap_seconds * 1_000_000

    def step(self, key: str) -> Step:
        return next(s for s in self.steps if s.key == key)

    @property
    def conversion_flags(self) -> tuple[str, str, str]:
        """The session flags of the cart, order and success steps."""
        keys = (self.cart_key, self.order_key, self.success_key)
        return tuple(self.step(key).had for key in keys)

    def with_limits(self, **sizes: int) -> "EventSpec":
        return replace(self, limits=replace(self.limits, **sizes), hot=None)


def homepage_spellings(host: str) -> tuple[str, ...]:
    """The four exact home page URLs of a host: both schemes, with and without the last slash."""
    return tuple(f"{scheme}://{host}{end}" for scheme in ("https", "http") for end in ("/", ""))


# The column and event names of the travel-site event table.
TRAVEL_COLUMNS = {
    "id": "id",
    "session_id": "session_id",
    "profile_id": "profile_id",
    "name": "name",
    "type": "type",
    "journey_state": "journey_state",
    "created": "create",
    "inserted": "insert",
    "session_start": "session_start",
    "session_duration": "session_duration",
    "duration_sec": "duration_sec",
    "page_url": "context_page_url",
    "page_title": "context_page_title",
    "product_name": "context_page_ld_name",
    "product_ref": "context_page_ld_productID",
    "utm_source": "utm_source",
    "utm_medium": "utm_medium",
    "utm_campaign": "utm_campaign",
    "device_type": "device_type",
    "os_name": "os_name",
    "geo_country": "device_geo_country_code",
    "geo_city": "device_geo_city",
}
TRAVEL_STEPS = (
    Step("Page View", "page_view"),
    Step("Search Tour", "search"),
    Step("Add To Cart", "add_to_cart"),
    Step("Order Booking", "order"),
    Step("Booking Success", "success"),
)


def travel_spec(host: str, **changes) -> EventSpec:
    """The five-step travel-site configuration for the site at `host`."""
    spec = EventSpec(
        columns=TRAVEL_COLUMNS,
        steps=TRAVEL_STEPS,
        view_event="Page View",
        intent_events=("Add To Cart", "Order Booking"),
        booking_events=("Order Booking",),
        search_key="search",
        cart_key="add_to_cart",
        order_key="order",
        success_key="success",
        homepages=homepage_spellings(host),
    )
    return replace(spec, **changes)


@dataclass(frozen=True)
class FilterSpec:
    """Optional slice of a table by device, source, country and an inclusive date range.

    A part applies only where it is set; the dates apply only if both are given, and then reject a
    null date. A table without the column of a part that is set is an error: a part is left out by
    `without`, never silently.
    """

    device: str | None = None
    source: str | None = None
    country: str | None = None
    date_from: date | None = None
    date_to: date | None = None

    def without(self, *parts: str) -> "FilterSpec":
        """The filter without some of its parts (device, source, country, date)."""
        names = {"device": ("device",), "source": ("source",), "country": ("country",), "date": ("date_from", "date_to")}
        return replace(self, **{field: None for part in parts for field in names[part]})

    def parts(self, date_column: str = "date_utc") -> dict[str, Column]:
        """The conditions that are set, by the column each one reads."""
        wanted = {"device_type": self.device, "utm_source": self.source, "geo_country": self.country}
        found = {c: F.col(c) == F.lit(value) for c, value in wanted.items() if value is not None}
        if self.date_from is not None and self.date_to is not None:
            day = F.col(date_column)
            found[date_column] = day.isNotNull() & day.between(F.lit(self.date_from), F.lit(self.date_to))
        return found

    def apply(self, df: DataFrame, date_column: str = "date_utc") -> DataFrame:
        """The rows of the slice."""
        parts = self.parts(date_column)
        missing = sorted(set(parts) - set(df.columns))
        if missing:
            raise ValueError(f"the table cannot be filtered by {', '.join(missing)}: it has no such column")
        for condition in parts.values():
            df = df.filter(condition)
        return df
