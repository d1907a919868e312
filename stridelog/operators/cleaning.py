"""Projection, personal-data removal, text repair, and the canonical event table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import resolve_escapes, undo_misread
from ..functions.times import local_date, local_hour, parsed_time
from ..functions.urls import canonical_link, first_group
from ..spec import EVENT_COLUMNS, REQUIRED_COLUMNS, EventSpec

# The columns of the travel-site table that carry analytic meaning.
KEEP_COLUMNS = (
    "id", "name", "type", "hit_name", "journey_state", "session_id", "profile_id", "create",
    "insert", "session_start", "session_duration", "context_page_url", "context_page_path",
    "context_page_title", "context_page_referer_host", "hit_url", "hit_referer",
    "context_page_ld_category", "context_page_ld_name", "context_page_ld_productID",
    "context_page_ld_sku", "context_page_ld_offers_price", "context_page_ld_offers_priceCurrency",
    "context_page_ld_offers_availability", "context_page_ld_aggregateRating_ratingValue",
    "context_page_ld_aggregateRating_reviewCount", "utm_source", "utm_medium", "utm_campaign",
    "utm_content", "utm_term", "device_type", "device_name", "device_brand", "device_model",
    "device_resolution", "device_orientation", "os_name", "os_version", "app_name", "app_version",
    "device_geo_country_code", "device_geo_country_name", "device_geo_city",
    "properties_tour_code", "properties_tour_name", "properties_tour_price",
    "properties_tourCode", "properties_tourType", "properties_code", "properties_name",
    "properties_page_code", "properties_button", "properties_bookingNo",
    "properties_bookingAmount", "properties_paymentType", "properties_customerNo",
    "properties_fullName", "properties_gender", "properties_contactInfo_contactName",
    "properties_contactInfo_email", "properties_contactInfo_phoneNumber",
    "properties_contactInfo_address", "properties_contactInfo_note",
)
# The kept columns that identify a person.
PII_COLUMNS = (
    "properties_contactInfo_email", "properties_contactInfo_phoneNumber",
    "properties_contactInfo_address", "properties_contactInfo_contactName",
    "properties_contactInfo_note", "properties_fullName", "properties_gender",
)


def missing_columns(df: DataFrame, keep: Iterable[str]) -> list[str]:
    return [c for c in keep if c not in df.columns]


def project_keep(
    df: DataFrame,
    keep: Iterable[str] = KEEP_COLUMNS,
    types: Mapping[str, str] | None = None,
    fill_missing: bool = True,
) -> DataFrame:
    """Exactly the columns of `keep`, in that order.

    One the source lacks becomes a null of the type in `types` (text by default), or is left out
    with `fill_missing=False`; `missing_columns` tells which.
    """
    types = types or {}
    have = set(df.columns)
    return df.select(
        *(
            F.col(f"`{c}`") if c in have else F.lit(None).cast(types.get(c, "string")).alias(c)
            for c in keep
            if fill_missing or c in have
        )
    )


def drop_pii(df: DataFrame, pii: Iterable[str] = PII_COLUMNS) -> DataFrame:
    return df.drop(*pii)


def repair_text(df: DataFrame, columns: Iterable[str] | None = None, passes: int = 3) -> DataFrame:
    """Undo misread encodings in the given text columns, or in all of them.

    Resolves escaped code points, then undoes up to `passes` layers. Each layer is a projection of
    its own: nested in one expression, every layer would compute the one below it several times.
    """
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    wanted = [c for c in df.columns if c in (text if columns is None else text & set(columns))]
    if not wanted:
        return df
    for repair in (resolve_escapes, *[undo_misread] * passes):
        df = df.withColumns({c: repair(F.col(f"`{c}`")) for c in wanted})
    return df


#: Columns of a clean event table that need not be derived again.
STORED = {("create_ts", "timestamp"), ("link", "string"), ("date_utc", "date")}


def canonical_events(raw: DataFrame, spec: EventSpec) -> DataFrame:
    """The event table under its logical names, with time, link, product and place derived.

    Adds create_ts, insert_ts, session_start_ts, link, product_id, destination, hour_local and
    date_local. Times that do not parse and URLs that do not match give nulls. What a clean event
    table has stored is taken from it: create_ts, link, the partition column date_utc, and dwell times
    as dwell_us, so that no operator computes them again.
    """
    lost = [c for c in REQUIRED_COLUMNS if spec.columns.get(c) not in raw.columns]
    if lost:
        raise ValueError(f"the source has no column for: {lost}")

    def source(logical: str):
        physical = spec.columns.get(logical)
        return raw[physical] if physical in raw.columns else None

    picked = []
    for logical, kind in EVENT_COLUMNS.items():
        value = source(logical)
        if logical == "duration_sec":
            if value is not None:
                picked.append(F.round(value.cast(kind) * 1_000_000).cast("long").alias("dwell_us"))
            continue
        if value is None:
            value = F.lit(None).cast(kind or "string")
        elif kind is not None:
            value = value.cast(kind)
        picked.append(value.alias(logical))
    stored = {f.name for f in raw.schema.fields if (f.name, f.dataType.typeName()) in STORED}
    stored = stored if {"create_ts", "link"} <= stored else set()
    events = raw.select(*picked, *(raw[c].alias(f"_{c}") for c in sorted(stored)))

    url = F.col("page_url")
    link = F.col("_link") if stored else canonical_link(url)
    if spec.null_link is not None:
        link = F.coalesce(link, F.lit(spec.null_link))
    gone = {"created", "inserted", "session_start", *(f"_{c}" for c in stored)}
    kept = [c for c in events.columns if c not in gone]
    events = events.select(
        *kept,
        (F.col("_create_ts") if stored else parsed_time(events, "created")).alias("create_ts"),
        *([F.col("_date_utc").alias("date_utc")] if "date_utc" in stored else []),
        parsed_time(events, "inserted").alias("insert_ts"),
        parsed_time(events, "session_start").alias("session_start_ts"),
        link.alias("link"),
        first_group(url, spec.product_pattern).alias("product_id"),
        first_group(url, spec.destination_pattern).alias("destination"),
    )
    return events.select(
        "*",
        local_hour(F.col("create_ts"), spec.utc_offset_hours).alias("hour_local"),
        local_date(F.col("create_ts"), spec.utc_offset_hours).alias("date_local"),
    )
