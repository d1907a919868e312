"""Who viewed which product, for how long, and whether they went on to buy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import TIME_BUCKETS, VIEW_BUCKETS, BucketSpec
from ..functions.rates import count_true, percent
from ..functions.times import naive, seconds, valid_dwell
from ..spec import EventSpec, FilterSpec
from .dwell import not_homepage, with_dwell
from .sessions import first_known
from .statistics import correlations

# The attributes of a profile follow the text order of its sessions unless time order is asked for.
PROFILE_ATTRIBUTES = ("utm_source", "device_type", "geo_country")


def profile_attributes(sessions: DataFrame, by_time: bool = False) -> DataFrame:
    """First known source, device and country of each profile."""
    order = F.col("session_id")
    if by_time:
        order = F.struct(F.col("started_at").isNull(), F.col("started_at"), F.col("session_id"))
    return (
        sessions.filter(F.col("profile_id").isNotNull())
        .groupBy("profile_id")
        .agg(*(first_known(c, order).alias(c) for c in PROFILE_ATTRIBUTES))
    )


def product_conversion(
    events: DataFrame,
    sessions: DataFrame,
    spec: EventSpec,
    ordered_intent: bool = False,
    attributes_by_time: bool = False,
) -> DataFrame:
    """One row per profile and product it viewed.

    views, total and average valid dwell seconds, product name, last visit, whether the profile
    showed intent for or booked that product, and the profile's attributes. Intent may precede the
    view unless `ordered_intent`. Views, intents and bookings come out of one aggregation.
    """
    needed = "id session_id profile_id name link create_ts product_id product_name".split()
    timed = with_dwell(events, spec, needed)
    timed = timed.filter(F.col("profile_id").isNotNull() & F.col("product_id").isNotNull())
    viewed = (F.col("name") == spec.view_event) & not_homepage(spec)

    def of_view(value: Column) -> Column:
        return F.when(viewed, value)

    def any_of(names: tuple[str, ...]) -> Column:
        return F.coalesce(F.bool_or(F.col("name").isin(*names)), F.lit(False))

    def last_of(names: tuple[str, ...]) -> Column:
        return F.max(F.when(F.col("name").isin(*names), F.col("create_ts")))

    order = F.struct(
        F.col("session_id").isNull(),
        F.col("session_id"),
        F.col("create_ts").isNull(),
        F.col("create_ts"),
        F.col("id"),
    )
    us = valid_dwell(F.col("dwell_us"), spec.cap_us)
    columns = [
        count_true(viewed).alias("view_rows"),
        F.count(of_view(F.col("id"))).alias("views"),
        F.coalesce(F.sum(of_view(us)), F.lit(0)).alias("us"),
        F.count(of_view(us)).alias("measured"),
        F.min_by(
            "product_name", F.when(viewed & F.col("product_name").isNotNull(), order)
        ).alias("product_name"),
        F.max(of_view(F.col("create_ts"))).alias("last_ts"),
        any_of(spec.intent_events).alias("intent"),
        any_of(spec.booking_events).alias("booked"),
    ]
    intent, booked = F.col("intent"), F.col("booked")
    if ordered_intent:
        columns += [
            F.min(of_view(F.col("create_ts"))).alias("first_view"),
            last_of(spec.intent_events).alias("last_intent"),
            last_of(spec.booking_events).alias("last_booking"),
        ]
        after = F.col("first_view")
        intent = F.coalesce(F.col("last_intent") > after, F.lit(False))
        booked = F.coalesce(F.col("last_booking") > after, F.lit(False))
    pairs = timed.groupBy("profile_id", "product_id").agg(*columns).filter(F.col("view_rows") > 0)
    pairs = pairs.select(
        "profile_id",
        "product_id",
        "views",
        seconds(F.col("us")).alias("total_time"),
        F.try_divide(seconds(F.col("us")), F.col("measured")).alias("avg_time"),
        "product_name",
        naive(F.col("last_ts")).alias("last_visit"),
        intent.alias("intent"),
        booked.alias("booked"),
    )
    return pairs.join(profile_attributes(sessions, attributes_by_time), "profile_id", "left")


def filter_conversion(pairs: DataFrame, filters: FilterSpec) -> DataFrame:
    """The pairs of one slice. They carry no date to filter by."""
    return filters.apply(pairs)


def _rates() -> list[Column]:
    pairs = F.count(F.lit(1))
    return [
        pairs.alias("users"),
        percent(count_true(F.col("intent")), pairs, 2).alias("intent_rate_pct"),
        percent(count_true(F.col("booked")), pairs, 2).alias("booked_rate_pct"),
    ]


def conversion_by(pairs: DataFrame, value: str, name: str, buckets: BucketSpec) -> DataFrame:
    """Pairs and rates per bucket of `value`, with the bucket's sort position."""
    return pairs.groupBy(
        buckets.order(F.col(value)).alias("bucket_order"), buckets.label(F.col(value)).alias(name)
    ).agg(*_rates())


def conversion_by_views(pairs: DataFrame) -> DataFrame:
    return conversion_by(pairs, "views", "views_bucket", VIEW_BUCKETS)


def conversion_by_time(pairs: DataFrame) -> DataFrame:
    return conversion_by(pairs, "total_time", "time_bucket", TIME_BUCKETS)


def conversion_cross(pairs: DataFrame) -> DataFrame:
    """Pairs and rates per views bucket and time bucket, with the sort positions of both."""
    return pairs.groupBy(
        VIEW_BUCKETS.order(F.col("views")).alias("views_order"),
        VIEW_BUCKETS.label(F.col("views")).alias("views_bucket"),
        TIME_BUCKETS.order(F.col("total_time")).alias("time_order"),
        TIME_BUCKETS.label(F.col("total_time")).alias("time_bucket"),
    ).agg(*_rates())


def conversion_matrix(pairs: DataFrame, cell: str = "intent_pct") -> DataFrame:
    """Views buckets as rows, time buckets as columns, `intent_pct` or `users` in the cells.

    The columns are fixed by the bucket list, so no pass over the data is needed to find them. A
    cell without pairs is null, a row without any is absent.
    """
    value = {
        "intent_pct": percent(count_true(F.col("intent")), F.count(F.lit(1)), 2),
        "users": F.count(F.lit(1)),
    }[cell]
    return (
        pairs.select(
            VIEW_BUCKETS.order(F.col("views")).alias("bucket_order"),
            VIEW_BUCKETS.label(F.col("views")).alias("views_bucket"),
            TIME_BUCKETS.pick(F.col("total_time"), TIME_BUCKETS.aliases).alias("t"),
            "intent",
        )
        .groupBy("bucket_order", "views_bucket")
        .pivot("t", list(TIME_BUCKETS.aliases))
        .agg(value)
    )


def shown_columns(matrix: DataFrame) -> DataFrame:
    """The matrix without the time buckets that no row has, as a report shows it.

    Looks at the matrix, which has at most one row per views bucket.
    """
    cells = [c for c in matrix.columns if c not in ("bucket_order", "views_bucket")]
    filled = matrix.agg(*(F.count(c).alias(c) for c in cells)).first()
    return matrix.drop(*(c for c in cells if filled[c] == 0))


def conversion_correlation(pairs: DataFrame) -> DataFrame:
    """Correlation of views, total and average time with intent."""
    return correlations(pairs, ("views", "total_time", "avg_time"), "intent")


def top_products(pairs: DataFrame, limit: int = 200, by_name: bool = False) -> DataFrame:
    """The most viewed products with users, time, intents, bookings and conversion.

    A product is its id, shown under the name with the most views. With `by_name` each spelling of
    the name counts as its own product and nameless ones are left out. Each pair is one user.
    """
    if by_name:
        groups = pairs.filter(F.col("product_name").isNotNull()).groupBy(
            "product_id", "product_name"
        )
        name = []
    else:
        groups = pairs.groupBy("product_id")
        named = F.when(F.col("product_name").isNotNull(), F.struct("views", "product_name"))
        name = [F.max_by("product_name", named).alias("product_name")]
    totals = groups.agg(
        *name,
        F.sum("views").alias("total_views"),
        F.count(F.lit(1)).alias("unique_users"),
        F.sum(F.round(F.col("total_time") * 1_000_000).cast("long")).alias("us"),
        count_true(F.col("intent")).alias("intents"),
        count_true(F.col("booked")).alias("bookings"),
    )
    ties = ["product_id"] + (["product_name"] if by_name else [])
    return (
        totals.orderBy(F.desc("total_views"), *ties)
        .limit(limit)
        .select(
            "product_id",
            "product_name",
            "total_views",
            "unique_users",
            seconds(F.col("us")).alias("total_time"),
            "intents",
            "bookings",
            percent(F.col("intents"), F.col("unique_users"), 2).alias("conv_pct"),
        )
    )
