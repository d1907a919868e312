"""Clickstream journey and conversion analytics on Spark DataFrames."""

from .operators.cleaning import canonical_events
from .session import configure
from .spec import EventSpec, FilterSpec, Limits, Step, homepage_spellings, travel_spec

__all__ = [
    "EventSpec",
    "FilterSpec",
    "Limits",
    "Step",
    "canonical_events",
    "configure",
    "homepage_spellings",
    "travel_spec",
]
