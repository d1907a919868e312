"""Link, product id and destination from a page URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_link(url: Column, strip_query: bool = False) -> Column:
    """The URL without its fragment, and without its query if asked."""
    link = F.substring_index(url, "#", 1)
    return F.substring_index(link, "?", 1) if strip_query else link


def first_group(text: Column, pattern: str) -> Column:
    """The first capture of `pattern`, null where it does not match."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
