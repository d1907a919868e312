"""Secret scan with corpus-wide ownership of every candidate value.

Native patterns give the spans of a text. The hashed value of each candidate is then counted over the
whole corpus: in how many documents (repositories) and of how many sources (owners) it stands. A
value that many owners share is a copied example; one that few owners hold is a live-looking
credential of theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelog.llm.text import same_row, sized, text_of
from stridelog.session import written

# The base kinds, in the order in which equal starts are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Added kinds: key blocks, three-part web tokens, and long values that mix letters of both cases with digits.
BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
WEB = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
MIXED = ("[0-9]", "[a-z]", "[A-Z]")

#: kind, its rank, pattern, the group that holds the value, least length of that group, what it must contain
KINDS = (
    ("assign", 0, ASSIGN, 2, 6, ()),
    ("access", 1, ACCESS, 0, 20, ()),
    ("hex", 2, HEX, 0, 24, ()),
    ("block", 3, BLOCK, 0, 1, ()),
    ("web", 4, WEB, 0, 1, ()),
    ("opaque", 5, OPAQUE, 0, 24, MIXED),
)

SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def _matches(text: Column, kind: str, rank: int, pattern: str, group: int, least: int, holds: tuple[str, ...]) -> Column:
    """Spans of all matches, leftmost first, in code points.

    Splitting at the pattern gives the gaps between the matches; what stands before a match is all
    earlier gaps and matches.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    empty = F.struct(F.lit(0).alias("at"), F.expr("array()").cast(SPAN).alias("spans"))

    def step(done, piece):
        start = done.at + F.length(piece.gap)
        end = start + F.length(piece.whole)
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"),
            piece.value.alias("value"),
        )
        good = F.coalesce(F.length(piece.value) >= F.lit(least), F.lit(False))
        for part in holds:
            good = good & piece.value.rlike(part)
        added = F.when(good, F.concat(done.spans, F.array(span))).otherwise(done.spans)
        return F.struct(F.coalesce(end, start).alias("at"), added.alias("spans"))

    found = F.aggregate(pieces, empty, step, lambda done: done.spans)
    return F.when(text.rlike(pattern), found).otherwise(F.expr("array()").cast(SPAN))


def secret_spans(documents: DataFrame, kinds: tuple = KINDS) -> DataFrame:
    """Each document row with `owner`, `text_key` and its spans by (start, kind). A null text has none."""
    text = text_of()
    spans = F.sort_array(F.concat(*(_matches(text, *kind) for kind in kinds)))
    return documents.select("doc_id", F.col("source").alias("owner"), F.xxhash64(text).alias("text_key"), spans.alias("spans"))


def ownership(spans: DataFrame) -> DataFrame:
    """Documents and owners of every candidate value: value_key, n_docs, n_owners.

    Counted in two steps, so that a value found in a third of all documents is first added up per
    owner inside the map tasks. A null owner counts as one owner, rows repeated as a whole as one document.
    """
    values = spans.where(F.size("spans") > 0).select(
        "doc_id", "owner", F.explode(F.array_distinct(F.transform("spans", lambda s: F.xxhash64(s.value)))).alias("value_key")
    )
    by_owner = values.groupBy("value_key", "owner", "doc_id").count().groupBy("value_key", "owner").agg(F.count(F.lit(1)).alias("n_docs"))
    return by_owner.groupBy("value_key").agg(F.sum("n_docs").alias("n_docs"), F.count(F.lit(1)).alias("n_owners"))


def scan(documents: DataFrame, example_owners: int = 3, example_docs: int = 100) -> DataFrame:
    """doc_id, owner, text_key, spans, n_live, n_example, most_docs, most_owners per document row.

    A span is an example if its value is copied widely: held by at least `example_owners` owners, or by at least
    `example_docs` documents whoever owns them. Else it is specific to its owner and live-looking. most_docs and
    most_owners are the counts of the row's most copied values, 0 without one. Rows that are equal in doc_id and text have equal results. Columns other than
    doc_id, text and source are not read.
    """
    # Narrow rows, read three times; the patterns run once.
    spans = written(secret_spans(documents), "secret-spans")
    owned = ownership(spans)
    single = (
        spans.where(F.size("spans") > 0)
        .select("doc_id", "text_key", F.explode("spans").alias("span"))
        .distinct()  # rows repeated as a whole
        .select("doc_id", "text_key", F.xxhash64("span.value").alias("value_key"))
    )
    copied = (F.col("n_owners") >= example_owners) | (F.col("n_docs") >= example_docs)
    judged = (
        single.join(owned, "value_key")
        .groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
        .agg(
            F.count_if(~copied).alias("n_live"),
            F.count_if(copied).alias("n_example"),
            F.max("n_docs").alias("most_docs"),
            F.max("n_owners").alias("most_owners"),
        )
    )
    return spans.join(judged, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left").select(
        "doc_id", "owner", "text_key", "spans",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_example", "most_docs", "most_owners")),
    )


def secret_report(documents: DataFrame) -> DataFrame:
    """Counts, digests and the verdict of each document row, from its spans."""

    def of(kind: str) -> Column:
        return F.filter("spans", lambda s: s.kind == kind)

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    base = F.filter("spans", lambda s: s["rank"] < 3)
    return scan(documents).select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
        "most_docs",
        "most_owners",
    )


def without_live_secrets(documents: DataFrame, example_owners: int = 3, example_docs: int = 100) -> DataFrame:
    """The rows without a live-looking credential; copied examples do no harm and stay."""
    judged = scan(documents, example_owners, example_docs).where(F.col("n_live") > 0)
    live = judged.select(F.col("doc_id").alias("llm_id"), F.col("text_key").alias("llm_key")).distinct()
    live = written(live, "live-secrets")
    return documents.join(sized(live), same_row(documents, live), "left_anti")
