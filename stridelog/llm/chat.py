r"""Chat formatting in budgeted windows.

The tokens of a conversation's turns are added up in order, in two levels, so that no task needs a
conversation as a whole. The running sum lays the turns on a ruler with a mark every `stride` tokens:
the turns between two marks are one window, a turn across a mark is a window of its own. So windows
are spans of whole turns, and none has more new tokens than the stride but for one single longer turn.
Each later window repeats the system turn and a limited number of the turns before it; repeated turns
are not under the loss mask.

Template of a turn: `### role: text</turn>` and a line feed. Inside role and text a backslash is
written `\b`, `<` is `\l` and `#` is `\h` (in a role also `:` is `\c`), so neither mark of the template can stand in them, and
the way back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Tokens that the template adds to a turn.
FRAME = 3
#: Turns in one step of the running sums.
STEP = 64

Pairs = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))


def escape(text: Column) -> Column:
    for plain, coded in Pairs:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(Pairs):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _laid_out(conversations: DataFrame) -> DataFrame:
    """Each turn with its position from 1, the tokens before it, and the tokens of the system turn."""
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = turns.withColumn("tokens", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + FRAME).withColumn(
        "step", F.coalesce(F.floor(F.col("turn") / STEP), F.lit(-(1 << 62)))
    )
    order = ["turn", "role", "text"]
    inside = Window.partitionBy("conv_id", "step").orderBy(*order)
    along = Window.partitionBy("conv_id").orderBy("step")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    steps = (
        turns.groupBy("conv_id", "step")
        .agg(
            F.sum("tokens").alias("step_tokens"),
            F.count(F.lit(1)).alias("step_turns"),
            F.min_by(F.struct("role", "tokens"), F.struct(*order)).alias("first"),
        )
        .select(
            F.col("conv_id").alias("c"),
            F.col("step").alias("s"),
            F.coalesce(F.sum("step_tokens").over(before), F.lit(0)).alias("tokens_before"),
            F.coalesce(F.sum("step_turns").over(before), F.lit(0)).alias("turns_before"),
            F.first("first").over(along).alias("head"),
        )
    )
    return (
        turns.withColumn("place", F.row_number().over(inside))
        .withColumn("upto", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(steps, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("step") == F.col("s")))
        .select(
            "conv_id", "role", "text", "tokens",
            (F.col("turns_before") + F.col("place")).alias("position"),
            (F.col("tokens_before") + F.col("upto") - F.col("tokens")).alias("start"),
            F.when(F.col("head.role") == "system", F.col("head.tokens")).otherwise(F.lit(0)).alias("system"),
        )
    )


def chat_windows(conversations: DataFrame, budget: int = 768, history: int = 128, history_turns: int = 4) -> DataFrame:
    """Windows of conversations: conv_id, window, n_repeated, n_new, text, loss (array of start, length).

    A turn counts its words and the template's marks. Of `budget`, the system turn (a first turn
    of that role) and `history` are set aside, the rest, at least a quarter, is the stride. History
    is at most `history_turns` turns with at most `history` tokens. `loss` holds the code points of
    the new assistant texts inside `text`. Turns stand in order of (turn, role, text), nulls first; null
    role and text count as empty, rows repeated as a whole are turns of their own, and a null conv_id is a
    conversation. Other columns are not read. An empty table gives no windows.
    """
    turns = _laid_out(conversations)
    stride = F.greatest(F.lit(budget - history) - F.col("system"), F.lit(budget // 4))
    is_system = (F.col("position") == 1) & (F.col("system") > 0)
    body = F.col("start") - F.col("system")
    cell = F.floor(body / stride)
    crosses = F.floor((body + F.col("tokens") - 1) / stride) > cell
    turns = turns.withColumn(
        "window", F.when(is_system, F.lit(0)).otherwise(cell * 2 + crosses.cast("int")).cast("long")
    )
    firsts = turns.groupBy("conv_id", "window").agg(
        F.min("position").alias("first"), F.min("start").alias("from"), F.max("system").alias("system")
    )
    earliest = F.greatest(F.col("first") - history_turns, F.when(F.col("system") > 0, F.lit(2)).otherwise(F.lit(1)))
    none = F.expr("array()").cast("array<bigint>")
    repeats = F.concat(
        F.when((F.col("system") > 0) & (F.col("first") > 1), F.array(F.lit(1).cast("long"))).otherwise(none),
        F.when(earliest < F.col("first"), F.sequence(earliest.cast("long"), (F.col("first") - 1).cast("long"))).otherwise(none),
    )
    wanted = firsts.select(F.col("conv_id").alias("c"), F.col("window").alias("w"), "from", F.explode(repeats).alias("p"))
    repeated = (
        turns.join(wanted, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("position") == F.col("p")))
        .where(is_system | (F.col("start") >= F.col("from") - history))
        .select("conv_id", F.col("w").alias("window"), "position", F.lit(True).alias("again"), "role", "text")
    )
    parts = turns.select("conv_id", "window", "position", F.lit(False).alias("again"), "role", "text").unionByName(repeated)

    lead = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(MIDDLE))
    coded = escape(F.col("text"))
    part = F.struct(
        "position",
        F.concat(lead, coded, F.lit(CLOSE)).alias("piece"),
        F.length(lead).alias("lead"),
        F.length(coded).alias("size"),
        "again",
        (~F.col("again") & (F.col("role") == "assistant")).alias("learn"),
    )
    windows = parts.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    spans = F.expr("array()").cast("array<struct<start:int,length:int>>")

    def add(done, p):
        span = F.struct((done.at + p.lead).alias("start"), p["size"].alias("length"))
        return F.struct(
            (done.at + F.length(p.piece)).alias("at"),
            F.when(p.learn, F.concat(done.spans, F.array(span))).otherwise(done.spans).alias("spans"),
        )

    return windows.select(
        "conv_id",
        "window",
        F.size(F.filter("parts", lambda p: p.again)).alias("n_repeated"),
        F.size(F.filter("parts", lambda p: ~p.again)).alias("n_new"),
        F.array_join(F.transform("parts", lambda p: p.piece), "").alias("text"),
        F.aggregate("parts", F.struct(F.lit(0).alias("at"), spans.alias("spans")), add, lambda done: done.spans).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What the formatted windows say: conv_id, window, `turns` (role, text; new ones only), `targets`."""
    pieces = F.split("text", CLOSE, -1)
    # The last piece is what follows the last mark: nothing.
    new = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - 1 - F.col("n_repeated"), F.lit(0)))

    def turn(piece):
        inner = F.substring(piece, F.lit(len(OPEN) + 1), F.length(piece))
        at = F.instr(inner, MIDDLE)
        return F.struct(
            unescape(F.replace(F.substring(inner, F.lit(1), at - 1), F.lit("\\c"), F.lit(":"))).alias("role"),
            unescape(F.substring(inner, at + len(MIDDLE), F.length(inner))).alias("text"),
        )

    return windows.select(
        "conv_id",
        "window",
        F.transform(new, turn).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substring("text", s.start + 1, s.length))).alias("targets"),
        F.length("text").cast("long").alias("chars"),
    )


def chat_report(conversations: DataFrame) -> DataFrame:
    """Digest of each conversation, read back from its windows."""
    whole = F.array_join(F.flatten(F.transform("all", lambda w: w.turns)), "")
    targets = F.array_join(F.flatten(F.transform("all", lambda w: w.targets)), "")
    read = read_back(chat_windows(conversations)).withColumn(
        "lines", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    )
    # The digests are of whole conversations, so here each comes together in one row.
    return (
        read.groupBy("conv_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("window", F.col("lines").alias("turns"), "targets"))).alias("all"),
            F.sum(F.size("lines")).alias("n_turns"),
            F.sum("chars").alias("formatted_chars"),
            F.count(F.lit(1)).alias("n_windows"),
        )
        .select(
            "conv_id",
            F.col("n_turns").cast("long").alias("n_turns"),
            F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
            F.length(targets).cast("long").alias("loss_chars"),
            F.sha2(targets.cast("binary"), 256).alias("loss_sha256"),
            F.col("formatted_chars").cast("long").alias("formatted_chars"),
            "n_windows",
        )
    )
