"""Chat formatting in budgeted windows of whole turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The template's control strings; all begin with OPEN, which escape() keeps out of texts.
OPEN, FIRST, AGAIN, BODY, END = "<|", "<|t|>", "<|r|>", "<|m|>", "<|e|>"


def escape(text: Column) -> Column:
    """Double backslashes, then part the two characters that open a control string.

    After the first step backslashes come in pairs, so a single one between the two
    characters can only stem from the second, and unescape() is exact.
    """
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(OPEN), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit(OPEN)), F.lit("\\\\"), F.lit("\\"))


def format_windows(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    budget: int = 512, history: int = 2,
) -> DataFrame:
    """Conversations as windows of whole turns: conv_col, window, formatted, loss (spans of formatted, in characters).

    Turns in order of turn_col (ties by role and text) count their words and four for
    the template. A leading system turn stands at the head of every window, and its
    tokens come off the budget. By prefix sums of the other turns' tokens, those that
    begin in one stretch of what is left are a window's targets; if they are more than
    that, the last of them is a window of its own. Up to history turns before a window's
    first target are repeated in it, the nearest first, as far as they fit. So only a
    window of one target that is too long beside the system turn passes the budget, and
    it repeats no other turn. Each turn is
    marked as first or repeated; loss spans cover the texts of assistant turns where
    they stand first, so each is learned once.

    Null texts and roles count as empty, null conv ids are one conversation, null turns
    come first, repeated rows are turns of their own. An empty table gives no windows.
    A conversation's turns are ordered in one task, row by row; windows of a long one
    are built apart.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("__c"), F.col(turn_col).alias("__t"), role.alias("__role"), text.alias("__text"))
    conv = Window.partitionBy("__c")
    order = conv.orderBy("__t", "__role", "__text")
    rows = rows.withColumn("__n", F.row_number().over(order))
    system = (F.col("__n") == 1) & (F.col("__role") == "system")
    tokens = (F.regexp_count("__text", F.lit(r"[^\x20\x09-\x0D]+")) + 4).cast("long")
    by_n = conv.orderBy("__n")
    rows = rows.withColumn("__system", system).withColumn("__all", tokens).withColumn("__tokens", F.when(system, 0).otherwise(F.col("__all")))
    room = F.lit(budget) - F.max(F.when(F.col("__system"), F.col("__all")).otherwise(0)).over(conv)
    begun = F.sum("__tokens").over(by_n.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__tokens")
    rows = rows.withColumn("__begun", begun).withColumn("__room", room)
    rows = rows.withColumn("__stretch", F.floor(F.col("__begun") / F.greatest("__room", F.lit(1))).cast("long"))
    within = F.sum("__tokens").over(Window.partitionBy("__c", "__stretch"))
    passes = F.col("__begun") + F.col("__tokens") > (F.col("__stretch") + 1) * F.greatest("__room", F.lit(1))
    rows = rows.withColumn("__parted", passes & (within > F.col("__room")) & (within > F.col("__tokens")))
    rows = rows.withColumn("__opens", F.coalesce((F.col("__stretch") > F.lag("__stretch", 1).over(by_n)) | F.col("__parted"), F.lit(False)))
    rows = rows.withColumn("__w", F.sum(F.col("__opens").cast("long")).over(by_n.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("__free", F.col("__room") - F.sum("__tokens").over(Window.partitionBy("__c", "__w")))
    fits = lambda j: F.lead("__opens", j).over(by_n) & (F.lead("__begun", j).over(by_n) - F.col("__begun") <= F.lead("__free", j).over(by_n))
    later = F.array(*(F.when(fits(j), F.lead("__w", j).over(by_n)) for j in range(1, history + 1))) if history else F.array().cast("array<bigint>")
    rows = rows.withColumn("__later", later).withColumn("__last", F.max("__w").over(conv))
    own = F.array(F.struct(F.col("__w").alias("w"), F.lit(False).alias("again")))
    repeat = lambda ws: F.transform(ws, lambda w: F.struct(w.alias("w"), F.lit(True).alias("again")))
    heads = F.when(F.col("__last") > F.col("__w"), repeat(F.sequence(F.col("__w") + 1, F.col("__last")))).otherwise(F.slice(repeat(F.array("__w")), 1, 0))
    places = F.when(F.col("__system"), F.concat(own, heads)).otherwise(F.concat(own, repeat(F.array_distinct(F.filter("__later", lambda w: w.isNotNull())))))
    placed = rows.select("__c", "__n", "__role", "__text", F.explode(places).alias("__p"))
    lead = F.concat(F.when(F.col("__p.again"), AGAIN).otherwise(FIRST), escape(F.col("__role")), F.lit(BODY))
    body = escape(F.col("__text"))
    pieces = placed.select("__c", F.col("__p.w").alias("window"), "__n", lead.alias("__lead"), body.alias("__body"), ((F.col("__role") == "assistant") & ~F.col("__p.again")).alias("__learn"))
    size = F.length("__lead") + F.length("__body") + len(END)
    along = Window.partitionBy("__c", "window").orderBy("__n")
    start = F.sum(size).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - len(END) - F.length("__body")
    pieces = pieces.withColumn("__from", start)
    item = F.struct("__n", F.concat("__lead", "__body", F.lit(END)).alias("piece"), "__from", (F.col("__from") + F.length("__body")).alias("__to"), "__learn")
    built = pieces.groupBy("__c", "window").agg(F.sort_array(F.collect_list(item)).alias("__items"))
    spans = F.transform(F.filter("__items", lambda x: x["__learn"]), lambda x: F.struct(x["__from"].alias("start"), x["__to"].alias("end")))
    return built.select(F.col("__c").alias(conv_col), "window", F.array_join(F.transform("__items", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss"))


def _turn(piece: Column) -> tuple[Column, Column, Column]:
    """Again, role and text of a piece between control strings."""
    rest = F.substring(piece, F.lit(len(FIRST) + 1), F.length(piece))
    role = F.substring_index(rest, BODY, 1)
    text = F.substring(rest, F.length(role) + len(BODY) + 1, F.length(rest))
    return F.startswith(piece, F.lit(AGAIN)), unescape(role), unescape(text)


def _pieces() -> Column:
    return F.filter(F.split("formatted", r"<\|e\|>", -1), lambda x: x != "")


def read_turns(windows: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """The turns of formatted windows, unescaped: conv_col, window, place, again, role, text."""
    again, role, text = _turn(F.col("__piece"))
    parts = windows.select(conv_col, "window", F.posexplode(_pieces()).alias("place", "__piece"))
    return parts.select(conv_col, "window", "place", again.alias("again"), role.alias("role"), text.alias("text"))


def digests(windows: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """What the windows say, by conversation: turns, loss text and size, read back from the output alone.

    Each window is read where it stands and gives what it says first and what it teaches; one
    aggregation brings these together. The two digests are over a whole conversation, so its
    text meets in one row here; format_windows() has no such row.
    """

    def said(piece: Column) -> Column:
        _, role, text = _turn(piece)
        return F.concat(role, F.lit("\n"), text, F.lit("\n"))

    new = F.filter(_pieces(), lambda x: ~_turn(x)[0])
    taught = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    each = windows.select(conv_col, "window", F.length("formatted").alias("__size"), new.alias("__new"), F.array_join(taught, "").alias("__taught"))
    each = each.select(conv_col, "__size", F.size("__new").alias("__n"), F.struct("window", F.array_join(F.transform("__new", said), "").alias("said"), F.col("__taught").alias("taught")).alias("__w"))
    whole = each.groupBy(conv_col).agg(F.sum("__n").cast("long").alias("n_turns"), F.sum("__size").cast("long").alias("formatted_chars"), F.sum(F.length("__w.taught")).cast("long").alias("loss_chars"), F.sort_array(F.collect_list("__w")).alias("__w"))
    digest = lambda name: F.sha2(F.array_join(F.transform("__w", lambda w: w[name]), ""), 256)
    return whole.select(conv_col, "n_turns", digest("said").alias("turns_sha256"), "loss_chars", digest("taught").alias("loss_sha256"), "formatted_chars")
