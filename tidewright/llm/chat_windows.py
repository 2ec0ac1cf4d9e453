"""Operator 6, chat formatting in budgeted windows. DataFrame functions only.

Prefix sums of the turns' tokens cut a conversation into spans at turn boundaries: the prefix sum is marked off in stretches of what the budget
leaves beside the system turn and the history, the turns that lie within one stretch are a span, and a turn over a mark is a span of
its own. A window is a span's turns, led by the conversation's system turn and by the last turns of the span before it as far as the history budget
reaches; a turn that takes more than its stretch leaves its window less history, or none. So no turn is ever split, capped or dropped, and no window
exceeds the budget unless one turn and the system turn together do. Repeated turns are
context only: the loss mask covers the text of an assistant's turn in the one window whose span owns it.

The template writes a turn as <|im_start|>role, newline, text, <|im_end|>, newline. Inside texts and roles a backslash is doubled and
"<|" becomes "<\\|", so that the output holds no control string but the template's own; roles also write a newline as "<\\/>".
Reading takes that back exactly.

Cases: null roles and texts count as empty; turns go by turn (null first), then role, then text, and rows that repeat are turns of
their own; rows with a null conv_id form one conversation; an empty table gives no windows; other columns are not looked at. A
conversation is one sequence and is read back as one, so its digest needs its text in one row; windows never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_TOKENS = 256
HISTORY_TOKENS = 64
START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\/>"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\/>"), F.lit("\n")))


def tokens_of(text: Column) -> Column:
    """A turn's length for the budget: its words, and two for the template."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long") + 2


def windows(turns: DataFrame, window_tokens: int = WINDOW_TOKENS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """(conv_id, window, n_repeated, formatted, loss) of turns (conv_id, turn, role, text).

    n_repeated: how many leading turns of the window are context. loss: the (start, length) of each masked stretch in code points."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("size", tokens_of(F.col("text")))
    conversation = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = conversation.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"place": F.row_number().over(conversation), "before": F.sum("size").over(so_far) - F.col("size")})
    head = (F.col("place") == 1) & (F.col("role") == "system")
    rows = rows.withColumn("system_size", F.coalesce(F.first(F.when(head, F.col("size")), ignorenulls=True).over(so_far), F.lit(0)))
    rows = rows.withColumn("room", F.greatest(F.lit(1), window_tokens - history_tokens - F.col("system_size"))).withColumns({"stretch": F.floor(F.col("before") / F.col("room")), "until": F.floor((F.col("before") + F.col("size") - 1) / F.col("room"))})
    # a mark lies within this turn, or within the last one or before this
    rows = rows.withColumn("opens", F.coalesce((F.col("stretch") != F.col("until")) | (F.col("stretch") != F.lag("stretch").over(conversation)) | (F.lag("stretch").over(conversation) != F.lag("until").over(conversation)), F.lit(True)))
    rows = rows.withColumn("window", F.sum(F.col("opens").cast("long")).over(so_far) - 1)
    # where the next span begins in the prefix sum, for the turns that it repeats
    ahead = Window.partitionBy("conv_id").orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next", F.min(F.when(F.col("opens"), F.struct("before", "size"))).over(ahead))
    left = window_tokens - F.col("system_size") - F.col("next.size")
    history = F.when(F.col("next.size") > F.col("room"), F.least(F.lit(history_tokens), left)).otherwise(history_tokens)  # a turn over a mark is a span of its own
    repeats = F.coalesce((F.col("next.before") - F.col("before") <= history) & ~((F.col("place") == 1) & (F.col("role") == "system")), F.lit(False))
    uses = F.when(repeats, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    turn = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(END))
    rows = rows.withColumn("written", turn).withColumn("text_from", F.char_length(escaped_role(F.col("role"))) + len(START) + 1).withColumn("text_chars", F.char_length(escaped(F.col("text"))))
    rows = rows.withColumn("system", F.first(F.when(head, F.col("written")), ignorenulls=True).over(so_far))
    used = rows.withColumn("later", F.explode(uses)).select(
        "conv_id", (F.col("window") + F.col("later")).alias("window"), F.col("system"),
        F.struct("place", "written", (F.col("later") == 1).alias("repeated"), ((F.col("role") == "assistant") & (F.col("later") == 0)).alias("target"), "text_from", "text_chars").alias("turn"),
    )
    spans = used.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.first("system", ignorenulls=True).alias("system"))
    # the system turn leads the windows that do not hold it as their own first turn
    lead = F.when((F.col("window") > 0) & F.col("system").isNotNull(), F.col("system")).otherwise(F.lit(""))
    spans = spans.withColumn("lead", lead)
    starts = F.aggregate(
        "turns", F.struct(F.char_length("lead").cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss")),
        lambda acc, t: F.struct(
            (acc["at"] + F.char_length(t["written"])).alias("at"),
            F.when(t["target"], F.array_append(acc["loss"], F.struct((acc["at"] + t["text_from"]).cast("long").alias("start"), t["text_chars"].cast("long").alias("length")))).otherwise(acc["loss"]).alias("loss"),
        ),
    )
    return spans.select(
        "conv_id", "window", (F.size(F.filter("turns", lambda t: t["repeated"])) + F.when(F.col("lead") != "", 1).otherwise(0)).alias("n_repeated"),
        F.concat(F.col("lead"), F.array_join(F.transform("turns", lambda t: t["written"]), "")).alias("formatted"), starts["loss"].alias("loss"),
    )


def written_turn(part: Column) -> Column:
    """One written turn without its start mark: role, newline, text, end mark."""
    role = F.substring_index(part, "\n", 1)
    from_ = F.char_length(role) + 2
    return F.struct(unescaped_role(role).alias("role"), unescaped(F.substr(part, from_, F.char_length(part) - from_ + 1 - len(END))).alias("text"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role,text>>, targets string, formatted_chars) from windows alone: repeats are left out, masked stretches joined."""
    written = F.split(F.col("formatted"), "<\\|im_start\\|>")
    parts = F.slice(written, F.col("n_repeated") + 2, F.size(written))
    own = F.transform(parts, written_turn)
    masked = F.array_join(F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    rows = formatted.select("conv_id", F.struct("window", own.alias("turns"), masked.alias("targets"), F.char_length("formatted").cast("long").alias("chars")).alias("w"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    return whole.select(
        "conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.array_join(F.transform("w", lambda x: x["targets"]), "").alias("targets"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("formatted_chars"),
    )
