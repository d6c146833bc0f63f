"""Chat formatting in budgeted windows, with loss masks. DataFrame functions only.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside a role or text are made
harmless and can be read back: in ``<``, any number of U+200B, ``|`` one more U+200B is put before the bar.

Turns are ordered by ``turn``, then role and text. Prefix sums of their tokens (by default a token per four
characters and three for the marks) choose the windows: turns whose running total ends in the same stretch
of ``stride`` tokens form a window, so a turn is never cut. The leading system turns are put before every
window. Of the window before, the last turns that fit in ``history`` tokens are repeated. So a window holds
at most the system turns, ``history`` and ``stride`` tokens, and what of its first turn lies before its
stretch: with turns of at most ``t`` tokens, no more than ``system + history + stride + t``.

The loss mask covers the texts of assistant turns in their own window. Repeated turns are masked out, so
every assistant text is a target exactly once.

Null texts and roles count as empty. Rows without a conversation id form one conversation. Repeated rows
are turns of their own, extra columns are ignored, and no rows give no windows. A conversation is put in
order by one task, which sorts and spills; windows, not conversations, are gathered into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefmine.llm.tables import prefix_sums

START, END = "<|im_start|>", "<|im_end|>"
MARK = "​"
STRIDE, HISTORY = 1024, 256


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, f"<({MARK}*)\\|", f"<$1{MARK}|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, f"<({MARK}*){MARK}\\|", "<$1|")


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long") + 3


def placed_turns(
    df: DataFrame, stride: int, history: int, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokens=token_estimate
) -> DataFrame:
    """(conv_id, at, lead, role, text, tokens, window, first, again): each turn's own window, the first window of
    its conversation, and the window that repeats it, if any. ``lead`` marks the leading system turns."""
    rows = df.select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"at": F.row_number().over(order), "lead": F.max((F.col("role") != "system").cast("int")).over(sofar) == 0, "tokens": tokens(F.col("text"))})
    by_place = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ends", F.sum(F.when(F.col("lead"), 0).otherwise(F.col("tokens"))).over(by_place))
    rows = rows.withColumn("window", F.when(~F.col("lead"), F.floor((F.col("ends") - 1) / stride)))
    by_window = Window.partitionBy("conv_id").orderBy("window")
    rows = rows.withColumns(
        {
            "next": F.min("window").over(by_window.rangeBetween(1, Window.unboundedFollowing)),
            "stop": F.max("ends").over(by_window.rangeBetween(Window.unboundedPreceding, 0)),
            "first": F.coalesce(F.min("window").over(Window.partitionBy("conv_id")), F.lit(0)),
        }
    )
    fits = ~F.col("lead") & (F.col("stop") - F.col("ends") + F.col("tokens") <= history)
    return rows.select("conv_id", "at", "lead", "role", "text", "tokens", "window", "first", F.when(fits, F.col("next")).alias("again"))


def windows(
    df: DataFrame, stride: int = STRIDE, history: int = HISTORY, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokens=token_estimate
) -> DataFrame:
    """One row per window: conv_id, window, n_tokens, formatted, pieces.

    ``pieces`` are its turns in order, as (at, repeated, begin, start, stop, target): the turn's place in the
    conversation, whether another window has it as its own, the code points in ``formatted`` at which
    its block and its text begin and its text ends, and whether the loss covers the text.
    """
    turns = placed_turns(df, stride, history, conv_id, turn, role, text, tokens)
    places = F.array(F.struct(F.col("window"), F.lit(False).alias("repeated")), F.struct(F.col("again").alias("window"), F.lit(True).alias("repeated")))
    dealt = turns.filter(~F.col("lead")).select("conv_id", "first", "at", "role", "text", "tokens", F.explode(places).alias("p")).filter("p.window IS NOT NULL")
    whole = F.struct("at", F.col("p.repeated").alias("repeated"), "role", "text", "tokens")
    bodies = dealt.groupBy("conv_id", "p.window").agg(F.min("first").alias("first"), F.array_sort(F.collect_list(whole)).alias("body"))
    leads = turns.filter("lead").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", F.lit(True).alias("repeated"), "role", "text", "tokens"))).alias("system"))
    joined = bodies.join(leads.withColumnRenamed("conv_id", "own"), F.col("conv_id").eqNullSafe(F.col("own")), "full")
    alone = F.col("body").isNull()
    window = F.when(alone, 0).otherwise(F.col("window")).alias("window")
    opening = alone | (F.col("window") == F.col("first"))
    system = F.transform("system", lambda s: s.withField("repeated", ~F.col("opening")))
    none = F.array().cast("array<struct<at:int,repeated:boolean,role:string,text:string,tokens:bigint>>")
    joined = joined.select(F.when(alone, F.col("own")).otherwise(F.col("conv_id")).alias("conv_id"), window, "system", "body", opening.alias("opening"))
    joined = joined.select("conv_id", "window", F.concat(F.coalesce(system, none), F.coalesce("body", none)).alias("turns"))
    made = F.transform("turns", lambda t: F.struct(escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text")))
    joined = joined.withColumn("made", made)
    joined = joined.withColumn("blocks", F.transform("made", lambda m: F.concat(F.lit(START), m["role"], F.lit("\n"), m["text"], F.lit(f"{END}\n"))))
    joined = joined.withColumn("stops", prefix_sums(F.transform("blocks", F.length)))

    def piece(t: Column, i: Column) -> Column:
        m, stop = F.get("made", i), F.get("stops", i)
        end = stop - len(END) - 1
        return F.struct(
            t["at"].alias("at"), t["repeated"].alias("repeated"), (stop - F.length(F.get("blocks", i))).alias("begin"), (end - F.length(m["text"])).alias("start"),
            end.alias("stop"), ((t["role"] == "assistant") & ~t["repeated"]).alias("target"),
        )

    n_tokens = F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, t: a + t["tokens"]).alias("n_tokens")
    return joined.select("conv_id", "window", n_tokens, F.array_join("blocks", "").alias("formatted"), F.transform("turns", piece).alias("pieces"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """(conv_id, at, role, text, target): the turns, each from its own window, out of formatted texts and masks."""
    rows = formatted.select("conv_id", "formatted", F.explode("pieces").alias("p")).filter("NOT p.repeated")
    begin = F.col("p.begin") + len(START)
    role = F.substring("formatted", begin + 1, F.col("p.start") - 1 - begin)
    text = F.substring("formatted", F.col("p.start") + 1, F.col("p.stop") - F.col("p.start"))
    return rows.select("conv_id", F.col("p.at").alias("at"), unescaped(role).alias("role"), unescaped(text).alias("text"), F.col("p.target").alias("target"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: turns, digest of all turns, characters and digest of the loss text, formatted characters."""
    turns = read_turns(formatted).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text", "target"))).alias("t"))
    said = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("t", lambda t: t["target"]), lambda t: t["text"]), "")
    turns = turns.select("conv_id", F.size("t").cast("bigint").alias("n_turns"), said.alias("said"), loss.alias("loss"))
    sizes = formatted.groupBy("conv_id").agg(F.sum(F.length("formatted")).cast("bigint").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"), F.max("n_tokens").alias("largest_window"))
    sizes = sizes.withColumnRenamed("conv_id", "own")
    return turns.join(sizes, F.col("conv_id").eqNullSafe(F.col("own"))).select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars", "n_windows", "largest_window",
    )
