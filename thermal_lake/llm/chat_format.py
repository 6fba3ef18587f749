"""Chat formatting into budgeted windows (operator 5), in DataFrame functions alone.

A turn is written as `### role: text</turn>` and a newline. Inside roles and texts a backslash is written as two, `#` as `\\h`, the `<` of
`</turn>` as `\\l` (and `:` in a role as `\\c`), so control strings never occur there and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermal_lake.llm.common import written
from thermal_lake.operators.graph import hot_keys, looked_up

START, MIDDLE, STOP = "### ", ": ", "</turn>\n"
BUDGET = 512
#: Tokens that a system turn may have to be repeated, and that the repeated history may have.
SYSTEM_MOST, HISTORY_MOST = BUDGET // 2, BUDGET // 4
#: Tokens of a conversation after which its windows are chosen by another task; a window ends there.
SEGMENT = 16 * BUDGET
#: More than any window holds: the tokens of a turn that can't be repeated.
NEVER = BUDGET + 1


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\h")), F.lit("</turn>"), F.lit("\\l/turn>"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescaped(text: Column) -> Column:
    part = lambda p: F.replace(F.replace(F.replace(p, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def size_in_words(text: Column) -> Column:
    return F.size(F.split(text, r"\s+"))


def in_order(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, role, text, tokens) as a written table with pos, which ascends in the order of conversations and their turns. A conversation of any length is dealt over many tasks, repeated rows too."""
    rows = turns.withColumn("_n", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", "text", "_n"]
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_n").withColumn("pos", F.monotonically_increasing_id()), "chat-turns")


def placed(rows: DataFrame) -> DataFrame:
    """(conv, pos, tokens, system, place, before): the place of a turn in its conversation, from 1, and the tokens before it; sums of the parts that tasks wrote join up the prefix sums in each."""
    t = rows.select("conv", "pos", "tokens", (F.col("role") == "system").alias("system"), F.shiftright("pos", 33).alias("part"))
    inside = Window.partitionBy("conv", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = t.groupBy("conv", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("b"))
    sums = sums.select("conv", "part", *[F.coalesce(F.sum(x).over(across), F.lit(0)).alias(f"{x}0") for x in ("n", "b")])
    t = t.withColumns({"n": F.row_number().over(inside), "b": F.sum("tokens").over(inside)}).join(sums, ["conv", "part"])
    return t.select("conv", "pos", "tokens", "system", (F.col("n") + F.col("n0")).alias("place"), (F.col("b") + F.col("b0") - F.col("tokens")).alias("before"))


def chosen(segments: DataFrame) -> DataFrame:
    """(conv, pos, window, again, system_again) for the turns of segments (conv, turns, t1, q1, t2, q2, system_tokens, system_pos): the turns fold into windows.

    A window takes turns while all its tokens stay within BUDGET. It begins with the system turn, if that and the first new turn fit, and with the last two turns before it,
    or the last one, if they fit besides; `again` holds these turns' pos. A turn that exceeds BUDGET is a window alone.
    """

    def step(a: Column, x: Column) -> Column:
        fresh = (a["start"] == 0) | (a["used"] + x["tokens"] > BUDGET)
        base = F.when((x["place"] > 1) & (F.col("system_tokens") + x["tokens"] <= BUDGET), F.col("system_tokens")).otherwise(F.lit(0).cast("long"))
        fits = lambda n: (n <= HISTORY_MOST) & (base + n + x["tokens"] <= BUDGET)
        two, one = fits(a["t1"] + a["t2"]), fits(a["t1"])
        again = F.when(fresh & two, F.array(a["q2"], a["q1"])).when(fresh & one, F.array(a["q1"])).otherwise(F.expr("cast(array() as array<bigint>)"))
        start = F.when(fresh, x["place"]).otherwise(a["start"])
        return F.struct(
            F.when(fresh, base + F.when(two, a["t1"] + a["t2"]).when(one, a["t1"]).otherwise(F.lit(0).cast("long")) + x["tokens"]).otherwise(a["used"] + x["tokens"]).alias("used"), start.alias("start"),
            F.when((x["place"] == 1) & F.col("system_pos").isNotNull(), F.lit(NEVER).cast("long")).otherwise(x["tokens"]).alias("t1"), x["pos"].alias("q1"), a["t1"].alias("t2"), a["q1"].alias("q2"),
            F.concat(a["out"], F.array(F.struct(x["pos"].alias("pos"), start.alias("window"), again.alias("again"), (fresh & (base > 0)).alias("system_again")))).alias("out"),
        )

    zero = F.lit(0).cast("long")
    begin = F.struct(
        zero.alias("used"), zero.alias("start"), F.col("t1"), F.col("q1"), F.col("t2"), F.col("q2"),
        F.expr("cast(array() as array<struct<pos: bigint, window: bigint, again: array<bigint>, system_again: boolean>>)").alias("out"),
    )
    return segments.select("conv", "system_pos", F.inline(F.aggregate("turns", begin, step)["out"]))


def format_windows(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Windows of conversations: conv id, window (the place of its first new turn), n_turns, n_repeated, n_tokens, formatted, loss.

    Turns are never split. A window's new turns follow each other; it takes the next one while n_tokens, which counts repeated turns too, stays within BUDGET, and ends where the prefix
    sum of tokens passes a multiple of SEGMENT. A turn has a token for each word and two more. A window begins with the system turn (a conversation's first turn, if its role is `system`) if that has SYSTEM_MOST tokens at most and fits
    together with the first new turn, and with up to two last turns before it that have HISTORY_MOST tokens at most together and fit too. These n_repeated turns are not new. Only a single turn
    that alone exceeds BUDGET makes a window beyond it, and then nothing is repeated there. loss holds the (start, end)
    code points of the new assistant texts, so each is a target once. Turns stand by (turn, role, text), nulls first; repeated rows are turns of their own. Null role or text
    counts as empty; rows with a null conversation id are one conversation; further columns aren't read.
    """
    turns = df.select(F.coalesce(F.col(conv_col).cast("long").cast("string"), F.lit("")).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = in_order(turns.withColumn("tokens", size_in_words(F.col("text")).cast("long") + 2))
    t = written(placed(rows), "chat-places")
    segments = t.groupBy("conv", F.floor(F.col("before") / SEGMENT).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("place", "tokens", "pos", "system"))).alias("turns"))
    # the two turns before a segment; the system turn is not history
    last = F.transform(F.slice("turns", F.greatest(F.size("turns") - 1, F.lit(1)), 2), lambda x: F.struct(F.when((x["place"] == 1) & x["system"], F.lit(NEVER).cast("long")).otherwise(x["tokens"]).alias("tokens"), x["pos"].alias("pos")))
    order = Window.partitionBy("conv").orderBy("segment")
    segments = segments.withColumn("last", last).withColumn("past", F.concat(*[F.coalesce(F.lag("last", n).over(order), F.expr("cast(array() as array<struct<tokens: bigint, pos: bigint>>)")) for n in (2, 1)]))
    past = {f"{name}{n}": F.coalesce(F.get("past", F.size("past") - n)[field], F.lit(missing).cast("long")) for n in (1, 2) for name, field, missing in (("t", "tokens", NEVER), ("q", "pos", -1))}
    segments = written(segments.select("conv", "segment", "turns", *[c.alias(k) for k, c in past.items()]), "chat-segments")
    system = t.where("place = 1 and system").select(F.col("conv").alias("of"), F.when(F.col("tokens") <= SYSTEM_MOST, F.col("tokens")).otherwise(NEVER).cast("long").alias("system_tokens"), F.col("pos").alias("system_pos"))
    segments = looked_up(segments, "conv", "segment", system, "of", hot_keys(segments, "conv", segments.count()), "left").withColumn("system_tokens", F.coalesce("system_tokens", F.lit(NEVER).cast("long")))
    found = chosen(segments)
    use = lambda pos, new: F.struct(pos.alias("at"), F.lit(new).alias("new"))
    uses = F.concat(F.array(use(F.col("pos"), True)), F.transform("again", lambda q: use(q, False)), F.when(F.col("system_again"), F.array(use(F.col("system_pos"), False))).otherwise(F.expr("cast(array() as array<struct<at: bigint, new: boolean>>)")))
    uses = written(found.select("conv", "window", F.inline(uses)), "chat-uses")
    piece = F.concat(F.lit(START), escaped(F.col("role"), True), F.lit(MIDDLE), escaped(F.col("text")), F.lit(STOP))
    head = F.length(F.concat(F.lit(START), escaped(F.col("role"), True), F.lit(MIDDLE)))
    pieces = rows.select("pos", "tokens", (F.col("role") == "assistant").alias("target"), piece.alias("piece"), head.alias("head"))
    used = looked_up(uses, "at", "window", pieces, "pos", hot_keys(uses, "at", uses.count()))
    grouped = used.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("pos", "new", "target", "piece", "head", "tokens"))).alias("t"))
    step = lambda a, x: F.struct((a["at"] + F.length(x["piece"])).alias("at"), F.when(x["new"] & x["target"], F.concat(a["loss"], F.array(F.struct((a["at"] + x["head"]).alias("start"), (a["at"] + F.length(x["piece"]) - len(STOP)).alias("end"))))).otherwise(a["loss"]).alias("loss"))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("loss"))
    return grouped.select(
        F.expr("cast(nullif(conv, '') as bigint)").alias(conv_col), "window", F.size("t").cast("long").alias("n_turns"), F.size(F.filter("t", lambda x: ~x["new"])).cast("long").alias("n_repeated"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_tokens"),
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), F.aggregate("t", zero, step)["loss"].alias("loss"),
    )


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv id, window, turns (role and text of the new turns) and loss_text (the targets, unescaped, nothing between), read from formatted and loss alone."""
    pieces = F.split("formatted", STOP)
    new = F.slice(pieces, F.col("n_repeated").cast("int") + 1, F.size(pieces) - 1 - F.col("n_repeated").cast("int"))
    turn = lambda p: F.struct(unescaped(F.substring_index(F.substr(p, F.lit(len(START) + 1)), MIDDLE, 1)).alias("role"), unescaped(F.substr(p, F.instr(p, F.lit(MIDDLE)) + len(MIDDLE))).alias("text"))
    span = lambda s: unescaped(F.substr("formatted", s["start"] + 1, s["end"] - s["start"]))
    return windows.select(conv_col, "window", F.length("formatted").cast("long").alias("chars"), F.transform(new, turn).alias("turns"), F.array_join(F.transform("loss", span), "").alias("loss_text"))


def digests(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row for each conversation; a digest is of the whole conversation, so its text comes together once for it."""
    read = read_back(windows, conv_col).select(conv_col, "chars", F.size("turns").cast("long").alias("n"), F.struct("window", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"), F.col("loss_text").alias("loss")).alias("w"))
    whole = read.groupBy(conv_col).agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("w"))
    text = lambda field: F.array_join(F.transform("w", lambda x: x[field]), "")
    return whole.select(conv_col, "n_turns", F.sha2(text("turns"), 256).alias("turns_sha256"), F.length(text("loss")).cast("long").alias("loss_chars"), F.sha2(text("loss"), 256).alias("loss_sha256"), "formatted_chars")
