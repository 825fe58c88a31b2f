"""Conversations as training windows of bounded length, with a loss mask. DataFrame functions only.

A turn is written as `<s>[role]`, a line feed, its text and `</s>`. Inside
roles and texts the characters of the template's control strings are escaped by
a backslash and a digit, so a text can't forge a turn, and `read_turns` gives
back what was written.

Windows. Prefix sums of turn tokens cut a conversation at turn bounds: a window
opens with the system turn, if the conversation starts with one, then repeats
the latest turns that fit into the history limit, then takes new turns up to
the budget. Repeated turns are outside the loss mask, which covers each
assistant text once. A turn that alone exceeds the budget has a window of its
own (`tokens` shows it).

One shuffle by conversation, and work in proportion to its turns. A task sorts a
conversation, which Spark may spill, and holds no more than `CHUNK` turns of it
and one window: longer conversations are cut chunk by chunk, all of them at once
for each chunk, and the last window of a chunk goes on in the next one, with its
history, so windows are the same whatever the chunks. The number of those steps
is that of the longest conversation's chunks; without a long one there is none.
Defined results: null
texts and roles count as empty; rows are ordered by turn (null first), ties by
role and text, and repeated rows are repeated turns; rows without an id form one
conversation; a conversation with only a system turn has one window; very long
texts are kept whole; an empty table gives no rows. Other columns are not used,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.columns import let
from quire.llm.workspace import Workspace

#: Turns of a conversation that a task holds, besides those of one window.
CHUNK = 4096
OPEN, HEAD_END, CLOSE = "<s>[", "]\n", "</s>"
#: Fixed values of the escape code; the backslash comes first.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("]", "\\3"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def count_tokens(text: Column) -> Column:
    """Words and punctuation marks, and two for the turn's control strings."""
    return (F.regexp_count(text, F.lit(r"\w+|[^\w\s]")) + 2).cast("long")


def windows(rows: DataFrame, budget: int = 1024, history: int = 256, tokens=count_tokens) -> DataFrame:
    """One row for each window: `conv_id`, `window`, `formatted`, `repeated` (turns at its start that an earlier
    window trains on, or that only give context), `loss` (spans of code points in `formatted`), `tokens`.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = rows.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("tokens", tokens(F.col("text")))
    i = F.row_number().over(order) - 1
    upto = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    one = F.struct("tokens", "role", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(HEAD_END)).alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.select("conv_id", "turn", "role", "text", one.alias("one"), i.alias("i"), upto.alias("upto"))
    longest = rows.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    system = F.when(F.first("one.role").over(order) == "system", F.first(F.struct("i", "upto", "one.*")).over(order)).alias("system")
    turns = turns.select("conv_id", F.floor(F.col("i") / CHUNK).cast("int").alias("chunk"), F.struct("i", "upto", "one.*").alias("own"), *([system] if longest > CHUNK else []))
    held = turns.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("own")).alias("own"), *([F.max("system").alias("system")] if longest > CHUNK else []))
    if longest <= CHUNK:
        return _placed(_cut(held, budget, history, last=True).select("conv_id", F.explode("windows").alias("w")))
    work = Workspace(rows.sparkSession)
    held = work.table(held.withColumn("last", F.col("chunk") == F.max("chunk").over(Window.partitionBy("conv_id"))))
    made, state = [], None
    for chunk in range((longest - 1) // CHUNK + 1):
        here = held.where(F.col("chunk") == chunk)
        if state is not None:
            here = here.join(state.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
        cut = work.table(_cut(here, budget, history, chunk > 0).select("conv_id", "last", "windows"))
        done = F.when(F.col("last"), F.col("windows")).otherwise(F.slice("windows", F.lit(1), F.size("windows") - 1))
        made.append(cut.select("conv_id", F.explode(done).alias("w")))
        state = cut.where("not last").select("conv_id", F.element_at("windows", -1).alias("open"))
    out = made[0]
    for other in made[1:]:
        out = out.unionByName(other)
    return _placed(out)


def _cut(held: DataFrame, budget: int, history: int, carried: bool = False, last: bool = False) -> DataFrame:
    """Adds `windows` (window, picked turns, repeated, own: what is picked without the system turn) to chunks of turns.

    With `carried`, each goes on with `open`, the last window of the chunk before.
    """
    none = F.expr("cast(array() as array<int>)")
    if carried:
        opening = F.when(F.col("system").isNotNull(), F.array("system"))
        turns = F.coalesce(F.concat(opening, "open.own", "own"), F.concat("open.own", "own"))
        first, before, number = F.col("system").isNotNull().cast("int"), F.size("open.own"), F.col("open.window")
        begun = F.col("open.repeated") - F.when(F.col("open.window") > 0, first).otherwise(0)  # of its turns, those that are repeated
    else:
        turns, first = F.col("own"), F.coalesce((F.col("own")[0]["role"] == "system").cast("int"), F.lit(0))
        before, number, begun = F.lit(0), F.lit(0), F.lit(0)
    held = held.withColumns({"turns": turns, "first": first, "before": before, "number": number, "begun": begun})
    room = F.lit(budget) - F.when(F.col("first") == 1, F.col("turns")[0]["tokens"]).otherwise(0)
    held = held.withColumns({"n": F.size("turns"), "room": room})

    def cuts(turns: Column) -> Column:
        """Where windows begin: the first new turn of each, and the first one that it repeats."""
        upto = lambda k: F.get(turns, k)["upto"]
        begins = lambda k: F.get(turns, k)["upto"] - F.get(turns, k)["tokens"]

        def earliest(least: Column, last: Column) -> Column:
            """The first turn, up to `last`, before which no less than `least` tokens stand; found by halving."""

            def halve(span: Column, _: Column) -> Column:
                middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
                found = begins(middle) >= least
                return F.when(span["low"] < span["high"], F.struct(F.when(found, span["low"]).otherwise(middle + 1).alias("low"), F.when(found, middle).otherwise(span["high"]).alias("high"))).otherwise(span)

            return F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.struct(F.col("first").alias("low"), last.alias("high")), halve)["low"]

        def step(so_far: Column, k: Column) -> Column:
            tokens = upto(k) - begins(k)
            least = begins(k) - F.least(F.lit(history).cast("long"), F.col("room") - tokens)
            back = F.when(F.size(so_far["cuts"]) > 0, earliest(least, k)).otherwise(k)

            def opened(at: Column) -> Column:
                return F.struct((upto(k) - begins(at)).cast("long").alias("used"), F.array_append(so_far["cuts"], F.struct(k.alias("begin"), at.alias("back"))).alias("cuts"))

            on = F.struct((so_far["used"] + tokens).cast("long").alias("used"), so_far["cuts"].alias("cuts"))
            return F.when((F.size(so_far["cuts"]) > 0) & (so_far["used"] + tokens <= F.col("room")), on).otherwise(let(back, opened))

        at = lambda begin, back: F.array(F.struct(begin.cast("int").alias("begin"), back.cast("int").alias("back")))
        going = F.struct((upto(F.col("first") + F.col("before") - 1) - begins(F.col("first"))).cast("long").alias("used"), at(F.col("first") + F.col("begun"), F.col("first")).alias("cuts"))
        start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<struct<begin:int,back:int>>)").alias("cuts"))
        start = F.when(F.col("before") > 0, going).otherwise(start)
        made = F.aggregate(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: k >= F.col("first") + F.col("before")), start, step)["cuts"]
        return let(made, lambda c: F.when(F.size(c) > 0, c).otherwise(at(F.col("first"), F.col("first"))))

    def opened(c: Column) -> Column:
        """Each window's turns: the system turn, repeated ones, new ones. Each turn is taken by its place, as a slice would copy all."""

        def window(cut: Column, k: Column) -> Column:
            end = F.coalesce(F.get(c, k + 1)["begin"], F.col("n"))
            places = F.filter(F.sequence(cut["back"], F.greatest(end - 1, cut["back"])), lambda t: t < end)
            own = F.transform(places, lambda t: F.get("turns", t))
            picked = F.transform(F.concat(F.when(F.col("first") == 1, F.array(F.lit(0))).otherwise(none), places), lambda t: F.get("turns", t))
            repeated = F.when(F.col("number") + k > 0, F.col("first")).otherwise(0) + cut["begin"] - cut["back"]
            return F.struct((F.col("number") + k).cast("int").alias("window"), picked.alias("picked"), repeated.cast("int").alias("repeated"), *([] if last else [own.alias("own")]))

        return F.transform(c, window)

    return held.withColumn("windows", let(let(F.transform("turns", lambda t: F.struct(t["upto"].alias("upto"), t["tokens"].alias("tokens"))), cuts), opened))


def _placed(windows: DataFrame) -> DataFrame:
    """Windows as rows: their text, and where the loss mask lies in it."""
    one = windows.select("conv_id", "w.window", "w.picked", "w.repeated")

    def place(so_far: Column, turn: Column) -> Column:
        at = so_far["at"] + F.length(turn["head"])
        stop = at + F.length(turn["body"])
        span = F.array(F.struct(at.cast("int").alias("start"), stop.cast("int").alias("end")))
        trained = (turn["role"] == "assistant") & (so_far["k"] >= F.col("repeated"))
        return F.struct((stop + len(CLOSE)).cast("int").alias("at"), (so_far["k"] + 1).cast("int").alias("k"), F.when(trained, F.concat(so_far["spans"], span)).otherwise(so_far["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    return one.select(
        "conv_id",
        "window",
        F.array_join(F.transform("picked", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        "repeated",
        F.aggregate("picked", zero, place)["spans"].alias("loss"),
        F.aggregate("picked", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("tokens"),
    )


def read_turns(formatted: Column, repeated: Column) -> Column:
    """Array of (role, text): the turns of a window without its repeated ones."""
    parts = F.split(formatted, CLOSE, -1)
    new = F.slice(parts, repeated + 1, F.size(parts) - 1 - repeated)

    def turn(part: Column) -> Column:
        stop = F.instr(part, HEAD_END)
        role = F.substring(part, F.lit(len(OPEN) + 1), stop - len(OPEN) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(part, stop + len(HEAD_END), F.length(part))).alias("text"))

    return F.transform(new, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
