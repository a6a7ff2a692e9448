"""Chat formatting in windows of a token budget, by DataFrame functions alone.

A turn is written as ``<s>[INST]role[/INST]text</s>``. Control strings inside roles
and texts get a backslash after their bracket (``</s>`` becomes ``<\\/s>``, and that
one more), which is taken out again on reading: no text can forge a mark.

Prefix sums of the turns' tokens choose the windows. A window holds the system
turn, a limited history of turns that earlier windows hold already, and as many
new turns as the budget has room for; spans are aligned to turns, and a turn that
alone exceeds the budget gets a window of its own rather than being cut. Loss
falls on the new assistant texts only, so each is a target exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks of the template.
OPEN, ROLE_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROL = r"(/?(?:s>|INST\]))"

BUDGET = 1024
HISTORY = 256
#: Tokens that a turn's marks cost.
MARKS = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def token_estimate(text: Column) -> Column:
    """Words and marks of the text, a stand-in where no tokenizer's counts are given."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("bigint")


def _numbered(turns: DataFrame, tokens: str | None) -> DataFrame:
    """Turns with their place in the conversation from 0; ties follow role and text."""
    cost = F.col(tokens).cast("bigint") if tokens else token_estimate(F.col("text"))
    rows = turns.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        (F.coalesce(cost, F.lit(0)) + MARKS).alias("tokens"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "tokens")
    return rows.withColumn("at", (F.row_number().over(order) - 1).cast("int")).withColumn(
        "system", (F.col("at") == 0) & (F.lower("role") == "system")
    )


def _spans(numbered: DataFrame, budget: int, history: int) -> DataFrame:
    """conv_id, window, lo, hi (new turns), from_ (with history), system (kept before them)."""
    sizes = numbered.select("conv_id", "at", "tokens", "system")
    whole = Window.partitionBy("conv_id")
    so_far = whole.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = F.when(F.col("system"), 0).otherwise(F.col("tokens"))
    sums = sizes.withColumn("upto", F.sum(body).over(so_far)).withColumn("before", F.col("upto") - body)
    kept = sums.withColumn(
        "system_tokens", F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(whole)
    ).where(~F.col("system"))
    # Turns that begin at most ``history`` tokens before this one.
    recent = whole.orderBy("before").rangeBetween(-history, Window.currentRow)
    starts = kept.withColumn("from_", F.min("at").over(recent)).withColumn("held", F.col("before") - F.min("before").over(recent))
    turn = F.struct("at", "before", "upto", "from_", (F.lit(budget) - F.col("system_tokens") - F.col("held")).alias("room"))
    listed = starts.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.max("at").alias("last"))
    none = F.expr("struct(cast(array() as array<struct<lo:int,from_:int>>) as found, 0L as begin, 0L as room)")

    def step(state: Column, t: Column) -> Column:
        fits = (F.size(state["found"]) > 0) & (t["upto"] - state["begin"] <= state["room"])
        new = F.array_append(state["found"], F.struct(t["at"].alias("lo"), t["from_"].alias("from_")))
        return F.when(fits, state).otherwise(
            F.struct(new.alias("found"), t["before"].alias("begin"), t["room"].alias("room"))
        )

    found = listed.select("conv_id", "last", F.aggregate("turns", none, step, lambda s: s["found"]).alias("found"))
    each = found.select("conv_id", "last", "found", F.posexplode("found").alias("window", "own"))
    hi = F.coalesce(F.try_element_at("found", F.col("window") + 2)["lo"] - 1, F.col("last"))
    spans = each.select("conv_id", "window", F.col("own.lo").alias("lo"), hi.alias("hi"), F.col("own.from_").alias("from_"))
    # A conversation of a system turn alone has a window without new turns after it.
    alone = sums.groupBy("conv_id").agg(F.max("at").alias("hi"), F.max("system").alias("system"))
    alone = alone.where("system and hi = 0").select(
        "conv_id", F.lit(0).alias("window"), F.lit(1).alias("lo"), F.col("hi"), F.lit(1).alias("from_")
    )
    return spans.unionByName(alone)


def chat_windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: str | None = None
) -> DataFrame:
    """One row per window: conv_id, window, formatted, n_turns, n_repeated, n_tokens, loss.

    ``loss`` lists the spans (start from 0, length, in characters of ``formatted``)
    of the new assistant texts. The first ``n_repeated`` of a window's ``n_turns``
    turns are the system turn and history that earlier windows hold. ``tokens``
    names a column with exact counts. Null texts and roles are empty, a null
    conv_id is a conversation of its own, repeated rows are turns of their own,
    other columns are ignored, an empty table gives no row. A conversation's turns are
    put in order in one task, with their texts, which a turn number that repeats is
    ordered by; after that, texts meet by window.
    """
    numbered = _numbered(turns, tokens)
    spans = _spans(numbered, budget, history)
    within = F.when(F.col("hi") >= F.col("from_"), F.sequence("from_", "hi")).otherwise(F.array().cast("array<int>"))
    places = F.array_union(F.array(F.lit(0)), within)  # 0 for the system turn, if there is one
    members = spans.select(F.col("conv_id").alias("conv"), "window", "lo", "from_", F.explode(places).alias("place"))
    same = members["conv"].eqNullSafe(numbered["conv_id"]) & (members["place"] == numbered["at"])
    rows = members.join(numbered, same).where((F.col("place") >= F.col("from_")) | F.col("system"))
    repeated = F.when(F.col("system"), F.col("window") > 0).otherwise(F.col("place") < F.col("lo"))
    shown = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(ROLE_END))
    turn = F.struct(
        F.col("place"), shown.alias("head"), escape(F.col("text")).alias("body"), repeated.alias("repeated"),
        ((F.col("role") == "assistant") & ~repeated).alias("target"), F.col("tokens"),
    )
    windows = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))))
    none = F.expr("struct(0 as at, cast(array() as array<struct<start:int,length:int>>) as spans)")

    def place(state: Column, t: Column) -> Column:
        start, length = state["at"] + F.char_length(t["head"]), F.char_length(t["body"])
        span = F.struct(start.alias("start"), length.alias("length"))
        after = F.when(t["target"], F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((start + length + len(CLOSE)).alias("at"), after.alias("spans"))

    return windows.select(
        "conv_id",
        "window",
        formatted.alias("formatted"),
        F.size("turns").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"),
        F.aggregate("turns", F.lit(0).cast("bigint"), lambda n, t: n + t["tokens"]).alias("n_tokens"),
        F.aggregate("turns", none, place, lambda s: s["spans"]).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted window, unescaped, as structs of role and text."""
    marked = F.filter(F.split(formatted, CLOSE), lambda t: t != "")
    content = F.transform(marked, lambda t: F.substr(t, F.lit(len(OPEN) + 1)))
    return F.transform(
        content,
        lambda t: F.struct(
            unescape(F.substr(t, F.lit(1), F.instr(t, ROLE_END) - 1)).alias("role"),
            unescape(F.substr(t, F.instr(t, ROLE_END) + len(ROLE_END))).alias("text"),
        ),
    )


def read_targets(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: turns, targets and sizes."""
    turns = F.col("turns")
    new = F.slice(turns, F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))
    parts = windows.withColumn("turns", read_turns(F.col("formatted"))).select(
        "conv_id",
        F.struct(
            "window",
            F.concat_ws("", F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("turns"),
            F.concat_ws("", read_targets(F.col("formatted"), F.col("loss"))).alias("targets"),
        ).alias("part"),
        (F.size("turns") - F.col("n_repeated")).cast("bigint").alias("n_turns"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
    whole = parts.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        F.array_sort(F.collect_list("part")).alias("parts"),
        F.sum("formatted_chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_windows"),
    )
    text = lambda name: F.concat_ws("", F.transform("parts", lambda p: p[name]))
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(text("turns").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(text("targets")).cast("bigint").alias("loss_chars"),
        F.sha2(text("targets").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
