"""Chat formatting in budgeted windows, with a loss mask and a reversible template. DataFrame functions only.

Every turn is written as ``<|role|>`` newline, escaped text, ``<|end|>`` newline. A backslash is put inside every
control string that a text or a role contains, before every backslash, and before the role ``end``, which would spell the
closing marker; so no text and no role can open or close a turn, and each one can be read back.

Prefix sums of turn tokens place the turns: the room of a window, less its system turn and its history, is cut into
cells of half that size; the turns whose prefix sum starts in one cell form a span, except that a turn longer than a
cell stands in a span of its own. A span holds less than two cells, hence fits the room, unless a single turn alone is
longer: that one is kept whole. Each span becomes one window: the leading system turn, then at most ``history`` tokens
of the turns just before it, repeated without loss, then its own turns. Loss falls on the texts of assistant turns in
the window that owns them, so each is learned once.

Defined cases: null text or role is empty text; turns are ordered by turn (null first), then role, then text, so ties
and repeated rows keep one order; a null conv_id is a conversation like any other; no rows give no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings: the template's own markers and those of common chat templates.
CONTROL = r"(<(?=\||/?s>|</?SYS>)|\|(?=>)|\[(?=/?INST\]))"
#: A written turn up to its closing marker: role and text, both still escaped.
SHAPE = r"^<\|([\s\S]*?)\|>\n([\s\S]*)$"
MARKER_TOKENS = 2  # opening and closing marker of a turn


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, CONTROL, r"$1\\")


def escaped_role(role: Column) -> Column:
    """A role as it is written; the one that would spell the closing marker gets a backslash."""
    return F.when(role == "end", F.lit("\\end")).otherwise(escape(role))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def turn_tokens(text: Column) -> Column:
    """Estimated tokens of a turn: a token for every four code points begun, and the two markers."""
    return (F.ceil(F.length(text) / 4) + MARKER_TOKENS).cast("bigint")


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns with their place in the conversation, the leading system turn's tokens, and prefix sums after it."""
    turns = conversations.select(
        "conv_id", "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("tokens", turn_tokens(F.col("text")))
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.withColumn("pos", F.row_number().over(by_turn).cast("bigint"))
    placed = placed.withColumn("leads", (F.col("pos") == 1) & (F.col("role") == "system"))
    counted = F.when(F.col("leads"), F.lit(0)).otherwise(F.col("tokens"))
    return placed.withColumns({
        "system_tokens": F.sum(F.when(F.col("leads"), F.col("tokens")).otherwise(0)).over(so_far),
        "before": F.sum(counted).over(so_far) - counted,
    })


def spans(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Turns with the number of their span; a leading system turn shares the first span."""
    room = F.greatest(F.lit(budget) - F.col("system_tokens") - F.lit(history), F.lit(2 * max(history, 1)))
    cell = F.floor(room / 2)
    turns = turns.withColumn("cell", F.floor(F.col("before") / cell)).withColumn(
        "alone", (F.col("tokens") > cell) & ~F.col("leads"))
    in_order = Window.partitionBy("conv_id").orderBy("pos")
    before = F.lag(F.struct("cell", "alone", "leads")).over(in_order)
    opens = F.when(before.isNull() | before["leads"], 0).when(
        (before["cell"] != F.col("cell")) | F.col("alone") | before["alone"], 1).otherwise(0)
    turns = turns.withColumn("_opens", opens)
    return turns.withColumn("span", F.sum("_opens").over(
        in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("bigint")).drop("_opens")


def windows(conversations: DataFrame, budget: int = 512, history: int = 96) -> DataFrame:
    """One row per window: conv_id, window, formatted, repeated turns at its head, loss spans in code points.

    ``loss`` is an array of (begin, length), begin counted from one.
    """
    placed = spans(numbered(conversations), budget, history)
    own = placed.withColumn("part", F.lit(2))
    # A cell is at least as long as the history, so only the next three spans can repeat a turn.
    starts = placed.where(~F.col("leads")).groupBy(F.col("conv_id").alias("_conv"), F.col("span").alias("_span")).agg(
        F.min("before").alias("_start"))
    ahead = placed.where(~F.col("leads")).withColumn("_ahead", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])))
    ahead = ahead.withColumn("span", F.col("span") + F.col("_ahead")).drop("_ahead")
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    repeated = (
        ahead.join(starts, same & (F.col("span") == F.col("_span"))).where(F.col("_start") - F.col("before") <= history)
        .drop("_conv", "_span", "_start").withColumn("part", F.lit(1))
    )
    heads = (
        placed.where("leads").join(starts, same).where(F.col("_span") > 0)
        .withColumn("span", F.col("_span")).drop("_conv", "_span", "_start").withColumn("part", F.lit(0))
    )
    written = F.concat(F.lit("<|"), escaped_role(F.col("role")), F.lit("|>\n"), escape(F.col("text")), F.lit("<|end|>\n"))
    rows = own.unionByName(repeated).unionByName(heads).withColumns({
        "written": written,
        "begin": F.length(escaped_role(F.col("role"))) + 6,  # counted from one, behind the opening marker
        "size": F.length(escape(F.col("text"))),
    })
    learned = (F.col("part") == 2) & (F.col("role") == "assistant")
    to_here = Window.partitionBy("conv_id", "span").orderBy("part", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("at", F.sum(F.length("written")).over(to_here) - F.length("written"))
    piece = F.struct("part", "pos", "written", F.when(learned, F.struct((F.col("at") + F.col("begin")).cast("bigint").alias("begin"),
                                                                    F.col("size").cast("bigint").alias("length"))).alias("loss"))
    packed = rows.groupBy("conv_id", "span").agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"), F.sum((F.col("part") < 2).cast("bigint")).alias("repeated"))
    return packed.select(
        "conv_id", F.col("span").alias("window"),
        F.array_join(F.transform("pieces", lambda p: p["written"]), "").alias("formatted"),
        "repeated",
        F.transform(F.filter("pieces", lambda p: p["loss"].isNotNull()), lambda p: p["loss"]).alias("loss"),
    )


def own_turns() -> Column:
    """The written turns that a window's text owns, without its repeated head."""
    bodies = F.split(F.col("formatted"), r"<\|end\|>\n")
    count = F.greatest(F.size(bodies) - 1 - F.col("repeated"), F.lit(0))
    return F.slice(bodies, (F.col("repeated") + 1).cast("int"), count.cast("int"))


def under_loss() -> Column:
    """What a window's loss mask covers, as it was before escaping."""
    parts = F.transform("loss", lambda s: F.substring(F.col("formatted"), s["begin"], s["length"]))
    return unescape(F.array_join(parts, ""))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns (conv_id, window, place, role, text) read from the windows' texts alone, repeated turns left out."""
    listed = own_turns()
    return formatted.select("conv_id", "window", F.posexplode(listed).alias("place", "_body")).select(
        "conv_id", "window", "place",
        unescape(F.regexp_extract("_body", SHAPE, 1)).alias("role"),
        unescape(F.regexp_extract("_body", SHAPE, 2)).alias("text"),
    )


def learned_text(formatted: DataFrame) -> DataFrame:
    """Per window, the unescaped text under its loss mask."""
    return formatted.select("conv_id", "window", under_loss().alias("learned"))


def chat_digest(conversations: DataFrame, budget: int = 512, history: int = 96) -> DataFrame:
    """Per conversation: counts and digests of its turns and of its loss, read back from the formatted windows."""
    made = windows(conversations, budget, history)
    listed = own_turns()
    lines = F.transform(listed, lambda b: F.concat(
        unescape(F.regexp_extract(b, SHAPE, 1)), F.lit("\n"),
        unescape(F.regexp_extract(b, SHAPE, 2)), F.lit("\n")))
    read = made.select(
        "conv_id", "window", F.size(listed).cast("bigint").alias("turns"), F.array_join(lines, "").alias("said"),
        under_loss().alias("learned"), F.length("formatted").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("turns").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", "said", "learned"))).alias("parts"),
        F.sum("chars").cast("bigint").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_windows"),
    )
    said = F.array_join(F.transform("parts", lambda p: p["said"]), "")
    learned = F.array_join(F.transform("parts", lambda p: p["learned"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("bigint").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars", "n_windows",
    )
