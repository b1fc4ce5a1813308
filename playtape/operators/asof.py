"""As-of joins as ordered merges, and the date / tolerance matchers.

Both as-of directions put the two sides on one line ordered by (key, time) and fill along it: one
shuffle, no pair is ever built, and hot keys are split by ``ordered``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from playtape.operators.dedupe import keep_first
from playtape.operators.ordered import CALENDAR_DAYS, bfill, ffill, ordered, scan


def _merge_line(left, right, by, left_ts, right_ts, take, right_order, forward, hot_rows, at_most=None):
    """Left and right rows on one line; equal instants put the right row where it still counts."""
    ranked = keep_first(right.where(F.col(right_ts).isNotNull()), [*by, right_ts], right_order)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(1 << 50))
    edge = F.lit((1 << 50) + 1) if forward else F.lit(-1)
    taken = F.struct(F.col(right_ts).alias("_ts"), *[F.col(c) for c in take])
    r = ranked.select(*by, F.col(right_ts).alias("_t"), edge.cast("bigint").alias("_k"), taken.alias("_right"))
    l = left.select(*by, F.col(left_ts).alias("_t"), spread.cast("bigint").alias("_k"), F.struct("*").alias("_left"))
    line = r.unionByName(l, allowMissingColumns=True)
    o = ordered(line, by, ["_t", "_k"], hot_rows, at_most)
    fill = bfill if forward else ffill
    out = scan(o, _hit=fill(F.col("_right"))).result()
    return out.where(F.col("_left").isNotNull()).select(
        "_left.*", F.col("_hit._ts").alias("_matched_ts"), *[F.col(f"_hit.{c}").alias(c) for c in take]
    )


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    take: Sequence[str],
    right_order: Sequence[str] = (),
    matched_ts: str = "matched_ts",
    hot_rows: int | None = None,
    at_most: int | None = None,
    tolerance: Column | None = None,
    audit: Observation | None = None,
) -> DataFrame:
    """Every left row with the latest right row at or before it (nulls where none).

    A match older than ``tolerance`` (a number or an interval, as the times' difference is) is too stale and gives nulls. ``audit``
    counts ``unmatched``, ``too_stale`` and ``matched`` rows while the plan runs; no second scan is made for them.
    """
    out = _merge_line(left, right, by, left_ts, right_ts, take, right_order or list(take), False, hot_rows, at_most)
    found = F.col("_matched_ts").isNotNull()
    stale = F.lit(False) if tolerance is None else found & (F.col(left_ts) - F.col("_matched_ts") > tolerance)
    if audit is not None:
        out = out.observe(audit, F.count_if(~found).alias("unmatched"), F.count_if(stale).alias("too_stale"), F.count_if(found & ~stale).alias("matched"))
    if tolerance is not None:
        out = out.withColumn("_stale", stale).withColumns({c: F.when(~F.col("_stale"), F.col(c)) for c in [*take, "_matched_ts"]}).drop("_stale")
    return out.withColumnRenamed("_matched_ts", matched_ts)


def asof_forward(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    take: Sequence[str],
    window: float | None = None,
    right_order: Sequence[str] = (),
    delay: str = "fill_delay",
    hot_rows: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Every left row with the first right row at or after it, if at most ``window`` later.

    Times are numbers (seconds); ``delay`` is the distance. Rows beyond the window keep nulls.
    """
    out = _merge_line(left, right, by, left_ts, right_ts, take, right_order or list(take), True, hot_rows, at_most)
    gap = F.col("_matched_ts") - F.col(left_ts)
    near = gap.isNotNull() if window is None else gap <= F.lit(window)
    fixed = {c: F.when(near, F.col(c)) for c in take}
    return out.withColumns({**fixed, delay: F.when(near, gap)}).drop("_matched_ts")


def asof_version(rows: DataFrame, day: str, versions: DataFrame, version_day: str, out: str) -> DataFrame:
    """The latest version day at or before each row's day, clamped to the first version.

    Works on the distinct days only, so its size is the number of calendar days.
    """
    days = rows.select(day).where(F.col(day).isNotNull()).distinct().withColumn("_one", F.lit(0))
    known = versions.select(F.col(version_day).alias(out)).distinct().withColumn("_one", F.lit(0))
    known = known.withColumn("_at", F.col(out))
    hit = asof_backward(days, known, ["_one"], day, "_at", [out], matched_ts="_m", at_most=2 * CALENDAR_DAYS).drop("_one", "_m")
    floor = versions.agg(F.min(version_day).alias("_first")).scalar()
    hit = hit.withColumn(out, F.coalesce(F.col(out), floor))
    return rows.join(F.broadcast(hit), day, "left")  # one row per calendar day


def nearby_day_lookup(games: DataFrame, day: str, key: Sequence[str], value: str, days: int = 1) -> DataFrame:
    """One ``value`` per (day, key) for every day within ``days`` of a game; the nearest day wins.

    The result is unique per (day, key), so joining a tape of any size to it cannot multiply rows.
    """
    offsets = F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("_off")
    spread = games.select(day, *key, value, offsets).withColumn(day, F.date_add(F.col(day), F.col("_off")))
    return keep_first(spread, [day, *key], [F.abs("_off"), F.col("_off"), F.col(value)]).drop("_off")


def join_nearby_day(tape: DataFrame, games: DataFrame, day: str, key: Sequence[str], value: str, days: int = 1):
    """(matched, unmatched) rows of the tape against games on the same key within ``days``."""
    lookup = nearby_day_lookup(games, day, key, value, days)
    matched = tape.join(lookup, [day, *key], "inner")
    unmatched = tape.join(lookup, [day, *key], "left_anti")
    return matched, unmatched


def match_within(
    games: DataFrame,
    events: DataFrame,
    key: Sequence[str],
    game_id: str,
    game_start: str,
    event_start: str,
    event_order: Sequence[str],
    seconds: float,
) -> DataFrame:
    """First event (by ``event_order``) on the same key whose start is missing or within ``seconds``.

    No game is paired with all events of its key. Starts are cut into buckets one microsecond longer than ``seconds``: a
    game's own bucket lies wholly within reach, so its first event is enough; of the bucket before, the events from
    the game's start less ``seconds`` on count, and of the one behind, those up to its start and ``seconds``: the first
    event among them is a running minimum read at that instant. Events without a start are first reduced to one per key.
    """
    reach = int(round(seconds * 1e6))
    width = reach + 1
    own = [c for c in events.columns if c not in key]
    known = F.lit(True)
    for c in key:
        known = known & F.col(c).isNotNull()
    ranked = F.struct(*event_order, *[c for c in own if c not in event_order])
    e = events.where(known).select(*key, F.unix_micros(event_start).alias("_us"), ranked.alias("_event"))
    g = games.where(known).withColumn("_us", F.unix_micros(game_start))
    bucket = F.expr(f"_us div {width} - IF(pmod(_us, {width}) != 0 AND _us < 0, 1, 0)")
    timed = e.where(F.col("_us").isNotNull()).withColumn("_bucket", bucket)

    def at(shift: int) -> DataFrame:
        us = F.col("_us") + F.lit(shift)
        points = g.where(F.col("_us").isNotNull()).select(*key, game_id, us.alias("_us"))
        points = points.withColumn("_bucket", bucket)
        line = timed.withColumn("_point", F.lit(0)).unionByName(points.withColumn("_point", F.lit(1)), allowMissingColumns=True)
        along = F.col("_us") if shift >= 0 else F.col("_us").desc()
        seen = Window.partitionBy(*key, "_bucket").orderBy(along, "_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return line.withColumn("_event", F.min("_event").over(seen)).where((F.col("_point") == 1) & F.col("_event").isNotNull()).select(
            game_id, "_event")

    firsts = timed.groupBy(*key, "_bucket").agg(F.min("_event").alias("_event"))
    inside = g.where(F.col("_us").isNotNull()).withColumn("_bucket", bucket).join(firsts, [*key, "_bucket"]).select(game_id, "_event")
    untimed = e.where(F.col("_us").isNull()).groupBy(*key).agg(F.min("_event").alias("_event"))
    always = g.join(untimed, list(key)).select(game_id, "_event")
    found = at(reach).unionByName(at(-reach)).unionByName(inside).unionByName(always)
    best = found.groupBy(game_id).agg(F.min("_event").alias("_event"))
    one = keep_first(g.drop("_us"), [game_id], list(key))
    return one.join(best, game_id).select(*games.columns, *[F.col(f"_event.{c}").alias(c) for c in own])
