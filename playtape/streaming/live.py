"""Live forms of the incremental operators on Structured Streaming."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ListState

from playtape.fixed_values import SUBSTITUTION
from playtape.functions.text import is_personal_foul, substitution_direction
from playtape.operators.asof import asof_forward
from playtape.operators.dedupe import keep_first
from playtape.plans.lineups import ACTORS, NOTES, Floor, game_context
from playtape.plans.features import parse_events, possession_rule

CHUNK = 10_000  # rows at most in one element of a state
SHARDS = 1024  # keys that the games of a feed are dealt over
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def landed_stream(spark: SparkSession, folder: str, schema: T.StructType, form: str = "json",
                  files_per_trigger: int | None = None) -> DataFrame:
    """New files of a landing folder as a stream."""
    reader = spark.readStream.schema(schema).format(form)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def land(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append everything not landed yet and stop; the checkpoint makes an interrupted run resume."""
    return (
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def dedupe_trades(trades: DataFrame, ts: str = "timestamp", lateness: str = "10 minutes", key: str = "trade_id") -> DataFrame:
    """One row per trade id among rows at most ``lateness`` apart."""
    return trades.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def append_versions(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch as its own version; replaying a batch replaces it, so reruns are safe."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained_windows(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str]) -> DataFrame:
    """A windowed aggregate run to the end of what has landed, with the windows that are still open.

    Append mode holds a window back until the watermark has passed it, so the last windows of a feed never come out.
    In update mode each batch writes the windows that it changed as a version, and the newest of each stands.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path))

    query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("version", T.IntegerType())])).parquet(path)
    return keep_first(rows, key, [F.col("version").desc()]).drop("version")


def complete_fills(fills: DataFrame, states: DataFrame, prints: DataFrame, lag_seconds: int = 10, window: int = 5) -> DataFrame:
    """The fills of a drained feed: those that streamed out, and those of states that were still waiting.

    ``states`` and ``prints`` are the landed rows. Only states without a streamed fill are looked at again.
    """
    waiting = states.join(fills.select("game_id", "play_number", "state_time"), ["game_id", "play_number", "state_time"], "left_anti")
    return fills.unionByName(landed_fills(waiting, prints, lag_seconds, window).select(*fills.columns))


def landed_fills(states: DataFrame, prints: DataFrame, lag_seconds: int = 10, window: int = 5) -> DataFrame:
    """The same fills from landed rows: an as-of merge, no pairs."""
    anchored = states.withColumn("_anchor", F.col("state_time") + F.make_dt_interval(secs=F.lit(float(lag_seconds))))
    first = prints.groupBy("game_id", "print_time").agg(F.min(F.struct("px_home", "px_away")).alias("_p")).withColumn("_at", F.col("print_time"))
    met = asof_forward(anchored, first, ["game_id"], "_anchor", "_at", ["print_time", "_p"])
    last = F.col("_anchor") + F.make_dt_interval(secs=F.lit(float(window)))
    return met.where(F.col("print_time") <= last).select("game_id", "play_number", "state_time", "print_time", "_p.px_home", "_p.px_away")


def latest_version(spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The newest row of every key over all versions."""
    return keep_first(spark.read.parquet(path), key, [F.col("version").desc(), *[F.col(c).desc() for c in order]])


class OneTimer:
    """A key's only timer, at the earliest instant that something may be due. When it fires, the key is looked at as of the watermark."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.at = handle, handle.getValueState("due", "at long")

    def wake(self, due_ms: int) -> None:
        held = self.at.get()
        if held is not None:
            if held[0] <= due_ms:
                return
            self.handle.deleteTimer(held[0])
        self._set(due_ms)

    def fired(self, due_ms: int | None) -> None:
        """The timer is spent; the next one, if any."""
        if due_ms is None:
            self.at.clear()
        else:
            self._set(due_ms)

    def _set(self, due_ms: int) -> None:
        self.handle.registerTimer(due_ms)
        self.at.update((due_ms,))


def _shard(game: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(game), F.lit(shards)).cast("int")


def _held(state: ListState, types: dict[str, str]) -> pd.DataFrame:
    """All rows of a list state whose elements are batches of rows, one array for each column."""
    chunks = list(state.get())
    return pd.DataFrame({c: np.concatenate([np.array(x[i], kind) for x in chunks]) if chunks else np.empty(0, kind)
                         for i, (c, kind) in enumerate(types.items())})


def _append(state: ListState, rows: pd.DataFrame) -> None:
    if len(rows):
        state.appendValue(tuple(rows[c].tolist() for c in rows.columns))


def _replace(state: ListState, rows: pd.DataFrame) -> None:
    state.clear()
    for at in range(0, len(rows), CHUNK):
        _append(state, rows.iloc[at:at + CHUNK])


class FillProcessor(StatefulProcessor):
    """The waiting states of a shard of games, answered in order of time by the prints that the watermark has passed.

    A print is held only until the watermark has passed it; then every state is known that it could answer. Each state is
    answered by the first print at or behind its anchor, or dropped when that one, or the watermark, is behind its window.
    Rows are kept by the batch, and a shard is looked at once a trigger: a call of the state store for each row or game, and a
    frame for each game, would be most of the work.
    """

    def __init__(self, lag_us: int, window_us: int, kind: str) -> None:
        self.lag, self.window, self.kind = lag_us, window_us, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", f"game_id array<{self.kind}>, at array<long>, play_number array<long>")
        self.prints = handle.getListState("prints", f"game_id array<{self.kind}>, at array<long>, px_home array<double>, px_away array<double>")
        self.timer = OneTimer(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = []
        for frame in rows:
            is_state = frame["is_state"].to_numpy(bool)
            states, prints = frame[is_state], frame[~is_state]
            _append(self.waiting, states[["game_id", "at_us", "play_number"]])
            _append(self.prints, prints[["game_id", "at_us", "px_home", "px_away"]].astype({"px_home": "f8", "px_away": "f8"}))
            due += [x.min() + later for x, later in ((states["at_us"], self.lag + self.window), (prints["at_us"], 0)) if len(x)]
        self.timer.wake(_behind(min(due)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = _held(self.waiting, {"game_id": "O", "at": "i8", "play_number": "i8"})
        prints = _held(self.prints, {"game_id": "O", "at": "i8", "px_home": "f8", "px_away": "f8"})
        passed = prints[prints["at"] < now].sort_values(["at", "px_home", "px_away"], na_position="first").drop_duplicates(["game_id", "at"])
        passed = passed.reset_index(drop=True).rename_axis("place").reset_index().rename(columns={"at": "print_us"})
        waiting = waiting.assign(anchor=waiting["at"] + self.lag, last=waiting["at"] + self.lag + self.window).sort_values(["anchor", "play_number"])
        met = pd.merge_asof(waiting, passed[["game_id", "print_us", "place"]], left_on="anchor", right_on="print_us", by="game_id", direction="forward")
        none = met["place"].isna()
        answer = passed.iloc[met["place"].fillna(0).astype("i8")[~none].to_numpy()]
        found = met.loc[~none, ["game_id", "play_number", "at", "last"]].assign(**{c: answer[c].to_numpy() for c in ("print_us", "px_home", "px_away")})
        found = found[found["print_us"] <= found["last"]]
        still, ahead = met[none & (met["last"] >= now)], prints[prints["at"] >= now]  # a print of those may still come
        _replace(self.waiting, still[["game_id", "at", "play_number"]])
        _replace(self.prints, ahead)
        due = [x.min() for x in (still["last"], ahead["at"]) if len(x)]
        self.timer.fired(_behind(min(due)) if due else None)
        if len(found):
            yield found.rename(columns={"at": "state_us"})[["game_id", "play_number", "state_us", "print_us", "px_home", "px_away"]]

    def close(self) -> None:
        pass


def _behind(at_us: int) -> int:
    """The first whole millisecond behind an instant."""
    return int(at_us) // 1000 + 1


def live_fills(states: DataFrame, prints: DataFrame, lag_seconds: int = 10, window: int = 5,
               lateness: str = "30 seconds", shards: int = SHARDS) -> DataFrame:
    """First print from ``lag_seconds`` after each state, at most ``window`` seconds later. Needs the RocksDB state store.

    States carry ``game_id, play_number, state_time``; prints ``game_id, print_time, px_home, px_away``. What is held of a game is its
    waiting states and the prints of the last ``lateness``: no pair of a state and a print. Games are dealt over ``shards``.
    """
    kind = states.schema["game_id"].dataType.simpleString()
    none, unnumbered = F.lit(None), F.lit(-(1 << 63))
    line = states.select("game_id", F.col("state_time").alias("at"), F.lit(True).alias("is_state"), F.coalesce(F.col("play_number").cast("long"), unnumbered).alias("play_number"),
                         none.cast("double").alias("px_home"), none.cast("double").alias("px_away")).unionByName(
        prints.select("game_id", F.col("print_time").alias("at"), F.lit(False).alias("is_state"), unnumbered.alias("play_number"),
                      F.col("px_home").cast("double").alias("px_home"), F.col("px_away").cast("double").alias("px_away")))
    # Without a game or an instant, nothing can match.
    line = line.where(F.col("game_id").isNotNull() & F.col("at").isNotNull())
    rows = line.withWatermark("at", lateness).withColumns({"at_us": F.unix_micros("at"), "shard": _shard(F.col("game_id"), shards)})
    found = rows.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=FillProcessor(lag_seconds * 1_000_000, window * 1_000_000, kind),
        outputStructType=f"game_id {kind}, play_number bigint, state_us bigint, print_us bigint, px_home double, px_away double",
        outputMode="Append", timeMode="EventTime")
    number = F.nullif(F.col("play_number"), unnumbered).cast(states.schema["play_number"].dataType)
    return found.select("game_id", number.alias("play_number"),
                        F.timestamp_micros("state_us").alias("state_time"), F.timestamp_micros("print_us").alias("print_time"), "px_home", "px_away")


class PossessionProcessor(StatefulProcessor):
    """Holds the last known ball side of one game."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ball = handle.getValueState("ball", T.StructType([T.StructField("side", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows), ignore_index=True).sort_values("play_number")
        held = self.ball.get()[0] if self.ball.exists() else None
        side = seen["ball"].astype("float64").ffill()
        if held is not None:
            side = side.fillna(held)
        if side.notna().any():
            self.ball.update((float(side.iloc[-1]),))
        yield pd.DataFrame({
            "game_id": key[0], "play_number": seen["play_number"].to_numpy(), "possession": side.fillna(0.0).to_numpy(),
            "poss_known": side.notna().astype("int32").to_numpy(),
        })

    def close(self) -> None:
        pass


def live_possession(events: DataFrame) -> DataFrame:
    """Possession after each event of a live feed, one small state per game. Needs the RocksDB state store.

    Rows of a game within one trigger are those that arrived since the last one, not its history.
    """
    rows = parse_events(events).select("game_id", "play_number", possession_rule().alias("ball"))
    return rows.groupBy("game_id").transformWithStateInPandas(
        statefulProcessor=PossessionProcessor(),
        outputStructType="game_id string, play_number bigint, possession double, poss_known int",
        outputMode="Append", timeMode="None",
    )


Play = namedtuple("Play", "game_id period number team_foul is_sub a1 a2 a3 s1 s2 s3 entering leaving at_ms start_home start_away")
_PLAY = dict(zip(Play._fields, "string int long int int long long long string string string long long long string string".split(), strict=True))


class LineupProcessor(StatefulProcessor):
    """Five-man lineups and fouls of a shard of games, released in play order.

    Who opened a period shows only in the whole period, so rows are held, in whatever order they come, until the watermark
    has passed a row of a later period: nothing of the earlier one can follow then. A game with nothing new for ``idle_ms`` of
    event time gives its last rows and is forgotten; ids that come again after that are a new game. A play of a period that was
    already released (it came later than the feed promised) comes out at once, with the lineups of now, and is marked late.
    Plays are kept by the batch, and a shard is looked at once a trigger.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", ", ".join(f"{c} array<{kind}>" for c, kind in _PLAY.items()))
        self.floors = handle.getMapState("floors", "game_id string", "period int, home string, away string, fouls string")
        self.timer = OneTimer(handle)

    def _load(self) -> dict[str | None, Floor]:
        floors = {}
        for (game,), (period, home, away, fouls) in self.floors.iterator():
            floor = floors[game] = Floor(game, period, {"home": set(_ids(home)), "away": set(_ids(away))})
            floor.fouls = {int(p): int(n) for p, n in (x.split(":") for x in fouls.split(",") if x)}
            floor.render("home", "away")
            floor.foul_text = fouls
        return floors

    def _save(self, game: str | None, floor: Floor) -> None:
        self.floors.updateValue((game,), (floor.period, floor.text["home"], floor.text["away"], floor.foul_text))

    def _hold(self, plays: list[Play]) -> None:
        for at in range(0, len(plays), CHUNK):
            self.held.appendValue(tuple(map(list, zip(*plays[at:at + CHUNK], strict=True))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        floors, late, due = self._load(), [], []
        for frame in rows:
            plays = [Play(*values) for values in zip(*(_plain(frame[c]) for c in _PLAY), strict=True)]
            was = [p.game_id in floors and p.period <= floors[p.game_id].period for p in plays]
            late += [p for p, behind in zip(plays, was, strict=True) if behind]
            fresh = [p for p, behind in zip(plays, was, strict=True) if not behind]
            self._hold(fresh)
            due += [p.at_ms + 1 for p in fresh]
        if due:
            self.timer.wake(min(due))
        late.sort(key=lambda p: (p.game_id or "", p.period, p.number))
        out = [_walked(floors[p.game_id], p, True) for p in late]
        for game in {p.game_id for p in late}:
            self._save(game, floors[game])
        if out:
            yield _lineup_rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        games: dict[str | None, dict[tuple, Play]] = {}
        for chunk in self.held.get():
            for play in map(Play._make, zip(*chunk, strict=True)):
                games.setdefault(play.game_id, {})[play.period, play.number] = play
        floors, out, kept, due = self._load(), [], [], []
        for game, plays in games.items():
            idle = max(p.at_ms for p in plays.values()) + self.idle_ms
            passed = [p.period for p in plays.values() if p.at_ms < now]
            ready = sorted(name for name in plays if idle <= now or (passed and name[0] < max(passed)))
            floor = floors.get(game) or Floor(game)
            for period, names in groupby(ready, lambda name: name[0]):
                part = [plays.pop(name) for name in names]
                if period != floor.period:
                    starts = {"home": _ids(part[0].start_home), "away": _ids(part[0].start_away)}
                    floor.enter_period(period, starts, openers_of(part), dict.fromkeys(NOTES, 0))
                out += [_walked(floor, p, False) for p in part]
            if plays:
                first = min(p.period for p in plays.values())
                due.append(min([idle] + [p.at_ms + 1 for p in plays.values() if p.period > first]))
                kept += plays.values()
                if ready:
                    self._save(game, floor)
            elif game in floors:
                self.floors.removeKey((game,))
        self.held.clear()
        self._hold(kept)
        self.timer.fired(min(due, default=None))
        if out:
            yield _lineup_rows(out)

    def close(self) -> None:
        pass


def _plain(column: pd.Series) -> list:
    """Values as Python's own, null as None; a column of whole numbers with nulls comes as floats."""
    return [None if x is None or x != x else x if isinstance(x, str) else int(x) for x in column.tolist()]


def _walked(floor: Floor, p: Play, late: bool) -> tuple:
    floor.play(p.is_sub, p.team_foul, (p.a1, p.a2, p.a3), (p.s1, p.s2, p.s3), dict.fromkeys(NOTES, 0))
    return (p.game_id, p.period, p.number, floor.text["home"], floor.text["away"], floor.ok, floor.foul_text, int(late))


_LINEUPS = {"game_id": "object", "period": "int32", "play_number": "int64", "home_lineup": "object", "away_lineup": "object",
            "lineup_ok": "bool", "player_fouls": "object", "late": "int32"}


def _lineup_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(_LINEUPS)).astype(_LINEUPS)


def _ids(text: str | None) -> list[int]:
    return [int(p) for p in (text or "").split(",") if p]


def openers_of(plays: list[Play]) -> dict[str, list[int]]:
    """Who of either side must have been on the floor when a period began: touched not after entering."""
    touch, entry, side_of = {}, {}, {}
    for play in plays:
        actors = play.a1, play.a2, play.a3
        side_of.update({p: s for p, s in zip(actors, (play.s1, play.s2, play.s3), strict=True) if p is not None and s is not None})
        for p in ((play.leaving,) if play.is_sub else actors):
            if p is not None:
                touch.setdefault(p, play.number)
        if play.is_sub and play.entering is not None:
            entry.setdefault(play.entering, play.number)
    opened = [p for p in touch if p in side_of and touch[p] <= entry.get(p, touch[p])]
    return {side: sorted(p for p in opened if side_of[p] == side) for side in ("home", "away")}


def live_lineups(plays: DataFrame, sides: DataFrame, lateness: str = "10 minutes", idle: str = "3 hours", shards: int = SHARDS) -> DataFrame:
    """Lineups and personal fouls after every play of a live feed that comes out of order. Needs the RocksDB state store.

    ``plays`` carry ``game_id, period, play_number, type_text, text, team_id, athlete_id_1..3`` and the instant ``at``; ``sides``
    is the rosters' (game_id, athlete_id, side, starter). Rows leave when the watermark, ``lateness`` behind the newest
    instant, has passed a later period, or ``idle`` behind the game's last play. What is held of a game: the plays of open
    periods (ids and flags, no text), two fives and the fouls. Games are dealt over ``shards``.
    """
    starters = game_context(sides)
    entering, leaving = substitution_direction(F.col("athlete_id_1").cast("long"), F.col("athlete_id_2").cast("long"), F.col("text"))
    actors = [F.col(a).cast("long") for a in ACTORS]
    known = plays.withWatermark("at", lateness).join(starters, "game_id", "left")
    rows = known.select(
        _shard(F.col("game_id"), shards).alias("shard"), "game_id", "period", F.col("play_number").cast("long").alias("number"), "at",
        F.coalesce(F.col("type_text") == SUBSTITUTION, F.lit(False)).cast("int").alias("is_sub"),
        (is_personal_foul(F.col("type_text")) & F.col("team_id").isNotNull()).cast("int").alias("team_foul"),
        *[a.alias(f"a{i}") for i, a in enumerate(actors, 1)],
        *[F.try_element_at("side_of", a).alias(f"s{i}") for i, a in enumerate(actors, 1)],
        entering.alias("entering"), leaving.alias("leaving"), F.unix_millis("at").alias("at_ms"),
        # The starters are the seed of a game's first period alone.
        *[F.when(F.col("period") == 1, F.array_join(c, ",")).alias(c) for c in ("start_home", "start_away")])
    width = int(pd.Timedelta(idle).total_seconds() * 1000)
    return rows.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=LineupProcessor(width),
        outputStructType="game_id string, period int, play_number bigint, home_lineup string, away_lineup string, lineup_ok boolean, player_fouls string, late int",
        outputMode="Append", timeMode="EventTime",
    )


def trades_per_minute(trades: DataFrame, ts: str = "timestamp", lateness: str = "2 minutes", width: str = "1 minute") -> DataFrame:
    """Trades and contracts per game and minute."""
    return (
        trades.withWatermark(ts, lateness).groupBy("game_id", F.window(ts, width).alias("w"))
        .agg(F.count(F.lit(1)).alias("trades"), F.sum("count_fp").alias("contracts"))
        .select("game_id", F.col("w.start").alias("minute"), "trades", "contracts")
    )
