"""Five-man lineups for every row.

Who opened a later period is an aggregate: a player whose first touch in the period is not after their
first entry must have started it. Only the walk through substitutions is sequential; it runs over the
sorted rows of each task in Arrow batches and keeps two small sets as its state, never a whole game.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtape.fixed_values import SUBSTITUTION
from playtape.functions.text import is_personal_foul, substitution_direction
from playtape.operators.dedupe import keep_first

ACTORS = ["athlete_id_1", "athlete_id_2", "athlete_id_3"]
NOTES = ["carried_forward", "unresolved_period", "sub_no_side", "sub_out_not_on_court", "sub_in_already_on_court",
         "repaired_short_lineup"]
ADDED = T.StructType(
    [T.StructField("home_lineup", T.StringType()), T.StructField("away_lineup", T.StringType()),
     T.StructField("lineup_ok", T.BooleanType()), T.StructField("player_fouls", T.StringType())]
    + [T.StructField(f"note_{n}", T.IntegerType()) for n in NOTES]
)


def _is_sub() -> Column:
    return F.coalesce(F.col("type_text") == SUBSTITUTION, F.lit(False))


def roster_sides(roster: DataFrame, teams: DataFrame) -> DataFrame:
    """(game_id, athlete_id, side, starter): one row per rostered player whose team plays the game."""
    placed = roster.where(F.col("athlete_id").isNotNull() & F.col("team_id").isNotNull()).join(
        teams.select("game_id", "home_team_id", "away_team_id"), "game_id"
    )
    side = F.when(F.col("team_id") == F.col("home_team_id"), "home").when(
        F.col("team_id") == F.col("away_team_id"), "away"
    )
    rows = placed.select(
        "game_id", F.col("athlete_id").cast("bigint").alias("athlete_id"), side.alias("side"),
        F.coalesce("starter", F.lit(False)).alias("starter"),
    ).where(F.col("side").isNotNull())
    return keep_first(rows, ["game_id", "athlete_id"], [F.col("starter").desc(), "side"])


def period_openers(pbp: DataFrame, sides: DataFrame) -> DataFrame:
    """(game_id, period, side, athlete_id) of players who must have been on the floor when a period began."""
    entering, leaving = substitution_direction(F.col("athlete_id_1"), F.col("athlete_id_2"), F.col("text"))
    touches = F.when(_is_sub(), F.array(leaving)).otherwise(F.array(*ACTORS))
    seen = pbp.select(
        "game_id", "period", "play_number", F.explode(touches).alias("athlete_id")
    ).withColumn("kind", F.lit("touch"))
    came = pbp.where(_is_sub()).select("game_id", "period", "play_number", entering.alias("athlete_id")).withColumn(
        "kind", F.lit("entry")
    )
    firsts = seen.unionByName(came).where(F.col("athlete_id").isNotNull()).groupBy(
        "game_id", "period", "athlete_id"
    ).agg(
        F.min(F.when(F.col("kind") == "touch", F.col("play_number"))).alias("touch"),
        F.min(F.when(F.col("kind") == "entry", F.col("play_number"))).alias("entry"),
    )
    opened = firsts.where(F.col("touch").isNotNull() & (F.col("entry").isNull() | (F.col("touch") <= F.col("entry"))))
    return opened.join(sides.select("game_id", "athlete_id", "side"), ["game_id", "athlete_id"]).select(
        "game_id", "period", "side", "athlete_id"
    )


def game_context(sides: DataFrame, openers: DataFrame | None = None) -> DataFrame:
    """Per game: player sides, starters and, where given, openers. Its size is that of a roster."""
    def ids(test: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(test, F.col("athlete_id"))))

    roster = sides.groupBy("game_id").agg(
        F.map_from_entries(F.collect_list(F.struct("athlete_id", "side"))).alias("side_of"),
        ids(F.col("starter") & (F.col("side") == "home")).alias("start_home"),
        ids(F.col("starter") & (F.col("side") == "away")).alias("start_away"),
    )
    if openers is None:
        return roster
    periods = openers.groupBy("game_id", "period").agg(
        ids(F.col("side") == "home").alias("home"), ids(F.col("side") == "away").alias("away")
    ).groupBy("game_id").agg(
        F.map_from_entries(F.collect_list(F.struct("period", F.struct("home", "away")))).alias("openers")
    )
    return roster.join(periods, "game_id", "left")


@dataclass
class Floor:
    """State of the game being walked: the players of both sides now, and their fouls."""

    game: object = None
    period: object = None
    five: dict[str, set] = field(default_factory=lambda: {"home": set(), "away": set()})
    fouls: dict[int, int] = field(default_factory=dict)
    text: dict[str, str] = field(default_factory=lambda: {"home": "", "away": ""})
    foul_text: str = ""

    def enter_game(self, game) -> None:
        self.game, self.period, self.fouls, self.foul_text = game, None, {}, ""
        self.five = {"home": set(), "away": set()}

    def render(self, *which: str) -> None:
        for side in which:
            self.text[side] = ",".join(str(p) for p in sorted(self.five[side]))

    def enter_period(self, period, starters: dict, openers: dict, notes: dict) -> None:
        """Seed the period: starters first, openers later, the previous five where openers are not five."""
        first = period == 1
        seed = {s: set(starters[s] if first else openers[s]) for s in ("home", "away")}
        if not first and any(len(seed[s]) != 5 for s in seed):
            notes["carried_forward"] += 1
            for s in seed:
                if len(seed[s]) != 5 and len(self.five[s]) == 5:
                    seed[s] = set(self.five[s])
        notes["unresolved_period"] += any(len(seed[s]) != 5 for s in seed)
        self.period, self.five = period, seed
        self.render("home", "away")

    def substitute(self, first, second, first_side, second_side, notes: dict) -> None:
        side = (first_side if first is not None else None) or (second_side if second is not None else None)
        if side is None:
            notes["sub_no_side"] += 1
            return
        five = self.five[side]
        if first is not None and second is not None:
            swapped = first in five and second not in five
            entering, leaving = (second, first) if swapped else (first, second)
        else:
            lone = second if first is None else first
            entering, leaving = (None, lone) if lone in five else (lone, None)
        if leaving is not None:
            notes["sub_out_not_on_court"] += leaving not in five
            five.discard(leaving)
        if entering is not None:
            notes["sub_in_already_on_court"] += entering in five
            five.add(entering)
        self.render(side)

    def act(self, player, side, notes: dict) -> None:
        """Someone acting while their side is short must be on the floor."""
        if side is not None and player not in self.five[side] and len(self.five[side]) < 5:
            self.five[side].add(player)
            notes["repaired_short_lineup"] += 1
            self.render(side)

    @property
    def ok(self) -> bool:
        return len(self.five["home"]) == 5 and len(self.five["away"]) == 5

    def play(self, is_sub, is_foul, players: tuple, sides: tuple, notes: dict) -> None:
        """One play: a substitution, or up to three players acting; a foul counts against the first of them."""
        if is_sub:
            self.substitute(*players[:2], *sides[:2], notes)
        else:
            for player, side in zip(players, sides, strict=True):
                if player is not None:
                    self.act(player, side, notes)
        if is_foul and players[0] is not None:
            self.foul(players[0])

    def foul(self, player) -> None:
        self.fouls[player] = self.fouls.get(player, 0) + 1
        self.foul_text = ",".join(f"{p}:{n}" for p, n in sorted(self.fouls.items()))


def _whole(value):
    return None if value is None or value != value else int(value)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    floor = Floor()
    for rows in batches:
        out = []
        for r in rows[["game_id", "period", "_sub", "_pf", *ACTORS, "_s1", "_s2", "_s3", "_start_home", "_start_away",
                       "_open_home", "_open_away"]].itertuples(index=False, name=None):
            game, period, is_sub, is_pf, a1, a2, a3, s1, s2, s3, sh, sa, oh, oa = r
            notes = dict.fromkeys(NOTES, 0)
            if game != floor.game:
                floor.enter_game(game)
            if period != floor.period:
                floor.enter_period(period, {"home": sh, "away": sa}, {"home": oh, "away": oa}, notes)
            floor.play(is_sub, is_pf, (_whole(a1), _whole(a2), _whole(a3)), (s1, s2, s3), notes)
            out.append((floor.text["home"], floor.text["away"], floor.ok, floor.foul_text, *notes.values()))
        added = pd.DataFrame(out, columns=ADDED.names, index=rows.index)
        kept = [c for c in rows.columns if not c.startswith("_")]
        yield pd.concat([rows[kept], added], axis=1)


def resolve_lineups(pbp: DataFrame, roster: DataFrame) -> DataFrame:
    """Add both lineups, whether both have five, personal fouls so far, and notes on every repair.

    Needs ``game_id, period, play_number, type_text, text, team_id, athlete_id_1..3`` and the team ids.
    """
    teams = pbp.groupBy("game_id").agg(
        F.max("home_team_id").alias("home_team_id"), F.max("away_team_id").alias("away_team_id")
    )
    sides = roster_sides(roster, teams)
    context = game_context(sides, period_openers(pbp, sides))
    columns = pbp.columns
    df = pbp.join(context, "game_id", "left")
    none = F.array().cast("array<bigint>")
    opened = F.try_element_at("openers", F.col("period"))
    helper = {f"_s{i}": F.try_element_at("side_of", F.col(a).cast("bigint")) for i, a in enumerate(ACTORS, 1)}
    helper |= {
        "_sub": _is_sub(),
        "_pf": is_personal_foul(F.col("type_text")) & F.col("team_id").isNotNull(),
        "_start_home": F.coalesce("start_home", none), "_start_away": F.coalesce("start_away", none),
        "_open_home": F.coalesce(opened["home"], none), "_open_away": F.coalesce(opened["away"], none),
    }
    df = df.withColumns(helper).select(*columns, *helper)
    line = df.repartition("game_id").sortWithinPartitions("game_id", "period", "play_number")
    schema = T.StructType([pbp.schema[c] for c in columns] + ADDED.fields)
    return line.mapInPandas(_walk, schema)
