"""The walk through substitutions in DuckDB SQL: one recursive step for each play of a game, all games at once."""

from __future__ import annotations

from playtape.workloads.base import ROSTERS_SQL

#: Personal fouls so far by player, as one text, of every play that any foul precedes.
FOULS_SQL = """fouls AS (SELECT game_id, play_number, period, athlete_id_1 AS a FROM plays WHERE type_text IN ('Shooting Foul', 'Personal Foul') AND actor_team_id IS NOT NULL AND athlete_id_1 IS NOT NULL),
tally AS (SELECT play_number, string_agg(concat(a, ':', n), ',' ORDER BY a) AS player_fouls FROM (
  SELECT p.play_number, f.a, count(*) AS n FROM plays p JOIN fouls f ON p.game_id = f.game_id AND (f.period, f.play_number) <= (p.period, p.play_number) GROUP BY 1, 2) counted GROUP BY 1)"""
_DIRECTED = "athlete_id_1 IS NOT NULL AND athlete_id_2 IS NOT NULL"
_VERB_FIRST = "coalesce(text LIKE 'enters the game for%', false)"


def _added(five: str, side: str, place: str, name: str) -> str:
    """``five`` with a player of this side who acts while it is short."""
    joins = f"NOT is_sub AND s{place} = '{side}' AND len({five}) < 5 AND NOT list_contains({five}, athlete_id_{place})"
    return f"CASE WHEN {joins} THEN list_append({five}, athlete_id_{place}) ELSE {five} END AS {name}"


def walk_sql(source: str) -> str:
    """CTEs that end in ``lineups``: game_id, play_number, both lineups, lineup_ok and the notes, for the plays in ``source``."""
    return f"""{ROSTERS_SQL},
sides AS (SELECT game_id, athlete_id, CASE WHEN athlete_id % 2 = 0 THEN 'home' ELSE 'away' END AS side, starter FROM rosters WHERE team_id IS NOT NULL),
starters AS (SELECT game_id, list(athlete_id) FILTER (starter AND side = 'home') AS sh, list(athlete_id) FILTER (starter AND side = 'away') AS sa FROM sides GROUP BY 1),
sub_rows AS (SELECT *, CASE WHEN {_DIRECTED} THEN athlete_id_1 WHEN {_VERB_FIRST} THEN NULL ELSE coalesce(athlete_id_1, athlete_id_2) END AS ent,
  CASE WHEN {_DIRECTED} THEN athlete_id_2 WHEN {_VERB_FIRST} THEN coalesce(athlete_id_1, athlete_id_2) END AS lea FROM {source} WHERE type_text = 'Substitution'),
touched AS (SELECT game_id, period, play_number, lea AS a, 0 AS kind FROM sub_rows UNION ALL SELECT game_id, period, play_number, athlete_id_1, 0 FROM {source} WHERE type_text <> 'Substitution'
  UNION ALL SELECT game_id, period, play_number, athlete_id_2, 0 FROM {source} WHERE type_text <> 'Substitution' UNION ALL SELECT game_id, period, play_number, ent, 1 FROM sub_rows),
first_seen AS (SELECT game_id, period, a, min(CASE WHEN kind = 0 THEN play_number END) AS touch, min(CASE WHEN kind = 1 THEN play_number END) AS entry FROM touched WHERE a IS NOT NULL GROUP BY 1, 2, 3),
opened AS (SELECT f.game_id, period, list(a) FILTER (side = 'home') AS oh, list(a) FILTER (side = 'away') AS oa FROM first_seen f JOIN sides s ON f.game_id = s.game_id AND f.a = s.athlete_id
  WHERE touch IS NOT NULL AND (entry IS NULL OR touch <= entry) GROUP BY 1, 2),
steps AS MATERIALIZED (SELECT r.game_id, r.period, r.play_number, r.athlete_id_1, r.athlete_id_2, r.type_text = 'Substitution' AS is_sub, one.side AS s1, two.side AS s2,
    coalesce(sh, []) AS sh, coalesce(sa, []) AS sa, coalesce(oh, []) AS oh, coalesce(oa, []) AS oa, row_number() OVER (PARTITION BY r.game_id ORDER BY r.period, r.play_number) AS step
  FROM {source} r LEFT JOIN sides one ON r.game_id = one.game_id AND r.athlete_id_1 = one.athlete_id LEFT JOIN sides two ON r.game_id = two.game_id AND r.athlete_id_2 = two.athlete_id
  LEFT JOIN starters st ON r.game_id = st.game_id LEFT JOIN opened o ON r.game_id = o.game_id AND r.period = o.period),
walk AS (
  SELECT game_id, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS play_number, CAST(NULL AS INT) AS period, CAST([] AS BIGINT[]) AS h, CAST([] AS BIGINT[]) AS a,
    0 AS carried_forward, 0 AS unresolved_period, 0 AS sub_no_side, 0 AS sub_out_not_on_court, 0 AS sub_in_already_on_court, 0 AS repaired_short_lineup
  FROM (SELECT DISTINCT game_id FROM steps) games
  UNION ALL
  SELECT game_id, step, play_number, period, h3 AS h, a3 AS a, carried, CAST(new AND (len(h0) <> 5 OR len(a0) <> 5) AS INT), CAST(is_sub AND side IS NULL AS INT),
    CAST(coalesce(is_sub AND NOT list_contains(five, leaving), false) AS INT), CAST(coalesce(is_sub AND list_contains(rest, entering), false) AS INT),
    CASE WHEN is_sub THEN 0 ELSE len(h3) + len(a3) - len(h0) - len(a0) END
  FROM (SELECT *, {_added('h2', 'home', '2', 'h3')}, {_added('a2', 'away', '2', 'a3')} FROM (
    SELECT *, {_added('h1', 'home', '1', 'h2')}, {_added('a1', 'away', '1', 'a2')} FROM (
      SELECT *, CASE WHEN is_sub AND side = 'home' THEN after ELSE h0 END AS h1, CASE WHEN is_sub AND side = 'away' THEN after ELSE a0 END AS a1 FROM (
        SELECT *, CASE WHEN entering IS NULL OR list_contains(rest, entering) THEN rest ELSE list_append(rest, entering) END AS after FROM (
          SELECT *, list_filter(five, lambda x: x <> coalesce(leaving, -1)) AS rest FROM (
            SELECT *, CASE WHEN named_both THEN CASE WHEN swapped THEN athlete_id_2 ELSE athlete_id_1 END WHEN NOT list_contains(five, lone) THEN lone END AS entering,
              CASE WHEN named_both THEN CASE WHEN swapped THEN athlete_id_1 ELSE athlete_id_2 END WHEN list_contains(five, lone) THEN lone END AS leaving FROM (
              SELECT *, list_contains(five, athlete_id_1) AND NOT list_contains(five, athlete_id_2) AS swapped, coalesce(athlete_id_1, athlete_id_2) AS lone FROM (
                SELECT *, CASE side WHEN 'home' THEN h0 WHEN 'away' THEN a0 END AS five FROM (
                  SELECT s.*, w.period IS DISTINCT FROM s.period AS new, CAST(w.period IS DISTINCT FROM s.period AND s.period <> 1 AND (len(oh) <> 5 OR len(oa) <> 5) AS INT) AS carried,
                    CASE WHEN w.period IS NOT DISTINCT FROM s.period THEN w.h WHEN s.period = 1 THEN sh WHEN len(oh) <> 5 AND len(w.h) = 5 THEN w.h ELSE oh END AS h0,
                    CASE WHEN w.period IS NOT DISTINCT FROM s.period THEN w.a WHEN s.period = 1 THEN sa WHEN len(oa) <> 5 AND len(w.a) = 5 THEN w.a ELSE oa END AS a0,
                    athlete_id_1 IS NOT NULL AND athlete_id_2 IS NOT NULL AS named_both,
                    CASE WHEN athlete_id_1 IS NOT NULL AND s1 IS NOT NULL THEN s1 WHEN athlete_id_2 IS NOT NULL THEN s2 END AS side
                  FROM walk w JOIN steps s ON w.game_id = s.game_id AND s.step = w.step + 1) q1) q2) q3) q4) q5) q6) q7) q8) q9),
lineups AS (SELECT * EXCLUDE (h, a, step, period), array_to_string(list_sort(h), ',') AS home_lineup, array_to_string(list_sort(a), ',') AS away_lineup, len(h) = 5 AND len(a) = 5 AS lineup_ok
  FROM walk WHERE step > 0)"""
