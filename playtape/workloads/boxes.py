"""Box scores, possession, rates and per-event features on the play view."""

from __future__ import annotations

from pyspark.sql import functions as F

from playtape.plans import box, features, priors, rates as rate_plans, reports
from playtape.plans.features import carry_possession, possession_rule
from playtape.operators.ordered import ordered
from playtape.session import cut_lineage
from playtape.workloads.base import (
    ODDS_SQL,
    PLAYS_SQL,
    RATES_SQL,
    ROSTERS_SQL,
    game_bound,
    games_count,
    odds,
    plays,
    query,
    rates,
    rosters,
    rounded,
    shown,
)

# -- flags in SQL --------------------------------------------------------------------------------

BOX_FLAGS = f"""{PLAYS_SQL},
value_ok AS (SELECT season, max(score_value) <= 4 AS ok FROM plays GROUP BY season),
raw_flags AS (SELECT p.*, coalesce(type_text ILIKE '%free throw%', false) AS is_ft, coalesce(lower(text) LIKE '%makes%', false) AS made,
  coalesce(lower(text) LIKE '%misses%', false) AS missed, coalesce(lower(text) LIKE '%block%', false) AS blk,
  coalesce(lower(text) LIKE '%three point%', false) OR (v.ok AND score_value = 3) AS three
  FROM plays p JOIN value_ok v ON p.season = v.season),
tagged AS (SELECT *,
  is_ft AND made AS is_ft_made, is_ft AND (made OR missed) AS is_ft_att,
  NOT is_ft AND (made OR missed OR blk) AS is_fga, NOT is_ft AND made AS is_fgm,
  NOT is_ft AND (made OR missed OR blk) AND three AS is_fg3a, NOT is_ft AND made AND three AS is_fg3m,
  NOT is_ft AND (made OR missed OR blk) AND NOT three AS is_fg2a, NOT is_ft AND made AND NOT three AS is_fg2m,
  type_text ILIKE '%turnover%' AS is_tov, type_text ILIKE '%foul%' AND NOT type_text ILIKE '%turnover%' AS is_foul,
  type_text ILIKE '%rebound%' AND type_text ILIKE '%offensive%' AS is_oreb, type_text ILIKE '%rebound%' AND type_text ILIKE '%defensive%' AS is_dreb,
  coalesce(lower(text) LIKE '%assists%', false) AS is_ast, type_text ILIKE '%turnover%' AND coalesce(lower(text) LIKE '%steal%', false) AS tov_stolen,
  NOT is_ft AND NOT made AND NOT missed AND blk AS fga_blocked,
  CASE WHEN NOT is_ft AND made AND three THEN 3.0 WHEN NOT is_ft AND made THEN 2.0 WHEN is_ft AND made THEN 1.0 ELSE 0.0 END AS pts,
  coalesce(actor_team_id = home_team_id, false) AS home_actor,
  actor_team_id IS NOT NULL AND actor_team_id <> home_team_id AS away_actor
  FROM raw_flags)"""

STINTS = f"""{BOX_FLAGS},
marked AS (SELECT *, CASE WHEN lag(home_lineup) OVER w IS DISTINCT FROM home_lineup OR lag(away_lineup) OVER w IS DISTINCT FROM away_lineup THEN 1 ELSE 0 END AS new FROM tagged
  WINDOW w AS (PARTITION BY game_id ORDER BY play_number)),
numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY game_id ORDER BY play_number ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stint_id FROM marked),
stints AS (SELECT * FROM (SELECT game_id, game_date, season, stint_id, home_lineup, away_lineup,
  sum(CASE WHEN home_actor THEN pts ELSE 0 END) AS pts_home, sum(CASE WHEN away_actor THEN pts ELSE 0 END) AS pts_away,
  count(*) FILTER (WHERE home_actor AND is_fga) - count(*) FILTER (WHERE home_actor AND is_oreb AND athlete_id_1 IS NOT NULL) + count(*) FILTER (WHERE home_actor AND is_tov) + 0.44e0 * count(*) FILTER (WHERE home_actor AND is_ft_att) AS poss_home,
  count(*) FILTER (WHERE away_actor AND is_fga) - count(*) FILTER (WHERE away_actor AND is_oreb AND athlete_id_1 IS NOT NULL) + count(*) FILTER (WHERE away_actor AND is_tov) + 0.44e0 * count(*) FILTER (WHERE away_actor AND is_ft_att) AS poss_away,
  greatest(max(seconds_elapsed) - min(seconds_elapsed), 0) AS seconds FROM numbered GROUP BY ALL) WHERE poss_home > 0 OR poss_away > 0)"""


def _tagged(spark, folder):
    return box.tag_box(plays(spark, folder))


@query("box_flags", f"""WITH {BOX_FLAGS} SELECT season, CAST(count(*) FILTER (WHERE is_fga) AS BIGINT) AS fga, CAST(count(*) FILTER (WHERE is_fgm) AS BIGINT) AS fgm, CAST(count(*) FILTER (WHERE is_fg3a) AS BIGINT) AS fg3a, CAST(count(*) FILTER (WHERE is_ft_att) AS BIGINT) AS fta,
 CAST(count(*) FILTER (WHERE is_foul) AS BIGINT) AS fouls, CAST(count(*) FILTER (WHERE tov_stolen) AS BIGINT) AS stolen, CAST(count(*) FILTER (WHERE fga_blocked) AS BIGINT) AS blocked, CAST(count(*) FILTER (WHERE is_ast) AS BIGINT) AS ast, round(sum(pts), 2) AS pts FROM tagged GROUP BY season""")
def _(spark, folder):
    names = {"fga": "is_fga", "fgm": "is_fgm", "fg3a": "is_fg3a", "fta": "is_ft_att", "fouls": "is_foul", "stolen": "tov_stolen", "blocked": "fga_blocked", "ast": "is_ast"}
    return rounded(_tagged(spark, folder).groupBy("season").agg(
        *[F.count_if(c).alias(n) for n, c in names.items()], F.sum("pts").alias("pts")), 2)


@query("stints", shown(f"WITH {STINTS} SELECT * FROM stints", "game_id game_date season stint_id home_lineup away_lineup", "pts_home pts_away poss_home poss_away seconds", 5))
def _(spark, folder):
    return rounded(box.stints(_tagged(spark, folder), at_most=game_bound(spark, folder)), 5)


EXPOSURE = f"""{STINTS},
sides AS (SELECT game_id, CAST(unnest(string_split(home_lineup, ',')) AS BIGINT) AS athlete_id, poss_home AS poss_off, poss_away AS poss_def, seconds, 1 AS oc_is_home FROM stints
  UNION ALL SELECT game_id, CAST(unnest(string_split(away_lineup, ',')) AS BIGINT), poss_away, poss_home, seconds, 0 FROM stints),
exposure AS (SELECT game_id, athlete_id, sum(poss_off) AS poss_off, sum(poss_def) AS poss_def, sum(seconds) AS seconds, max(oc_is_home) AS oc_is_home, sum(seconds) / 60 AS minutes FROM sides GROUP BY 1, 2)"""


@query("oncourt_exposure", shown(f"WITH {EXPOSURE} SELECT * FROM exposure", "game_id athlete_id oc_is_home", "poss_off poss_def seconds minutes", 8))
def _(spark, folder):
    return rounded(box.oncourt_exposure(box.stints(_tagged(spark, folder), at_most=game_bound(spark, folder))), 8)


COUNTS = {"fga": "is_fga", "fgm": "is_fgm", "fg3a": "is_fg3a", "fg3m": "is_fg3m", "fg2a": "is_fg2a", "fg2m": "is_fg2m", "fta": "is_ft_att", "ftm": "is_ft_made", "tov": "is_tov", "oreb": "is_oreb", "dreb": "is_dreb", "fouls": "is_foul"}
PLAYER_BOX = f"""{EXPOSURE},
counts AS (SELECT game_id, athlete_id_1 AS athlete_id, CAST(avg(CASE WHEN home_actor THEN 1.0 ELSE 0 END) > 0.5 AS INT) AS is_home, sum(pts) AS pts, {', '.join(f'count(*) FILTER (WHERE {f}) AS {n}' for n, f in COUNTS.items())}
  FROM tagged WHERE athlete_id_1 IS NOT NULL GROUP BY 1, 2),
gaps AS (SELECT game_id, max(game_date) AS game_date, max(season) AS season, max(home_final) - sum(CASE WHEN home_actor THEN pts ELSE 0 END) AS gap_home, max(away_final) - sum(CASE WHEN away_actor THEN pts ELSE 0 END) AS gap_away FROM tagged GROUP BY 1),
player_box AS (SELECT e.*, g.game_date, g.season, coalesce(c.is_home, 0) AS is_home, coalesce(c.pts, 0) AS pts, {', '.join(f'coalesce(c.{n}, 0) AS {n}' for n in COUNTS)}, coalesce(CASE WHEN oc_is_home = 1 THEN gap_home ELSE gap_away END, 0) AS pts_gap
  FROM exposure e LEFT JOIN counts c ON e.game_id = c.game_id AND e.athlete_id = c.athlete_id LEFT JOIN gaps g ON e.game_id = g.game_id)"""
PLAYER_BOX_ROUND = "poss_off poss_def seconds minutes pts pts_gap " + " ".join(COUNTS)


def _player_box(spark, folder):
    """Box and stints are season tables in the pipeline; they are written once here too."""
    tagged = cut_lineage(_tagged(spark, folder))
    stint = cut_lineage(box.stints(tagged, at_most=game_bound(spark, folder)))
    return box.player_game_box(tagged, stint)


@query("player_game_box", shown(f"WITH {PLAYER_BOX} SELECT * FROM player_box", "game_id athlete_id game_date season is_home", PLAYER_BOX_ROUND, 8))
def _(spark, folder):
    return rounded(_player_box(spark, folder), 8)


@query("missing_points", shown(f"WITH {PLAYER_BOX} SELECT * FROM gaps", "game_id game_date season", "gap_home gap_away"))
def _(spark, folder):
    return rounded(box.missing_points(_tagged(spark, folder)))


META = f"""meta AS (SELECT game_id, max(season) AS season, max(game_date) AS game_date, max(home_team) AS home_team, max(away_team) AS away_team, max(home_team_id) AS home_team_id, max(away_team_id) AS away_team_id,
  max(home_final) AS home_final, max(away_final) AS away_final, max(period) AS max_period, CAST(2880 + greatest(max(period) - 4, 0) * 300 AS DOUBLE) AS game_seconds FROM plays GROUP BY game_id)"""


@query("game_meta", f"WITH {PLAYS_SQL}, {META} SELECT * FROM meta")
def _(spark, folder):
    return box.game_meta(plays(spark, folder))


TEAM_COUNTS = {"fga": "is_fga", "fgm": "is_fgm", "fg3a": "is_fg3a", "fg3m": "is_fg3m", "fta": "is_ft_att", "ftm": "is_ft_made", "oreb": "is_oreb AND athlete_id_1 IS NOT NULL", "dreb": "is_dreb AND athlete_id_1 IS NOT NULL", "tov": "is_tov", "ast": "is_ast", "fouls": "is_foul", "tov_stolen": "tov_stolen", "fga_blocked": "fga_blocked"}
OPP = ["pts", *TEAM_COUNTS, "poss"]
TEAM_BOX = f"""{BOX_FLAGS}, {META},
totals AS (SELECT game_id, actor_team_id AS team_id, sum(pts) AS pts, {', '.join(f'count(*) FILTER (WHERE {f}) AS {n}' for n, f in TEAM_COUNTS.items())} FROM tagged WHERE actor_team_id IS NOT NULL GROUP BY 1, 2),
own AS (SELECT t.*, m.* EXCLUDE (game_id), CAST(team_id = home_team_id AS INT) AS is_home, CASE WHEN team_id = home_team_id THEN home_team ELSE away_team END AS team, CASE WHEN team_id = home_team_id THEN away_team ELSE home_team END AS opponent,
  CASE WHEN team_id = home_team_id THEN away_team_id ELSE home_team_id END AS opp_team_id, CASE WHEN team_id = home_team_id THEN home_final ELSE away_final END AS team_final, CASE WHEN team_id = home_team_id THEN away_final ELSE home_final END AS opp_final,
  fga - oreb + tov + 0.44e0 * fta AS poss FROM totals t JOIN meta m ON t.game_id = m.game_id),
team_box AS (SELECT a.*, CAST(a.team_final > a.opp_final AS INT) AS won, a.team_final - a.pts AS pts_gap, {', '.join(f'o.{c} AS opp_{c}' for c in OPP)},
  coalesce(o.tov_stolen, 0) AS stl, coalesce(o.fga_blocked, 0) AS blk, a.oreb + a.dreb AS reb, o.oreb + o.dreb AS opp_reb, a.tov_stolen AS opp_stl, a.fga_blocked AS opp_blk
  FROM own a LEFT JOIN own o ON a.game_id = o.game_id AND o.team_id = a.opp_team_id)"""
TEAM_BOX_KEEP = "game_id team_id season game_date team opponent opp_team_id is_home won"
TEAM_BOX_ROUND = "pts poss pts_gap team_final opp_final stl blk reb opp_reb opp_stl opp_blk " + " ".join(TEAM_COUNTS) + " " + " ".join(f"opp_{c}" for c in OPP)


def _team_box(spark, folder):
    return box.team_game_box(_tagged(spark, folder))


@query("team_game_box", shown(f"WITH {TEAM_BOX} SELECT * FROM team_box", TEAM_BOX_KEEP, TEAM_BOX_ROUND))
def _(spark, folder):
    df = _team_box(spark, folder)
    return rounded(df.select(*TEAM_BOX_KEEP.split(), *[F.col(c).cast("double").alias(c) for c in TEAM_BOX_ROUND.split()]))


@query("scoring_check", shown(f"WITH {TEAM_BOX}, g AS (SELECT game_id, sum(pts) AS b, sum(team_final) AS o FROM team_box GROUP BY 1) SELECT avg(CASE WHEN o <> 0 THEN b / o END) AS ratio, avg(CASE WHEN b = o THEN 1.0 ELSE 0 END) AS exact_share FROM g", "", "ratio exact_share"))
def _(spark, folder):
    return rounded(reports.scoring_check(_team_box(spark, folder)))


@query("shooting_check", shown(f"WITH {TEAM_BOX} SELECT sum(fgm) / sum(fga) AS fg_pct, sum(blk) / count(*) AS blk_per_game, sum(fga) / count(*) AS fga_per_game FROM team_box", "", "fg_pct blk_per_game fga_per_game"))
def _(spark, folder):
    return rounded(reports.shooting_check(_team_box(spark, folder)))


TIMING = f"""{BOX_FLAGS},
said AS (SELECT *, CASE WHEN actor_team_id IS NULL THEN NULL WHEN is_fga OR is_ft_att OR is_tov OR is_oreb THEN actor_team_id WHEN is_dreb THEN CASE WHEN actor_team_id = home_team_id THEN away_team_id ELSE home_team_id END END AS s FROM tagged),
filled AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY game_id, period ORDER BY play_number ROWS UNBOUNDED PRECEDING),
  first_value(s IGNORE NULLS) OVER (PARTITION BY game_id, period ORDER BY play_number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS off FROM said),
flagged AS (SELECT *, CASE WHEN lag(off) OVER (PARTITION BY game_id, period ORDER BY play_number) IS DISTINCT FROM off THEN 1 ELSE 0 END AS new FROM filled WHERE off IS NOT NULL),
runs AS (SELECT *, sum(new) OVER (PARTITION BY game_id, period ORDER BY play_number ROWS UNBOUNDED PRECEDING) AS poss_id FROM flagged),
p AS (SELECT game_id, period, poss_id, off, max(seconds_elapsed) AS t_end, min(CASE WHEN is_fga THEN seconds_elapsed END) AS t_first FROM runs GROUP BY ALL),
t AS (SELECT *, coalesce(lag(t_end) OVER (PARTITION BY game_id, period ORDER BY poss_id), CASE WHEN period <= 4 THEN (period - 1) * 720 ELSE 2880 + (period - 5) * 300 END) AS t0 FROM p),
timing AS (SELECT game_id, off AS team_id, CAST(count(*) AS BIGINT) AS poss_seg, coalesce(sum(t_end - t0) FILTER (WHERE t_end - t0 BETWEEN 0 AND 60), 0) AS sum_poss_sec, CAST(count(*) FILTER (WHERE t_end - t0 BETWEEN 0 AND 60) AS BIGINT) AS n_poss_sec,
  coalesce(sum(t_first - t0) FILTER (WHERE t_first - t0 BETWEEN 0 AND 40), 0) AS sum_shot_sec, CAST(count(*) FILTER (WHERE t_first - t0 BETWEEN 0 AND 40) AS BIGINT) AS n_shot_sec FROM t GROUP BY 1, 2)"""


@query("possession_timing", shown(f"WITH {TIMING} SELECT * FROM timing", "game_id team_id poss_seg n_poss_sec n_shot_sec", "sum_poss_sec sum_shot_sec", 5))
def _(spark, folder):
    return rounded(box.possession_timing(_tagged(spark, folder), at_most=game_bound(spark, folder)), 5)


# -- strict flags, possession, segments ----------------------------------------------------------

STRICT = f"""{PLAYS_SQL},
s0 AS (SELECT *, type_text LIKE 'Free Throw%' AS ft, coalesce(regexp_matches(text, '(?i)\\bmakes\\b'), false) AS makes, coalesce(regexp_matches(text, '(?i)\\bmisses\\b'), false) AS misses,
  coalesce(regexp_matches(text, '(?i)three point'), false) AS three, regexp_matches(type_text, '(?i)turnover') OR coalesce(regexp_matches(text, '(?i)turnover'), false) AS is_turnover,
  coalesce(regexp_matches(text, '(?i)steal'), false) AS is_steal, regexp_matches(type_text, '(?i)defensive rebound') AS is_def_reb, regexp_matches(type_text, '(?i)offensive rebound') AS is_off_reb,
  regexp_extract(text, '(?i)free throw ([0-9]+) of ([0-9]+)', 1) AS n1, regexp_extract(text, '(?i)free throw ([0-9]+) of ([0-9]+)', 2) AS n2,
  TRY_CAST(nullif(regexp_extract(text, '(?i)([0-9]+)-foot', 1), '') AS INT) AS shot_dist, concat(type_text, ' | ', coalesce(text, '')) AS words FROM plays),
strict AS (SELECT *, NOT ft AND (makes OR misses) AS is_fga, NOT ft AND (makes OR misses) AND three AS is_fg3a, NOT ft AND makes AND three AS is_fg3m, NOT ft AND (makes OR misses) AND NOT three AS is_fg2a, NOT ft AND makes AND NOT three AS is_fg2m,
  ft AND (makes OR misses) AS is_fta, ft AND makes AS is_ftm, ft AND (makes OR misses) AND n1 <> '' AND n1 = n2 AS is_ft_last, regexp_matches(type_text, '(?i)foul') AND NOT is_turnover AS is_foul,
  CASE WHEN regexp_matches(words, '(?i)dunk') THEN 'dunk' WHEN regexp_matches(words, '(?i)layup|finger roll|tip shot|putback') THEN 'layup' WHEN regexp_matches(words, '(?i)hook') THEN 'hook' WHEN regexp_matches(words, '(?i)fade away|turnaround|step back') THEN 'fade'
    WHEN regexp_matches(words, '(?i)floating|driving') THEN 'float' WHEN regexp_matches(words, '(?i)pullup|running') THEN 'pullup' WHEN regexp_matches(words, '(?i)jump|shot') THEN 'jump' ELSE 'other' END AS shot_family,
  CASE WHEN shot_dist IS NULL THEN -1 WHEN shot_dist >= 30 THEN 9 WHEN shot_dist >= 27 THEN 8 WHEN shot_dist >= 24 THEN 7 WHEN shot_dist >= 22 THEN 6 WHEN shot_dist >= 18 THEN 5 WHEN shot_dist >= 14 THEN 4 WHEN shot_dist >= 10 THEN 3 WHEN shot_dist >= 7 THEN 2 WHEN shot_dist >= 4 THEN 1 ELSE 0 END AS dist_bin
  FROM s0),
ball0 AS (SELECT *, CASE WHEN actor_team_id IS NULL THEN NULL WHEN actor_team_id = home_team_id THEN 1e0 ELSE -1e0 END AS side FROM strict),
ball1 AS (SELECT *, CASE WHEN (is_fga AND NOT is_fg3m AND NOT is_fg2m) OR (is_ft_last AND NOT is_ftm) THEN NULL WHEN is_turnover OR is_fg3m OR is_fg2m OR (is_ft_last AND is_ftm) THEN -side WHEN is_def_reb OR is_off_reb OR is_steal THEN side END AS b FROM ball0),
states AS (SELECT *, coalesce(held, 0e0) AS possession, CAST(held IS NOT NULL AS INT) AS poss_known FROM (SELECT *, last_value(b IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY play_number ROWS UNBOUNDED PRECEDING) AS held FROM ball1))"""


def _states(spark, folder):
    return features.possession_state(features.parse_events(plays(spark, folder)), at_most=game_bound(spark, folder))


@query("event_flags", f"""WITH {STRICT} SELECT play_number, is_fga, is_fg3a, is_fg3m, is_fg2a, is_fg2m, is_fta, is_ftm, is_ft_last, shot_dist, shot_family, dist_bin, is_turnover, is_steal, is_def_reb, is_off_reb, is_foul FROM strict""")
def _(spark, folder):
    df = features.parse_events(plays(spark, folder))
    return df.select("play_number", "is_fga", "is_fg3a", "is_fg3m", "is_fg2a", "is_fg2m", "is_fta", "is_ftm", "is_ft_last",
                     "shot_dist", "shot_family", "dist_bin", "is_turnover", "is_steal", "is_def_reb", "is_off_reb", "is_foul")


@query("possession_state", f"WITH {STRICT} SELECT play_number, possession, poss_known FROM states")
def _(spark, folder):
    return _states(spark, folder).select("play_number", "possession", "poss_known")


SEGMENTS = f"""{STRICT},
carried AS (SELECT *, coalesce(lag(possession) OVER (PARTITION BY game_id ORDER BY play_number), 0e0) AS off FROM states),
cut AS (SELECT *, CASE WHEN lag(off) OVER (PARTITION BY game_id ORDER BY play_number) IS DISTINCT FROM off THEN 1 ELSE 0 END AS new FROM carried),
seg AS (SELECT *, CAST(sum(new) OVER (PARTITION BY game_id ORDER BY play_number ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM cut),
ends AS (SELECT game_id, segment, min(off) AS possession, CAST(max_by(home_score, play_number) AS DOUBLE) AS home_end, CAST(max_by(away_score, play_number) AS DOUBLE) AS away_end, max_by(seconds_elapsed, play_number) AS elapsed_end,
  min_by(seconds_left_reg, play_number) AS seconds_left_reg, min_by(period, play_number) AS period FROM seg GROUP BY 1, 2),
starts AS (SELECT *, coalesce(lag(home_end) OVER w, 0e0) AS home_start, coalesce(lag(away_end) OVER w, 0e0) AS away_start, coalesce(lag(elapsed_end) OVER w, 0e0) AS began FROM ends WINDOW w AS (PARTITION BY game_id ORDER BY segment)),
segments AS (SELECT * FROM (SELECT *, home_start - away_start AS margin_start, CASE WHEN possession > 0 THEN home_end - home_start ELSE away_end - away_start END AS points, CASE WHEN possession > 0 THEN away_end - away_start ELSE home_end - home_start END AS opp_points,
  elapsed_end - began AS duration FROM starts) WHERE points BETWEEN 0 AND 4 AND duration BETWEEN 0 AND 60 AND possession <> 0)"""
SEGMENT_COLUMNS = "possession home_end away_end elapsed_end seconds_left_reg home_start away_start margin_start points opp_points duration"


def _segments(spark, folder):
    return box.possession_segments(_states(spark, folder), at_most=game_bound(spark, folder))


@query("possession_segments", shown(f"WITH {SEGMENTS} SELECT * FROM segments", "game_id segment period", SEGMENT_COLUMNS, 5))
def _(spark, folder):
    return rounded(_segments(spark, folder).select("game_id", "segment", "period", *SEGMENT_COLUMNS.split()), 5)


@query("points_distribution", f"""WITH {SEGMENTS}, c AS (SELECT CAST(points AS INT) AS points, count(*) AS n FROM segments GROUP BY 1)
SELECT CAST(g AS INT) AS points, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM c), 6) AS share FROM generate_series(0, 4) t(g) LEFT JOIN c ON g = points""")
def _(spark, folder):
    return rounded(priors.points_distribution(_segments(spark, folder)))


@query("possession_seconds", f"""WITH {SEGMENTS},
e AS (SELECT duration, CASE WHEN seconds_left_reg < 0 THEN NULL WHEN seconds_left_reg < 30 THEN 0 WHEN seconds_left_reg < 60 THEN 1 WHEN seconds_left_reg < 120 THEN 2 WHEN seconds_left_reg < 300 THEN 3 WHEN seconds_left_reg < 720 THEN 4 WHEN seconds_left_reg < 3000 THEN 5 END AS tl,
  CASE WHEN m < -15 THEN 0 WHEN m < -9 THEN 1 WHEN m < -5 THEN 2 WHEN m < -2 THEN 3 WHEN m < 0 THEN 4 WHEN m < 2 THEN 5 WHEN m < 5 THEN 6 WHEN m < 9 THEN 7 WHEN m < 15 THEN 8 ELSE 9 END AS mg
  FROM (SELECT *, CASE WHEN possession > 0 THEN margin_start ELSE -margin_start END AS m FROM segments WHERE period <= 4)),
c AS (SELECT tl, mg, avg(duration) AS mean, count(*) AS n FROM e GROUP BY 1, 2)
SELECT CAST(t AS INT) AS tl, CAST(g AS INT) AS mg, CAST(coalesce(n, 0) AS BIGINT) AS n, round(CASE WHEN n >= 20 THEN mean ELSE (SELECT avg(duration) FROM e) END, 6) AS value
FROM generate_series(0, 5) a(t) CROSS JOIN generate_series(0, 9) b(g) LEFT JOIN c ON t = tl AND g = mg""")
def _(spark, folder):
    return rounded(priors.possession_seconds(_segments(spark, folder), 20))


@query("shot_quality_table", f"""WITH {STRICT}, s AS (SELECT shot_family, CAST(dist_bin AS INT) AS dist_bin, CAST(is_fg3a AS INT) AS is3, CAST(is_fg3m OR is_fg2m AS INT) AS made FROM strict WHERE is_fga),
c AS (SELECT shot_family, dist_bin, is3, avg(made) AS rate, count(*) AS n FROM s GROUP BY 1, 2, 3 HAVING count(*) >= 100), l AS (SELECT is3, avg(made) AS fallback FROM s GROUP BY 1)
SELECT is3, shot_family, dist_bin, round(rate, 6) AS rate, CAST(n AS BIGINT) AS n, round(fallback, 6) AS fallback FROM c JOIN l USING (is3)""")
def _(spark, folder):
    return rounded(priors.shot_quality_table(features.parse_events(plays(spark, folder)), 100))


@query("league_rates", f"""WITH {STRICT} SELECT round(count(*) FILTER (WHERE is_fg3m) / count(*) FILTER (WHERE is_fg3a), 6) AS league_fg3_pct, round(count(*) FILTER (WHERE is_fg2m) / count(*) FILTER (WHERE is_fg2a), 6) AS league_fg2_pct,
 round(count(*) FILTER (WHERE is_ftm) / count(*) FILTER (WHERE is_fta), 6) AS league_ft_pct, CAST(count(*) FILTER (WHERE is_fg3a) AS BIGINT) AS n_prior_fg3a, CAST(count(*) FILTER (WHERE is_foul) AS BIGINT) AS n_fouls FROM strict""")
def _(spark, folder):
    return rounded(priors.league_rates(features.parse_events(plays(spark, folder))))


@query("pace_fit", shown(f"""WITH {SEGMENTS}, {ODDS_SQL}, g AS (SELECT game_id, count(*) AS poss FROM segments GROUP BY 1)
SELECT count(*) AS n, regr_intercept(poss, total_close) AS intercept, regr_slope(poss, total_close) AS slope, corr(poss, total_close) AS corr FROM g JOIN odds o ON g.game_id = o.espn_game_id WHERE total_close IS NOT NULL""",
                         "n", "intercept slope corr"))
def _(spark, folder):
    return rounded(priors.pace_fit(_segments(spark, folder), odds(spark, folder), 10))


# -- prior-only rates ----------------------------------------------------------------------------

RATE_SQL = f"""{PLAYER_BOX},
day AS (SELECT game_date, sum(pts) AS pts, sum(poss_off) AS poss_off, sum(fg3m) AS fg3m, sum(fg3a) AS fg3a, sum(fg2m) AS fg2m, sum(fg2a) AS fg2a, sum(ftm) AS ftm, sum(fta) AS fta FROM player_box GROUP BY 1),
lg AS (SELECT game_date, {', '.join(f"coalesce(nullif({scale} * coalesce(sum({a}) OVER w, 0) / greatest(coalesce(sum({b}) OVER w, 0), 1), 0), {d}) AS {n}" for n, a, b, scale, d in (('lg_pts', 'pts', 'poss_off', '1e2', '110e0'), ('lg_fg3', 'fg3m', 'fg3a', '1e0', '0.36e0'), ('lg_fg2', 'fg2m', 'fg2a', '1e0', '0.52e0'), ('lg_ft', 'ftm', 'fta', '1e0', '0.78e0')))}
  FROM day WINDOW w AS (ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pt AS (SELECT game_id, athlete_id, game_date, is_home, season, CAST(count(*) OVER w AS BIGINT) AS prior_gp, {', '.join(f'coalesce(sum({c}) OVER w, 0) AS {c}' for c in ('pts', 'poss_off', 'minutes', 'pts_gap', *COUNTS))}
  FROM player_box WINDOW w AS (PARTITION BY athlete_id ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT p.*, l.* EXCLUDE (game_date) FROM pt p LEFT JOIN lg l ON p.game_date = l.game_date),
player_rates AS (SELECT game_id, athlete_id, game_date, is_home, season, prior_gp, minutes AS prior_min, poss_off AS prior_poss,
  CASE WHEN ok THEN (100 * pts + 400 * lg_pts * 0.2e0) / (poss_off + 400) END AS pts_per100, CASE WHEN ok THEN 100 * (fga + 0.44e0 * fta + tov) / greatest(poss_off, 1) END AS usage_per100,
  CASE WHEN ok THEN pts / greatest(2 * (fga + 0.44e0 * fta), 1) END AS ts_pct, CASE WHEN ok THEN fg3a / greatest(fga, 1) END AS fg3a_rate, CASE WHEN ok THEN fg2a / greatest(fga, 1) END AS fg2a_rate, CASE WHEN ok THEN fta / greatest(fga, 1) END AS ft_rate,
  CASE WHEN ok THEN 100 * tov / greatest(poss_off, 1) END AS tov_per100, CASE WHEN ok THEN 100 * fouls / greatest(poss_off, 1) END AS foul_per100, CASE WHEN ok THEN 100 * (oreb + dreb) / greatest(poss_off, 1) END AS reb_per100,
  CASE WHEN ok THEN (fg3m + 20 * lg_fg3) / (fg3a + 20) ELSE lg_fg3 END AS fg3_pct, CASE WHEN ok THEN (fg2m + 20 * lg_fg2) / (fg2a + 20) ELSE lg_fg2 END AS fg2_pct, CASE WHEN ok THEN (ftm + 20 * lg_ft) / (fta + 20) ELSE lg_ft END AS ft_pct,
  pts_gap AS prior_pts_missing, CASE WHEN pts + pts_gap <> 0 THEN 100 * pts_gap / (pts + pts_gap) END AS pts_missing_pct FROM (SELECT *, poss_off >= 50 AS ok FROM r))"""
RATE_ROUND = "prior_min prior_poss pts_per100 usage_per100 ts_pct fg3a_rate fg2a_rate ft_rate tov_per100 foul_per100 reb_per100 fg3_pct fg2_pct ft_pct prior_pts_missing pts_missing_pct"


@query("player_rates", shown(f"WITH {RATE_SQL} SELECT * FROM player_rates", "game_id athlete_id game_date is_home season prior_gp", RATE_ROUND, 8))
def _(spark, folder):
    return rounded(rate_plans.player_rates(cut_lineage(_player_box(spark, folder)), at_most=games_count(spark, folder)), 8)


@query("prior_daily_league", shown(f"WITH {RATE_SQL} SELECT * FROM lg", "game_date", "lg_pts lg_fg3 lg_fg2 lg_ft", 4))
def _(spark, folder):
    return rounded(rate_plans.prior_daily_league(_player_box(spark, folder)), 4)


YTD_SUMS = [*rate_plans.TEAM_TOTALS, *[f"opp_{c}" for c in rate_plans.TEAM_TOTALS], *rate_plans.TEAM_EXTRA]


def _side_rates(o, p):
    z = "poss" if not o else "opp_poss"
    return [f"{o}fgm / nullif({o}fga, 0) AS {o}fg_pct", f"{o}fg3m / nullif({o}fg3a, 0) AS {o}fg3_pct", f"{o}ftm / nullif({o}fta, 0) AS {o}ft_pct",
            f"({o}fgm + 0.5e0 * {o}fg3m) / nullif({o}fga, 0) AS {o}efg_pct", f"{o}fg3a / nullif({o}fga, 0) AS {o}fg3a_rate", f"{o}fta / nullif({o}fga, 0) AS {o}ft_rate", f"100 * {o}tov / nullif({z}, 0) AS {o}tov_pct"]


YTD_OUT = [
    "pts / nullif(poss, 0) AS off_ppp", "opp_pts / nullif(opp_poss, 0) AS def_ppp", "pts / nullif(poss, 0) - opp_pts / nullif(opp_poss, 0) AS net_ppp",
    "(nullif(poss, 0) + nullif(opp_poss, 0)) / 2 / nullif(game_seconds / 60, 0) * 48 AS poss_per_48", "sum_poss_sec / nullif(n_poss_sec, 0) AS sec_per_poss", "sum_shot_sec / nullif(n_shot_sec, 0) AS sec_to_first_shot",
    "poss_seg AS poss_segmented", "poss AS poss_formula", "pts_gap AS prior_pts_missing", "100 * pts_gap / nullif(pts + pts_gap, 0) AS pts_missing_pct",
    *_side_rates("", "poss"), *_side_rates("opp_", "opp_poss"),
    "oreb / nullif(oreb + opp_dreb, 0) AS oreb_pct", "dreb / nullif(dreb + opp_oreb, 0) AS dreb_pct", "reb / nullif(reb + opp_reb, 0) AS reb_pct",
    *[f"100 * {c} / nullif(poss, 0) AS off_{c}_per100" for c in rate_plans.PER_100], *[f"100 * opp_{c} / nullif(opp_poss, 0) AS def_{c}_per100" for c in rate_plans.PER_100],
]
YTD_SQL = f"""{TEAM_BOX}, {TIMING.split(BOX_FLAGS + ',')[1]},
joined AS (SELECT b.*, coalesce(t.poss_seg, 0) AS poss_seg, coalesce(t.sum_poss_sec, 0) AS sum_poss_sec, coalesce(t.n_poss_sec, 0) AS n_poss_sec, coalesce(t.sum_shot_sec, 0) AS sum_shot_sec, coalesce(t.n_shot_sec, 0) AS n_shot_sec
  FROM team_box b LEFT JOIN timing t ON b.game_id = t.game_id AND b.team_id = t.team_id),
c AS (SELECT game_id, season, game_date, team, team_id, opponent, opp_team_id, is_home, CAST(count(*) OVER w AS BIGINT) AS games_played, {', '.join(f'CAST(coalesce(sum({s}) OVER w, 0) AS DOUBLE) AS {s}' for s in YTD_SUMS)}
  FROM joined WINDOW w AS (PARTITION BY season, team_id ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ytd AS (SELECT game_id, season, game_date, team, team_id, opponent, opp_team_id, is_home, games_played, {', '.join(YTD_OUT)} FROM c)"""
YTD_NAMES = " ".join(e.rsplit(" AS ", 1)[1] for e in YTD_OUT)


@query("team_ytd", shown(f"WITH {YTD_SQL} SELECT * FROM ytd", "game_id season game_date team team_id opponent opp_team_id is_home games_played", YTD_NAMES, 4))
def _(spark, folder):
    tagged = cut_lineage(_tagged(spark, folder))
    return rounded(rate_plans.team_ytd(box.team_game_box(tagged), box.possession_timing(tagged, at_most=game_bound(spark, folder)), at_most=2 * games_count(spark, folder)), 4)


@query("rapm_gram", f"""WITH {STINTS}, refits AS (SELECT game_date AS d, row_number() OVER (ORDER BY game_date) AS ix FROM (SELECT game_date, row_number() OVER (ORDER BY game_date) AS n, max(game_date) OVER () AS last FROM (SELECT DISTINCT game_date FROM stints)) WHERE (n - 1) % 7 = 0 OR game_date = last),
placed AS (SELECT s.*, (SELECT min(ix) FROM refits WHERE d > s.game_date) AS bucket FROM stints s),
obs AS (SELECT row_number() OVER () AS id, * FROM (SELECT season, bucket, home_lineup AS o, away_lineup AS d, 1 AS h, poss_home AS w, 100 * pts_home AS wy FROM placed WHERE poss_home > 0 AND bucket IS NOT NULL
  UNION ALL SELECT season, bucket, away_lineup, home_lineup, 0, poss_away, 100 * pts_away FROM placed WHERE poss_away > 0 AND bucket IS NOT NULL)),
f AS (SELECT id, season, bucket, w, wy, concat('o', unnest(string_split(o, ','))) AS i FROM obs UNION ALL SELECT id, season, bucket, w, wy, concat('d', unnest(string_split(d, ','))) FROM obs
  UNION ALL SELECT id, season, bucket, w, wy, 'i' FROM obs UNION ALL SELECT id, season, bucket, w, wy, 'h' FROM obs WHERE h = 1)
SELECT season, bucket, i, j, round(v, 4) AS v FROM (SELECT a.season, a.bucket, a.i, b.i AS j, sum(a.w) AS v FROM f a JOIN f b ON a.id = b.id AND a.i <= b.i GROUP BY ALL
  UNION ALL SELECT season, bucket, i, 'y', sum(wy) FROM f GROUP BY ALL)""")
def _(spark, folder):
    stint = cut_lineage(box.stints(_tagged(spark, folder), at_most=game_bound(spark, folder)))
    refits = rate_plans.every_nth_date(stint, "game_date", 7).withColumnRenamed("game_date", "refit_date")
    return rounded(rate_plans.rapm_gram(rate_plans.rapm_observations(stint, rate_plans.index_refits(refits))), 4)


RIDGE, FADE, LEAST_STINTS = 50.0, 0.75, 100


def _ratings_sql(refits: str) -> str:
    """CTEs that end in ``ratings``, from ``stints`` and ``refits`` (a query of dates ``d``): the normal equations solved by elimination."""
    return f"""refit_days AS (SELECT d, row_number() OVER (ORDER BY d) AS ix FROM (SELECT DISTINCT d FROM ({refits}) asked)),
due AS (SELECT d, ix FROM (SELECT d, ix, (SELECT count(*) FROM stints s WHERE s.game_date < d) AS n FROM refit_days) WHERE n >= {LEAST_STINTS}),
newest AS (SELECT d, max(season) AS season FROM due JOIN stints s ON s.game_date < d GROUP BY 1),
obs AS (SELECT row_number() OVER () AS id, * FROM (SELECT season, game_date, home_lineup AS o, away_lineup AS e, 1 AS h, poss_home AS w, 100 * pts_home AS wy FROM stints WHERE poss_home > 0
  UNION ALL SELECT season, game_date, away_lineup, home_lineup, 0, poss_away, 100 * pts_away FROM stints WHERE poss_away > 0)),
named AS (SELECT id, concat('o', unnest(string_split(o, ','))) AS i FROM obs UNION ALL SELECT id, concat('d', unnest(string_split(e, ','))) FROM obs UNION ALL SELECT id, 'i' FROM obs UNION ALL SELECT id, 'h' FROM obs WHERE h = 1),
daily AS (SELECT season, game_date, a.i, b.i AS j, sum(w) AS v FROM obs JOIN named a USING (id) JOIN named b USING (id) GROUP BY ALL UNION ALL SELECT season, game_date, i, 'y', sum(wy) FROM obs JOIN named USING (id) GROUP BY ALL),
summed AS (SELECT n.d, i, j, sum(v * {FADE} ** (n.season - g.season)) AS v FROM newest n JOIN daily g ON g.game_date < n.d GROUP BY ALL),
placed AS (SELECT d, i, row_number() OVER (PARTITION BY d ORDER BY i) AS pos FROM (SELECT DISTINCT d, i FROM summed)),
cells AS (SELECT a.d, a.pos, b.pos AS along, coalesce(m.v, 0) + CASE WHEN a.i = b.i AND a.i NOT IN ('h', 'i') THEN {RIDGE} ELSE 0 END AS v
  FROM placed a JOIN placed b ON a.d = b.d LEFT JOIN summed m ON m.d = a.d AND m.i = a.i AND m.j = b.i
  UNION ALL SELECT a.d, a.pos, 1000000, coalesce(m.v, 0) FROM placed a LEFT JOIN summed m ON m.d = a.d AND m.i = a.i AND m.j = 'y'),
systems AS (SELECT d, count(*) AS n, list(cell_line ORDER BY pos) AS lines FROM (SELECT d, pos, list(CAST(v AS DOUBLE) ORDER BY along) AS cell_line FROM cells GROUP BY 1, 2) GROUP BY 1),
steps_done AS (SELECT d, n, CAST(1 AS BIGINT) AS k, lines FROM systems UNION ALL
  SELECT d, n, k + 1, list_transform(lines, lambda r, i: CASE WHEN i = k THEN unit_row ELSE list_transform(r, lambda x, c: x - r[k] * unit_row[c]) END)
  FROM (SELECT *, list_transform(lines[k], lambda x: x / lines[k][k]) AS unit_row FROM steps_done WHERE k <= n) q),
solved AS (SELECT d, unnest(lines) AS cell_line, generate_subscripts(lines, 1) AS pos FROM steps_done WHERE k = n + 1),
coefficients AS (SELECT d, i, cell_line[len(cell_line)] AS x FROM solved JOIN placed USING (d, pos)),
ratings AS (SELECT d AS refit_date, CAST(i[2:] AS BIGINT) AS athlete_id, coalesce(max(x) FILTER (i[1] = 'o'), 0) AS rapm_off, coalesce(max(x) FILTER (i[1] = 'd'), 0) AS rapm_def
  FROM coefficients WHERE len(i) > 1 GROUP BY 1, 2)"""


@query("rapm", shown(f"""WITH RECURSIVE {STINTS}, {_ratings_sql("SELECT game_date AS d FROM (SELECT game_date, row_number() OVER (ORDER BY game_date) AS n, max(game_date) OVER () AS last FROM (SELECT DISTINCT game_date FROM stints)) WHERE (n - 1) % 7 = 0 OR game_date = last")}
SELECT refit_date, athlete_id, rapm_off, rapm_def, rapm_off - rapm_def AS rapm_net FROM ratings""", "refit_date athlete_id", "rapm_off rapm_def rapm_net", 4))
def _(spark, folder):
    stint = cut_lineage(box.stints(_tagged(spark, folder), at_most=game_bound(spark, folder)))
    refits = rate_plans.every_nth_date(stint, "game_date", 7).withColumnRenamed("game_date", "refit_date")
    return rounded(rate_plans.rapm(stint, refits, ridge_lambda=RIDGE, season_decay=FADE, min_stints=LEAST_STINTS), 4)


RATE_BUILD = f"""WITH RECURSIVE {RATE_SQL},
dates AS (SELECT season, game_date, row_number() OVER (PARTITION BY season ORDER BY game_date) AS n, max(game_date) OVER (PARTITION BY season) AS last FROM (SELECT DISTINCT season, game_date FROM player_rates)),
refits AS (SELECT season, game_date AS d FROM dates WHERE (n - 1) % 7 = 0 OR game_date = last),
versions AS (SELECT p.*, coalesce((SELECT max(d) FROM refits r WHERE r.season = p.season AND d <= p.game_date), (SELECT min(d) FROM refits r WHERE r.season = p.season)) AS refit_date FROM player_rates p),
{_ratings_sql("SELECT d FROM refits")}
SELECT game_id, v.athlete_id, season, prior_gp, prior_min, prior_poss, v.refit_date, round(rapm_off, 4) AS rapm_off, round(rapm_def, 4) AS rapm_def, round(rapm_off - rapm_def, 4) AS rapm_net
FROM versions v LEFT JOIN ratings r ON v.refit_date = r.refit_date AND v.athlete_id = r.athlete_id"""


@query("rate_build", shown(RATE_BUILD, "game_id athlete_id season prior_gp refit_date", "prior_min prior_poss rapm_off rapm_def rapm_net", 8))
def _(spark, folder):
    tagged = cut_lineage(_tagged(spark, folder))
    stint = cut_lineage(box.stints(tagged, at_most=game_bound(spark, folder)))
    built = rate_plans.rate_build(stint, cut_lineage(box.player_game_box(tagged, stint)), [2022, 2023, 2024], at_most=games_count(spark, folder),
                                  ridge_lambda=RIDGE, season_decay=FADE, min_stints=LEAST_STINTS)
    ratings = [F.round(c, 4).alias(c) for c in ("rapm_off", "rapm_def", "rapm_net")]
    return rounded(built.select("game_id", "athlete_id", "season", "prior_gp", "refit_date", "prior_min", "prior_poss", *ratings), 8)


# -- per-event features --------------------------------------------------------------------------

CLOCK_SQL = """clocked AS (SELECT p.*, o.* EXCLUDE (game_id, espn_game_id), CASE WHEN period <= 4 THEN seconds_left_reg ELSE pc_seconds_left END AS seconds_left_horizon,
  greatest(0, least(1, CASE WHEN period <= 4 THEN seconds_left_reg / 2880 ELSE pc_seconds_left / 300 END)) AS frac_left FROM states p LEFT JOIN odds o ON p.game_id = o.espn_game_id)"""


def _clocked(spark, folder):
    return features.clock_features(features.parse_events(plays(spark, folder))).join(
        odds(spark, folder).withColumnRenamed("espn_game_id", "game_id"), "game_id", "left")


@query("clock_features", f"""WITH {STRICT}, {ODDS_SQL}, {CLOCK_SQL} SELECT play_number, CAST(period > 4 AS INT) AS is_ot, greatest(0, period - 4) AS ot_number, CASE WHEN period <= 4 THEN 720e0 ELSE 300e0 END AS period_len,
 round(seconds_left_horizon, 8) AS seconds_left_horizon, round(frac_left, 8) AS frac_left, round(1 - frac_left, 8) AS frac_elapsed FROM clocked""")
def _(spark, folder):
    return rounded(_clocked(spark, folder).select("play_number", "is_ot", "ot_number", "period_len", "seconds_left_horizon", "frac_left", "frac_elapsed"), 8)


PREGAME = ["logit_close"] + [f"{s}_p{t}" for t in ("0p5", "0p75", "1p0", "1p25") for s in ("exp_margin_left", "logit_close", "total_left")] + [
    "exp_margin_left", "line_surprise", "line_surprise_rate", "exp_margin_x_surprise_rate", "exp_margin_left_x_surprise", "margin_plus_exp_left", "exp_margin_left_per_sec"]
PREGAME_SQL = f"""pre0 AS (SELECT *, ln(q / (1 - q)) AS logit_close, -home_spread_close AS ex FROM (SELECT *, greatest(1e-4, least(1 - 1e-4, p_home_close)) AS q FROM clocked WHERE p_home_close IS NOT NULL) UNION ALL BY NAME SELECT *, NULL AS q, NULL AS logit_close, -home_spread_close AS ex FROM clocked WHERE p_home_close IS NULL),
pre1 AS (SELECT *, {', '.join(f"ex * pow(frac_left, {k}) AS exp_margin_left_p{t}, logit_close * pow(frac_left, {k}) AS logit_close_p{t}, total_close * pow(frac_left, {k}) AS total_left_p{t}" for k, t in ((0.5, '0p5'), (0.75, '0p75'), (1.0, '1p0'), (1.25, '1p25')))},
  ex * pow(frac_left, 0.8) AS exp_margin_left, score_margin - ex * (1 - pow(frac_left, 0.8)) AS line_surprise FROM pre0),
pre2 AS (SELECT *, CASE WHEN line_surprise IS NOT NULL THEN greatest(-30, least(30, line_surprise / greatest(0.15e0, least(1, 1 - frac_left)))) END AS line_surprise_rate FROM pre1),
pregame AS (SELECT *, ex * line_surprise_rate AS exp_margin_x_surprise_rate, exp_margin_left * line_surprise AS exp_margin_left_x_surprise, score_margin + exp_margin_left AS margin_plus_exp_left, exp_margin_left / sqrt(greatest(seconds_left_horizon, 1)) AS exp_margin_left_per_sec FROM pre2)"""


@query("pregame_features", shown(f"WITH {STRICT}, {ODDS_SQL}, {CLOCK_SQL}, {PREGAME_SQL} SELECT * FROM pregame", "play_number", " ".join(PREGAME), 8))
def _(spark, folder):
    return rounded(features.pregame_features(_clocked(spark, folder), 0.8).select("play_number", *PREGAME), 8)


LUCK = "fg3_luck_home_pts fg3_luck_away_pts fg3_luck_diff_pts ft_luck_diff_pts fg2_luck_diff_pts luck_diff_pts margin_ex_luck fg3_luck_x_fracleft luck_x_fracleft fta_diff fta_diff_x_fracleft foul_diff fg3a_diff fga_total"


def _side(flag, weight="1e0"):
    return [f"sum(CASE WHEN {flag} AND coalesce(actor_team_id = {s}_team_id, false) THEN {weight} ELSE 0 END) OVER w" for s in ("home", "away")]


def _luck_sql():
    h = {n: _side(f, e) for n, f, e in (("fg3a", "is_fg3a", "1e0"), ("fg3m", "is_fg3m", "1e0"), ("fg2a", "is_fg2a", "1e0"), ("fg2m", "is_fg2m", "1e0"), ("fta", "is_fta", "1e0"), ("ftm", "is_ftm", "1e0"), ("foul", "is_foul", "1e0"),
                                        ("x3", "is_fg3a", "e3"), ("x2", "is_fg2a", "e2"), ("xft", "is_fta", "eft"))}
    cols = ", ".join(f"{h[n][0]} AS h_{n}, {h[n][1]} AS a_{n}" for n in h)
    return f"""shoot AS (SELECT c.*, r.prior_min, r.w * coalesce(r.fg3_pct, 0.36e0) + (1 - coalesce(r.w, 0)) * 0.36e0 AS z3, coalesce(r.w, 0) AS wt, r.fg3_pct, r.fg2_pct, r.ft_pct FROM clocked c LEFT JOIN (SELECT *, greatest(coalesce(prior_min, 0), 0) / (greatest(coalesce(prior_min, 0), 0) + 500) AS w FROM rates) r ON c.game_id = r.game_id AND c.athlete_id_1 = r.athlete_id),
shoot2 AS (SELECT *, wt * coalesce(fg3_pct, 0.36e0) + (1 - wt) * 0.36e0 AS e3, wt * coalesce(fg2_pct, 0.52e0) + (1 - wt) * 0.52e0 AS e2, wt * coalesce(ft_pct, 0.78e0) + (1 - wt) * 0.78e0 AS eft FROM shoot),
sums AS (SELECT *, {cols} FROM shoot2 WINDOW w AS (PARTITION BY game_id ORDER BY play_number ROWS UNBOUNDED PRECEDING)),
luck0 AS (SELECT *, 3 * (h_fg3m - h_x3) AS fg3_luck_home_pts, 3 * (a_fg3m - a_x3) AS fg3_luck_away_pts, 3 * (h_fg3m - h_x3) - 3 * (a_fg3m - a_x3) AS fg3_luck_diff_pts, (h_ftm - h_xft) - (a_ftm - a_xft) AS ft_luck_diff_pts, 2 * ((h_fg2m - h_x2) - (a_fg2m - a_x2)) AS fg2_luck_diff_pts,
  h_fta - a_fta AS fta_diff, h_foul - a_foul AS foul_diff, h_fg3a - a_fg3a AS fg3a_diff, h_fg3a + a_fg3a + h_fg2a + a_fg2a AS fga_total FROM sums),
luck AS (SELECT *, fg3_luck_diff_pts + ft_luck_diff_pts + fg2_luck_diff_pts AS luck_diff_pts, score_margin - (fg3_luck_diff_pts + ft_luck_diff_pts + fg2_luck_diff_pts) AS margin_ex_luck, fg3_luck_diff_pts * frac_left AS fg3_luck_x_fracleft,
  (fg3_luck_diff_pts + ft_luck_diff_pts + fg2_luck_diff_pts) * frac_left AS luck_x_fracleft, fta_diff * frac_left AS fta_diff_x_fracleft FROM luck0)"""


@query("luck_features", shown(f"WITH {STRICT}, {ODDS_SQL}, {RATES_SQL}, {CLOCK_SQL}, {_luck_sql()} SELECT * FROM luck", "play_number", LUCK, 8))
def _(spark, folder):
    shooter = rates(spark, folder).withColumnRenamed("athlete_id", "shooter_id").select("game_id", "shooter_id", "fg3_pct", "fg2_pct", "ft_pct", "prior_min")
    df = _clocked(spark, folder).withColumn("shooter_id", F.col("athlete_id_1")).join(shooter, ["game_id", "shooter_id"], "left")
    df = features.expected_shooting(df, {"fg3_pct": 0.36, "fg2_pct": 0.52, "ft_pct": 0.78})
    o = features.luck_features(carry_possession(ordered(
        df.withColumn("_ball", possession_rule()), ["game_id"], ["play_number"], at_most=game_bound(spark, folder))))
    return rounded(o.result().select("play_number", *LUCK.split()), 8)


@query("state_features", shown(f"""WITH {STRICT}, {ODDS_SQL}, {CLOCK_SQL} SELECT play_number, home_score + away_score AS pts_total, CASE WHEN 1 - frac_left > 0.02 THEN (home_score + away_score) / (total_close * (1 - frac_left)) END AS pace_ratio,
 score_margin * frac_left AS margin_x_fracleft, CASE WHEN seconds_left_horizon > 0 THEN score_margin / sqrt(greatest(seconds_left_horizon, 1)) ELSE score_margin END AS margin_per_sec_left, home_team_fouls_period - away_team_fouls_period AS team_foul_diff_period FROM clocked""",
                               "play_number pts_total team_foul_diff_period", "pace_ratio margin_x_fracleft margin_per_sec_left", 8))
def _(spark, folder):
    return rounded(features.state_features(_clocked(spark, folder)).select(
        "play_number", "pts_total", "team_foul_diff_period", "pace_ratio", "margin_x_fracleft", "margin_per_sec_left"), 8)


AVAILABLE_SQL = """available AS (SELECT DISTINCT game_id, team_id, athlete_id FROM rosters WHERE team_id IS NOT NULL AND NOT (coalesce(did_not_play, false) AND NOT coalesce(reason ILIKE '%coach%', true)))"""


@query("available_players", f"WITH {ROSTERS_SQL}, {AVAILABLE_SQL} SELECT * FROM available")
def _(spark, folder):
    return features.available_players(rosters(spark, folder))


LINEUP = "oncourt_rapm_diff rest_rapm_diff oncourt_edge home_oncourt_edge away_oncourt_edge rest_rapm_diff_left rest_rapm_resid"
LINEUP_SQL = f"""{AVAILABLE_SQL},
base AS (SELECT game_id, athlete_id, coalesce(rapm_net, 0) AS v, CASE WHEN prior_gp > 0 THEN coalesce(prior_min, 0) / prior_gp ELSE 0 END AS mpg FROM rates),
sides AS (SELECT game_id, max(home_team_id) AS h, max(away_team_id) AS a, max(home_spread_close) AS sp FROM clocked GROUP BY 1),
placed AS (SELECT s.game_id, CASE WHEN av.team_id = s.h THEN 'home' WHEN av.team_id = s.a THEN 'away' END AS side, coalesce(b.mpg, 0) AS w, coalesce(b.v, 0) AS v FROM available av JOIN sides s ON av.game_id = s.game_id LEFT JOIN base b ON av.game_id = b.game_id AND av.athlete_id = b.athlete_id),
rest AS (SELECT s.game_id, -sp AS ex, sum(CASE WHEN side = 'home' THEN w * v END) / nullif(sum(CASE WHEN side = 'home' THEN w END), 0) * 5 AS hr, sum(CASE WHEN side = 'away' THEN w * v END) / nullif(sum(CASE WHEN side = 'away' THEN w END), 0) * 5 AS ar FROM sides s LEFT JOIN placed p ON s.game_id = p.game_id GROUP BY s.game_id, sp),
fit AS (SELECT regr_slope(hr - ar, ex) AS sl, regr_intercept(hr - ar, ex) AS ic FROM rest),
ids AS (SELECT DISTINCT game_id, home_lineup AS l FROM clocked UNION SELECT DISTINCT game_id, away_lineup FROM clocked),
lv AS (SELECT i.game_id, i.l, sum(b.v) AS v FROM (SELECT game_id, l, CAST(unnest(string_split(l, ',')) AS BIGINT) AS athlete_id FROM ids) i LEFT JOIN base b ON i.game_id = b.game_id AND i.athlete_id = b.athlete_id GROUP BY 1, 2),
line AS (SELECT c.play_number, frac_left, x.v - y.v AS oncourt_rapm_diff, hr - ar AS rest_rapm_diff, (x.v - y.v) - (hr - ar) AS oncourt_edge, x.v - hr AS home_oncourt_edge, y.v - ar AS away_oncourt_edge, (hr - ar) * frac_left AS rest_rapm_diff_left, (hr - ar) - (ic + sl * ex) AS rest_rapm_resid
  FROM clocked c LEFT JOIN rest r ON c.game_id = r.game_id LEFT JOIN lv x ON c.game_id = x.game_id AND c.home_lineup = x.l LEFT JOIN lv y ON c.game_id = y.game_id AND c.away_lineup = y.l, fit)"""


@query("lineup_features", shown(f"WITH {STRICT}, {ODDS_SQL}, {RATES_SQL}, {ROSTERS_SQL}, {CLOCK_SQL}, {LINEUP_SQL} SELECT * FROM line", "play_number", LINEUP, 5))
def _(spark, folder):
    out = features.lineup_features(_clocked(spark, folder), rates(spark, folder), features.available_players(rosters(spark, folder)), 10)
    return rounded(out.select("play_number", *LINEUP.split()), 5)
