"""Scalar expressions over events, orders, pages, documents and a tape made from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from playtape.fixed_values import EXCHANGE_ALIASES, EXCHANGE_CODES, TAPE_ALIASES
from playtape.functions import clock, numeric, text
from playtape.plans import tape as tape_plan
from playtape.operators.filters import thin_groups, value_counts
from playtape.operators.quantiles import describe
from playtape.workloads.base import PLAYS_SQL, plays, query, rounded, shown, table
from playtape.workloads.walk_twin import FOULS_SQL, walk_sql


def _events(spark, folder):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return table(spark, folder, "events").withColumn("k", k)


K = "(SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)"


@query("clock_seconds", f"""SELECT event_id, CASE WHEN k % 10 = 9 OR k % 10 = 8 THEN NULL ELSE round(k % 12 * 60 + (k % 60) + (k % 10) / 10.0, 4) END AS seconds FROM {K}""")
def _(spark, folder):
    k = F.col("k")
    face = F.concat((k % 12).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("."), (k % 10).cast("string"))
    face = F.when(k % 10 == 9, "half").when(k % 10 == 8, "1:x").otherwise(face)
    return rounded(_events(spark, folder).select("event_id", clock.clock_seconds(face).alias("seconds")), 4)


@query("period_clock", f"""SELECT event_id, CASE WHEN p <= 4 THEN (p - 1) * 720 ELSE 2880 + (p - 5) * 300 END AS start, CASE WHEN p <= 4 THEN 720 ELSE 300 END AS length,
  CASE WHEN p <= 4 THEN (p - 1) * 720 + 720 - k ELSE 2880 + (p - 5) * 300 + 300 - k END AS elapsed, 2880 - CASE WHEN p <= 4 THEN (p - 1) * 720 + 720 - k ELSE 2880 + (p - 5) * 300 + 300 - k END AS left_reg
  FROM (SELECT *, 1 + event_id % 6 AS p FROM {K})""")
def _(spark, folder):
    p, k = 1 + F.col("event_id") % 6, F.col("k")
    elapsed = clock.seconds_elapsed(p, k)
    return _events(spark, folder).select(
        "event_id", clock.period_start(p).alias("start"), clock.period_length(p).alias("length"), elapsed.alias("elapsed"), clock.regulation_left(elapsed).alias("left_reg"))


@query("whole_second", "SELECT event_id, CAST(round_even(epoch_us(ts) / 1e6, 0) AS BIGINT) AS second FROM events")
def _(spark, folder):
    return _events(spark, folder).select("event_id", clock.whole_second(F.col("ts").cast("timestamp")).alias("second"))


@query("instant", f"""SELECT event_id, CASE k % 4 WHEN 0 THEN date_trunc('minute', ts) + INTERVAL 5 HOUR WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS at FROM {K}""")
def _(spark, folder):
    ts, k = F.col("ts"), F.col("k")
    stamp = F.when(k % 4 == 0, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm"), F.lit("-05:00"))).when(
        k % 4 == 1, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(
        k % 4 == 2, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise("soon")
    return _events(spark, folder).select("event_id", clock.instant(stamp).cast("timestamp_ntz").alias("at"))


@query("date_labels", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN o_orderkey % 6 + 1 <= 4 THEN concat('Q', o_orderkey % 6 + 1) ELSE 'OT' END AS quarter FROM orders")
def _(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", clock.month_label(F.col("o_orderdate")).alias("month"), clock.quarter_label(F.col("o_orderkey") % 6 + 1).alias("quarter"))


@query("american_odds", shown("""SELECT o_orderkey, ph / (ph + pa) AS p_home, ph + pa - 1 AS overround FROM (SELECT o_orderkey, CASE WHEN h < 0 THEN -h / (-h + 100.0) ELSE 100.0 / (h + 100.0) END AS ph, CASE WHEN a < 0 THEN -a / (-a + 100.0) ELSE 100.0 / (a + 100.0) END AS pa
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -100 - o_orderkey % 300 ELSE 100 + o_orderkey % 300 END AS h, CASE WHEN o_orderkey % 2 = 0 THEN 100 + o_orderkey % 250 ELSE -105 - o_orderkey % 250 END AS a FROM orders))""", "o_orderkey", "p_home overround"))
def _(spark, folder):
    k = F.col("o_orderkey")
    h = F.when(k % 2 == 0, -100 - k % 300).otherwise(100 + k % 300)
    a = F.when(k % 2 == 0, 100 + k % 250).otherwise(-105 - k % 250)
    p, over = numeric.devigged(numeric.american_probability(h), numeric.american_probability(a))
    return rounded(table(spark, folder, "orders").select("o_orderkey", p.alias("p_home"), over.alias("overround")))


@query("logit_sigmoid", shown("SELECT o_orderkey, ln(q / (1 - q)) AS z, q / 1 AS p FROM (SELECT o_orderkey, greatest(1e-4, least(1 - 1e-4, o_totalprice / 500000)) AS q FROM orders)", "o_orderkey", "z p", 8))
def _(spark, folder):
    z = numeric.logit(F.col("o_totalprice") / 500000, 1e-4)
    return rounded(table(spark, folder, "orders").select("o_orderkey", z.alias("z"), numeric.sigmoid(z).alias("p")), 8)


@query("power_decay", shown("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice * pow(l_quantity / 50, 0.5) AS d0p5, l_extendedprice * pow(l_quantity / 50, 0.75) AS d0p75, l_extendedprice * pow(l_quantity / 50, 1.25) AS d1p25 FROM lineitem",
                            "l_orderkey l_linenumber l_suppkey l_partkey l_quantity", "d0p5 d0p75 d1p25", 4))
def _(spark, folder):
    x, f = F.col("l_extendedprice"), F.col("l_quantity") / 50
    return rounded(table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", numeric.decayed(x, f, 0.5).alias("d0p5"), numeric.decayed(x, f, 0.75).alias("d0p75"), numeric.decayed(x, f, 1.25).alias("d1p25")), 4)


@query("season_weight", shown("SELECT o_orderkey, pow(0.75, (SELECT max(extract(year FROM o_orderdate)) FROM orders) - extract(year FROM o_orderdate)) AS w FROM orders", "o_orderkey", "w"))
def _(spark, folder):
    o = table(spark, folder, "orders")
    newest = o.agg(F.max(F.year("o_orderdate")).alias("m")).scalar()
    return rounded(o.select("o_orderkey", numeric.season_weight(F.year("o_orderdate"), newest, 0.75).alias("w")))


@query("finite_or", f"""SELECT event_id, CASE k % 4 WHEN 0 THEN value WHEN 1 THEN 0.0 WHEN 2 THEN 8.0 ELSE -8.0 END AS v FROM {K}""")
def _(spark, folder):
    k = F.col("k") % 4
    x = F.when(k == 0, F.col("value")).when(k == 1, float("nan")).when(k == 2, float("inf")).otherwise(float("-inf"))
    return _events(spark, folder).select("event_id", numeric.finite_or(x, 0.0, 8.0, -8.0).alias("v"))


@query("taker_fee", shown("SELECT o_orderkey, ceil(0.07e0 * (1 + o_orderkey % 300) * p * (1 - p) * 100) / 100 AS fee FROM (SELECT o_orderkey, (o_custkey % 97 + 1) / 1e2 AS p FROM orders)", "o_orderkey", "fee"))
def _(spark, folder):
    p = (F.col("o_custkey") % 97 + 1) / 100.0
    return rounded(table(spark, folder, "orders").select("o_orderkey", numeric.taker_fee((1 + F.col("o_orderkey") % 300).cast("double"), p).alias("fee")))


@query("cut_buckets", """SELECT o_orderkey, CASE WHEN e < 0.02 THEN NULL WHEN e < 0.03 THEN '2-3%' WHEN e < 0.05 THEN '3-5%' WHEN e < 0.075 THEN '5-7.5%' WHEN e < 0.1 THEN '7.5-10%' WHEN e < 0.15 THEN '10-15%' WHEN e < 1 THEN '15%+' END AS edge_bucket,
 CASE WHEN m <= -999 THEN NULL WHEN m <= -14.5 THEN 'trail 15+' WHEN m <= -9.5 THEN 'trail 10-14' WHEN m <= -4.5 THEN 'trail 5-9' WHEN m <= -0.5 THEN 'trail 1-4' WHEN m <= 0.5 THEN 'tied' WHEN m <= 4.5 THEN 'lead 1-4' WHEN m <= 9.5 THEN 'lead 5-9' WHEN m <= 14.5 THEN 'lead 10-14' ELSE 'lead 15+' END AS margin_bucket
 FROM (SELECT o_orderkey, o_custkey % 200 / 1e3 AS e, o_orderkey % 41 - 20 AS m FROM orders)""")
def _(spark, folder):
    from playtape.fixed_values import EDGE_EDGES, EDGE_LABELS, LEAD_EDGES, LEAD_LABELS
    return table(spark, folder, "orders").select(
        "o_orderkey", numeric.bucket_left(F.col("o_custkey") % 200 / 1000.0, EDGE_EDGES, EDGE_LABELS).alias("edge_bucket"),
        numeric.bucket_right(F.col("o_orderkey") % 41 - 20, LEAD_EDGES, LEAD_LABELS).alias("margin_bucket"))


@query("document_flags", """SELECT lang, CAST(count(*) FILTER (WHERE regexp_matches(text, '(?i)\\bthe\\b')) AS BIGINT) AS the_docs, CAST(count(*) FILTER (WHERE starts_with(text, 'T')) AS BIGINT) AS t_docs,
 CAST(count(*) FILTER (WHERE regexp_matches(text, '(?i)license|copyright')) AS BIGINT) AS license_docs FROM documents GROUP BY lang""")
def _(spark, folder):
    t = F.col("text")
    return table(spark, folder, "documents").groupBy("lang").agg(
        F.count_if(text.has(t, r"\bthe\b")).alias("the_docs"), F.count_if(t.startswith("T")).alias("t_docs"),
        F.count_if(text.any_word(t, ["license", "copyright"])).alias("license_docs"))


@query("extract_numbers", """SELECT page_id, TRY_CAST(nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') AS INT) AS page, TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS INT) AS item FROM pages""")
def _(spark, folder):
    u = F.col("url")
    return table(spark, folder, "pages").select("page_id", text.extract_number(u, "page=([0-9]+)").alias("page"), text.extract_number(u, "/([0-9]+)").alias("item"))


@query("foul_class", f"""WITH {PLAYS_SQL} SELECT play_number, CASE WHEN type_text IN ('Shooting Foul', 'Personal Foul') THEN 'team and personal' WHEN type_text = 'Technical Foul' THEN 'technical' ELSE 'unrecognised' END AS class FROM plays WHERE type_text LIKE '%Foul%'""")
def _(spark, folder):
    return plays(spark, folder).where(F.col("type_text").contains("Foul")).select("play_number", text.foul_class(F.col("type_text")).alias("class"))


@query("label_audit", f"""WITH {PLAYS_SQL} SELECT DISTINCT type_text, CASE WHEN type_text IN ('Shooting Foul', 'Personal Foul') THEN 'team and personal' WHEN type_text = 'Technical Foul' THEN 'technical' ELSE 'unrecognised' END AS class FROM plays WHERE type_text ILIKE '%foul%' OR type_text ILIKE '%technical%'""")
def _(spark, folder):
    from playtape.plans.reports import label_audit
    return label_audit(plays(spark, folder))


@query("substitution_direction", f"""WITH {PLAYS_SQL} SELECT play_number, CASE WHEN athlete_id_1 IS NOT NULL AND athlete_id_2 IS NOT NULL THEN athlete_id_1 WHEN coalesce(text LIKE 'enters the game for%', false) THEN NULL ELSE coalesce(athlete_id_1, athlete_id_2) END AS entering,
 CASE WHEN athlete_id_1 IS NOT NULL AND athlete_id_2 IS NOT NULL THEN athlete_id_2 WHEN coalesce(text LIKE 'enters the game for%', false) THEN coalesce(athlete_id_1, athlete_id_2) END AS leaving FROM plays WHERE type_text = 'Substitution'""")
def _(spark, folder):
    entering, leaving = text.substitution_direction(F.col("athlete_id_1"), F.col("athlete_id_2"), F.col("text"))
    return plays(spark, folder).where("type_text = 'Substitution'").select("play_number", entering.alias("entering"), leaving.alias("leaving"))


@query("period_openers", f"""WITH {PLAYS_SQL}, sides AS (SELECT DISTINCT game_id, athlete_id_1 AS athlete_id, CASE WHEN athlete_id_1 % 2 = 0 THEN 'home' ELSE 'away' END AS side FROM plays WHERE athlete_id_1 IS NOT NULL),
sub AS (SELECT *, CASE WHEN athlete_id_1 IS NOT NULL AND athlete_id_2 IS NOT NULL THEN athlete_id_1 WHEN coalesce(text LIKE 'enters the game for%', false) THEN NULL ELSE coalesce(athlete_id_1, athlete_id_2) END AS ent,
  CASE WHEN athlete_id_1 IS NOT NULL AND athlete_id_2 IS NOT NULL THEN athlete_id_2 WHEN coalesce(text LIKE 'enters the game for%', false) THEN coalesce(athlete_id_1, athlete_id_2) END AS lea FROM plays WHERE type_text = 'Substitution'),
seen AS (SELECT game_id, period, play_number, lea AS a, 0 AS kind FROM sub UNION ALL SELECT game_id, period, play_number, athlete_id_1, 0 FROM plays WHERE type_text <> 'Substitution' UNION ALL SELECT game_id, period, play_number, athlete_id_2, 0 FROM plays WHERE type_text <> 'Substitution'
  UNION ALL SELECT game_id, period, play_number, ent, 1 FROM sub),
f AS (SELECT game_id, period, a, min(CASE WHEN kind = 0 THEN play_number END) AS touch, min(CASE WHEN kind = 1 THEN play_number END) AS entry FROM seen WHERE a IS NOT NULL GROUP BY 1, 2, 3)
SELECT f.game_id, period, side, a AS athlete_id FROM f JOIN sides s ON f.game_id = s.game_id AND f.a = s.athlete_id WHERE touch IS NOT NULL AND (entry IS NULL OR touch <= entry)""")
def _(spark, folder):
    from playtape.plans.lineups import period_openers
    p = plays(spark, folder)
    side = F.when(F.col("athlete_id_1") % 2 == 0, "home").otherwise("away")
    sides = p.where(F.col("athlete_id_1").isNotNull()).select("game_id", F.col("athlete_id_1").alias("athlete_id"), side.alias("side")).distinct()
    return period_openers(p, sides)


@query("resolve_lineups", f"""WITH RECURSIVE {PLAYS_SQL}, {walk_sql('plays')}, {FOULS_SQL}
SELECT play_number, home_lineup, away_lineup, lineup_ok, coalesce(player_fouls, '') AS player_fouls FROM lineups LEFT JOIN tally USING (play_number)""")
def _(spark, folder):
    from playtape.plans.lineups import resolve_lineups
    from playtape.workloads.base import rosters
    p = plays(spark, folder).withColumn("team_id", F.col("actor_team_id")).drop("home_lineup", "away_lineup", "lineup_ok")
    out = resolve_lineups(p, rosters(spark, folder))
    return out.select("play_number", "home_lineup", "away_lineup", "lineup_ok", "player_fouls")


@query("array_tools", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS suppliers, CAST(count(DISTINCT l_suppkey) AS INT) AS size FROM lineitem GROUP BY l_orderkey")
def _(spark, folder):
    sup = F.array_sort(F.collect_set("l_suppkey"))
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_join(sup.cast("array<string>"), ",").alias("suppliers"), F.size(sup).alias("size"))


@query("map_and_json", f"SELECT event_id, k, CASE WHEN k % 2 = 0 THEN k * 2 END AS doubled FROM {K}")
def _(spark, folder):
    parsed = F.from_json("props", "k int")["k"]
    pairs = F.create_map(F.lit("even"), F.when(parsed % 2 == 0, parsed * 2))
    return table(spark, folder, "events").select("event_id", parsed.alias("k"), F.element_at(pairs, "even").alias("doubled"))


# -- a tape made from events ---------------------------------------------------------------------

_ALIAS_SQL = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EXCHANGE_ALIASES.items())
_CODES_SQL = ", ".join(f"'{c}'" for c in EXCHANGE_CODES)
_TAPE_SQL = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TAPE_ALIASES.items())
_PLAIN = ["NYK", "SAS", "GS", "LAL", "BOS", "NO", "UTAH", "WSH", "XXX", "PHX"]


def _ticker(k):
    """Ticker text per event: away and home from a short list, some unknown, some with a bad date."""
    codes = F.array(*[F.lit(c) for c in _PLAIN])
    away, home = F.get(codes, k % 10), F.get(codes, (k + 1 + k % 3) % 10)
    yes = F.when(k % 4 == 0, away).otherwise(home)
    day = F.when(k % 23 == 0, F.lit("25FEB30")).otherwise(F.concat(F.lit("25"), F.get(F.array(*[F.lit(m) for m in ("OCT", "NOV", "DEC", "JAN", "FEB")]), k % 5), F.lpad((1 + k % 28).cast("string"), 2, "0")))
    return F.concat(F.lit("SERIES-"), day, away, home, F.lit("-"), yes)


def _norm(x):
    return f"CASE WHEN (CASE {x} {_ALIAS_SQL} ELSE {x} END) IN ({_CODES_SQL}) THEN (CASE {x} {_ALIAS_SQL} ELSE {x} END) END"


_LIST = "[" + ", ".join(f"'{c}'" for c in _PLAIN) + "]"
TICKERS = f"""codes AS (SELECT *, {_LIST}[1 + k % 10] AS a0, {_LIST}[1 + (k + 1 + k % 3) % 10] AS h0 FROM {K}),
dated AS (SELECT *, CASE WHEN k % 4 = 0 THEN a0 ELSE h0 END AS y0, concat(a0, h0) AS blob, CASE WHEN k % 23 = 0 THEN NULL ELSE TRY_CAST(concat('2025-', ['10', '11', '12', '01', '02'][1 + k % 5], '-', lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0')) AS DATE) END AS day FROM codes),
cuts AS (SELECT event_id, blob, unnest(generate_series(2, length(blob) - 2)) AS i FROM dated),
split AS (SELECT event_id, min(a) AS away, min(h) AS home FROM (SELECT event_id, {_norm('blob[:i]')} AS a, {_norm('blob[i+1:]')} AS h FROM cuts) WHERE a IS NOT NULL AND h IS NOT NULL GROUP BY event_id HAVING count(*) = 1),
parsed AS (SELECT d.*, {_norm('y0')} AS yes, s.away, s.home FROM dated d LEFT JOIN split s ON d.event_id = s.event_id),
tickers AS (SELECT *, day IS NOT NULL AND yes IS NOT NULL AND (yes = away OR yes = home) IS TRUE AS ok FROM parsed)"""


@query("parse_ticker", f"""WITH {TICKERS} SELECT event_id, CASE WHEN ok THEN day END AS game_date, CASE WHEN ok THEN away END AS away_team, CASE WHEN ok THEN home END AS home_team, CASE WHEN ok THEN CAST(yes = home AS INT) END AS is_home_yes FROM tickers""")
def _(spark, folder):
    df = _events(spark, folder).select("event_id", _ticker(F.col("k")).alias("ticker"))
    return text.parse_ticker(df, "ticker").drop("ticker")


@query("split_team_blob", f"WITH {TICKERS} SELECT d.event_id, s.away, s.home FROM dated d LEFT JOIN split s ON d.event_id = s.event_id")
def _(spark, folder):
    t = F.regexp_extract(_ticker(F.col("k")), text.TICKER, 5)
    df = _events(spark, folder).select("event_id", text.split_team_blob(t).alias("t"))
    return df.select("event_id", F.col("t.away").alias("away"), F.col("t.home").alias("home"))


@query("tape_team", f"SELECT event_id, CASE t {_TAPE_SQL} ELSE t END AS team FROM (SELECT event_id, {_LIST}[1 + k % 10] AS t FROM {K})")
def _(spark, folder):
    codes = F.array(*[F.lit(c) for c in _PLAIN])
    messy = F.concat(F.lit(" "), F.lower(F.get(codes, F.col("k") % 10)), F.lit("-1 "))
    return _events(spark, folder).select("event_id", text.tape_team(messy).alias("team"))


def _raw_tape(spark, folder):
    ev, k = _events(spark, folder), F.col("k")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    cents = (1 + F.col("k") % 99).cast("int")
    return ev.select(
        _ticker(k).alias("ticker"), F.lit("E").alias("event_ticker"),
        F.when(k % 31 == 0, "").otherwise(F.concat(F.lit("t"), (F.col("event_id") - F.col("event_id") % 2 * (k % 3 == 0).cast("int")).cast("string"))).alias("trade_id"),
        F.when(k % 19 == 0, "").when(k % 29 == 0, "soon").otherwise(stamp).alias("created_time"),
        F.when(k % 3 == 0, F.concat(F.lit("0."), F.lpad(cents.cast("string"), 2, "0"))).alias("yes_price_dollars"),
        F.when(k % 5 == 0, F.concat(F.lit("0."), F.lpad((100 - cents - (k % 10 == 0).cast("int")).cast("string"), 2, "0"))).alias("no_price_dollars"),
        F.when((k % 3 != 0) & (k % 17 != 0), cents).alias("yes_price"),
        F.when(k % 13 == 0, "many").otherwise(F.col("value").cast("string")).alias("count_fp"),
        F.when(k % 2 == 0, "yes").when(k % 11 == 0, None).otherwise(" NO").alias("taker_side"),
        F.lit("x").alias("taker_outcome_side"), F.when(k % 7 == 0, None).when(k % 2 == 0, "bid").otherwise("ask").alias("taker_book_side"),
        F.lit(None).cast("boolean").alias("is_block_trade"), "event_id")


TAPE = f"""{TICKERS},
raw AS (SELECT *, CASE WHEN k % 31 = 0 THEN '' ELSE concat('t', event_id - CASE WHEN k % 3 = 0 THEN event_id % 2 ELSE 0 END) END AS trade_id, CASE WHEN k % 19 = 0 THEN 'none' WHEN k % 29 = 0 THEN 'bad' ELSE 'ok' END AS stamp,
  CASE WHEN k % 3 = 0 OR k % 17 <> 0 THEN CAST(1 + k % 99 AS DOUBLE) END AS yes_c, CASE WHEN k % 5 = 0 THEN CAST(100 - (1 + k % 99) - CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS DOUBLE) END AS no_c, CASE WHEN k % 13 = 0 THEN NULL ELSE value END AS cnt FROM tickers),
usable AS (SELECT *, CASE WHEN yes = home THEN yes_c ELSE 100 - yes_c END AS home_c, epoch_us(ts) / 1e6 AS tsu FROM raw WHERE ok AND stamp = 'ok' AND yes_c IS NOT NULL),
tape AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY tsu) AS n FROM usable WHERE trade_id <> '') WHERE n = 1)"""


def _tape(spark, folder):
    return tape_plan.assemble(tape_plan.usable_trades(tape_plan.typed_trades(_raw_tape(spark, folder))))


@query("read_trades", shown(f"WITH {TAPE} SELECT event_id, trade_id, yes_c AS yes_price_cents, home_c AS home_yes_price_cents, no_c AS no_price_cents, cnt AS count_fp, tsu AS timestamp_unix FROM usable", "event_id trade_id", "yes_price_cents home_yes_price_cents no_price_cents count_fp timestamp_unix", 6))
def _(spark, folder):
    df = tape_plan.usable_trades(tape_plan.typed_trades(_raw_tape(spark, folder)))
    return rounded(df.select("event_id", "trade_id", "yes_price_cents", "home_yes_price_cents", "no_price_cents", "count_fp", "timestamp_unix"), 6)


@query("trade_report", f"""WITH {TAPE} SELECT 'no_timestamp' AS metric, CAST(count(*) AS BIGINT) AS value FROM raw WHERE stamp = 'none' UNION ALL SELECT 'no_price', count(*) FROM raw WHERE stamp <> 'none' AND yes_c IS NULL
 UNION ALL SELECT 'bad_timestamp', count(*) FROM raw WHERE stamp = 'bad' AND yes_c IS NOT NULL UNION ALL SELECT 'no_count', count(*) FROM raw WHERE stamp = 'ok' AND yes_c IS NOT NULL AND cnt IS NULL UNION ALL SELECT 'unparsed_ticker', count(*) FROM raw WHERE NOT ok""")
def _(spark, folder):
    return tape_plan.trade_report(tape_plan.typed_trades(_raw_tape(spark, folder)))


@query("assemble_shards", f"WITH {TAPE} SELECT trade_id, event_id FROM tape")
def _(spark, folder):
    return _tape(spark, folder).select("trade_id", "event_id")


@query("price_sides", shown(f"""WITH {TAPE} SELECT event_id, CASE WHEN yes = home THEN printed ELSE other END AS px_home, CASE WHEN yes = home THEN other ELSE printed END AS px_away FROM (
  SELECT *, CASE WHEN k % 2 = 0 THEN yes_c ELSE yes_c + 1 END AS printed, CASE WHEN k % 2 = 0 THEN 101 - yes_c ELSE 100 - yes_c END AS other FROM tape)""", "event_id", "px_home px_away"))
def _(spark, folder):
    return rounded(tape_plan.price_sides(_tape(spark, folder)).select("event_id", "px_home", "px_away"))


@query("price_sides_legacy", shown(f"WITH {TAPE} SELECT event_id, home_c AS px_home, 101 - home_c AS px_away FROM tape", "event_id", "px_home px_away"))
def _(spark, folder):
    return rounded(tape_plan.price_sides(_tape(spark, folder), mode="legacy").select("event_id", "px_home", "px_away"))


@query("leg_check", f"WITH {TAPE} SELECT CAST(count(no_c) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE abs(yes_c + no_c - 100) <= 0.01) AS BIGINT) AS consistent FROM tape")
def _(spark, folder):
    return tape_plan.leg_check(_tape(spark, folder))


@query("thin_markets", f"WITH {TAPE} SELECT day AS game_date, away AS away_team, home AS home_team, CAST(count(*) AS BIGINT) AS n FROM tape GROUP BY 1, 2, 3 HAVING count(*) < 120")
def _(spark, folder):
    return thin_groups(_tape(spark, folder), ["game_date", "away_team", "home_team"], 120)


@query("book_side_counts", f"WITH {TAPE} SELECT CASE WHEN k % 7 = 0 THEN NULL WHEN k % 2 = 0 THEN 'bid' ELSE 'ask' END AS taker_book_side, CAST(count(*) AS BIGINT) AS n FROM tape GROUP BY 1")
def _(spark, folder):
    return value_counts(_tape(spark, folder), "taker_book_side")


@query("trades_per_game", shown(f"WITH {TAPE}, g AS (SELECT count(*) AS c FROM tape GROUP BY day, away, home) SELECT count(*) AS n, avg(c) AS mean, stddev_samp(c) AS sd, min(c) AS min, max(c) AS max, quantile_cont(c, 0.05) AS p05, quantile_cont(c, 0.5) AS p50, quantile_cont(c, 0.95) AS p95 FROM g", "n min max", "mean sd p05 p50 p95"))
def _(spark, folder):
    games = _tape(spark, folder).groupBy("game_date", "away_team", "home_team").agg(F.count(F.lit(1)).alias("c"))
    return rounded(describe(games, "c", [0.05, 0.5, 0.95], ["p05", "p50", "p95"]))
