"""Values that have to equal the published data formats and the established parameters of the analysis."""

# --- fixed values: franchises -------------------------------------------------------------------
FRANCHISES = [
    "ATL", "BKN", "BOS", "CHA", "CHI", "CLE", "DAL", "DEN", "DET", "GS", "HOU", "IND", "LAC", "LAL", "MEM",
    "MIA", "MIL", "MIN", "NO", "NY", "OKC", "ORL", "PHI", "PHX", "POR", "SA", "SAC", "TOR", "UTAH", "WSH",
]
FORMER_FRANCHISES = ["NJ", "NOH", "NOK", "CHO", "SEA"]
EXHIBITION_CODES = ["EAST", "WEST", "DUR", "LEB", "GIA", "USA", "WLD"]
EXCHANGE_CODES = [
    "ATL", "BOS", "BKN", "CHA", "CHI", "CLE", "DAL", "DEN", "DET", "GSW", "HOU", "IND", "LAC", "LAL", "MEM",
    "MIA", "MIL", "MIN", "NOP", "NYK", "OKC", "ORL", "PHI", "PHX", "POR", "SAC", "SAS", "TOR", "UTA", "WAS",
]
EXCHANGE_ALIASES = {
    "BRK": "BKN", "BRO": "BKN", "NJN": "BKN", "NJ": "BKN", "BK": "BKN", "PHO": "PHX", "CHO": "CHA", "CHH": "CHA",
    "NOH": "NOP", "NO": "NOP", "NOR": "NOP", "NY": "NYK", "SA": "SAS", "GS": "GSW", "UTAH": "UTA", "WSH": "WAS",
}
TAPE_ALIASES = {
    "GS": "GSW", "NO": "NOP", "NOH": "NOP", "NY": "NYK", "SA": "SAS", "UTAH": "UTA", "WSH": "WAS", "PHO": "PHX",
    "BRK": "BKN", "NJN": "BKN", "CHO": "CHA",
}
FULL_TEAM_NAMES = {
    "Atlanta Hawks": "ATL", "Boston Celtics": "BOS", "Brooklyn Nets": "BKN", "Charlotte Hornets": "CHA",
    "Chicago Bulls": "CHI", "Cleveland Cavaliers": "CLE", "Dallas Mavericks": "DAL", "Denver Nuggets": "DEN",
    "Detroit Pistons": "DET", "Golden State Warriors": "GS", "Houston Rockets": "HOU", "Indiana Pacers": "IND",
    "Los Angeles Clippers": "LAC", "LA Clippers": "LAC", "Los Angeles Lakers": "LAL", "Memphis Grizzlies": "MEM",
    "Miami Heat": "MIA", "Milwaukee Bucks": "MIL", "Minnesota Timberwolves": "MIN", "New Orleans Pelicans": "NO",
    "New York Knicks": "NY", "Oklahoma City Thunder": "OKC", "Orlando Magic": "ORL", "Philadelphia 76ers": "PHI",
    "Phoenix Suns": "PHX", "Portland Trail Blazers": "POR", "Sacramento Kings": "SAC", "San Antonio Spurs": "SA",
    "Toronto Raptors": "TOR", "Utah Jazz": "UTAH", "Washington Wizards": "WSH",
}
MONTHS = {
    "JAN": 1, "FEB": 2, "MAR": 3, "APR": 4, "MAY": 5, "JUN": 6,
    "JUL": 7, "AUG": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DEC": 12,
}

# --- fixed values: clock ------------------------------------------------------------------------
REGULATION_PERIODS = 4
PERIOD_SECONDS = 720
OVERTIME_SECONDS = 300
REGULATION_SECONDS = 2880

# --- fixed values: foul labels ------------------------------------------------------------------
TEAM_FOULS = [
    "Shooting Foul", "Personal Foul", "Loose Ball Foul", "Personal Take Foul", "Transition Take Foul",
    "Away from Play Foul", "Clear Path Foul", "Inbound Foul", "Flagrant Foul Type 1", "Flagrant Foul Type 2",
    "Double Personal Foul",
]
PERSONAL_ONLY_FOULS = ["Offensive Foul", "Offensive Foul Turnover"]
TECHNICAL_FOULS = [
    "Technical Foul", "Double Technical Foul", "Defensive 3-Seconds Technical", "Delay Technical",
    "Hanging Technical Foul", "Flopping Technical", "Taunting Technical Foul", "Non-Unsportsmanlike Technical",
    "Excess Timeout Technical", "Too Many Players Technical", "Free Throw - Technical",
]
SUBSTITUTION = "Substitution"

# --- fixed values: shots ------------------------------------------------------------------------
SHOT_FAMILIES = {
    "dunk": "dunk",
    "layup": "layup|finger roll|tip shot|putback",
    "hook": "hook",
    "fade": "fade away|turnaround|step back",
    "float": "floating|driving",
    "pullup": "pullup|running",
    "jump": "jump|shot",
}
DISTANCE_EDGES = [0, 4, 7, 10, 14, 18, 22, 24, 27, 30, 100]
SHOT_CELL_MIN = 500

# --- fixed values: possession measurement -------------------------------------------------------
TIME_LEFT_EDGES = [0, 30, 60, 120, 300, 720, 3000]
MARGIN_EDGES = [-200, -15, -9, -5, -2, 0, 2, 5, 9, 15, 200]
DURATION_CELL_MIN = 200
MAX_POINTS = 4
MAX_POSSESSION_SECONDS = 60
MAX_SHOT_SECONDS = 40
MAX_POSSESSIONS = 250
EDGE_LIMIT = 0.30
EDGE_STEP = 0.02
MARGIN_CAP = 60
PACE_SCALE_RANGE = (0.75, 1.35)

# --- fixed values: rates ------------------------------------------------------------------------
BOX_SHRINK = 400.0
SHOT_SHRINK = 0.05
LEAGUE_DEFAULTS = {"pts": 110.0, "fg3": 0.36, "fg2": 0.52, "ft": 0.78}
FREE_THROW_WEIGHT = 0.44

# --- fixed values: features ---------------------------------------------------------------------
DECAY_POWERS = [0.5, 0.75, 1.0, 1.25]
STATE_FEATURES = [
    "score_margin", "seconds_left_period", "seconds_left_horizon", "frac_left", "frac_elapsed",
    "margin_x_fracleft", "margin_per_sec_left", "exp_margin_left", "exp_margin_left_per_sec",
    "margin_plus_exp_left", "pts_total", "pace_ratio", "fg3_luck_diff_pts", "fg3_luck_x_fracleft",
    "fg2_luck_diff_pts", "ft_luck_diff_pts", "luck_diff_pts", "luck_x_fracleft", "margin_ex_luck", "fg3a_diff",
    "fga_total", "fta_diff", "fta_diff_x_fracleft", "foul_diff", "team_foul_diff_period",
]
LINEUP_FEATURES = [
    "oncourt_rapm_diff", "rest_rapm_diff", "rest_rapm_diff_left", "oncourt_edge", "home_oncourt_edge",
    "away_oncourt_edge",
]
SURFACE_FEATURES = ["sim_wp", "sim_logit", "sim_n_poss", "sim_adv", "sim_ball_value", "sim_pregame_lift"]
FEATURE_IDS = [
    "game_id", "season", "game_date", "home_team", "away_team", "period", "play_number", "wallclock",
    "pc_seconds_left", "home_score", "away_score", "home_final", "away_final", "home_lineup", "away_lineup",
    "logit_close", "total_close", "home_spread_close", "line_surprise", "line_surprise_rate",
    "exp_margin_x_surprise_rate", "exp_margin_left_x_surprise",
]
EDGE_PREDICTORS = [
    "exp_margin_full", "exp_margin_left", "rest_rapm_diff", "oncourt_rapm_diff", "home_oncourt_edge",
    "away_oncourt_edge", "fg3_luck_diff_pts", "ft_luck_diff_pts", "fg2_luck_diff_pts", "fta_diff", "foul_diff",
    "pace_ratio", "fg3_luck_x_fracleft", "luck_x_fracleft", "fta_diff_x_fracleft", "rest_rapm_diff_left",
    "frac_left", "exp_margin_x_surprise_rate",
]

# --- fixed values: report buckets ---------------------------------------------------------------
EDGE_EDGES = [0.02, 0.03, 0.05, 0.075, 0.10, 0.15, 1.0]
EDGE_LABELS = ["2-3%", "3-5%", "5-7.5%", "7.5-10%", "10-15%", "15%+"]
PRICE_EDGES = [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 101]
PRICE_LABELS = ["0-9", "10-19", "20-29", "30-39", "40-49", "50-59", "60-69", "70-79", "80-89", "90-100"]
LEAD_EDGES = [-999, -14.5, -9.5, -4.5, -0.5, 0.5, 4.5, 9.5, 14.5, 999]
LEAD_LABELS = [
    "trail 15+", "trail 10-14", "trail 5-9", "trail 1-4", "tied", "lead 1-4", "lead 5-9", "lead 10-14", "lead 15+",
]
BET_COLUMNS = [
    "game_id", "game_date", "home_team", "away_team", "season", "period", "pc_seconds_left", "grid_unix", "anchor",
    "side", "price", "p_win", "edge", "edge_z", "contracts", "fee", "staked", "won", "pnl", "score_margin",
    "logit_close", "fill_delay", "edge_bucket", "price_bucket", "margin_bucket", "role", "quarter", "month",
]
CALIBRATOR_KINDS = ["raw", "platt", "isotonic", "tail_iso"]


def decay_tag(power: float) -> str:
    """Column suffix of a decay power: 0.75 -> p0p75."""
    return "p" + str(power).replace(".", "p")


def feature_names(powers: list[float] = DECAY_POWERS) -> list[str]:
    """The model inputs in their written order."""
    decayed = [
        f"{stem}_{decay_tag(k)}" for k in powers for stem in ("exp_margin_left", "logit_close", "total_left")
    ]
    return STATE_FEATURES + LINEUP_FEATURES + SURFACE_FEATURES + decayed
