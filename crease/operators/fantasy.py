"""Fantasy points per player and match, and what is asked of them; `s` is the dialect."""

from __future__ import annotations

from crease.functions.dialect import Dialect, count, total

OUT = "wicket_type IS NOT NULL"


def batting_points(runs="runs", balls="balls", fours="fours", sixes="sixes", out="dismissed", role="primary_role") -> str:
    sr = f"{runs} / nullif({balls}, 0) * 100"
    return f"""{runs} * 5e-1 + {fours} + {sixes} * 2 + CASE WHEN {runs} >= 100 THEN 16 WHEN {runs} >= 50 THEN 8 ELSE 0 END + CASE WHEN {out} AND {runs} = 0 AND coalesce({role}, '') IN ('BAT', 'AR', 'WK') THEN -2 ELSE 0 END
  + CASE WHEN {balls} < 10 THEN 0 WHEN {sr} > 170 THEN 6 WHEN {sr} > 150 THEN 4 WHEN {sr} > 130 THEN 2 WHEN {sr} <= 50 THEN -6 WHEN {sr} <= 60 THEN -4 WHEN {sr} <= 70 THEN -2 ELSE 0 END"""


def bowling_points(balls="legal_deliveries", runs="runs_conceded", wickets="wickets", straight="bowled_lbw_wickets", maidens="maiden_overs") -> str:
    eco = f"{runs} / nullif({balls}, 0) * 6"
    return f"""{wickets} * 25e0 + {straight} * 8 + CASE WHEN {wickets} >= 5 THEN 16 WHEN {wickets} = 4 THEN 8 WHEN {wickets} = 3 THEN 4 ELSE 0 END + {maidens} * 4
  + CASE WHEN {balls} < 12 THEN 0 WHEN {eco} < 5 THEN 6 WHEN {eco} < 6 THEN 4 WHEN {eco} < 7 THEN 2 WHEN {eco} < 10 THEN 0 WHEN {eco} < 11 THEN -2 WHEN {eco} < 12 THEN -4 ELSE -6 END"""


def fielding_points(catches="catches", stumpings="stumpings", direct="direct_runouts", indirect="indirect_runouts") -> str:
    return f"{catches} * 8e0 + {stumpings} * 12 + {direct} * 12 + {indirect} * 6 + CASE WHEN {catches} >= 3 THEN 4 ELSE 0 END"


def points(s: Dialect) -> str:
    """CTEs up to fp: player_id, match_id, batting_points, bowling_points, fielding_points, total_points, training_exclude."""
    credited = "wicket_type NOT IN ('run out', 'retired hurt', 'retired not out', 'obstructing the field')"
    if "fp" in s.stored:
        return f"{s.base},\nfp AS ({s.stored['fp']})"
    return f"""{s.base},
bat AS (SELECT striker_id AS player_id, match_id, {count('faced')} AS balls, {total('runs_batter', 'faced')} AS runs, {count('faced AND runs_batter = 4')} AS fours, {count('faced AND runs_batter = 6')} AS sixes, {count(OUT)} > 0 AS dismissed FROM d WHERE striker_id IS NOT NULL GROUP BY 1, 2),
ovr AS (SELECT bowler_id, match_id, innings, over_no, count(*) AS n, sum(CASE WHEN coalesce(extras_type, '') IN ('byes', 'legbyes') THEN runs_batter ELSE runs_total END) AS conceded, {count('legal')} AS legal_balls, {count(credited)} AS wickets, {count("wicket_type IN ('bowled', 'lbw')")} AS straight FROM d WHERE striker_id IS NOT NULL AND bowler_id IS NOT NULL GROUP BY 1, 2, 3, 4),
bowl AS (SELECT bowler_id AS player_id, match_id, {total('legal_balls')} AS legal_deliveries, {total('conceded')} AS runs_conceded, {total('wickets')} AS wickets, {total('straight')} AS bowled_lbw_wickets, {count('n = 6 AND conceded = 0')} AS maiden_overs FROM ovr GROUP BY 1, 2),
field AS (SELECT wicket_player_id AS player_id, match_id, {count("wicket_type = 'caught'")} AS catches, {count("wicket_type = 'stumped'")} AS stumpings, {count("wicket_type = 'run out'")} AS direct_runouts FROM d WHERE wicket_player_id IS NOT NULL AND striker_id IS NOT NULL GROUP BY 1, 2),
ks AS (SELECT player_id, match_id FROM bat UNION SELECT player_id, match_id FROM bowl UNION SELECT player_id, match_id FROM field),
raw AS (SELECT ks.player_id, ks.match_id, CASE WHEN bat.player_id IS NULL THEN 0e0 ELSE {batting_points()} END AS pb, CASE WHEN bowl.player_id IS NULL THEN 0e0 ELSE {bowling_points()} END AS pw, CASE WHEN field.player_id IS NULL THEN 0e0 ELSE {fielding_points(indirect='0')} END AS pf
  FROM ks LEFT JOIN bat ON ks.player_id = bat.player_id AND ks.match_id = bat.match_id LEFT JOIN bowl ON ks.player_id = bowl.player_id AND ks.match_id = bowl.match_id LEFT JOIN field ON ks.player_id = field.player_id AND ks.match_id = field.match_id LEFT JOIN players p ON ks.player_id = p.player_id),
fp AS (SELECT raw.player_id, raw.match_id, {s.r('pb', 2)} AS batting_points, {s.r('pw', 2)} AS bowling_points, {s.r('pf', 2)} AS fielding_points, {s.r('pb + pw + pf', 2)} AS total_points, m.rain_affected AS training_exclude, m.match_date, m.league_id, m.season, m.winner, l.format AS fmt, l.difficulty
  FROM raw JOIN matches m ON raw.match_id = m.match_id JOIN leagues l ON m.league_id = l.league_id)"""


def _z(s: Dialect) -> str:
    """CTEs up to z: fp with the z-score within league and season (0 where it has no spread)."""
    return f"""{points(s)},
ls AS (SELECT league_id, season, avg(total_points) AS season_mean, stddev_samp(total_points) AS season_deviation FROM fp GROUP BY league_id, season),
z AS (SELECT fp.*, coalesce((total_points - season_mean) / nullif(season_deviation, 0), 0e0) AS z FROM fp JOIN ls ON fp.league_id = ls.league_id AND fp.season IS NOT DISTINCT FROM ls.season)"""


def f06_fantasy_points(s: Dialect, fmt: str = "T20") -> str:
    return f"{points(s)}\nSELECT player_id, match_id, batting_points, bowling_points, fielding_points, total_points, training_exclude FROM fp"


def f07_unscored(s: Dialect, fmt: str = "T20") -> str:
    return f"{points(s)}\nSELECT m.match_id FROM matches m LEFT JOIN (SELECT DISTINCT match_id FROM fp) x ON m.match_id = x.match_id WHERE x.match_id IS NULL"


def p05_momentum(s: Dialect, fmt: str = "T20", days: int = 365) -> str:
    return f"""{_z(s)},
x AS (SELECT player_id, z * exp(-33e-3 * {s.days(s.as_of, 'match_date')}) * difficulty AS ws, {s.days(s.as_of, 'match_date')} AS age FROM z WHERE match_date <= {s.as_of} AND {s.days(s.as_of, 'match_date')} <= {days}),
g AS (SELECT player_id, {s.r(s.clamp('sum(ws) / count(*) * 10 + 5', '0e0', '10e0'), 2)} AS momentum_score, count(*) AS matches_in_window, cast(min(age) as bigint) AS days_since_last_match FROM x GROUP BY player_id)
SELECT *, CASE WHEN momentum_score > 6.5 THEN 'hot' WHEN momentum_score < 3.5 THEN 'cold' ELSE 'neutral' END AS signal FROM g"""


def p05_recent_activity(s: Dialect, fmt: str = "T20", days: int = 365, limit: int = 10) -> str:
    """Each player's latest matches of the window, with what they weigh."""
    return f"""{_z(s)},
x AS (SELECT player_id, match_date, match_id, league_id, {s.r('total_points', 2)} AS total_points, {s.r('z', 3)} AS z_score, {s.r(f"exp(-33e-3 * {s.days(s.as_of, 'match_date')})", 4)} AS weight,
  cast(row_number() OVER (PARTITION BY player_id ORDER BY match_date DESC, match_id DESC) as bigint) AS rank FROM z WHERE match_date <= {s.as_of} AND {s.days(s.as_of, 'match_date')} <= {days})
SELECT * FROM x WHERE rank <= {limit}"""


def p07_consistency(s: Dialect, fmt: str = "T20") -> str:
    """Floor and ceiling are nearest-rank: the values at positions int(0.1 n) and int(0.9 n)."""
    return f"""{points(s)},
k AS (SELECT player_id, total_points, row_number() OVER (PARTITION BY player_id ORDER BY total_points) - 1 AS k, count(*) OVER (PARTITION BY player_id) AS n FROM fp),
g AS (SELECT player_id, count(*) AS matches_analyzed, {s.r('avg(total_points)', 2)} AS mean_fp, {s.r('coalesce(stddev_samp(total_points), 0e0)', 2)} AS std_fp, max(CASE WHEN k = floor(n * 1e-1) THEN total_points END) AS floor_fp, max(CASE WHEN k = least(n - 1, floor(n * 9e-1)) THEN total_points END) AS ceiling_fp FROM k GROUP BY player_id HAVING count(*) >= 3),
c AS (SELECT *, {s.rate('std_fp', 'mean_fp', '1', 4)} AS cv, {s.rate('ceiling_fp', 'mean_fp', '1', 3)} AS upside_ratio FROM g)
SELECT *, CASE WHEN cv < 0.4 THEN 'safe' WHEN cv < 0.7 THEN 'moderate' WHEN cv < 1 THEN 'boom-or-bust' ELSE 'volatile' END AS risk_profile FROM c"""


def p08_win_contribution(s: Dialect, fmt: str = "T20") -> str:
    w = "PARTITION BY player_id"
    return f"""{points(s)},
h AS (SELECT *, coalesce(winner, '') NOT IN ('', 'no result', 'tie') AS won, total_points >= avg(total_points) OVER ({w}) + 15e-1 * coalesce(stddev_samp(total_points) OVER ({w}), 0e0) AS high FROM fp),
g AS (SELECT player_id, count(*) AS matches, {count('won')} AS wins, {s.rate(count('won'), 'count(*)', '1', 4)} AS win_rate, coalesce({s.r('avg(CASE WHEN won THEN total_points END)', 2)}, 0e0) AS mean_fp_in_wins, coalesce({s.r('avg(CASE WHEN NOT won THEN total_points END)', 2)}, 0e0) AS mean_fp_in_losses,
  CASE WHEN avg(total_points) > 0 THEN {s.r(s.clamp('coalesce(avg(CASE WHEN won THEN total_points END), 0e0) / avg(total_points) * 100', '0e0', '100e0'), 2)} ELSE 50e0 END AS wci_score, {count('high')} AS high_leverage_matches, {s.rate(count('high AND won'), count('high'), '1', 4)} AS winning_in_high_leverage_pct FROM h GROUP BY player_id)
SELECT * FROM g"""


def p11_league_breakdown(s: Dialect, fmt: str = "T20") -> str:
    return f"{_z(s)}\nSELECT player_id, league_id, count(*) AS matches, {s.r('avg(total_points)', 2)} AS raw_avg_fp, {s.r('avg(z)', 4)} AS z_score, max(difficulty) AS difficulty_multiplier FROM z GROUP BY player_id, league_id"


def p11_league_adjusted(s: Dialect, fmt: str = "T20") -> str:
    return f"""{_z(s)},
g AS (SELECT player_id, league_id, {s.r('avg(z)', 4)} AS zs, max(difficulty) AS diff FROM z GROUP BY player_id, league_id),
k AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY diff, league_id) AS low, row_number() OVER (PARTITION BY player_id ORDER BY diff DESC, league_id) AS high, count(*) OVER (PARTITION BY player_id) AS n FROM g),
a AS (SELECT player_id, {s.rate('sum(zs * diff)', 'sum(diff)', '1', 4)} AS overall_adjusted_score, CASE WHEN max(n) >= 2 THEN {s.r('max(CASE WHEN low = 1 THEN zs END) - max(CASE WHEN high = 1 THEN zs END)', 4)} ELSE 0e0 END AS inflation_index FROM k GROUP BY player_id)
SELECT *, CASE WHEN abs(inflation_index) < 0.3 THEN 'consistent' WHEN inflation_index > 0.3 THEN 'inflator' ELSE 'undervalued' END AS label FROM a"""


def p14_format_switch(s: Dialect, fmt: str = "T20") -> str:
    w = "PARTITION BY player_id ORDER BY match_date, match_id"
    return f"""{_z(s)},
l AS (SELECT *, lag(fmt) OVER ({w}) AS before, lag(match_date) OVER ({w}) AS prior FROM z),
t AS (SELECT player_id, z, before, fmt, CASE WHEN before IS NULL THEN 'settled' WHEN before <> fmt AND {s.days('match_date', 'prior')} <= 7 THEN 'switch' WHEN before = fmt AND {s.days('match_date', 'prior')} >= 10 THEN 'settled' END AS kind FROM l),
g AS (SELECT player_id, {count("kind = 'switch'")} AS switch_matches, {count("kind = 'settled'")} AS settled_matches, coalesce({s.r("avg(CASE WHEN kind = 'switch' THEN z END)", 4)}, 0e0) AS switch_avg_z, coalesce({s.r("avg(CASE WHEN kind = 'settled' THEN z END)", 4)}, 0e0) AS settled_avg_z,
  avg(CASE WHEN kind = 'switch' AND before = 'T20' AND fmt = 'ODI' THEN z END) AS down, avg(CASE WHEN kind = 'switch' AND before = 'ODI' AND fmt = 'T20' THEN z END) AS up FROM t GROUP BY player_id),
a AS (SELECT *, {s.r('switch_avg_z - settled_avg_z', 4)} AS performance_delta, {s.r(s.clamp('1 - abs(switch_avg_z - settled_avg_z)', '0e0', '1e0'), 4)} AS format_adaptability_score FROM g)
SELECT player_id, switch_matches, settled_matches, switch_avg_z, settled_avg_z, performance_delta, format_adaptability_score, CASE WHEN down IS NULL AND up IS NULL THEN NULL WHEN up IS NULL OR down <= up THEN 'T20_to_ODI' ELSE 'ODI_to_T20' END AS worst_switch_direction,
  CASE WHEN abs(performance_delta) < 0.2 THEN 'format-agnostic' WHEN abs(performance_delta) < 0.5 THEN 'slight-impact' ELSE 'significant-impact' END AS verdict FROM a"""


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "fp" and k[1:3].isdigit()}
