"""What the web client asks for: matches to come, predictions, line-ups, a player's form and match-ups; `s` is the dialect.

Predictions are the mean of a player's last five matches, as those of `x07_lineups`; a trained model's have the same
shape (`catalog.x08_upcoming`).
"""

from __future__ import annotations

from crease.functions.dialect import Dialect, count, total
from crease.operators.features import BATTER, BOWLER, histories
from crease.operators.upcoming import players_told, squads_told

#: Points a match by which the last five must rise or fall for a trend to be called that; a choice of ours.
TREND = 1
MODEL = "mean_of_five"


def w01_upcoming(s: Dialect, fmt: str = "T20") -> str:
    return f"{s.base}\nSELECT u.upcoming_id, u.league_id, u.match_date, u.team1, u.team2, u.venue_id, l.format, 'scheduled' AS status, u.toss_winner, u.toss_decision FROM upcoming u LEFT JOIN leagues l ON u.league_id = l.league_id"


def _predicted(s: Dialect) -> str:
    """CTEs up to pr: a row for each player who is to play."""
    return f"""{squads_told(s)},
pr AS (SELECT t.upcoming_id, t.player_id, p.name AS player_name, t.team, p.primary_role AS role, {s.r('t.points_mean_5', 2)} AS predicted_points, t.credits, '{MODEL}' AS model_version FROM told t LEFT JOIN players p ON t.player_id = p.player_id WHERE t.is_told = 0)"""


def w02_predictions(s: Dialect, fmt: str = "T20") -> str:
    """Players of a match to come, best first."""
    return f"{_predicted(s)}\nSELECT pr.*, cast(row_number() OVER (PARTITION BY upcoming_id ORDER BY predicted_points DESC, player_id) as bigint) AS rank FROM pr"


def w02_match(s: Dialect, fmt: str = "T20") -> str:
    """A match's players by team, its best and its mean prediction, and which side's players are predicted more."""
    of = lambda k: f"coalesce(sum(CASE WHEN pr.team = u.team{k} THEN predicted_points END), 0e0)"
    return f"""{_predicted(s)}
SELECT u.upcoming_id, u.match_date, u.team1, u.team2, count(pr.player_id) AS players, {count('pr.team = u.team1')} AS team1_players, {count('pr.team = u.team2')} AS team2_players, {s.r(of(1), 2)} AS team1_points, {s.r(of(2), 2)} AS team2_points, max(predicted_points) AS top_prediction, {s.r(s.mean('predicted_points', 2, 'pr.player_id'), 1)} AS mean_prediction
FROM upcoming u LEFT JOIN pr ON pr.upcoming_id = u.upcoming_id GROUP BY u.upcoming_id, u.match_date, u.team1, u.team2"""


def w03_candidates(s: Dialect, fmt: str = "T20") -> str:
    return f"{_predicted(s)}\nSELECT upcoming_id AS match_id, player_id, predicted_points AS points, credits, role, team FROM pr"


def w04_form(s: Dialect, fmt: str = "T20") -> str:
    """Form of the players in `asked` before their day; the trend is rising or falling from TREND points a match on."""
    return f"""{players_told(s)}
SELECT t.player_id, t.day, p.name, p.primary_role AS role, p.batting_hand, p.bowling_style, cast(least(t.prior_matches, 10) as bigint) AS matches_last_10, t.points_mean_3 AS fp_last3_avg, t.points_mean_5 AS fp_last5_avg, t.points_mean_10 AS fp_last10_avg, t.points_std_5 AS fp_std5,
  CASE WHEN t.points_trend >= {TREND} THEN 'rising' WHEN t.points_trend <= -{TREND} THEN 'falling' ELSE 'stable' END AS fp_trend, t.runs_mean_5 AS bat_runs_avg5, t.sr_mean_5 AS bat_sr_avg5, t.boundary_rate_5 AS bat_boundary_pct5, t.wickets_mean_5 AS bowl_wkts_avg5, t.economy_mean_5 AS bowl_eco_avg5
FROM told t LEFT JOIN players p ON t.player_id = p.player_id WHERE t.is_told = 0"""


def w04_recent_scores(s: Dialect, fmt: str = "T20", limit: int = 10) -> str:
    """The latest matches before the day of the players in `asked`, and against whom they were (null without a toss)."""
    return f"""{histories(s)},
x AS (SELECT a.player_id, a.day, pm.match_id, pm.match_date, pm.opponent AS vs, pm.total_points, pm.batting_points, pm.bowling_points, pm.fielding_points, cast(row_number() OVER (PARTITION BY a.player_id, a.day ORDER BY pm.match_date DESC, pm.match_id DESC) as bigint) AS rank
  FROM (SELECT DISTINCT player_id, day FROM asked) a JOIN pm ON pm.player_id = a.player_id AND pm.match_date < a.day WHERE pm.total_points IS NOT NULL)
SELECT * FROM x WHERE rank <= {limit}"""


def w05_matchups(s: Dialect, fmt: str = "T20") -> str:
    """Each player against kinds of bowlers (strike rate) and of batters (economy), over all matches; no rate without a ball."""
    kinds = [*BATTER["values"], *BOWLER["values"]]
    pick = lambda x: "CASE k " + " ".join(f"WHEN {i} THEN {x(kind)}" for i, kind in enumerate(kinds)) + " END"
    return f"""{histories(s)},
g AS (SELECT player_id, {', '.join(f'{total(f"{x}_{k}")} AS {x}_{k}' for k in kinds for x in 'rb')} FROM pm WHERE player_id IS NOT NULL GROUP BY player_id),
e AS (SELECT g.*, {s.each(len(kinds))} AS k FROM g),
r AS (SELECT player_id, k < {len(BATTER['values'])} AS bats, {pick(repr)} AS matchup_type, {pick(lambda k: f'r_{k}')} AS runs, {pick(lambda k: f'b_{k}')} AS sample_deliveries FROM e)
SELECT player_id, matchup_type, CASE WHEN bats THEN {s.r('runs / nullif(sample_deliveries, 0) * 100', 2)} END AS strike_rate, CASE WHEN NOT bats THEN {s.r('runs / nullif(sample_deliveries, 0) * 6', 2)} END AS economy_rate, sample_deliveries FROM r"""


QUERIES = {k: f for k, f in list(globals().items()) if k[0] == "w" and k[1:3].isdigit()}
