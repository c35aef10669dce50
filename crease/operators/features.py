"""Features of a player before each match, evaluation windows and metrics; `s` is the dialect.

All of it looks strictly back, by days: of another match on the same day nothing is known. What is known is told by rows of
one stream for each key: the key's history, a row a match, and the rows that ask, which stand before the matches of their
day. One shuffle by key serves all windows: running sums in that order, and, as each history numbers its own rows (matches
that count, innings faced, matches bowled), ranges over those numbers for the last few of them. Matches as played ask
for themselves; matches to come (`upcoming`) and lists of players and days ask by the same text, so that a model meets
the same features in training and in prediction.
"""

from __future__ import annotations

from crease.functions.dialect import Dialect, count, total
from crease.operators.fantasy import points

PACE = "('right-arm fast', 'right-arm medium', 'left-arm fast')"
SPIN = "('right-arm offbreak', 'left-arm orthodox', 'legbreak')"
#: What a player's last innings with the bat, and last matches with the ball, said.
BAT = ["runs_mean_5", "sr_mean_5", "boundary_rate_5", "fifty_rate_10"]
BOWL = ["wickets_mean_5", "economy_mean_5", "bowling_sr_5"]

#: Kinds of opponents (a player o), and the fewest balls for a rate against them.
BATTER = {"values": {"pace": f"o.bowling_style IN {PACE}", "spin": f"o.bowling_style IN {SPIN}", "left_arm": "o.bowling_style IN ('left-arm fast', 'left-arm orthodox')"}, "least": 10, "times": 100, "none": "NULL"}
BOWLER = {"values": {"left": "o.batting_hand = 'Left hand'", "right": "o.batting_hand = 'Right hand'"}, "least": 12, "times": 6, "none": "75e-1"}
KINDS = [*BATTER["values"], *BOWLER["values"]]
#: Columns of a player's match (pm) that histories add up.
SUMS = ["balls", "bowled", "first_over", *(f"{x}_{k}" for k in KINDS for x in "rb")]


def histories(s: Dialect) -> str:
    """CTEs up to pm: one row for each player and match, of points, what the player did with bat and ball, and the team met.

    The team met is known where the toss is. Balls without a bowler count for the match's total only, in a row of no player.
    """
    if "pm" in s.stored:
        return f"{s.base},\npm AS ({s.stored['pm']})"
    bat, bowl = "side = 0 AND faced", "side = 1 AND legal"
    credited = "wicket_type NOT IN ('run out', 'retired hurt', 'retired not out', 'obstructing the field')"
    against = [f"{total(value, f'{ok} AND {c}')} AS r_{k}, {count(f'{ok} AND {c}')} AS b_{k}" for ok, value, of in ((bat, "runs_batter", BATTER), (bowl, "runs_total", BOWLER)) for k, c in of["values"].items()]
    first = "CASE toss_decision WHEN 'bat' THEN toss_winner WHEN 'field' THEN CASE WHEN toss_winner = team1 THEN team2 ELSE team1 END END"
    did = ["bats", "balls", "runs", "big", "first_over", "bowled", "conceded", "wickets", "sent", "first_total", *(f"{x}_{k}" for k in KINDS for x in "rb")]
    return f"""{points(s)},
sides AS (SELECT match_id, innings, over_ball, striker_id, bowler_id, runs_batter, runs_total, wicket_type, faced, legal, {s.each(2)} AS side FROM d),
ps AS (SELECT CASE side WHEN 0 THEN striker_id ELSE bowler_id END AS player_id, match_id, min(CASE side WHEN 0 THEN innings ELSE 3 - innings END) AS bats, {count(bat)} AS balls, {total('runs_batter', bat)} AS runs, {count(f'{bat} AND runs_batter IN (4, 6)')} AS big,
  cast(min(over_ball) FILTER (WHERE side = 0) as double) AS first_over, {count(bowl)} AS bowled, {total('runs_total', bowl)} AS conceded, {count(f'side = 1 AND {credited}')} AS wickets, {count('side = 1')} AS sent, {total('runs_total', 'side = 1 AND innings = 1')} AS first_total, {', '.join(against)}
  FROM sides LEFT JOIN players o ON o.player_id = CASE side WHEN 0 THEN bowler_id ELSE striker_id END GROUP BY 1, 2),
joint AS (SELECT coalesce(fp.player_id, ps.player_id) AS player_id, coalesce(fp.match_id, ps.match_id) AS match_id, batting_points, bowling_points, fielding_points, total_points, training_exclude, {', '.join(did)} FROM fp FULL JOIN ps ON fp.player_id = ps.player_id AND fp.match_id = ps.match_id),
pm AS (SELECT x.*, b.bowling_style, m.match_date, m.league_id, m.season, m.venue_id, m.team1, m.team2, m.toss_winner, m.toss_decision, CASE WHEN bats IS NOT NULL AND toss_decision IS NOT NULL THEN CASE WHEN ({first} = team1) = (bats = 1) THEN team2 ELSE team1 END END AS opponent
  FROM joint x JOIN matches m ON x.match_id = m.match_id LEFT JOIN players b ON x.player_id = b.player_id)"""


#: The order of a stream: what asks on a day stands before what is told of it.
ORDER = "day, is_told, match_id"
#: Columns that a stream by player needs, beside player_id, day, is_told and match_id.
TOLD = ["opponent", "venue_id", "total_points", "training_exclude", "runs", "big", "conceded", "wickets", *SUMS]


def _so_far(by: str) -> str:
    return f"PARTITION BY {by} ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _last(n: int, number: str, by: str = "player_id") -> str:
    """The last `n` rows of the history that `number` counts."""
    return f"PARTITION BY {by} ORDER BY {number} RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


def told(s: Dialect, stream: str) -> str:
    """CTEs up to told: the rows of `stream` (TOLD and any more columns) with all that is known of their player."""
    said = lambda c, n, ok="": f"CASE WHEN is_told = 1{ok} THEN {c} END AS {n}"
    own = [said("total_points", "pts", " AND NOT training_exclude"), said("total_points", "all_pts"), *(said(c, f"i_{c}", " AND balls > 0") for c in ("runs", "balls", "big")), *(said(c, f"w_{c}", " AND bowled > 0") for c in ("bowled", "conceded", "wickets")), *(said(c, f"t_{c}") for c in SUMS)]
    w = _so_far("player_id")
    sums = ", ".join(f"sum(t_{c}) OVER ({w}) AS s_{c}" for c in SUMS)
    pair = lambda by: f"sum(all_pts) OVER ({_so_far(f'player_id, {by}')}) AS p_{by}, count(all_pts) OVER ({_so_far(f'player_id, {by}')}) AS n_{by}"
    p, i, b = (lambda n, number=number: _last(n, number) for number in ("prior_matches", "n_bat", "n_bowl"))
    means = ", ".join(f"{s.r(f'coalesce(avg(pts) OVER ({p(k)}), 0e0)', 6)} AS points_mean_{k}" for k in (3, 5, 10))
    some = lambda x, n: f"coalesce({s.r(x, 6)}, 0e0) AS {n}"
    rates = ", ".join(f"CASE WHEN coalesce(s_{n}, 0) = 0 THEN {of['none']} WHEN s_b_{k} >= {of['least']} THEN {s.r(f's_r_{k} / nullif(s_b_{k}, 0) * {of["times"]}', 6)} END AS vs_{k}" for of, n in ((BATTER, "balls"), (BOWLER, "bowled")) for k in of["values"])
    # the weights of the faded mean fall to 3e-1 of the next match's; beyond 40 matches they are below a double's precision
    # a level trend is 0, not the negative zero that rounding can give
    return f"""{stream},
told_1 AS (SELECT stream.*, {', '.join(own)} FROM {s.parted('stream', 'player_id', 4)}),
told_2 AS (SELECT *, count(pts) OVER ({w}) AS prior_matches, count(i_balls) OVER ({w}) AS n_bat, count(w_bowled) OVER ({w}) AS n_bowl, max(CASE WHEN pts IS NOT NULL THEN day END) OVER ({w}) AS last_date, count(t_first_over) OVER ({w}) AS n_first_over, {sums} FROM told_1),
told_3 AS (SELECT *, {pair('opponent')}, {pair('venue_id')} FROM told_2),
told AS (SELECT *, coalesce({s.days('day', 'last_date')}, 999) AS days_since_last, {means}, {s.r(f'coalesce(stddev_pop(pts) OVER ({p(5)}), 0e0)', 6)} AS points_std_5,
  CASE WHEN prior_matches > 0 THEN {s.r(f"{s.faded('pts', '3e-1', p(40))} * 7e-1 / (1 - power(3e-1, least(prior_matches, 40)))", 6)} ELSE 0e0 END AS points_faded_mean,
  CASE WHEN prior_matches >= 3 THEN coalesce(nullif({s.r(f'regr_slope(pts, cast(prior_matches as double)) OVER ({p(5)})', 6)}, 0), 0e0) ELSE 0e0 END AS points_trend,
  {some(f'avg(i_runs) OVER ({i(5)})', 'runs_mean_5')}, {some(f'avg(CASE WHEN i_balls >= 10 THEN i_runs / i_balls * 100 END) OVER ({i(5)})', 'sr_mean_5')}, {some(f'sum(i_big) OVER ({i(5)}) / sum(i_balls) OVER ({i(5)})', 'boundary_rate_5')}, {some(f'avg(CASE WHEN i_runs >= 50 THEN 1 WHEN i_runs < 50 THEN 0 END) OVER ({i(10)})', 'fifty_rate_10')},
  {some(f'avg(w_wickets) OVER ({b(5)})', 'wickets_mean_5')}, {some(f'avg(CASE WHEN w_bowled >= 12 THEN w_conceded / w_bowled * 6 END) OVER ({b(5)})', 'economy_mean_5')}, {some(f'sum(w_bowled) OVER ({b(5)}) / nullif(sum(w_wickets) OVER ({b(5)}), 0)', 'bowling_sr_5')},
  CASE WHEN opponent IS NOT NULL THEN {s.r('p_opponent / nullif(n_opponent, 0)', 6)} END AS versus_mean, CASE WHEN opponent IS NOT NULL THEN n_opponent END AS versus_matches,
  CASE WHEN venue_id IS NOT NULL THEN {s.r('p_venue_id / nullif(n_venue_id, 0)', 6)} END AS at_venue_mean, CASE WHEN venue_id IS NOT NULL THEN n_venue_id END AS at_venue_matches, {rates}, {s.r('s_first_over / nullif(n_first_over, 0)', 6)} AS batting_position_mean FROM told_3)"""


def _played(s: Dialect) -> str:
    """CTEs up to told, asked by each player's matches themselves (is_told = 0)."""
    return told(s, f"{histories(s)},\nstream AS (SELECT pm.*, match_date AS day, {s.each(2)} AS is_told FROM pm WHERE player_id IS NOT NULL)")


def of_matches() -> str:
    """CTE tq, after pm: points, balls and runs of each match."""
    kinds = ", ".join(f"sum(CASE WHEN bowling_style IN {styles} THEN conceded ELSE 0 END) AS {k}_runs, sum(CASE WHEN bowling_style IN {styles} THEN bowled ELSE 0 END) AS {k}_balls" for k, styles in (("pace", PACE), ("spin", SPIN)))
    return f"""tq AS (SELECT match_id, match_date, team1, team2, venue_id, sum(batting_points) AS sb, sum(bowling_points) AS sw, count(total_points) AS n, count(bats) AS n_played, sum(CASE WHEN bowling_style IN {PACE} THEN sent ELSE 0 END) AS pace, sum(CASE WHEN bowling_style IS NOT NULL THEN sent ELSE 0 END) AS known,
  sum(first_total) AS first_total, {kinds} FROM pm GROUP BY match_id, match_date, team1, team2, venue_id)"""


#: Columns that streams by team and by venue need.
OF_TEAM = ["sb", "sw", "n", "n_played", "pace", "known"]
OF_VENUE = ["first_total", "pace_runs", "pace_balls", "spin_runs", "spin_balls", "sb", "sw", "n"]


def told_of_teams(s: Dialect, stream: str) -> str:
    """CTEs up to tt: the rows of `stream` (team, OF_TEAM) with how strong the team was and how much pace it met, each in its last five matches."""
    w, q, m = _so_far("team"), _last(5, "n_q", "team"), _last(5, "n_m", "team")
    mean = lambda x, other: s.r(f"coalesce(sum({x}) OVER ({q}) / nullif(sum(t_n) OVER ({q}), 0), {other})", 6)
    said = lambda ok, *cols: ", ".join(f"CASE WHEN is_told = 1 AND {ok} > 0 THEN {c} END AS t_{c}" for c in cols)
    return f"""{stream},
tt_1 AS (SELECT team_stream.*, {said('n', 'sb', 'sw', 'n')}, {said('n_played', 'pace', 'known')} FROM team_stream),
tt_2 AS (SELECT *, count(t_n) OVER ({w}) AS n_q, count(t_known) OVER ({w}) AS n_m FROM tt_1),
tt AS (SELECT *, {mean('t_sb', '15e0')} AS opposition_batting, {mean('t_sw', '8e0')} AS opposition_bowling, {s.r(f'coalesce(sum(t_pace) OVER ({m}) / nullif(sum(t_known) OVER ({m}), 0), 5e-1)', 6)} AS opposition_pace_ratio FROM tt_2)"""


def told_of_venues(s: Dialect, stream: str) -> str:
    """CTEs up to tv: the rows of `stream` (venue_id, OF_VENUE) with what all earlier matches at the venue were like."""
    w = _so_far("venue_id")
    sums = ", ".join(f"sum(CASE WHEN is_told = 1 THEN {c} END) OVER ({w}) AS s_{c}" for c in OF_VENUE)
    mean = lambda a, b, other, times="1": s.r(f"coalesce(s_{a} / nullif({b}, 0) * {times}, {other})", 6)
    return f"""{stream},
tv_1 AS (SELECT venue_stream.*, count(CASE WHEN is_told = 1 THEN 1 END) OVER ({w}) AS s_matches, {sums} FROM venue_stream),
tv_2 AS (SELECT *, {mean('first_total', 's_matches', '160e0')} AS venue_first_innings, {mean('pace_runs', 's_pace_balls', '75e-1', '6')} AS venue_pace_economy, {mean('spin_runs', 's_spin_balls', '75e-1', '6')} AS venue_spin_economy, {mean('sb', 's_n', '20e0')} AS venue_batting_points, {mean('sw', 's_n', '10e0')} AS venue_bowling_points FROM tv_1),
tv AS (SELECT *, {s.rate('venue_pace_economy', 'venue_spin_economy', '1', 6, '1e0')} AS venue_pace_spin_ratio FROM tv_2)"""


def _teams(s: Dialect) -> str:
    """CTEs up to tt, asked by the teams of each match."""
    return told_of_teams(s, f"""{histories(s)}, {of_matches()},
team_4 AS (SELECT tq.*, match_date AS day, {s.each(4)} AS k FROM tq),
team_stream AS (SELECT match_id, day, {', '.join(OF_TEAM)}, CASE WHEN k % 2 = 0 THEN team1 ELSE team2 END AS team, CASE WHEN k >= 2 THEN 1 ELSE 0 END AS is_told FROM team_4)""")


def _venues(s: Dialect) -> str:
    """CTEs up to tv, asked by each match with a venue."""
    return told_of_venues(s, f"""{histories(s)}, {of_matches()},
venue_stream AS (SELECT match_id, venue_id, match_date AS day, {', '.join(OF_VENUE)}, {s.each(2)} AS is_told FROM tq WHERE venue_id IS NOT NULL AND n > 0 AND n_played > 0)""")


VENUE = ["venue_first_innings", "venue_pace_economy", "venue_spin_economy", "venue_pace_spin_ratio", "venue_batting_points", "venue_bowling_points"]
#: Rows of told that ask: matches that count, matches with points, matches with a ball faced or bowled.
COUNTED, SCORED, SEEN = "is_told = 0 AND NOT training_exclude", "is_told = 0 AND total_points IS NOT NULL", "is_told = 0 AND bats IS NOT NULL"


def _form(s: Dialect) -> str:
    """CTEs up to form: points over matches that count, batting over innings faced, bowling over matches bowled, each before the day."""
    return f"{_played(s)},\nform AS (SELECT player_id, match_id, match_date, league_id, season, total_points AS target, {', '.join(FORM)} FROM told WHERE {COUNTED})"


FORM = ["prior_matches", "days_since_last", "points_mean_3", "points_mean_5", "points_mean_10", "points_std_5", "points_faded_mean", "points_trend", *BAT, *BOWL]


def g02_form(s: Dialect, fmt: str = "T20") -> str:
    return f"{_form(s)}\nSELECT player_id, match_id, {', '.join(FORM)} FROM form"


def g04_training_rows(s: Dialect, fmt: str = "T20", prior: int = 3) -> str:
    return f"{_form(s)}\nSELECT player_id, match_id, target, points_mean_5, points_std_5 FROM form WHERE prior_matches >= {prior}"


def g05_opposition(s: Dialect, fmt: str = "T20") -> str:
    """How strong a team met is: mean points of all players in its last five matches."""
    return f"{_teams(s)}\nSELECT team, match_id, opposition_batting, opposition_bowling FROM tt WHERE is_told = 0 AND n > 0"


def g06_versus_opposition(s: Dialect, fmt: str = "T20") -> str:
    """Mean points and number of a player's earlier matches against the team met; who bats first is known from the toss, or the match is left out."""
    return f"{_played(s)}\nSELECT player_id, match_id, opponent, versus_mean, versus_matches FROM told WHERE {SCORED} AND opponent IS NOT NULL"


def g07_pace_share(s: Dialect, fmt: str = "T20") -> str:
    """Share of balls bowled by pace in each team's last five matches."""
    return f"{_teams(s)}\nSELECT team, match_id, opposition_pace_ratio FROM tt WHERE is_told = 0 AND n_played > 0"


def g08_batter_matchups(s: Dialect, fmt: str = "T20") -> str:
    """Strike rates against kinds of bowlers over all earlier matches, for every match of a player."""
    return f"{_played(s)}\nSELECT player_id, match_id, {', '.join(f'vs_{k}' for k in BATTER['values'])} FROM told WHERE {SEEN}"


def g09_bowler_matchups(s: Dialect, fmt: str = "T20") -> str:
    """Economy against kinds of batters over all earlier matches, for every match of a player; a default if there was no ball at all before."""
    return f"{_played(s)}\nSELECT player_id, match_id, {', '.join(f'vs_{k}' for k in BOWLER['values'])} FROM told WHERE {SEEN}"


def g10_venue(s: Dialect, fmt: str = "T20") -> str:
    """Of earlier matches at the venue only."""
    return f"{_venues(s)}\nSELECT match_id, venue_id, {', '.join(VENUE)} FROM tv WHERE is_told = 0"


def g11_player_venue(s: Dialect, fmt: str = "T20") -> str:
    """Mean points and number of a player's earlier matches at the venue."""
    return f"{_played(s)}\nSELECT player_id, match_id, at_venue_mean, at_venue_matches FROM told WHERE {SCORED} AND venue_id IS NOT NULL"


def g12_static(s: Dialect, fmt: str = "T20") -> str:
    flag = lambda c, n: f"CASE WHEN {c} THEN 1 ELSE 0 END AS {n}"
    roles = ", ".join(flag(f"primary_role = '{r}'", f"is_{r.lower()}") for r in ("BAT", "BOWL", "AR", "WK"))
    return f"{s.base}\nSELECT player_id, {roles}, {flag("batting_hand = 'Left hand'", 'is_left_hand')}, {flag(f'bowling_style IN {PACE}', 'is_pacer')}, {flag(f'bowling_style IN {SPIN}', 'is_spinner')}, dob FROM players"


def g12_batting_position(s: Dialect, fmt: str = "T20") -> str:
    """Mean over earlier matches of the over and ball that a player first faced, for every match of the player."""
    return f"{_played(s)}\nSELECT player_id, match_id, batting_position_mean FROM told WHERE {SEEN}"


def g13_context(s: Dialect, fmt: str = "T20") -> str:
    return f"""{s.base},
t AS (SELECT match_id, league_id, toss_winner, toss_decision, team1 AS team FROM matches UNION ALL SELECT match_id, league_id, toss_winner, toss_decision, team2 FROM matches)
SELECT t.match_id, t.team, CASE WHEN t.toss_winner = t.team THEN 1 ELSE 0 END AS toss_won, CASE WHEN (t.toss_winner = t.team) = (t.toss_decision = 'bat') THEN 1 ELSE 0 END AS batting_first, coalesce(l.difficulty, 1e0) AS league_difficulty, coalesce(l.similarity, 1e0) AS format_similarity, coalesce(l.tier, 2) AS league_tier FROM t LEFT JOIN leagues l ON t.league_id = l.league_id"""


#: Columns a model of points learns from; missing ones stay null.
FEATURES = [
    *FORM, "versus_mean", "versus_matches", "opposition_batting", "opposition_bowling", "opposition_pace_ratio", "vs_pace", "vs_spin", "vs_left_arm", "vs_left", "vs_right", "venue_first_innings", "venue_pace_economy", "venue_spin_economy", "venue_pace_spin_ratio",
    "venue_batting_points", "venue_bowling_points", "at_venue_mean", "at_venue_matches", "is_bat", "is_bowl", "is_ar", "is_wk", "is_left_hand", "is_pacer", "is_spinner", "age", "batting_position_mean", "toss_won", "batting_first", "league_difficulty", "format_similarity", "league_tier",
]


def static(s: Dialect, day: str) -> dict[str, str]:
    """SQL of what a player is on a day: a player who isn't known has no role and hand, and no age."""
    flags = ["is_bat", "is_bowl", "is_ar", "is_wk", "is_left_hand", "is_pacer", "is_spinner"]
    return {**{c: f"coalesce({c}, 0)" for c in flags}, "age": s.r(f"{s.days(day, 'dob')} / 365.25e0", 6)}


def chosen(own: dict[str, str]) -> str:
    """The columns of FEATURES, some of them made by SQL of their own."""
    return ", ".join(f"{own[c]} AS {c}" if c in own else c for c in FEATURES)


def g14_matrix(s: Dialect, fmt: str = "T20", prior: int = 3) -> str:
    """One row of all features and the target for each player and match with at least `prior` earlier matches; where the toss is unknown, so are the teams and what hangs on them."""
    team = "CASE WHEN f.opponent = f.team1 THEN f.team2 ELSE f.team1 END"
    met = lambda x: f"CASE WHEN f.opponent IS NOT NULL THEN {x} END"
    own = {**static(s, "f.match_date"), "toss_won": met(f"CASE WHEN f.toss_winner = {team} THEN 1 ELSE 0 END"), "batting_first": met(f"CASE WHEN (f.toss_winner = {team}) = (f.toss_decision = 'bat') THEN 1 ELSE 0 END"), "league_difficulty": met("coalesce(l.difficulty, 1e0)"), "format_similarity": met("coalesce(l.similarity, 1e0)"), "league_tier": met("coalesce(l.tier, 2)")}
    return f"""SELECT f.player_id, f.match_id, f.match_date, f.league_id, f.season, f.target, {chosen(own)}
FROM ({_played(s)} SELECT told.*, total_points AS target FROM told WHERE {COUNTED} AND prior_matches >= {prior}) f
LEFT JOIN ({_teams(s)} SELECT match_id, team, opposition_batting, opposition_bowling, opposition_pace_ratio FROM tt WHERE is_told = 0) t ON t.match_id = f.match_id AND t.team = f.opponent
LEFT JOIN ({_venues(s)} SELECT match_id, {', '.join(VENUE)} FROM tv WHERE is_told = 0) v ON v.match_id = f.match_id
LEFT JOIN ({g12_static(s)}) p ON p.player_id = f.player_id
LEFT JOIN ({s.base} SELECT * FROM leagues) l ON l.league_id = f.league_id"""


def g15_outcome_rows(s: Dialect, fmt: str = "T20") -> str:
    """One row for each decided match: the toss, and both teams' strength in their last five matches."""
    of = lambda c, k: f"max(CASE WHEN tt.team = m.team{k} THEN {c} END)"
    return f"""{_teams(s)}
SELECT m.match_id, m.match_date, CASE WHEN m.toss_winner = m.team1 THEN 1 ELSE 0 END AS toss_first_team, CASE WHEN m.toss_decision = 'bat' THEN 1 ELSE 0 END AS toss_bat, {of('opposition_batting', 1)} AS batting_1, {of('opposition_bowling', 1)} AS bowling_1, {of('opposition_batting', 2)} AS batting_2, {of('opposition_bowling', 2)} AS bowling_2,
  CASE WHEN m.winner = m.team1 THEN 1 ELSE 0 END AS target
FROM matches m JOIN tt ON tt.match_id = m.match_id WHERE m.winner IS NOT NULL AND tt.is_told = 0 AND tt.n > 0 GROUP BY m.match_id, m.match_date, m.toss_winner, m.toss_decision, m.team1, m.winner"""


def x04_backtest_windows(s: Dialect, fmt: str = "T20") -> str:
    """Walk-forward windows of 90 days, stepped by 30: rows to train on and to validate on."""
    return f"""{_form(s)},
r AS (SELECT player_id, match_date FROM form WHERE prior_matches >= 3),
per AS (SELECT match_date, count(*) AS n FROM r GROUP BY match_date),
lo AS (SELECT min(match_date) AS first_date, max(match_date) AS last_date FROM per),
w AS (SELECT g AS window_no, {s.add_days('first_date', 'g * 30')} AS cursor_date, last_date FROM (SELECT lo.*, {s.steps(s.days('last_date', 'first_date') + ' / 30')} AS g FROM lo) x),
c AS (SELECT window_no, cursor_date, {total('n', 'match_date < cursor_date')} AS n_train, {total('n', f"match_date >= cursor_date AND match_date < {s.add_days('cursor_date', '90')}")} AS n_val FROM w JOIN per ON per.match_date < {s.add_days('cursor_date', '90')} WHERE cursor_date <= last_date GROUP BY 1, 2)
SELECT cast(window_no as bigint) AS window_no, cursor_date, n_train, n_val FROM c WHERE n_train >= 1000 AND n_val >= 50"""


def x05_baseline_metrics(s: Dialect, fmt: str = "T20") -> str:
    """Each season's mean of the last five matches as the prediction: RMSE, rank correlation (average ranks), share of the true top eleven found."""
    # ranks by counts of distinct values: points and means of five of them are few, whatever the rows
    rank = lambda x: f"SELECT season, {x}, sum(count(*)) OVER (PARTITION BY season ORDER BY {x}) - (count(*) - 1) / 2 AS r{x} FROM r GROUP BY season, {x}"
    return f"""{_form(s)},
r AS (SELECT season, match_id, player_id, target AS y, points_mean_5 AS p FROM form WHERE prior_matches >= 3),
ky AS ({rank('y')}), kp AS ({rank('p')}),
rk AS (SELECT r.*, ry, rp, row_number() OVER (PARTITION BY match_id ORDER BY r.y DESC, player_id) AS ty, row_number() OVER (PARTITION BY match_id ORDER BY r.p DESC, player_id) AS tp, count(*) OVER (PARTITION BY match_id) AS n FROM r JOIN ky ON r.season IS NOT DISTINCT FROM ky.season AND r.y = ky.y JOIN kp ON r.season IS NOT DISTINCT FROM kp.season AND r.p = kp.p),
o AS (SELECT season, match_id, {count('ty <= 11 AND tp <= 11')} / 11 AS overlap FROM rk WHERE n >= 11 GROUP BY season, match_id),
oo AS (SELECT season, avg(overlap) AS top_11_overlap FROM o GROUP BY season),
a AS (SELECT season, count(*) AS n, sqrt(avg((y - p) * (y - p))) AS rmse, corr(cast(ry as double), cast(rp as double)) AS rho FROM rk GROUP BY season)
SELECT a.season, a.n, {s.r('rmse', 4)} AS rmse, {s.r('rho', 4)} AS spearman, {s.r('top_11_overlap', 4)} AS top_11_overlap, CASE WHEN rho >= 0.4 THEN 'good' WHEN rho >= 0.3 THEN 'acceptable' ELSE 'poor' END AS verdict FROM a LEFT JOIN oo ON a.season = oo.season"""


def x07_candidates(s: Dialect, fmt: str = "T20") -> str:
    """Players of a match with their predicted points (the mean of the last five), credits, role and team."""
    return f"""{_form(s)}
SELECT form.match_id, form.player_id, points_mean_5 AS points, 7 + (form.player_id % 7) * 5e-1 AS credits, p.primary_role AS role, concat('Team_', {s.text('cast(floor((form.player_id - 1) / 11) as int)')}) AS team FROM form JOIN players p ON form.player_id = p.player_id WHERE prior_matches >= 1"""


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "gx" and k[1:3].isdigit()}
