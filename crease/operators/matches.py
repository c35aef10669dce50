"""Questions about venues, teams, matches, leaders, match-ups and match states; `s` is the dialect."""

from __future__ import annotations

from crease.functions.dialect import Dialect, count, overs, total

OUT = "wicket_type IS NOT NULL"
DECIDED = "winner IS NOT NULL AND toss_decision IS NOT NULL"
FIRST = "CASE toss_decision WHEN 'bat' THEN toss_winner WHEN 'field' THEN CASE WHEN toss_winner = team1 THEN team2 ELSE team1 END END"


def _ml(fmt: str) -> str:
    return f"ml AS (SELECT m.*, l.format AS fmt, {FIRST} AS batted_first FROM matches m JOIN leagues l ON m.league_id = l.league_id WHERE l.format = '{fmt}')"


def v01_toss(s: Dialect, fmt: str = "T20") -> str:
    return f"""{s.base}, {_ml(fmt)},
g AS (SELECT venue_id, count(*) AS total_matches, {count(DECIDED)} AS n, {count(f'{DECIDED} AND toss_winner = winner')} AS won, {count(f'{DECIDED} AND batted_first = winner')} AS first_won,
  {count(f"{DECIDED} AND toss_decision = 'bat'")} AS bats, {count(f"{DECIDED} AND toss_decision = 'bat' AND toss_winner = winner")} AS bats_won, {count(f"{DECIDED} AND toss_decision = 'field'")} AS fields, {count(f"{DECIDED} AND toss_decision = 'field' AND toss_winner = winner")} AS fields_won FROM ml GROUP BY venue_id),
r AS (SELECT venue_id, total_matches, n, {s.rate('won', 'n', '1', 4, '5e-1')} AS win_rate_when_winning_toss, {s.rate('first_won', 'n', '1', 4, '5e-1')} AS batting_first_win_pct, coalesce(bats_won / nullif(bats, 0), 0e0) AS rb, coalesce(fields_won / nullif(fields, 0), 0e0) AS rf FROM g)
SELECT venue_id, total_matches, win_rate_when_winning_toss, {s.r('win_rate_when_winning_toss - 5e-1', 4)} AS toss_alpha, batting_first_win_pct, {s.r('1 - batting_first_win_pct', 4)} AS fielding_first_win_pct,
  CASE WHEN rb >= rf THEN 'bat' ELSE 'field' END AS best_toss_decision, CASE WHEN n >= 30 THEN 'high' WHEN n >= 15 THEN 'medium' ELSE 'low' END AS confidence FROM r"""


def v01_toss_seasons(s: Dialect, fmt: str = "T20") -> str:
    return f"""{s.base}, {_ml(fmt)},
g AS (SELECT venue_id, season, count(*) AS matches, {s.rate(count('toss_winner = winner'), 'count(*)', '1', 4)} AS toss_win_rate FROM ml WHERE {DECIDED} GROUP BY venue_id, season),
k AS (SELECT *, cast(row_number() OVER (PARTITION BY venue_id ORDER BY season DESC) as bigint) AS season_rank FROM g)
SELECT * FROM k WHERE season_rank <= 3"""


def v02_day_night(s: Dialect, fmt: str = "T20") -> str:
    a = 15 if fmt == "T20" else 40
    return f"""{s.base}, {_ml(fmt)},
w AS (SELECT venue_id, count(*) AS total_matches, {s.rate(count('winner IS NOT NULL AND batted_first IS NOT NULL AND winner <> batted_first'), count('winner IS NOT NULL AND batted_first IS NOT NULL'), '1', 4, '5e-1')} AS batting_second_win_pct FROM ml GROUP BY venue_id),
g AS (SELECT venue_id, {s.rate(total('runs_total', 'innings = 1'), count('innings = 1'), '6', 2)} AS rr1, {s.rate(total('runs_total', 'innings = 2'), count('innings = 2'), '6', 2)} AS rr2 FROM d WHERE fmt = '{fmt}' AND faced AND over_no >= {a} AND over_no < {overs(fmt)} GROUP BY venue_id),
x AS (SELECT w.venue_id, total_matches, batting_second_win_pct, coalesce(rr1, 0e0) AS death_overs_1st_innings_rr, coalesce(rr2, 0e0) AS death_overs_2nd_innings_rr,
  coalesce({s.r(s.clamp('(rr2 - rr1) / nullif(rr1, 0) * 10', '0e0', '10e0'), 2)}, 0e0) AS dew_factor_score FROM w LEFT JOIN g ON w.venue_id = g.venue_id)
SELECT *, CASE WHEN dew_factor_score >= 7 THEN 'heavy' WHEN dew_factor_score >= 4 THEN 'moderate' WHEN dew_factor_score >= 1 THEN 'slight' ELSE 'none' END AS dew_effect, '{'overs_16-20' if fmt == 'T20' else 'overs_41-50'}' AS strongest_effect_phase,
  CASE WHEN dew_factor_score >= 7 THEN 'Strong effect: sides batting second have a clear advantage in the last overs' WHEN dew_factor_score >= 4 THEN 'Moderate effect: some advantage for sides batting second in the last overs' WHEN dew_factor_score >= 1 THEN 'Mild effect: a slight advantage for sides batting second'
  WHEN dew_factor_score <= 0 AND death_overs_1st_innings_rr > 0 THEN 'No effect: the last overs of the first innings are as productive or more' ELSE 'Too few deliveries to tell' END AS dew_effect_interpretation FROM x"""


def _par(s: Dialect, fmt: str) -> str:
    return f"""{s.base}, {_ml(fmt)},
o AS (SELECT match_id, venue_id, over_no + 1 AS g, sum(runs_total) AS runs FROM d WHERE fmt = '{fmt}' AND innings = 1 GROUP BY 1, 2, 3),
mm AS (SELECT DISTINCT match_id, venue_id FROM o),
grid AS (SELECT mm.match_id, mm.venue_id, n.g FROM mm JOIN {s.grid(str(overs(fmt)))} n ON true),
c AS (SELECT grid.match_id, grid.venue_id, grid.g, sum(coalesce(o.runs, 0)) OVER (PARTITION BY grid.match_id ORDER BY grid.g) AS so_far FROM grid LEFT JOIN o ON grid.match_id = o.match_id AND grid.g = o.g)"""


def v03_par_progression(s: Dialect, fmt: str = "T20") -> str:
    return f"""{_par(s, fmt)}
SELECT venue_id, cast(g as bigint) AS over, {s.r('cast(median(so_far) as double)', 1)} AS par_runs FROM c GROUP BY venue_id, g"""


def v03_par_score(s: Dialect, fmt: str = "T20") -> str:
    return f"""{_par(s, fmt)},
t AS (SELECT c.venue_id, c.so_far AS total, ml.batted_first = ml.winner AS won FROM c JOIN ml ON c.match_id = ml.match_id WHERE c.g = {overs(fmt)}),
r AS (SELECT venue_id, count(*) AS matches_analyzed, {s.r('avg(total)', 1)} AS avg_first_innings_total, {s.r('cast(median(CASE WHEN won THEN total END) as double)', 1)} AS w FROM t GROUP BY venue_id)
SELECT venue_id, matches_analyzed, avg_first_innings_total, coalesce(w, avg_first_innings_total) AS winning_threshold, CASE WHEN matches_analyzed >= 30 THEN 'high' WHEN matches_analyzed >= 15 THEN 'medium' ELSE 'low' END AS confidence FROM r"""


def _sides(fmt: str) -> str:
    """Each match twice, once a team, with the innings it bats in (null if unknown)."""
    return f"""{_ml(fmt)},
sides AS (SELECT match_id, team1 AS team, winner, CASE WHEN batted_first = team1 THEN 1 WHEN batted_first IS NOT NULL THEN 2 END AS bats FROM ml
  UNION ALL SELECT match_id, team2, winner, CASE WHEN batted_first = team2 THEN 1 WHEN batted_first IS NOT NULL THEN 2 END FROM ml)"""


def t01_depth(s: Dialect, fmt: str = "T20") -> str:
    return f"""{s.base}, {_sides(fmt)},
b AS (SELECT match_id, innings, striker_id, min(delivery_id) AS first_ball, sum(runs_batter) AS runs FROM d WHERE fmt = '{fmt}' GROUP BY 1, 2, 3),
p AS (SELECT *, row_number() OVER (PARTITION BY match_id, innings ORDER BY first_ball) AS position FROM b),
i AS (SELECT match_id, innings, {total('runs')} AS runs, {total('runs', 'position <= 3')} AS top, {total('runs', 'position BETWEEN 4 AND 6')} AS mid, {total('runs', 'position > 6')} AS low FROM p GROUP BY 1, 2),
g AS (SELECT team, count(DISTINCT sides.match_id) AS matches_analyzed, {s.r('avg(i.runs)', 2)} AS avg_team_total, {s.r('avg(top / i.runs) * 100', 2)} AS top_order_pct, {s.r('avg(mid / i.runs) * 100', 2)} AS middle_order_pct, {s.r('avg(low / i.runs) * 100', 2)} AS lower_order_pct, count(*) AS sample_innings
  FROM sides JOIN i ON sides.match_id = i.match_id AND (sides.bats IS NULL OR sides.bats = i.innings) WHERE i.runs > 0 GROUP BY team)
SELECT *, {s.r(s.clamp('lower_order_pct / 100 * 10 + middle_order_pct / 100 * 5', '0e0', '10e0'), 2)} AS depth_score, CASE WHEN top_order_pct >= 65 THEN 'high' WHEN top_order_pct >= 50 THEN 'medium' ELSE 'low' END AS top_order_reliance FROM g"""


def t02_comeback(s: Dialect, fmt: str = "T20") -> str:
    pp, all_overs = (6, 20) if fmt == "T20" else (10, 50)
    half = all_overs // 2
    return f"""{s.base}, {_sides(fmt)},
i AS (SELECT match_id, innings, {count(f'over_no < {pp} AND {OUT}')} AS early, {total('runs_total')} AS runs, {total('runs_total', f'over_no < {half}')} AS at_half FROM d WHERE fmt = '{fmt}' GROUP BY 1, 2),
x AS (SELECT sides.team, sides.match_id, sides.winner, i.early, i.innings, i.at_half, f.runs AS first_runs FROM sides LEFT JOIN i ON sides.match_id = i.match_id AND sides.bats = i.innings LEFT JOIN i f ON f.match_id = sides.match_id AND f.innings = 1),
y AS (SELECT *, coalesce(early >= 3, false) OR coalesce(innings = 2 AND (coalesce(first_runs, 0) + 1 - at_half) / {all_overs - half} > 10.5, false) AS losing FROM x),
g AS (SELECT team, count(*) AS matches_analyzed, {count('losing')} AS losing_position_matches, {count('losing AND winner = team')} AS comebacks_won FROM y GROUP BY team),
r AS (SELECT *, {s.rate('comebacks_won', 'losing_position_matches', '1', 2)} AS comeback_index FROM g)
SELECT *, CASE WHEN comeback_index > 0.35 THEN 'elite' WHEN comeback_index > 0.2 THEN 'strong' WHEN comeback_index > 0.1 THEN 'average' ELSE 'fragile' END AS resilience FROM r"""


def t03_rivalry(s: Dialect, fmt: str = "T20") -> str:
    """Unordered pairs; the streak is the run of equal winners among the latest decided meetings."""
    return f"""{s.base}, {_ml(fmt)},
p AS (SELECT least(team1, team2) AS a, greatest(team1, team2) AS b, winner, match_id, match_date FROM ml),
c AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY match_date DESC, match_id DESC) AS k, first_value(winner) OVER (PARTITION BY a, b ORDER BY match_date DESC, match_id DESC) AS latest FROM p WHERE winner IS NOT NULL),
st AS (SELECT *, sum(CASE WHEN winner <> latest THEN 1 ELSE 0 END) OVER (PARTITION BY a, b ORDER BY k) AS breaks FROM c),
sk AS (SELECT a, b, max(latest) AS streak_team, {count('breaks = 0')} AS current_streak FROM st GROUP BY a, b),
five AS (SELECT a, b, {s.joined(f"concat({s.text('match_date')}, ' ', coalesce(winner, 'no result'))", ', ', 'k')} AS last_5_results FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY match_date DESC, match_id DESC) AS k FROM p) y WHERE k <= 5 GROUP BY a, b),
g AS (SELECT a, b, count(*) AS total_meetings, {count('winner = a')} AS team1_wins, {count('winner = b')} AS team2_wins, {count('winner IS NULL')} AS no_results FROM p GROUP BY a, b)
SELECT g.a AS team1, g.b AS team2, total_meetings, team1_wins, team2_wins, no_results, {s.rate('team1_wins', 'total_meetings', '1', 2)} AS team1_win_pct, last_5_results, streak_team, coalesce(current_streak, 0) AS current_streak,
  CASE WHEN team1_wins > team2_wins THEN g.a WHEN team2_wins > team1_wins THEN g.b ELSE 'even' END AS dominant_team FROM g LEFT JOIN sk ON g.a = sk.a AND g.b = sk.b JOIN five ON g.a = five.a AND g.b = five.b"""


def m01_pitch(s: Dialect, fmt: str = "T20", after_over: int = 3) -> str:
    """How the pitch plays from the first overs, against the venue's economy of pace bowling (75e-1 where it isn't known)."""
    few, plural = "n < 12", lambda x, word: f"CASE WHEN {x} = 1 THEN '{word}' ELSE '{word}s' END"
    rate = s.text("actual_run_rate")
    overs = f"{after_over} over{'s' if after_over != 1 else ''}"
    return f"""{s.base},
k AS (SELECT match_id, venue_id, wicket_type, count(*) AS n, {count('faced')} AS balls, {total('runs_total')} AS runs FROM d WHERE innings = 1 AND over_no < {after_over} GROUP BY 1, 2, 3),
kg AS (SELECT match_id, venue_id, cast(sum(n) as bigint) AS n, cast(sum(balls) as bigint) AS balls, cast(sum(runs) as bigint) AS runs, {total('n', OUT)} AS wickets, {s.counted('wicket_type', 'n')} AS out FROM k GROUP BY 1, 2),
g AS (SELECT kg.*, {s.at('out', 'bowled')} + {s.at('out', 'lbw')} AS straight, {s.at('out', 'caught')} AS w_caught, v.avg_pace_economy AS venue_economy FROM kg LEFT JOIN venues v ON kg.venue_id = v.venue_id),
r AS (SELECT *, {s.r('runs / greatest(balls, 1) * 6', 2)} AS rr, {s.r('straight / greatest(wickets, 1)', 2)} AS pi, w_caught / greatest(wickets, 1) AS bounce, coalesce(venue_economy, 75e-1) AS par FROM g),
c AS (SELECT match_id, n, venue_economy, straight, w_caught, CASE WHEN {few} THEN 0 ELSE {after_over} END AS overs_analyzed, CASE WHEN {few} THEN 0 ELSE wickets END AS wickets_in_sample, CASE WHEN {few} THEN 0e0 ELSE rr END AS actual_run_rate, CASE WHEN {few} THEN 0e0 ELSE pi END AS pace_indicator,
  CASE WHEN {few} THEN '' ELSE {s.listed('out')} END AS wicket_types,
  CASE WHEN {few} THEN 'insufficient_data' WHEN pi > 5e-1 AND rr < par THEN 'pace-friendly' WHEN bounce > 5e-1 THEN 'pace-friendly' WHEN rr > 9 THEN 'batting-friendly' WHEN wickets = 0 AND rr > 8 THEN 'batting-friendly' ELSE 'balanced' END AS classification FROM r)
SELECT match_id, overs_analyzed, wickets_in_sample, wicket_types, actual_run_rate, pace_indicator, classification, CASE WHEN wickets_in_sample <= 1 THEN 'low' WHEN wickets_in_sample <= 3 THEN 'medium' ELSE 'high' END AS confidence,
  CASE WHEN {few} OR venue_economy IS NULL THEN NULL WHEN abs(actual_run_rate - venue_economy) <= 3e-1 THEN 'at' WHEN actual_run_rate > venue_economy THEN 'above' ELSE 'below' END AS vs_venue_baseline,
  CASE WHEN {few} THEN 'Too few deliveries to classify the pitch.'
    WHEN classification = 'pace-friendly' AND wickets_in_sample > 0 THEN concat({s.text('wickets_in_sample')}, ' ', {plural('wickets_in_sample', 'wicket')}, ' in {overs} with ', CASE WHEN straight > 0 AND w_caught > 0 THEN concat({s.text('straight')}, ' bowled/LBW, ', {s.text('w_caught')}, ' caught') WHEN straight > 0 THEN concat({s.text('straight')}, ' bowled/LBW') WHEN w_caught > 0 THEN concat({s.text('w_caught')}, ' caught') ELSE 'dismissals' END, ': there is seam movement.')
    WHEN classification = 'batting-friendly' AND venue_economy IS NOT NULL THEN concat({rate}, ' an over in {overs}, against a venue average of ', {s.text(s.r('venue_economy', 2))}, ': a flat track.')
    WHEN classification = 'batting-friendly' THEN concat({rate}, ' an over in {overs}: a flat track.')
    ELSE concat({rate}, ' an over with ', {s.text('wickets_in_sample')}, ' ', {plural('wickets_in_sample', 'wicket')}, ' in {overs}: balanced.') END AS interpretation FROM c"""


def _curve(s: Dialect) -> str:
    w = "PARTITION BY match_id, innings ORDER BY delivery_id"
    first = s.r(s.clamp("5e-1 - wk / 10 * 2e-1", "5e-2", "95e-2"), 2)
    chase = f"CASE WHEN need <= 0 THEN 95e-2 WHEN remaining = 0 THEN 5e-2 ELSE {s.r(s.clamp('8 / (need / (remaining / 6)) * 5e-1', '5e-2', '95e-2'), 2)} END"
    return f"""{s.base},
u AS (SELECT match_id, innings, over_no, delivery_id, over_ball, striker_id, bowler_id, runs_total, wicket_type, sum(CASE WHEN {OUT} THEN 1 ELSE 0 END) OVER ({w}) AS wk, sum(runs_total) OVER ({w}) AS rs, sum(CASE WHEN faced THEN 1 ELSE 0 END) OVER ({w}) AS bs FROM {s.parted('d', 'match_id')}),
tg AS (SELECT match_id, sum(runs_total) + 1 AS target FROM d WHERE innings = 1 GROUP BY match_id),
v AS (SELECT u.*, greatest(coalesce(target, 1) - rs, 0) AS need, greatest(120 - bs, 0) AS remaining FROM u LEFT JOIN tg ON u.match_id = tg.match_id),
x AS (SELECT *, {chase} AS raw, {first} AS wp1 FROM v)"""


def _momentum(s: Dialect) -> str:
    return f"""{_curve(s)},
y AS (SELECT *, CASE WHEN innings = 1 THEN wp1 ELSE {s.r(s.clamp('raw - wk * 25e-3', '5e-2', '95e-2'), 2)} END AS wp_batting_team FROM x),
z AS (SELECT *, coalesce({s.r('wp_batting_team - lag(wp_batting_team) OVER (PARTITION BY match_id, innings ORDER BY delivery_id)', 2)}, CASE WHEN innings = 1 THEN 0e0 ELSE {s.r('wp_batting_team - 5e-1', 2)} END) AS wp_delta FROM y),
curve AS (SELECT match_id, innings, delivery_id, over_ball, CASE WHEN runs_total >= 4 THEN 'boundary' WHEN {OUT} THEN 'wicket' WHEN runs_total = 0 THEN 'dot' ELSE 'normal' END AS event, cast(runs_total as bigint) AS runs_this_ball, wicket_type, wp_batting_team, wp_delta FROM z)"""


def m02_momentum(s: Dialect, fmt: str = "T20") -> str:
    return f"{_momentum(s)}\nSELECT * FROM curve"


def m02_turning_point(s: Dialect, fmt: str = "T20") -> str:
    return f"""{_momentum(s)},
k AS (SELECT match_id, delivery_id, innings, event, wp_delta, cast(row_number() OVER (PARTITION BY match_id ORDER BY abs(wp_delta) DESC, delivery_id) as bigint) AS rank FROM curve)
SELECT * FROM k WHERE rank <= 3"""


def m03_turning_overs(s: Dialect, fmt: str = "T20") -> str:
    wp2 = f"CASE WHEN need <= 0 THEN 95e-2 WHEN remaining = 0 THEN 5e-2 ELSE {s.r(s.clamp('8 / (need / (remaining / 6)) * 5e-1 - wk * 25e-3', '5e-2', '95e-2'), 2)} END"
    return f"""{_curve(s)},
o AS (SELECT match_id, innings, over_no, max(delivery_id) AS last_ball, cast(sum(runs_total) as bigint) AS runs FROM x GROUP BY 1, 2, 3),
e AS (SELECT o.match_id, o.innings, o.over_no, o.runs, CASE WHEN o.innings = 1 THEN wp1 ELSE {wp2} END AS wp_after FROM o JOIN x ON o.last_ball = x.delivery_id),
w AS (SELECT *, lag(wp_after, 1, 5e-1) OVER (PARTITION BY match_id, innings ORDER BY over_no) AS wp_before FROM e),
kb AS (SELECT match_id, innings, over_no, striker_id, bowler_id, wicket_type, row_number() OVER (PARTITION BY match_id, innings, over_no ORDER BY CASE WHEN {OUT} THEN 0 ELSE 1 END, CASE WHEN {OUT} THEN 0 ELSE -runs_total END, delivery_id) AS k FROM x),
r AS (SELECT w.match_id, w.innings, w.over_no + 1 AS over, w.runs, wp_before, wp_after, {s.r('wp_after - wp_before', 2)} AS wp_swing, striker_id, bowler_id, wicket_type FROM w JOIN kb ON w.match_id = kb.match_id AND w.innings = kb.innings AND w.over_no = kb.over_no AND kb.k = 1),
t AS (SELECT *, cast(row_number() OVER (PARTITION BY match_id ORDER BY abs(wp_swing) DESC, innings, over) as bigint) AS rank FROM r)
SELECT *, concat('Over ', {s.text('over')}, ' (innings ', {s.text('innings')}, '): ', {s.text('runs')}, ' runs', CASE WHEN {OUT} THEN concat(', wicket (', wicket_type, ')') ELSE '' END, ' swung win probability ', CASE WHEN wp_swing >= 0 THEN '+' ELSE '' END, {s.text('wp_swing')}, ' toward the ', CASE WHEN innings = 2 THEN 'chasing side' ELSE 'batting side' END, '.') AS description FROM t WHERE rank <= 5"""


def l01_final_over_bowlers(s: Dialect, fmt: str = "T20", limit: int = 10) -> str:
    return f"""{s.base},
g AS (SELECT league_id, bowler_id AS player_id, {count('faced')} AS balls, {total('runs_total')} AS runs_conceded, {count(f'faced AND {OUT}')} AS wickets FROM d WHERE innings = 2 AND over_no = CASE WHEN fmt = 'ODI' THEN 49 ELSE 19 END GROUP BY 1, 2),
r AS (SELECT *, {s.rate('runs_conceded', 'balls', '6', 2)} AS economy FROM g WHERE balls >= 10),
k AS (SELECT *, cast(row_number() OVER (PARTITION BY league_id ORDER BY economy, player_id) as bigint) AS rank FROM r)
SELECT k.*, coalesce(p.name, {s.text('k.player_id')}) AS name, concat({s.text('balls')}, ' balls in final over') AS qualification FROM k LEFT JOIN players p ON k.player_id = p.player_id WHERE rank <= {limit}"""


def l01_final_over_batters(s: Dialect, fmt: str = "T20", limit: int = 10) -> str:
    return f"""{s.base},
g AS (SELECT league_id, striker_id AS player_id, count(*) AS balls, {total('runs_batter')} AS runs, {count('runs_batter = 6')} AS sixes, {count('runs_batter = 4')} AS fours FROM d WHERE faced AND innings = 2 AND over_no = CASE WHEN fmt = 'ODI' THEN 49 ELSE 19 END GROUP BY 1, 2),
r AS (SELECT *, {s.rate('runs', 'balls', '100', 2)} AS strike_rate FROM g WHERE balls >= 10),
k AS (SELECT *, cast(row_number() OVER (PARTITION BY league_id ORDER BY strike_rate DESC, player_id) as bigint) AS rank FROM r)
SELECT k.*, coalesce(p.name, {s.text('k.player_id')}) AS name, concat({s.text('balls')}, ' balls in final over') AS qualification FROM k LEFT JOIN players p ON k.player_id = p.player_id WHERE rank <= {limit}"""


def _matchups(s: Dialect, fmt: str, asked: bool = False) -> str:
    """CTEs up to mu: the bowlers of each batter, ranked. All who met, or those asked for in `attacks`, without a ball too."""
    own = "JOIN a ON d.striker_id = a.batter_id AND d.bowler_id = a.player_id" if asked else ""
    sums = f"SELECT striker_id AS batter_id, bowler_id AS player_id, count(*) AS balls_faced, {total('runs_batter')} AS runs, {count(OUT)} AS dismissals FROM d {own} WHERE fmt = '{fmt}' AND faced GROUP BY 1, 2"
    if asked:
        zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("balls_faced", "runs", "dismissals"))
        g = f"a AS (SELECT DISTINCT batter_id, bowler_id AS player_id FROM attacks),\ngb AS ({sums}),\ng AS (SELECT a.*, {zero} FROM a LEFT JOIN gb ON a.batter_id = gb.batter_id AND a.player_id = gb.player_id)"
    else:
        g = f"g AS ({sums})"
    return f"""{s.base},
{g},
r AS (SELECT *, {s.rate('runs', 'balls_faced', '100', 2)} AS sr_conceded, {s.rate('dismissals', 'balls_faced', '10', 2)} AS dismissal_rate FROM g),
mu AS (SELECT r.*, CASE WHEN balls_faced >= 20 THEN 'high' WHEN balls_faced >= 10 THEN 'medium' ELSE 'low' END AS confidence, cast(row_number() OVER (PARTITION BY batter_id ORDER BY dismissal_rate DESC, sr_conceded, r.player_id) as bigint) AS rank, coalesce(p.name, {s.text('r.player_id')}) AS name FROM r LEFT JOIN players p ON r.player_id = p.player_id)"""


def _recommended(s: Dialect, ranked: str) -> str:
    return f"""{ranked},
f AS (SELECT batter_id, {s.joined('name', ', ', 'rank')} AS names FROM mu WHERE confidence = 'low' GROUP BY batter_id)
SELECT mu.batter_id, CASE WHEN balls_faced = 0 THEN 'No choice: too little is known of them against each other' WHEN dismissals > 0 THEN concat(name, ' is the most effective choice (', {s.text('dismissals')}, CASE WHEN dismissals = 1 THEN ' dismissal in ' ELSE ' dismissals in ' END, {s.text('balls_faced')}, ' balls, strike rate ', {s.text('sr_conceded')}, ')')
  ELSE concat(name, ' concedes the lowest strike rate (', {s.text('sr_conceded')}, ' in ', {s.text('balls_faced')}, ' balls)') END AS recommendation, CASE WHEN f.names IS NOT NULL THEN concat('Few balls for: ', f.names) END AS caveat
FROM mu LEFT JOIN f ON mu.batter_id = f.batter_id WHERE rank = 1"""


def u01_bowler_matchups(s: Dialect, fmt: str = "T20") -> str:
    return f"{_matchups(s, fmt)}\nSELECT * FROM mu"


def u01_recommendation(s: Dialect, fmt: str = "T20") -> str:
    """The bowler to choose against each batter, and whose figures rest on few balls."""
    return _recommended(s, _matchups(s, fmt))


def u01_asked_matchups(s: Dialect, fmt: str = "T20") -> str:
    """The bowlers asked for, ranked against each batter; a bowler who never bowled to the batter has zeros."""
    return f"{_matchups(s, fmt, True)}\nSELECT * FROM mu"


def u01_asked_recommendation(s: Dialect, fmt: str = "T20") -> str:
    return _recommended(s, _matchups(s, fmt, True))


def u02_partnerships(s: Dialect, fmt: str = "T20") -> str:
    return f"""{s.base},
m AS (SELECT least(striker_id, non_striker_id) AS batter1_id, greatest(striker_id, non_striker_id) AS batter2_id, match_id, {total('runs_total')} AS runs, {count('legal')} AS balls FROM d WHERE fmt = '{fmt}' AND non_striker_id IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT batter1_id, batter2_id, count(*) AS partnerships, {total('runs')} AS total_runs, {total('balls')} AS total_balls, max(runs) AS best_partnership FROM m GROUP BY 1, 2),
o AS (SELECT striker_id AS player_id, {s.rate('sum(runs_batter)', 'count(*)', '100', 2)} AS sr FROM d WHERE faced GROUP BY striker_id),
r AS (SELECT g.*, {s.rate('total_runs', 'total_balls', '100', 2)} AS combined_sr, {s.rate('total_runs', 'partnerships', '1', 2)} AS runs_per_partnership, (coalesce(a.sr, 0e0) + coalesce(b.sr, 0e0)) / 2 AS baseline FROM g LEFT JOIN o a ON g.batter1_id = a.player_id LEFT JOIN o b ON g.batter2_id = b.player_id),
x AS (SELECT batter1_id, batter2_id, partnerships, total_runs, total_balls, best_partnership, combined_sr, runs_per_partnership, {s.r('combined_sr - baseline', 2)} AS chemistry_delta FROM r)
SELECT *, CASE WHEN chemistry_delta > 10 AND partnerships >= 5 THEN 'elite_pairing' WHEN chemistry_delta < -10 THEN 'underwhelming' WHEN partnerships >= 5 THEN 'solid' ELSE 'average' END AS verdict FROM x"""


#: States that the registered queries ask about: innings, completed overs, wickets, runs, target.
STATES = [(i, o, w, r, t) for i, o, w, r, t in [(1, 6, 1, 50, None), (1, 6, 2, 45, None), (1, 10, 2, 80, None), (1, 10, 4, 70, None), (1, 15, 3, 130, None), (1, 15, 6, 110, None), (1, 18, 5, 160, None), (2, 6, 1, 50, 170), (2, 6, 3, 40, 150), (2, 10, 2, 85, 165), (2, 10, 5, 60, 180), (2, 15, 4, 120, 160), (2, 15, 7, 100, 175), (2, 18, 5, 150, 168), (2, 10, 9, 10, 400)]]


def states(rows=STATES) -> str:
    cells = ", ".join(f"({k}, {i}, {o}, {w}, {r}, {'cast(null as int)' if t is None else t})" for k, (i, o, w, r, t) in enumerate(rows))
    return f"st AS (SELECT * FROM (VALUES {cells}) AS v(state_id, innings, overs_done, wickets, runs, target))"


def _similar(s: Dialect, fmt: str, near: int, far: int) -> str:
    """Matches in a like state: a narrow band of runs and wickets, or a wide one where the narrow is empty. The states are a short list of parameters."""
    return f"""{s.base}, {states()},
ov AS (SELECT match_id, innings, over_no, sum(runs_total) AS runs, sum(CASE WHEN {OUT} THEN 1 ELSE 0 END) AS outs FROM d WHERE fmt = '{fmt}' GROUP BY 1, 2, 3),
ats AS (SELECT st.state_id, ov.match_id, sum(ov.runs) AS at_runs, sum(ov.outs) AS at_wickets FROM ov JOIN st ON ov.innings = st.innings AND ov.over_no <= st.overs_done - 1 GROUP BY st.state_id, ov.match_id),
bands AS (SELECT ats.state_id, ats.match_id, abs(at_wickets - st.wickets) <= 1 AND abs(at_runs - st.runs) <= {near} AS narrow FROM ats JOIN st ON ats.state_id = st.state_id WHERE abs(at_wickets - st.wickets) <= 2 AND abs(at_runs - st.runs) <= {far}),
chosen AS (SELECT state_id, match_id FROM (SELECT *, max(CASE WHEN narrow THEN 1 ELSE 0 END) OVER (PARTITION BY state_id) AS has FROM bands) x WHERE narrow OR has = 0)"""


CONFIDENCE = "CASE WHEN sample_size > 100 THEN 'high' WHEN sample_size >= 30 THEN 'medium' ELSE 'low' END AS confidence"


def o01_win_probability(s: Dialect, fmt: str = "T20") -> str:
    return f"""{_similar(s, fmt, 15, 30)},
g AS (SELECT st.state_id, {count('m.match_id IS NOT NULL')} AS sample_size, {count('st.innings = 1 AND m.winner = m.team1 OR st.innings = 2 AND m.winner = m.team2')} AS wins FROM st LEFT JOIN chosen c ON st.state_id = c.state_id LEFT JOIN matches m ON c.match_id = m.match_id GROUP BY st.state_id),
x AS (SELECT st.*, sample_size, {s.rate('wins', 'sample_size', '1', 4, '5e-1')} AS p, greatest(target - runs, 0) AS runs_needed, ({overs(fmt)} - overs_done) * 6 AS balls_remaining FROM g JOIN st ON g.state_id = st.state_id),
y AS (SELECT *, {s.r('runs_needed / nullif(balls_remaining, 0) * 6', 2)} AS required_rr FROM x)
SELECT state_id, innings, overs_done, wickets, runs, target, sample_size, CASE WHEN required_rr > {36 if fmt == 'T20' else 20} THEN least(p, 2e-2) ELSE p END AS win_probability, runs_needed, balls_remaining, required_rr, {CONFIDENCE} FROM y"""


def check_state(innings: int, overs_done: int, wickets: int, runs: int, target: int | None, fmt: str = "T20") -> None:
    """Raises ValueError for a state of a match that can't be."""
    if innings not in (1, 2) or not 0 <= wickets <= 10 or runs < 0:
        raise ValueError("innings must be 1 or 2, wickets 0 to 10 and runs no less than 0")
    if innings == 2 and target is None:
        raise ValueError("a chase needs a target")
    if not 1 <= overs_done <= overs(fmt):
        raise ValueError(f"overs must be 1 to {overs(fmt)} in {fmt}")


def o01_blueprint(s: Dialect, fmt: str = "T20") -> str:
    """For every chase played, after some overs of it: what a chase at a steady rate has scored by the milestone overs that lie ahead, one short of the target at most."""
    done, ahead = ((6, 10, 15), (10, 15, 18, 19)) if fmt == "T20" else ((10, 25, 40), (20, 30, 40, 45, 48, 49))
    rows = lambda xs: ", ".join(f"({x})" for x in xs)
    return f"""{s.base},
tg AS (SELECT match_id, sum(runs_total) + 1 AS target FROM d WHERE fmt = '{fmt}' AND innings = 1 GROUP BY match_id),
ov AS (SELECT match_id, over_no, sum(runs_total) AS runs FROM d WHERE fmt = '{fmt}' AND innings = 2 GROUP BY 1, 2),
st AS (SELECT ov.match_id, p.overs_done, sum(ov.runs) AS runs, max(over_no) AS last_over FROM ov JOIN (SELECT * FROM (VALUES {rows(done)}) AS v(overs_done)) p ON ov.over_no < p.overs_done GROUP BY 1, 2),
o AS (SELECT * FROM (VALUES {rows(ahead)}) AS v(over))
SELECT st.match_id, overs_done, over, cast(least(runs + {s.r(f'greatest(target - runs, 0) * ((over - overs_done) * 6) / greatest(({overs(fmt)} - overs_done) * 6, 1)', 0)}, target - 1) as bigint) AS target_runs_by_end
FROM st JOIN tg ON st.match_id = tg.match_id JOIN o ON o.over > st.overs_done WHERE last_over = overs_done - 1"""


def o02_collapse(s: Dialect, fmt: str = "T20") -> str:
    return f"""{_similar(s, fmt, 20, 35)},
wn AS (SELECT c.state_id, d.match_id, d.delivery_id, d.runs_total, d.wicket_type, row_number() OVER (PARTITION BY c.state_id, d.match_id ORDER BY d.delivery_id) AS k
  FROM chosen c JOIN st ON c.state_id = st.state_id JOIN d ON d.match_id = c.match_id AND d.innings = st.innings AND d.over_no >= st.overs_done - 1 AND d.over_no <= st.overs_done + 4),
w AS (SELECT state_id, match_id, sum(runs_total) AS r, sum(CASE WHEN {OUT} THEN 1 ELSE 0 END) AS o, min_by(wicket_type, CASE WHEN {OUT} THEN k END) AS first_kind FROM wn WHERE k <= 30 GROUP BY 1, 2),
g AS (SELECT state_id, count(*) AS sample_size, {s.rate(count('o >= 3'), 'count(*)', '1', 4)} AS collapse_probability, {s.r('avg(CASE WHEN o >= 3 THEN r END)', 1)} AS expected_runs_if_collapse, {s.r('avg(CASE WHEN o < 3 THEN r END)', 1)} AS expected_runs_if_no_collapse FROM w GROUP BY state_id),
k AS (SELECT state_id, first_kind, row_number() OVER (PARTITION BY state_id ORDER BY count(*) DESC, first_kind) AS k FROM w WHERE o >= 3 GROUP BY state_id, first_kind)
SELECT st.state_id, coalesce(sample_size, 0) AS sample_size, coalesce(collapse_probability, 0e0) AS collapse_probability, k.first_kind AS most_common_trigger, expected_runs_if_collapse, expected_runs_if_no_collapse, {CONFIDENCE.replace('sample_size', 'coalesce(sample_size, 0)')}
FROM st LEFT JOIN g ON st.state_id = g.state_id LEFT JOIN k ON st.state_id = k.state_id AND k.k = 1"""


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "vtmluo" and k[1:3].isdigit()}
