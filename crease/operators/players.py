"""Player questions over all players at once, one row per grain; `s` is the dialect."""

from __future__ import annotations

from crease.functions.dialect import Dialect, count, phase, total

OUT = "wicket_type IS NOT NULL"


def label(x: str, ladder: list[tuple[str, str]], other: str) -> str:
    """The first label whose condition on `x` holds."""
    return "CASE " + " ".join(f"WHEN {x} {c} THEN '{v}'" for c, v in ladder) + f" ELSE '{other}' END"


def p01_clutch(s: Dialect, fmt: str = "T20") -> str:
    """Second innings from over 15: batting and bowling of each player."""
    return f"""{s.base},
bat AS (SELECT striker_id AS player_id, {count('faced')} AS balls, {total('runs_batter', 'faced')} AS runs, {count(f'faced AND {OUT}')} AS outs FROM d WHERE innings = 2 AND over_no >= 15 GROUP BY striker_id),
bowl AS (SELECT bowler_id AS player_id, {count('legal')} AS balls, {total('runs_total', 'legal')} AS runs FROM d WHERE innings = 2 AND over_no >= 15 GROUP BY bowler_id),
j AS (SELECT coalesce(bat.player_id, bowl.player_id) AS player_id, coalesce(bat.balls, 0) AS clutch_deliveries, {s.rate('bat.runs', 'bat.balls', '100', 2)} AS clutch_batting_sr, {s.rate('bat.runs', 'bat.outs', '1', 2, 'null')} AS clutch_batting_avg,
  {s.rate('bowl.runs', 'bowl.balls', '6', 2, 'null')} AS clutch_bowling_economy FROM bat FULL JOIN bowl ON bat.player_id = bowl.player_id),
i AS (SELECT *, {s.r(s.clamp('clutch_batting_sr / 150 * 10', '0e0', '10e0'), 2)} AS clutch_index FROM j)
SELECT *, {label('clutch_index', [('>= 7.5', 'elite_clutch'), ('>= 5.5', 'clutch'), ('>= 3.5', 'average')], 'poor')} AS signal FROM i"""


def _phases(s: Dialect, fmt: str) -> str:
    return f"""{s.base},
p AS (SELECT striker_id AS player_id, {phase(fmt)} AS phase, {count('faced')} AS balls, {total('runs_batter', 'faced')} AS runs, {count('faced AND runs_batter IN (4, 6)')} AS boundaries,
  {count('faced AND runs_batter = 0')} AS dots, {count(f'faced AND {OUT}')} AS dismissals FROM d WHERE fmt = '{fmt}' GROUP BY 1, 2),
q AS (SELECT player_id, phase, balls, runs, {s.rate('runs', 'balls', '100', 2)} AS sr, boundaries, {s.rate('boundaries', 'balls', '1', 4)} AS boundary_pct, {s.rate('dots', 'balls', '1', 4)} AS dot_pct, dismissals FROM p WHERE balls > 0)"""


def p02_phase_profile(s: Dialect, fmt: str = "T20") -> str:
    return f"{_phases(s, fmt)}\nSELECT * FROM q"


def p02_acceleration(s: Dialect, fmt: str = "T20") -> str:
    return f"""{_phases(s, fmt)},
a AS (SELECT player_id, {s.r("coalesce(max(sr) FILTER (WHERE phase = 'death'), 0e0) - coalesce(max(sr) FILTER (WHERE phase = 'powerplay'), 0e0)", 2)} AS acceleration_score FROM q GROUP BY player_id)
SELECT *, {label('acceleration_score', [('> 20', 'finisher'), ('< -20', 'anchor')], 'allround')} AS player_type FROM a"""


def p03_pressure(s: Dialect, fmt: str = "T20") -> str:
    """Dot streaks are islands; a boundary's wicket is the first within the same match with no wicket between."""
    w = "PARTITION BY bowler_id, match_id ORDER BY delivery_id"
    return f"""{s.base},
l AS (SELECT bowler_id, match_id, innings, over_no, delivery_id, runs_total, {OUT} AS out, row_number() OVER ({w}) AS rn FROM d WHERE fmt = '{fmt}' AND legal),
e AS (SELECT *, sum(CASE WHEN runs_total > 0 THEN 1 ELSE 0 END) OVER ({w}) AS island, max(CASE WHEN runs_total >= 4 THEN rn END) OVER ({w}) AS last_boundary, max(CASE WHEN out THEN rn END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_out FROM l),
streaks AS (SELECT bowler_id, {s.r('avg(n)', 2)} AS avg_consecutive_dots, max(n) AS max_dot_streak FROM (SELECT bowler_id, match_id, island, count(*) AS n FROM e WHERE runs_total = 0 GROUP BY bowler_id, match_id, island) x GROUP BY bowler_id),
maidens AS (SELECT bowler_id, {count('r = 0')} AS maidens, count(*) AS overs FROM (SELECT bowler_id, match_id, innings, over_no, sum(runs_total) AS r FROM l GROUP BY 1, 2, 3, 4) x GROUP BY bowler_id),
t AS (SELECT bowler_id, count(*) AS total_balls, {total('runs_total')} AS total_runs, {count('runs_total = 0')} AS dots, {count('runs_total >= 4')} AS boundaries,
  {count('out AND last_boundary IS NOT NULL AND (last_out IS NULL OR last_out < last_boundary) AND rn - last_boundary <= 3')} AS quick FROM e GROUP BY bowler_id),
m AS (SELECT t.bowler_id AS player_id, total_balls, total_runs, {s.rate('total_runs', 'total_balls', '6', 2)} AS economy, {s.rate('dots', 'total_balls', '1', 4)} AS dot_pct, coalesce(avg_consecutive_dots, 0e0) AS avg_consecutive_dots, coalesce(max_dot_streak, 0) AS max_dot_streak,
  {s.rate('maidens', 'overs', '1', 4)} AS maiden_rate, {s.rate('quick', 'boundaries', '1', 4)} AS wicket_after_boundary_rate FROM t LEFT JOIN streaks ON t.bowler_id = streaks.bowler_id LEFT JOIN maidens ON t.bowler_id = maidens.bowler_id)
SELECT *, {s.r(s.clamp('(dot_pct * 4 + maiden_rate * 3 + (1 - least(economy / 12, 1e0)) * 3) * 10', '0e0', '10e0'), 2)} AS pressure_score,
  CASE WHEN dot_pct > 0.5 AND economy < 7 THEN 'strangler' WHEN wicket_after_boundary_rate > 0.2 THEN 'comeback-king' ELSE 'containment' END AS archetype FROM m"""


KINDS = ["caught", "bowled", "lbw", "run out", "stumped"]


def p04_dismissals(s: Dialect, fmt: str = "T20") -> str:
    kinds = ", ".join(f"{count(f'wicket_type = {chr(39)}{k}{chr(39)}')} AS {k.replace(' ', '_')}" for k in KINDS)
    return f"""{s.base},
p AS (SELECT striker_id AS player_id, {phase(fmt)} AS phase, count(*) AS balls, {kinds}, {count(f"{OUT} AND wicket_type NOT IN ({', '.join(repr(k) for k in KINDS)})")} AS other, {count(OUT)} AS dismissals FROM d WHERE fmt = '{fmt}' AND faced GROUP BY 1, 2)
SELECT *, {s.rate('dismissals', 'balls', '100', 2)} AS dismissal_rate_per_100 FROM p"""


def p04_danger_zone(s: Dialect, fmt: str = "T20") -> str:
    return f"""{s.base},
p AS (SELECT striker_id AS player_id, {phase(fmt)} AS phase, count(*) AS balls, {count(OUT)} AS outs FROM d WHERE fmt = '{fmt}' AND faced GROUP BY 1, 2),
z AS (SELECT player_id, phase, row_number() OVER (PARTITION BY player_id ORDER BY {s.rate('outs', 'balls', '100', 2)} DESC, CASE phase WHEN 'powerplay' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END) AS k FROM p WHERE outs > 0),
k AS (SELECT striker_id AS player_id, wicket_type, row_number() OVER (PARTITION BY striker_id ORDER BY count(*) DESC, wicket_type) AS k FROM d WHERE fmt = '{fmt}' AND faced AND {OUT} GROUP BY striker_id, wicket_type),
t AS (SELECT player_id, cast(sum(outs) as bigint) AS total_dismissals FROM p GROUP BY player_id)
SELECT t.player_id, total_dismissals, k.wicket_type AS most_common_dismissal, z.phase AS danger_zone_phase FROM t LEFT JOIN z ON t.player_id = z.player_id AND z.k = 1 LEFT JOIN k ON t.player_id = k.player_id AND k.k = 1"""


def p06_nemesis_of_batter(s: Dialect, fmt: str = "T20") -> str:
    return f"""{s.base},
g AS (SELECT striker_id AS player_id, bowler_id AS opponent_id, count(*) AS balls, {count(OUT)} AS dismissals FROM d GROUP BY 1, 2),
r AS (SELECT *, {s.rate('dismissals', 'balls', '10', 3)} AS rate FROM g WHERE balls >= 10 AND dismissals >= 1),
k AS (SELECT *, cast(row_number() OVER (PARTITION BY player_id ORDER BY rate DESC, opponent_id) as bigint) AS rank FROM r)
SELECT k.player_id, k.rank, k.opponent_id, k.balls, k.dismissals, k.rate, coalesce(p.name, {s.text('k.opponent_id')}) AS opponent_name FROM k LEFT JOIN players p ON k.opponent_id = p.player_id WHERE k.rank <= 5"""


def p06_nemesis_of_bowler(s: Dialect, fmt: str = "T20") -> str:
    return f"""{s.base},
g AS (SELECT bowler_id AS player_id, striker_id AS opponent_id, count(*) AS balls, {total('runs_batter')} AS runs FROM d WHERE faced GROUP BY 1, 2),
r AS (SELECT *, {s.rate('runs', 'balls', '100', 2)} AS rate FROM g WHERE balls >= 10),
k AS (SELECT *, cast(row_number() OVER (PARTITION BY player_id ORDER BY rate DESC, opponent_id) as bigint) AS rank FROM r)
SELECT k.player_id, k.rank, k.opponent_id, k.balls, k.runs, k.rate, coalesce(p.name, {s.text('k.opponent_id')}) AS opponent_name FROM k LEFT JOIN players p ON k.opponent_id = p.player_id WHERE k.rank <= 5"""


BUCKETS = ["1_10", "11_20", "21_30", "31_40", "40_plus"]


def _faced(s: Dialect, fmt: str) -> str:
    """Balls faced with their number in the innings and its bucket."""
    return f"""{s.base},
f AS (SELECT striker_id AS player_id, match_id, innings, delivery_id, runs_batter, row_number() OVER (PARTITION BY striker_id, match_id, innings ORDER BY delivery_id) AS n FROM d WHERE fmt = '{fmt}' AND faced),
b AS (SELECT *, CASE WHEN n <= 10 THEN '1_10' WHEN n <= 20 THEN '11_20' WHEN n <= 30 THEN '21_30' WHEN n <= 40 THEN '31_40' ELSE '40_plus' END AS zone FROM f)"""


def _ignition(threshold: int, prefix: str = "balls_") -> str:
    return "CASE " + " ".join(f"WHEN sr_{k} >= {threshold} THEN '{prefix}{k}'" for k in BUCKETS) + " END"


def p09_rhythm(s: Dialect, fmt: str = "T20") -> str:
    w = "PARTITION BY player_id, match_id, innings ORDER BY n"
    sr = ", ".join(f"{s.rate(total('runs_batter', f'zone = {chr(39)}{k}{chr(39)}'), count(f'zone = {chr(39)}{k}{chr(39)}'), '100', 2)} AS sr_{k}" for k in BUCKETS)
    return f"""{_faced(s, fmt)},
z AS (SELECT player_id, {sr}, count(DISTINCT match_id * 2 + innings) AS innings_analyzed FROM b GROUP BY player_id),
i AS (SELECT *, sum(CASE WHEN runs_batter > 0 THEN 1 ELSE 0 END) OVER ({w}) AS island FROM f),
dots AS (SELECT player_id, {s.r('avg(k)', 2)} AS avg_dot_streak FROM (SELECT player_id, match_id, innings, island, count(*) AS k FROM i WHERE runs_batter = 0 GROUP BY 1, 2, 3, 4) x GROUP BY player_id),
h AS (SELECT *, CASE WHEN n - lag(n) OVER ({w}) <= 3 THEN 0 ELSE 1 END AS fresh FROM f WHERE runs_batter IN (4, 6)),
c AS (SELECT *, sum(fresh) OVER ({w}) AS cluster FROM h),
clusters AS (SELECT player_id, {s.r('avg(k)', 2)} AS boundary_clustering_score FROM (SELECT player_id, match_id, innings, cluster, count(*) AS k FROM c GROUP BY 1, 2, 3, 4) x GROUP BY player_id)
SELECT z.*, coalesce(avg_dot_streak, 0e0) AS avg_dot_streak, coalesce(boundary_clustering_score, 0e0) AS boundary_clustering_score,
  CASE WHEN sr_21_30 > sr_1_10 + 20 THEN 'slow-starter' WHEN sr_1_10 > sr_21_30 + 20 THEN 'instant-accelerator' ELSE 'steady-state' END AS player_archetype, {_ignition(150 if fmt == 'T20' else 100)} AS ignition_point
FROM z LEFT JOIN dots ON z.player_id = dots.player_id LEFT JOIN clusters ON z.player_id = clusters.player_id"""


def p16_zones(s: Dialect, fmt: str = "T20") -> str:
    return f"""{_faced(s, fmt)},
g AS (SELECT player_id, zone, count(*) AS balls, {total('runs_batter')} AS runs, {count('runs_batter IN (4, 6)')} AS fours_and_sixes FROM b GROUP BY player_id, zone),
r AS (SELECT player_id, zone, {s.rate('runs', 'balls', '100', 2)} AS sr, {s.rate('fours_and_sixes', 'balls', '1', 4)} AS boundary_pct, runs, balls FROM g)
SELECT *, coalesce(balls >= 20 AND row_number() OVER (PARTITION BY player_id ORDER BY CASE WHEN balls >= 20 THEN sr END DESC NULLS LAST, zone) = 1, false) AS is_peak,
  row_number() OVER (PARTITION BY player_id ORDER BY CASE WHEN sr >= {150 if fmt == 'T20' else 100} THEN 0 ELSE 1 END, CASE zone WHEN '1_10' THEN 0 WHEN '11_20' THEN 1 WHEN '21_30' THEN 2 WHEN '31_40' THEN 3 ELSE 4 END) = 1 AND sr >= {150 if fmt == 'T20' else 100} AS is_ignition FROM r"""


def p10_milestones(s: Dialect, fmt: str = "T20", final: bool = True) -> str:
    ctes = f"""{_faced(s, fmt)},
u AS (SELECT *, coalesce(sum(runs_batter) OVER (PARTITION BY player_id, match_id, innings ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
o AS (SELECT player_id, {s.rate('sum(runs_batter)', 'count(*)', '100', 2)} AS overall_sr FROM f GROUP BY player_id),
w AS (SELECT player_id, CASE WHEN before BETWEEN 20 AND 24 THEN '25' WHEN before BETWEEN 45 AND 49 THEN '50' ELSE '100' END AS milestone, count(*) AS sample, {s.rate('sum(runs_batter)', 'count(*)', '100', 2)} AS sr FROM u WHERE before BETWEEN 20 AND 24 OR before BETWEEN 45 AND 49 OR before BETWEEN 90 AND 99 GROUP BY 1, 2),
ms AS (SELECT w.player_id, overall_sr, milestone, sr, {s.r('sr - overall_sr', 2)} AS sr_delta, sample FROM w JOIN o ON w.player_id = o.player_id)"""
    return f"{ctes}\nSELECT * FROM ms" if final else ctes


def p10_conversion(s: Dialect, fmt: str = "T20") -> str:
    return f"""{_faced(s, fmt)},
t AS (SELECT player_id, match_id, innings, sum(runs_batter) AS runs FROM f GROUP BY 1, 2, 3),
c AS (SELECT player_id, {count('runs >= 25')} AS reached_25, {count('runs >= 50')} AS reached_50, {count('runs >= 100')} AS reached_100 FROM t GROUP BY player_id)
SELECT *, {s.rate('reached_50', 'reached_25', '1', 4)} AS conversion_25_to_50, {s.rate('reached_100', 'reached_50', '1', 4)} AS conversion_50_to_100 FROM c"""


def p10_label(s: Dialect, fmt: str = "T20") -> str:
    """Whether a batter speeds up or slows down near milestones: the mean change over windows of five balls or more."""
    return f"""{p10_milestones(s, fmt, final=False)},
who AS (SELECT DISTINCT player_id FROM f),
g AS (SELECT who.player_id, coalesce(avg(ms.sr_delta), 0e0) AS delta FROM who LEFT JOIN ms ON who.player_id = ms.player_id AND ms.sample >= 5 GROUP BY who.player_id)
SELECT player_id, CASE WHEN delta > 5 THEN 'accelerator' WHEN delta < -5 THEN 'freezer' ELSE 'unaffected' END AS label FROM g"""


def _arrivals(s: Dialect, fmt: str) -> str:
    """Each batter's innings with arrival and position."""
    return f"""{s.base},
a AS (SELECT match_id, innings, striker_id AS player_id, min(delivery_id) AS first_ball, {count('faced')} AS balls, {total('runs_batter', 'faced')} AS runs FROM d WHERE fmt = '{fmt}' GROUP BY 1, 2, 3),
o AS (SELECT *, rank() OVER (PARTITION BY match_id, innings ORDER BY first_ball) AS position FROM a)"""


def p12_positions(s: Dialect, fmt: str = "T20") -> str:
    return f"""{_arrivals(s, fmt)},
g AS (SELECT player_id, cast(position as bigint) AS position, count(*) AS matches, {s.r('avg(runs / balls * 100)', 2)} AS avg_sr, {s.r('avg(runs)', 2)} AS avg_runs FROM o WHERE balls > 0 GROUP BY player_id, position)
SELECT *, matches >= 3 AND row_number() OVER (PARTITION BY player_id ORDER BY CASE WHEN matches >= 3 THEN 0 ELSE 1 END, avg_sr DESC, position) = 1 AS is_optimal FROM g"""


def _inherited(s: Dialect, fmt: str) -> str:
    """State at arrival from running sums over the innings, then a ladder."""
    return f"""{_arrivals(s, fmt)},
run AS (SELECT delivery_id, over_no, coalesce(sum(CASE WHEN {OUT} THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, innings ORDER BY delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w,
  coalesce(sum(runs_total) OVER (PARTITION BY match_id, innings ORDER BY delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM d WHERE fmt = '{fmt}'),
st AS (SELECT o.player_id, o.balls, o.runs, CASE WHEN w < 1 OR (w <= 2 AND over_no < 3) THEN 'clean_start' WHEN w >= 4 AND over_no < 10 AND innings = 2 AND r < 150 THEN 'rescue_mission' WHEN w >= 3 AND over_no < 10 THEN 'crisis'
  WHEN w >= 5 AND over_no < 15 THEN 'crisis' WHEN w BETWEEN 1 AND 2 AND over_no < 10 THEN 'slight_pressure' ELSE 'clean_start' END AS state FROM o JOIN run ON o.first_ball = run.delivery_id WHERE o.balls > 0),
bs AS (SELECT player_id, state, count(*) AS innings, {s.r('avg(runs / balls * 100)', 2)} AS avg_sr, {s.r('avg(runs)', 2)} AS avg_runs FROM st GROUP BY player_id, state)"""


def p13_inherited(s: Dialect, fmt: str = "T20") -> str:
    return f"{_inherited(s, fmt)}\nSELECT * FROM bs"


def p13_summary(s: Dialect, fmt: str = "T20") -> str:
    """The state a batter scores fastest from (the first in order of ties), and a crisis against a clean start."""
    at = "CASE state WHEN 'clean_start' THEN 0 WHEN 'slight_pressure' THEN 1 WHEN 'crisis' THEN 2 ELSE 3 END"
    return f"""{_inherited(s, fmt)},
k AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY avg_sr DESC, {at}) AS k FROM bs)
SELECT player_id, max(CASE WHEN k = 1 THEN state END) AS best_state, {s.r("coalesce(max(CASE WHEN state = 'crisis' THEN avg_sr END), 0e0) - coalesce(max(CASE WHEN state = 'clean_start' THEN avg_sr END), 0e0)", 2)} AS crisis_delta FROM k GROUP BY player_id"""


def _spells(s: Dialect, fmt: str) -> str:
    w = "PARTITION BY bowler_id, match_id, innings ORDER BY over_no"
    return f"""{s.base},
o AS (SELECT bowler_id, match_id, innings, over_no, {count('legal')} AS balls, {total('runs_total')} AS runs, {count(OUT)} AS wickets FROM d WHERE fmt = '{fmt}' GROUP BY 1, 2, 3, 4),
g AS (SELECT *, CASE WHEN over_no - lag(over_no) OVER ({w}) <= 2 THEN 0 ELSE 1 END AS fresh FROM o),
n AS (SELECT *, sum(fresh) OVER ({w}) AS spell FROM g),
e AS (SELECT bowler_id, match_id, innings, spell, sum(balls) AS balls, sum(runs) AS runs, sum(wickets) AS wickets FROM n WHERE spell <= 3 GROUP BY 1, 2, 3, 4),
sp AS (SELECT bowler_id AS player_id, cast(spell as bigint) AS spell, count(*) AS matches, {s.rate('sum(runs)', 'sum(balls)', '6', 2)} AS avg_economy, {s.r('avg(wickets)', 2)} AS avg_wickets, {s.r('avg(balls)', 2)} AS avg_balls FROM e GROUP BY bowler_id, spell)"""


def p15_spells(s: Dialect, fmt: str = "T20") -> str:
    return f"{_spells(s, fmt)}\nSELECT * FROM sp"


def p15_spell_decay(s: Dialect, fmt: str = "T20") -> str:
    return f"""{_spells(s, fmt)},
x AS (SELECT player_id, {s.r('max(avg_economy) FILTER (WHERE spell = 3) - max(avg_economy) FILTER (WHERE spell = 1)', 2)} AS spell_decay FROM sp GROUP BY player_id),
k AS (SELECT player_id, spell, row_number() OVER (PARTITION BY player_id ORDER BY avg_economy, spell) AS k FROM sp)
SELECT x.player_id, x.spell_decay, coalesce(k.spell, 1) AS best_spell, CASE WHEN x.spell_decay < -0.5 THEN 'frontloader' WHEN x.spell_decay > 0.5 THEN 'better-recalled' ELSE 'consistent' END AS verdict FROM x LEFT JOIN k ON x.player_id = k.player_id AND k.k = 1"""


def p17_chase(s: Dialect, fmt: str = "T20") -> str:
    return f"""{s.base},
a AS (SELECT striker_id AS player_id, {s.rate('sum(runs_batter)', 'count(*)', '100', 2)} AS overall_sr FROM d WHERE fmt = '{fmt}' AND faced GROUP BY striker_id),
i AS (SELECT striker_id AS player_id, match_id, {count('faced')} AS balls, {total('runs_batter', 'faced')} AS runs, {count(OUT)} AS outs, max(CASE WHEN winner IS NOT NULL THEN 1 ELSE 0 END) AS decided FROM d WHERE fmt = '{fmt}' AND innings = 2 GROUP BY 1, 2),
c AS (SELECT player_id, count(*) AS chase_innings, {s.rate('sum(runs)', 'sum(balls)', '100', 2)} AS chase_sr, {s.r('sum(runs) / coalesce(nullif(sum(CASE WHEN outs > 0 THEN 1 ELSE 0 END), 0), 1)', 2)} AS chase_avg, {count('outs = 0 AND decided = 1')} AS chases_finished_won FROM i GROUP BY player_id),
j AS (SELECT c.player_id, chase_innings, overall_sr, chase_sr, chase_avg, chases_finished_won, {s.rate('chases_finished_won', 'chase_innings', '1', 2)} AS finishing_rate FROM c JOIN a ON c.player_id = a.player_id)
SELECT *, CASE WHEN chase_sr > 140 AND finishing_rate > 0.4 THEN 'elite_chaser' WHEN chase_sr >= overall_sr AND finishing_rate > 0.2 THEN 'reliable' WHEN chase_sr < overall_sr - 8 THEN 'front_runner' ELSE 'average' END AS verdict FROM j"""


def p18_rotation(s: Dialect, fmt: str = "T20") -> str:
    return f"""{s.base},
g AS (SELECT striker_id AS player_id, count(*) AS balls, {count('runs_batter = 1')} AS ones, {count('runs_batter = 0')} AS dots, {count('runs_batter IN (4, 6)')} AS big, {total('runs_batter', 'runs_batter NOT IN (4, 6)')} AS small FROM d WHERE fmt = '{fmt}' AND faced GROUP BY striker_id),
h AS (SELECT *, ones / balls AS so, dots / balls AS sd, big / balls AS sb FROM g WHERE balls >= 10)
SELECT player_id, balls, {s.r('so * 100', 2)} AS singles_pct, {s.r('sd * 100', 2)} AS dot_pct, {s.r('sb * 100', 2)} AS boundary_pct, {s.rate('small', 'balls - big', '100', 2)} AS non_boundary_sr,
  {s.r(s.clamp('so * 7 + (1 - sd) * 3', '0e0', '10e0'), 2)} AS rotation_score, CASE WHEN so > 0.4 THEN 'rotator' WHEN sb > 0.18 AND so < 0.3 THEN 'boundary_reliant' WHEN sd > 0.5 THEN 'blocker' ELSE 'balanced' END AS archetype FROM h"""


def p19_sixes(s: Dialect, fmt: str = "T20") -> str:
    a, b = ("6.7", "15.7") if fmt == "T20" else ("10.7", "40.7")
    return f"""{s.base},
g AS (SELECT striker_id AS player_id, count(*) AS balls, count(DISTINCT match_id) AS innings, {count('runs_batter = 6')} AS total_sixes, {count(f'runs_batter = 6 AND over_ball < {a}')} AS powerplay_sixes,
  {count(f'runs_batter = 6 AND over_ball >= {a} AND over_ball < {b}')} AS middle_sixes, {count(f'runs_batter = 6 AND over_ball >= {b}')} AS death_sixes FROM d WHERE fmt = '{fmt}' AND faced GROUP BY striker_id)
SELECT player_id, total_sixes, {s.rate('total_sixes', 'balls', '100', 2)} AS six_rate, {s.rate('total_sixes', 'innings', '1', 2)} AS sixes_per_innings, powerplay_sixes, middle_sixes, death_sixes, {', '.join(f"{s.rate(f'{p}_sixes', 'total_sixes', '1', 2)} AS {p}_pct" for p in ('powerplay', 'middle', 'death'))},
  CASE WHEN total_sixes = 0 THEN NULL WHEN powerplay_sixes >= middle_sixes AND powerplay_sixes >= death_sixes THEN 'powerplay' WHEN middle_sixes >= death_sixes THEN 'middle' ELSE 'death' END AS dominant_six_phase,
  {s.r('least(10e0, total_sixes / balls * 100 / 5 * 10)', 2)} AS power_rating FROM g WHERE balls >= 10"""


def p20_workload(s: Dialect, fmt: str = "T20", days: int = 365) -> str:
    return f"""{s.base},
m AS (SELECT bowler_id AS player_id, match_id, match_date, {count('legal')} AS balls, {total('runs_total')} AS runs FROM d WHERE match_date <= {s.as_of} AND {s.days(s.as_of, 'match_date')} <= {days} GROUP BY 1, 2, 3),
dd AS (SELECT player_id, match_date, row_number() OVER (PARTITION BY player_id ORDER BY match_date) AS k, count(*) OVER (PARTITION BY player_id) AS n, lag(match_date) OVER (PARTITION BY player_id ORDER BY match_date) AS prior FROM (SELECT DISTINCT player_id, match_date FROM m) x),
t AS (SELECT player_id, max(CASE WHEN k = cast(floor(n / 2) as bigint) + 1 THEN match_date END) AS mid, {count(f"{s.days('match_date', 'prior')} <= 2")} AS back_to_back_matches FROM dd GROUP BY player_id),
g AS (SELECT m.player_id, {total('balls')} AS total_balls_bowled, count(*) AS matches_bowled, cast({s.days('max(match_date)', 'min(match_date)')} + 1 as bigint) AS days_active,
  {s.rate('sum(CASE WHEN match_date < mid THEN runs END)', 'sum(CASE WHEN match_date < mid THEN balls END)', '6', 2)} AS first_half_economy, {s.rate('sum(CASE WHEN match_date >= mid THEN runs END)', 'sum(CASE WHEN match_date >= mid THEN balls END)', '6', 2)} AS second_half_economy
  FROM m JOIN t ON m.player_id = t.player_id GROUP BY m.player_id),
w AS (SELECT g.*, back_to_back_matches, {s.rate('total_balls_bowled', 'matches_bowled', '1', 2)} AS balls_per_match, {s.r('second_half_economy - first_half_economy', 2)} AS economy_delta, CASE WHEN total_balls_bowled > 180 THEN 'high' WHEN total_balls_bowled > 90 THEN 'moderate' ELSE 'light' END AS workload_level FROM g JOIN t ON g.player_id = t.player_id)
SELECT *, CASE WHEN economy_delta > 1 AND workload_level = 'high' THEN 'elevated' ELSE 'normal' END AS fatigue_signal FROM w"""


def _ball_age(s: Dialect, fmt: str) -> str:
    a, b = (6, 15) if fmt == "T20" else (10, 40)
    return f"""{s.base},
g AS (SELECT bowler_id AS player_id, CASE WHEN over_no < {a} THEN 'new_ball' WHEN over_no >= {b} THEN 'old_ball' ELSE 'middle' END AS segment, {count('legal')} AS balls, {total('runs_total')} AS runs, {count(OUT)} AS wickets FROM d WHERE fmt = '{fmt}' GROUP BY 1, 2),
r AS (SELECT *, {s.rate('runs', 'balls', '6', 2)} AS economy, {s.rate('wickets', 'balls', '6', 2)} AS wickets_per_over FROM g),
ba AS (SELECT *, balls >= 12 AND row_number() OVER (PARTITION BY player_id ORDER BY CASE WHEN balls >= 12 THEN 0 ELSE 1 END, economy, CASE segment WHEN 'new_ball' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END) = 1 AS is_best FROM r)"""


def p21_ball_age(s: Dialect, fmt: str = "T20") -> str:
    return f"{_ball_age(s, fmt)}\nSELECT * FROM ba"


def p21_specialist(s: Dialect, fmt: str = "T20") -> str:
    return f"""{_ball_age(s, fmt)},
b AS (SELECT player_id, max(CASE WHEN is_best THEN segment END) AS best_phase FROM ba GROUP BY player_id)
SELECT *, CASE best_phase WHEN 'new_ball' THEN 'new_ball_specialist' WHEN 'old_ball' THEN 'death_specialist' WHEN 'middle' THEN 'first_change' ELSE 'utility' END AS specialist_type FROM b"""


QUERIES = {k: f for k, f in list(globals().items()) if k[0] == "p" and k[1:3].isdigit()}
