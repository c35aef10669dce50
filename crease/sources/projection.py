"""The cricket tables, as a projection of order data: a stand-in for ball-by-ball sources in tests and benchmarks."""

from __future__ import annotations

#: League, name, format, difficulty, similarity weight, tier.
LEAGUES = [("ipl", "T20", 1.5, 1.0, 1), ("t20i", "T20", 1.4, 1.0, 1), ("odi", "ODI", 1.4, 0.9, 1), ("bbl", "T20", 1.2, 1.0, 2), ("psl", "T20", 1.2, 1.0, 2), ("blast", "T20", 0.8, 1.0, 3)]

STYLES = ["right-arm fast", "right-arm medium", "left-arm fast", "right-arm offbreak", "left-arm orthodox", "legbreak"]


def _literal(rows, names: str) -> str:
    cells = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"cast({x} as double)" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {cells}) AS v({names})"


def deliveries(lineitem: str) -> str:
    return f"""
SELECT cast(match_id * 240 + (innings - 1) * 120 + b0 as bigint) AS delivery_id, match_id, innings, over_no, ball_no, cast(over_no + ball_no / 10.0 as decimal(4, 1)) AS over_ball,
  bat_no * 11 + 1 + cast(floor(b0 / 12) as int) + l_partkey % 2 AS striker_id, bat_no * 11 + 1 + cast(floor(b0 / 12) as int) + 1 - l_partkey % 2 AS non_striker_id,
  bowl_no * 11 + 6 + over_no % 2 + 2 * (cast(floor(over_no / 4) as int) % 3) AS bowler_id, extras_type, runs_batter,
  CASE WHEN extras_type IS NULL THEN 0 ELSE 1 END AS runs_extras, runs_batter + CASE WHEN extras_type IS NULL THEN 0 ELSE 1 END AS runs_total, wicket_type,
  CASE WHEN wicket_type IS NOT NULL THEN bat_no * 11 + 1 + cast(floor(b0 / 12) as int) + l_partkey % 2 END AS wicket_player_id
FROM (
  SELECT *, CASE WHEN innings = 1 THEN t1 ELSE t2 END AS bat_no, CASE WHEN innings = 1 THEN t2 ELSE t1 END AS bowl_no, cast(floor(b0 / 6) as int) AS over_no, b0 % 6 + 1 AS ball_no,
    CASE WHEN extras_type IN ('wides', 'byes', 'legbyes') THEN 0 WHEN l_quantity <= 15 THEN 0 WHEN l_quantity <= 33 THEN 1 WHEN l_quantity <= 39 THEN 2 WHEN l_quantity <= 40 THEN 3 WHEN l_quantity <= 46 THEN 4 ELSE 6 END AS runs_batter,
    CASE WHEN (l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 20 = 0 AND coalesce(extras_type, '') <> 'wides' THEN CASE l_partkey % 6 WHEN 0 THEN 'caught' WHEN 1 THEN 'caught' WHEN 2 THEN 'bowled' WHEN 3 THEN 'lbw' WHEN 4 THEN 'run out' ELSE 'stumped' END END AS wicket_type
  FROM (
    SELECT *, match_id % 10 AS t1, (match_id + 1 + cast(floor(match_id / 10) as int) % 9) % 10 AS t2,
      cast(row_number() OVER (PARTITION BY match_id, innings ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 as int) AS b0,
      CASE l_partkey % 25 WHEN 0 THEN 'wides' WHEN 1 THEN 'noballs' WHEN 2 THEN 'byes' WHEN 3 THEN 'legbyes' END AS extras_type
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, cast(floor(l_orderkey / 60) as int) AS match_id, CASE WHEN l_orderkey % 60 < 30 THEN 1 ELSE 2 END AS innings FROM {lineitem}) a
  ) b WHERE b0 < 120
) c"""


def matches(orders: str) -> str:
    return f"""
SELECT *, CASE toss_decision WHEN 'bat' THEN team1 WHEN 'field' THEN team2 END AS toss_winner,
  CASE WHEN w = 0 THEN NULL WHEN w <= 5 THEN team1 ELSE team2 END AS winner
FROM (
  SELECT match_id, CASE match_id % 6 WHEN 0 THEN 'ipl' WHEN 1 THEN 't20i' WHEN 2 THEN 'odi' WHEN 3 THEN 'bbl' WHEN 4 THEN 'psl' ELSE 'blast' END AS league_id,
    cast(year(o_orderdate) as varchar(4)) AS season, cast(o_orderdate as date) AS match_date, cast(floor(match_id / 6) as int) % 8 + 1 AS venue_id,
    concat('Team_', cast(match_id % 10 as varchar(4))) AS team1, concat('Team_', cast((match_id + 1 + cast(floor(match_id / 10) as int) % 9) % 10 as varchar(4))) AS team2,
    CASE WHEN o_custkey % 17 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 'bat' ELSE 'field' END AS toss_decision, o_custkey % 20 = 0 AS rain_affected, cast(floor(o_totalprice) as bigint) % 10 AS w
  FROM (SELECT *, cast(floor(o_orderkey / 60) as int) AS match_id FROM {orders} WHERE o_orderkey % 60 = 0) a
) b"""


def players(customer: str) -> str:
    styles = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(STYLES))
    return f"""
SELECT cast(c_custkey as int) AS player_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'Left hand' ELSE 'Right hand' END AS batting_hand,
  CASE WHEN (c_custkey - 1) % 11 >= 5 THEN CASE c_custkey % 6 {styles} END END AS bowling_style,
  CASE WHEN (c_custkey - 1) % 11 = 3 THEN 'WK' WHEN (c_custkey - 1) % 11 <= 4 THEN 'BAT' WHEN (c_custkey - 1) % 11 <= 6 THEN 'AR' ELSE 'BOWL' END AS primary_role,
  CASE WHEN c_custkey % 19 > 0 THEN date '1962-01-01' + cast(c_custkey * 37 % 4000 as int) END AS dob
FROM {customer} WHERE c_custkey BETWEEN 1 AND 110"""


#: Every delivery with its match; faced and legal as bowlers and batters count them (a missing extra counts).
JOINED = """
SELECT d.*, m.league_id, m.season, m.match_date, m.venue_id, m.team1, m.team2, m.toss_winner, m.toss_decision, m.winner, m.rain_affected, l.format AS fmt, l.difficulty,
  coalesce(d.extras_type, '') <> 'wides' AS faced, coalesce(d.extras_type, '') NOT IN ('wides', 'noballs', 'no-balls') AS legal
FROM deliveries d JOIN matches m ON d.match_id = m.match_id JOIN leagues l ON m.league_id = l.league_id"""


#: Runs per over off pace bowling at each venue, over all its matches; a table of venues takes its place where there is one.
VENUES = """
SELECT d.venue_id, sum(d.runs_total) * 6e0 / count(*) AS avg_pace_economy FROM d JOIN players b ON d.bowler_id = b.player_id
WHERE legal AND d.venue_id IS NOT NULL AND b.bowling_style IN ('right-arm fast', 'right-arm medium', 'left-arm fast') GROUP BY d.venue_id"""


#: Matches to come, their squads, and players whose form is asked for: a stand-in too, so that they can be compared with what happened.
UPCOMING = "SELECT match_id AS upcoming_id, match_date, league_id, venue_id, team1, team2, toss_winner, toss_decision FROM matches WHERE match_date >= date '1998-05-01'"
SQUADS = """
SELECT u.upcoming_id, p.player_id, CASE WHEN p.player_id % 29 > 0 THEN p.team END AS team, CASE WHEN p.player_id % 10 > 0 THEN 7 + (p.player_id % 7) * 5e-1 END AS credits, p.player_id % 13 > 0 AS is_playing_xi
FROM (SELECT player_id, concat('Team_', cast(cast(floor((player_id - 1) / 11) as int) as varchar(4))) AS team FROM players) p JOIN (SELECT upcoming_id, team1 AS team FROM upcoming UNION ALL SELECT upcoming_id, team2 FROM upcoming) u ON p.team = u.team"""
ASKED = "SELECT player_id, date '1998-03-01' AS day FROM players"
ATTACKS = """
SELECT b.player_id AS batter_id, w.player_id AS bowler_id FROM squads b JOIN squads w ON b.upcoming_id = w.upcoming_id AND b.team <> w.team JOIN players p ON w.player_id = p.player_id
WHERE b.is_playing_xi AND w.is_playing_xi AND p.primary_role IN ('BOWL', 'AR')"""


def leagues() -> str:
    return _literal(LEAGUES, "league_id, format, difficulty, similarity, tier")


def tables(lineitem: str, orders: str, customer: str) -> dict[str, str]:
    """The SQL of deliveries, matches, players, leagues, d and venues, of upcoming and squads, and of what is asked: asked (players and days) and attacks (batters and bowlers)."""
    return {"deliveries": deliveries(lineitem), "matches": matches(orders), "players": players(customer), "leagues": leagues(), "d": JOINED, "venues": VENUES, "upcoming": UPCOMING, "squads": SQUADS, "asked": ASKED, "attacks": ATTACKS}
