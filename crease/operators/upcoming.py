"""Features of matches to come and of players asked for: the streams of `features`, asked from outside; `s` is the dialect."""

from __future__ import annotations

from crease.functions.dialect import Dialect
from crease.operators import features

#: Credits of a player that a squad gives none.
CREDITS = "8e0"


def asked(s: Dialect) -> str:
    """CTE ask: one row for each player of a squad that is to play; a player without a team is of the first."""
    if "ask" in s.stored:
        return f"ask AS ({s.stored['ask']})"
    return f"""ask AS (SELECT u.upcoming_id, q.player_id, coalesce(q.team, u.team1) AS team, CASE WHEN coalesce(q.team, u.team1) = u.team1 THEN u.team2 ELSE u.team1 END AS opponent, u.match_date AS day, u.league_id, u.venue_id, u.toss_winner, u.toss_decision, coalesce(q.credits, {CREDITS}) AS credits
  FROM squads q JOIN upcoming u ON q.upcoming_id = u.upcoming_id WHERE q.is_playing_xi)"""


def _stream(name: str, key: str, of: list[str], history: str, ask: str, carried: list[str], among: str) -> str:
    """CTE `name`: the rows of `history` (key, match_id, match_date and `of`) whose key is `among` those asked for, and the rows of `ask` (key, day and `carried`)."""
    given = [c for c in of if c in carried]
    more = [c for c in carried if c not in of]
    return f"""{name} AS (SELECT h.{key}, h.match_date AS day, 1 AS is_told, h.match_id, {', '.join(f'h.{c}' for c in of)}{''.join(f', NULL AS {c}' for c in more)} FROM {history} h WHERE h.{key} IN (SELECT {among})
  UNION ALL SELECT {key}, day, 0, NULL, {', '.join(c if c in given else 'NULL' for c in of)}{''.join(f', {c}' for c in more)} FROM {ask} WHERE {key} IS NOT NULL)"""


def _begin(s: Dialect) -> str:
    return f"{features.histories(s)}, {asked(s)}"


def squads_told(s: Dialect) -> str:
    """CTEs up to told: the players of `ask` (is_told = 0) with all that was known of them before the day."""
    carried = ["opponent", "venue_id", "upcoming_id", "team", "league_id", "toss_winner", "toss_decision", "credits"]
    return features.told(s, f"{_begin(s)}, {_stream('stream', 'player_id', features.TOLD, 'pm', 'ask', carried, 'player_id FROM ask')}")


def players_told(s: Dialect) -> str:
    """CTEs up to told: the players and days in `asked` (is_told = 0) with all that was known of them before the day."""
    ask = "ask AS (SELECT DISTINCT player_id, day FROM asked)"
    return features.told(s, f"{features.histories(s)}, {ask}, {_stream('stream', 'player_id', features.TOLD, 'pm', 'ask', [], 'player_id FROM ask')}")


def g03_form_at(s: Dialect, fmt: str = "T20") -> str:
    """Form of the players in `asked` before their day."""
    return f"{players_told(s)}\nSELECT player_id, day, {', '.join(features.FORM)} FROM told WHERE is_told = 0"


def g16_inference_matrix(s: Dialect, fmt: str = "T20") -> str:
    """One row of all features for each player who is to play a match of `upcoming`, from what was known before its day.

    A player, team or venue without history has the features' defaults; without a toss nobody has won it or bats first.
    """
    begin, players = _begin(s), squads_told(s)
    teams = features.told_of_teams(s, f"""{begin}, {features.of_matches()},
asked_teams AS (SELECT DISTINCT opponent AS team, day FROM ask),
team_2 AS (SELECT tq.*, {s.each(2)} AS k FROM tq),
of_team AS (SELECT CASE WHEN k = 0 THEN team1 ELSE team2 END AS team, team_2.* FROM team_2),
{_stream('team_stream', 'team', features.OF_TEAM, 'of_team', 'asked_teams', [], 'opponent FROM ask')}""")
    venues = features.told_of_venues(s, f"""{begin}, {features.of_matches()},
asked_venues AS (SELECT DISTINCT venue_id, day FROM ask),
of_venue AS (SELECT * FROM tq WHERE n > 0 AND n_played > 0),
{_stream('venue_stream', 'venue_id', features.OF_VENUE, 'of_venue', 'asked_venues', [], 'venue_id FROM ask')}""")
    own = {**features.static(s, "a.day"), "toss_won": "CASE WHEN a.toss_winner = a.team THEN 1 ELSE 0 END", "batting_first": "CASE WHEN (a.toss_winner = a.team) = (a.toss_decision = 'bat') THEN 1 ELSE 0 END", "league_difficulty": "coalesce(l.difficulty, 1e0)", "format_similarity": "coalesce(l.similarity, 1e0)", "league_tier": "coalesce(l.tier, 2)", "at_venue_matches": "coalesce(at_venue_matches, 0)"}
    return f"""SELECT a.upcoming_id, a.player_id, a.day AS match_date, a.league_id, a.team, a.credits, {features.chosen(own)}
FROM ({players} SELECT * FROM told WHERE is_told = 0) a
LEFT JOIN ({teams} SELECT team AS of_team, day AS of_day, opposition_batting, opposition_bowling, opposition_pace_ratio FROM tt WHERE is_told = 0) t ON t.of_team = a.opponent AND t.of_day = a.day
LEFT JOIN ({venues} SELECT venue_id AS at_venue, day AS at_day, {', '.join(features.VENUE)} FROM tv WHERE is_told = 0) v ON v.at_venue = a.venue_id AND v.at_day = a.day
LEFT JOIN ({features.g12_static(s)}) p ON p.player_id = a.player_id
LEFT JOIN ({s.base} SELECT * FROM leagues) l ON l.league_id = a.league_id"""


QUERIES = {k: f for k, f in list(globals().items()) if k[0] == "g" and k[1:3].isdigit()}
