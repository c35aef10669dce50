"""Data-quality checks, usage of keys and page names; `s` is the dialect."""

from __future__ import annotations

from crease.functions.dialect import Dialect, count, total
from crease.operators.fantasy import points


def d01_summary(s: Dialect, fmt: str = "T20") -> str:
    return f"{s.base}\nSELECT count(*) AS deliveries, count(DISTINCT match_id) AS matches, {s.rate(count('striker_id IS NOT NULL AND bowler_id IS NOT NULL'), 'count(*)', '100', 2)} AS resolution_rate FROM d"


def d01_points(s: Dialect, fmt: str = "T20") -> str:
    """How many fantasy points rows there are, and their mean."""
    return f"{points(s)}\nSELECT count(*) AS n, {s.r('avg(total_points)', 2)} AS mean_points FROM fp"


def _checks(s: Dialect) -> str:
    """CTEs up to ck: the balls are read twice, once by match and once for repeated ids; all else is sums of matches and players."""
    none = lambda *cs: ", ".join(f"{count(f'{c} IS NULL')} AS no_{c}" for c in cs)
    checks = [  # name, rows that break it, rows looked at, how bad that is
        ("null_striker", "no_striker_id", "balls", "share"), ("null_bowler", "no_bowler_id", "balls", "share"), ("missing_style", "no_bowling_style", "players", "note"), ("missing_hand", "no_batting_hand", "players", "note"),
        ("missing_role", "no_primary_role", "players", "note"), ("duplicate_balls", "again", "balls", "critical"), ("low_ball_matches", "low", "played", "note"), ("orphan_deliveries", "orphans", "balls", "critical"),
    ]
    by = lambda k: "CASE k " + " ".join(f"WHEN {i} THEN {x[k] if k in (1, 2) else repr(x[k])}" for i, x in enumerate(checks)) + " END"
    return f"""{s.base},
b AS (SELECT match_id, count(*) AS n, {none('striker_id', 'bowler_id')} FROM deliveries GROUP BY match_id),
bm AS (SELECT b.*, m.match_id AS known, l.format AS fmt FROM b LEFT JOIN matches m ON b.match_id = m.match_id LEFT JOIN leagues l ON m.league_id = l.league_id),
f AS (SELECT {total('n')} AS balls, {total('no_striker_id')} AS no_striker_id, {total('no_bowler_id')} AS no_bowler_id, {total('n', 'known IS NULL')} AS orphans, {count('fmt IS NOT NULL')} AS played, {count("n < 9e-1 * CASE WHEN fmt = 'T20' THEN 120 ELSE 600 END AND fmt IS NOT NULL")} AS low FROM bm),
p AS (SELECT count(*) AS players, {none('bowling_style', 'batting_hand', 'primary_role')} FROM players),
r AS (SELECT {total('n - 1')} AS again FROM (SELECT delivery_id, count(*) AS n FROM deliveries GROUP BY delivery_id) x),
one AS (SELECT f.*, p.*, r.*, {s.each(len(checks))} AS k FROM f CROSS JOIN p CROSS JOIN r),
c AS (SELECT {by(0)} AS check_name, {by(1)} AS n, {by(2)} AS total, {by(3)} AS kind FROM one),
ck AS (SELECT check_name, n, total, CASE WHEN n = 0 THEN 'ok' WHEN kind = 'critical' OR kind = 'share' AND n > 5e-2 * total THEN 'critical' ELSE 'warning' END AS level FROM c)"""


def d02_checks(s: Dialect, fmt: str = "T20") -> str:
    """One row a check: how many rows break it, of how many, and how bad that is."""
    return f"{_checks(s)}\nSELECT * FROM ck"


def d07_report(s: Dialect, fmt: str = "T20") -> str:
    """The issues in one line by severity, and the code to end with: 1 if any is critical."""
    critical, warning = "level = 'critical'", "level = 'warning'"
    issue = f"concat(check_name, ': ', {s.text('n')}, ' of ', {s.text('total')})"
    listed = lambda level: f"coalesce({s.joined(f"CASE WHEN {level} THEN {issue} END", '; ', 'check_name')}, '')"
    return f"{_checks(s)}\nSELECT {count(critical)} AS n_critical, {count(warning)} AS n_warning, {listed(critical)} AS critical, {listed(warning)} AS warnings, CASE WHEN max(CASE WHEN level = 'critical' THEN 1 ELSE 0 END) = 1 THEN 1 ELSE 0 END AS exit_code FROM ck"


def k01_usage(s: Dialect, fmt: str = "T20") -> str:
    """Requests by user: in all, on the last day and in its month."""
    return f"""WITH e AS (SELECT user_id, cast(ts as date) AS day FROM {s.events}), z AS (SELECT max(day) AS today FROM e)
SELECT user_id, count(*) AS total, {count('day = today')} AS today_count, {count('year(day) = year(today) AND month(day) = month(today)')} AS month_count FROM e JOIN z ON true GROUP BY user_id"""


def k03_keys(s: Dialect, fmt: str = "T20", most: int = 5) -> str:
    """Keys (here a user's kinds of events) with their use on the last day, and whether the user may add another: `most` active ones at most."""
    return f"""WITH e AS (SELECT user_id, event_type AS key_name, cast(ts as date) AS day FROM {s.events}), z AS (SELECT max(day) AS today FROM e),
k AS (SELECT user_id, key_name, count(*) AS total, {count('day = today')} AS today_count, max(day) AS last_used FROM e JOIN z ON true GROUP BY user_id, key_name)
SELECT k.*, count(*) OVER (PARTITION BY user_id) < {most} AS may_add FROM k"""


def _since(s: Dialect, days: int) -> str:
    """CTE r: events of the last `days` days, 1 to 90 of them, up to the last day there is."""
    return f"""e AS (SELECT user_id, event_type AS key_name, cast(ts as date) AS day FROM {s.events}), z AS (SELECT max(day) AS today FROM e),
r AS (SELECT e.* FROM e JOIN z ON true WHERE {s.days('today', 'day')} <= {max(1, min(days, 90))})"""


def k04_usage_since(s: Dialect, fmt: str = "T20", days: int = 30) -> str:
    """Requests by user, key and day within the last `days` days."""
    return f"WITH {_since(s, days)}\nSELECT user_id, key_name, day, count(*) AS request_count FROM r GROUP BY 1, 2, 3"


def k04_key_share(s: Dialect, fmt: str = "T20", days: int = 30) -> str:
    """Each key's share, in percent, of its user's requests within the last `days` days."""
    return f"""WITH {_since(s, days)},
g AS (SELECT user_id, key_name, count(*) AS requests FROM r GROUP BY 1, 2)
SELECT user_id, key_name, requests, {s.r('requests / sum(requests) OVER (PARTITION BY user_id) * 100', 1)} AS share FROM g"""


def k02_usage_daily(s: Dialect, fmt: str = "T20") -> str:
    return f"SELECT user_id, cast(ts as date) AS day, count(*) AS request_count FROM {s.events} GROUP BY 1, 2"


def h01_page_names(s: Dialect, fmt: str = "T20") -> str:
    """The name on a player's page: its first heading."""
    return f"SELECT page_id, trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)) AS name FROM {s.pages}"


def s01_sessions(s: Dialect, fmt: str = "T20", minutes: int = 30) -> str:
    """Each user's visits: runs of events of which none comes more than `minutes` after the one before; the end is that long after the last."""
    gap = f"ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > interval '{minutes}' minute"
    return f"""WITH e AS (SELECT user_id, event_type, ts, CASE WHEN {gap} THEN 1 ELSE 0 END AS fresh FROM {s.events} WHERE ts IS NOT NULL),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS visit FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + interval '{minutes}' minute AS session_end, count(*) AS events, count(DISTINCT event_type) AS kinds FROM n GROUP BY user_id, visit"""


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "dkhs" and k[1:3].isdigit()}
