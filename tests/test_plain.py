"""Answers against plain loops over the tables' rows: no text is shared with the queries."""

import datetime
import math
import statistics
from collections import Counter, defaultdict

import duckdb
import pytest

from crease import catalog

AS_OF = datetime.date(1998, 8, 2)
DIFFICULTY = {"ipl": 1.5, "t20i": 1.4, "odi": 1.4, "bbl": 1.2, "psl": 1.2, "blast": 0.8}
PACE = {"right-arm fast", "right-arm medium", "left-arm fast"}
SPIN = {"right-arm offbreak", "left-arm orthodox", "legbreak"}


class Tables:
    def __init__(self, folder):
        self.con = duckdb.connect()
        for t in ("lineitem", "orders", "customer"):
            self.con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        base = catalog.duckdb_dialect().base
        self.balls = sorted(self.rows(f"{base} SELECT * FROM d"), key=lambda r: r["delivery_id"])
        self.matches = {r["match_id"]: r for r in self.rows(f"{base} SELECT * FROM matches")}
        self.players = {r["player_id"]: r for r in self.rows(f"{base} SELECT * FROM players")}
        self.points = self.answer("f06_fantasy_points")
        for r in self.points:
            m = self.matches[r["match_id"]]
            r.update({k: m[k] for k in ("match_date", "league_id", "season", "winner", "venue_id")}, fmt="ODI" if m["league_id"] == "odi" else "T20")
        by = defaultdict(list)
        for r in self.points:
            by[r["league_id"], r["season"]].append(r["total_points"])
        for r in self.points:
            x = by[r["league_id"], r["season"]]
            r["z"] = (r["total_points"] - statistics.mean(x)) / statistics.stdev(x) if len(x) > 1 and statistics.stdev(x) > 0 else 0.0

    def rows(self, sql):
        cur = self.con.execute(sql)
        names = [c[0] for c in cur.description]
        return [dict(zip(names, r)) for r in cur.fetchall()]

    def answer(self, name, **options):
        return self.rows(catalog.TEMPLATES[name](catalog.duckdb_dialect(), **options))

    def by_player(self):
        out = defaultdict(list)
        for r in sorted(self.points, key=lambda r: (r["match_date"], r["match_id"])):
            out[r["player_id"]].append(r)
        return out


@pytest.fixture(scope="module")
def t():
    return Tables("/root/testdata/sf0.01")


def near(a, b, by=0.011):
    return a is None and b is None or a is not None and b is not None and abs(a - b) <= by


def faced(b):
    return b["extras_type"] != "wides"


def legal(b):
    return b["extras_type"] not in ("wides", "noballs", "no-balls")


def test_pitch(t):
    pace = defaultdict(list)
    first = defaultdict(list)
    for b in t.balls:
        style = t.players.get(b["bowler_id"], {}).get("bowling_style")
        if legal(b) and style in PACE:
            pace[b["venue_id"]].append(b["runs_total"])
        if b["innings"] == 1 and b["over_no"] < 3:
            first[b["match_id"]].append(b)
    got = {r["match_id"]: r for r in t.answer("m01_pitch")}
    assert got.keys() == first.keys() and len({r["classification"] for r in got.values()}) > 2
    for k, balls in first.items():
        r = got[k]
        if len(balls) < 12:
            assert (r["classification"], r["confidence"], r["actual_run_rate"], r["wickets_in_sample"], r["overs_analyzed"]) == ("insufficient_data", "low", 0, 0, 0)
            continue
        venue = pace.get(t.matches[k]["venue_id"])
        base = statistics.mean(venue) * 6 if venue else None
        rate = round(sum(b["runs_total"] for b in balls) / max(1, sum(map(faced, balls))) * 6, 2)
        out = Counter(b["wicket_type"] for b in balls if b["wicket_type"])
        n = sum(out.values())
        pi, bounce = round((out["bowled"] + out["lbw"]) / max(1, n), 2), out["caught"] / max(1, n)
        want = "pace-friendly" if pi > 0.5 and rate < (7.5 if base is None else base) or bounce > 0.5 else "batting-friendly" if rate > 9 or n == 0 and rate > 8 else "balanced"
        assert near(r["actual_run_rate"], rate) and near(r["pace_indicator"], pi) and r["classification"] == want
        assert r["vs_venue_baseline"] == (None if base is None else "at" if abs(rate - base) <= 0.3 else "above" if rate > base else "below")
        assert r["wicket_types"] == ", ".join(f"{x}: {c}" for x, c in sorted(out.items()))


def test_win_contribution_leaves_out_ties(t):
    folder = duckdb.connect()
    for x in ("lineitem", "orders", "customer"):
        folder.execute(f"CREATE VIEW {x} AS SELECT * FROM '/root/testdata/sf0.001/{x}.parquet'")
    s = catalog.duckdb_dialect()
    tied = {**s.tables, "matches": f"SELECT * REPLACE (CASE match_id % 5 WHEN 0 THEN 'tie' WHEN 1 THEN 'no result' WHEN 2 THEN '' ELSE winner END AS winner) FROM ({s.tables['matches']}) x"}
    from dataclasses import replace

    s = replace(s, tables=tied)
    cur = folder.execute(catalog.TEMPLATES["p08_win_contribution"](s))
    got = {r[0]: dict(zip([c[0] for c in cur.description], r)) for r in cur.fetchall()}
    cur = folder.execute(f"{catalog.TEMPLATES['f06_fantasy_points'](s)}")
    points = defaultdict(list)
    winner = dict(folder.execute(f"{s.base} SELECT match_id, winner FROM matches").fetchall())
    for r in cur.fetchall():
        points[r[0]].append((r[5], winner[r[1]] not in (None, "", "tie", "no result")))
    for p, rows in points.items():
        x = [v for v, _ in rows]
        bar = statistics.mean(x) + 1.5 * (statistics.stdev(x) if len(x) > 1 else 0)
        won = [v for v, w in rows if w]
        assert got[p]["matches"] == len(rows) and got[p]["wins"] == len(won)
        assert near(got[p]["mean_fp_in_wins"], statistics.mean(won) if won else 0)
        assert got[p]["high_leverage_matches"] == sum(v >= bar for v in x)


def test_momentum_and_recent_activity(t):
    recent = defaultdict(list)
    for r in t.answer("p05_recent_activity"):
        recent[r["player_id"]].append(r)
    got = {r["player_id"]: r for r in t.answer("p05_momentum")}
    seen = 0
    for p, rows in t.by_player().items():
        rows = [r for r in rows if 0 <= (AS_OF - r["match_date"]).days <= 365]
        if not rows:
            assert p not in got
            continue
        seen += 1
        w = [math.exp(-0.033 * (AS_OF - r["match_date"]).days) for r in rows]
        score = max(0, min(10, sum(r["z"] * x * DIFFICULTY[r["league_id"]] for r, x in zip(rows, w)) / len(rows) * 10 + 5))
        assert near(got[p]["momentum_score"], score) and got[p]["matches_in_window"] == len(rows)
        assert got[p]["days_since_last_match"] == (AS_OF - rows[-1]["match_date"]).days
        latest = sorted(recent[p], key=lambda r: r["rank"])
        assert [r["match_id"] for r in latest] == [r["match_id"] for r in rows[::-1][:10]]
        assert all(near(a["z_score"], b["z"], 0.0011) and near(a["weight"], x, 0.00011) for a, b, x in zip(latest, rows[::-1], w[::-1]))
    assert seen > 50


def test_league_adjusted(t):
    got = {r["player_id"]: r for r in t.answer("p11_league_adjusted")}
    for p, rows in t.by_player().items():
        by = defaultdict(list)
        for r in rows:
            by[r["league_id"]].append(r["z"])
        z = {k: round(statistics.mean(v), 4) for k, v in by.items()}
        total = sum(z[k] * DIFFICULTY[k] for k in z) / sum(DIFFICULTY[k] for k in z)
        low = min(z, key=lambda k: (DIFFICULTY[k], k))
        high = min(z, key=lambda k: (-DIFFICULTY[k], k))
        assert near(got[p]["overall_adjusted_score"], total, 0.0003) and near(got[p]["inflation_index"], z[low] - z[high] if len(z) > 1 else 0, 0.0003)


def test_format_switch(t):
    got = {r["player_id"]: r for r in t.answer("p14_format_switch")}
    ways = set()
    for p, rows in t.by_player().items():
        switch, settled, way = [], [rows[0]["z"]], defaultdict(list)
        for a, b in zip(rows, rows[1:]):
            gap = (b["match_date"] - a["match_date"]).days
            if a["fmt"] != b["fmt"] and gap <= 7:
                switch.append(b["z"])
                way[f"{a['fmt']}_to_{b['fmt']}"].append(b["z"])
            elif a["fmt"] == b["fmt"] and gap >= 10:
                settled.append(b["z"])
        assert (got[p]["switch_matches"], got[p]["settled_matches"]) == (len(switch), len(settled))
        assert near(got[p]["switch_avg_z"], statistics.mean(switch) if switch else 0, 0.0002)
        worst = min((k for k in ("T20_to_ODI", "ODI_to_T20") if way[k]), key=lambda k: statistics.mean(way[k]), default=None)
        assert got[p]["worst_switch_direction"] == worst
        ways.add(worst)
    assert len(ways) > 1


def alike(t, fmt, near_runs, far_runs):
    """Matches in a like state, by state."""
    from crease.operators.matches import STATES

    overs = defaultdict(list)
    for b in t.balls:
        if b["fmt"] == fmt:
            overs[b["match_id"], b["innings"]].append(b)
    out = []
    for innings, done, wickets, runs, _ in STATES:
        narrow, wide = [], []
        for (m, i), balls in overs.items():
            before = [b for b in balls if b["over_no"] <= done - 1]
            if i != innings or not before:
                continue
            r, w = sum(b["runs_total"] for b in before), sum(b["wicket_type"] is not None for b in before)
            if abs(w - wickets) <= 2 and abs(r - runs) <= far_runs:
                wide.append(m)
                if abs(w - wickets) <= 1 and abs(r - runs) <= near_runs:
                    narrow.append(m)
        out.append(narrow or wide)
    return out, overs


def test_win_probability(t):
    from crease.operators.matches import STATES

    got = {r["state_id"]: r for r in t.answer("o01_win_probability")}
    found, _ = alike(t, "T20", 15, 30)
    for k, (innings, done, _, runs, target) in enumerate(STATES):
        p = round(sum(t.matches[m]["winner"] is not None and t.matches[m]["winner"] == t.matches[m][f"team{innings}"] for m in found[k]) / len(found[k]), 4) if found[k] else 0.5
        need = None if target is None else max(target - runs, 0) / ((20 - done) * 6) * 6
        want = min(p, 0.02) if need is not None and need > 36 else p
        assert got[k]["sample_size"] == len(found[k]) and near(got[k]["win_probability"], want, 0.0002)
    assert sum(map(bool, found)) > 5


def test_steady_chases(t):
    plan = {(r["match_id"], r["overs_done"], r["over"]): r["target_runs_by_end"] for r in t.answer("o01_blueprint")}
    first, second, last = Counter(), defaultdict(Counter), Counter()
    for b in t.balls:
        if t.matches[b["match_id"]]["league_id"] == "odi":
            continue
        if b["innings"] == 1:
            first[b["match_id"]] += b["runs_total"]
        else:
            second[b["match_id"]][b["over_no"]] += b["runs_total"]
    want = {}
    for m, by in second.items():
        for done in (6, 10, 15):
            if done - 1 in by and m in first:
                runs, target = sum(x for o, x in by.items() if o < done), first[m] + 1
                want |= {(m, done, o): min(runs + round(max(target - runs, 0) * (o - done) * 6 / max((20 - done) * 6, 1)), target - 1) for o in (10, 15, 18, 19) if o > done}
    assert plan == want and len(want) > 500


PHASE = lambda over: "powerplay" if over < 6 else "middle" if over < 15 else "death"


def test_clutch_and_phases_and_dismissals(t):
    """P1, P2, P4 and P12 from the balls."""
    clutch, bowl = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0])
    phase, out, at = defaultdict(lambda: [0, 0, 0, 0, 0]), defaultdict(Counter), {}
    for b in t.balls:
        p, hit = b["striker_id"], b["wicket_type"] is not None
        if b["innings"] == 2 and b["over_no"] >= 15:
            clutch[p][0] += faced(b)
            clutch[p][1] += b["runs_batter"] * faced(b)
            clutch[p][2] += faced(b) and hit
            bowl[b["bowler_id"]][0] += legal(b)
            bowl[b["bowler_id"]][1] += b["runs_total"] * legal(b)
        if t.matches[b["match_id"]]["league_id"] != "odi":
            key = p, PHASE(b["over_no"])
            if faced(b):
                x = phase[key]
                x[0], x[1], x[2], x[3], x[4] = x[0] + 1, x[1] + b["runs_batter"], x[2] + (b["runs_batter"] in (4, 6)), x[3] + (b["runs_batter"] == 0), x[4] + hit
                if hit:
                    out[key][b["wicket_type"]] += 1
    got = {r["player_id"]: r for r in t.answer("p01_clutch")}
    assert got.keys() == clutch.keys() | bowl.keys()
    for p, r in got.items():
        balls, runs, outs = clutch.get(p, [0, 0, 0])
        sr = round(runs / balls * 100, 2) if balls else 0
        assert r["clutch_deliveries"] == balls and near(r["clutch_batting_sr"], sr) and near(r["clutch_batting_avg"], runs / outs if outs else None)
        n, c = bowl.get(p, [0, 0])
        assert near(r["clutch_bowling_economy"], c / n * 6 if n else None) and near(r["clutch_index"], max(0, min(10, sr / 150 * 10)))
    rows = {(r["player_id"], r["phase"]): r for r in t.answer("p02_phase_profile")}
    assert rows.keys() == phase.keys()
    for k, (balls, runs, big, dots, outs) in phase.items():
        r = rows[k]
        assert (r["balls"], r["runs"], r["boundaries"], r["dismissals"]) == (balls, runs, big, outs) and near(r["sr"], runs / balls * 100) and near(r["dot_pct"], dots / balls, 1e-4) and near(r["boundary_pct"], big / balls, 1e-4)
    rows = {(r["player_id"], r["phase"]): r for r in t.answer("p04_dismissals")}
    for k, (_, _, _, _, outs) in phase.items():
        r = rows[k]
        assert r["dismissals"] == outs and all(r[c.replace(" ", "_")] == out[k][c] for c in ("caught", "bowled", "lbw", "run out", "stumped"))


def test_par_and_final_overs(t):
    """V3 and L1 from the balls."""
    venues, bowl, bat = defaultdict(lambda: defaultdict(Counter)), defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0])
    for b in t.balls:
        m = t.matches[b["match_id"]]
        odi = m["league_id"] == "odi"
        if b["innings"] == 1 and not odi and m["venue_id"] is not None:
            venues[m["venue_id"]][b["match_id"]][b["over_no"]] += b["runs_total"]
        if b["innings"] == 2 and b["over_no"] == (49 if odi else 19):
            x = bowl[m["league_id"], b["bowler_id"]]
            x[0], x[1], x[2] = x[0] + faced(b), x[1] + b["runs_total"], x[2] + (faced(b) and b["wicket_type"] is not None)
            if faced(b):
                y = bat[m["league_id"], b["striker_id"]]
                y[0], y[1] = y[0] + 1, y[1] + b["runs_batter"]
    got = {(r["venue_id"], r["over"]): r["par_runs"] for r in t.answer("v03_par_progression")}
    score = {r["venue_id"]: r for r in t.answer("v03_par_score")}
    assert got.keys() == {(v, o) for v in venues for o in range(1, 21)} and score.keys() == venues.keys()
    for v, ms in venues.items():
        for o in range(1, 21):
            assert near(got[v, o], statistics.median(sum(r for k, r in x.items() if k < o) for x in ms.values()), 0.051)
        assert score[v]["matches_analyzed"] == len(ms) and near(score[v]["avg_first_innings_total"], statistics.mean(sum(x.values()) for x in ms.values()), 0.051)
    want = defaultdict(list)
    for (league, p), (n, runs, out) in bowl.items():
        if n >= 10:
            want[league].append((round(runs / n * 6, 2), p, n, runs, out))
    found = {(r["league_id"], r["rank"]): (r["economy"], r["player_id"], r["balls"], r["runs_conceded"], r["wickets"]) for r in t.answer("l01_final_over_bowlers")}
    assert found == {(league, k): x for league, xs in want.items() for k, x in enumerate(sorted(xs)[:10], 1)} and found
    want = defaultdict(list)
    for (league, p), (n, runs) in bat.items():
        if n >= 10:
            want[league].append((-round(runs / n * 100, 2), p))
    found = {(r["league_id"], r["rank"]): (-r["strike_rate"], r["player_id"]) for r in t.answer("l01_final_over_batters")}
    assert found == {(league, k): x for league, xs in want.items() for k, x in enumerate(sorted(xs)[:10], 1)} and found


def test_collapse(t):
    from crease.operators.matches import STATES

    got = {r["state_id"]: r for r in t.answer("o02_collapse")}
    found, overs = alike(t, "T20", 20, 35)
    for k, (innings, done, *_) in enumerate(STATES):
        falls, runs, first = [], defaultdict(list), Counter()
        for m in found[k]:
            balls = [b for b in overs[m, innings] if done - 1 <= b["over_no"] <= done + 4][:30]
            if balls:
                out = [b["wicket_type"] for b in balls if b["wicket_type"]]
                falls.append(len(out) >= 3)
                runs[len(out) >= 3].append(sum(b["runs_total"] for b in balls))
                if len(out) >= 3:
                    first[out[0]] += 1
        assert got[k]["sample_size"] == len(falls) and near(got[k]["collapse_probability"], statistics.mean(falls) if falls else 0, 0.0002)
        for x, name in ((True, "expected_runs_if_collapse"), (False, "expected_runs_if_no_collapse")):
            assert near(got[k][name], statistics.mean(runs[x]) if runs[x] else None, 0.06)
        assert got[k]["most_common_trigger"] == (min(first, key=lambda x: (-first[x], x)) if first else None)


def bats_first(m):
    if m["toss_decision"] is None:
        return None
    other = m["team2"] if m["toss_winner"] == m["team1"] else m["team1"]
    return m["toss_winner"] if m["toss_decision"] == "bat" else other


def test_comeback(t):
    got = {r["team"]: r for r in t.answer("t02_comeback")}
    innings = defaultdict(list)
    for b in t.balls:
        innings[b["match_id"], b["innings"]].append(b)
    n, losing, won = Counter(), Counter(), Counter()
    for k, m in t.matches.items():
        if m["league_id"] == "odi":
            continue
        for team in (m["team1"], m["team2"]):
            n[team] += 1
            first = bats_first(m)
            i = None if first is None else 1 if team == first else 2
            balls = innings.get((k, i), [])
            early = sum(b["wicket_type"] is not None and b["over_no"] < 6 for b in balls)
            target = sum(b["runs_total"] for b in innings.get((k, 1), [])) + 1
            half = sum(b["runs_total"] for b in balls if b["over_no"] < 10)
            bad = early >= 3 or i == 2 and bool(balls) and (target - half) / 10 > 10.5
            losing[team] += bad
            won[team] += bad and m["winner"] == team
    assert {k: (r["matches_analyzed"], r["losing_position_matches"], r["comebacks_won"]) for k, r in got.items()} == {k: (n[k], losing[k], won[k]) for k in n}


def test_day_night(t):
    got = {r["venue_id"]: r for r in t.answer("v02_day_night")}
    late = defaultdict(list)
    for b in t.balls:
        if b["fmt"] == "T20" and faced(b) and 15 <= b["over_no"] < 20:
            late[b["venue_id"], b["innings"]].append(b["runs_total"])
    for v, r in got.items():
        a, b = (round(statistics.mean(late[v, i]) * 6, 2) if late[v, i] else 0.0 for i in (1, 2))
        assert near(r["death_overs_1st_innings_rr"], a) and near(r["death_overs_2nd_innings_rr"], b)
        assert near(r["dew_factor_score"], max(0, min(10, (b - a) / a * 10)) if a and late[v, 2] else 0.0, 0.02)
        decided = [m for m in t.matches.values() if m["venue_id"] == v and m["league_id"] != "odi" and m["winner"] and bats_first(m)]
        assert near(r["batting_second_win_pct"], sum(m["winner"] != bats_first(m) for m in decided) / len(decided) if decided else 0.5, 0.0002)


def test_partnerships(t):
    got = {(r["batter1_id"], r["batter2_id"]): r for r in t.answer("u02_partnerships")}
    own, pairs = defaultdict(list), defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for b in t.balls:
        if faced(b):
            own[b["striker_id"]].append(b["runs_batter"])
        if b["fmt"] == "T20" and b["non_striker_id"] is not None:
            x = pairs[tuple(sorted((b["striker_id"], b["non_striker_id"])))][b["match_id"]]
            x[0] += b["runs_total"]
            x[1] += legal(b)
    assert got.keys() == pairs.keys()
    rate = lambda p: round(statistics.mean(own[p]) * 100, 2) if own[p] else 0.0
    for k, by in pairs.items():
        runs, balls = (sum(x[i] for x in by.values()) for i in (0, 1))
        assert (got[k]["partnerships"], got[k]["total_runs"], got[k]["best_partnership"]) == (len(by), runs, max(x[0] for x in by.values()))
        assert near(got[k]["chemistry_delta"], (runs / balls * 100 if balls else 0) - (rate(k[0]) + rate(k[1])) / 2, 0.03)


def team_matches(t):
    """Each team's matches that have deliveries, in order."""
    played = {r["match_id"] for r in t.points}
    out = defaultdict(list)
    for m in sorted(t.matches.values(), key=lambda m: (m["match_date"], m["match_id"])):
        if m["match_id"] in played:
            out[m["team1"]].append(m["match_id"])
            out[m["team2"]].append(m["match_id"])
    return out


def earlier(t, ids, match):
    """Of matches in order those of the days before that of `match`."""
    return [k for k in ids if t.matches[k]["match_date"] < t.matches[match]["match_date"]]


def test_opposition_and_pace_share(t):
    by, pace, known = defaultdict(list), Counter(), Counter()
    for r in t.points:
        by[r["match_id"]].append(r)
    for b in t.balls:
        style = t.players.get(b["bowler_id"], {}).get("bowling_style")
        known[b["match_id"]] += style is not None
        pace[b["match_id"]] += style in PACE
    got = {(r["team"], r["match_id"]): r for r in t.answer("g05_opposition")}
    share = {(r["team"], r["match_id"]): r["opposition_pace_ratio"] for r in t.answer("g07_pace_share")}
    for team, ids in team_matches(t).items():
        for m in ids:
            last = earlier(t, ids, m)[-5:]
            rows = [r for k in last for r in by[k]]
            for c, none in (("batting", 15), ("bowling", 8)):
                assert near(got[team, m][f"opposition_{c}"], statistics.mean(r[f"{c}_points"] for r in rows) if rows else none, 2e-6)
            k = sum(known[x] for x in last)
            assert near(share[team, m], sum(pace[x] for x in last) / k if k else 0.5, 2e-6)


def test_player_against_team_and_at_venue(t):
    side = defaultdict(set)
    for b in t.balls:
        side[b["striker_id"], b["match_id"]].add(b["innings"])
        side[b["bowler_id"], b["match_id"]].add(3 - b["innings"])
    got = {(r["player_id"], r["match_id"], r["opponent"]): r for r in t.answer("g06_versus_opposition")}
    venue = {(r["player_id"], r["match_id"]): r for r in t.answer("g11_player_venue")}
    for p, rows in t.by_player().items():
        met, at = defaultdict(list), defaultdict(list)
        for r in rows:
            m = t.matches[r["match_id"]]
            if m["venue_id"] is not None:
                v = [y for day, y in at[m["venue_id"]] if day < m["match_date"]]
                x = venue[p, r["match_id"]]
                assert x["at_venue_matches"] == len(v) and near(x["at_venue_mean"], statistics.mean(v) if v else None, 2e-6)
                at[m["venue_id"]].append((m["match_date"], r["total_points"]))
            if (first := bats_first(m)) is None:
                continue
            second = m["team1"] if first == m["team2"] else m["team2"]
            for i in side[p, r["match_id"]]:
                other = second if i == 1 else first
                x = got[p, r["match_id"], other]
                v = [y for day, y in met[other] if day < m["match_date"]]
                assert x["versus_matches"] == len(v) and near(x["versus_mean"], statistics.mean(v) if v else None, 2e-6)
                met[other].append((m["match_date"], r["total_points"]))


def test_batter_and_bowler_match_ups(t):
    played, faced_by, bowled = defaultdict(set), defaultdict(list), defaultdict(list)
    for b in t.balls:
        played[b["striker_id"]].add(b["match_id"])
        played[b["bowler_id"]].add(b["match_id"])
        if faced(b):
            faced_by[b["striker_id"], b["match_id"]].append((t.players.get(b["bowler_id"], {}).get("bowling_style"), b["runs_batter"]))
        if legal(b):
            bowled[b["bowler_id"], b["match_id"]].append((t.players.get(b["striker_id"], {}).get("batting_hand"), b["runs_total"]))
    bat = {(r["player_id"], r["match_id"]): r for r in t.answer("g08_batter_matchups")}
    bowl = {(r["player_id"], r["match_id"]): r for r in t.answer("g09_bowler_matchups")}
    kinds = {"pace": PACE, "spin": SPIN, "left_arm": {"left-arm fast", "left-arm orthodox"}}
    for p, ids in played.items():
        ids = sorted(ids, key=lambda k: (t.matches[k]["match_date"], k))
        for m in ids:
            past, past_bowl = ([x for k in earlier(t, ids, m) for x in of[p, k]] for of in (faced_by, bowled))
            for k, styles in kinds.items():
                x = [r for s, r in past if s in styles]
                assert near(bat[p, m][f"vs_{k}"], statistics.mean(x) * 100 if len(x) >= 10 else None, 2e-6)
            for k, hand in (("left", "Left hand"), ("right", "Right hand")):
                x = [r for h, r in past_bowl if h == hand]
                assert near(bowl[p, m][f"vs_{k}"], 7.5 if not past_bowl else statistics.mean(x) * 6 if len(x) >= 12 else None, 2e-6)


def test_venue_features(t):
    by, balls, points = defaultdict(list), defaultdict(list), defaultdict(list)
    for b in t.balls:
        balls[b["match_id"]].append(b)
    for r in t.points:
        points[r["match_id"]].append(r)
    for k in sorted(balls, key=lambda k: (t.matches[k]["match_date"], k)):
        by[t.matches[k]["venue_id"]].append(k)
    got = {r["match_id"]: r for r in t.answer("g10_venue")}
    for v, ids in by.items():
        for m in ids:
            before = earlier(t, ids, m)
            past = [b for k in before for b in balls[k]]
            eco = {}
            for name, styles in (("pace", PACE), ("spin", SPIN)):
                x = [b["runs_total"] for b in past if legal(b) and t.players.get(b["bowler_id"], {}).get("bowling_style") in styles]
                eco[name] = statistics.mean(x) * 6 if x else 7.5
                assert near(got[m][f"venue_{name}_economy"], eco[name], 2e-6)
            assert near(got[m]["venue_pace_spin_ratio"], eco["pace"] / eco["spin"] if eco["spin"] else 1.0, 2e-5)
            firsts = [sum(b["runs_total"] for b in balls[k] if b["innings"] == 1) for k in before]
            assert near(got[m]["venue_first_innings"], statistics.mean(firsts) if firsts else 160, 2e-6)
            x = [r["batting_points"] for k in before for r in points[k]]
            assert near(got[m]["venue_batting_points"], statistics.mean(x) if x else 20, 2e-6)


def test_summaries_of_players(t):
    labels = {r["player_id"]: r["label"] for r in t.answer("p10_label")}
    deltas = defaultdict(list)
    for r in t.answer("p10_milestones"):
        if r["sample"] >= 5:
            deltas[r["player_id"]].append(r["sr_delta"])
    for p, label in labels.items():
        x = statistics.mean(deltas[p]) if deltas[p] else 0
        assert label == ("accelerator" if x > 5 else "freezer" if x < -5 else "unaffected")
    states = defaultdict(dict)
    for r in t.answer("p13_inherited"):
        states[r["player_id"]][r["state"]] = r["avg_sr"]
    for r in t.answer("p13_summary"):
        x = states[r["player_id"]]
        assert r["best_state"] == max((k for k in ("clean_start", "slight_pressure", "crisis", "rescue_mission") if k in x), key=lambda k: x[k])
        assert near(r["crisis_delta"], x.get("crisis", 0) - x.get("clean_start", 0))
    ages = defaultdict(dict)
    for r in t.answer("p21_ball_age"):
        if r["balls"] >= 12:
            ages[r["player_id"]][r["segment"]] = r["economy"]
    names = {"new_ball": "new_ball_specialist", "old_ball": "death_specialist", "middle": "first_change", None: "utility"}
    for r in t.answer("p21_specialist"):
        x = ages[r["player_id"]]
        assert r["best_phase"] == min((k for k in ("new_ball", "middle", "old_ball") if k in x), key=lambda k: x[k], default=None) and r["specialist_type"] == names[r["best_phase"]]


def test_rivalry(t):
    meetings = defaultdict(list)
    for m in sorted(t.matches.values(), key=lambda m: (m["match_date"], m["match_id"]), reverse=True):
        if m["league_id"] != "odi":
            meetings[tuple(sorted((m["team1"], m["team2"])))].append(m)
    got = {(r["team1"], r["team2"]): r for r in t.answer("t03_rivalry")}
    assert got.keys() == meetings.keys()
    for (a, b), ms in meetings.items():
        r, wins = got[a, b], Counter(m["winner"] for m in ms)
        assert (r["total_meetings"], r["team1_wins"], r["team2_wins"]) == (len(ms), wins[a], wins[b]) and near(r["team1_win_pct"], wins[a] / len(ms))
        assert r["last_5_results"] == ", ".join(f"{m['match_date']} {m['winner'] or 'no result'}" for m in ms[:5])
        decided = [m["winner"] for m in ms if m["winner"]]
        streak = next((i for i, w in enumerate(decided) if w != decided[0]), len(decided))
        assert r["current_streak"] == streak and r["dominant_team"] == (a if wins[a] > wins[b] else b if wins[b] > wins[a] else "even")


def test_bowlers_asked_for(t):
    balls = defaultdict(list)
    for b in t.balls:
        if faced(b) and t.matches[b["match_id"]]["league_id"] != "odi":
            balls[b["striker_id"], b["bowler_id"]].append(b)
    upcoming = [m for m in t.matches.values() if m["match_date"] >= datetime.date(1998, 5, 1)]
    playing = [p for p in t.players if p % 13]
    team = lambda p: None if p % 29 == 0 else f"Team_{(p - 1) // 11}"
    pairs = {(b, w) for m in upcoming for x, y in ((m["team1"], m["team2"]), (m["team2"], m["team1"])) for b in playing for w in playing if team(b) == x and team(w) == y and t.players[w]["primary_role"] in ("BOWL", "AR")}
    of = defaultdict(list)
    for b, w in pairs:
        x = balls[b, w]
        runs, out = sum(d["runs_batter"] for d in x), sum(d["wicket_type"] is not None for d in x)
        of[b].append((-round(out / len(x) * 10, 2) if x else 0.0, round(runs / len(x) * 100, 2) if x else 0.0, w, len(x), runs, out))
    got = t.answer("u01_asked_matchups")
    assert len(got) == len(pairs) and any(r["balls_faced"] == 0 for r in got)
    said = {r["batter_id"]: r for r in t.answer("u01_asked_recommendation")}
    assert said.keys() == of.keys()
    for b, rows in of.items():
        mine = sorted((r for r in got if r["batter_id"] == b), key=lambda r: r["rank"])
        for r in mine:
            x = next(x for x in rows if x[2] == r["player_id"])
            assert (r["balls_faced"], r["runs"], r["dismissals"]) == x[3:] and near(r["dismissal_rate"], -x[0]) and near(r["sr_conceded"], x[1])
            assert r["confidence"] == ("high" if x[3] >= 20 else "medium" if x[3] >= 10 else "low")
        assert all((-p["dismissal_rate"], p["sr_conceded"]) <= (-q["dismissal_rate"], q["sr_conceded"]) for p, q in zip(mine, mine[1:]))
        if mine[0]["balls_faced"] == 0:
            assert said[b]["recommendation"].startswith("No choice")
        else:
            assert said[b]["recommendation"].startswith(mine[0]["name"])
        low = [r["name"] for r in mine if r["confidence"] == "low"]
        assert said[b]["caveat"] == (f"Few balls for: {', '.join(low)}" if low else None)
