"""From match files to answers: ids in the order of the balls, venues, quarantine, counters, and committed tables."""

import random
from collections import defaultdict

import pytest
import yaml
from pyspark.sql import functions as F

from crease import catalog
from crease.functions.names import resolve_matches
from crease.sources import ingest, loading, projection, snapshots
from crease.sources.snapshots import Change

KINDS = ["caught", "bowled", "lbw", "run out", "stumped", "hit wicket", "caught and bowled"]


def innings(r, team, other):
    """20 overs, some of seven balls and more, in the order they were bowled."""
    overs = []
    for over in range(20):
        balls = []
        for ball in range(r.choice([6, 6, 6, 7, 11])):
            extras = {r.choice(["wides", "noballs", "legbyes"]): 1} if r.random() < 0.1 else {}
            runs = 0 if "legbyes" in extras or "wides" in extras else r.choice([0, 0, 0, 1, 1, 2, 4, 6])
            b = {"batter": f"{team} bat {over // 2}", "bowler": f"{other} bowl {over % 3}", "non_striker": f"{team} bat {over // 2 + 1}", "runs": {"batter": runs, "extras": len(extras), "total": runs + len(extras)}}
            if extras:
                b["extras"] = extras
            if r.random() < 0.08:
                b["wickets"] = [{"kind": r.choice(KINDS), "player_out": b["batter"]}]
            balls.append(b)
        overs.append({"over": over, "deliveries": balls})
    return {"team": team, "overs": overs}


def match(seed, day, venue="Ground", city="Town", **info):
    r = random.Random(seed)
    return {"info": {"teams": ["A", "B"], "dates": [day], "venue": venue, "city": city, "season": 2020, "match_type": "T20", "toss": {"winner": "A", "decision": "bat"}, "outcome": {"winner": "B"}, **info}, "innings": [innings(r, "A", "B"), innings(r, "B", "A")]}


@pytest.fixture()
def folder(tmp_path):
    at = tmp_path / "in"
    for league, name, data in [
        ("ipl", "zz.yaml", match(1, "2020-01-01")), ("ipl", "aa.yaml", match(2, "2020-01-03", "  ground ", "town")), ("bbl", "mm.yml", match(3, "2020-01-02", "Oval", None)), ("bbl", "bb.yaml", match(4, "2020-01-02", None, None)),
    ]:
        (at / league).mkdir(parents=True, exist_ok=True)
        (at / league / name).write_text(yaml.safe_dump(data, sort_keys=False))
    return at


def write(folder, name, data):
    (folder / name).write_text(data if isinstance(data, str) else yaml.safe_dump(data, sort_keys=False))


def balls(data):
    """(innings, over, ball, delivery) of a match file, as bowled."""
    return [(i, o["over"], k, b) for i, inn in enumerate(data["innings"], 1) for o in inn["overs"] for k, b in enumerate(o["deliveries"], 1)]


def own_tables(spark, files):
    """Everything that questions need, from files alone; players are numbered by name."""
    with_ids = ingest.with_match_ids(files)
    venues = ingest.venues(with_ids)
    m, d = ingest.matches(with_ids, venues), ingest.deliveries(with_ids)
    names = d.select(F.explode(F.array("striker", "bowler", "non_striker")).alias("name")).distinct()
    players = ingest.numbered(names, ["name"], "player_id").selectExpr("cast(player_id as int) AS player_id", "name", "'Right hand' AS batting_hand", "cast(null as string) AS bowling_style", "'BAT' AS primary_role", "cast(null as date) AS dob")
    found, stats = resolve_matches(d, m, players.select("name", "player_id"), players.limit(0).select("name", "player_id"))
    assert stats.filter("unresolved > 0 or exact <> total_names").count() == 0
    tables = {"deliveries": found, "matches": m, "players": players, "leagues": spark.sql(projection.leagues())}
    return catalog.over_tables(spark, tables), {r["name"]: r["player_id"] for r in players.collect()}, tables


def test_ids_sort_as_balls_were_bowled_and_stay(spark, folder):
    files = ingest.read_matches(spark, str(folder))
    with_ids = ingest.with_match_ids(files)
    ids = {r["stem"]: (r["match_id"], r["league_id"]) for r in with_ids.collect()}
    assert ids == {"zz": (1, "ipl"), "bb": (2, "bbl"), "mm": (3, "bbl"), "aa": (4, "ipl")}
    d = [(r["match_id"], r["innings"], r["over_no"], r["ball_no"], r["striker"], str(r["over_ball"])) for r in ingest.deliveries(with_ids.repartition(7)).orderBy("delivery_id").collect()]
    want = []
    for stem, (i, league) in sorted(ids.items(), key=lambda x: x[1]):
        data = yaml.safe_load(next((folder / league).glob(f"{stem}.*")).read_text())
        want += [(i, inn, over, k, b["batter"]) for inn, over, k, b in balls(data)]
    assert [x[:5] for x in d] == want and len(want) > 4 * 240
    assert {x[5] for x in d if x[2:4] == (3, 10)} <= {"3.1"}  # as the source writes it
    known = with_ids.select("league_id", "stem", "match_id")
    write(folder, "ipl/first.yaml", match(5, "2019-01-01"))
    again = {r["stem"]: r["match_id"] for r in ingest.with_match_ids(ingest.read_matches(spark, str(folder)), known).collect()}
    assert again == {k: v[0] for k, v in ids.items()} | {"first": 5}


def test_venues_by_name(spark, folder):
    with_ids = ingest.with_match_ids(ingest.read_matches(spark, str(folder)))
    venues = ingest.venues(with_ids)
    assert {r["venue_key"]: r["venue_id"] for r in venues.collect()} == {"ground, town": 1, "oval": 2}
    m = {r["match_id"]: r["venue_id"] for r in ingest.matches(with_ids, venues).collect()}
    assert m == {1: 1, 2: None, 3: 2, 4: 1}
    known = spark.createDataFrame([("oval", 1), ("x", 7)], "venue_key string, venue_id long")
    assert {r["venue_key"]: r["venue_id"] for r in ingest.venues(with_ids, known).collect()} == {"oval": 1, "ground, town": 8}


def test_answers_from_files_are_those_of_plain_loops(spark, folder):
    s, player, _ = own_tables(spark, ingest.read_matches(spark, str(folder)).repartition(5))
    data = [yaml.safe_load(p.read_text()) for p in folder.rglob("*.y*ml")]
    legal = lambda b: next(iter(b.get("extras", {})), "") not in ("wides", "noballs")
    faced = lambda b: next(iter(b.get("extras", {})), "") != "wides"
    near = lambda a, b: abs(a - b) <= 0.0051

    by = defaultdict(list)  # bowler: matches, each the legal balls as bowled
    for m in data:
        mine = defaultdict(list)
        for inn, over, _, b in balls(m):
            if legal(b):
                mine[b["bowler"]].append((inn, over, b["runs"]["total"], bool(b.get("wickets"))))
        for k, v in mine.items():
            by[player[k]].append(v)
    got = {r["player_id"]: r for r in catalog.run(spark, "p03_pressure", s).collect()}
    assert got.keys() == by.keys()
    for p, ms in by.items():
        streaks, quick, boundaries, overs = [], 0, 0, defaultdict(int)
        for k, ball_list in enumerate(ms):
            run, since = 0, None
            for inn, over, runs, out in ball_list:
                overs[k, inn, over] += runs
                run = run + 1 if runs == 0 else 0
                if runs == 0:
                    streaks.append(run) if run == 1 else streaks.__setitem__(-1, run)
                since = 0 if runs >= 4 else None if since is None else since + 1
                boundaries += runs >= 4
                if out and since is not None:
                    quick, since = quick + (since <= 3), None
        r = got[p]
        assert r["total_balls"] == sum(map(len, ms)) and r["max_dot_streak"] == max(streaks)
        assert near(r["avg_consecutive_dots"], sum(streaks) / len(streaks))
        assert abs(r["wicket_after_boundary_rate"] - quick / boundaries) < 1e-4 and abs(r["maiden_rate"] - sum(v == 0 for v in overs.values()) / len(overs)) < 1e-4

    seen = defaultdict(list)  # batter: innings, each the runs of the balls faced
    for m in data:
        mine = defaultdict(list)
        for inn, _, _, b in balls(m):
            if faced(b):
                mine[b["batter"], inn].append(b["runs"]["batter"])
        for (k, _), v in mine.items():
            seen[player[k]].append(v)
    rhythm = {r["player_id"]: r for r in catalog.run(spark, "p09_rhythm", s).collect()}
    assert rhythm.keys() == seen.keys()
    for p, lists in seen.items():
        first = [x for v in lists for x in v[:10]]
        dots, clusters = [], []
        for v in lists:
            run, last = 0, None
            for k, x in enumerate(v):
                run = run + 1 if x == 0 else 0
                if x == 0:
                    dots.append(run) if run == 1 else dots.__setitem__(-1, run)
                if x in (4, 6):
                    if last is not None and k - last <= 3:
                        clusters[-1] += 1
                    else:
                        clusters.append(1)
                    last = k
        r = rhythm[p]
        assert near(r["sr_1_10"], 100 * sum(first) / len(first)) and near(r["avg_dot_streak"], sum(dots) / len(dots) if dots else 0)
        assert near(r["boundary_clustering_score"], sum(clusters) / len(clusters) if clusters else 0) and r["innings_analyzed"] == len(lists)

    curve = defaultdict(list)
    for r in sorted(catalog.run(spark, "m02_momentum", s).collect(), key=lambda r: r["delivery_id"]):
        curve[r["match_id"]].append((r["innings"], r["wp_batting_team"]))
    r2 = lambda x: round(x, 2)
    clamp = lambda x: max(0.05, min(0.95, x))
    for stem, i in (("zz", 1), ("aa", 4)):
        m = yaml.safe_load((folder / "ipl" / f"{stem}.yaml").read_text())
        target = sum(b["runs"]["total"] for inn, _, _, b in balls(m) if inn == 1) + 1
        runs = out = bowled = now = 0
        want = []
        for inn, _, _, b in balls(m):
            if inn != now:
                runs, out, bowled, now = 0, 0, 0, inn
            runs, out, bowled = runs + b["runs"]["total"], out + bool(b.get("wickets")), bowled + faced(b)
            if inn == 1:
                want.append((1, r2(clamp(0.5 - out / 10 * 0.2))))
            else:
                need, left = target - runs, 120 - bowled
                wp = 0.95 if need <= 0 else 0.05 if left <= 0 else r2(clamp(8 / (need / (left / 6)) * 0.5))
                want.append((2, r2(clamp(wp - 0.025 * out))))
        assert len(curve[i]) == len(want) and all(a[0] == b[0] and abs(a[1] - b[1]) <= 0.011 for a, b in zip(curve[i], want))


def test_quarantine_counters_and_a_second_load(spark, folder, tmp_path):
    super_over = match(7, "2020-02-01")
    super_over["innings"].append({"team": "A", "super_over": True, "overs": super_over["innings"][0]["overs"][:1]})
    write(folder, "ipl/super.yaml", super_over)
    write(folder, "ipl/bad.yaml", "info: [broken")
    write(folder, "ipl/zz.yml", match(8, "2020-02-02"))  # its name is loaded already
    write(folder, "ipl/dateless.yaml", {"info": {"teams": ["A", "B"]}, "innings": []})
    store = str(tmp_path / "store")
    n = sum(len([x for x in balls(yaml.safe_load(p.read_text())) if x[0] < 3]) for p in folder.rglob("*.y*ml") if p.stem not in ("bad", "dateless") and p.name != "zz.yml")
    dry = loading.load(spark, str(folder), store, dry_run=True)
    assert snapshots.versions(spark, store) == []
    first = loading.load(spark, str(folder), store)
    assert first == dry == {"files_found": 8, "files_new": 8, "matches_loaded": 5, "deliveries_loaded": n, "files_skipped": 3, "quarantined": 4}
    assert loading.load(spark, str(folder), store) == {"files_found": 8, "files_new": 0, "matches_loaded": 0, "deliveries_loaded": 0, "files_skipped": 0, "quarantined": 0}
    now = snapshots.current(spark, store)
    assert now.version == 1 and now.table("deliveries").count() == n and now.table("matches").count() == 5
    held = sorted((r["path"].rsplit("/", 1)[1], r["reason"].split(":")[0], r["innings"], r["balls"]) for r in now.table("quarantine").collect())
    assert held == [("bad.yaml", "unreadable", None, 0), ("dateless.yaml", "no date", None, 0), ("super.yaml", "innings after the second", 3, len(super_over["innings"][2]["overs"][0]["deliveries"])), ("zz.yml", "match of this league and name is loaded", None, 0)]
    ids = {(r["league_id"], r["stem"]): r["match_id"] for r in now.table("files").collect() if r["match_id"]}
    write(folder, "bbl/early.yaml", match(9, "2001-01-01", "New Park", None))
    more = loading.load(spark, str(folder), store)
    assert (more["files_new"], more["matches_loaded"], more["quarantined"]) == (1, 1, 0)
    now = snapshots.current(spark, store)
    assert {(r["league_id"], r["stem"]): r["match_id"] for r in now.table("files").collect() if r["match_id"]} == ids | {("bbl", "early"): 6}
    assert {r["venue_key"]: r["venue_id"] for r in now.table("venues").collect()} == {"ground, town": 1, "oval": 2, "new park": 3}
    assert now.table("deliveries").selectExpr("count(*) = count(distinct delivery_id)").first()[0]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_committed_changes_read_what_they_write(spark, tmp_path):
    at = str(tmp_path / "t")
    make = lambda *x: spark.createDataFrame(list(x), "id int, x string, y string")
    one = snapshots.commit(snapshots.current(spark, at), {"t": Change("append", make((1, "a", None), (2, "", "q"), (None, "n", None)), ("id",), 4)})
    two = snapshots.commit(one, {"t": Change("upsert", make((2, "b", "c"), (3, "d", None)))})
    three = snapshots.commit(two, {"t": Change("fill_nulls", make((1, "z", "w"), (None, "z", "v")))})
    four = snapshots.commit(three, {"t": Change("update", spark.createDataFrame([(3, "u"), (9, "u")], "id long, x string")), "s": Change("append", make((7, "s", "s")))})
    five = snapshots.commit(four, {"t": Change("delete", make((1, None, None)))})
    six = snapshots.commit(five, {"t": Change("insert_if_absent", make((3, "no", "no"), (5, "e", "e"), (5, "f", "f"), (None, "no", None)))})
    assert rows(one.table("t")) == [(1, "a", None), (2, "", "q"), (None, "n", None)]  # readers of old versions keep them
    assert rows(two.table("t")) == [(1, "a", None), (2, "b", "c"), (3, "d", None), (None, "n", None)]
    assert rows(three.table("t")) == [(1, "a", "w"), (2, "b", "c"), (3, "d", None), (None, "n", "v")]
    assert rows(four.table("t")) == [(1, "a", "w"), (2, "b", "c"), (3, "u", None), (None, "n", "v")] and four.table("s").count() == 1
    assert rows(snapshots.current(spark, at).table("t")) == rows(six.table("t")) == [(2, "b", "c"), (3, "u", None), (5, "f", "f"), (None, "n", "v")]
    untouched = {b: p for b, p in one.tables["t"]["parts"].items()}
    assert any(six.tables["t"]["parts"].get(b) == p for b, p in untouched.items()) or len(untouched) < 3
    assert snapshots.clean(spark, at) > 0 and snapshots.versions(spark, at) == [5, 6]
    assert rows(snapshots.current(spark, at).table("t")) == rows(five.table("t").unionByName(make((5, "f", "f"))))


def test_a_crash_or_another_writer_leaves_the_version(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    make = lambda *x: spark.createDataFrame(list(x), "id int, x string")
    one = snapshots.commit(snapshots.current(spark, at), {"t": Change("append", make((1, "a"), (2, "b")), ("id",))})
    reading = one.table("t")
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            snapshots.commit(one, {"t": Change("delete", make((1, "")))})
    assert snapshots.current(spark, at).version == 1 and rows(snapshots.current(spark, at).table("t")) == [(1, "a"), (2, "b")]
    (tmp_path / "t/_versions/000000000002").write_text('{"tables": {"t"')  # a writer that died in the pointer
    assert snapshots.current(spark, at).version == 1
    two = snapshots.commit(one, {"t": Change("upsert", make((1, "c")))})
    assert two.version == 3 and rows(reading) == [(1, "a"), (2, "b")] and rows(snapshots.current(spark, at).table("t")) == [(1, "c"), (2, "b")]
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(one, {"t": Change("upsert", make((1, "d")))})
    assert rows(snapshots.current(spark, at).table("t")) == [(1, "c"), (2, "b")]


def test_writes_with_clashing_columns_and_null_keys(spark):
    old = spark.createDataFrame([(1, None, "s", None), (None, "", "t", None), (2, "k", "u", None)], "id int, side string, row string, seen string")
    new = spark.createDataFrame([(1, "a", "x"), (1, "b", "w"), (None, "n", "y"), (5, "e", "z")], "id int, side string, row string")
    assert rows(ingest.fill_nulls(old, new, "id")) == [(1, "b", "s", None, "updated"), (2, "k", "u", None, "skipped"), (5, "e", "z", None, "inserted"), (None, "n", "t", None, "updated")]
    assert rows(ingest.fill_nulls(ingest.fill_nulls(old, new, "id").drop("outcome"), new, "id").drop("outcome")) == rows(ingest.fill_nulls(old, new, "id").drop("outcome"))
    assert rows(ingest.update(old, new, ["id"])) == [(1, "b", "w", None), (2, "k", "u", None), (None, "n", "y", None)]
    assert rows(ingest.upsert(old.drop("seen"), new, ["id"])) == [(1, "b", "w"), (2, "k", "u"), (5, "e", "z"), (None, "n", "y")]


def test_pitch_lists_any_kind_of_wicket(spark, folder):
    s, _, _ = own_tables(spark, ingest.read_matches(spark, str(folder)))
    got = {r["match_id"]: r["wicket_types"] for r in catalog.run(spark, "m01_pitch", s, after_over=20).collect()}
    want = {}
    for stem, i in (("zz", 1), ("bb", 2), ("mm", 3), ("aa", 4)):
        data = yaml.safe_load(next(folder.rglob(f"{stem}.*")).read_text())
        out = defaultdict(int)
        for inn, _, _, b in balls(data):
            if inn == 1 and b.get("wickets"):
                out[b["wickets"][0]["kind"]] += 1
        want[i] = ", ".join(f"{k}: {n}" for k, n in sorted(out.items()))
    assert got == want and any("hit wicket" in x for x in want.values()) and any("caught and bowled" in x for x in want.values())


def test_checks_find_what_is_broken_in_two_scans(spark, sf_dir, folder):
    s, _, tables = own_tables(spark, ingest.read_matches(spark, str(folder)))
    level = {r["check_name"]: (r["n"], r["total"], r["level"]) for r in catalog.run(spark, "d02_checks", s).collect()}
    n = tables["deliveries"].count()
    assert level["duplicate_balls"] == (0, n, "ok") and level["missing_style"][2] == "warning" and level["low_ball_matches"] == (0, 4, "ok")
    d = tables["deliveries"]
    broken = d.unionByName(d.filter("match_id = 1").limit(3)).unionByName(d.filter("match_id = 2").limit(2).withColumn("match_id", F.lit(99).cast("long")).withColumn("delivery_id", F.col("delivery_id") * 1000)).withColumn("bowler_id", F.when(F.col("over_no") > 5, F.col("bowler_id")))
    level = {r["check_name"]: (r["n"], r["level"]) for r in catalog.run(spark, "d02_checks", catalog.over_tables(spark, tables | {"deliveries": broken})).collect()}
    assert level["duplicate_balls"] == (3, "critical") and level["orphan_deliveries"] == (2, "critical") and level["null_bowler"][1] == "critical" and level["null_striker"] == (0, "ok")
    for name in ("d02_checks", "d07_report"):
        df = catalog.queries()[name](spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        scans = [x for x in plan.split("\n") if "FileScan" in x]
        assert sum("delivery_id#" in x or "striker_id#" in x for x in scans) <= 2 and not any("l_orderkey" in x for x in scans)


def test_mapping_files_and_what_they_mean(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("cricsheet_name,espn_id,note\n A One ,1,x\n#Hash,2,\nB,two,\n,3,\nC,,\nA One,9,later\n")
    (tmp_path / "names.csv").write_text("name,player_id\nD, 4 \n")
    (tmp_path / "over.csv").write_text("cricsheet_name,player_id,notes\n# a comment,1,\nE,5,why\nF,x,\n")
    (tmp_path / "styles.csv").write_text("raw_label,enum_value\nRight-Arm Fast ,right-arm fast\nLegbreak, legbreak\n")
    at = lambda x: str(tmp_path / x)
    assert rows(ingest.player_ids(spark, at("ids.csv"))) == [("#Hash", 2), ("A One", 9)]
    assert rows(ingest.player_ids(spark, at("names.csv"))) == [("D", 4)] and rows(ingest.manual_overrides(spark, at("over.csv"))) == [("E", 5)]
    assert ingest.style_labels(spark, at("styles.csv")) == {"right-arm fast": "right-arm fast", "legbreak": "legbreak"}
    assert rows(ingest.player_ids(spark, at("none.csv"))) == [] and ingest.style_labels(spark, at("none.csv")) == {}
