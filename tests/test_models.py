"""Form against a plain loop, metrics against the definition, trained models, and the momentum curve over a stream."""

import datetime
import math
import re

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor

from crease import catalog
from crease.operators import features, models
from crease.sources import ingest
from crease.streaming import momentum


@pytest.fixture(scope="module")
def dialect(sf_dir):
    return catalog.spark_dialect(sf_dir)


def test_form_is_that_of_a_plain_loop(spark, dialect):
    per = spark.sql(f"""{dialect.base}, b AS (SELECT striker_id AS p, match_id, sum(runs_batter) AS runs, count(*) AS balls FROM d WHERE faced GROUP BY 1, 2),
      w AS (SELECT bowler_id AS p, match_id, count(CASE WHEN legal THEN 1 END) AS bowled, count(CASE WHEN wicket_type <> 'run out' THEN 1 END) AS wickets FROM d GROUP BY 1, 2)
      SELECT coalesce(b.p, w.p) AS p, coalesce(b.match_id, w.match_id) AS match_id, runs, balls, bowled, wickets FROM b FULL JOIN w ON b.p = w.p AND b.match_id = w.match_id""").collect()
    stats = {(r["p"], r["match_id"]): r for r in per}
    dates = {r["match_id"]: r["match_date"] for r in spark.sql(f"{dialect.base} SELECT match_id, match_date FROM matches").collect()}
    points = {}
    for r in catalog.run(spark, "f06_fantasy_points", dialect).collect():
        points.setdefault(r["player_id"], []).append((dates[r["match_id"]], r["match_id"], r["total_points"], r["training_exclude"]))
    got = {(r["player_id"], r["match_id"]): r for r in catalog.run(spark, "g02_form", dialect).collect()}
    assert got
    for player, rows in points.items():
        rows.sort()
        for day, match, _, out in rows:
            if out:
                assert (player, match) not in got
                continue
            r = got[player, match]
            before = [x for x in rows if x[0] < day]
            pts = [x[2] for x in before if not x[3]]
            n = len(pts)
            assert r["prior_matches"] == n
            weights = [0.3 ** (n - 1 - k) for k in range(n)]
            assert math.isclose(r["points_faded_mean"], np.average(pts, weights=weights) if n else 0, abs_tol=2e-6)
            assert math.isclose(r["points_trend"], np.polyfit(range(min(n, 5)), pts[-5:], 1)[0] if n >= 3 else 0, abs_tol=2e-6)
            earlier = [stats.get((player, x[1])) for x in before]
            bat = [s for s in earlier if s and s["runs"] is not None][-5:]
            bowl = [s for s in earlier if s and s["bowled"]][-5:]
            assert math.isclose(r["runs_mean_5"], sum(s["runs"] for s in bat) / len(bat) if bat else 0, abs_tol=2e-6)
            assert math.isclose(r["wickets_mean_5"], sum(s["wickets"] for s in bowl) / len(bowl) if bowl else 0, abs_tol=2e-6)


def test_metrics_are_those_of_the_definition(spark):
    rows = [(m, p, float((m * 7 + p * 5) % 13), float((m * 3 + p * 11) % 9)) for m in range(6) for p in range(12 if m else 5)]
    got = models.metrics(spark.createDataFrame(rows, "match_id int, player_id int, target double, prediction double")).first()
    y, p = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    best = lambda m, k: {r[1] for r in sorted((r for r in rows if r[0] == m), key=lambda r: (-r[k], r[1]))[:11]}
    assert got["n"] == len(rows)
    assert math.isclose(got["rmse"], np.sqrt(np.mean((y - p) ** 2)))
    assert math.isclose(got["spearman"], np.corrcoef(rank(y), rank(p))[0, 1])
    assert math.isclose(got["top_11_overlap"], np.mean([len(best(m, 2) & best(m, 3)) / 11 for m in range(1, 6)]))


def test_models_learn_are_saved_and_tested_forward(spark, tmp_path):
    day = datetime.date(2020, 1, 1)
    rows = [(k % 40, k, day + datetime.timedelta(k % 40 * 5), "ipl", "2024" if k % 40 == 39 else "2020", float(k % 7 * 10), float(k % 7), None if k % 5 == 0 else 1.0) for k in range(800)]
    df = spark.createDataFrame(rows, "match_id int, player_id int, match_date date, league_id string, season string, target double, a double, b double")
    train, val = models.split(df, "2020-05-01")
    assert train.count() + val.count() == 780
    model = models.fit_points(train, val, ["a", "b"], trees=60)
    again = models.load(str(tmp_path), models.save(model, str(tmp_path), "v1").rsplit("_", 1)[1])
    models.save(model, str(tmp_path), "v0")
    assert models.newest(spark, str(tmp_path)) == "v1"
    with pytest.raises(FileNotFoundError):
        models.newest(spark, str(tmp_path / "none"))
    scored = models.predict(again, val, ["a", "b"]).collect()
    assert len(scored) == val.count() and min(r["rank"] for r in scored) == 1
    assert models.metrics(models.score(model, val, ["a", "b"])).first()["spearman"] > 0.9
    assert {r["feature"]: r["importance"] for r in models.importance(spark, model, ["a", "b"]).collect()}["a"] > 0.9
    assert models.windows(df, 60, 60, 100, 50) == [day + datetime.timedelta(60 * k) for k in (1, 2, 3)]
    folder = str(tmp_path / "windows")
    options = {"step": 60, "days": 60, "trees": 5, "least_train": 100, "least_validation": 50, "features": ["a", "b"]}
    got = models.backtest(df, folder, **options).orderBy("cursor_date").collect()
    assert [r["verdict"] for r in got] == ["good"] * 3 and all(0 < r["trees"] <= 5 for r in got)
    for r in got:
        until = r["cursor_date"] + datetime.timedelta(60)
        before, after = df.filter(df["match_date"] < r["cursor_date"]), df.filter((df["match_date"] >= r["cursor_date"]) & (df["match_date"] < until))
        one = models.fit_points(before, after, ["a", "b"], trees=5)
        assert (before.count(), models.grown(one)) == (r["n_train"], r["trees"])
        assert math.isclose(models.metrics(models.score(one, after, ["a", "b"])).first()["rmse"], r["rmse"], rel_tol=1e-9)
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "windows").rglob("*.parquet")}
    last = max(p for p in kept if "cursor=" in str(p)).parent
    (last / "_SUCCESS").unlink()  # as a run that was cut off leaves it
    again = models.backtest(df, folder, **options).orderBy("cursor_date").collect()
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "windows").rglob("*.parquet")}
    assert again == got and {p for p in kept if now.get(p) != kept[p]} == {p for p in kept if p.parent == last}
    assert models.backtest(df, folder, least_train=10**6).count() == 0


def test_boosting_keeps_the_best_trees_and_ends_with_patience(spark):
    assert models.best_prefix([5, 4, 4.5, 3, 3.5, 3.2, 3.1], 3) == (4, True)
    assert models.best_prefix([5, 4, 4.5, 3, 3.5], 3) == (4, False) and models.best_prefix([1, 2, 3, 0], 2) == (1, True)
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 2))
    y = 3 * (x[:, 0] > 0) + r.normal(size=600)  # a signal of one split, the rest is noise
    rows = spark.createDataFrame([(float(a), float(b), float(c), k) for k, ((a, b), c) in enumerate(zip(x, y))], "a double, b double, target double, k int")
    train, held = rows.filter("k < 300"), rows.filter("k >= 300")
    model = models.fit_points(train, held, ["a", "b"], trees=200, patience=8)
    n = models.grown(model)
    assert 5 < n < 200
    error = lambda m: models.score(m, held.selectExpr("*", "0 AS match_id", "k AS player_id"), ["a", "b"]).selectExpr("avg(pow(target - prediction, 2))").first()[0]
    of = {k: error(models.fit_points(train, train, ["a", "b"], trees=k, patience=300)) for k in (n - 3, n, n + 6)}
    assert math.isclose(of[n], error(model), rel_tol=1e-9) and of[n] < of[n - 3] and of[n] < of[n + 6]


def test_trees_are_grown_on_as_many_parts_as_the_rows_need(spark, monkeypatch):
    """A matrix dealt by player comes in hundreds of parts, most of them empty; each tree asks every part several times."""
    fit, parts = GBTRegressor.fit, []
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, rows: parts.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    rows = spark.range(300).selectExpr("id % 30 AS match_id", "id AS player_id", "cast(id % 5 as double) AS a", "cast(id % 5 as double) AS target")
    models.fit_points(rows.repartition(200, "match_id"), rows.repartition(150, "match_id"), ["a"], trees=2)
    monkeypatch.setattr(models, "PART_ROWS", 100)
    models.fit_points(rows.repartition(200, "match_id"), rows, ["a"], trees=2)
    assert parts == [1, 3]
    placed = lambda df: [[tuple(r) for r in part] for part in models.dealt(df, 300).rdd.glom().collect()]
    one, other = placed(rows), placed(rows.orderBy("a").repartition(7))
    assert one == other and len(one) == 3 and sorted(r for part in one for r in part) == sorted(tuple(r) for r in rows.collect())


def test_matrix_of_the_models_is_g14(spark, sf_dir):
    s = catalog.stored_dialect(spark, sf_dir)
    got, want = catalog._matrix(spark, s), catalog.run(spark, "g14_matrix", s)
    assert got.columns == want.columns and got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
    assert got.rdd.getNumPartitions() == 1


def test_no_leakage_in_the_matrix(spark, dialect):
    whole = {(r["player_id"], r["match_id"]): r for r in catalog.run(spark, "g14_matrix", dialect).collect()}
    tables = {t: spark.sql(f"{dialect.base} SELECT * FROM {t}") for t in ("deliveries", "matches", "players", "leagues")}
    cut = sorted(r["match_date"] for r in tables["matches"].collect())[18]
    tables["matches"] = tables["matches"].filter(f"match_date <= date '{cut}'")
    part = {(r["player_id"], r["match_id"]): r for r in catalog.run(spark, "g14_matrix", catalog.over_tables(spark, tables)).collect()}
    assert 0 < len(part) < len(whole) and all(whole[k] == v for k, v in part.items())


def test_inference_matrix_is_the_training_matrix_of_what_was_played(spark):
    """On all days, those with several matches of a player or team too, both know the same."""
    s = catalog.stored_dialect(spark, "/root/testdata/sf0.01")
    day = {r["match_id"]: r for r in spark.sql(f"{s.base} SELECT match_id, match_date, toss_decision, count(*) OVER (PARTITION BY match_date) AS n FROM matches").collect()}
    trained = {(r["player_id"], r["match_id"]): r for r in catalog.run(spark, "g14_matrix", s).collect()}
    asked = catalog.run(spark, "g16_inference_matrix", s).collect()
    assert len({(r["upcoming_id"], r["player_id"]) for r in asked}) == len(asked)
    squads = spark.sql(f"{s.base} SELECT upcoming_id, player_id, team, credits FROM squads WHERE is_playing_xi").collect()
    assert {(r["upcoming_id"], r["player_id"]) for r in asked} == {(r["upcoming_id"], r["player_id"]) for r in squads}
    assert all(r["credits"] == 8.0 for r in asked if r["player_id"] % 10 == 0)
    both = [(r, trained[r["player_id"], r["upcoming_id"]]) for r in asked if (r["player_id"], r["upcoming_id"]) in trained and day[r["upcoming_id"]]["toss_decision"] and r["player_id"] % 29]
    assert len(both) > 200 and sum(day[r["upcoming_id"]]["n"] > 1 for r, _ in both) > 20
    assert [(r["player_id"], r["upcoming_id"], c, r[c], x[c]) for r, x in both for c in features.FEATURES if r[c] != x[c]] == []


@pytest.mark.parametrize("name", ["g14_matrix", "g16_inference_matrix"])
def test_matrices_read_the_facts_three_times_at_most(spark, sf_dir, name):
    """One stream by player, one by team, one by venue; small tables besides."""
    df = catalog.queries()[name](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert sum("points#" in line or "bats#" in line for line in scans) == 3 and not any("runs_total#" in line for line in scans)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 10 and "lineitem" not in plan


def test_what_is_asked_of_players_without_a_past(spark, dialect):
    """Own tables of matches to come: unknown players, venues and teams, no toss, a team left out."""
    s = dialect
    tables = {t: spark.sql(f"{s.base} SELECT * FROM {t}") for t in ("deliveries", "matches", "players", "leagues")}
    day = datetime.date(1990, 1, 1)
    tables["upcoming"] = spark.createDataFrame([(1, day, "none", None, "A", "B", None, None), (2, datetime.date(2000, 1, 1), "ipl", 1, "Team_0", "Team_1", "Team_1", "field")], "upcoming_id int, match_date date, league_id string, venue_id int, team1 string, team2 string, toss_winner string, toss_decision string")
    tables["squads"] = spark.createDataFrame([(1, 1, None, None, True), (1, 999, "B", 9.5, True), (1, 2, "A", 9.0, False), (2, 1, "Team_0", 9.0, True)], "upcoming_id int, player_id int, team string, credits double, is_playing_xi boolean")
    tables["asked"] = spark.createDataFrame([(1, day), (999, day), (1, datetime.date(2000, 1, 1)), (1, day)], "player_id int, day date")
    own = catalog.over_tables(spark, tables)
    got = {(r["upcoming_id"], r["player_id"]): r for r in catalog.run(spark, "g16_inference_matrix", own).collect()}
    assert set(got) == {(1, 1), (1, 999), (2, 1)}
    r = got[1, 1]
    assert (r["team"], r["credits"], r["prior_matches"], r["days_since_last"], r["points_mean_5"], r["versus_mean"], r["versus_matches"]) == ("A", 8.0, 0, 999, 0.0, None, 0)
    assert (r["opposition_batting"], r["opposition_bowling"], r["opposition_pace_ratio"], r["vs_pace"], r["vs_left"]) == (15.0, 8.0, 0.5, None, 7.5)
    assert (r["venue_first_innings"], r["at_venue_mean"], r["at_venue_matches"], r["toss_won"], r["batting_first"], r["league_difficulty"], r["league_tier"]) == (None, None, 0, 0, 0, 1.0, 2)
    assert (got[1, 999]["credits"], got[1, 999]["is_bat"], got[1, 999]["age"]) == (9.5, 0, None)
    r = got[2, 1]
    born = tables["players"].filter("player_id = 1").first()["dob"]
    assert math.isclose(r["age"], (datetime.date(2000, 1, 1) - born).days / 365.25, abs_tol=1e-6)
    assert r["prior_matches"] > 0 and r["venue_first_innings"] > 0 and (r["toss_won"], r["batting_first"]) == (0, 1)
    form = {(r["player_id"], r["day"]): r["prior_matches"] for r in catalog.run(spark, "g03_form_at", own).collect()}
    assert form == {(1, day): 0, (999, day): 0, (1, datetime.date(2000, 1, 1)): got[2, 1]["prior_matches"]}


def test_outcomes_and_stored_predictions(spark):
    rows = spark.createDataFrame([(k, k % 2, k % 3 % 2, float(k % 2 * 9), 1.0, 5.0, None, k % 2) for k in range(120)], "match_id int, toss_first_team int, toss_bat int, batting_1 double, bowling_1 double, batting_2 double, bowling_2 double, target int")
    model = models.fit_outcome(rows.filter("match_id < 80"), rows.filter("match_id >= 80"), trees=20)
    predicted = model.transform(models.numbers(rows, models.OUTCOME)).withColumnRenamed("prediction", "predicted")
    assert tuple(models.accuracy(predicted).first()) == (120, 1.0)
    assert tuple(models.accuracy(predicted.filter("false")).first()) == (0, None)
    train = spark.createDataFrame([(k, float(k % 5), float(k % 5)) for k in range(100)], "k int, a double, target double")
    points = models.fit_points(train.filter("k < 80"), train.filter("k >= 80"), ["a"], trees=10)
    matrix = spark.createDataFrame([(1, 1, "A", 8.0, 4.0), (1, 2, "B", 8.0, 0.0), (2, 1, "A", 8.0, None)], "upcoming_id int, player_id int, team string, credits double, a double")
    new = models.predict_upcoming(points, matrix, "v1", ["a"])
    assert [(r["upcoming_id"], r["player_id"], r["rank"]) for r in new.orderBy("upcoming_id", "rank").collect()] == [(1, 1, 1), (1, 2, 2), (2, 1, 1)]
    keys = ["player_id", "upcoming_id", "model_version"]
    twice = ingest.upsert(ingest.upsert(new, new, keys), models.predict_upcoming(points, matrix, "v2", ["a"]), keys)
    assert twice.count() == 6 and twice.groupBy("model_version").count().filter("count = 3").count() == 2


def test_momentum_over_a_stream_is_that_over_tables(spark, dialect, tmp_path):
    d = spark.sql(f"{dialect.base} SELECT delivery_id, match_id, innings, over_no, ball_no, extras_type, runs_total, wicket_type, cast(match_date as timestamp) + make_interval(0, 0, 0, 0, 0, cast(delivery_id % 240 as int)) AS bowled_at FROM d WHERE match_id < 6")
    source = tmp_path / "in"
    for k, part in enumerate(("delivery_id % 240 < 70", "delivery_id % 240 BETWEEN 60 AND 150", "delivery_id % 240 > 140")):  # the parts overlap: repeats
        d.filter(part).coalesce(1).write.mode("append").option("maxRecordsPerFile", 0).parquet(str(source / str(k)))
    stream = spark.readStream.schema(momentum.INPUT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    q = momentum.momentum(stream, late="20 years").writeStream.format("memory").queryName("curve").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    got = {r["delivery_id"]: r["wp_batting_team"] for r in spark.table("curve").collect()}
    want = {r["delivery_id"]: r["wp_batting_team"] for r in catalog.run(spark, "m02_momentum", dialect).filter("match_id < 6").collect()}
    assert len(got) == spark.table("curve").count() and got.keys() == want.keys()
    assert [(k, got[k], want[k]) for k in want if not math.isclose(got[k], want[k], abs_tol=1e-9)] == []
