"""Queries by name, for Spark and as SQL for the engine that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crease.functions import names
from crease.functions.dialect import Dialect
from crease.operators import client, fantasy, features, lineup, matches, models, players, service, upcoming
from crease.session import kept, shared_path
from crease.sources import projection

#: Date from which the order tables' matches are kept from the models' training.
CUTOFF = "1997-06-01"
TEMPLATES = {**players.QUERIES, **matches.QUERIES, **fantasy.QUERIES, **features.QUERIES, **upcoming.QUERIES, **client.QUERIES, **service.QUERIES}


#: Formats that a question can be asked of.
FORMATS = ("T20", "ODI")
#: Templates whose answer depends on the format: these are registered for each.
BY_FORMAT = [name for name, f in TEMPLATES.items() if f(probe := Dialect("duckdb", {}), fmt="ODI") != f(probe)]
#: Bytes of the order tables for which a query's large tables get a part more; below LEAST_PARTS of them, Spark chooses.
PART, LEAST_PARTS = 2 << 20, 20
#: Tables written once a session and state of the data: (application, folder, state) to the SQL that reads them.
_stored: dict[tuple, dict[str, str]] = {}


def spark_dialect(sf_dir: str) -> Dialect:
    return Dialect("spark", projection.tables(*(f"parquet.`{sf_dir}/{t}.parquet`" for t in ("lineitem", "orders", "customer"))), f"parquet.`{sf_dir}/events.parquet`", f"parquet.`{sf_dir}/pages.parquet`")


def duckdb_dialect() -> Dialect:
    return Dialect("duckdb", projection.tables("lineitem", "orders", "customer"))


def over_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> Dialect:
    """The dialect over a user's own deliveries, matches, players and leagues (and venues); several can be in use at once.

    Questions on what is to come read the tables upcoming and squads, asked (player_id, day) or attacks (batter_id, bowler_id) too.
    """
    own = uuid.uuid4().hex
    for name, df in tables.items():
        df.createOrReplaceTempView(f"crease_{name}_{own}")
    at = {name: f"SELECT * FROM crease_{name}_{own}" for name in tables}
    venues = at.pop("venues", projection.VENUES)  # after d, which it is made from
    return Dialect("spark", {**at, "d": projection.JOINED, "venues": venues})


def store(spark: SparkSession, dialect: Dialect) -> Dialect:
    """Write what queries begin with to the shared folder, so that they scan it as compact tables instead of deriving it anew: the matches, the deliveries, alone and joined, the fantasy points, the players' matches and, where there are matches to come, who is asked for and who bowls to whom."""
    folder = shared_path(spark, f"crease-tables-{uuid.uuid4().hex}")
    begin = {"matches": lambda s: s.base, "deliveries": lambda s: s.base, "d": lambda s: s.base, "fp": fantasy.points, "pm": features.histories}
    if "attacks" in dialect.tables:
        begin["attacks"] = lambda s: s.base
    if "upcoming" in dialect.tables:
        begin["ask"] = lambda s: f"{s.base}, {upcoming.asked(s)}"
    for name, query in begin.items():
        spark.sql(f"{query(dialect)} SELECT * FROM {name}").write.parquet(f"{folder}/{name}")
        dialect = replace(dialect, stored={**dialect.stored, name: f"SELECT * FROM parquet.`{folder}/{name}`"})
    return dialect


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Bytes, files and time of change of each source table: what is stored is made anew once they differ."""
    out = []
    for name in ("lineitem", "orders", "customer"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        size = fs.getContentSummary(at)
        out.append((size.getLength(), size.getFileCount(), fs.getFileStatus(at).getModificationTime()))
    return tuple(out)


def stored_dialect(spark: SparkSession, sf_dir: str) -> Dialect:
    """The dialect over the order tables of `sf_dir`, its derived tables written at the first call in a session, and again when the data has changed."""
    state = _state(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, state)
    if key not in _stored:
        _stored[key] = store(spark, spark_dialect(sf_dir)).stored
    parts = sum(size for size, *_ in state) // PART
    return replace(spark_dialect(sf_dir), stored=_stored[key], parts=parts if parts >= LEAST_PARTS else 0)


def run(spark: SparkSession, name: str, dialect: Dialect, season: str | None = None, **options) -> DataFrame:
    """The query over all seasons or one; a format is given in either case of letters."""
    if "fmt" in options:
        options["fmt"] = options["fmt"].upper()
        if options["fmt"] not in FORMATS:
            raise ValueError(f"fmt must be one of {', '.join(FORMATS)}")
    return spark.sql(TEMPLATES[name](dialect if season is None else dialect.of_season(season), **options))


def _until(rows: DataFrame, cutoff: str, months: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rows of before `cutoff`: those that trees are grown on, and those of the last `months`, which end the boosting; all of them for both where either has none."""
    stop, day = F.add_months(F.lit(cutoff).cast("date"), -months), F.col("match_date")
    known = rows.filter(day < F.lit(cutoff).cast("date"))
    grown, held = known.filter(day < stop), known.filter(day >= stop)
    return (known, known) if grown.isEmpty() or held.isEmpty() else (grown, held)


def _matrix(spark: SparkSession, s: Dialect) -> DataFrame:
    """`g14_matrix`, dealt for the models: the query's own parts are by player, most of them empty where tables are large."""
    n = spark.sql(f"SELECT count(*) FROM ({s.stored['pm']})").first()[0]
    return models.dealt(run(spark, "g14_matrix", s), n)


#: Models of points of a session and state of the data: (application, folder, state, cutoff) to the model.
_models: dict[tuple, PipelineModel] = {}


def _points_model(spark: SparkSession, sf_dir: str, cutoff: str, known: DataFrame) -> PipelineModel:
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir), cutoff)
    if key not in _models:
        _models[key] = models.fit_points(*_until(known, cutoff))
    return _models[key]


def x01_points_model(spark: SparkSession, sf_dir: str, cutoff: str = CUTOFF) -> DataFrame:
    """Metrics, and trees kept, of a model of points on the matches from `cutoff` on, which neither training nor its early stop has seen."""
    known, test = models.split(kept(_matrix(spark, stored_dialect(spark, sf_dir))), cutoff)
    model = _points_model(spark, sf_dir, cutoff, known)
    return models.metrics(kept(models.score(model, test))).withColumn("trees", F.lit(models.grown(model)))


def x02_outcome_model(spark: SparkSession, sf_dir: str, cutoff: str = CUTOFF) -> DataFrame:
    """Predicted and real winner (1: the first team) of every match from `cutoff` on, fitted on those before."""
    rows = kept(run(spark, "g15_outcome_rows", stored_dialect(spark, sf_dir)))
    test = rows.filter(F.col("match_date") >= F.lit(cutoff).cast("date"))
    model = models.fit_outcome(*_until(rows, cutoff))
    return model.transform(models.numbers(test, models.OUTCOME)).select("match_id", F.col("target").cast("long").alias("target"), F.col("prediction").cast("long").alias("predicted"), F.lit(models.grown(model)).alias("trees"))


#: Days between the windows of the registered backtest, and its trees at most; `models.backtest` steps by 30 days unless told otherwise.
BACKTEST_STEP, BACKTEST_TREES, BACKTEST_PATIENCE = 365, 40, 10


def x04_backtest(spark: SparkSession, sf_dir: str, step: int = BACKTEST_STEP, trees: int = BACKTEST_TREES, patience: int = BACKTEST_PATIENCE) -> DataFrame:
    """Walk-forward metrics of models of points over the whole matrix: a row a window."""
    rows = _matrix(spark, stored_dialect(spark, sf_dir))
    return models.backtest(rows, shared_path(spark, f"backtest-{uuid.uuid4().hex}"), step=step, trees=trees, patience=patience)


def x02_outcome_accuracy(spark: SparkSession, sf_dir: str, cutoff: str = CUTOFF) -> DataFrame:
    return models.accuracy(x02_outcome_model(spark, sf_dir, cutoff))


def x06_predictions(spark: SparkSession, sf_dir: str, cutoff: str = CUTOFF) -> DataFrame:
    """Predicted points and rank of each player in the matches from `cutoff` on."""
    known, test = models.split(kept(_matrix(spark, stored_dialect(spark, sf_dir))), cutoff)
    return models.predict(_points_model(spark, sf_dir, cutoff, known), test)


def run_sql(spark: SparkSession, dialect: Dialect, query: str) -> DataFrame:
    return spark.sql(f"{dialect.base} {query}")


def w03_dream_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best line-up of each match to come that has one, with names, roles and credits: a row a player, and the line-up's totals."""
    s = stored_dialect(spark, sf_dir)
    rows = kept(run(spark, "w03_candidates", s))
    players = run_sql(spark, s, "SELECT player_id, name AS player_name FROM players")
    own = rows.select("match_id", "player_id", "team", "role", "credits")
    picked = lineup.lineups(rows).join(own, ["match_id", "player_id"]).join(players, "player_id", "left")
    per = Window.partitionBy("match_id")
    return picked.select(F.col("match_id").alias("upcoming_id"), "player_id", "player_name", "team", "role", F.col("points").alias("predicted_points"), "credits", "is_captain", "is_vice_captain", F.round(F.sum("credits").over(per), 1).alias("total_credits"), F.col("score").alias("projected_score"))


def x08_upcoming(spark: SparkSession, sf_dir: str, version: str = "latest") -> DataFrame:
    """Predicted points and ranks of the squads of all matches to come, by a model of what was played before the first of them."""
    s = stored_dialect(spark, sf_dir)
    matrix = kept(run(spark, "g16_inference_matrix", s))
    first = spark.sql(f"{s.base} SELECT cast(coalesce(min(match_date), current_date()) as string) FROM upcoming").first()[0]
    known, _ = models.split(kept(_matrix(spark, s)), first)
    return models.predict_upcoming(_points_model(spark, sf_dir, first, known), matrix, version)


#: The first year whose deliveries have names only, in the stand-in for deliveries to resolve.
NAMED_FROM = 1998


def _name(i: str, how: str = "said") -> str:
    """SQL of the name of player `i`, two words of letters and digits: as it is `said` in a match (by the id right, misspelt, another name, or one nobody knows), the `right` or the `other` name."""
    a, b = f"substr(md5(cast({i} as varchar(9))), 1, 8)", f"substr(md5(cast({i} as varchar(9))), 9, 10)"
    right, other = f"concat({a}, ' ', {b})", f"concat('alias ', {b}, 'x', substr({a}, 3, 4))"
    if how != "said":
        return right if how == "right" else other
    bent = f"concat({b}, '  ', upper(substr({a}, 1, 4)), substr({a}, 6, 3))"
    return f"CASE {i} % 4 WHEN 0 THEN {right} WHEN 1 THEN {bent} WHEN 2 THEN {other} WHEN 3 THEN concat('nobody ', reverse({b})) END"


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The order tables' deliveries with names, those of NAMED_FROM on without ids; their matches; and the maps of right and of other names."""
    s = stored_dialect(spark, sf_dir)
    sql = lambda q: spark.sql(f"{s.base} {q}")
    known = f"year(match_date) < {NAMED_FROM}"
    right = lambda r: f"CASE WHEN {r}_id IS NOT NULL THEN {_name(f'{r}_id', 'right')} END"
    roles = ", ".join(f"CASE WHEN {known} THEN {r}_id END AS {r}_id, CASE WHEN {known} THEN {right(r)} ELSE {_name(f'{r}_id')} END AS {r}" for r in names.ROLES)
    maps = (sql(f"SELECT {_name('player_id', how)} AS name, player_id FROM players WHERE player_id % 4 = {k}") for k, how in ((0, "right"), (2, "other")))
    return sql(f"SELECT delivery_id, match_id, {roles} FROM d"), sql("SELECT match_id, league_id, match_date FROM matches"), *maps


def n03_match_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per match the names of its deliveries by the way they were resolved."""
    return names.resolve_matches(*_named(spark, sf_dir))[1]


def n03_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deliveries with the ids that their names gave."""
    return names.resolve_matches(*_named(spark, sf_dir))[0].select("delivery_id", *(f"{r}_id" for r in names.ROLES))


def n04_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.totals(n03_match_resolution(spark, sf_dir))


#: Labels that no map knows.
UNKNOWN_LABELS = ["right-arm underarm", "umpire"]


def n05_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles and roles of players, from labels as pages write them: each label of the maps, and unknown ones."""

    def pick(labels: dict[str, str]) -> Column:
        every = [*labels, *UNKNOWN_LABELS]
        return F.concat(F.lit(" "), F.initcap(F.get(F.array(*map(F.lit, every)), F.col("player_id") % len(every))), F.lit(" "))

    players = run(spark, "g12_static", stored_dialect(spark, sf_dir)).select("player_id")
    return players.select("player_id", names.bowling_style(pick(names.STYLE_LABELS)).alias("bowling_style"), names.playing_role(pick(names.ROLE_LABELS)).alias("primary_role"))


def _by_hand() -> dict[str, str]:
    """SQL of the queries that are no templates."""
    base, known, methods = duckdb_dialect().base, f"year(match_date) < {NAMED_FROM}", ("exact", "fuzzy", "manual", "unresolved")
    counts = ", ".join(f"count(*) FILTER (WHERE method = '{m}') AS {m}" for m in methods)
    how = f"""{base}, seen AS (SELECT DISTINCT striker_id AS id, league_id, year(match_date) AS y FROM d WHERE {known}),
near AS (SELECT DISTINCT a.league_id, a.y, seen.id FROM (SELECT DISTINCT league_id, year(match_date) AS y FROM d WHERE NOT {known}) a JOIN seen ON a.league_id = seen.league_id AND abs(a.y - seen.y) <= 5),
t AS (SELECT match_id, league_id, year(match_date) AS y, unnest([striker_id, bowler_id, non_striker_id, wicket_player_id]) AS id FROM d WHERE NOT {known}),
how AS (SELECT t.*, CASE WHEN t.id % 4 = 0 THEN 'exact' WHEN t.id % 4 = 1 AND near.id IS NOT NULL THEN 'fuzzy' WHEN t.id % 4 = 2 THEN 'manual' ELSE 'unresolved' END AS method FROM t LEFT JOIN near ON near.id = t.id AND near.league_id = t.league_id AND near.y = t.y WHERE t.id IS NOT NULL),
c AS (SELECT match_id, count(*) AS total_names, {counts} FROM how GROUP BY match_id)"""
    some = ", ".join(f"CASE WHEN {known} THEN d.{r}_id ELSE i_{r}.id END AS {r}_id" for r in names.ROLES)
    joins = " ".join(f"LEFT JOIN ids i_{r} ON i_{r}.id = d.{r}_id AND i_{r}.league_id = d.league_id AND i_{r}.y = year(d.match_date)" for r in names.ROLES)
    sums = ", ".join(f"cast(sum({c}) as bigint) AS {c}" for c in ("total_names", *methods))
    pick = lambda labels: f"[{', '.join(map(repr, [*labels, *UNKNOWN_LABELS]))}][player_id % {len(labels) + len(UNKNOWN_LABELS)} + 1]"
    table = lambda labels: f"(VALUES {', '.join(f'({k!r}, {v!r})' for k, v in labels.items())})"
    return {
        "n03_match_resolution": f"{how} SELECT * FROM c",
        "n03_resolved": f"{how}, ids AS (SELECT DISTINCT league_id, y, id FROM how WHERE method <> 'unresolved') SELECT d.delivery_id, {some} FROM d {joins}",
        "n04_totals": f"{how}, g AS (SELECT {sums} FROM c) SELECT *, round_even((total_names - unresolved) / total_names * 100, 1) AS resolution_rate FROM g",
        "n05_labels": f"{base}, p AS (SELECT player_id, {pick(names.STYLE_LABELS)} AS style, {pick(names.ROLE_LABELS)} AS role FROM players) SELECT player_id, s.b AS bowling_style, r.b AS primary_role FROM p LEFT JOIN {table(names.STYLE_LABELS)} s(a, b) ON p.style = s.a LEFT JOIN {table(names.ROLE_LABELS)} r(a, b) ON p.role = r.a",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: (lambda spark, sf_dir, name=name: run(spark, name, stored_dialect(spark, sf_dir))) for name in TEMPLATES}
    out |= {f"{name}_odi": (lambda spark, sf_dir, name=name: run(spark, name, stored_dialect(spark, sf_dir), fmt="ODI")) for name in BY_FORMAT}
    out["x07_lineups"] = lambda spark, sf_dir: lineup.lineups(run(spark, "x07_candidates", stored_dialect(spark, sf_dir)))
    out["x07_lineup_text"] = lambda spark, sf_dir: lineup.described(out["x07_lineups"](spark, sf_dir), run_sql(spark, stored_dialect(spark, sf_dir), "SELECT player_id, name, primary_role FROM players"))
    out["w03_dream_teams"] = w03_dream_teams
    out |= {f.__name__: f for f in (n03_match_resolution, n03_resolved, n04_totals, n05_labels)}
    return {**out, "x01_points_model": x01_points_model, "x02_outcome_model": x02_outcome_model, "x02_outcome_accuracy": x02_outcome_accuracy, "x04_backtest": x04_backtest, "x06_predictions": x06_predictions, "x08_upcoming": x08_upcoming}


def oracles() -> dict[str, str]:
    of = {name: f(duckdb_dialect()) for name, f in TEMPLATES.items()}
    return {**of, **{f"{name}_odi": TEMPLATES[name](duckdb_dialect(), fmt="ODI") for name in BY_FORMAT}, **_by_hand()}
