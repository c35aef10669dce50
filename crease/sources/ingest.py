"""Match files and mapping files into tables, and the writes that keep them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crease.functions.names import bowling_style, playing_role
from crease.session import kept

#: What in a result says that rain had a part in it.
RAIN = ["rain", "no result", "abandoned", "d/l", "dls", "vjd", "duckworth", "wet"]

BALL = "struct<batter:string,bowler:string,non_striker:string,runs:struct<batter:int,total:int>,extras:map<string,int>,wickets:array<struct<kind:string,player_out:string>>>"
MATCH = f"struct<info:struct<teams:array<string>,dates:array<string>,venue:string,city:string,toss:struct<winner:string,decision:string>,outcome:struct<winner:string,result:string,method:string,eliminator:string>,season:string,match_type:string,match_number:int>,innings:array<struct<overs:array<struct<over:int,deliveries:array<{BALL}>>>>>>"


def read_matches(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, league_id (the file's folder), stem, match (null where the file can't be parsed), error of each YAML file under `path`; a bad file spoils no other."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        for pdf in parts:
            out = []
            for name, content in zip(pdf["path"], pdf["content"]):
                try:
                    out.append((name, json.dumps(yaml.safe_load(bytes(content).decode("utf-8")), default=str), None))
                except Exception as e:  # noqa: BLE001 - reported with the file
                    out.append((name, None, str(e)[:500]))
            yield pd.DataFrame(out, columns=["path", "json", "error"])

    files = listed(spark, path).select("path", "content")
    step = F.split("path", "/")
    return files.mapInPandas(run, "path string, json string, error string").select("path", F.coalesce(F.get(step, F.size(step) - 2), F.lit("")).alias("league_id"), F.regexp_replace(F.element_at(step, -1), r"\.[^.]*$", "").alias("stem"), F.from_json("json", MATCH).alias("match"), "error")


def listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The match files under `path`; content is read only where it is selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.y*ml").option("recursiveFileLookup", "true").load(path)


def _first_date() -> Column:
    return F.try_to_date(F.element_at("match.info.dates", 1))


def fault() -> Column:
    """Why a file gives no match; null where it does."""
    teams = F.col("match.info.teams")
    return (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("unreadable: "), "error")).when(F.col("match.info").isNull(), "no info")
        .when(F.coalesce(F.size(teams), F.lit(0)) < 2, "no teams").when(_first_date().isNull(), "no date").when(F.coalesce(F.size("match.innings"), F.lit(-1)) < 0, "no innings")
    )


def numbered(df: DataFrame, order: list[str], name: str, after: int = 0) -> DataFrame:
    """`df` with a gapless number from `after` + 1 on in the order of `order`; ranges are counted first, so no task holds all rows."""
    parts = kept(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    counts = parts.groupBy("part_").count()
    base = counts.select("part_", F.coalesce(F.sum("count").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_"))
    place = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return parts.join(F.broadcast(base), "part_").withColumn(name, F.col("base_") + place + after).drop("part_", "base_")


def extended(known: DataFrame | None, new: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Rows of `new` (one a key) with ids: that of `known` (keys and `name`) where it has the key, else the next ones in `order`."""
    if known is None:
        return numbered(new, order, name)
    known = known.select(*keys, name)
    old = new.join(known, keys)
    last = known.agg(F.coalesce(F.max(name), F.lit(0))).first()[0]
    return old.unionByName(numbered(new.join(known, keys, "left_anti"), order, name, last))


#: Bits of a delivery's id for what follows the match: innings, over, ball.
INNINGS_BITS, OVER_BITS, BALL_BITS = 2, 10, 10


def delivery_id(match_id: Column, innings: Column, over: Column, ball: Column) -> Column:
    """One number a delivery, in the order of match, innings, over and ball."""
    packed = match_id.cast("long") * (1 << INNINGS_BITS) + innings
    return (packed * (1 << OVER_BITS) + over) * (1 << BALL_BITS) + ball


def with_match_ids(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The files that give a match, with match_id: numbers in the order of date, league and file name, after those in `known` (league_id, stem, match_id).

    Of files of one league and name the first by path counts.
    """
    good = files.filter(fault().isNull())
    first = good.groupBy("league_id", "stem").agg(F.min("path").alias("path"), F.min(_first_date()).alias("day_"))
    ids = extended(known, first, ["league_id", "stem"], ["day_", "league_id", "stem"], "match_id")
    return good.join(ids.select("path", "match_id"), "path")


def venue_key(name: Column) -> Column:
    """A venue's name without regard to case and spaces."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def _venue_name() -> Column:
    """Venue and city, with a comma where there are both; null without a venue."""
    part = lambda c: F.nullif(F.trim(F.col(f"match.info.{c}")), F.lit(""))
    return F.when(part("venue").isNotNull(), F.concat_ws(", ", part("venue"), part("city")))


def venues(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """venue_key, name and venue_id of the files' venues: ids of `known` (venue_key, venue_id) stay, others follow by key. One venue a name, whatever its case and spaces."""
    named = files.select(_venue_name().alias("name")).filter("name <> ''").groupBy(venue_key(F.col("name")).alias("venue_key")).agg(F.min("name").alias("name"))
    return extended(known, named, ["venue_key"], ["venue_key"], "venue_id")


def matches(files: DataFrame, venues: DataFrame) -> DataFrame:
    """One row for each of `files` with a match_id; venue_id by the names in `venues`, null without a name."""
    i = F.col("match.info")
    said = F.lower(F.concat_ws(" ", i["outcome"]["method"], i["outcome"]["result"], i["outcome"]["eliminator"]))
    rain = F.exists(F.array(*map(F.lit, RAIN)), lambda k: F.contains(said, k))
    balls = F.aggregate("match.innings", F.lit(0), lambda a, x: a + F.coalesce(F.aggregate(x["overs"], F.lit(0), lambda b, o: b + F.greatest(F.coalesce(F.size(o["deliveries"]), F.lit(0)), F.lit(0))), F.lit(0)))
    full = F.when(F.upper(i["match_type"]).isin("T20", "IT20"), 120).otherwise(600)
    rows = files.select(
        "match_id", "league_id", i["season"].alias("season"), _first_date().alias("match_date"), venue_key(_venue_name()).alias("venue_key"),
        F.get(i["teams"], 0).alias("team1"), F.get(i["teams"], 1).alias("team2"), i["toss"]["winner"].alias("toss_winner"), i["toss"]["decision"].alias("toss_decision"), i["outcome"]["winner"].alias("winner"),
        rain.alias("rain_affected"), (balls < 0.9 * full).alias("low_ball_count"),
    )
    return rows.join(venues.select("venue_key", "venue_id"), "venue_key", "left").select("match_id", "league_id", "season", "match_date", "venue_id", "team1", "team2", "toss_winner", "toss_decision", "winner", "rain_affected", "low_ball_count")


def deliveries(files: DataFrame) -> DataFrame:
    """One row a ball of innings 1 and 2 of `files` with a match_id (`quarantine` has the others); the first extra and the first wicket count.

    delivery_id sorts as the balls were bowled. Names are kept, ids are null until names are resolved; over_ball is the
    source's number, in which ball 10 of an over reads as ball 1: order by delivery_id.
    """
    innings = files.select("match_id", F.posexplode("match.innings").alias("i", "inn")).filter("i < 2")
    overs = innings.select("match_id", (F.col("i") + 1).alias("innings"), F.explode("inn.overs").alias("o"))
    balls = overs.select("match_id", "innings", F.col("o.over").alias("over_no"), F.posexplode("o.deliveries").alias("b", "x")).withColumn("ball_no", F.col("b") + 1)
    name = lambda c: F.nullif(F.trim(c), F.lit(""))
    return balls.filter(_numbers_fit()).select(
        delivery_id(F.col("match_id"), F.col("innings"), F.col("over_no"), F.col("ball_no")).alias("delivery_id"), "match_id", "innings", "over_no", "ball_no", F.concat_ws(".", "over_no", "ball_no").cast("decimal(4,1)").alias("over_ball"),
        name("x.batter").alias("striker"), name("x.bowler").alias("bowler"), name("x.non_striker").alias("non_striker"), *(F.lit(None).cast("int").alias(f"{r}_id") for r in ("striker", "bowler", "non_striker", "wicket_player")),
        F.element_at(F.map_keys("x.extras"), 1).alias("extras_type"), F.coalesce("x.runs.batter", F.lit(0)).alias("runs_batter"), F.coalesce(F.aggregate(F.map_values("x.extras"), F.lit(0), lambda a, v: a + v), F.lit(0)).alias("runs_extras"), F.coalesce("x.runs.total", F.lit(0)).alias("runs_total"),
        F.get("x.wickets", 0)["kind"].alias("wicket_type"), name(F.get("x.wickets", 0)["player_out"]).alias("wicket_player"),
    )


def _numbers_fit() -> Column:
    return F.col("over_no").between(0, (1 << OVER_BITS) - 1) & F.col("ball_no").between(1, (1 << BALL_BITS) - 1)


def quarantine(files: DataFrame, with_ids: DataFrame) -> DataFrame:
    """path, reason, innings, over_no, balls and content (JSON) of what `files` hold but no table takes: files without a match, repeated matches, innings after the second (super overs), overs out of range."""
    row = lambda reason, innings="null", over="null", balls="0", content="to_json(match)": [F.col("path"), reason.alias("reason"), F.expr(f"cast({innings} as int) AS innings"), F.expr(f"cast({over} as int) AS over_no"), F.expr(f"cast({balls} as int) AS balls"), F.expr(f"{content} AS content")]
    whole = files.filter(fault().isNotNull()).select(*row(fault()))
    again = files.filter(fault().isNull()).join(with_ids.select("path"), "path", "left_anti").select(*row(F.lit("match of this league and name is loaded")))
    innings = with_ids.select("path", F.posexplode("match.innings").alias("i", "inn"))
    more = innings.filter("i >= 2").select(*row(F.lit("innings after the second"), "i + 1", "null", "aggregate(inn.overs, 0, (a, o) -> a + greatest(coalesce(size(o.deliveries), 0), 0))", "to_json(inn)"))
    overs = innings.filter("i < 2").select("path", "i", F.explode("inn.overs").alias("o")).withColumn("over_no", F.col("o.over")).withColumn("ball_no", F.greatest(F.size("o.deliveries"), F.lit(1)))
    odd = overs.filter(~F.coalesce(_numbers_fit(), F.lit(False))).select(*row(F.lit("over or ball out of range"), "i + 1", "over_no", "greatest(coalesce(size(o.deliveries), 0), 0)", "to_json(o)"))
    return whole.unionByName(again).unionByName(more).unionByName(odd)


def read_mapping(spark: SparkSession, path: str, id_column: str | None = None) -> DataFrame:
    """A mapping CSV with a header: trimmed, without comments and blank keys, and with whole-number ids only where `id_column` says so."""
    df = spark.read.csv(path, header=True, comment="#", inferSchema=False)
    df = df.select(*[F.trim(F.col(c)).alias(c.strip()) for c in df.columns])
    df = df.filter(F.col(df.columns[0]).isNotNull() & (F.col(df.columns[0]) != ""))
    return df.withColumn(id_column, F.expr(f"try_cast(`{id_column}` as int)")).filter(F.col(id_column).isNotNull()) if id_column else df


#: What the columns of a file of names and player ids can be called.
NAME_COLUMNS, ID_COLUMNS = ("cricsheet_name", "name"), ("player_id", "espn_id")


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _first_of(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """The first of the columns that isn't blank, trimmed; null where none is there."""
    return F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns if c in df.columns), F.lit(None).cast("string"))


def _last_of_each(df: DataFrame, key: str, value: str) -> DataFrame:
    """Of rows of one key the last in the file."""
    return df.withColumn("line_", F.monotonically_increasing_id()).groupBy(key).agg(F.max_by(value, "line_").alias(value))


def player_ids(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """name, player_id of a CSV of names and ids (exact names); lines without a name or a whole number are left out, a missing file is empty."""
    if not _there(spark, path):
        return spark.createDataFrame([], "name string, player_id int")
    df = spark.read.csv(path, header=True, comment="#" if comments else None, inferSchema=False)
    rows = df.select(_first_of(df, NAME_COLUMNS).alias("name"), _first_of(df, ID_COLUMNS).alias("player_id"))
    rows = rows.withColumn("player_id", F.expr("try_cast(player_id as int)")).filter("name is not null and player_id is not null")
    return _last_of_each(rows, "name", "player_id")


def manual_overrides(spark: SparkSession, path: str) -> DataFrame:
    """name, player_id of a CSV of overrides: as `player_ids`, without lines that begin with #."""
    return player_ids(spark, path, comments=True)


def style_labels(spark: SparkSession, path: str) -> dict[str, str]:
    """Label (lower case, trimmed) to style of a CSV of raw_label and enum_value, for `page_facts`; a missing file is empty. A label list is a few hundred lines."""
    if not _there(spark, path):
        return {}
    rows = spark.read.csv(path, header=True, inferSchema=False).select(F.lower(F.trim("raw_label")).alias("label"), F.trim("enum_value").alias("style")).filter("label is not null and style is not null")
    return {r["label"]: r["style"] for r in _last_of_each(rows, "label", "style").collect()}


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` and the rows of `new` whose key it lacks, once each; a null key is like another."""
    return old.unionByName(absent(old, new, keys))


def absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `new` whose key `old` lacks, once each."""
    new = _once(new, keys)
    return new.join(*_side(old.select(*keys).distinct(), new, keys)[:2], "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """`old` with `new`'s rows in place of those of the same key (null like null); of new rows of one key the last by `order`, else the one that sorts last."""
    new = _once(new, keys, order)
    return delete(old, new, keys).unionByName(new)


def update(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`old` with the columns of `changes` in its rows of the same key (null like null); rows of other keys stay, and none are added."""
    side, same, own = _side(_once(changes, keys), old, keys)
    joined = old.join(side, same, "left")
    return joined.select(*(F.when(own.isNotNull(), own[c]).otherwise(old[c]).alias(c) if c in changes.columns and c not in keys else old[c] for c in old.columns))


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """`old` without the rows whose key is in `gone`."""
    return old.join(*_side(gone.select(*keys).distinct(), old, keys)[:2], "left_anti")


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both, by the names of their columns; a column that `new` lacks is null."""
    return old.unionByName(new, allowMissingColumns=True)


def fill_nulls(old: DataFrame, new: DataFrame, keys: list[str] | str) -> DataFrame:
    """Full join by `keys` (null like null) that fills only null or empty fields; outcome is inserted, updated or skipped. Of new rows of one key the one that sorts last counts."""
    keys = [keys] if isinstance(keys, str) else keys
    new = _once(new, keys)
    side, same, own = _side(new, old, keys)
    seen = _free("seen", [*old.columns, *side.columns])
    joined = old.withColumn(seen, F.lit(True)).join(side, same, "full")
    mine = {c: joined[c] for c in old.columns}
    blank = {c: mine[c].isNull() | (mine[c].cast("string") == "") for c in old.columns}
    rest = [c for c in old.columns if c not in keys]
    filled = reduce(lambda a, b: a | b, (blank[c] & own[c].isNotNull() for c in rest if c in new.columns), F.lit(False))
    outcome = F.when(joined[seen].isNull(), "inserted").when(own.isNotNull() & filled, "updated").otherwise("skipped")
    value = lambda c: F.when(joined[seen].isNull(), own[c]).otherwise(mine[c]) if c in keys else F.when(blank[c], F.coalesce(own[c], mine[c])).otherwise(mine[c]) if c in new.columns else mine[c]
    return joined.select(*(value(c).alias(c) for c in old.columns), outcome.alias("outcome"))


def _once(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row a key, always the same one: the last by `order`, then by all columns."""
    rest = ([order] if order else []) + [f.name for f in df.schema.fields if f.name not in keys and not isinstance(f.dataType, T.MapType)]
    if not rest:
        return df.dropDuplicates(keys)
    top = F.max_by(F.struct("*"), F.struct(*rest))  # combined before the shuffle: a key of very many rows is no group of them
    (name,) = (_free("row", keys),)
    return df.groupBy(*keys).agg(top.alias(name)).select(*(F.col(f"{name}.{c}").alias(c) for c in df.columns))


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def _side(side: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, Column, Column]:
    """`side` as one struct column, when it is of a row's keys (null like null), and that column: no name of `rows` clashes with it."""
    name = _free("side", rows.columns)
    side = side.select(F.struct("*").alias(name))
    own = side[name]
    return side, reduce(lambda a, b: a & b, [rows[k].eqNullSafe(own[k]) for k in keys]), own


#: What a fact's label on a player's page can be, by fact.
FACTS = {"batting": "Batting(?: Style)?", "bowling": "Bowling(?: Style)?", "role": "(?:Playing )?Role", "country": "Country|Nationality", "born": "Born|Date of Birth"}


def page_facts(pages: DataFrame, styles: dict[str, str], html: str = "html") -> DataFrame:
    """page_id with name, batting_hand, bowling_style_raw, bowling_style, primary_role, nationality and dob of players' pages; null where a page doesn't say.

    The name is that of the og:title tag before a bar, else the first heading. A fact is the text after its label up to
    the element's end.
    """
    h = F.coalesce(F.col(html), F.lit(""))
    title = F.trim(F.regexp_extract(h, r"(?i)<meta[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"'|]*)", 1))
    heading = F.trim(F.regexp_replace(F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", ""))
    blank = lambda c: F.when(c != "", c)
    flat = F.regexp_replace(h, r"(?i)</?(?:b|strong|span|i|em)\b[^>]*>", " ")
    fact = {k: blank(F.trim(F.regexp_extract(flat, rf"(?i)(?:^|[>\s])(?:{label}):\s*([^<]+)", 1))) for k, label in FACTS.items()}
    hand = F.when(F.lower(fact["batting"]).contains("left"), "Left hand").when(F.lower(fact["batting"]).contains("right"), "Right hand")
    born = F.coalesce(*(F.try_to_date(fact["born"], f) for f in ("yyyy-MM-dd", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy")))
    return pages.select("page_id", F.coalesce(blank(title), blank(heading)).alias("name"), hand.alias("batting_hand"), fact["bowling"].alias("bowling_style_raw"), bowling_style(fact["bowling"], styles).alias("bowling_style"), playing_role(fact["role"]).alias("primary_role"), F.when(F.length(fact["country"]) < 50, fact["country"]).alias("nationality"), born.alias("dob"))
