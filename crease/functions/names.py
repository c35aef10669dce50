"""Name resolution: exact map, then near names of the league and years, then manual overrides; for names, matches and totals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crease.session import kept

#: The roles of a ball that are resolved, in this order.
ROLES = ("striker", "bowler", "non_striker", "wicket_player")
#: Labels of playing roles.
ROLE_LABELS = {
    "batter": "BAT", "batsman": "BAT", "top order batter": "BAT", "middle order batter": "BAT", "opening batter": "BAT", "bowler": "BOWL", "bowling allrounder": "AR",
    "batting allrounder": "AR", "allrounder": "AR", "all-rounder": "AR", "wicketkeeper": "WK", "wicketkeeper batter": "WK", "wicket-keeper": "WK",
}

#: Labels of bowling styles as pages write them, and the style of each.
STYLE_LABELS = {
    "right-arm fast": "right-arm fast", "right-arm fast-medium": "right-arm fast", "right-arm fastmedium": "right-arm fast", "right-arm medium-fast": "right-arm medium", "right-arm medium": "right-arm medium",
    "right-arm offbreak": "right-arm offbreak", "right-arm off break": "right-arm offbreak", "off break": "right-arm offbreak",
    "right-arm legbreak": "legbreak", "right-arm leg break": "legbreak", "legbreak": "legbreak", "leg break": "legbreak", "legbreak googly": "legbreak", "right-arm leg-break googly": "legbreak",
    "left-arm fast": "left-arm fast", "left-arm fast-medium": "left-arm fast", "left-arm fastmedium": "left-arm fast", "left-arm medium-fast": "left-arm fast", "left-arm medium": "left-arm fast",
    "slow left-arm orthodox": "left-arm orthodox", "left-arm orthodox": "left-arm orthodox", "slow left-arm": "left-arm orthodox", "left-arm chinaman": "left-arm orthodox", "left-arm spin": "left-arm orthodox",
}


def _indel(a: str, b: str) -> float:
    """100 (1 - insertions and deletions / total length), from the longest common subsequence."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def token_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of the names with their words sorted, 0 to 100."""
    return pd.Series([None if x is None or y is None else _indel(" ".join(sorted(x.split())), " ".join(sorted(y.split()))) for x, y in zip(a, b)], dtype="float64")


def normalised(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def _ordered(name: Column) -> Column:
    return F.array_join(F.array_sort(F.split(normalised(name), " ")), " ")


def _pairs_of_letters(name: Column) -> Column:
    """Pairs of neighbouring letters of the name with its words sorted and its ends marked; those that repeat are numbered."""
    marked = F.concat(F.lit("\x02"), _ordered(name), F.lit("\x03"))
    grams = F.transform(F.sequence(F.lit(1), F.char_length(marked) - 1), lambda i: F.substring(marked, i, F.lit(2)))
    return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, 1, i + 1), lambda x: x == g)).cast("string")))


def candidates(asked: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Pairs (name, league_id, year, other, other_id) of the same league within five years; none of ratio `least` or more (of 67 to 100) is left out.

    With e = 1 - least / 100, two such names differ by so few letters that of n letters of one at most k n of its
    n + 1 pairs are broken, k = 3 e + (1/2 - 3/2 e) 2 e / (1 + e). Each thus shares one of its k n + 1 rarest pairs
    with the other, so only those are joined.
    """
    e = 1 - least / 100
    k = 3 * e + (0.5 - 1.5 * e) * 2 * e / (1 + e)

    def grams(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("gram", F.explode(_pairs_of_letters(F.col(name)))).withColumn("length", F.char_length(_ordered(F.col(name))))

    every = grams(known.select("league_id", "y", "other", "other_id").distinct(), "other")
    often = every.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))

    def rarest(df: DataFrame, of: list[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*of).orderBy(F.coalesce("n", F.lit(0)), "gram"))
        return df.join(often, "gram", "left").withColumn("place", place).filter(F.col("place") <= F.floor(k * F.col("length") + 1e-9) + 1).drop("n", "place")

    left = rarest(grams(asked, "name"), ["name", "league_id", "year"])
    right = rarest(every, ["league_id", "y", "other", "other_id"]).withColumnRenamed("length", "size")
    near = F.abs(F.col("length") - F.col("size")) <= e * (F.col("length") + F.col("size")) + 1e-9
    return left.join(right, ["league_id", "gram"]).filter(near & (F.abs(F.col("year") - F.col("y")) <= 5)).select("name", "league_id", "year", "other", "other_id").distinct()


def pool(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    """league_id, year, name, player_id: the strikers known by id, by league and year of the match."""
    seen = deliveries.filter("striker_id is not null and striker is not null").select("match_id", F.col("striker").alias("name"), F.col("striker_id").alias("player_id"))
    return seen.join(matches.select("match_id", "league_id", F.year("match_date").alias("year")), "match_id").select("league_id", "year", "name", "player_id").distinct()


def resolve(names: DataFrame, exact: DataFrame, pool: DataFrame, manual: DataFrame, least: float = 85.0, gap: float = 5.0) -> DataFrame:
    """name, league_id, year of `names` with player_id, method (exact, fuzzy, manual, unresolved), confidence and ambiguous.

    exact and manual: (name, player_id). pool: (league_id, year, name, player_id), the known strikers. A near name is the
    one of highest ratio, `least` or more, of the same league within five years; ambiguous if a name of another player
    comes within `gap` of it. Null names are left out.
    """

    def key(df: DataFrame, name: str) -> DataFrame:
        return df.filter("name is not null").groupBy(F.col("name").alias(name)).agg(F.min("player_id").alias(f"{name}_id"))

    step = names.filter("name is not null").select("name", "league_id", "year").distinct().join(key(exact, "e"), F.col("name") == F.col("e"), "left")
    asked = step.filter("e_id is null").select("name", "league_id", "year")
    known = pool.filter("name is not null").select("league_id", F.col("year").alias("y"), F.col("name").alias("other"), F.col("player_id").alias("other_id"))
    pairs = candidates(asked, known, least - gap)
    scored = pairs.withColumn("score", token_ratio(normalised(F.col("name")), normalised(F.col("other"))))
    each = scored.groupBy("name", "league_id", "year", "other_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("name", "league_id", "year").orderBy(F.desc("score"), "other_id")
    best = each.withColumn("k", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).filter((F.col("k") == 1) & (F.col("score") >= least))
    near = best.select("name", "league_id", "year", F.col("other_id").alias("f_id"), "score", (F.col("score") - F.coalesce("second", F.lit(0.0)) < gap).alias("ambiguous"))
    out = step.join(near, ["name", "league_id", "year"], "left").join(key(manual, "m"), F.col("name") == F.col("m"), "left")
    method = F.when(F.col("e_id").isNotNull(), "exact").when(F.col("f_id").isNotNull(), "fuzzy").when(F.col("m_id").isNotNull(), "manual").otherwise("unresolved")
    confidence = F.when(method == "fuzzy", F.col("score") / 100).when(method == "unresolved", 0.0).otherwise(1.0)
    return out.select("name", "league_id", "year", F.coalesce("e_id", "f_id", "m_id").alias("player_id"), method.alias("method"), confidence.alias("confidence"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def resolve_matches(deliveries: DataFrame, matches: DataFrame, exact: DataFrame, manual: DataFrame, known: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """The deliveries with the ids of their names, and per match the names resolved by each method.

    Deliveries whose striker_id is null are resolved: names of striker, bowler, non_striker and wicket_player, in this
    order; a bowler who would be the ball's striker is left without an id. Ids that a name doesn't give stay as they
    were. `known` is the pool of strikers; by default those of the deliveries that have ids.

    Names are counted by match before anything is joined, and each match's few names come back to its balls as one
    map: one join by match, so neither a name that stands in every match nor a missing one gathers balls in a task.
    """
    todo = F.col("striker_id").isNull()
    when = matches.select("match_id", F.col("league_id").alias("of_league"), F.year("match_date").alias("of_year"))
    said = deliveries.filter(todo).select("match_id", F.explode(F.array(*(F.col(r) for r in ROLES))).alias("said")).filter("said is not null and said <> ''").groupBy("match_id", "said").agg(F.count(F.lit(1)).alias("times"))
    placed = kept(said.join(when, "match_id", "left"))
    found = resolve(placed.select(F.col("said").alias("name"), F.col("of_league").alias("league_id"), F.col("of_year").alias("year")), exact, pool(deliveries, matches) if known is None else known, manual, **options)
    same = F.col("said").eqNullSafe(found["name"]) & F.col("of_league").eqNullSafe(found["league_id"]) & F.col("of_year").eqNullSafe(found["year"])
    named = placed.join(found, same)
    ids = F.map_from_entries(F.collect_list(F.when(F.col("player_id").isNotNull(), F.struct("said", "player_id"))))
    counted = [F.coalesce(F.sum(F.when(F.col("method") == m, F.col("times"))), F.lit(0)).alias(m) for m in ("exact", "fuzzy", "manual", "unresolved")]
    per = kept(named.groupBy("match_id").agg(F.sum("times").alias("total_names"), *counted, ids.alias("ids")))
    mine = per.select(F.col("match_id").alias("of_match"), F.col("ids").alias("of_names"))
    rows = deliveries.join(mine, deliveries["match_id"] == mine["of_match"], "left")
    taken = {r: F.when(F.col(r).isNotNull(), F.try_element_at(mine["of_names"], F.col(r))) for r in ROLES}
    taken["bowler"] = F.when(taken["striker"].eqNullSafe(taken["bowler"]), None).otherwise(taken["bowler"])
    own = [F.when(todo, F.coalesce(taken[c[:-3]], F.col(c))).otherwise(F.col(c)).alias(c) if c.endswith("_id") and c[:-3] in ROLES else deliveries[c] for c in deliveries.columns]
    return rows.select(*own), per.drop("ids")


def totals(stats: DataFrame) -> DataFrame:
    """Sums over all matches, and the share of names that got an id, in percent."""
    sums = stats.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_names", "exact", "fuzzy", "manual", "unresolved")))
    return sums.withColumn("resolution_rate", F.bround((F.col("total_names") - F.col("unresolved")) / F.greatest(F.col("total_names"), F.lit(1)) * 100, 1))


def bowling_style(label: Column, styles: dict[str, str] = STYLE_LABELS) -> Column:
    """The style of a label as a page writes it, by a map of lower-case labels; null for an unknown one."""
    return F.create_map(*[F.lit(x) for k, v in styles.items() for x in (k.strip().lower(), v)])[F.lower(F.trim(label))]


def playing_role(label: Column) -> Column:
    """BAT, BOWL, AR or WK of a label as a page writes it; null for an unknown one."""
    return F.create_map(*[F.lit(x) for pair in ROLE_LABELS.items() for x in pair])[F.lower(F.trim(label))]
