"""Best line-ups of eleven within credits, roles and team limits, exactly; a match's players meet as one short list."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least and most players of each role; players, credits and players of one team.
ROLES = {"WK": (1, 4), "BAT": (3, 6), "AR": (1, 4), "BOWL": (3, 6)}
PLAYERS, CREDITS, PER_TEAM = 11, 100.0, 7
#: Points and credits are added as whole numbers of this many digits, so that sums don't hang on their order.
DIGITS = 9

#: (credits, value) by number of players and how many of them are of the first team: those that no cheaper one equals.
Fronts = dict[tuple[int, int], list[tuple[int, int]]]


def _front(entries: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    out, top = [], None
    for cost, value in sorted(entries, key=lambda e: (e[0], -e[1])):
        if cost <= budget and (top is None or value > top):
            out.append((cost, value))
            top = value
    return out


def _joined(left: Fronts, right: Fronts, budget: int, most: int, per_team: int) -> Fronts:
    """Fronts of all unions of a choice of `left` and one of `right`."""
    out: Fronts = {}
    for (n, a), these in left.items():
        for (m, b), those in right.items():
            if n + m <= most and a + b <= per_team and n + m - a - b <= per_team:
                out.setdefault((n + m, a + b), []).extend((c + d, v + w) for c, v in these for d, w in those)
    return {key: front for key, entries in out.items() if (front := _front(entries, budget))}


def best(candidates: list[tuple[int, float, float, str, str]], credits: float = CREDITS, per_team: int = PER_TEAM) -> list[int] | None:
    """Indices of the best eleven of (id, points, credits, role, team), or None if no eleven fits; of equal points, that of the first candidates.

    Each role has its own fronts, for each count of its players and of the first team's; wicketkeepers and batters are
    joined, all-rounders and bowlers too, and of both halves only pairs are looked at that can be better than the best so
    far. A value is the points, followed by a bit for each candidate.
    """
    if len({c[4] for c in candidates}) > 2:
        raise ValueError("a match has two teams")
    first, size, unit = min((c[4] for c in candidates), default=""), len(candidates), 10**DIGITS
    budget = round(credits * unit) + 1
    halves: list[Fronts] = []
    for pair in (("WK", "BAT"), ("AR", "BOWL")):
        half: Fronts = {(0, 0): [(0, 0)]}
        for role in pair:
            least, most = ROLES[role]
            own: Fronts = {(0, 0): [(0, 0)]}
            for i, (_, points, cost, of, team) in enumerate(candidates):
                if of == role and math.isfinite(points) and math.isfinite(cost):
                    one = (round(cost * unit), (round(points * unit) << size) + (1 << size - 1 - i))
                    own = _joined(own, {(0, 0): [(0, 0)], (1, int(team == first)): [one]}, budget, most, per_team)
            half = _joined(half, {k: v for k, v in own.items() if k[0] >= least}, budget, PLAYERS, per_team)
        halves.append(half)
    top = None
    for (n, a), these in halves[0].items():
        for (m, b), those in halves[1].items():
            if n + m != PLAYERS or a + b > per_team or PLAYERS - a - b > per_team or (top is not None and these[-1][1] + those[-1][1] <= top):
                continue
            k = len(those) - 1
            for cost, value in these:
                while k >= 0 and cost + those[k][0] > budget:
                    k -= 1
                if k >= 0 and (top is None or value + those[k][1] > top):
                    top = value + those[k][1]
    return None if top is None else [i for i in range(size) if top >> size - 1 - i & 1]


def _number(x: float | None) -> float:
    return math.nan if x is None else x


def lineups(candidates: DataFrame) -> DataFrame:
    """match_id, player_id, points, is_captain, is_vice_captain, score of the best line-up of each match that has one; a match with players of more than two teams has none."""
    schema = "match_id int, player_id int, points double, is_captain boolean, is_vice_captain boolean, score double"
    arrow = pa.schema([("match_id", pa.int32()), ("player_id", pa.int32()), ("points", pa.float64()), ("is_captain", pa.bool_()), ("is_vice_captain", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for match_id, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(r["player_id"], _number(r["points"]), _number(r["credits"]), r["role"], r["team"]) for r in of]
                picked = best(rows) if len({r[4] for r in rows}) <= 2 else None
                if picked is not None:
                    ranked = sorted(picked, key=lambda i: (-rows[i][1], rows[i][0]))
                    score = round(sum(rows[i][1] for i in picked) + rows[ranked[0]][1] + 0.5 * rows[ranked[1]][1], 2)
                    out += [(match_id, rows[i][0], rows[i][1], k == 0, k == 1, score) for k, i in enumerate(ranked)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(arrow), arrow)], schema=arrow)

    row = F.struct("player_id", F.col("points").cast("double").alias("points"), F.col("credits").cast("double").alias("credits"), "role", "team")
    by = candidates.groupBy("match_id").agg(F.array_sort(F.collect_list(row)).alias("of"))
    return by.mapInArrow(run, schema)


def described(lineups: DataFrame, players: DataFrame) -> DataFrame:
    """match_id, text: each line-up as lines, captain and vice-captain first, then by points; a name that isn't known is the id."""
    name = F.coalesce("name", F.col("player_id").cast("string"))
    mark = F.when(F.col("is_captain"), " (C)").when(F.col("is_vice_captain"), " (VC)").otherwise("")
    rows = lineups.join(players.select("player_id", "name", "primary_role"), "player_id", "left")
    order = F.struct((~F.col("is_captain")).alias("c"), (~F.col("is_vice_captain")).alias("v"), (-F.col("points")).alias("p"), "player_id", F.concat(name, mark, F.lit(", "), F.coalesce("primary_role", F.lit("?")), F.lit(", "), F.format_number("points", 1)).alias("line"))
    by = rows.groupBy("match_id").agg(F.array_sort(F.collect_list(order)).alias("of"), F.max("score").alias("score"))
    return by.select("match_id", F.concat(F.array_join(F.transform("of", lambda x: x["line"]), "\n"), F.lit("\nTotal "), F.format_number("score", 2)).alias("text"))
