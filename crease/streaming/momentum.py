"""The momentum curve while a match is played: an extension, as all else here is over finished tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Input: deliveries as they are bowled, with the time of each; output: the state after each ball.
INPUT = "delivery_id long, match_id int, innings int, over_no int, ball_no int, extras_type string, runs_total int, wicket_type string, bowled_at timestamp"
OUTPUT = "match_id int, innings int, delivery_id long, runs long, wickets long, balls_left long, wp_batting_team double"
STATE = "target long, runs long, wickets long, balls long, last_id long"
BALLS = 120


def _two(x: float) -> float:
    """Two digits, half-even of x * 100, as the queries over tables round."""
    return round(x * 100) / 100


def chance(innings: int, target: int, runs: int, wickets: int, left: int) -> float:
    """Chance of the batting team to win: by wickets lost in the first innings, by the rate that is asked for in the second."""
    if innings == 1:
        return _two(max(0.05, min(0.95, 0.5 - wickets / 10 * 0.2)))
    need = max(target - runs, 0)
    if need == 0:
        base = 0.95
    elif left == 0:
        base = 0.05
    else:
        base = _two(max(0.05, min(0.95, 8 / (need / (left / 6)) * 0.5)))
    return _two(max(0.05, min(0.95, base - wickets * 0.025)))


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A match's balls of one trigger in order of delivery_id; a ball not newer than the last one seen (a repeat) is left out."""
    if state.hasTimedOut:
        state.remove()
        return
    target, runs, wickets, balls, last = state.get if state.exists else (0, 0, 0, 0, -1)
    out = []
    rows = pd.concat(list(batches)).sort_values("delivery_id")
    for r in rows.itertuples(index=False):
        if r.delivery_id <= last:
            continue
        if r.innings == 2 and target == 0:
            target, runs, wickets, balls = runs + 1, 0, 0, 0
        last = r.delivery_id
        runs += r.runs_total
        wickets += pd.notna(r.wicket_type)
        balls += r.extras_type != "wides"
        left = max(BALLS - balls, 0)
        out.append((key[0], r.innings, last, runs, wickets, left, chance(r.innings, target, runs, wickets, left)))
    state.update((int(target), int(runs), int(wickets), int(balls), int(last)))
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 12 * 3600 * 1000)
    yield pd.DataFrame(out, columns=["match_id", "innings", "delivery_id", "runs", "wickets", "balls_left", "wp_batting_team"])


def momentum(deliveries: DataFrame, late: str = "10 minutes") -> DataFrame:
    """State after each ball of a stream of deliveries (columns of ``INPUT``), kept by match.

    One small state for each match under way; it goes 12 hours after the watermark of its last balls. Balls
    of one match must come in order of delivery_id from trigger to trigger.
    """
    return (
        deliveries.withWatermark("bowled_at", late)
        .groupBy("match_id")
        .applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
