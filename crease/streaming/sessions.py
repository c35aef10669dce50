"""Visits of users over a stream of events (an extension): session windows that end when a user has been quiet for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

INPUT = "ts timestamp, user_id long, event_type string"


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, session_start, session_end (`gap` after the last event), events and kinds (of event) of each visit.

    Over a stream a visit is given once no event that comes within `late` can change it; events that come later than
    that are left out and counted (`LateRows`). Over a table nothing is late. Events without a time are left out; a
    null user is a user.
    """
    rows = events.filter("ts is not null").select("ts", "user_id", "event_type")
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    visits = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"), F.collect_set("event_type").alias("kinds"))
    return visits.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events", F.size("kinds").cast("long").alias("kinds"))


class LateRows(StreamingQueryListener):
    """Counts, by query id, the rows that came too late; add it to ``spark.streams`` before the query starts."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.dropped[str(p.id)] = self.dropped.get(str(p.id), 0) + sum(o.numRowsDroppedByWatermark for o in p.stateOperators)

    def onQueryTerminated(self, event) -> None:
        pass
