"""Visits over a stream, under shuffled arrival, against a plain loop and the registered query."""

import datetime
import random
import time
from collections import defaultdict

from crease import catalog
from crease.streaming import sessions

GAP = datetime.timedelta(minutes=30)


def plain(rows):
    by, out = defaultdict(list), []
    for ts, user, kind in sorted((r for r in rows if r[0]), key=lambda r: r[0]):
        by[user].append((ts, kind))
    for user, events in by.items():
        visit = []
        for e in [*events, None]:
            if visit and (e is None or e[0] - visit[-1][0] > GAP):
                out.append((user, visit[0][0], visit[-1][0] + GAP, len(visit), len({k for _, k in visit})))
                visit = []
            visit.append(e)
    return sorted(out, key=str)


def made(seed):
    r = random.Random(seed)
    day = datetime.datetime(2024, 1, 1)
    rows = [(day + datetime.timedelta(minutes=r.choice([r.randrange(3000), 30 * r.randrange(100)])), r.choice([1, 2, 3, None]), r.choice("abc")) for _ in range(400)]
    return [*rows, (None, 1, "a")]


def streamed(spark, tmp_path, parts, late):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, sessions.INPUT).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        time.sleep(1.1)  # files are read in the order of their times, in whole seconds
    listener = sessions.LateRows()
    spark.streams.addListener(listener)
    stream = spark.readStream.schema(sessions.INPUT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = sessions.sessions(stream, late=late).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(180)
        time.sleep(2)
    finally:
        q.stop()
        spark.streams.removeListener(listener)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    return got, listener.dropped[str(q.id)]


def test_a_table_of_events(spark):
    rows = made(1)
    assert sorted(map(tuple, sessions.sessions(spark.createDataFrame(rows, sessions.INPUT)).collect()), key=str) == plain(rows)


def test_registered_query_is_that_of_the_operator(spark, sf_dir):
    want = sessions.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))
    got = catalog.queries()["s01_sessions"](spark, sf_dir)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() > 10


def test_shuffled_arrival_within_the_watermark(spark, tmp_path):
    rows = made(2)
    random.Random(3).shuffle(rows)
    end = (datetime.datetime(2030, 1, 1), 9, "z")  # moves the watermark past all else
    got, dropped = streamed(spark, tmp_path, [rows[:150], rows[150:300], rows[300:], [end], [(datetime.datetime(2030, 1, 2), 9, "z")]], "10 days")
    assert dropped == 0 and got == plain(rows)  # the last two visits are not over


def test_late_events_are_counted(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    early, late = [(day, 1, "a"), (day + datetime.timedelta(minutes=5), 1, "b")], [(day - datetime.timedelta(days=2), 1, "a"), (day - datetime.timedelta(days=3), 2, "a")]
    got, dropped = streamed(spark, tmp_path, [early, [(day + datetime.timedelta(days=1), 5, "c")], [(day + datetime.timedelta(days=1), 5, "c"), *late], [(day + datetime.timedelta(days=3), 9, "z")]], "1 hour")
    assert dropped == 2 and got == plain([*early, *[(day + datetime.timedelta(days=1), 5, "c")] * 2])
