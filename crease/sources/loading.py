"""Loads of match files into committed tables: only files not loaded before, with counters and a quarantine."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from crease.session import kept
from crease.sources import ingest, snapshots
from crease.sources.snapshots import Change

#: Keys of the tables that a load writes.
KEYS = {"files": ("path",), "matches": ("match_id",), "deliveries": ("match_id",), "venues": ("venue_key",), "quarantine": ("path",)}
COUNTERS = ["files_found", "files_new", "matches_loaded", "deliveries_loaded", "files_skipped", "quarantined"]


def _count(seen: Observation, df: DataFrame) -> int:
    try:
        return seen.get["n"]
    except Py4JJavaError:
        if df.isEmpty():  # a plan found empty as it runs loses its metrics
            return 0
        raise


def load(spark: SparkSession, path: str, folder: str, dry_run: bool = False) -> dict[str, int]:
    """Load the match files under `path` into the tables in `folder` (files, matches, deliveries, venues, quarantine), all at once or not at all.

    Files whose path is in `files` are not read again. Counters: files found and new, matches and deliveries loaded,
    new files that gave no match, rows in quarantine; the counts of rows come from the jobs that write them. A dry run
    counts without a commit. Paths of new files pass the driver, as those of all files do when Spark lists them.
    """
    base = snapshots.current(spark, folder)
    found = ingest.listed(spark, path).select("path")
    new = found.join(base.table("files").select("path"), "path", "left_anti") if "files" in base else found
    paths = [r["path"] for r in new.collect()]
    counts = dict.fromkeys(COUNTERS, 0) | {"files_found": found.count(), "files_new": len(paths)}
    if not paths:
        return counts
    files = kept(ingest.read_matches(spark, paths))
    known = base.table("files").filter("match_id is not null").select("league_id", "stem", "match_id") if "files" in base else None
    fresh = files.join(known, ["league_id", "stem"], "left_anti").select(*files.columns) if known is not None else files
    last = known.agg(F.max("match_id")).first()[0] if known is not None else None
    good = kept(ingest.with_match_ids(fresh, known if last else None))
    venues = kept(ingest.venues(good, base.table("venues") if "venues" in base else None))
    tables = {"matches": ingest.matches(good, venues), "deliveries": ingest.deliveries(good), "quarantine": ingest.quarantine(files, good)}
    watched, seen = {}, {}
    for name, df in tables.items():
        seen[name] = Observation(name)
        watched[name] = df.observe(seen[name], F.count(F.lit(1)).alias("n"))
    manifest = files.select("path", "league_id", "stem", "error").join(good.select("path", "match_id"), "path", "left")
    if dry_run:
        for df in watched.values():
            df.write.format("noop").mode("overwrite").save()
    else:
        how = {"files": "append", "matches": "append", "deliveries": "append", "venues": "insert_if_absent", "quarantine": "append"}
        rows: dict[str, DataFrame] = {**watched, "files": manifest, "venues": venues}
        snapshots.commit(base, {name: Change(how[name], df, KEYS[name]) for name, df in rows.items()})
    n = {name: _count(o, tables[name]) for name, o in seen.items()}
    return counts | {"matches_loaded": n["matches"], "deliveries_loaded": n["deliveries"], "files_skipped": len(paths) - n["matches"], "quarantined": n["quarantine"]}
