"""Committed tables: a folder holds versions of a set of tables, and a pointer written last says which files each consists of.

A version is a file ``_versions/<number>``, made only if there is none, that lists each table's Parquet folders by bucket
(a hash of the table's keys). A change reads and writes the buckets that its rows touch, in a new folder, and then makes
the next version: a crash before that leaves the old version and some unread files, readers keep the files of the version
they began with, and of two writers from one version the second fails (`Conflict`). All tables of one `commit` change together.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crease.sources import ingest

BUCKET = "bucket_"


class Conflict(RuntimeError):
    """Another writer has made the next version."""


@dataclass(frozen=True)
class Change:
    """`how`: append, insert_if_absent, upsert, update, delete, fill_nulls or replace. `keys` and `buckets` are those of a table that isn't there yet."""

    how: str
    rows: DataFrame
    keys: tuple[str, ...] = ()
    buckets: int = 16


@dataclass(frozen=True)
class Snapshot:
    spark: SparkSession
    folder: str
    version: int = 0
    tables: dict = field(default_factory=dict)

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def table(self, name: str, buckets: list[str] | None = None) -> DataFrame:
        """The table as of this version, or some of its buckets."""
        t = self.tables[name]
        schema = T.StructType.fromJson(t["schema"])
        paths = [f"{self.folder}/{p}" for b, parts in t["parts"].items() if buckets is None or b in buckets for p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _list(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def versions(spark: SparkSession, folder: str) -> list[int]:
    return [int(x) for x in _list(spark, f"{folder}/_versions") if x.isdigit()]


def current(spark: SparkSession, folder: str, version: int | None = None) -> Snapshot:
    """The newest version that was written to its end, or the one asked for; an empty one of number 0 where there is none."""
    folder = folder.rstrip("/")
    for n in sorted(versions(spark, folder), reverse=True) if version is None else [version]:
        fs, at = _fs(spark, f"{folder}/_versions/{n:012d}")
        stream = fs.open(at)
        try:
            text = _text(spark, stream)
        finally:
            stream.close()
        try:
            return Snapshot(spark, folder, n, json.loads(text)["tables"])
        except ValueError:
            continue  # a writer died, or is at work
    return Snapshot(spark, folder, max(versions(spark, folder), default=0))


def _text(spark: SparkSession, stream) -> str:
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
    lines = []
    while (line := reader.readLine()) is not None:
        lines.append(line)
    return "\n".join(lines)


def _publish(base: Snapshot, tables: dict) -> Snapshot:
    """Make the next version, unless another writer has."""
    if current(base.spark, base.folder).version != base.version:
        raise Conflict(f"version {base.version} of {base.folder} is no longer the newest")
    number = max([base.version, *versions(base.spark, base.folder)]) + 1  # what a writer left unfinished keeps its number
    fs, at = _fs(base.spark, f"{base.folder}/_versions/{number:012d}")
    try:
        out = fs.create(at, False)
    except Exception as e:
        raise Conflict(f"version {number} of {base.folder} is there") from e
    out.write(bytearray(json.dumps({"tables": tables}).encode()))
    out.close()
    return Snapshot(base.spark, base.folder, number, tables)


def _bucketed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*(F.col(k) for k in keys)), F.lit(buckets)) if keys else F.lit(0))


def _write(base: Snapshot, rows: DataFrame, keys: list[str], buckets: int) -> dict[str, str]:
    """Write rows by bucket to a new folder; the folder of each bucket that has rows."""
    folder = f"data/{uuid.uuid4().hex}"
    _bucketed(rows, keys, buckets).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{base.folder}/{folder}")
    return {x.split("=")[1]: f"{folder}/{x}" for x in _list(base.spark, f"{base.folder}/{folder}") if x.startswith(f"{BUCKET}=")}


_REWRITES: dict[str, Callable[[DataFrame, DataFrame, list[str]], DataFrame]] = {
    "upsert": ingest.upsert, "update": ingest.update, "delete": ingest.delete, "fill_nulls": lambda old, new, keys: ingest.fill_nulls(old, new, keys).drop("outcome")
}


def _changed(base: Snapshot, name: str, change: Change) -> dict:
    if name not in base.tables or change.how == "replace":
        if change.how in ("update", "delete"):
            raise KeyError(name)
        old = base.tables.get(name)
        keys, n = (old["keys"], old["buckets"]) if old else (list(change.keys), change.buckets)
        rows = ingest._once(change.rows, keys) if keys and change.how not in ("append", "replace") else change.rows
        return {"keys": keys, "buckets": n, "schema": json.loads(rows.schema.json()), "parts": {b: [p] for b, p in _write(base, rows, keys, n).items()}}
    t = base.tables[name]
    keys, n, schema = t["keys"], t["buckets"], T.StructType.fromJson(t["schema"])
    types = {f.name: f.dataType for f in schema}
    rows = change.rows.select(*(F.col(f"`{c}`").cast(types[c]).alias(c) for c in types if c in change.rows.columns))
    if change.how == "append":
        rows = ingest.append(base.spark.createDataFrame([], schema), rows)
        return t | {"parts": _plus(t["parts"], _write(base, rows, keys, n))}
    touched = [str(r[0]) for r in _bucketed(rows, keys, n).select(BUCKET).distinct().collect()]  # at most `buckets`
    old = base.table(name, touched)
    if change.how == "insert_if_absent":
        return t | {"parts": _plus(t["parts"], _write(base, ingest.absent(old, rows, keys), keys, n))}
    new = _write(base, _REWRITES[change.how](old, rows, keys), keys, n)
    return t | {"parts": {b: p for b, p in t["parts"].items() if b not in touched} | {b: [p] for b, p in new.items()}}


def _plus(parts: dict[str, list[str]], more: dict[str, str]) -> dict[str, list[str]]:
    return {b: parts.get(b, []) + ([more[b]] if b in more else []) for b in {*parts, *more}}


def commit(base: Snapshot, changes: dict[str, Change]) -> Snapshot:
    """The version after `base`, with all changes or, on any failure, not at all."""
    return _publish(base, base.tables | {name: _changed(base, name, change) for name, change in changes.items()})


def clean(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Forget all but the newest `keep` versions and delete what only the others read; returns how many folders went. Files of a writer at work are in no version, so they stay."""
    folder = folder.rstrip("/")
    every = versions(spark, folder)
    at = {n: {p for t in current(spark, folder, n).tables.values() for parts in t["parts"].values() for p in parts} for n in every}
    kept, gone = every[-keep:], every[:-keep]
    used = set().union(*(at[n] for n in kept))
    unread = set().union(*(at[n] for n in gone)) - used if gone else set()
    for path in [f"_versions/{n:012d}" for n in gone] + sorted(unread):
        fs, p = _fs(spark, f"{folder}/{path}")
        fs.delete(p, True)
    return len(unread)
