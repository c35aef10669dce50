"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python regular expression for the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once: a lambda's variable holds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names`, each with underscores added until no column of `df` is called so, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def _shared(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="crease-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the folder that the driver and all executors share: the session's ``spark.checkpoint.dir``; a temporary folder only in local mode (tests)."""
    return f"{_shared(spark).rstrip('/')}/{name}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of ours in the shared folder, through the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from those files, so that a lost executor costs no more than the work since."""
    _shared(df.sparkSession)
    return df.checkpoint()


#: Rows of one key from which on they are joined apart, and the most such keys that are sent to every task.
HEAVY_ROWS, HEAVY_KEYS = 1_000_000, 10_000


def join_heavy(rows: DataFrame, side: DataFrame, key: str, counts: Callable[[], DataFrame], total: int, how: str = "inner", heavy_rows: int | None = None) -> DataFrame:
    """`rows` (`total` of them) joined with `side` (one row a key) by `key`, however many of the rows share a key.

    `counts` gives key, n (rows of each key). Keys of more than `heavy_rows` rows are few: their part of `side` is sent
    to every task and their rows stay where they are; the rest is shuffled. Where there are such keys, `rows` is read
    twice. At most HEAVY_KEYS keys are sent: were there more, the bound would rise until that holds.
    """
    least = max(HEAVY_ROWS if heavy_rows is None else heavy_rows, total // HEAVY_KEYS)  # so there are HEAVY_KEYS at most
    if total <= least:
        return rows.join(side, key, how)
    heavy = cut(counts().filter((F.col("n") > least) & F.col(key).isNotNull()).select(F.col(key).alias("__heavy")))
    if not heavy.limit(1).count():
        return rows.join(side, key, how)
    few, same = F.broadcast(heavy), F.col(key) == F.col("__heavy")
    rest = rows.join(few, same, "left_anti").join(side, key, how)
    apart = rows.join(few, same, "left_semi").join(F.broadcast(side.join(few, same, "left_semi")), key, how)
    return rest.unionByName(apart)


def pieces(batches: Iterator[pa.RecordBatch], column: str, chars: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about `chars` bytes of `column`, one row at least, to bound a task's memory."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + (n or 0) > chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        if start < len(sizes):
            yield batch.slice(start)


def before(values: Column, zero: int, op: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """For each place of an array<int>, `op` (associative) over all earlier values; `zero` before the first.

    By blocks: each block's total, the totals before each block, then what stands earlier in the own block. A
    running result in an aggregate's state would be copied at every step, so that the cost grew with the square.
    """

    def over(v: Column, start: Column, n: Column) -> Column:
        return F.aggregate(F.slice(v, start + 1, n), F.lit(zero), lambda a, b: op(a, b))

    def whole(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / block).cast("int")), lambda b: over(v, b * block, F.lit(block)))

    def ahead(totals: Column) -> Column:
        return F.transform(totals, lambda _, b: over(totals, F.lit(0), b))

    def place(v: Column, p: Column) -> Column:
        return F.transform(v, lambda _, i: op(F.get(p, F.floor(i / block).cast("int")), over(v, i - i % block, i % block)))

    return let(values, lambda v: let(whole(v), lambda totals: let(ahead(totals), lambda p: place(v, p))))


def regex_spans(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """Leftmost non-overlapping matches of `pattern` as array<struct<start,end,kind>>, in code points.

    What stands between the matches (split) and the matches themselves alternate, so their lengths
    give the offsets; the pattern must not match the empty string. `keep` filters by the text of
    `group`. Texts without a match cost one search.
    """
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part")
    )
    sizes = F.transform(found, lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.coalesce(F.char_length(x["hit"]), F.lit(0)).alias("hit"), (x["hit"].isNotNull() & (keep(x["part"]) if keep else F.lit(True))).alias("ok")))

    def spans(s: Column, at: Column) -> Column:
        placed = F.transform(s, lambda x, i: F.struct((F.get(at, i) + x["gap"]).alias("start"), (F.get(at, i) + x["gap"] + x["hit"]).alias("end"), F.lit(kind).alias("kind"), x["ok"].alias("ok")))
        return F.transform(F.filter(placed, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))

    all_spans = let(sizes, lambda s: let(before(F.transform(s, lambda x: x["gap"] + x["hit"]), 0, lambda a, b: a + b), lambda at: spans(s, at)))
    return F.when(text.rlike(pattern), all_spans).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string>>"))
