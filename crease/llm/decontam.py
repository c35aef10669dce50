"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by size (powers of two of their number of shingles). An item's signature is its
least min-hash values, as many as its partition needs: an item that is contained to the degree
`threshold` misses at most (1 - threshold) of its shingles, so of the (that many + 1) least at least one
is in the document, however long the document is. Documents that hold a signature value are candidates;
candidates are verified by the exact number of the item's distinct shingles, compared word by word, that they hold.

Words are runs of letters and digits, lower-cased; shingles have five words (a shorter item is one
shingle of all its words; an item without words matches nothing). DataFrame functions only. Null texts
hold nothing; null ids are kept as values; repeated rows give one result; empty tables give none. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.llm.common import col, cut, fresh

SHINGLE, THRESHOLD = 5, 0.8
#: Rows of signatures, shingles or candidates (some 100 bytes each in a task's table), and bytes of their texts, up to which they are sent to every task.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64_000_000
#: Parts that the rows of each shingle are dealt to where its side is too large to be sent.
PARTS = 64


def _fits(df: DataFrame) -> bool:
    texts = sum((F.coalesce(F.octet_length(col(c)), F.lit(0)) for c, kind in df.dtypes if kind == "string"), F.lit(0))
    rows, size = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(texts), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def _small(df: DataFrame) -> DataFrame:
    """`df`, broadcast if it has at most BROADCAST_ROWS rows and BROADCAST_BYTES of text; else the join shuffles."""
    return F.broadcast(df) if _fits(df) else df


def _meet(held: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """`held` (with its places, i) joined with `side` by the shingles `on`, however many rows of `held` hold the same one.

    A side that fits is sent to every task. A larger one has each row repeated for PARTS parts and `held` is dealt
    to these by text and place, so that a shingle which many documents hold goes to as many tasks.
    """
    if _fits(side):
        return held.drop("i").join(F.broadcast(side), on)
    every = side.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = held.withColumn("part", F.pmod(F.xxhash64("doc_id", "key", "i"), F.lit(PARTS)).cast("int")).drop("i")
    return dealt.join(every, [*on, "part"]).drop("part")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _runs(words: Column, size: int, make: Callable[[list[Column]], Column], kind: str) -> Column:
    """`make` of each run of `size` words, repeats included."""
    return F.when(F.size(words) < size, F.array().cast(f"array<{kind}>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: make([F.get(words, i + k) for k in range(size)]))
    )


def _joined(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)  # words hold no spaces, so this names the shingle


def item_index(items: DataFrame, item_id: str = "item_id", text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, size (words of its shingles), n (its distinct shingles), h and s (a shingle's hash and text), signature (whether h belongs to it) of each item and shingle."""
    words = items.select(col(item_id).alias("item_id"), _words(col(text)).alias("words")).filter(F.size("words") > 0)
    sizes = F.least(F.size("words"), F.lit(shingle))
    kind = "struct<h:bigint,s:string>"
    by_size = F.lit(None).cast(f"array<{kind}>")
    for k in range(1, shingle + 1):
        by_size = F.when(sizes == k, _runs(F.col("words"), k, lambda parts: F.struct(F.xxhash64(*parts).alias("h"), _joined(parts).alias("s")), kind)).otherwise(by_size)
    hashed = F.array_sort(F.array_distinct(by_size))
    rows = words.select("item_id", sizes.alias("size"), hashed.alias("hashes")).withColumn("n", F.size("hashes"))
    top = (F.pow(F.lit(2), F.length(F.bin("n"))) - 1).cast("int")  # the largest n of the partition
    depth = F.least(F.col("n"), top - F.ceil(F.lit(threshold) * top - 1e-9) + 1)
    return rows.select("item_id", "size", "n", depth.alias("depth"), F.posexplode("hashes").alias("k", "x")).select("item_id", "size", "n", "x.h", "x.s", (F.col("k") < F.col("depth")).alias("signature")).distinct()


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of each pair with containment of at least `threshold`."""
    index = cut(item_index(items, item_id, item_text, shingle, threshold))
    sizes = sorted(r[0] for r in index.select("size").distinct().collect())  # at most `shingle` values
    words = docs.select(col(doc_id).alias("doc_id"), F.xxhash64(col(text)).alias("key"), _words(col(text)).alias("words"))

    def of_size(make: Callable[[list[Column]], Column]) -> Column:
        """`make` of the words at place i, as many as `size` says."""
        out = F.lit(None)
        for k in sizes:
            out = F.when(F.col("size") == k, make([F.get("words", F.col("i") + j) for j in range(k)])).otherwise(out)
        return out

    def held(df: DataFrame, exact: bool) -> DataFrame:
        """doc_id, key, size, i, h (and the shingle itself): what the documents hold at each place, all sizes in one pass.

        Places are exploded, not shingles, so that the shingles are made in generated code.
        """
        sized = df.withColumn("size", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")))
        ends = F.size("words") - F.col("size")
        placed = sized.withColumn("i", F.explode(F.when(ends >= 0, F.sequence(F.lit(0), ends))))
        h = of_size(lambda parts: F.xxhash64(*parts)).cast("bigint").alias("h")
        return placed.select("doc_id", "key", "size", "i", h, *([of_size(_joined).cast("string").alias("s")] if exact else []))

    signatures = index.filter("signature").select("size", "h", "item_id").distinct()
    found = cut(_meet(held(words, False), signatures, ["size", "h"]).select("doc_id", "key", "item_id").distinct())
    wanted = _small(found.select("doc_id", "key").distinct().withColumnsRenamed({"doc_id": "d", "key": "k"}))
    suspects = words.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_semi")
    shared = _meet(held(suspects, True), index.select("size", "h", "s", "item_id", "n"), ["size", "h", "s"])
    counted = shared.select("doc_id", "key", "item_id", "n", "s").distinct().groupBy("doc_id", "key", "item_id", "n").agg(F.count(F.lit(1)).alias("n_shared"))
    pairs = counted.filter(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n") - 1e-9))
    best = pairs.groupBy("doc_id", "item_id").agg(F.max("n_shared").cast("long").alias("n_shared"), F.max("n").cast("long").alias("n_shingles"))
    return best.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def drop_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` without those that hold an item; all columns pass through, whatever their names."""
    key, gone_key = fresh(docs, "__key", "__gone")
    keyed = docs.withColumn(key, F.xxhash64(col(doc_id), col(text)))
    gone = leaks(keyed, items, key, text, **options).select(F.col("doc_id").alias(gone_key)).distinct()
    return keyed.join(_small(cut(gone)), F.col(key) == F.col(gone_key), "left_anti").drop(key)


#: The same rows as `leaks` over the tables documents and benchmark, for DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, least(len(w), 5) AS size, unnest([array_to_string(w[i:i + least(len(w), 5) - 1], ' ') for i in range(1, len(w) - least(len(w), 5) + 2)]) AS s FROM b WHERE len(w) > 0),
bn AS (SELECT item_id, size, s, count(*) OVER (PARTITION BY item_id) AS n FROM bs),
sizes AS (SELECT DISTINCT size FROM bs),
ds AS (SELECT DISTINCT doc_id, size, unnest([array_to_string(w[i:i + size - 1], ' ') for i in range(1, len(w) - size + 2)]) AS s FROM d, sizes WHERE len(w) >= size)
SELECT doc_id, item_id, count(*) AS n_shared, max(n) AS n_shingles, count(*) / max(n) AS containment
FROM ds JOIN bn USING (size, s) GROUP BY doc_id, item_id HAVING count(*) >= ceil(0.8 * max(n) - 1e-9)
"""
