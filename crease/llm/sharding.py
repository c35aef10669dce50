"""Sharding by Karmarkar-Karp differencing.

Law `bytes`: groups of equal texts are indivisible and go to shards of near equal bytes. A partial
partition is a tuple of shard sums; the two with the largest spread are combined, one's largest sums
with the other's smallest, until one is left. While there are more than `CELL` items, cells of that many
are differenced in parallel, each into `FINE` bundles for every shard, and the bundles are the next level's
items; the last level is one task over at most `CELL` items. A large group ends up alone in its
bundle, so the small ones can even it out; a group larger than a shard's share stays whole.

Slots are gapless within a shard: counts of (shard, bucket) give each bucket's offset, and rows are
numbered within buckets, which are small however large a group is. Rows of a very large group are joined
with its shard apart (`join_heavy`). Null texts count as empty, of size 1;
null ids are kept; repeated rows get slots of their own; other columns are not read.
"""

from __future__ import annotations

import heapq
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crease.llm.common import col, cut, join_heavy

CELL, FINE = 4096, 4


def difference(parts: list[list[int]]) -> list[list[int]]:
    """For each partial partition, to which final shard each of its sums goes (largest differencing method)."""
    order = count()
    shards = len(parts[0])
    heap = []
    for i, sums in enumerate(parts):
        ranked = sorted(((x, (i, k)) for k, x in enumerate(sums)), key=lambda y: -y[0])
        heap.append((ranked[-1][0] - ranked[0][0], next(order), [x for x, _ in ranked], [y for _, y in ranked]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        merged = sorted(((a[k] + b[-1 - k], (left[k], right[-1 - k])) for k in range(shards)), key=lambda y: -y[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], next(order), [x for x, _ in merged], [y for _, y in merged]))
    out = [[0] * shards for _ in parts]
    for shard, tree in enumerate(heap[0][3]):
        stack = [tree]
        while stack:
            x = stack.pop()
            if isinstance(x[0], tuple):
                stack += x
            else:
                out[x[0]][x[1]] = shard
    return out


def assign(groups: DataFrame, shards: int, cell: int = CELL) -> DataFrame:
    """key, shard of each (key, bytes); keys must be distinct. `cell` must be well above `shards`."""
    if cell < 4 * FINE * shards:
        raise ValueError("a cell needs at least four items a bundle")

    def split(parts: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("item")
            goes = difference([[x] + [0] * (parts - 1) for x in pdf["bytes"].tolist()])
            return pdf.assign(bundle=pdf["cell"] * parts + [x[0] for x in goes])[["item", "bundle", "bytes"]]

        return run

    n = groups.count()
    items = groups.withColumnRenamed("key", "item")
    where = None
    while True:
        cells = max(1, -(-n // cell))
        parts = shards if cells == 1 else FINE * shards
        step = cut(items.withColumn("cell", F.pmod(F.xxhash64("item"), F.lit(cells))).groupBy("cell").applyInPandas(split(parts), "item long, bundle long, bytes long"))
        goes = step.select(F.col("item").alias("at"), "bundle")
        where = goes.withColumnRenamed("at", "key") if where is None else where.join(goes, "at").select("key", "bundle")
        if cells == 1:
            return where.select("key", F.col("bundle").cast("int").alias("shard"))
        where = where.withColumnRenamed("bundle", "at")
        items = step.groupBy(F.col("bundle").alias("item")).agg(F.sum("bytes").alias("bytes"))
        n = cells * parts


def shard(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", cell: int = CELL, bucket_rows: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row."""
    t = F.coalesce(col(text), F.lit(""))
    rows = cut(docs.select(col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("key"), F.monotonically_increasing_id().alias("row")))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    total = rows.count()
    buckets = max(1, -(-total // bucket_rows))
    joined = join_heavy(rows, assign(groups.drop("n"), shards, cell), "key", lambda: groups.select("key", "n"), total)
    # cut: the slots below need each row in the same place every time
    placed = cut(joined.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets))))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row")) - 1
    numbered = placed.withColumn("within", within).join(offsets, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), (F.col("offset") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
