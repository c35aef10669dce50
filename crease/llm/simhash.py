"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint maps to the bit counts of its 16 segments of 4 bits. The Manhattan distance of two such
vectors never exceeds the Hamming distance of the fingerprints, so a range join on the grid of vectors
finds every near pair: each fingerprint visits the cells within one step, and two fingerprints that
differ in at most two bits meet in the cell of a value between them. Verification is exact and makes no
pairs: in a cell with company, a fingerprint names the values one bit away that lie in that cell; two
fingerprints share such a value exactly if they differ in at most two bits. At most 65 fingerprints can
share one, so every group there is small, whatever the size of a group of copies.

Equal fingerprints are one node, so copies never become pairs. A fingerprint or class of very many rows is
joined apart (`join_heavy`). Null texts count as empty (fingerprint zero). Rows whose doc_id is null take
part; a class without any doc_id has component_id null. Repeated rows give repeated results. Ids may be of
any type with an order. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.llm.common import col, cut, fresh, join_heavy, pieces

SEGMENTS, WIDTH = 16, 4
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of a UTF-8 text, as a signed 64-bit integer."""
    words = (text or b"").lower().split()  # bytes: only A-Z, and only \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
        n = len(words) - shingle + 1
    hashes = np.fromiter(map(_hash, grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        ones += np.unpackbits(hashes[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _ones(fp: Column, segment: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, WIDTH * segment).bitwiseAND(F.lit((1 << WIDTH) - 1)))


def near_edges(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that join exactly the distinct fingerprints linked by chains of 2 or fewer differing bits."""
    vector = sum((F.shiftleft(_ones(F.col("fp"), s).cast("long"), 3 * s) for s in range(1, SEGMENTS)), _ones(F.col("fp"), 0).cast("long"))
    steps = [F.struct(F.lit(-1).alias("segment"), F.lit(0).alias("turn"), F.lit(0).cast("long").alias("by"))]
    steps += [F.struct(F.lit(s).alias("segment"), F.lit(d).alias("turn"), F.lit(d << (3 * s)).cast("long").alias("by")) for s in range(SEGMENTS) for d in (1, -1)]
    visits = fps.select("fp", vector.alias("v")).select("fp", "v", F.explode(F.array(*steps)).alias("step"))
    visits = visits.select("fp", (F.col("v") + F.col("step.by")).alias("cell"), F.col("step.segment").alias("segment"), F.col("step.turn").alias("turn"))
    busy = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell")
    met = visits.join(busy, "cell")
    first = F.col("segment") * WIDTH
    flips = F.filter(
        F.transform(F.array(*[F.lit(i) for i in range(WIDTH)]), lambda i: first + i),
        lambda bit: F.call_function("shiftrightunsigned", F.col("fp"), bit).bitwiseAND(F.lit(1)) == F.when(F.col("turn") == 1, 0).otherwise(1),
    )
    between = F.when(F.col("turn") == 0, F.array("fp")).otherwise(F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))))
    near = met.select("fp", F.explode(between).alias("value"))
    hubs = near.groupBy("value").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("b <> top").select("value", "b")
    return near.join(hubs, "value").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each node's component, by alternating large-star and small-star steps.

    Each step halves chains, so rounds grow with the logarithm of a component's length; state is cut to
    the shared checkpoint folder every round. Only counts reach the driver.
    """

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = join_heavy(both, least, "a", lambda: both.groupBy("a").agg(F.count(F.lit(1)).alias("n")), 2 * seen[0])
        if large:
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return joined.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    edges = cut(edges)
    seen = sign(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        edges = cut(star(star(edges, True), False))
        if (now := sign(edges)) == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).groupBy("node").agg(F.min("root").alias("root"))


def _keyed(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """doc_id (as it is), key (hash of the text), fp of each row, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], pa.int64())], names=["doc_id", "key", "fp"])

    source = docs.select(col(doc_id).alias("doc_id"), F.xxhash64(col(text)).alias("key"), col(text).cast("binary").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return cut(source.mapInArrow(run, f"doc_id {kind}, key long, fp long"))


def _labels(nodes: DataFrame) -> DataFrame:
    """fp, root (one fingerprint for each class), component_id (the class's least doc_id) of nodes (fp, least)."""
    linked = components(near_edges(nodes))
    roots = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp")
    rooted = cut(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    several = rooted.filter("fp <> root").select("root").distinct()
    # only classes of several fingerprints meet again by root
    inner = cut(rooted.join(several, "root", "left_semi"))
    named = inner.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    together = join_heavy(inner, named.drop("n"), "root", lambda: named.select("root", "n"), inner.count())
    alone = rooted.join(several, "root", "left_anti").withColumn("component_id", F.col("least"))
    # cut: as a plain table on one side, Spark can split the rows of a fingerprint that many documents share
    return cut(together.select("fp", "root", "component_id").unionByName(alone.select("fp", "root", "component_id")))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id of each row."""
    found = _keyed(docs, doc_id, text, shingle).drop("key")
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    labels = _labels(nodes.drop("n")).select("fp", "component_id")
    named = join_heavy(found, labels, "fp", lambda: nodes.select("fp", "n"), found.count())
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Rows to drop (about 50 bytes each in a task's table) up to which they are sent to every task.
BROADCAST_SPARE = 500_000


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with exactly one row of each class: that of its least doc_id (null only if all are), of equal ids the one whose text has the least hash.

    Rows are told apart by doc_id and a hash of the text, so an id reused for different texts costs none of them its
    place; of rows alike in both any one stays. All columns pass through, whatever their names.
    """
    found = _keyed(docs, doc_id, text, 3)
    # a class's row: struct order puts ids before nulls, then the least id, then the least hash
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))
    best = found.groupBy("fp").agg(F.min(rank).alias("least"), F.count(F.lit(1)).alias("n"))
    winners = _labels(best.drop("n")).select(F.col("component_id.doc_id").alias("w_id"), F.col("component_id.key").alias("w_key")).distinct()
    winners = cut(winners)
    same_row = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key"))
    rows = found.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    spare = cut(rows.join(winners, same_row, "left_anti").select("doc_id", "key"))
    again = cut(rows.filter("n > 1").join(winners, same_row, "left_semi").select("doc_id", "key"))

    key, s_id, s_key = fresh(docs, "__key", "__id", "__of")
    keyed = docs.withColumn(key, F.xxhash64(col(text)))

    def named(df: DataFrame) -> DataFrame:
        return df.select(F.col(df.columns[0]).alias(s_id), F.col(df.columns[1]).alias(s_key))

    same = col(doc_id).eqNullSafe(col(s_id)) & (col(key) == col(s_key))
    if spare.limit(BROADCAST_SPARE + 1).count() <= BROADCAST_SPARE:
        kept = keyed.join(F.broadcast(named(spare)), same, "left_anti")
    else:
        kept = keyed.join(named(winners), same, "left_semi")
    if not again.limit(1).count():
        return kept.drop(key)
    repeated = named(again)
    if again.limit(BROADCAST_SPARE + 1).count() <= BROADCAST_SPARE:
        repeated = F.broadcast(repeated)
    once = kept.join(repeated, same, "left_semi").dropDuplicates([doc_id, key])
    return kept.join(repeated, same, "left_anti").unionByName(once).drop(key)
