"""Periodic runs of words: stretches that repeat themselves, such as loops of boilerplate or of a generator gone stale.

Method: repeated k-gram masking. A run of period q has at least max(least, 2 q) words, so the stretch without its last
q words and the one without its first q words are equal, overlap in max(least - q, q) words or more, and cover it.
With k the least of those bounds over all q (6 for runs of 12 words), each word of a run lies in a k-gram that the
document holds twice. Words outside such k-grams can't join runs; k-grams are found by sorting their hashes (a
collision only keeps a word too many). Main and Lorentz's algorithm, which halves a stretch and finds the runs that
cross its middle from four arrays of longest common extensions, then searches only the segments that survive, each
whole: time n log n in their words.

A document is one row and is searched in its row; no state outlives it. Null texts count as empty and have no run.
Rows whose doc_id is null give rows too. Repeated rows give repeated results, empty tables empty ones, and other
columns are not read (`collapse` passes them through).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crease.llm.common import col, fresh, pieces

#: Words that a run has at least.
LEAST = 12


def overlap(least: int) -> int:
    """The fewest words by which a run and itself, moved on by its period, overlap."""
    return min(max(least - q, q) for q in range(1, least + 1))


def segments(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """The stretches (start, end) of `least` words or more that consist of k-grams standing twice or more in `ids`."""
    k = overlap(least)
    if len(ids) < least:
        return []
    n = len(ids) - k + 1
    grams, x = np.zeros(n, np.uint64), ids.astype(np.uint64)
    for j in range(k):
        grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x[j : j + n]
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    change[at] += 1
    np.add.at(change, at + k, -1)
    edges = np.flatnonzero(np.diff(np.r_[False, np.cumsum(change)[:-1] > 0, False]))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= least]


def _z(s: list[int]) -> list[int]:
    """For each place, how many items from there on equal those from the beginning on."""
    n = len(s)
    z, left, right = [n] + [0] * (n - 1), 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(s: list[int], low: int, mid: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the repetitions within s[low:high] that cross `mid`, as far as they go there; a period may be a multiple of the smallest."""
    u, v, both = s[low:mid], s[mid:high], s[low:high]
    back = u[::-1]
    ahead, behind = _z(v), _z(back)
    to_left = _z([*back, -1, *both[::-1]])[len(u) + 1 :]  # common suffix of u and of both, less the last i items
    to_right = _z([*v, -1, *both])[len(v) + 1 :]
    for p in range(1, len(v) + 1):
        a, b = to_left[len(v) - p], ahead[p] if p < len(v) else 0
        if a + b >= p:
            yield mid - a, mid + p + b, p
    for p in range(1, len(u) + 1):
        a, b = behind[p] if p < len(u) else 0, to_right[len(u) - p]
        if a + b >= p:
            yield mid - p - a, mid + b, p


def runs_of(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of `least` items and two periods or more, by start and period."""
    found: dict[tuple[int, int], int] = {}
    for first, last in segments(ids, least):
        s = ids[first:last].tolist()
        todo = [(0, len(s))]
        while todo:
            low, high = todo.pop()
            if high - low < least:
                continue
            mid = (low + high) // 2
            todo += [(low, mid), (mid, high)]
            for a, b, p in crossing(s, low, mid, high):
                # what reaches an inner border goes on there, and is found whole where that border is the middle
                if b - a >= max(least, 2 * p) and (a > low or low == 0) and (b < high or high == len(s)):
                    at = first + a, first + b
                    found[at] = min(p, found.get(at, p))
    return sorted((a, b - a, p) for (a, b), p in found.items())


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # bytes: at \x20 and \x09-\x0D only


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if each run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, start, length, period (long) of every run of every text, in words from 0."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            ids, out = batch.column("doc_id"), []
            for k, x in enumerate(batch.column("text").to_pylist()):
                out += [(k, *r) for r in runs_of(numbered(words_of(x)), least)]
            at = pa.array([r[0] for r in out], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), *(pa.array([r[i] for r in out], pa.int64()) for i in (1, 2, 3))], ["doc_id", "start", "length", "period"])

    rows = docs.select(col(doc_id).alias("doc_id"), col(text).cast("binary").alias("text"))
    return rows.mapInArrow(found, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, period long")


def collapse(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """`docs`, the words of each text that holds a run joined by one space, of each run its first period only; other texts stay as they are."""

    @F.pandas_udf("string")
    def collapsed(texts):
        def one(x):
            words = words_of(x if x is None else bytes(x))
            r = runs_of(numbered(words), least)
            return b" ".join(w for w, k in zip(words, kept_words(len(words), r)) if k).decode() if r else None

        return texts.map(one, na_action="ignore").astype(object)

    (done,) = fresh(docs, "collapsed")
    rows = docs.withColumn(done, collapsed(col(text).cast("binary")))
    return rows.select(*(F.coalesce(F.col(done), col(c)).alias(c) if c == text else col(c) for c in docs.columns))


def damaged(words: list[bytes], doc_id: object) -> list[bytes]:
    """The words, for one in ten ids (by crc32 of the decimal id) with a periodic tail; of a null id as they are."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, damage: bool = False) -> DataFrame:
    """A row a document: doc_id, n_runs, the longest run's start, length, period and exponent_milli (null without a run; ties to the smallest start, then period) and the digests runs_sha256 and collapsed_sha256.

    runs_sha256 is of each run's ``start,length,period`` and a line feed, by start and period; collapsed_sha256 of the
    words left when each run keeps its first period, joined by one space. `damage` gives one document in ten a periodic tail first.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = []
            for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(x)
                if damage:
                    words = damaged(words, i)
                r = runs_of(numbered(words), least)
                top = min(r, key=lambda y: (-y[1], y[0], y[2]), default=None)
                longest = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
                kept = [w for w, k in zip(words, kept_words(len(words), r)) if k] if r else words
                out.append((len(r), *longest, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in r).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = [pa.array([r[k] for r in out], pa.int64() if k < 5 else pa.string()) for k in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *NUMBERS, "runs_sha256", "collapsed_sha256"])

    rows = docs.select(col(doc_id).alias("doc_id"), col(text).cast("binary").alias("text"))
    return rows.mapInArrow(digests, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in NUMBERS)}, runs_sha256 string, collapsed_sha256 string")


NUMBERS = ["n_runs", "start", "length", "period", "exponent_milli"]
