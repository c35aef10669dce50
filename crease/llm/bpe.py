"""Byte-level BPE encoding and decoding.

Method: a segment tree over the ranks of adjacent pairs. A leaf holds (rank, position) of the pair
that starts at a symbol, inner nodes the minimum, so the root names the leftmost pair of lowest
rank; a merge updates three leaves and their ancestors, until no pair can be merged. Short words
are encoded many at once, one tree to a row of a matrix; long ones one at a time.

Null texts count as empty: no ids, empty decoded text. The input's other columns pass through; a column
of the input with the name of an output column is replaced. Empty tables give empty results, repeated
rows repeated results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crease.llm.common import col, pieces

NONE = np.int64(1) << 62
#: Words of more bytes get a tree of their own.
WIDE = 64
#: Words that a task keeps the ids of.
CACHE_WORDS = 150_000

#: The pre-tokenizer's pattern, and the same for texts of ASCII and Latin letters only.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\x09-\x0d\x20A-Za-z0-9À-ÖØ-öø-ɏ]+|[\x09-\x0d\x20]+(?![^\x09-\x0d\x20])|[\x09-\x0d\x20]+")
NOT_LATIN = re.compile(r"[^\x09-\x0d\x20-\x7eÀ-ɏ]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """A tokenizer file's tables; small and of fixed size, so it travels with the task."""

    def __init__(self, spec: dict):
        letters = byte_letters()
        vocab = dict(spec["model"]["vocab"])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.first = np.array([vocab[x] for x in letters], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        byte_of = {x: b for b, x in enumerate(letters)}
        of = {i: bytes(byte_of[c] for c in x) if all(c in byte_of for c in x) else x.encode() for x, i in chain(vocab.items(), self.special.items())}
        self.bytes = pa.array([of.get(i, b"") for i in range(max(of) + 2)], pa.large_binary())  # the last: of unknown ids
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        return cls(json.loads(Path(path).read_text(encoding="utf-8")))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where there is none or a symbol is missing (negative)."""
        key = left << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.order[at], NONE >> 32)


def merge_rows(v: Vocabulary, words: list[bytes], width: int) -> list[bytes]:
    """Ids, as packed int32, of words of 2 to `width` bytes (a power of two): one segment tree a row."""
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    sym = np.full((n, width + 1), -1, np.int64)  # the last column is a sentinel beyond the ends
    sym[:, :width][np.arange(width) < lengths[:, None]] = v.first[np.frombuffer(b"".join(words), np.uint8)]
    after = np.where(np.arange(width + 1) + 1 < lengths[:, None], np.arange(width + 1) + 1, width)
    before = np.broadcast_to(np.r_[width, np.arange(width)], (n, width + 1)).copy()
    tree = np.full((n, 2 * width), NONE, np.int64)
    tree[:, width:] = v.ranks(sym[:, :width], sym[:, 1 : width + 1]) << 32 | np.arange(width)
    for level in range(width.bit_length() - 2, -1, -1):
        a = 1 << level
        tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
    symf, afterf, beforef, treef = sym.reshape(-1), after.reshape(-1), before.reshape(-1), tree.reshape(-1)
    row = np.arange(n)
    while True:
        root = treef[row * 2 * width + 1]
        go = root < NONE >> 1
        row, root = row[go], root[go]
        if not len(row):
            break
        base, top = row * (width + 1), row * 2 * width
        at = root & 0xFFFFFFFF
        new = v.made[root >> 32]
        right = afterf[base + at]
        beyond, previous = afterf[base + right], beforef[base + at]
        symf[base + at], symf[base + right] = new, -1
        afterf[base + at] = beyond
        inner = beyond < width
        beforef[(base + beyond)[inner]] = at[inner]
        treef[top + width + right] = NONE
        treef[top + width + at] = v.ranks(new, symf[base + beyond]) << 32 | at
        has = previous < width
        treef[(top + width + previous)[has]] = v.ranks(symf[base + previous][has], new[has]) << 32 | previous[has]
        nodes = [width + right, width + at, width + np.where(has, previous, at)]
        for _ in range(width.bit_length() - 1):
            for i, x in enumerate(nodes):
                nodes[i] = x >> 1
                left = top + (nodes[i] << 1)
                treef[top + nodes[i]] = np.minimum(treef[left], treef[left + 1])
    kept = sym >= 0
    ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
    flat = sym[kept].astype(np.int32).tobytes()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def merge_one(v: Vocabulary, word: bytes) -> bytes:
    """Ids, as packed int32, of one word of any length; time n log n."""
    sym = v.first[np.frombuffer(word, np.uint8)]
    n = len(sym)
    width = 1 << max(1, (n - 1).bit_length())
    leaves = np.full(width, NONE, np.int64)
    leaves[: n - 1] = v.ranks(sym[:-1], sym[1:]) << 32 | np.arange(n - 1)
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = [int(NONE), *chain.from_iterable(x.tolist() for x in reversed(levels))]
    sym, none, made = sym.tolist(), int(NONE), v.made
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    known: dict[tuple[int, int], int] = {}

    def leaf(i: int) -> None:
        j = after[i] if sym[i] >= 0 else n
        if j >= n:
            x = none
        else:
            pair = sym[i], sym[j]
            if pair not in known:
                known[pair] = int(v.ranks(np.array(pair[:1]), np.array(pair[1:]))[0])
            x = known[pair] << 32 | i
        i += width
        tree[i] = x
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

    while tree[1] < none >> 1:
        i, new = tree[1] & 0xFFFFFFFF, int(made[tree[1] >> 32])
        j = after[i]
        sym[i], sym[j], after[i] = new, -1, after[j]
        if after[j] < n:
            before[after[j]] = i
        leaf(j)
        leaf(i)
        if before[i] >= 0:
            leaf(before[i])
    return np.array([x for x in sym if x >= 0], np.int32).tobytes()


class Encoder:
    """Encodes texts; keeps the ids of CACHE_WORDS words, those met first."""

    def __init__(self, v: Vocabulary):
        self.v, self.known = v, {}

    def words(self, text: str) -> list[str]:
        """Pre-tokens, in order; an added token of the vocabulary is one of its own."""
        find = (WORDS if NOT_LATIN.search(text) else LATIN_WORDS).findall
        if not self.v.split or not any(x in text for x in self.v.special):
            return find(text)
        return [w for x in self.v.split.split(text) for w in ([x] if x in self.v.special else find(x))]

    def learn(self, words: set[str]) -> None:
        by: dict[int, list[str]] = {}
        for w in words:
            if w in self.v.special:
                self.known[w] = np.int32(self.v.special[w]).tobytes()
                continue
            n = len(w.encode())
            if n == 1:
                self.known[w] = np.int32(self.v.first[ord(w)]).tobytes()
            elif n > WIDE:
                self.known[w] = merge_one(self.v, w.encode())
            else:
                by.setdefault(1 << (n - 1).bit_length(), []).append(w)
        for width, some in by.items():
            step = max(1, 400_000 // width)
            for k in range(0, len(some), step):
                part = some[k : k + step]
                self.known.update(zip(part, merge_rows(self.v, [w.encode() for w in part], width)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as packed int32; of an empty or null one none."""
        words = [self.words(t or "") for t in texts]
        self.learn(set().union(*words) - self.known.keys())
        get = self.known.__getitem__
        out = [b"".join(map(get, w)) for w in words]
        if len(self.known) > CACHE_WORDS:
            self.known = dict(islice(self.known.items(), CACHE_WORDS))
        return out


def id_lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def decoded(v: Vocabulary, ids: pa.ListArray) -> list[str | None]:
    """As the tokenizers library decodes: unknown ids give nothing, broken UTF-8 the replacement character."""
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    known = v.bytes.take(pa.array(np.where((flat >= 0) & (flat < len(v.bytes)), flat, len(v.bytes) - 1)))
    at = np.frombuffer(known.buffers()[1], np.int64)[known.offset :] if len(known) else np.zeros(1, np.int64)
    data = known.buffers()[2].to_pybytes() if len(known) and known.buffers()[2] else b""
    out, start = [], 0
    for n in pc.list_value_length(ids).to_pylist():
        out.append(None if n is None else data[at[start] : at[start + n]].decode("utf-8", "replace"))
        start += n or 0
    return out


def _apply(df: DataFrame, path: str, source: str, outs: dict[str, T.DataType], make) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path))  # of the file's size, about 2 MB
    keep = [c for c in df.columns if c not in outs]
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + [T.StructField(k, t) for k, t in outs.items()])

    is_text = isinstance(df.schema[source].dataType, T.StringType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Encoder(held.value)
        for b in pieces(batches, source) if is_text else batches:
            new = make(state, b.column(source))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *new], names=[*keep, *outs])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add `ids` (array<int>) of the whole `text`, without special tokens."""
    return _apply(df, path, text, {ids: T.ArrayType(T.IntegerType())}, lambda s, x: [id_lists(s.encode(x.to_pylist()))])


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add `text`, what `ids` stand for, special tokens included; null for null ids."""
    return _apply(df, path, ids, {text: T.StringType()}, lambda s, x: [pa.array(decoded(s.v, x), pa.string())])


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", back: str = "decoded") -> DataFrame:
    """Both in one pass: `ids` of `text`, and what those ids decode to."""

    def make(s: Encoder, x: pa.Array) -> list[pa.Array]:
        got = id_lists(s.encode(x.to_pylist()))
        return [got, pa.array(decoded(s.v, got), pa.string())]

    return _apply(df, path, text, {ids: T.ArrayType(T.IntegerType()), back: T.StringType()}, make)


def digest(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    done = round_trip(df.select(col(doc_id).alias("doc_id"), col(text).alias("text")), path)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
