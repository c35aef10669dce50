"""Language identification by word-first backoff.

A word that training saw is scored by its log frequency in each language; an unseen word falls back to
character n-grams, of five letters down to one: the longest length of which any n-gram is known decides.
A document's language is the one with the greatest sum over its words.

The model is fitted on a bounded sample of labelled rows: about `sample` documents of each label, picked
by a hash of doc_id (which decides membership only). Counts are made by Spark; all words and n-grams of
the sample are kept, none is cut off. Every text is scored whole.

Texts without a letter and null texts are `und` with score 0. With no labelled rows everything is `und`.
Null labels are not learned from. Repeated rows give repeated results; empty tables give empty results;
other columns are not read. Ids may be of any type.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice
from itertools import count as count_from

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crease.llm.common import col, cut, pieces

WORD = re.compile(r"[^\W\d_]+")
GRAM = 5
#: Labelled documents of each language that the model learns from.
SAMPLE = 1000
CACHE_WORDS = 200_000
#: Marks the beginning and end of a word in its n-grams.
EDGE = "\x02"


def lettered(words: list[str]) -> list[str]:
    """`words` without those of no letter, such as a superscript or a fraction."""
    return words if all(map(str.isalpha, words)) else [w for w in words if any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    w = f"{EDGE}{word}{EDGE}"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def fit(rows: DataFrame, sample: int = SAMPLE) -> dict:
    """Languages and log frequencies from rows (doc_id, text, lang); what reaches the driver is bounded by `sample`."""
    rows = rows.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {"langs": [], "tables": {}, "rows": np.zeros((0, 0), np.float32)}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, sample / n) * (1 << 30)))])
    picked = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            seen: dict[tuple[str, int, str], int] = {}
            words: dict[tuple[str, str], int] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                for w in lettered(WORD.findall(text.lower())):
                    words[lang, w] = words.get((lang, w), 0) + 1
            for (lang, w), n in words.items():
                seen[lang, 0, w] = n
                for k in range(1, GRAM + 1):
                    for g in grams(w, k):
                        seen[lang, k, g] = seen.get((lang, k, g), 0) + n
            lang, k, g = zip(*seen) if seen else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(k, pa.int32()), pa.array(g, pa.string()), pa.array(seen.values(), pa.int64())], names=["lang", "k", "gram", "n"])

    counts = picked.mapInArrow(count, "lang string, k int, gram string, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    langs = sorted(sizes)
    at = {x: i for i, x in enumerate(langs)}
    got = cut(counts).toArrow()  # one piece of memory, not a row object each
    lang, k, gram = (got.column(c).combine_chunks() for c in ("lang", "k", "gram"))
    lang = np.array([at[x] for x in pc.unique(lang).to_pylist()], np.int64)[lang.dictionary_encode().indices.to_numpy()] if len(gram) else np.zeros(0, np.int64)
    k, n = k.to_numpy(), got.column("n").to_numpy()
    totals = np.zeros((GRAM + 1, len(langs)))
    np.add.at(totals, (k, lang), n)
    tables: dict[int, dict[str, int]] = {x: {} for x in range(GRAM + 1)}
    places = np.empty(len(gram), np.int64)
    number = count_from(0)
    for i, (x, g) in enumerate(zip(k.tolist(), gram.to_pylist())):
        table = tables[x]
        places[i] = table[g] if g in table else table.setdefault(g, next(number))
    freq = np.zeros((next(number), len(langs)))
    freq[places, lang] = n
    length = np.zeros(len(freq), np.int64)
    length[places] = k
    return {"langs": langs, "tables": tables, "rows": np.log((freq + 0.1) / (np.maximum(totals, 1)[length] + 1)).astype(np.float32)}


class Scorer:
    """`tables`: of each length the row in `rows` of a gram (a word at 0); `rows`: its log frequency by language."""

    def __init__(self, model: dict):
        self.langs, self.tables, self.known = model["langs"], model["tables"], model["rows"]
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.langs)), np.float32)

    def of(self, w: str) -> list[int]:
        """The rows whose mean is the word's score."""
        if (x := self.tables[0].get(w)) is not None:
            return [x]
        for k in range(min(GRAM, len(w) + 2), 0, -1):
            found = [x for x in map(self.tables[k].get, grams(w, k)) if x is not None]
            if found:
                return found
        return []

    def score(self, words: list[str]) -> np.ndarray:
        lists = [self.of(w) for w in words]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        out = np.zeros((len(words), len(self.langs)), np.float32)
        if some := int(sizes.sum()):
            picked = self.known[np.fromiter(chain.from_iterable(lists), np.int64, some)]
            has = sizes > 0
            out[has] = np.add.reduceat(picked, np.concatenate([[0], np.cumsum(sizes[has])[:-1]]), axis=0) / sizes[has, None]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = [lettered(WORD.findall(t.lower())) if t else [] for t in texts]
        new = list(set().union(*words) - self.index.keys())
        if new:
            start = len(self.rows)
            self.index.update(zip(new, range(start, start + len(new))))
            self.rows = np.concatenate([self.rows, self.score(new)])
        counts = np.array([len(w) for w in words])
        flat = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.rows[flat], axis=0, dtype=np.float64)])
        ends = np.cumsum(counts)
        total = sums[ends] - sums[ends - counts]
        if len(self.index) > CACHE_WORDS:
            self.index = dict(islice(self.index.items(), CACHE_WORDS))
            self.rows = self.rows[:CACHE_WORDS]
        out = []
        for n, s in zip(counts.tolist(), total):
            if not n or not self.langs:
                out.append(("und", 0.0))
                continue
            best = int(np.argmax(s))
            out.append((self.langs[best], float(1 / np.exp(np.minimum(s - s[best], 0)).sum())))
        return out


def predict(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the share of the best language in the posterior) of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit's parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in pieces(batches, "text"):
            got = scorer.predict(b.column("text").to_pylist()) if scorer.langs else [("und", 0.0)] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id) -> "F.Column":
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows with a label that aren't held out. A null doc_id is held out."""
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"), col(lang).alias("lang"))
    model = fit(rows.filter(~held_out(F.col("doc_id"))), **options)
    return predict(rows, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(True)).alias("held_out"), "lang_pred", "score")
