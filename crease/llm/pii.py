"""Personal data with information-theoretic sanitisation.

Base: e-mail addresses, IP addresses, card numbers and phone numbers by pattern and checks. Method: the
corpus tells how strongly a term (a word outside all findings) reveals a protected entity. Entities are
taken at three grains: the kind of a finding, the group it belongs to (an e-mail's domain, an address's
network, a card's issuer, a phone's area) and its value, written one way. A term meets a kind where both
stand in a document, a group or value where it stands within `window` words of it. With n different texts of
the term, m of them with the entity, and p(e) the entity's share of all texts, p(e|t) is taken at the lower
end of Wilson's interval for m of n, as wide as keeps the chance of one error among all pairs that are tested
(those that meet in `support` texts) at `error`: words that meet an entity a few times by chance don't count
for much. The mutual information log p(e|t) / p(e) is compared to the entity's information content
-log p(e), which it can't exceed. A term whose ratio reaches `disclosure` gives the entity away and is
reported (kind `term`) wherever it stands outside the base's findings, to be generalised or removed.
Copies of a text are one piece of evidence: each of c copies counts 1/c.

All counts cover all documents and are made in one pass, after one over the texts' digests that finds copies. Terms that disclose are sent to every task up to
BROADCAST_TERMS; more are joined with all places of words. Null texts count as empty; repeated rows count
and are returned as often as they come; empty tables give empty results. `find` reads no other columns,
`sanitise` passes them all through, whatever their names. Ids may be of any type.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import partial
from statistics import NormalDist

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crease.llm.common import col, cut, fresh, join_heavy, pieces

#: The base patterns, by kind, in order.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
TERM = re.compile(r"[^\W\d_]{3,}")
DIGITS = re.compile(r"[0-9]")
WINDOW, SUPPORT, DISCLOSURE, ERROR = 3, 3, 0.9, 0.05
#: Counts that a task holds before it hands them on.
HELD = 300_000
#: Texts that have copies up to which their digests are sent to every task; about 60 bytes each.
BROADCAST_COPIES = 500_000
#: Disclosing terms up to which they are sent to every task; 8 bytes each, about 100 in a task's set.
BROADCAST_TERMS = 200_000


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    out = []
    if "@" in text:
        out += [(*m.span(), "email") for m in EMAIL.finditer(text)]
    if DIGITS.search(text):
        out += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(DIGITS.findall(m.group())) <= 15]
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (x[0], rank[x[2]]))


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def term_hash(word: str) -> int:
    return _hash(word.lower())


def free_words(text: str, spans) -> list[tuple[int, int]]:
    """The places of all words that no finding touches; `spans` by start."""
    out, k, reach = [], 0, 0
    for m in TERM.finditer(text):
        a, b = m.span()
        while k < len(spans) and spans[k][0] < b:
            reach = max(reach, spans[k][1])
            k += 1
        if a >= reach:
            out.append((a, b))
    return out


def neighbours(words: list[tuple[int, int]], start: int, end: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Up to `window` of the `words` before and after, however far away."""
    left, right = bisect_right(words, start, key=lambda x: x[1]), bisect_left(words, end, key=lambda x: x[0])
    return words[max(0, left - window) : left] + words[right : right + window]


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode()) - (1 << 63)


#: Stands for every document where an entity is named, and for every word where a term is.
ALL = 0
KIND_IDS = {k: _hash(f"kind {k}") for k in KINDS}


def entities(kind: str, value: str) -> tuple[str, str]:
    """The group and the value of a finding, each written one way."""
    if kind == "email":
        value = value.lower()
        group = value.rpartition("@")[2]
    elif kind == "ip":
        parts = [str(int(x[-4:])) for x in value.split(".")]
        value, group = ".".join(parts), ".".join(parts[:2])
    else:
        value = "".join(DIGITS.findall(value))
        group = value[: 6 if kind == "card" else 4]
    return f"{kind} group {group}", f"{kind} value {value}"


def _weighted(docs: DataFrame, text: str) -> DataFrame:
    """text and weight: 1 / c for each of c equal texts, null for a text that is there once."""
    rows = docs.select(F.coalesce(col(text), F.lit("")).alias("text")).select("text", F.md5(F.col("text").cast("binary")).alias("digest"))
    copies = cut(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    side = copies.select("digest", (1 / F.col("n")).alias("weight"))
    if copies.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES:
        joined = rows.join(F.broadcast(side), "digest", "left")
    else:
        joined = join_heavy(rows, side, "digest", lambda: copies, rows.count(), "left")
    return joined.select("text", "weight")


def _counts(docs: DataFrame, text: str, window: int) -> DataFrame:
    """entity, term, n: in how many different texts they meet; with ALL, in how many one of them stands, or how many there are.

    One pass; what a task has counted is handed on before it grows beyond HELD entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()  # by word, for all documents and for those of each kind
        by_kind: dict[str, Counter] = {k: Counter() for k in KINDS}
        pairs: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = [(ALL, term_hash(w), n) for w, n in words.items()]
            rows += [(KIND_IDS[k], term_hash(w), n) for k, c in by_kind.items() for w, n in c.items()]
            rows += [(e, t, n) for (e, t), n in pairs.items()]
            for c in (words, pairs, *by_kind.values()):
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.float64()) for i in range(3)], names=["entity", "term", "n"])

        for b in pieces(batches, "text"):
            for t, weight in zip(b.column("text").to_pylist(), b.column("weight").to_pylist()):
                add = _plain if weight is None else partial(_part, weight)
                pairs[ALL, ALL] += weight or 1
                if not t:
                    continue
                spans = base_spans(t)
                if not spans:
                    add(words, {w.lower() for w in set(TERM.findall(t))})
                    continue
                free = free_words(t, spans)
                here = {t[x:y].lower() for x, y in free}
                add(words, here)
                met = set()
                for k in {k for _, _, k in spans}:
                    add(by_kind[k], here)
                    met.add((KIND_IDS[k], ALL))
                for a, z, k in spans:
                    near = [term_hash(t[x:y]) for x, y in neighbours(free, a, z, window)]
                    for e in map(_hash, entities(k, t[a:z])):
                        met.add((e, ALL))
                        met.update((e, w) for w in near)
                add(pairs, met)
            if len(words) + len(pairs) + sum(map(len, by_kind.values())) > HELD:
                yield out()
        yield out()

    counted = _weighted(docs, text).mapInArrow(run, "entity long, term long, n double")
    return counted.groupBy("entity", "term").agg(F.round(F.sum("n"), 6).alias("n"))


def _plain(counter: Counter, keys: set) -> None:
    counter.update(keys)


def _part(weight: float, counter: Counter, keys: set) -> None:
    for k in keys:
        counter[k] += weight


def disclosing(docs: DataFrame, text: str = "text", window: int = WINDOW, support: int = SUPPORT, disclosure: float = DISCLOSURE, error: float = ERROR) -> DataFrame:
    """entity, term, ratio of the pairs whose mutual information reaches the threshold."""
    counts = cut(_counts(docs, text, window))
    total = float(max((counts.filter(f"entity = {ALL} AND term = {ALL}").first() or {"n": 0})["n"], 2))
    often = counts.filter((F.col("entity") != ALL) & (F.col("term") != ALL) & (F.col("n") >= support)).withColumnRenamed("n", "both")
    often = cut(often)
    size = often.count()
    known = counts.filter(f"entity <> {ALL} AND term = {ALL}").select("entity", F.col("n").alias("n_entity"))
    terms = counts.filter(f"entity = {ALL} AND term <> {ALL}").select("term", F.col("n").alias("n_term"))
    paired = join_heavy(often, known, "entity", lambda: often.groupBy("entity").agg(F.count(F.lit(1)).alias("n")), size)
    paired = join_heavy(paired, terms, "term", lambda: often.groupBy("term").agg(F.count(F.lit(1)).alias("n")), size)
    share, n = F.col("n_entity") / total, F.col("n_term")
    z2 = NormalDist().inv_cdf(1 - error / max(size, 1)) ** 2
    p = F.least(F.col("both") / n, F.lit(1.0))
    least = (p + z2 / (2 * n) - F.sqrt(z2 * p * (1 - p) / n + z2 * z2 / (4 * n * n))) / (1 + z2 / n)
    ratio = F.log(F.greatest(least, F.lit(1e-300)) / share) / -F.log(share)
    return paired.filter(F.col("n_entity") < total).select("entity", "term", ratio.alias("ratio")).filter(F.col("ratio") >= disclosure)


def _teller(known: list[int]):
    """Whether a word is one of the terms `known`; remembers the words it met last."""
    wanted, seen = frozenset(known), {}

    def told(word: str) -> bool:
        if (hit := seen.get(word)) is None:
            if len(seen) >= 150_000:
                seen.clear()
            hit = seen[word] = term_hash(word) in wanted
        return hit

    return told if wanted else None


def _term_spans(text: str, spans, told) -> list[tuple[int, int, str]]:
    if told is None or not any(map(told, set(TERM.findall(text)))):
        return []
    return [(x, y, "term") for x, y in free_words(text, spans) if told(text[x:y])]


def _decided(docs: DataFrame, text: str, options: dict) -> tuple[DataFrame, list[int] | None]:
    """The disclosing terms as a table, and as a list if they are few enough for every task."""
    decided = cut(disclosing(docs, text, **options).select("term").distinct())
    few = decided.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    return decided, [r["term"] for r in decided.collect()] if few else None


def _places(rows: DataFrame, text: str, row: str, decided: DataFrame) -> DataFrame:
    """row, terms (array of start, end): where the terms `decided` stand in `rows`, by a join over all places of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            out = [(r, term_hash(t[x:y]), x, y) for r, t in zip(b.column("row").to_pylist(), b.column("text").to_pylist()) if t for x, y in free_words(t, base_spans(t))]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["row", "term", "start", "end"])

    every = rows.select(F.col(row).alias("row"), col(text).alias("text")).mapInArrow(run, "row long, term long, start int, end int")
    return every.join(decided, "term").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("terms"))


def _numbered(docs: DataFrame, decided: DataFrame, text: str) -> tuple[DataFrame, str]:
    """`docs`, written with a number for each row, joined with the places of their terms in the column named."""
    row, terms = fresh(docs, "__row", "__terms")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))  # the numbers stay as written
    places = _places(rows, text, row, decided).select(F.col("row").alias(row), F.col("terms").alias(terms))
    return rows.join(places, row, "left").drop(row), terms


def _all_spans(text: str, told, places) -> tuple[list, list]:
    """The base's findings, and the terms'."""
    spans = base_spans(text)
    return spans, [(p["start"], p["end"], "term") for p in places] if places is not None else _term_spans(text, spans, told)


def _apply(docs: DataFrame, text: str, options: dict, make, keep: list[str], outs: list[tuple[str, pa.DataType, T.DataType]]) -> DataFrame:
    """Columns `keep` of `docs` and what `make(text, base spans, term spans)` gives for each row."""
    decided, known = _decided(docs, text, options)
    rows, terms = (docs, None) if known is not None else _numbered(docs, decided, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = _teller(known or [])
        for b in pieces(batches, text):
            places = b.column(terms).to_pylist() if terms else [None] * b.num_rows
            made = [make(t, *_all_spans(t or "", told, p if p is not None or not terms else [])) for t, p in zip(b.column(text).to_pylist(), places)]
            new = {name: pa.array([m[i] for m in made], kind) for i, (name, kind, _) in enumerate(outs)}
            names = [*keep, *(n for n in new if n not in keep)]
            yield pa.RecordBatch.from_arrays([new[c] if c in new else b.column(c) for c in names], names=names)

    own = [f for f in docs.schema.fields if f.name in keep]
    fields = [*own, *(T.StructField(n, d) for n, _, d in outs if n not in keep)]
    return rows.mapInArrow(run, T.StructType(fields))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row; `options` as of `disclosing`."""
    rank = {k: i for i, k in enumerate((*KINDS, "term"))}

    def make(_, base, terms):
        n = Counter(k for _, _, k in base)
        spans = sorted(base + terms, key=lambda x: (x[0], rank[x[2]])) if terms else base
        return (*(n[k] for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans))

    outs = [(f"n_{k}", pa.int64(), T.LongType()) for k in KINDS] + [("base_sha256", pa.string(), T.StringType()), ("spans", pa.string(), T.StringType())]
    return _apply(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")), "text", options, make, ["doc_id"], outs)


def cleaned(text: str, spans) -> str:
    """`text` with each finding generalised to its kind and terms removed; overlapping ones are one, of all their kinds."""
    parts, at, k = [], 0, 0
    spans = sorted(spans)
    while k < len(spans):
        start, end, kinds = spans[k][0], spans[k][1], [spans[k][2]]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][1])
            kinds.append(spans[k][2])
            k += 1
        named = [x for x in dict.fromkeys(kinds) if x != "term"]
        parts += [text[at:start], f"<{'+'.join(named)}>" if named else ""]
        at = end
    return "".join([*parts, text[at:]])


def sanitise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """`docs` with findings generalised to their kind (`<email>`) and disclosing terms removed, row by row: no id is needed. Null texts stay null."""

    def make(t, base, terms):
        return (None if t is None else cleaned(t, base + terms) if base or terms else t,)

    return _apply(docs, text, options, make, docs.columns, [(text, pa.string(), T.StringType())])
