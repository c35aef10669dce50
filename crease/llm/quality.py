"""Quality rules with host-level verdicts.

Method: failures of the rules are summed by host (here `source`), each host's rate is shrunk towards an
empirical beta prior (fitted by moments over the hosts, so small hosts say little), and the verdict is
joined back: on a host that is worse than hosts usually are (its posterior, but for a share of
1 - `credible`, lies more than the prior's deviation above the corpus rate) or whose shrunk rate exceeds
`host_rate`, a document that breaks a soft rule goes too. The bar thus follows the table: where hosts
differ by no more than chance the prior is narrow, posteriors hardly leave it, and no host stands out.
Documents that break no rule stay wherever they are from.

DataFrame functions only. Null texts count as empty (and fail the base rules); null hosts give no
evidence and get no verdict; empty tables give empty results; other columns are not read by `verdicts`.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.llm.common import SPACE, col, cut, fresh, join_heavy, let

#: Hosts up to which the verdicts are sent to every task; about 100 bytes each.
BROADCAST_HOSTS = 10_000
#: Share of a host's posterior that must lie above the bar.
CREDIBLE = 0.95


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of 3 words that occurs twice or more in `words`.

    Windows are found by sorting (31 bits of hash, position) as one long; those that agree there are then
    compared word by word. Time n log n, nothing is exploded.
    """
    windows = F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.shiftleft(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(i.cast("long")),
        )
    )

    def high(x: Column) -> Column:
        return F.shiftright(x, 32)

    alike = let(F.sort_array(windows), lambda s: F.filter(s, lambda x, i: (high(x) == high(F.get(s, i - 1))) | (high(x) == high(F.get(s, i + 1)))))
    grams = F.sort_array(F.transform(alike, lambda x: let(x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"), lambda p: F.struct(F.get(words, p).alias("a"), F.get(words, p + 1).alias("b"), F.get(words, p + 2).alias("c"), p.alias("p")))))

    def same(x: Column, y: Column) -> Column:
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    places = let(grams, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["p"])))
    covered = let(places, lambda q: F.aggregate(F.transform(q, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(q, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x))
    return covered.cast("long")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "soft_failed")


def _measured(docs: DataFrame, text: str) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with its measures, under names that no column of it has, and those names by measure."""
    words, lines, whole, n_lines, *names = fresh(docs, "words", "lines", "whole", "n_lines", *MEASURES)
    at = dict(zip(MEASURES, names))
    own = [col(c) for c in docs.columns]
    t = F.coalesce(col(text), F.lit(""))
    rows = docs.select(*own, t.alias(whole))
    rows = rows.select(*own, whole, F.array_remove(F.split(whole, SPACE), "").alias(words), F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(lines))
    rows = rows.select(
        *own,
        F.size(words).cast("long").alias(at["n_words"]),
        F.char_length(F.array_join(words, "")).cast("long").alias(at["word_chars"]),
        F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias(at["n_symbols"]),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(at["n_dup_lines"]),
        F.size(lines).alias(n_lines),
        repeated_words(F.col(words)).alias(at["n_repeat_words"]),
    )
    n, chars, symbols, dup, repeat = (F.col(at[x]) for x in MEASURES[:5])
    soft = (10 * symbols > n) | (10 * dup > 3 * F.col(n_lines)) | (chars < 2 * n) | (chars > 20 * n)
    base = (n < 50) | (100 * repeat > 50 * n)
    return rows.select(*own, *names[:5], base.alias(at["base_failed"]), soft.alias(at["soft_failed"])), at


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, soft_failed of each row."""
    rows, at = _measured(docs.select(col(doc_id).alias("doc_id"), col(host).alias("host"), col(text).alias("text")), "text")
    return rows.select("doc_id", "host", *(F.col(at[x]).alias(x) for x in MEASURES))


def host_rates(measured: DataFrame, credible: float = CREDIBLE) -> DataFrame:
    """host, n, failed, rate, worse: the share of documents that fail, shrunk by a beta prior fitted over all hosts.

    `worse`: at least `credible` of the host's posterior, taken as normal, lies above the corpus rate and one
    deviation of the prior.
    """
    hosts = measured.filter("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("base_failed") | F.col("soft_failed")).alias("failed"))
    raw = F.col("failed") / F.col("n")
    prior = hosts.agg((F.sum("failed") / F.sum("n")).alias("m"), F.coalesce(F.var_samp(raw), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n")).alias("inv")).first()
    m = min(max(prior["m"] or 0.0, 1e-6), 1 - 1e-6)
    spread = max((prior["v"] or 0.0) - m * (1 - m) * (prior["inv"] or 0.0), 1e-6)  # without what sampling adds
    strength = min(max(m * (1 - m) / spread - 1, 1.0), 1e4)
    rated = hosts.withColumn("rate", (F.col("failed") + m * strength) / (F.col("n") + strength))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + strength + 1))
    bar = m + (m * (1 - m) / (strength + 1)) ** 0.5
    return rated.withColumn("worse", F.col("rate") - NormalDist().inv_cdf(credible) * deviation > bar)


def _with_verdict(rows: DataFrame, rates: DataFrame, host_rate: float) -> DataFrame:
    """`rows` (with a column host) with `strict`: whether the host is worse than hosts usually are or its rate is above `host_rate`."""
    bad = cut(rates.filter(F.col("worse") | (F.col("rate") > host_rate)).select("host", "n", F.lit(True).alias("strict")))
    if bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        judged = rows.join(F.broadcast(bad.drop("n")), "host", "left")
    else:
        judged = join_heavy(rows, bad.drop("n"), "host", lambda: bad.select("host", "n"), rows.count(), "left")
    return judged.withColumn("strict", F.coalesce("strict", F.lit(False)))


def verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", host_rate: float = 0.5) -> DataFrame:
    """The measures of each row, and kept."""
    measured = cut(measures(docs, doc_id, text, host))  # small: no text; used twice
    judged = _with_verdict(measured, cut(host_rates(measured)), host_rate)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~(F.col("strict") & F.col("soft_failed"))).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", host_rate: float = 0.5) -> DataFrame:
    """`docs` without the rows that `verdicts` rejects; repeated rows stay as often as they come, all columns pass through.

    Rows are measured once and written with their flags (those that fail the base rules without their content), so
    that host verdicts reach them by a broadcast and no text is shuffled.
    """
    rows, at = _measured(docs, text)
    flags = [F.col(at[x]).alias(x) for x in ("base_failed", "soft_failed")]
    whole = F.when(~F.col(at["base_failed"]), F.struct(*(col(c) for c in docs.columns))).alias("row")
    measured = cut(rows.select(col(host).alias("host"), *flags, whole))
    judged = _with_verdict(measured, cut(host_rates(measured.drop("row"))), host_rate)
    return judged.filter(~F.col("base_failed") & ~(F.col("strict") & F.col("soft_failed"))).select("row.*")
