"""Secret scans with multipart credential linking.

Base: strong findings of three kinds (assign, access, hex), reported wherever they stand. Method: weak
parts - login names or short access identifiers, short secrets, endpoints - are joined by interval within
a document: a weak identifier or secret is reported only if its complement (weak or strong) lies within
`scope` code points, an endpoint only if both do. The join is a sweep over the parts in order of their
start, forwards and backwards, so its cost follows the number of parts, and no pairs are made.

DataFrame functions only. Null texts count as empty; a text without parts gives empty results; repeated
rows give repeated results; other columns pass through `find` and `mask`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.llm.common import before, col, fresh, let, regex_spans

SCOPE = 200
#: Code points of the pieces in which a text is masked.
PIECE = 4096

#: The base kinds in order, with their patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
BASE = ("assign", "access", "hex")

#: Where a name may begin: not within a run of letters and digits, so after _ and - too (DB_USER), and at a capital (dbUser).
NAME = r"(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))"
#: Weak parts. Group 2 of the first and third holds the value. The names that the base looks for begin anywhere, as there.
USER = NAME + r"""((?i:user|user_?name|user_?id|login|client_?id|account|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
SHORT_ACCESS = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{6,13}(?![A-Z0-9])"
SHORT_SECRET = r"((?i:password|passwd|secret|token|api_?key)|" + NAME + r"""(?i:pass|pwd|secret_?(?:access_?)?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{4,})"""
SCHEME = r"(?<![A-Za-z0-9])(?i:(?:jdbc:)?[a-z][a-z0-9+.-]{1,20}://|jdbc:[a-z]{2,12}:[a-z0-9]{2,12}:@(?://)?)"
ENDPOINT = f"(?:{SCHEME}|{NAME}" + r"""(?i:host|hostname|endpoint|server)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9][A-Za-z0-9._:/-]{2,}"""
#: What every part but hex contains: one search decides whether the rest is looked for.
HINT = r"(?i:user|login|client_?id|account|access|pass|pwd|secret|token|api_?key|akia|://|jdbc:|host|endpoint|server)"

SPANS = "array<struct<start:int,end:int,kind:string>>"
#: Which complement each kind offers (i, s or e).
PART = {"assign": "s", "access": "i", "hex": "s", "id": "i", "key": "s", "endpoint": "e"}


def _none() -> Column:
    return F.array().cast(SPANS)


def base_spans(text: Column, hint: Column) -> Column:
    """The strong findings, by start, then in the order of BASE; array<struct<start,end,kind>>."""
    some = F.when(hint, F.concat(regex_spans(text, ASSIGN, "assign", lambda v: F.char_length(v) >= 12, 2), regex_spans(text, ACCESS, "access"))).otherwise(_none())
    return F.concat(some, regex_spans(text, HEX, "hex"))


def weak_spans(text: Column, hint: Column) -> Column:
    parts = F.concat(
        regex_spans(text, USER, "id"), regex_spans(text, SHORT_ACCESS, "id"), regex_spans(text, SHORT_SECRET, "key"), regex_spans(text, ENDPOINT, "endpoint")
    )
    return F.when(hint, parts).otherwise(_none())


def _role(x: Column) -> Column:
    return F.when(x["kind"].isin([k for k, r in PART.items() if r == "i"]), "i").when(x["kind"] == "endpoint", "e").otherwise("s")


def linked(strong: Column, weak: Column, scope: int = SCOPE) -> Column:
    """Those of `weak` that have their complement within `scope`, by start.

    Sweeping once each way, a part knows the nearest end (start) of an identifier and of a secret before
    (after) it.
    """
    far = 1 << 30

    # A weak secret that lies in a strong finding is the same one. In order of start, the longer first and a strong
    # one before a weak one, it lies in one exactly if some strong one before it ends no sooner.
    def keyed(spans: Column, is_weak: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), F.lit(is_weak).alias("weak"), x["kind"].alias("kind")))

    def fresh(k: Column) -> Column:
        reach = before(F.transform(k, lambda x: F.when(x["weak"] == 0, -x["back"]).otherwise(-1)), -1, F.greatest)
        own = let(reach, lambda r: F.filter(k, lambda x, i: (x["weak"] == 0) | (F.get(r, i) < -x["back"])))
        return F.transform(own, lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["kind"].alias("kind")))

    parts = F.array_sort(let(F.array_sort(F.concat(keyed(strong, 0), keyed(weak, 1))), fresh))

    def sweep(ordered: Column, gap) -> Column:
        def ends(role: str) -> Column:
            return before(F.transform(ordered, lambda x: F.when(_role(x) == role, gap(x)[1]).otherwise(-far)), -far, F.greatest)

        near = lambda last: F.transform(ordered, lambda x, k: gap(x)[0] - F.get(last, k) <= scope)
        return F.arrays_zip(let(ends("i"), near).alias("i"), let(ends("s"), near).alias("s"))

    def join(p: Column) -> Column:
        before = sweep(p, lambda x: (x["start"], x["end"]))
        after = F.reverse(sweep(F.reverse(p), lambda x: (-x["end"], -x["start"])))
        rows = F.arrays_zip(p.alias("p"), before.alias("b"), after.alias("a"))

        def told(x: Column) -> Column:
            i, s = x["b"]["i"] | x["a"]["i"], x["b"]["s"] | x["a"]["s"]
            return x["p"]["kind"].isin("id", "key", "endpoint") & F.when(x["p"]["kind"] == "id", s).when(x["p"]["kind"] == "key", i).otherwise(i & s)

        return F.transform(F.filter(rows, told), lambda x: x["p"])

    return F.when(F.size(weak) == 0, _none()).otherwise(let(parts, join))


def in_order(spans: Column, kinds: tuple[str, ...] = (*BASE, "id", "key", "endpoint")) -> Column:
    """By start, then by kind as listed."""
    rank = F.create_map(*[F.lit(x) for k, v in enumerate(kinds) for x in (v, k)])
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def find(docs: DataFrame, text: str = "text", scope: int = SCOPE, base: str = "base", spans: str = "spans") -> DataFrame:
    """`docs` with columns `base` and `spans` (all findings): arrays of struct<start,end,kind> in code points; columns of these names are replaced."""
    t = F.coalesce(col(text), F.lit(""))
    hint, weak = fresh(docs, "__hint", "__weak")
    found = docs.withColumn(hint, t.rlike(HINT))
    found = found.withColumns({base: base_spans(t, F.col(hint)), weak: weak_spans(t, F.col(hint))})
    found = found.withColumn(base, F.when(F.size(base) == 0, F.col(base)).otherwise(in_order(F.col(base))))
    found = found.withColumn(spans, F.when(F.size(weak) == 0, F.col(base)).otherwise(in_order(F.concat(base, linked(F.col(base), F.col(weak), scope)))))
    return found.drop(weak, hint)


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    found = find(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")), scope=scope)

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def mask(docs: DataFrame, text: str = "text", mark: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """`docs` with every finding in `text` replaced by `mark`; touching or overlapping ones by one mark. Nulls stay."""
    base, spans = fresh(docs, "__base", "__spans")
    found = find(docs, text, scope, base, spans)
    t = col(text)

    def between(pieces: Column, start: Column, n: Column) -> Column:
        """`n` code points from `start` on; only the pieces they lie in are looked at."""
        first = F.floor(start / PIECE).cast("int")
        return F.substring(F.array_join(F.slice(pieces, first + 1, F.floor((start + n) / PIECE).cast("int") - first + 1), ""), F.pmod(start, F.lit(PIECE)) + 1, n)

    def texts(pieces: Column, at: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            done = F.get(at, k)
            return F.when((x["start"] > done) | (k == 0), F.array(between(pieces, done, x["start"] - done), F.lit(mark))).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(spans, one))

    pieces = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    last = F.array_max(F.transform(spans, lambda x: x["end"]))
    head = let(pieces, lambda p: let(before(F.transform(spans, lambda x: x["end"]), 0, F.greatest), lambda at: texts(p, at)))
    masked = F.concat(F.array_join(head, ""), F.substring(t, last + 1, F.char_length(t)))
    out = found.withColumn(text, F.when(t.isNull() | (F.size(spans) == 0), t).otherwise(masked))
    return out.drop(base, spans)
