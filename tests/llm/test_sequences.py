"""Neighbours, conversations and periodic runs against plain versions that look at everything."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from crease.llm import dialogues, graph, periods
from crease.llm.queries import QUERIES


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# 11


def plain_nearest(rows, queries, k=5):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, []).append(np.array(v, np.float64))
    cos = lambda a, b: float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
    out = {}
    for i in queries:
        if i in ok:
            q = min(ok[i], key=tuple)
            near = sorted((-max(s), j) for j, vs in ok.items() if j != i and (s := [cos(q, v) for v in vs if len(v) == len(q)]))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def as_lists(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_neighbours_of_the_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = plain_nearest(rows, [i for i, _ in rows if i % 50 == 0])
    df = QUERIES["op11_neighbours"](spark, sf_dir)
    assert dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    got = as_lists(df)
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    hits = [len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 5 for i in want]
    assert sum(hits) / len(hits) >= 0.97
    score = {i: dict(plain_nearest(rows, [i], len(rows))[i]) for i in list(want)[:3]}
    assert all(math.isclose(s, score[i][j], rel_tol=1e-12) for i in score for j, s in got[i])


@pytest.mark.parametrize("spread", [1.0, 0.1])
def test_neighbours_over_shards_and_blocks(spark, spread):
    """Recall on even and on clustered vectors, with queries in several rounds; and copies by the hundred."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16))
    x = centres[r.integers(0, 12, 1500)] + spread * r.normal(size=(1500, 16))
    x[700:1000] = x[700]  # one row's copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    index = graph.index(df, shard_rows=400)
    assert index.count() == 4
    got = as_lists(graph.search(index, df.filter("vec_id % 20 = 0"), block=20, blocks=2))
    want = plain_nearest(rows, range(0, 1500, 20))
    assert got.keys() == want.keys()
    hits = [len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 5 for i in want]
    assert sum(hits) / len(hits) >= 0.97
    assert [j for j, _ in got[800]] == [700, 701, 702, 703, 704] and [j for j, _ in got[700]] == [701, 702, 703, 704, 705]


def test_neighbours_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 0.5]), (10, [1.0, 2.0, 3.0]), (11, [1e-200, 1e-200]), (12, [1e300, 0.0]), (13, [0.0, 1.0]), (13, [1.0, 0.1])]
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], "vec_id long, embedding array<double>, shard int, ids string, dim int")
    got = as_lists(graph.nearest(df, df))
    assert set(got) == {1, 2, 3, 11, 12, 13}  # 10 has no other of its length
    assert [j for j, _ in got[1]] == [2, 12, 13, 3, 11] and [j for j, _ in got[13]] == [3, 11, 1, 2, 12]
    assert got[1][0][1] == 1.0 and math.isclose(got[3][0][1], 1.0)
    none = df.limit(0)
    assert graph.nearest(none, none).count() == 0 and graph.nearest(df, none).count() == 0 and graph.nearest(df.filter("vec_id = 1"), df).filter("query_id = 1").count() == 0


def test_every_node_can_be_reached():
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges, entries = graph.build(x, degree=3, beam=4)
    seen, front = set(entries.tolist()), set(entries.tolist())
    while front:
        front = {int(j) for i in front for j in edges[i] if j >= 0} - seen
        seen |= front
    assert len(seen) == 600 and all(len(set(e[e >= 0])) == (e >= 0).sum() and i not in e for i, e in enumerate(edges))


def test_pruning_is_that_of_the_definition():
    r = np.random.default_rng(5)
    x = r.normal(size=(80, 6)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = np.arange(20)
    candidates = r.integers(-1, 80, (20, 40))
    got = graph.pruned(x, nodes, candidates, 6, 1.2)
    d = lambda a, b: float(np.sqrt(max(0.0, 2 - 2 * float(x[a] @ x[b]))))
    for i in range(20):
        left, want = sorted({int(c) for c in candidates[i]} - {-1, i}, key=lambda c: d(i, c)), []
        while left and len(want) < 6:
            want.append(left[0])
            left = [c for c in left[1:] if 1.2 * d(want[-1], c) > d(i, c)]
        assert [int(c) for c in got[i] if c >= 0] == want


# 12


def plain_repair(rows):
    """Fewest costs, then least audit, by relaxing (row, state) until nothing improves; rows: (turn, role, text) in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.strip("\t\n\x0b\x0c\r ")[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    best = {(0, ""): (0, "", ())}
    go = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    changed = True
    while changed:
        changed = False
        for (i, s), (cost, audit, out) in list(best.items()):
            steps = [((i, go[s]), 2, "I", ((name[go[s]], ""),))]
            if i < len(rows):
                _, role, text = rows[i]
                extra = faults[i] == "truncated"
                steps.append(((i + 1, s), 3, "D", ()))
                if faults[i] in ("", "truncated"):
                    steps.append(((i + 1, go[s]), 2 + extra, "R", ((name[go[s]], text),)))
                    if role[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[s] and role[:1]:
                        steps.append(((i + 1, role[:1]), extra, "K", ((role, text),)))
            for at, c, e, turns in steps:
                new = cost + c, audit + e, out + turns
                if at not in best or new[:2] < best[at][:2]:
                    best[at], changed = new, True
    cost, audit, out = min((best[k] for k in ((len(rows), ""), (len(rows), "a")) if k in best), key=lambda x: x[:2])
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out))


def plain_dialogues(rows, damage=True):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        role, text, k = said(role), said(text), zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20 if damage else 9
        kept = by[conv]
        if k:
            text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
            kept += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest())
    return sorted(((c, *plain_repair(sorted(x, key=order))) for c, x in by.items()), key=str)


TALK = "conv_id long, turn long, role string, text string, stays int, digest string, is_row int"


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0) for r in rows], TALK)


def test_dialogues_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = QUERIES["op12_dialogues"](spark, sf_dir)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_dialogues([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()])


@pytest.mark.parametrize("block", [256, 3])
def test_random_dialogues_whatever_the_blocks(spark, block, monkeypatch):
    r = random.Random(block)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "ux"], ["Hi.", "Yes!", "no", "a b", "", " \n", None, "Why?", "x.\n ", "é"]
    rows = [(r.randrange(150) if r.random() < 0.98 else None, r.choice([None, *range(9)]) if r.random() < 0.5 else k, r.choice(roles), r.choice(texts)) for k in range(1200)]
    monkeypatch.setattr(dialogues.Conversation.__init__, "__defaults__", (block,))
    for damage in (True, False):
        got = dialogues.digest(made(spark, rows), damage=damage)
        assert sorted(map(tuple, got.collect()), key=str) == plain_dialogues(rows, damage)


def test_search_over_blocks_is_that_over_the_whole():
    r = random.Random(4)
    for _ in range(300):
        rows = [(r.choice("suat") if r.random() < 0.9 else "", r.choice([0, 0, 0, 1, 2, 4])) for _ in range(r.randrange(1, 30))]
        whole = dialogues.search(rows, [(dialogues.START, 0)], True)[0]
        now = dialogues.Conversation(r.randrange(1, 7))
        for x in rows:
            now.add(1, *x)
        assert now.result()[-2:] == (whole[1], whole[3])


def test_long_and_odd_dialogues(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"t{t}.") for t in range(3000)] + [(2, 0, "user", "x" * 300_000), (3, None, None, None), (4, 5, "system", "Only."), (5, 1, "user", "Hi."), (5, 1, "user", "Hi.")]
    got = {r["conv_id"]: r for r in dialogues.digest(made(spark, rows)).collect()}
    r = got[1]
    assert (r["gaps"], r["truncated"], r["illegal"]) == (0, 0, 1000) and len(r["audit"].replace("I", "")) == 3000
    assert (got[2]["truncated"], got[2]["cost"], got[2]["audit"]) == (1, 3, "D")
    assert (got[3]["blank"], got[3]["audit"], got[3]["repaired_sha256"]) == (1, "D", sha(""))
    assert (got[4]["cost"], got[4]["audit"]) == (3, "D") and (got[5]["duplicate"], got[5]["audit"], got[5]["cost"]) == (1, "KDI", 5)
    assert dialogues.digest(made(spark, [])).count() == 0 and dialogues.repair(made(spark, [])).count() == 0


def test_repaired_turns_hash_to_the_digest_and_need_no_edit(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = defaultdict(list)
    again = dialogues.repair(df, damage=True)
    for r in again.collect():
        turns[r["conv_id"]].append((r["position"], r["role"], r["text"]))
    for r in dialogues.digest(df, damage=True).collect():
        mine = sorted(turns[r["conv_id"]])
        assert [p for p, _, _ in mine] == list(range(len(mine)))
        assert sha("\n".join(f"{a}:{b}" for _, a, b in mine)) == r["repaired_sha256"]
    assert dialogues.audits(again, turn="position").filter("illegal > 0 or gaps > 0").count() == 0


# 13


def plain_runs(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((a, b - a, p) for (a, b), p in found.items())


def plain_periods(rows, damage=True):
    out = []
    for i, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(i).encode())
        if damage and i is not None and h % 10 == 0 and n:
            a, g = (h // 10) % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(words)
        gone = {k for s, length, p in runs for k in range(s + p, s + length)}
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        out.append((i, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    return sorted(out, key=str)


def short(df):
    return [(r["doc_id"], r["text"]) for r in df.collect() if not r["text"] or len(r["text"]) < 9000]


@pytest.mark.parametrize("which", ["docs", "edge", "empty"])
def test_periods_as_the_plain_loop(which, request):
    df = request.getfixturevalue(which)
    some = df.filter("text is null or length(text) < 9000")
    got = periods.digest(some, damage=True)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_periods(short(df))
    assert periods.digest(df, damage=True).count() == df.count()


def test_runs_of_random_words():
    r, n = random.Random(2), 0
    for _ in range(1500):
        letters = r.randrange(1, 5)
        words = [r.randrange(letters) for _ in range(r.randrange(0, 80))]
        if words and r.random() < 0.6:
            words = [w[0] for w in periods.damaged([bytes([x]) for x in words], r.randrange(10**6))]
        want = plain_runs(words)
        n += len(want)
        assert periods.runs_of(np.array(words, np.int64)) == want
    assert n > 500


def test_the_mask_keeps_every_run_and_skips_the_rest():
    assert periods.overlap(12) == 6
    r = random.Random(6)
    words = [r.randrange(10**6) for _ in range(5000)]
    words[1000:1000] = [1, 2, 3] * 5
    words[3000:3000] = list(range(7, 20)) * 2
    kept = periods.segments(np.array(words, np.int64))
    assert [(a, b) for a, b in kept] == [(1000, 1015), (3000, 3026)]


def test_collapse_and_spans(spark, edge):
    rows = [(1, "a b c " * 6 + "end"), (2, "no  run here"), (3, None), (4, "x " * 12), (4, "x " * 11)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, collapsed string")
    assert sorted((r["doc_id"], r["text"], r["collapsed"]) for r in periods.collapse(df).collect() if r["text"]) == [(1, "a b c end", "c"), (2, "no  run here", "c"), (4, "x", "c"), (4, "x " * 11, "c")]
    assert sorted(map(tuple, periods.runs(df).collect())) == [(1, 0, 18, 3), (4, 0, 12, 1)]
    assert periods.collapse(edge).count() == edge.count() and periods.collapse(edge).columns == edge.columns


def test_a_long_text_of_one_word_and_a_long_period():
    assert periods.runs_of(np.zeros(30_000, np.int64)) == [(0, 30_000, 1)]
    x = np.random.default_rng(1).integers(0, 10**9, 10_000)
    assert periods.runs_of(np.r_[x, x, x[:5000]]) == [(0, 25_000, 10_000)]
