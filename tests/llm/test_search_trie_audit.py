"""Nearest neighbours, prefix tries and source divergences against brute force."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlake.llm import ann, divergence, queries, trie

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def brute_nearest(rows, is_query, k):
    sound = [(i, v) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    asks = {}
    for i, v in sound:
        if is_query(i):
            asks[i] = min(asks.get(i, v), v)
    out = []
    for q, v in asks.items():
        near = sorted((math.dist(v, w), i) for i, w in sound if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return sorted(out)


def close(got, want):
    got = sorted(map(tuple, got))
    return [r[:3] for r in got] == [r[:3] for r in want] and all(math.isclose(a[3], b[3], rel_tol=1e-12, abs_tol=1e-300) for a, b in zip(got, want, strict=True))


def test_nearest_on_awkward_rows(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(1, 40)]
    rows += [(100, [1.0, 1.0, 1.0]), (100, [2.0, 2.0, 1.0]), (100, [1.0, 1.0, 1.0])]  # an id of several vectors, one of them twice
    rows += [(110, None), (120, [0.0, 0.0, 0.0]), (130, [float("nan"), 1.0, 1.0]), (140, [1.0, None, 2.0]), (None, [1.0, 1.0, 1.0]), (150, [float("inf"), 0.0, 1.0]), (160, [])]
    rows += [(170, [1e200, -1e200, 1e-200]), (180, [3e200, 1e200, 0.0]), (190, [1e-170, 2e-170, 0.0]), (200, [1e-170, 0.0, 0.0])]
    rows += [(10, [1.0, 5.0]), (20, [1.0, 4.0]), (300, [4.0])]  # other lengths
    frame = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "vec_id long, embedding array<double>, node string, score double")
    got = ann.nearest(frame, F.col("vec_id") % 10 == 0, k=4, recall=1.0).collect()
    assert close(got, brute_nearest(rows, lambda i: i % 10 == 0, 4))
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert ann.nearest(frame, F.col("vec_id") < 0).count() == 0


def test_nearest_recall_among_hot_and_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24))
    x = (centres[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 24))).astype(np.float32)
    x[1000:2000] = x[1000]  # a third of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(frame, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append(r)
    d = np.sqrt(((x[::50, None].astype(float) - x[None].astype(float)) ** 2).sum(2))
    hits = 0
    for q, row in zip(range(0, 3000, 50), d, strict=True):
        row[q] = np.inf
        want = np.lexsort((np.arange(3000), row))[:10]
        own = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        assert all(math.isclose(r.score, row[r.vec_id], rel_tol=1e-12, abs_tol=1e-12) for r in own)
        hits += len(set(want.tolist()) & {r.vec_id for r in own})
    assert hits >= 0.95 * 600


@pytest.mark.parametrize(("parts", "radius"), [(2, 5), (5, 9), (8, 27), (16, 3)])
def test_pigeonhole_retrieves_every_code_within_the_radius(parts, radius):
    rng, tables = np.random.default_rng(parts), ann.substrings(parts, radius)
    assert sum(w for _, w, _ in tables) == 64
    for _ in range(500):
        flips = rng.choice(64, rng.integers(0, radius + 1), replace=False)
        assert any(sum(s <= i < s + w for i in flips) <= f for s, w, f in tables)
    for width, flips in ((5, 2), (4, 9), (3, 0), (3, -1)):
        assert sorted(ann.masks(width, flips).tolist()) == [m for m in range(1 << width) if m.bit_count() <= flips]


def brute_trie(rows):
    """rows: conv_id -> [(role, text)]"""
    members, below = defaultdict(list), defaultdict(set)
    for c, turns in rows.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].add(p)
    child = Counter(p[:-1] for p in members if p)
    out = []
    for p, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(rows[c]) == len(p)))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below[p] if x)
        leaves = sum(not child[x] for x in below[p])
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), child[p], leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_rebuilt(table):
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in table if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        own[c].append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}


def test_prefix_trie_on_awkward_conversations(spark):
    say = [("u", "hi"), ("a", "hello"), ("u", ""), ("a", "ñandú 日本")]
    table = [(c, t, *say[(c * t + t // 2) % 4]) for c in range(1, 60) for t in range(c % 13)]
    table += [(100 + c, t, "u", f"turn {t}") for c in range(60) for t in range(c % 30)]  # chains of ends
    table += [(c, t, "same", "x" * t) for c in range(200, 260) for t in range(12)]  # one whole conversation
    table += [(300, None, None, None), (300, 0, "u", None), (None, 1, "u", "lost"), (303, 1, "u", "no base"), (304, 2, "a", "short"), (305, 5, "a:", "b"), (306, 5, "a", ":b")]
    table += [(400, t, "u", str(t)) for t in range(700)] + [(401, t, "u", str(t)) for t in range(500)]
    frame = spark.createDataFrame([(*r, 0.5, "clash") for r in table], "conv_id long, turn long, role string, text string, key double, digests string")
    out = trie.prefix_trie(queries.rebuilt(trie.sequences(frame))).drop("key").collect()
    assert sorted(map(tuple, out), key=str) == brute_trie(brute_rebuilt(table))
    plain = trie.prefix_trie(trie.sequences(frame)).drop("key").collect()
    own = brute_rebuilt([r for r in table if r[0] is not None and r[0] % 5 == 0])
    part = trie.prefix_trie(trie.sequences(frame.where("conv_id % 5 = 0"))).drop("key").collect()
    assert sorted(map(tuple, part), key=str) == brute_trie(own) and len(plain) > len(part)
    assert trie.prefix_trie(trie.sequences(frame.limit(0))).count() == 0
    empty = trie.prefix_trie(spark.createDataFrame([(7, [], []), (3, [], [])], "conv_id long, digests array<binary>, sizes array<long>")).drop("key").collect()
    assert list(map(tuple, empty)) == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,7").hexdigest())]


def sql_rows(sql, **frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame)
    return sorted(map(tuple, con.execute(sql).fetchall()), key=str)


def test_prefix_trie_equals_its_sql(spark):
    frame = spark.read.parquet(f"{SF}/conversations.parquet")
    assert sorted(map(tuple, queries.op12_prefix_trie(spark, SF).collect()), key=str) == sql_rows(queries.OP12_SQL, conversations=frame.toPandas())


def test_slices_of_one_hash_are_told_apart():
    buffer = divergence.LOWER[np.frombuffer("Ab ab ÄÖ äö a 日本\0日 ab aB9b".encode(), np.uint8)]
    starts, ends = divergence.boundaries(buffer)
    want = [b"ab", b"ab", "ÄÖ".encode(), "äö".encode(), b"a", "日本".encode(), "日".encode(), b"ab", b"ab", b"b"]
    for digest in (None, lambda s: 7, len, lambda s: s[0]):
        terms, of = divergence.grouped(buffer, starts, ends, digest)
        assert [terms[i] for i in of] == want and len(set(terms)) == len(terms)
    assert divergence.boundaries(np.zeros(0, np.uint8))[0].size == 0


def test_probability_is_exact():
    rng = np.random.default_rng(2)
    of = rng.integers(1, 9 * 10**15, 500)
    n = (of * rng.random(500)).astype(np.int64) + 1
    assert divergence.probability(n, of).tolist() == [1 + 10**9 * a // b for a, b in zip(n.tolist(), of.tolist(), strict=True)]
    assert divergence.probability(np.array([5]), 5).tolist() == [10**9 + 1]


def brute_audit(rows, min_docs, top):
    term = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", source or "", [m.lower() for m in term.findall((text or "").encode())]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen, n = Counter(), defaultdict(Counter)
        for own, source, found in docs:
            if own == lang:
                seen.update(set(found))
                n[source].update(found)
        kept = sorted(t for t, k in seen.items() if k >= min_docs)
        total = sum((Counter({t: c[t] for t in kept}) for c in n.values()), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        ps, q = {s: p(c) for s, c in n.items()}, p(total)
        for s in n:
            pairs = sorted(((-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode()) for o in n if o != s))
            terms = sorted((q[t] - ps[s][t], t) for t in kept if n[s][t] and ps[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -value, r + 1) for r, (value, item) in enumerate(found)]
    return sorted(out, key=str)


def test_audit_on_awkward_rows(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["Alpha", "BETA", "ß", "İx", "日本", "x", "y9z", "don't", " ", "é"]
    rows = [(lang, f"s{i % k}", " ".join(rng.choice(vocabulary, i % 9)) + "\n" * (i % 3)) for lang, k in (("en", 5), ("de", 1), ("ja", 12)) for i in range(60)]
    rows += [("en", None, "alpha " * 400), ("en", "", "beta"), (None, None, None), ("", "s", ""), ("en", "quiet", "12 34"), ("en", "quiet", None), ("xx", "a", "rare"), ("xx", "b", "words")]
    rows += [("en", "hot", "alpha beta x " * 20)] * 40
    frame = spark.createDataFrame([(*r, 3, "clash") for r in rows], "lang string, source string, text string, n long, term string")
    for min_docs, top, entries in ((3, 50, 1 << 17), (3, 2, 4), (1000, 50, 8)):
        got = divergence.audit(frame, min_docs, top, entries).collect()
        assert sorted(map(tuple, got), key=str) == brute_audit(rows, min_docs, top)
    assert divergence.audit(frame.limit(0)).count() == 0


def test_audit_equals_its_sql(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(map(tuple, queries.op13_source_divergence(spark, SF).collect()), key=str) == sql_rows(queries.OP13_SQL, documents=frame.toPandas())
