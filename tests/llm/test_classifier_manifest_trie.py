"""Operators 11 to 13 against plain versions, and on the awkward inputs that their docstrings define."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from safemeter.llm import factorisation, merkle, prefix_trie
from safemeter.llm._bytes import ByteHash, runs

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, G int"


def by_text(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


# ---- factorisation machine
def test_linear_time_margin_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = factorisation.Machine(0.3, rng.normal(size=factorisation.SIZE), rng.normal(size=(factorisation.SIZE, 4)))
    import pyarrow as pa

    texts = pa.array(["One one two ### ! \n X", "", None, "été 12"])
    _, _, data, off = next(runs(texts))
    text, place, value = factorisation.features(data, off, np.array([5, -1, 0, 6]), ByteHash(5))
    want = []
    for t in range(4):
        x = dict(zip(place[text == t].tolist(), value[text == t].tolist(), strict=True))
        assert len(x) == (text == t).sum() and all(0 <= p < factorisation.SIZE for p in x)
        want.append(0.3 + sum(m.linear[p] * v for p, v in x.items()) + sum(m.factors[p] @ m.factors[q] * x[p] * x[q] for p, q in combinations(x, 2)))
    assert np.allclose(m.margins(text, place, value, 4), want)


def test_held_out_quality_and_odd_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = {r["doc_id"]: r for r in factorisation.judged(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    seen = [(r["quality"], got[r["doc_id"]]["score"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    good, bad = ([s for q, s in seen if q == k] for k in (1, 0))
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.9
    # labels, languages, sources and ids are no inputs
    machine = factorisation.trained(docs.join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").limit(60), iterations=3)
    odd = docs.limit(20).select((F.col("doc_id") + 1).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit(None).cast("string").alias("source"), "n_chars", F.lit(1).alias("score"), F.lit(2).alias("K"))
    a, b = (sorted(r["score"] for r in factorisation.scored(d, machine).collect()) for d in (docs.limit(20), odd))
    assert a == b
    rows = [(1, None, None), (2, "", 0), (3, " \n", 3), (None, "x " * 200_000, 400_000), (4, "a", 1), (4, "a", 1)]
    out = factorisation.scored(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), machine).collect()
    assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out) and len({r["score"] for r in out if r["doc_id"] == 4}) == 1
    assert factorisation.judged(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in factorisation.judged(docs.limit(5).drop("n_chars"), labels.limit(0)).collect()} == {0.5}
    one = factorisation.trained(docs.limit(5).withColumn("label", F.lit(1)))
    assert {r["score"] > 0.99 for r in factorisation.scored(docs.limit(3), one).collect()} == {True}


# ---- Merkle manifest
def test_addresses_are_a_van_emde_boas_order():
    for levels in range(1, 6):
        places = [merkle.address(d, np.arange(8**d), levels) for d in range(levels)]
        assert sorted(np.concatenate(places).tolist()) == list(range(merkle.nodes_in(levels)))
        assert places[0][0] == 0
    # of four levels the first two are the upper half; each subtree below is one stretch
    assert merkle.address(1, np.arange(8), 4).tolist() == list(range(1, 9))
    assert [merkle.address(2, np.array([k]), 4)[0] for k in (0, 1)] == [9, 18] and merkle.address(3, np.arange(8), 4).tolist() == list(range(10, 18))


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(r):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def levels_over(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        x = out[-1]
        out.append([digest("".join(x[k : k + 8])) for k in range(0, len(x), 8)])
    return out


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels_over([v[2] for v in sorted(by[x], key=lambda v: v[:3])]) for x in langs}
    top, out = levels_over([trees[x][-1][0] for x in langs]) if langs else None, []
    for place, x in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(sorted(by[x], key=lambda v: v[:3])):
            now, proof = leaf, ""
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                now = leaf_of((*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])))
            for tree, at in ((trees[x], i), (top, place)):
                for level in tree[:-1]:
                    a = at // 8 * 8
                    left, right = "".join(level[a:at]), "".join(level[at + 1 : a + 8])
                    proof, now, at = proof + left + right, digest(left + now + right), at // 8
            out.append((r[0], leaf, trees[x][-1][0], top[-1][0], digest(proof), now, now == top[-1][0]))
    return out


TAMPERED = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 0"


def test_manifest(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(50)]), rng.choice(["s", None]), rng.choice([None, "", "a", "é", "zz"]), 1, rng.choice(["Aa", "b", None, "", "ÄB", "Z" * 9000])) for _ in range(300)]
    rows += [(k, "s", "hot", None, "X" * (k % 70)) for k in range(4700)] + [(7, "s", "hot", None, "same")] * 20 + [(k, "s", f"l{k}", 2, "Q") for k in range(600)]
    for some in (rows, rows[:1], []):
        docs = spark.createDataFrame([(*r, "clash", 1) for r in some], DOCS)
        got = merkle.verified(docs, tampered=F.expr(TAMPERED))
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert by_text(map(tuple, got.collect())) == by_text(plain_manifest(some))
    assert {r["verified"] for r in merkle.verified(docs.sparkSession.createDataFrame([(*r, "c", 1) for r in rows[:40]], DOCS)).collect()} == {True}


# ---- prefix trie
TURNS = "conv_id long, turn long, role string, text string, node int, Depth string"


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest(), r, x))
    own = {c: [v[3:] for v in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + t[h:])
    nodes = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, m in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * words
    ends = {p: digest(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))) for p, m in nodes.items()}
    return [(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends[p]) for p, m in nodes.items()]


def test_trie(spark):
    rng = random.Random(3)
    rows = [(rng.choice([-41, -3, 0, 1, 2, 20, 21, 22, 23, 24, 25, 40, 41, 42, None, 60, 61, 77]), rng.choice([None, 0, 1, 2, 3, 5]), rng.choice(["user", None, "a"]), rng.choice(["x y", "z", None, "", " \t", "w " * 5000])) for _ in range(400)]
    rows += [(100, k, "u", "word " * 3) for k in range(120)] + [(101, k, "u", "word " * 3) for k in range(90)] + [(120 + 20 * j, 0, "u", "same") for j in range(300)]
    docs = spark.createDataFrame([(*r, 1, "d") for r in rows], TURNS)
    want = by_text(plain_trie(rows))
    for options in ({}, {"chunk": 7, "local_nodes": 100}):
        assert by_text(map(tuple, prefix_trie.prefix_trie(docs, **options).collect())) == want
    assert prefix_trie.prefix_trie(docs.where("conv_id is null")).count() == 0


def test_trie_split_by_joins_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = by_text(map(tuple, prefix_trie.prefix_trie(docs, chunk=2, local_nodes=3).collect()))
    assert got == by_text(plain_trie([tuple(r) for r in docs.select("conv_id", "turn", "role", "text").collect()]))


def test_local_decomposition_of_deep_and_wide_components():
    rng = random.Random(5)
    for n, deep in ((1, 1), (400, 1), (400, 400), (300, 3)):
        parent = [-1] + [max(0, k - 1 - rng.randrange(min(deep, k))) if deep < n else k - 1 for k in range(1, n)]
        depth = [0] * n
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
        own = np.array([[rng.randrange(5), rng.randrange(9)] for _ in range(n)])
        want, weight = own.copy(), np.ones(n, np.int64)
        for k in range(n - 1, 0, -1):
            want[parent[k]] += want[k]
            weight[parent[k]] += weight[k]
        names = np.arange(n)  # a name per row: depths need not tell rows apart
        got = prefix_trie._settled(names, np.array(depth), np.array([max(p, 0) for p in parent]), np.zeros(n, np.int64), weight, own, np.zeros_like(own))
        assert (got == want).all()


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_prefix_trie"])
def test_query_equals_sql(spark, name):
    import duckdb

    from safemeter.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, "/root/testdata/sf0.001").select(*names)
    assert by_text(map(tuple, got.collect())) == by_text(want.fetchall())
