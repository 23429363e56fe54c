"""Near-duplicates, vectors, top-k and components against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmark.llm import embed_dedup, simhash, topk
from quillmark.llm._common import edges_to_components, spread_join


def components(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 300
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(200)] + [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(200, 240)]
    pairs = [p for p in pairs if p[0] != p[1]]
    got = {r["node"]: r["component"] for r in edges_to_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components(n, pairs)
    assert got == {i: want[i] for i in {x for p in pairs for x in p}}


def test_components_of_nothing(spark):
    assert edges_to_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_triples_meet_every_four_bytes():
    assert len(simhash.triples()) == 20
    assert all(any(set(t) <= set(f) for t in simhash.triples()) for f in itertools.combinations(range(8), 4))


def test_fingerprints(monkeypatch):
    texts = ["", " \t", "one", "One TWO three", "a b c d", "a b c d a b c d " * 30, "É été\x0bx y z", "straße " * 9]
    for text in texts:
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    monkeypatch.setattr(simhash, "_STRIDE", 3)
    for text in texts:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(3)
    centers = [rng.getrandbits(64) for _ in range(12)]
    fps = set(centers)
    for c in centers:
        for _ in range(rng.choice((0, 3, 60))):
            f = c
            for _ in range(rng.randint(1, 7)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    place = {s[0]: i for i, s in enumerate(signed)}
    want = components(len(fps), [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert components(len(fps), [(place[e["a"]], place[e["b"]]) for e in edges]) == want


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(50)) for _ in range(400)) for _ in range(5)]
    texts = [None, "", " ", *base, *base[:2], base[0].replace("alpha", "ALPHA"), base[1] + " end", "one", "one"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, component_id int").repartition(3)
    fps = [plain_fingerprint(t or "") for t in texts]
    want = components(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{f:016x}", want[i]) for i, f in enumerate(fps)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def vectors_with_copies(n=400, dims=32, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for i in range(0, n, 4):
        x[i] = x[i // 8] + rng.normal(size=dims) * rng.choice([0.05, 0.15, 0.25, 0.3])
    x[10:60] = x[10] + rng.normal(size=(50, dims)) * 0.05
    x[200:220] = x[200]
    return x, rng.integers(0, 3, n)


def test_embedding_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    x, label = vectors_with_copies()
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))]
    odd = [(1000, None, 1), (1001, [0.0] * 32, 1), (1002, [float("nan")] * 32, 1), (1003, x[10].tolist(), None), (1004, x[10].tolist()[:8], int(label[10])), (1005, [1e300] * 32, 1), (1006, [None] * 32, 1), (1007, [], 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, label int, rep string").repartition(3)
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(table).collect()}
    assert len(got) == len(rows) + len(odd)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    links = near.sum(axis=1)
    assert all(got[i]["n_links"] <= links[i] for i in range(len(x)))
    assert sum(got[i]["n_links"] for i in range(len(x))) >= 0.95 * links.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(1000, 1008))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embed_dedup.near_duplicates(table.limit(0)).count() == 0


def test_components_of_linked_vectors_equal_brute_force(spark):
    """Where each link is found, counts and components are those of all pairs: chains whose ends are not linked, copies."""
    rng = np.random.default_rng(3)
    dims, chains, steps = 64, 12, 6
    rows = []
    for c in range(chains):
        one, other = np.linalg.qr(rng.normal(size=(dims, 2)))[0].T
        for k in range(steps):  # neighbours at cosine 0.981, next but one at 0.924
            angle = np.pi / 16 * k
            rows += [(np.cos(angle) * one + np.sin(angle) * other, c % 3)] * (1 + 3 * (k == 2))
    order = rng.permutation(len(rows))
    x, label = np.array([rows[i][0] for i in order]), np.array([rows[i][1] for i in order])
    near = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    parent = np.arange(len(x))
    while True:  # smallest reachable id, to a fixpoint
        nxt = np.minimum(parent, np.where(near, parent, len(x)).min(axis=1))
        if (nxt == parent).all():
            break
        parent = nxt
    table = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(table).collect()}
    assert near.sum() > 100 and len(set(parent)) >= chains
    assert got == {i: (int(near[i].sum()), int(parent[i]), parent[i] == i) for i in range(len(x))}


def test_rotations_are_orthogonal():
    x, _ = vectors_with_copies()
    _, matrix = embed_dedup.learn_rotations(x / np.linalg.norm(x, axis=1, keepdims=True))
    for k in range(0, matrix.shape[1], 32):
        assert np.allclose(matrix[:, k : k + 32].T @ matrix[:, k : k + 32], np.eye(32), atol=1e-8)


@pytest.mark.parametrize("strip", [4, 4096])
def test_top_k_equals_brute_force(spark, monkeypatch, strip):
    monkeypatch.setattr(topk, "STRIP", strip)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 40)) * 0.2
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (920, [float("inf")] * 40), (940, [0.5, None])]
    table = topk.integer_vectors(spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, v string, rank int"))
    got = {}
    for r in topk.top_k(table, table.where("vec_id % 20 = 0"), k=7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    whole = np.floor(64 * x.astype(np.float32).astype(float)).astype(int)
    assert set(got) == set(range(0, 300, 20))
    for q, found in got.items():
        want = sorted((-(whole[q] @ whole[i]), i) for i in range(300) if i != q)[:7]
        assert [found[r] for r in range(1, 8)] == [(-s, i) for s, i in want]


def test_top_k_small_and_large_values(spark):
    table = topk.integer_vectors(spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>"))
    rows = topk.top_k(table, table.where("vec_id = 0"), k=20).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in rows] == [(1, (1 << 63) - 1), (2, -(1 << 63))]
    assert topk.top_k(table, table.where("vec_id = 5"), k=3).count() == 0 and topk.top_k(table.limit(0), table.limit(0), k=3).count() == 0


def test_embedding_recall_near_the_threshold(spark):
    """Pairs planted by themselves at each cosine, so that no block of copies outweighs them."""
    rng = np.random.default_rng(9)
    cosines, n, dims = (0.931, 0.935, 0.94, 0.95), 400, 64
    x = rng.normal(size=(len(cosines) * n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=x.shape)
    off -= (off * x).sum(axis=1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    c = np.repeat(cosines, n)[:, None]
    vectors = np.concatenate((x, c * x + np.sqrt(1 - c**2) * off))
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    linked = {r["vec_id"] for r in embed_dedup.near_duplicates(table).where("n_links > 0").collect()}
    for k, cosine in enumerate(cosines):
        assert sum(i in linked for i in range(k * n, (k + 1) * n)) >= 0.92 * n, cosine


def test_spread_join_equals_join(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 7, id) AS k", "id AS v")
    groups = rows.groupBy("k").agg({"v": "min"}).toDF("k", "least").join(rows.groupBy("k").count().toDF("k", "size"), "k")
    got = spread_join(rows, "k", groups, "size")
    want = rows.join(groups.drop("size"), "k")
    assert sorted(map(tuple, got.select("k", "v", "least").collect())) == sorted(map(tuple, want.select("k", "v", "least").collect()))
    assert spread_join(rows.limit(0), "k", groups.limit(0), "size").count() == 0


def test_copies_spread_over_tasks(spark):
    """Rows of 20,000 copies of a text and of a vector stay spread after the last join: no task has three times the mean."""
    docs = spark.range(20_500, numPartitions=8).selectExpr("id AS doc_id", "if(id < 20000, 'one and the same text', concat('text of ', id, ' and ', id * 7, ' or ', id * 13)) AS text")
    vectors = spark.range(20_500, numPartitions=8).selectExpr("id AS vec_id", "1 AS label", "if(id < 20000, transform(sequence(1, 16), i -> i * 1D), transform(sequence(1, 16), i -> sin(id * i * i))) AS embedding")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("16", "false", "-1"), strict=True):
            spark.conf.set(k, v)
        for found, hot in ((simhash.near_duplicates(docs), "doc_id"), (embed_dedup.near_duplicates(vectors), "vec_id")):
            rows = found.where(f"{hot} < 20000").groupBy(F.spark_partition_id()).count().collect()
            assert sum(r["count"] for r in rows) == 20_000 and max(r["count"] for r in rows) <= 3 * 20_000 / 16
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_columns_are_dropped_before_the_last_block():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(64, 64))
    c = np.floor(64 * (centres[rng.integers(0, 64, 12_000)] + 0.15 * rng.normal(size=(12_000, 64))) / 8)
    ids, trace = np.arange(len(c)), []
    own = ids % 20 == 0
    scores, found = topk.branch_and_bound(ids[own], c[own], ids, c, 20, trace)
    every = -(-own.sum() // topk.GROUP) * len(c)
    assert sum(left[-1] if len(left) == 4 else 0 for left in trace) < 0.3 * every
    full = c[own] @ c.T
    full[np.arange(own.sum()), ids[own]] = -np.inf
    for i in range(own.sum()):
        best = sorted(zip(-full[i], ids, strict=True))[:20]
        assert scores[i].tolist() == [-s for s, _ in best] and found[i].tolist() == [j for _, j in best]


def test_rounds_of_components_plan_each_star_once(spark, monkeypatch):
    """What the driver plans, and keeps of a plan, does not hold one star several times over in the next."""
    from quillmark.llm import _common

    reads, plain = [], _common.written

    def written(df, **options):
        reads.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return plain(df, **options)

    monkeypatch.setattr(_common, "written", written)
    chain = [(i, i + 1) for i in range(40)]
    got = {r["node"]: r["component"] for r in edges_to_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0)
    assert 2 <= max(reads) <= 8
