"""The pipeline's near copies against brute force on five-word shingles."""

import itertools
import random
import time

import numpy as np
import pytest

import corpus_pipeline
from quillmark.llm import near_copies, simhash

from .test_similarity import components


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited_copies(seed=8):
    """Families of copies with words changed at random: far apart in SimHash, some just above and some below 0.8."""
    rng = random.Random(seed)
    texts = [None, "", "one", "One", "two words", "one two three four five"]
    for n in (30, 80, 200, 400):
        for _ in range(6):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            texts.append(" ".join(base))
            for changed in range(1, 8):
                words = list(base)
                for i in rng.sample(range(n), max(1, n * changed // 200)):
                    words[i] = f"x{rng.randrange(5000)}"
                texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("block", [7, 256])
def test_stage_drops_edited_copies_and_nothing_else(spark, sf, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    texts = edited_copies()
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if similarity(sets[i], sets[j]) >= 0.8]
    bits = [(simhash.fingerprint(texts[i] or "") ^ simhash.fingerprint(texts[j] or "")).bit_count() for i, j in pairs]
    assert sum(b > 4 for b in bits) > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect())
    assert got == sorted(set(components(len(texts), pairs)))


def test_stage_goes_by_rows_where_ids_repeat_or_lack(spark, sf):
    a, b, c = (" ".join(f"{x}{i}" for i in range(300)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, b + " end"), (None, c), (None, c + " end"), (None, a + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()]
    assert len(got) == 3 and (1, a) in got and (1, b) in got
    assert [d for d, t in got if t in (c, c + " end")] == [None]


def test_texts_that_share_a_template_are_compared_as_a_product(spark):
    """4,096 texts of one template at a similarity near 0.65, and near copies of some: no link between the former."""
    rng = random.Random(2)
    template = [f"t{i}" for i in range(300)]
    texts = [" ".join(template + [f"u{rng.randrange(10**9)}" for _ in range(80)]) for _ in range(4096)]
    copies = [t + " more" for t in texts[:40]]
    assert 0.6 < similarity(shingles(texts[0]), shingles(texts[1])) < 0.7
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + copies)], "doc_id long, text string")
    nodes = near_copies.sketches(docs)
    assert nodes.selectExpr("explode(keys) AS key").groupBy("key").count().where("count > 1000").count() > 0
    own = [near_copies.shingle_hashes(t) for t in texts + copies]
    began = time.time()
    links = [link for lo in range(0, 4096, 1024) for link in near_copies.forest(own[lo : lo + 1024])]
    for x, y in itertools.combinations(range(0, 4096, 1024), 2):
        links += near_copies.forest(own[x : x + 1024], own[y : y + 1024])
    assert not links and time.time() - began < 20
    got = near_copies.groups(docs).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["component"], set()).add(r["doc_id"])
    assert sorted(map(sorted, (g for g in groups.values() if len(g) > 1))) == [[i, 4096 + i] for i in range(40)]


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 5000)).astype(np.uint64)) for _ in range(9)]
    plain = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    own = near_copies.shared(sets, None)  # says nothing of a set with itself
    assert all(own[i, j] == plain[i][j] for i in range(9) for j in range(9) if i != j)
    assert near_copies.shared(sets[:4], sets[4:]).tolist() == [row[4:] for row in plain[:4]]
    assert near_copies.shared([np.zeros(0, np.uint64)], None).tolist() == [[0]]


def test_rows_of_every_kind(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, None), (4, ""), (5, " \n"), (6, "one"), (6, "one")]
    docs = spark.createDataFrame([(*r, 1, 2, [3]) for r in rows], "doc_id long, text string, node int, component int, keys array<int>").repartition(2)
    got = sorted((r["doc_id"], r["component"]) for r in near_copies.groups(docs).collect())
    of = dict(got)
    assert len(got) == 7 and of[1] == of[2] and of[3] == of[4] == of[5] and len({of[1], of[3], of[6]}) == 3
    assert near_copies.groups(docs.limit(0)).collect() == []
