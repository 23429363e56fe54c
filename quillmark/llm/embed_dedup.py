"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and a rerank.

Rotations are learnt on a bounded sample so that the signs of centred, rotated vectors are balanced codes that lose
little (alternating between codes and the orthogonal Procrustes rotation). ROUNDS rotations give codes of ROUNDS x
dims bits, cut into substrings of KEY_BITS; each substring is a table, and vectors of a label that agree in one meet.
Of the pairs that meet, those whose codes are near enough are reranked by cosine of the original vectors, so no pair
below the threshold is ever linked; recall is measured in the tests against brute force.

Copies are folded to one row a vector. A pair is counted in the first table where it meets; links leave a task as
counts and as a spanning forest, never as pairs. The vectors of a bucket are packed into blocks of at most BLOCK, one row
each, which are written once; a bucket of k blocks gives k (k + 1) / 2 pairs of block numbers, and only those are dealt
out. A bucket of n vectors is so read about n / (2 BLOCK) times, which is the least its n * n / 2 comparisons ask for.

Rows: a vec_id that repeats keeps a row each, which link like other rows when their vectors do; a null label or vec_id, or a vector that is null, zero or has null or non-finite components, links with nothing:
n_links 0, its own component, kept. Vectors of different lengths never link. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import edges_to_components, spread_join, written

THRESHOLD = 0.93
#: Bound on the vectors that rotations are learnt from.
SAMPLE = 8192
ROUNDS = 5
KEY_BITS = 16
#: Part of the code's bits in which a linked pair may differ: twice the mean at a cosine of 0.93.
FAR = 0.25
#: Vectors of a bucket that are packed together and compared at once.
BLOCK = 1024


def learn_rotations(sample: np.ndarray, rounds: int = ROUNDS, steps: int = 30, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """mean and dims x (rounds * dims) matrix of iterative quantisation on unit vectors."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    mean = sample.mean(axis=0)
    centred = sample - mean
    # All principal directions are kept, so the principal axes are one more rotation.
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
    projected, out = centred @ axes, []
    for _ in range(rounds):
        rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(steps):
            codes = np.where(projected @ rotation >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(codes.T @ projected)
            rotation = (u @ vt).T
        out.append(axes @ rotation)
    return mean, np.concatenate(out, axis=1)


def code_and_keys(unit: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows of bytes) and the numbers of their substrings."""
    mean, matrix = model
    bits = (unit - mean) @ matrix >= 0
    tables = max(1, bits.shape[1] // KEY_BITS)
    cut = bits[:, : tables * KEY_BITS] if bits.shape[1] >= KEY_BITS else bits
    weights = 1 << np.arange(cut.shape[1] // tables)
    return np.packbits(bits, axis=1), (cut.reshape(len(bits), tables, -1) * weights).sum(axis=2).astype(np.int64)


def _units(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _coded(folded: DataFrame, models: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    shared = folded.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keys: list = [None] * n
            codes: list = [None] * n
            units: list = [None] * n
            rows = batch["v"].to_pylist()
            dims = np.array([len(r) for r in rows])
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                unit = _units(np.array([rows[i] for i in at], float))
                code, key = code_and_keys(unit, shared.value.get(d) or (np.zeros(d), np.eye(d)))
                for k, i in enumerate(at.tolist()):
                    keys[i], codes[i], units[i] = key[k].tolist(), code[k].tobytes(), unit[k].tobytes()
            out = [batch["rep"], batch["label"], batch["n"], pa.array(dims, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(codes, pa.binary()), pa.array(units, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["rep", "label", "n", "dims", "keys", "code", "unit"])

    return folded.select("rep", "label", "n", "v").mapInArrow(run, "rep long, label string, n long, dims int, keys array<long>, code binary, unit binary")


def _bucket_links(a: dict, b: dict | None, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Counts of links for the rows of a (and b), and a forest of links as pairs of rep."""
    own = b is None
    b = a if own else b
    count_a, count_b = np.zeros(len(a["rep"]), np.int64), np.zeros(len(b["rep"]), np.int64)
    far = FAR * 8 * a["code"].shape[1]
    words_b = b["code"]
    differ = np.zeros((len(count_a), len(count_b)), np.uint16)
    for w in range(words_b.shape[1]):
        differ += np.bitwise_count(a["code"][:, w : w + 1] ^ words_b[:, w])
    near = differ <= far
    if own:
        near &= np.triu(np.ones(near.shape, bool), 1)
    for t in range(table):  # met before
        near &= a["keys"][:, t : t + 1] != b["keys"][:, t]
    i, j = np.nonzero(near)
    good = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        good[s] = (a["unit"][i[s]] * b["unit"][j[s]]).sum(axis=1) >= threshold
    i, j = i[good], j[good]
    np.add.at(count_a, i, b["n"][j])
    np.add.at(count_b, j, a["n"][i])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    edges = []
    for x, y in zip(a["rep"][i].tolist(), b["rep"][j].tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            edges.append((x, y))
    return (count_a + count_b if own else count_a), count_b, edges


def links(coded: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """rep, links (part of its count), other (null, or a neighbour for the spanning forest)."""
    index = coded.select("rep", "label", "dims", F.posexplode("keys").alias("t", "key"))
    bucket = ["label", "dims", "t", "key"]
    index = index.select("rep", F.struct(*bucket).alias("bucket"))
    sizes = written(index.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").withColumn("k", F.ceil(F.col("size") / BLOCK)))
    listed = spread_join(index, "bucket", sizes, "size").select("bucket.*", "rep", "k")
    listed = listed.select(F.xxhash64(*bucket).alias("g"), F.xxhash64(F.lit(3), *reversed(bucket)).alias("g2"), "t", "rep", "k")
    listed = listed.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("k")))
    member = F.struct("rep", "n", "keys", "code", "unit")
    blocks = written(
        listed.join(coded.select("rep", "n", "keys", "code", "unit"), "rep").groupBy("g", "g2", "t", "k", "block").agg(F.collect_list(member).alias("rows"))
    )
    # Pairs of block numbers; those of a bucket of one block are compared where they lie.
    alone = blocks.where("k = 1").select("t", F.col("rows").alias("a"), F.lit(None).cast(blocks.schema["rows"].dataType).alias("b"))
    several = blocks.where("k > 1")
    x, y = (several.select("g", "g2", F.col("block").alias(c), F.col("rows").alias(r)) for c, r in (("x", "a"), ("y", "b")))
    pairs = several.select("g", "g2", "t", F.col("block").alias("x"), F.explode(F.sequence(F.col("block"), F.col("k") - 1)).alias("y"))
    # A block that stands against itself has no second side.
    same = pairs.where("x = y").join(x, ["g", "g2", "x"]).select("t", "a", F.lit(None).cast(blocks.schema["rows"].dataType).alias("b"))
    across = pairs.where("x < y").join(x, ["g", "g2", "x"]).join(y, ["g", "g2", "y"]).select("t", "a", "b")
    across = across.repartition(F.xxhash64("a.rep", "b.rep"))  # by pair, so that one bucket's pairs spread over all tasks

    def side(rows: pa.StructArray) -> dict:
        one = {name: rows.field(name) for name in ("rep", "n", "keys", "code", "unit")}
        fixed = lambda c, kind: np.frombuffer(b"".join(one[c].to_pylist()), kind).reshape(len(rows), -1)
        return {"rep": one["rep"].to_numpy(), "n": one["n"].to_numpy(), "keys": one["keys"].flatten().to_numpy().reshape(len(rows), -1), "code": fixed("code", np.uint8), "unit": fixed("unit", np.float64)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, a, b in zip(batch["t"].to_pylist(), batch["a"], batch["b"], strict=True):
                sides = [side(s.values) for s in (a, b) if s.is_valid]
                *counts, edges = _bucket_links(sides[0], sides[1] if len(sides) > 1 else None, t, threshold)
                rep, found, other = [e[0] for e in edges], [0] * len(edges), [e[1] for e in edges]
                for rows, count in zip(sides, counts, strict=False):
                    at = np.flatnonzero(count)
                    rep += rows["rep"][at].tolist()
                    found += count[at].tolist()
                    other += [None] * len(at)
                yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(found, pa.int64()), pa.array(other, pa.int64())], ["rep", "links", "other"])

    out = "rep long, links long, other long"
    return alone.mapInArrow(run, out).unionByName(same.mapInArrow(run, out)).unionByName(across.mapInArrow(run, out))


def near_duplicates(table: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    infinite = F.lit(float("inf"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    fit &= F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < infinite)) & F.exists(x, lambda c: c != 0)
    # Two independent hashes stand for label and vector; copies have both in common.
    vectors = F.when(F.coalesce(fit, F.lit(False)), x)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vectors.alias("v"))
    rows = rows.select("vec_id", "label", "v", F.xxhash64("label", "v").alias("h1"), F.xxhash64("v", F.lit(1), "label").alias("h2"))
    whole = rows.where("v is not null")
    folded = written(whole.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("label").alias("label"), F.any_value("v").alias("v")))

    sample: dict[int, list] = {}
    for row in folded.orderBy(F.xxhash64("h1"), "rep").limit(SAMPLE).select("v").collect():
        sample.setdefault(len(row["v"]), []).append(row["v"])
    models = {d: learn_rotations(_units(np.array(v, float))) for d, v in sample.items() if len(v) > 1}
    coded = written(_coded(folded, models))
    found = written(links(coded, threshold=threshold))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = edges_to_components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    copies = F.struct("h1", "h2").alias("copies")
    by_class = (
        folded.select("h1", "h2", "rep", "n").join(counts, "rep", "left").join(joined, folded["rep"] == joined["node"], "left")
        .select(copies, "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    out = spread_join(whole.select("vec_id", copies), "copies", written(by_class), "n").select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
