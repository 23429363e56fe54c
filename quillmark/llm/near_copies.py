"""Near copies by the Jaccard similarity of five-word shingles, for the pipeline's SimHash stage.

A row is folded to its set of shingle hashes (a node). Two lookups name candidates: fingerprints within simhash.MAX_BITS
bits by the index of byte positions, and nodes that agree in a band of minima. The bands reach the edited copies whose
SimHashes differ in more bits: BANDS bands of ROWS minima meet a pair at a similarity of 0.8 with probability 0.9996.
Candidates leave as stars, so a list costs a row an entry, never its pairs.

Candidates are no links: within each connected group of them, all pairs are held against the threshold on the whole sets,
which are made again from the text of one row a node. The sets of a group are packed into blocks of at most about BLOCK
nodes and BLOCK_HASHES hashes, written once, and pairs of block numbers are dealt out. Within a pair of blocks only
hashes that more than one text has matter: the numbers of shared ones of all pairs are one product of 0/1 matrices. So
texts that share a template without being near copies cost a product, not a comparison of sets each; nothing is capped.

Rows: a null text counts as empty; texts without words are copies of each other; texts of any length are read whole, a
set beyond BLOCK_HASHES is a block of its own; rows that repeat a text, with or without their doc_id, share a node, and
their joins are dealt out however many they are; a null doc_id is kept; columns besides doc_id and text are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._common import edges_to_components, spread_join, written

SHINGLE = 5
#: Links need a similarity of at least NEAR[0] / NEAR[1].
NEAR = (4, 5)
BANDS = 20
ROWS = 5
#: Nodes of a group, and their hashes, that are packed together, about.
BLOCK = 1024
BLOCK_HASHES = 1 << 19
#: Columns of a product at once.
_COLUMNS = 2048
_RNG = np.random.default_rng(17)
_FLIP = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_ODD = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
#: Shingles that are mixed at once.
_STRIDE = 2048


def shingle_hashes(text: str) -> np.ndarray:
    """The sorted set of hashes of a text's shingles; fewer words than a shingle has are one shingle."""
    words = simhash._WORDS.findall(text.translate(simhash._UPPER))
    joined = map(" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [" ".join(words)] if words else []  # noqa: B905
    return np.unique(np.array([xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in joined], np.uint64))


def simhash_of(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STRIDE):
        ones += np.unpackbits(hashes[at : at + _STRIDE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def bands(hashes: np.ndarray) -> list[int]:
    """Keys of the bands; none for a text without words."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), _STRIDE):
        least = np.minimum(least, ((hashes[at : at + _STRIDE] ^ _FLIP) * _ODD).min(axis=1))
    return [_signed(xxhash.xxh64_intdigest(band.tobytes(), t)) for t, band in enumerate(least.reshape(BANDS, ROWS))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_key() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node, size (of its set), fp, keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, fp, keys = [], [], [], []
            for text in batch["text"]:
                hashes = shingle_hashes(text.as_py())
                node.append(_signed(xxhash.xxh64_intdigest(hashes.tobytes())))
                size.append(len(hashes))
                fp.append(simhash_of(hashes))
                keys.append(bands(hashes))
            out = [batch["doc_id"], batch["text_key"], pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "text_key", "node", "size", "fp", "keys"])

    rows = docs.select("doc_id", text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, node long, size long, fp long, keys array<long>")


def candidates(nodes: DataFrame) -> DataFrame:
    """a, b: edges that connect all nodes which share a band or whose fingerprints are within simhash.MAX_BITS bits."""
    index = nodes.select("node", F.explode("keys").alias("key"))
    least = index.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    by_band = spread_join(index, "key", written(least), "n").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    heads = written(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")))
    same = spread_join(nodes.select("node", "fp"), "fp", heads, "n").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    found = simhash.links(heads.select("fp"))
    ends = [heads.select(F.col("fp").alias(c), F.col("head").alias(f"node_{c}")) for c in "ab"]
    by_bits = found.join(ends[0], "a").join(ends[1], "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return by_band.union(same).union(by_bits)


def shared(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """How many hashes each set of a shares with each of b (or of a)."""
    sides = [a] if b is None else [a, b]
    flat = [np.concatenate(side) for side in sides]
    if b is None:
        values, counts = np.unique(flat[0], return_counts=True)
        common = values[counts > 1]
    else:
        common = np.intersect1d(*flat)
    placed = []
    for side, hashes in zip(sides, flat, strict=True):
        at = np.searchsorted(common, hashes)
        held = np.flatnonzero(common[np.minimum(at, len(common) - 1)] == hashes) if len(common) else np.zeros(0, np.int64)
        held = held[np.argsort(at[held], kind="stable")]
        placed.append((np.repeat(np.arange(len(side)), [len(s) for s in side])[held], at[held], len(side)))
    total = np.zeros((len(a), len(sides[-1])), np.float64)
    for lo in range(0, len(common), _COLUMNS):
        has = []
        for of, at, n in placed:
            cut = slice(*np.searchsorted(at, (lo, lo + _COLUMNS)))
            matrix = np.zeros((n, min(_COLUMNS, len(common) - lo)), np.float32)
            matrix[of[cut], at[cut] - lo] = 1
            has.append(matrix)
        total += has[0] @ has[-1].T
    return total


def forest(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that join, with no cycle, all sets of a (or of a and b, across) that are near enough, as pairs of places in
    a followed by b."""
    sizes = [np.array([len(s) for s in side]) for side in (a, a if b is None else b)]
    near = sum(NEAR) * shared(a, b) >= NEAR[0] * (sizes[0][:, None] + sizes[1])
    if b is not None:
        n = len(a) + len(b)
        across, near = near, np.zeros((n, n), bool)
        near[: len(a), len(a) :], near[len(a) :, : len(a)] = across, across.T
    np.fill_diagonal(near, False)
    out, seen = [], ~near.any(axis=1)
    for start in range(len(near)):
        if seen[start]:
            continue
        seen[start] = True
        todo = [start]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(near[i] & ~seen)
            seen[new] = True
            todo += new.tolist()
            out += [(i, j) for j in new.tolist()]
    return out


def packed(docs: DataFrame, nodes: DataFrame, coarse: DataFrame) -> DataFrame:
    """component, k (its number of blocks), block, rows (node and set): the sets of coarse's nodes in blocks."""
    members = coarse.join(nodes.select("node", "size", "rep"), "node")
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"))
    k = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("hashes") / BLOCK_HASHES, F.lit(1.0)))
    listed = spread_join(members.drop("size"), "component", written(sizes.select("component", "n", k.alias("k"))), "n")
    listed = listed.select("component", "k", F.pmod(F.xxhash64("node", F.lit(7)), F.col("k")).alias("block"), "node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"))
    rows = docs.select(F.col("doc_id"), text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    # One row a node is asked for; of rows that repeat both doc_id and text, one is taken.
    texts = rows.join(listed, rows["doc_id"].eqNullSafe(listed["rep_id"]) & (rows["text_key"] == listed["rep_key"])).dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_hashes(t.as_py()).tobytes() for t in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("component", "k", "block", "node")), sets], ["component", "k", "block", "node", "set"])

    sets = texts.select("component", "k", "block", "node", "text").mapInArrow(run, "component long, k long, block long, node long, set binary")
    return written(sets.groupBy("component", "k", "block").agg(F.collect_list(F.struct("node", "set")).alias("rows")))


def verified(blocks: DataFrame) -> DataFrame:
    """a, b: links of nodes that connect, within each component of blocks, all whose similarity is high enough."""
    several = blocks.where("k > 1")
    x, y = (several.select("component", F.col("block").alias(c), F.col("rows").alias(r)) for c, r in (("x", "one"), ("y", "other")))
    later = F.explode(F.sequence(F.col("block") + 1, F.col("k") - 1)).alias("y")
    pairs = several.where("block < k - 1").select("component", F.col("block").alias("x"), later)
    across = pairs.join(x, ["component", "x"]).join(y, ["component", "y"]).select("one", "other")
    within = blocks.select(F.col("rows").alias("one"), F.lit(None).cast(blocks.schema["rows"].dataType).alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, other in zip(batch["one"], batch["other"], strict=True):
                sides = [s.values for s in (one, other) if s.is_valid]
                nodes = np.concatenate([s.field("node").to_numpy() for s in sides])
                links = forest(*([np.frombuffer(h.as_buffer(), np.uint64) for h in s.field("set")] for s in sides))
                at = np.array(links, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at[:, 0]]), pa.array(nodes[at[:, 1]])], ["a", "b"])

    return within.mapInArrow(run, "a long, b long").unionByName(across.mapInArrow(run, "a long, b long"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, component: rows that are reachable from each other by links share a component."""
    marked = written(sketches(docs))
    rep = F.min(F.struct("doc_id", "text_key")).alias("rep")
    nodes = written(marked.groupBy("node").agg(rep, F.count("*").alias("n"), F.any_value("size").alias("size"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys")))
    coarse = edges_to_components(candidates(nodes))
    joined = edges_to_components(verified(packed(docs, nodes, coarse)))
    named = written(nodes.select("node", "n").join(joined, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component")))
    return spread_join(marked.select("doc_id", "text_key", "node"), "node", named, "n").select("doc_id", "text_key", "component")
