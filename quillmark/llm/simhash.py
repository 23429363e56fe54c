"""SimHash near-duplicates through an inverted index of byte positions.

Fingerprints of 64 bits that differ in at most 4 bits differ in at most 4 of their 8 bytes, so they share at least 4
positional bytes. Posting lists of single (position, byte) entries would hold a 256th of the corpus each; the index
therefore keeps lists of three joint entries: 20 triples of positions hit every set of four (a Turan system), so each
pair with four shared bytes meets in a list. Within a list the shared positional bytes of each pair are tallied, pairs
that reach the guaranteed four are kept and verified by their differing bits.

Only connectivity is asked for, so a list yields a spanning forest of its links, at most one link a fingerprint, never
its pairs. Copies are folded to one row a fingerprint before the index. A long list is dealt out as pairs of blocks of
bounded size, which spread over tasks; nothing is capped.

Rows: a null or empty text, or one of white space, has fingerprint zero and is linked like any other; fewer words than
a shingle has are one shingle; a doc_id that repeats keeps a row each; null doc_ids take part but never name a
component unless alone. Texts of any length are read whole. An empty table gives no rows; columns besides doc_id and text
are ignored.

Scale: a list grows as N / 2^24 of N distinct fingerprints and the compared pairs as N^2 / 2^24, which is fine to about
10^9 distinct fingerprints; beyond that, lists of four positions in a longer fingerprint would be due.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import edges_to_components, spread_join, whole_groups, written

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Fingerprints of a list that are compared at once.
BLOCK = 2048
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}
#: Shingles whose bits are counted at once.
_STRIDE = 1 << 16


def triples() -> list[tuple[int, int, int]]:
    """20 triples of the 8 positions such that any four positions hold one: positions in three rings of sizes 3, 3, 2;
    a triple lies in one ring, or has two of a ring and one of the next."""
    rings = ((0, 1, 2), (3, 4, 5), (6, 7))
    found = [tuple(r) for r in rings if len(r) == 3]
    for i, ring in enumerate(rings):
        found += [tuple(sorted((*two, one))) for two in itertools.combinations(ring, 2) for one in rings[(i + 1) % 3]]
    return sorted(found)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: bit i is set if it is set in over half of the shingles' hashes."""
    words = _WORDS.findall(text.translate(_UPPER))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _STRIDE):
        part = words[at : at + _STRIDE + shingle - 1]
        joined = map(" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [" ".join(words)]  # noqa: B905
        hashes = np.array([xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), SEED) for s in joined], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or "", shingle) for t in batch["text"]], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray | None, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, with no cycle, all of a (or of a and b, across) that differ in at most max_bits bits."""
    least = 8 - max_bits
    own = b is None
    b = a if own else b
    nodes = a if own else np.concatenate((a, b))
    offset = 0 if own else len(a)
    parent = np.arange(len(nodes))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right = [], []
    split_b = b.view(np.uint8).reshape(-1, 8)
    for i in range(len(a)):
        rest = slice(i + 1, None) if own else slice(0, None)
        # The tally of shared positional bytes, then the bits of those that reach the guaranteed number.
        tally = (split_b[rest] == a[i : i + 1].view(np.uint8)).sum(axis=1, dtype=np.uint8)
        at = np.flatnonzero(tally >= least)
        if len(at):
            at = at + (i + 1 if own else 0)
            at = at[np.bitwise_count(b[at] ^ a[i]) <= max_bits]
        for j in at.tolist():
            x, y = root(i), root(offset + j)
            if x != y:
                parent[y] = x
                left.append(i)
                right.append(offset + j)
    return nodes[left], nodes[right]


def links(fps: DataFrame, *, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: links of distinct fingerprints fp that connect all whose distance is at most max_bits (at most 4)."""
    if not 0 <= max_bits <= 4:
        raise ValueError("triples of bytes find distances up to 4 bits")
    masks = [sum(0xFF << (8 * p) for p in t) for t in triples()]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    entry = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(signed)]))
    index = fps.select("fp", entry.alias("e"))
    sizes = written(index.groupBy("e").agg(F.count("*").alias("n")).where("n > 1").withColumn("k", F.ceil(F.col("n") / BLOCK)))
    # Lists of more than a block are dealt into blocks; each pair of blocks is a group of its own.
    listed = spread_join(index, "e", sizes, "n").select("fp", "e.t", "e.bytes", "k")
    listed = listed.withColumn("block", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("k")))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")))
    dealt = listed.select("t", "bytes", "fp", "block", F.explode(pair).alias("p")).select("t", "bytes", "p.x", "p.y", "fp", "block")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ("t", "bytes", "x", "y")):
            found = [(np.zeros(0, np.uint64),) * 2]
            fp, block = group["fp"].astype(np.uint64), group["block"]
            for lo, hi in zip(group["starts"].tolist(), group["ends"].tolist(), strict=True):
                one, at = fp[lo:hi], block[lo:hi]
                x, y = group["x"][lo], group["y"][lo]
                if hi - lo == 2:
                    if x == y and int(one[0] ^ one[1]).bit_count() <= max_bits:
                        found.append((one[:1], one[1:]))
                elif x == y:
                    found.append(forest(one, None, max_bits))
                else:
                    found.append(forest(one[at == x], one[at == y], max_bits))
            a, b = (np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    keys = ["t", "bytes", "x", "y"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id that is reachable by links)."""
    marked = written(fingerprints(docs, shingle=shingle))
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    folded = written(least)
    joined = edges_to_components(links(folded.select("fp"), max_bits=max_bits))
    # A component is named by its smallest doc_id, found per fingerprint first.
    grouped = folded.join(joined, folded["fp"] == joined["node"], "left").select("fp", "least", "copies", F.coalesce("component", "fp").alias("c"))
    grouped = written(grouped)
    named = grouped.groupBy("c").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    by_fp = written(spread_join(grouped, "c", named, "size").select("fp", "copies", "component_id"))
    return spread_join(marked, "fp", by_fp, "copies").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
