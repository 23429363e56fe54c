"""Exact top-k by inner product of integer vectors, branch and bound over blocks of dimensions.

Vectors are stored vertically (a row of the matrix is a dimension), turned to the principal axes of the candidates so that
the first dimensions hold most of their mass; turning leaves inner products as they are. Queries that are alike form small
groups, candidates that are alike form strips, and a group takes the strips in the order of what they can reach. Scores are accumulated a block of
dimensions at a time; what the remaining dimensions can still add is at most the product of the remaining norms, so a
candidate that can reach the k-th best score of no query of the group is dropped, and the surviving columns are compacted.
Survivors are scored exactly, as integers. Queries and candidates meet in blocks bounded in bytes; only k rows a query
leave a task.

Rows: vectors that are null, or hold null or non-finite components, take no part; vectors of different lengths are not
compared; scores beyond 64 bits are held at the border (components so large that doubles would round are summed as Python
integers, pair by pair, without pruning); equal scores go to the smaller vec_id; a row is excluded as its own answer by
vec_id, so rows that repeat a vec_id are not answers to each other; a null vec_id takes no part. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds on the rows and bytes of a block of queries or candidates.
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 65_536
BLOCK_BYTES = 32 << 20
#: Queries of a group, candidates that are scored at once, dimensions accumulated between two prunings, and vectors that
#: the others are laid beside.
GROUP = 32
STRIP = 2048
DIM_BLOCK = 16
PIVOTS = 128
#: Beyond this, sums of products are not exact in double precision.
EXACT = float(1 << 53)


def _keep_best(score, ids, k):
    """Columns of each row ordered by score down, id up; the first k."""
    if score.shape[1] > k:
        floor = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        width = int((score >= floor).sum(axis=1).max())
        if width < score.shape[1]:
            # Candidates at or above the k-th score; ties at the border are all kept until they are ordered.
            order = np.argsort(-score, axis=1, kind="stable")[:, :width]
            score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _alike(vertical: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each vector the pivot (a unit vector) it is most like; vectors are taken in slices, as pivots are many."""
    return np.concatenate([np.argmax(pivots.T @ vertical[:, i : i + 8192], axis=0) for i in range(0, vertical.shape[1], 8192)] or [np.zeros(0, np.int64)])


def branch_and_bound(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids), queries x at most k, of candidates c for queries q; -inf marks no answer. q, c: rows of floats
    that hold integers. trace: gets, for each group and strip, the columns left after each block of dimensions."""
    dims = q.shape[1]
    best_s, best_i = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    axes = np.linalg.eigh(c.T @ c)[1][:, ::-1] if len(c) and dims else np.eye(dims)
    vertical_q, vertical_c = np.ascontiguousarray((q @ axes).T), np.ascontiguousarray((c @ axes).T)
    cuts = list(range(0, dims, DIM_BLOCK))
    unit = vertical_q / np.maximum(np.sqrt((vertical_q**2).sum(axis=0)), 1e-300)
    pivots = unit[:, :: max(1, len(q) // PIVOTS)] if len(q) else unit
    # Vectors that are alike lie side by side.
    q_order, c_order = (np.argsort(_alike(v, pivots), kind="stable") if len(q) and v.shape[1] else np.arange(v.shape[1]) for v in (vertical_q, vertical_c))
    vertical_c, c, c_ids = np.ascontiguousarray(vertical_c[:, c_order]), c[c_order], c_ids[c_order]
    rest = lambda v: [np.sqrt((v[d + DIM_BLOCK :] ** 2).sum(axis=0)) for d in cuts]
    rest_q, rest_c = rest(vertical_q), rest(vertical_c)
    norm_q, norm_c = np.sqrt((vertical_q**2).sum(axis=0)), np.sqrt((vertical_c**2).sum(axis=0))
    strips = np.arange(0, len(c), STRIP)
    for own in [q_order[i : i + GROUP] for i in range(0, len(q), GROUP)] if len(c) else []:
        turned = np.ascontiguousarray(vertical_q[:, own])
        hope = turned[:DIM_BLOCK].mean(axis=1) @ vertical_c[:DIM_BLOCK] + (rest_q[0][own].mean() * rest_c[0] if cuts else 0)
        for at in strips[np.argsort(-np.maximum.reduceat(hope, strips), kind="stable")].tolist():
            here = slice(at, min(at + STRIP, len(c)))
            alive, strip, left = np.arange(here.start, here.stop), vertical_c[:, here], []
            partial = np.zeros((len(own), len(alive)))
            for b, d in enumerate(cuts):
                partial += turned[d : d + DIM_BLOCK].T @ strip[d : d + DIM_BLOCK]
                # Rounding of the turned vectors is far below this slack.
                open_ = partial + (rest_q[b][own][:, None] * rest_c[b][alive] + 1e-9 * norm_q[own][:, None] * norm_c[alive] + 1e-6) >= best_s[own, -1:]
                keep = open_.any(axis=0)
                if keep.mean() < 0.9 or b + 1 == len(cuts):
                    partial, alive, strip = partial[:, keep], alive[keep], strip[:, keep]
                left.append(int(keep.sum()))
                if not len(alive):
                    break
            if trace is not None:
                trace.append(left)
            if len(alive):
                exact, found = q[own] @ c[alive].T, c_ids[alive]
                exact[q_ids[own][:, None] == found[None, :]] = -np.inf
                both = np.concatenate((best_s[own], exact), axis=1), np.concatenate((best_i[own], np.broadcast_to(found, exact.shape)), axis=1)
                best_s[own], best_i[own] = _keep_best(*both, k)
    return best_s, best_i


def _exact_large(q_ids, q, c_ids, c, k):
    """The same by Python integers, for components so large that doubles would round."""
    scores, ids = np.full((len(q), k), -np.inf, object), np.full((len(q), k), np.iinfo(np.int64).max)
    whole = [[int(x) for x in row] for row in c.tolist()]
    for i, row in enumerate(q.tolist()):
        own = [int(x) for x in row]
        found = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(map(int.__mul__, own, w)))), j) for j, w in zip(c_ids.tolist(), whole, strict=True) if j != q_ids[i])[:k]
        for r, (s, j) in enumerate(found):
            scores[i, r], ids[i, r] = -s, j
    return scores, ids


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs: vec_id long, v array<double> that holds integers, none null."""
    dims = F.size("v").alias("dims")
    # Rows are numbered through by hash into blocks: block counts follow from the row counts and the widest vector.
    q_rows, c_rows, widest = (max(1, x or 0) for x in (queries.count(), *vectors.agg(F.count("*"), F.max(F.size("v"))).first()))
    fits = max(1, BLOCK_BYTES // (8 * widest))
    q_blocks, c_blocks = -(-q_rows // min(QUERY_BLOCK, fits)), -(-c_rows // min(CANDIDATE_BLOCK, fits))
    c_blocks = max(c_blocks, min(vectors.sparkSession.sparkContext.defaultParallelism, -(-c_rows // STRIP)))
    both = queries.select(
        F.lit(True).alias("is_query"), F.col("vec_id"), "v", dims, F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_blocks)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))).alias("cb")
    ).unionByName(
        vectors.select(F.lit(False).alias("is_query"), F.col("vec_id"), "v", dims, F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(c_blocks)).alias("cb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("qb"))
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["is_query"]], pdf[~pdf["is_query"]]
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        if not len(q) or not len(c):
            return empty
        q_ids, c_ids = q["vec_id"].to_numpy(np.int64), c["vec_id"].to_numpy(np.int64)
        qm, cm = np.stack(q["v"].to_numpy()).reshape(len(q), -1), np.stack(c["v"].to_numpy()).reshape(len(c), -1)
        mass = max(1.0, np.abs(qm).max(initial=0)) * max(1.0, np.abs(cm).max(initial=0)) * max(1, qm.shape[1])
        scores, ids = (branch_and_bound if mass < EXACT else _exact_large)(q_ids, qm, c_ids, cm, k)
        there = scores != -np.inf
        return pd.DataFrame({"query_id": np.repeat(q_ids, there.sum(axis=1)), "vec_id": ids[there], "score": scores[there].astype(np.int64)})

    local = both.groupBy("cb", "qb", "dims").applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(table: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, v = floor(scale * x) of every vector without null or non-finite components."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fit = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    # Spark's floor of a double is a long; large values stay doubles, which hold integers from 2^53 on anyway.
    whole = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**50, F.floor(F.lit(scale) * c).cast("double")).otherwise(F.lit(scale) * c))
    return table.where(fit & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
