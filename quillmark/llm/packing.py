"""Packing of documents into sequences of a fixed length, planned by non-negative least squares.

Each document's ids are cut into full windows and a tail. The histogram of tail lengths (at most `length` numbers)
goes to the driver, which enumerates shallow combinations of lengths that fill a window, solves how often each is used
so that the histogram is met, and rounds down. Tails that no combination takes are packed greedily: laid end to end
and cut at window borders; what is left in the very last window is cut at powers of two, which need no padding.

Places follow from prefix sums over tasks, so nothing whole passes through one task: a tail's rank among the tails of
its length says which use of which combination it fills. The first ranks of a length are the spare ones; rounding leaves
few of them, whatever the size of the corpus, and only their ids are moved: of every other tail the checksum is enough.

Rows: a null text counts as empty; an empty text still has the end id; a text of any length is cut whole; rows that
repeat a doc_id are packed each; a null doc_id is kept; an empty table gives no rows. Columns besides doc_id and text are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from ._common import pieces_of, written

LENGTH = 1024


def combinations(length: int) -> list[tuple[int, ...]]:
    """Shallow combinations that fill a window or need no padding: powers of two alone, pairs, and triples of which
    two are equal or one is a power of two."""
    found = {(1 << k,) for k in range(length.bit_length()) if 1 << k < length}
    found |= {(a, length - a) for a in range(1, length // 2 + 1)}
    for a in range(1, length):
        for b in {a, *(1 << k for k in range(length.bit_length()))}:
            c = length - a - b
            if b < length and c > 0:
                found.add(tuple(sorted((a, b, c))))
    return sorted(found)


def solve_nnls(columns: list[tuple[int, ...]], target: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """x >= 0 that minimises |A x - target|, A's columns being the counts of each length in a combination.
    Cyclic coordinate descent: each step solves for one entry exactly."""
    x, rest = np.zeros(len(columns)), target.astype(float).copy()
    counts = [sorted({(n, c.count(n)) for n in c}) for c in columns]
    live = [j for j, c in enumerate(counts) if all(target[n] for n, _ in c)]
    for _ in range(sweeps):
        moved = 0.0
        for j in live:
            step = sum(k * rest[n] for n, k in counts[j]) / sum(k * k for _, k in counts[j])
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved += abs(step)
                for n, k in counts[j]:
                    rest[n] -= k * step
        if moved < 0.5:
            break
    return x


def plan_packing(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) that together use no more tails of any length than there are. histogram: by length."""
    columns = combinations(len(histogram))
    x = solve_nnls(columns, histogram)
    left, plan = histogram.astype(np.int64).copy(), []

    def take(j: int, want: int) -> None:
        need = {n: columns[j].count(n) for n in columns[j]}
        times = min([want, *(int(left[n]) // k for n, k in need.items())])
        if times > 0:
            plan.append((columns[j], times))
            for n, k in need.items():
                left[n] -= k * times

    for j in np.argsort(-x, kind="stable"):
        take(int(j), int(x[j]))
    return plan


def _cut_ids(docs: DataFrame, length: int, end_id: int, path: str) -> DataFrame:
    """Per document: its tail's ids, checksums of its full windows and its tail, and its places among its task's rows."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("n_full", pa.int64()), ("full_before", pa.int64()), ("full_crc", pa.list_(pa.int64())), ("tail_len", pa.int32()), ("tail_rank", pa.int64()), ("tail_crc", pa.int64()), ("tail", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokens.ByteBpe.load(path), TaskContext.get().partitionId()
        ranks, full = [0] * length, 0
        for batch in batches:
            docs, first = batch["doc_id"], 0
            for texts in pieces_of(batch["text"], tokens.BATCH_CHARS):
                ids, lengths = tokens.with_end(*encoder.encode_all(texts), end_id)
                data, at, rows = memoryview(ids).cast("B"), 0, []
                for n in lengths.tolist():
                    k, rest = divmod(n, length)
                    crc = [zlib.crc32(data[at + i * 4 * length : at + (i + 1) * 4 * length]) for i in range(k)]
                    tail = data[at + 4 * k * length : at + 4 * n]
                    rows.append((part, n, k, full, crc, rest, ranks[rest], zlib.crc32(tail), tail.tobytes()))
                    full += k
                    ranks[rest] += 1
                    at += 4 * n
                columns = list(zip(*rows, strict=True))
                columns.insert(1, docs.slice(first, len(lengths)))
                first += len(lengths)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "part int, doc_id long, doc_tokens long, n_full long, full_before long, full_crc array<long>, tail_len int, tail_rank long, tail_crc long, tail binary")


def pack(docs: DataFrame, *, length: int = LENGTH, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = written(_cut_ids(docs, length, end_id, tokenizer or tokens.default_path()))
    sums = written(cut.groupBy("part", "tail_len").agg(F.count("*").alias("n"), F.sum("n_full").alias("k")))
    # At most `length` rows; ranks of a length and full windows are numbered through over the parts.
    by_length = {r["tail_len"]: r for r in sums.groupBy("tail_len").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect()}
    histogram = np.zeros(length, np.int64)
    for n, r in by_length.items():
        histogram[n] = r["n"] if n else 0
    full_total = sum(r["k"] for r in by_length.values())
    plan = plan_packing(histogram)
    taken = np.zeros(length, np.int64)
    for combo, times in plan:
        for n in combo:
            taken[n] += times
    spare = histogram - taken

    parts = sums.groupBy("part").agg(F.sum("k").alias("k"))
    fulls = parts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("full_base"))  # a row a task
    ranks = sums.select("part", "tail_len", (F.sum("n").over(Window.partitionBy("tail_len").orderBy("part")) - F.col("n")).alias("rank_base"))
    bases = written(ranks.join(fulls, "part"))
    # Spare ranks are the first of a length, so they lie in its first parts: at most `length` rows.
    few = F.element_at(F.array(*map(F.lit, spare.tolist())), F.col("tail_len") + 1)
    until = {r["tail_len"]: r["part"] for r in bases.where(F.col("rank_base") < few).groupBy("tail_len").agg(F.max("part").alias("part")).collect()}
    reach = F.element_at(F.array(*[F.lit(until.get(n, -1)) for n in range(length)]), F.col("tail_len") + 1)
    may_be_spare = (F.col("part") <= reach) & (F.col("tail_rank") < few)
    rank = F.col("rank_base") + F.col("tail_rank")

    def ranked(rows: DataFrame, which: Column, tail: Column) -> DataFrame:
        columns = ["doc_id", "doc_tokens", (F.col("full_base") + F.col("full_before")).alias("first"), "full_crc", "tail_len", rank.alias("rank"), "tail_crc", tail.alias("tail")]
        return rows.join(bases, ["part", "tail_len"]).where(which).select(*columns)

    placed = ranked(cut.drop("tail"), rank >= few, F.lit(None).cast("binary")).unionByName(ranked(cut.where(may_be_spare), rank < few, F.col("tail")))

    # slots[n]: for each use of tails of length n in the plan, how many ranks it takes and where they go.
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used, sequence = spare.copy(), full_total
    for combo, times in plan:
        at = 0
        for n in combo:
            slots.setdefault(n, []).append((int(used[n]), sequence, at))
            used[n] += times
            at += n
        sequence += times
    spare_start = np.concatenate(([0], np.cumsum(spare * np.arange(length))))[:-1].tolist()
    spare_total = int((spare * np.arange(length)).sum())
    last = spare_total // length * length
    borders = []  # in the last window, at falling powers of two
    rest, at = spare_total - last, last
    for k in reversed(range(length.bit_length())):
        if rest >> k & 1:
            at += 1 << k
            borders.append(at)
    spares, starts = spare.tolist(), {n: np.array([s[0] for s in v]) for n, v in slots.items()}
    first_spare = sequence

    def spread(g: int, n: int) -> list[tuple[int, int, int]]:
        """(length, sequence, offset) of the pieces of spare ids g to g + n."""
        out = []
        while n:
            if g < last:
                take = min(n, length - g % length)
                out.append((take, first_spare + g // length, g % length))
            else:
                i = next(i for i, b in enumerate(borders) if g < b)
                begin = borders[i - 1] if i else last
                take = min(n, borders[i] - g)
                out.append((take, first_spare + last // length + i, g - begin))
            g, n = g + take, n - take
        return out

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            rows: list[tuple] = []
            columns = [batch[c].to_pylist() for c in ("doc_id", "doc_tokens", "first", "full_crc", "tail_len", "rank", "tail_crc", "tail")]
            for doc, total, first, crcs, n, rank, tail_crc, tail in zip(*columns, strict=True):
                for i, crc in enumerate(crcs):
                    rows.append((doc, i * length, length, crc, total, first + i, 0))
                begin = total - n
                if n and rank >= spares[n]:
                    begin_rank, seq, offset = slots[n][int(np.searchsorted(starts[n], rank, "right")) - 1]
                    rows.append((doc, begin, n, tail_crc, total, seq + rank - begin_rank, offset))
                elif n:
                    done = 0
                    for size, seq, offset in spread(spare_start[n] + rank * n, n):
                        rows.append((doc, begin + done, size, zlib.crc32(tail[4 * done : 4 * (done + size)]), total, seq, offset))
                        done += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names)

    return placed.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
