"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts are made by Spark over all rows with a language; the log-probability matrix (buckets x languages, at most
CELLS numbers) is broadcast. The texts of a batch are scored together: their n-grams are the rows of one sparse matrix of
counts (a row a text, a column a bucket), which is multiplied by the matrix in numpy.

Rows: a text that is null, empty or without any letter gets `und` with score 0; if no row can be learnt from, every
row does. A text of any length is scored whole, in parts. Ties go to the first language in order. Repeated rows count as
often as they occur. An empty table gives no rows; columns besides those named are kept, whatever their names (lang_pred
and score are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pieces_of, unused

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Bound on the broadcast matrix. More languages share fewer buckets; beyond CELLS / LEAST_BUCKETS of them learning fails.
CELLS = 1 << 24
LEAST_BUCKETS = 1 << 10
#: Characters that are hashed at once; bounds the memory of a batch and of a very long text.
BLOCK = 1 << 19
UNDETERMINED = "und"


def _parts(texts: list[str], overlap: int) -> Iterator[tuple[list[str], list[int]]]:
    """Texts in parts of about BLOCK characters, with the number of the text of each; a text that is cut goes on with the
    n-grams that begin in its next part."""
    held, owners, size = [], [], 0
    for i, text in enumerate(texts):
        text = text.lower()
        for at in range(0, max(len(text), 1), BLOCK):
            piece = text[at : at + BLOCK + overlap]
            held.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= BLOCK:
                yield held, owners
                held, owners, size = [], [], 0
    if held:
        yield held, owners


def ngram_rows(texts: list[str], orders: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(texts, buckets): for every n-gram of the texts, in lower case, the number of its text (ascending within a part and
    an order) and its bucket."""
    widest = max(orders)
    for pieces, owners in _parts(texts, widest - 1):
        codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        lengths = np.array([len(p) for p in pieces])
        owner = np.repeat(np.array(owners, np.int32), lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters up to the end of the piece
        # What begins in the overlap is counted in the next part.
        own = np.repeat(np.minimum(lengths, BLOCK), lengths) > np.repeat(lengths, lengths) - left
        h = np.zeros(len(codes), np.uint64)
        for n in range(1, widest + 1):
            h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
            if n in orders and len(h):
                whole = (left[: len(h)] >= n) & own[: len(h)]
                mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield owner[: len(h)][whole], ((mixed >> np.uint64(40)).astype(np.int32) % np.int32(buckets))[whole]


def sparse_product(rows: np.ndarray, columns: np.ndarray, matrix: np.ndarray, out: np.ndarray) -> None:
    """Adds to out the product of a sparse matrix of counts, given by its entries (rows ascending), with a dense one."""
    at_once = max(1, CELLS // 2 // matrix.shape[1])
    for at in range(0, len(rows), at_once):
        own = rows[at : at + at_once]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        out[own[starts]] += np.add.reduceat(matrix[columns[at : at + at_once]], starts, axis=0, dtype=np.float64)


def ngram_counts(docs: DataFrame, *, orders=ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """lang, bucket, n and the number of rows (bucket -1) over all rows with text and language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}

        def emit() -> pa.RecordBatch:
            langs, ids, n = [], [], []
            for lang, have in sums.items():
                at = np.flatnonzero(have)
                langs += [lang] * (len(at) + 1)
                ids += [-1, *at.tolist()]
                n += [rows[lang], *have[at].tolist()]
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ids, pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])

        for batch in batches:
            done, langs_of = 0, batch["lang"].to_pylist()
            for part in pieces_of(batch["text"]):
                texts: dict[str, list[str]] = {}
                for text in part.to_pylist():
                    texts.setdefault(langs_of[done], []).append(text)
                    done += 1
                for lang, own in texts.items():
                    if lang not in sums:
                        if len(sums) >= 256:  # keeps a worker's memory bounded whatever the column holds
                            yield emit()
                            sums.clear()
                            rows.clear()
                        sums[lang], rows[lang] = np.zeros(buckets, np.int64), 0
                    rows[lang] += len(own)
                    for _, h in ngram_rows(own, orders, buckets):
                        sums[lang] += np.bincount(h, minlength=buckets)
        yield emit()

    known = docs.where("text is not null and lang is not null").select("lang", "text")
    return known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, *, orders=ORDERS, buckets: int = BUCKETS, smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """languages, log priors, log probabilities (buckets x languages). Collects at most CELLS rows."""
    kinds = docs.where("text is not null and lang is not null").select("lang").distinct().limit(CELLS // LEAST_BUCKETS + 1).count()
    if kinds > CELLS // LEAST_BUCKETS:
        raise ValueError(f"more than {CELLS // LEAST_BUCKETS} languages")
    while buckets * kinds > CELLS:
        buckets //= 2
    table = ngram_counts(docs, orders=orders, buckets=buckets).toPandas()
    langs = sorted(table["lang"].unique().tolist())
    place = {lang: i for i, lang in enumerate(langs)}
    prior, counts = np.zeros(len(langs)), np.zeros((buckets, len(langs)))
    column = table["lang"].map(place).to_numpy(int)
    bucket, n = table["bucket"].to_numpy(int), table["n"].to_numpy(float)
    prior[column[bucket < 0]] = n[bucket < 0]
    counts[bucket[bucket >= 0], column[bucket >= 0]] = n[bucket >= 0]
    counts += smoothing
    return langs, np.log(prior / max(prior.sum(), 1)), np.log(counts / counts.sum(axis=0))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], *, orders=ORDERS) -> DataFrame:
    """All columns of docs, then lang_pred and score (the posterior probability of lang_pred)."""
    langs, prior, logp = model
    logp = logp.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((langs, prior, logp))

    text_name = unused(docs, "text_to_score")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, logp = shared.value
        for batch in batches:
            best, scores = [UNDETERMINED] * batch.num_rows, [0.0] * batch.num_rows
            before = 0
            for part in pieces_of(batch[text_name]):
                texts, first_row = part.to_pylist(), before
                before += len(texts)
                known = [i for i, t in enumerate(texts) if langs and t and any(map(str.isalpha, t))]
                if not known:
                    continue
                total = np.tile(prior, (len(known), 1))
                for rows, columns in ngram_rows([texts[i] for i in known], orders, len(logp)):
                    sparse_product(rows, columns, logp, total)
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                first = np.argmax(odds, axis=1)
                for i, k, p in zip(known, first.tolist(), (odds.max(axis=1) / odds.sum(axis=1)).tolist(), strict=True):
                    best[first_row + i], scores[first_row + i] = langs[k], p
            keep = batch.drop_columns([text_name]) if batch.num_columns > 1 else batch.select([])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(best, pa.string()), pa.array(scores, pa.float64())], [*keep.schema.names, "lang_pred", "score"])

    columns = [docs[f"`{c}`"] for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*columns, F.col("text").alias(text_name))
    out = docs.select(*columns, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(score, out)
