"""Toxicity: embeddings of subwords averaged into a linear softmax, trained jointly in numpy.

A word's subwords are the hashed character n-grams of its marked form, so a misspelling that was never seen shares
most vectors with the word it stands for. Vectors are averaged over a window of words, the softmax gives the window's
probability, and a text is as toxic as its worst window, so that length does not dilute it. As labels belong to
texts, each step learns from the worst window of a toxic text and from the worst few of a clean one.

Because softmax and average are linear, a trained model gives each word a logit and each window the mean of those of
its words' subwords: scoring needs one memoised number pair a word.

Learning uses at most SAMPLE labelled texts of SAMPLE_CHARS together, the ones whose hashed doc_id is smallest. Rows: a null or empty text, or
one without words, is scored by the bias alone; if nothing can be learnt the score is 0; repeated rows get equal
scores; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import give_back, unused

#: Bound on labelled texts to learn from.
SAMPLE = 6000
#: Bound on the characters of those texts together; texts beyond it are not learnt from, none is cut.
SAMPLE_CHARS = 100_000_000
BUCKETS = 1 << 17
DIMS = 8
GRAMS = (3, 4, 5)
WINDOW = 3
#: Windows of a clean text that a step learns from, and by how much each weighs less.
CLEAN_WINDOWS = 4
CLEAN_SHARE = 2.0
#: Subwords of fewer labelled texts are not learnt: they would only name single texts.
MIN_TEXTS = 6
#: Bounds on the memo of chunks: entries, and characters of a chunk that is kept.
CACHE_ENTRIES = 150_000
LONGEST_CHUNK = 40
#: Texts, and new words, that are worked on together.
TEXTS_AT_ONCE = 256
WORDS_AT_ONCE = 50_000
_WORD = re.compile(r"[^\W_]+")


def word_grams(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, places): hashed character n-grams of all marked words at once, and the place of each gram's word. The
    marked word itself is one more gram."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(lengths)
    place = np.repeat(np.arange(len(words)), lengths)
    left = ends[place] - np.arange(len(codes))  # characters up to the end of the word
    mixed = (codes + (left.astype(np.uint64) << np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    hashes, owners = [np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), ends - lengths)], [np.arange(len(words))]
    rolled = codes
    for n in range(2, max(GRAMS) + 1):
        rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if n in GRAMS:
            whole = np.flatnonzero(left[: len(rolled)] >= n)
            hashes.append(rolled[whole] + np.uint64(n))
            owners.append(place[whole])
    h = np.concatenate(hashes)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(33)).astype(np.int64) % buckets, np.concatenate(owners)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Model:
    """Subword vectors, softmax weights and bias; grams (logit, number of subwords) of a word."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: float):
        self.logits = vectors @ weights
        self.bias = float(bias)
        self.memo: dict[str, list[tuple[float, float]]] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def pairs(self, chunks: list[str]) -> list[list[tuple[float, float]]]:
        """(sum of subword logits, number of subwords) of each word of texts without white space."""
        lists = [words_of(c) for c in chunks]
        words = [w for found in lists for w in found]
        pairs: list[tuple[float, float]] = []
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at : at + WORDS_AT_ONCE]
            buckets, places = word_grams(part, len(self.logits))
            sums, sizes = np.bincount(places, self.logits[buckets], len(part)), np.bincount(places, minlength=len(part))
            pairs += zip(sums.tolist(), sizes.tolist(), strict=True)
        ends = np.cumsum([len(found) for found in lists]).tolist()
        return [pairs[end - len(found) : end] for end, found in zip(ends, lists, strict=True)]

    def score_all(self, texts: list[str | None]) -> list[float]:
        """For each text the probability of its worst window; windows start at each half window."""
        parts = [(t or "").lower().split() for t in texts]
        new = [c for c in set().union(*parts) if c not in self.memo]
        if len(self.memo) + len(new) > CACHE_ENTRIES:
            self.memo.clear()
            new = list(set().union(*parts))
        new.sort()
        held = dict(zip(new, self.pairs(new), strict=True))
        out = []
        for part in parts:
            pairs = [pair for chunk in part for pair in (held[chunk] if chunk in held else self.memo[chunk])]
            worst = 0.0
            if pairs:
                flat = np.array(pairs)
                worst = float(window_means(flat[:, 0], flat[:, 1]).max())
            out.append(float(1 / (1 + np.exp(-np.clip(worst + self.bias, -60, 60)))))
        self.memo.update((c, p) for c, p in held.items() if len(c) <= LONGEST_CHUNK)
        return out

    def score(self, text: str | None) -> float:
        return self.score_all([text])[0]


def window_starts(n: int) -> np.ndarray:
    return np.arange(0, max(1, n - WINDOW // 2), WINDOW // 2)


def window_means(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    starts = window_starts(len(sums))
    ends = np.minimum(starts + WINDOW, len(sums))
    a, b = np.concatenate(([0.0], np.cumsum(sums))), np.concatenate(([0.0], np.cumsum(sizes)))
    return (a[ends] - a[starts]) / np.maximum(b[ends] - b[starts], 1)


def gradients(ids: list[np.ndarray], target: np.ndarray, weight: np.ndarray, vectors: np.ndarray, weights: np.ndarray, bias: float):
    """Of the weighted logistic loss of windows, given as lists of buckets: the buckets that occur and the gradient of
    each one's vector (summed over the windows), and those of weights and bias (the mean over the windows)."""
    n = np.array([len(x) for x in ids])
    rows, cols = np.repeat(np.arange(len(ids)), n), np.concatenate(ids)
    mean = np.add.reduceat(vectors[cols], np.concatenate(([0], np.cumsum(n)[:-1]))) / n[:, None]
    p = 1 / (1 + np.exp(-np.clip(mean @ weights + bias, -60, 60)))
    error = (p - target) * weight
    touched, where = np.unique(cols, return_inverse=True)
    gradient = np.zeros((len(touched), vectors.shape[1]))
    np.add.at(gradient, where, (error / n)[rows][:, None] * weights)
    return touched, gradient, error @ mean / len(ids), error.sum() / len(ids)


def fit(texts: list[str], labels: list[int], *, buckets: int = BUCKETS, dims: int = DIMS, epochs: int = 8, rate: float = 0.3, seed: int = 7) -> Model | None:
    """Joint training of vectors and softmax by Adagrad over the chosen windows."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dims, 1 / dims, (buckets, dims))
    weights, bias = rng.normal(0, 1, dims), 0.0
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int32) for t in texts]
    every, flats, counts = list(vocabulary), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(every), WORDS_AT_ONCE):  # in parts: the arrays of all words at once are large
        hashed, owners = word_grams(every[at : at + WORDS_AT_ONCE], buckets)
        flats.append(hashed[np.argsort(owners, kind="stable")].astype(np.int32))
        counts.append(np.bincount(owners))
    flat, sizes = np.concatenate(flats), np.concatenate(counts)
    del vocabulary, every, flats
    begin = np.concatenate(([0], np.cumsum(sizes)))
    texts_of = np.zeros(buckets, np.int64)
    for d in docs:
        own = np.unique(d)
        if len(own):
            texts_of[np.unique(np.concatenate([flat[begin[w] : begin[w + 1]] for w in own]))] += 1
    rare = texts_of < MIN_TEXTS
    vectors[rare] = 0
    seen_v, seen_w, seen_b = np.full(buckets, 1e-6), np.full(dims, 1e-6), 1e-6
    order = np.arange(len(docs))
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for epoch in range(epochs):
        rng.shuffle(order)
        for chunk in np.array_split(order, max(1, len(order) // 256)):
            # One logit a word of the chunk, then the worst window of each text.
            own = np.unique(np.concatenate([docs[i] for i in chunk]))
            if not len(own):
                continue
            logits = vectors @ weights
            place = np.full(len(sizes), -1)
            place[own] = np.arange(len(own))
            at = np.concatenate([flat[begin[w] : begin[w + 1]] for w in own])
            word_sum = np.add.reduceat(logits[at], np.concatenate(([0], np.cumsum(sizes[own])[:-1])))
            picked, target, weight = [], [], []
            for i in chunk:
                if not len(docs[i]):
                    continue
                means = window_means(word_sum[place[docs[i]]], sizes[docs[i]])
                starts = window_starts(len(docs[i]))
                chosen = [int(np.argmax(means))]
                if y[i] and epoch == 0:  # nothing is known yet: all of a toxic text stands for it
                    chosen = rng.integers(0, len(starts), min(8, len(starts))).tolist()
                elif not y[i]:  # the worst windows of a clean text are the ones to learn from
                    chosen = np.argpartition(-means, min(CLEAN_WINDOWS, len(means)) - 1)[:CLEAN_WINDOWS].tolist()
                for c in chosen:
                    picked.append(docs[i][starts[c] : starts[c] + WINDOW])
                    target.append(y[i])
                    weight.append(balance[i] / (len(chosen) if y[i] else CLEAN_SHARE))
            ids = [np.concatenate([flat[begin[w] : begin[w + 1]] for w in p]) for p in picked]
            touched, gradient, grad_w, grad_b = gradients(ids, np.array(target), np.array(weight), vectors, weights, bias)
            gradient[rare[touched]] = 0
            seen_v[touched] += (gradient**2).mean(axis=1)
            vectors[touched] -= rate * gradient / np.sqrt(seen_v[touched])[:, None]
            seen_w += grad_w**2
            seen_b += grad_b**2
            weights -= rate * grad_w / np.sqrt(seen_w)
            bias -= rate * grad_b / np.sqrt(seen_b)
    return Model(vectors, weights, bias)


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model | None:
    """docs: doc_id, text; labels: doc_id, toxic. The sample is drawn from ids alone, and only its texts are read:
    at most `sample` rows are broadcast and come to the driver."""
    known = labels.where("toxic is not null").join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = known.select("doc_id", "toxic", F.xxhash64("doc_id").alias("k")).orderBy("k", "doc_id", "toxic").limit(sample)
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").orderBy("k", "text", "toxic").limit(sample)
        .withColumn("chars", F.sum(F.length("text")).over(Window.orderBy("k", "text", "toxic"))).where(F.col("chars") <= SAMPLE_CHARS).select("text", "toxic").toPandas()
    )
    texts, marks = rows["text"].tolist(), rows["toxic"].astype(int).tolist()
    del rows
    model = fit(texts, marks)
    del texts, marks
    give_back()  # what training took would stay with the driver for the stages that follow
    return model


def score(docs: DataFrame, model: Model | None, *, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those of keep), then score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_name = unused(docs, "text_to_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores: list[float] = []
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch[text_name].slice(at, TEXTS_AT_ONCE).to_pylist()
                scores += model.score_all(part) if model else [0.0] * len(part)
            keep = batch.drop_columns([text_name])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [*keep.schema.names, "score", "predicted"])

    columns = [docs[f"`{c}`"] for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    out = docs.select(*columns, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return docs.select(*columns, F.col("text").alias(text_name)).mapInArrow(run, out)
