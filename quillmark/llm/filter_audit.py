"""How filters interact: what each removes, and would have removed, in every order of application.

A document that fails a set of filters survives the subsets that share none with it. Its truth-table word has a bit for
each of the 32 subsets, set where it survives. Words of a part and label are added up bit by bit by carry-save
adders (three words give their sums and their carries, until few are left at each weight), which yields the survivors of
every subset; all counts of all 120 orders follow from those 32 numbers.

Filters on a document's whole text: A under 200 words; B fewer than half of the words distinct; C over 3 % capital
letters; D one of #$%&*|; E identical to the text of a smaller doc_id.

Rows: a null text counts as empty (it fails A); texts of any length are judged whole; of rows that repeat a doc_id and a
text none copies the other; a null doc_id is neither smaller nor larger than any, so its row never fails E and makes no
other row fail it, and has no label; a document with several labels has one if any row says so; a null lang is the part '',
like an empty one; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: White space between words: space and the controls from tab to carriage return.
_SPACES = "\t\n\x0b\x0c\r "
#: Bit s of WORDS[f] is set if a document that fails the filters in f survives those in s.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & f) for f in range(SUBSETS)], np.uint32)
_OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set, by carry-save addition of whole words."""
    total = np.zeros(32, np.int64)
    level, weight = words.astype(np.uint32), 1
    while len(level):
        carries = []
        while len(level) > 2:
            n = len(level) // 3
            a, b, c, rest = level[:n], level[n : 2 * n], level[2 * n : 3 * n], level[3 * n :]
            half = a ^ b
            carries.append(a & b | half & c)
            level = np.concatenate((half ^ c, rest))
        total += weight * np.unpackbits(level.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        level, weight = np.concatenate(carries) if carries else np.zeros(0, np.uint32), 2 * weight
    return total


def own_failures(text: Column) -> Column:
    """Bits 0 to 3 for the filters A to D, which look at nothing but the text (not null)."""
    trimmed = F.btrim(text, F.lit(_SPACES))
    words = F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    # Bound as a lambda variable, so that a text is split once.
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def bits(s: Column) -> Column:
        tests = (s["n"] < 200, 100 * s["distinct"] < 50 * s["n"], 100 * capitals.cast("long") > 3 * F.length(text), text.rlike("[#$%&*|]"))
        return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))

    return F.transform(F.array(sizes), bits)[0]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of FILTERS), good, toxic: a row a document."""
    text = F.coalesce("text", F.lit(""))
    judged = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
            own_failures(text).alias("own"), F.unhex(F.sha2(text, 256)).alias("copy"),
        )
    )
    named = judged.where("doc_id is not null")
    # One row a text; it meets the row of its doc_id, so that copies of one text are spread by their ids.
    first = named.groupBy("copy").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    found = named.join(first, ["copy", "doc_id"], "left").join(marks, "doc_id", "left")
    false = F.lit(False)
    out = found.select("part", F.when(F.col("first"), F.col("own")).otherwise(F.col("own") + 16).alias("fails"), F.coalesce("good", false).alias("good"), F.coalesce("toxic", false).alias("toxic"))
    return out.unionByName(judged.where("doc_id is null").select("part", F.col("own").alias("fails"), false.alias("good"), false.alias("toxic")))


def survivors(failed: DataFrame) -> DataFrame:
    """part, every, good, toxic: per part the survivors of each of the 32 subsets, of all documents and by label."""
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pc.dictionary_encode(batch["part"])
            of = parts.indices.to_numpy(zero_copy_only=False)
            words = WORDS[batch["fails"].to_numpy()]
            labels = [np.ones(len(of), bool), *(batch[c].to_numpy(zero_copy_only=False) for c in ("good", "toxic"))]
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(len(parts.dictionary) + 1))
            groups = [order[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
            columns = [pa.array([positional_counts(words[g[label[g]]]) for g in groups], kind) for label in labels]
            yield pa.RecordBatch.from_arrays([parts.dictionary, *columns], ["part", "every", "good", "toxic"])

    counted = failed.mapInArrow(run, "part string, every array<long>, good array<long>, toxic array<long>")
    sums = [F.array(*[F.sum(F.col(c)[s]) for s in range(SUBSETS)]).alias(c) for c in ("every", "good", "toxic")]
    return counted.groupBy("part").agg(*sums)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    orders = list(permutations(range(len(FILTERS))))
    steps = [(k, i, o[i], sum(1 << f for f in o[:i]), sum(1 << f for f in o[: i + 1])) for k, o in enumerate(orders) for i in range(len(o))]
    order, step, own, before, after = np.array(steps).T
    names = ["".join(FILTERS[f] for f in o) for o in orders]
    full = SUBSETS - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, *lists in zip(batch["part"], *(batch[c].to_pylist() for c in ("every", "good", "toxic")), strict=True):
                n, good, toxic = (np.array(v, np.int64) for v in lists)
                removed = n[before] - n[after]
                fails = n[0] - n[1 << own]
                shapley = np.zeros(len(FILTERS), np.int64)
                np.add.at(shapley, own, removed)
                columns = (
                    [part.as_py()] * len(own), [names[k] for k in order], step + 1, n[after], removed, fails - removed,
                    n[full & ~(1 << own)] - n[full], good[before] - good[after], toxic[before] - toxic[after], shapley[own],
                )
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in _OUT.split(", ")])

    return survivors(failures(docs, labels)).mapInArrow(run, _OUT)
