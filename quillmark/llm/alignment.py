"""Alignment of two tokenizers' ids over the same bytes, by whitespace-token anchors.

A text is tokenised in full by both: a space and the text by a byte-level BPE (A), the text by a sentencepiece model
whose dummy prefix is that space (B). Byte offsets where tokens of both end are shared ends; those before a token that
starts with a space in both are anchors, which split a document into windows of ids, about a word each. A window's
groups (cuts at its shared ends) and links (A-B pairs of tokens whose bytes overlap) depend on its ids alone: within a
slice of some SLICE_BYTES of text each distinct window, told by its ids, is aligned once and the result taken for all.

Links are counted over all documents in two passes. Tasks work on parts of some PART_BYTES of text. A part writes a row a
document, with the pairs it holds, and one row with the part's distinct id pairs, each with its number of documents
there: so a pair is shuffled once a part, however many documents hold it, and no pair is hot. The pairs' counts over the
corpus come back to their parts, where they are summed over each document's pairs.

Rows: texts that are null, empty, or whose tokens' bytes differ from the space and the text in A or B have no tokens
(zeros and ''). Strings that name special tokens are plain text. Texts of any length are aligned whole, each alone if it
is long. Repeated rows are documents of their own, a null doc_id is kept, columns besides doc_id and text are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from ._common import pieces_of, written

#: Bytes of texts whose pairs are counted together before they are shuffled.
PART_BYTES = 16 << 20
#: Bytes of texts that are tokenised together (a longer text is alone).
SLICE_BYTES = 4 << 20
#: Bound on the bytes of a generation of memoised words of B; a worker holds two at most.
PIECE_BYTES = 32 << 20
MARK = "▁"
_DOCS = "part string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, linked binary, times binary"
_PARTS = "pairs array<long>, held array<long>"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class PlainBpe(tokens.ByteBpe):
    """A byte-level BPE for which the names of special tokens are plain text."""

    _loaded: dict[str, "PlainBpe"] = {}

    def __init__(self, path: str):
        super().__init__(path)
        self.special = []

    def token_bytes(self) -> pa.Array:
        hidden = {c: b for b, c in self.visible.items()}
        by_id = {i: piece for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        return pa.array([bytes(hidden[c] for c in by_id.get(i, "")) for i in range(1 + max(by_id))], pa.large_binary())

    def spaced(self, pieces: list[str]) -> list[bytes | None]:
        return list(map(self._spaced, pieces))


class Pieces:
    """A sentencepiece model. Where no piece has a mark behind another character, no merge goes over a single space
    between other characters, and a text's words may be encoded one by one, each distinct word once."""

    _loaded: dict[str, "Pieces"] = {}

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_words = not any(MARK in name.lstrip(MARK) for name in names)
        self.names = names
        self.memo = tokens.Generations(None, PIECE_BYTES)

    @classmethod
    def load(cls, path: str) -> "Pieces":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def token_bytes(self) -> pa.Array:
        out = []
        for i, name in enumerate(self.names):
            out.append(bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else name.replace(MARK, " ").encode())
        return pa.array(out, pa.large_binary())

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self.model.encode(texts, out_type=int, num_threads=1)]

    def spaced(self, pieces: list[str]) -> list[bytes | None]:
        """The ids of a mark and each piece; None for pieces that don't stand for themselves."""
        if not self.by_words:
            return [None] * len(pieces)
        memo = self.memo
        new = [p for p in pieces if p and p not in memo and p not in memo.old and MARK not in p]
        fresh = dict(zip(new, self.encode(new), strict=True))
        memo.make = lambda p: fresh[p] if p in fresh else self.encode([p])[0]  # the latter if it fell out meanwhile
        return [None if not p or MARK in p else memo[p] for p in pieces]


def encode_spaced(texts: pa.Array, makers: list[tuple[Callable, Callable]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per maker, the ids of a space and each text end to end, and how many each text has. A maker is (ids of a space and
    each of some pieces, None for pieces that can't stand alone; ids of a space and a whole text)."""
    lists = pc.split_pattern(texts, " ")
    starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    coded = pc.dictionary_encode(lists.flatten())
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    out = []
    for spaced, whole_text in makers:
        made = spaced(distinct)
        codes = coded.indices.to_numpy(zero_copy_only=False).copy()
        odd = np.array([m is None for m in made], bool)[codes]
        whole = np.add.reduceat(odd, starts, dtype=np.int64) > 0
        if whole.any():
            codes[np.repeat(whole, np.diff(np.append(starts, len(codes))))] = len(made)
            at = np.flatnonzero(whole)
            codes[starts[at]] = len(made) + 1 + np.arange(len(at))
            made = [*made, b"", *(whole_text(texts[i].as_py()) for i in at.tolist())]
        every = pa.array(made, pa.large_binary()).take(pa.array(codes))
        _, ends, data = every.buffers()
        at = np.frombuffer(ends, np.int64, len(codes) + 1)
        ids = np.frombuffer(data, "<u4", int(at[-1]) // 4) if at[-1] else np.zeros(0, "<u4")
        out.append((ids, np.diff(np.append(at[starts], at[-1])) // 4))
    return out


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of 32-bit ids as binary values."""
    borders = np.concatenate(([0], 4 * ends)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(values, "<u4"))])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs that start at `starts`, run after run."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class Aligner:
    _loaded: dict[tuple[str, str], "Aligner"] = {}

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = PlainBpe.load(path_a), Pieces.load(path_b)
        self.bytes_a, self.bytes_b = self.a.token_bytes(), self.b.token_bytes()
        self.sizes_a, self.sizes_b = (pc.binary_length(t).to_numpy().astype(np.int64) for t in (self.bytes_a, self.bytes_b))
        self.spaced_a, self.spaced_b = (np.array([t[:1] == b" " for t in table.to_pylist()], bool) for table in (self.bytes_a, self.bytes_b))
        # An id as text with what follows it: within A's or B's ids, behind the last of A's, behind the last of a group.
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.decimals = pa.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(most)], pa.large_binary())
        self.most = most
        self.makers = [(self.a.spaced, lambda t: self.a.encode(" " + t)), (self.b.spaced, lambda t: self.b.encode([t])[0])]

    @classmethod
    def load(cls, path_a: str, path_b: str) -> "Aligner":
        if (path_a, path_b) not in cls._loaded:
            cls._loaded[path_a, path_b] = cls(path_a, path_b)
        return cls._loaded[path_a, path_b]

    def windows(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of windows that lie end to end, with the numbers of their tokens: the linked pairs (a << 32 | b) of all and how
        many each window has, how many groups each has, and their text (each group followed by ;)."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        of_a, of_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        # Whichever token ends first (or both) is done with, as when two sorted lists are merged: a link for each
        # distinct end of either, from the token of A to the token of B that reach it.
        ends = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        pairs, n_links = a[at_a] << 32 | b[at_b], np.bincount(of_a[at_a], minlength=len(n_a))
        last_a, last_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        shown = np.concatenate((a + self.most * last_a, b + 2 * self.most * last_b))
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        text = self.decimals.take(pa.array(shown[order]))
        borders = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)[np.concatenate(([0], np.cumsum(n_a + n_b)))]
        rows = pa.Array.from_buffers(pa.large_binary(), len(n_a), [None, pa.py_buffer(np.ascontiguousarray(borders)), text.buffers()[2]])
        return pairs, n_links, np.bincount(of_b[last_b], minlength=len(n_a)), rows

    def tokenised(self, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Which texts have tokens, and their ids and lengths by A and by B (of those texts alone)."""
        coded = encode_spaced(texts, self.makers)
        spaced = pc.binary_join_element_wise("", texts, " ").cast(pa.large_binary())
        _, ends, data = spaced.buffers()
        want = np.frombuffer(ends, np.int64, len(texts) + 1, spaced.offset * 8)
        good = np.diff(want) > 1
        for (ids, lengths), table in zip(coded, (self.bytes_a, self.bytes_b), strict=True):
            made = table.take(pa.array(ids))
            at = np.frombuffer(made.buffers()[1], np.int64, len(ids) + 1)[np.concatenate(([0], np.cumsum(lengths)))] if len(ids) else np.zeros(len(texts) + 1, np.int64)
            good &= np.diff(at) == np.diff(want)
            own, whole = memoryview(made.buffers()[2] or b""), memoryview(data)
            if np.array_equal(at, want) and own == whole[want[0] : want[-1]]:
                continue
            for i in np.flatnonzero(good).tolist():
                good[i] = own[at[i] : at[i + 1]] == whole[want[i] : want[i + 1]]
        ids = [i if good.all() else i[np.repeat(good, n)] for i, n in coded]
        return good, ids, [n[good] for _, n in coded]


class Part:
    """What the documents of a part share: their pairs and the number of documents that hold each."""

    def __init__(self, aligner: Aligner, name: str):
        self.aligner, self.name, self.size = aligner, name, 0
        self.pairs: dict[int, int] = {}
        self.held = np.zeros(1024, np.int64)

    def add(self, texts: pa.Array) -> dict[str, list | np.ndarray]:
        """The columns of a slice's documents."""
        al, n = self.aligner, len(texts)
        good, (ids_a, ids_b), (n_a, n_b) = al.tokenised(texts)
        out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")} | {c: [v] * n for c, v in (("groups_sha256", ""), ("linked", b""), ("times", b""))}
        if not good.any():
            return out
        ends_a, ends_b = np.cumsum(al.sizes_a[ids_a]), np.cumsum(al.sizes_b[ids_b])
        at_a, at_b = np.zeros(ends_a[-1] + 1, bool), np.zeros(ends_a[-1] + 1, bool)
        at_a[ends_a], at_b[ends_b] = True, True
        # Both next tokens start at a shared end; every document starts with a space, so its border is an anchor.
        to_a = np.flatnonzero(at_b[ends_a] & np.append(al.spaced_a[ids_a[1:]], True)) + 1
        to_b = np.flatnonzero(at_a[ends_b] & np.append(al.spaced_b[ids_b[1:]], True)) + 1
        # Windows are told apart by their ids; each distinct one is aligned once.
        codes = [pc.dictionary_encode(_cut(ids, to)).indices.to_numpy(zero_copy_only=False).astype(np.int64) for ids, to in ((ids_a, to_a), (ids_b, to_b))]
        _, where, window = np.unique(codes[0] << 32 | codes[1], return_index=True, return_inverse=True)
        sizes_a, sizes_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        own_a, own_b = sizes_a[where], sizes_b[where]
        pairs, n_links, n_groups, shown = al.windows(ids_a[_ranges(to_a[where] - own_a, own_a)], own_a, ids_b[_ranges(to_b[where] - own_b, own_b)], own_b)

        doc = np.flatnonzero(good)
        of = np.searchsorted(np.cumsum(n_a), to_a - 1, "right")  # a window's document, among those with tokens
        out["n_a"][doc], out["n_b"][doc] = n_a, n_b
        links = n_links[window]
        borders = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(doc)))))
        out["n_groups"][doc], out["n_links"][doc] = (np.add.reduceat(x, borders[:-1]) for x in (n_groups[window], links))
        text = shown.take(pa.array(window))
        at = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)[borders].tolist()
        data = memoryview(text.buffers()[2])

        # Each document's distinct pairs, and how often it has each.
        distinct, number = np.unique(pairs, return_inverse=True)
        known = self.pairs
        of_part = np.array([known.setdefault(p, len(known)) for p in distinct.tolist()], np.int64)
        linked = of_part[number][_ranges((np.cumsum(n_links) - n_links)[window], links)]
        held, times = np.unique(np.repeat(of, links) << 32 | linked, return_counts=True)
        linked, cuts = held & 0xFFFFFFFF, np.searchsorted(held >> 32, np.arange(len(doc) + 1)).tolist()
        linked_bytes, times_bytes = linked.astype("<u4"), times.astype("<u4")
        for k, i in enumerate(doc.tolist()):
            out["groups_sha256"][i] = hashlib.sha256(data[at[k] : at[k + 1] - 1]).hexdigest()
            out["linked"][i] = linked_bytes[cuts[k] : cuts[k + 1]].tobytes()
            out["times"][i] = times_bytes[cuts[k] : cuts[k + 1]].tobytes()
        if len(self.held) < len(known):
            self.held = np.concatenate((self.held, np.zeros(len(known), np.int64)))
        self.held += np.bincount(linked, minlength=len(self.held))
        return out


def _written_parts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The rows of documents, and a row of each part with its pairs (doc_id and what follows it null)."""
    columns = [(f.split()[0], f.split()[1]) for f in f"{_DOCS}, {_PARTS}".split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(c, kinds[t]) for c, t in columns])

    def rows(n: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task, count = Aligner.load(path_a, path_b), TaskContext.get().partitionId(), 0
        part: Part | None = None

        def closed(part: Part) -> pa.RecordBatch:
            pairs = np.fromiter(part.pairs, np.int64, len(part.pairs))
            return rows(1, part=[part.name], pairs=[pairs], held=[part.held[: len(pairs)]])

        for batch in batches:
            first = 0
            for texts in pieces_of(batch["text"], SLICE_BYTES):
                if part is None:
                    part, count = Part(aligner, f"{task}-{count}"), count + 1
                made = part.add(texts)
                part.size += texts.nbytes
                yield rows(len(texts), part=[part.name] * len(texts), doc_id=batch["doc_id"].slice(first, len(texts)), **made)
                first += len(texts)
                if part.size >= PART_BYTES:
                    yield closed(part)
                    part = None
        if part is not None:
            yield closed(part)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return written(source.mapInArrow(run, f"{_DOCS}, {_PARTS}"))


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The unsigned 32-bit numbers in all values end to end, and how many each value has."""
    sizes = pc.binary_length(column).to_numpy() // 4
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").astype(np.int64), sizes


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs of these sizes."""
    total, ends = np.concatenate(([0], np.cumsum(values))), np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def align(docs: DataFrame, *, tokenizer: str | None = None, pieces: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    parts = _written_parts(docs, tokenizer or tokens.default_path(), pieces or public_tokenizers.path("piece_bpe_32k.model"))
    listed = parts.where("pairs is not null").select("part", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "p")).select("part", "at", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    counts = listed.groupBy("pair").agg(F.sum("held").alias("count"))
    # An A id has at most as many pairs as B has ids.
    highest = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    counts = counts.select("pair", "count", (F.col("count") == highest).alias("best"))
    looked_up = listed.select("part", "at", "pair").join(counts, "pair").select(F.col("part").alias("of"), "at", "count", "best")
    schema = pa.schema([(c, pa.string() if t == "string" else pa.int64()) for c, t in (f.split() for f in _OUT.split(", "))])

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: the documents of a part, right: the counts of its pairs."""
        if not left.num_rows:
            return schema.empty_table()
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        at = right["at"].to_numpy()
        count[at], best[at] = right["count"].to_numpy(), right["best"].to_numpy()
        linked, sizes = _numbers(left["linked"])
        times, _ = _numbers(left["times"])
        made = {"count_sum": _sums(count[linked] * times, sizes), "n_best": _sums(best[linked] * times, sizes)}
        return pa.table([made.get(f.name, left[f.name] if f.name in left.column_names else None) for f in schema], schema=schema)

    documents = parts.where("pairs is null").drop("pairs", "held")
    return documents.groupBy("part").cogroup(looked_up.groupBy("of")).applyInArrow(gather, _OUT)
