"""Byte-pair encoding with word ends, and decoding, from a vocabulary file alone.

encode: canonical composition, white space to one space, lower case by character; words by pattern; then merges from a
priority queue of (rank, position) over a doubly linked list of symbols, where entries whose symbols have changed are
skipped. decode: the vocabulary's strings, joined as the file's (absent) decoder says. A slice of texts is cut at white
space and its pieces are numbered by Arrow, so that only its distinct pieces are looked at in Python; Arrow lays their
ids end to end and takes the strings of all ids. Words are memoised, in a memo that is bounded in bytes.

Rows: a null text counts as empty; an empty text has no ids and decodes to the empty string; a text of any length is
encoded whole, in time that grows with n log n in its longest word; repeated rows give repeated results; a null doc_id
is kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pieces_of
from .tokens import Generations, visible_bytes

#: Bound on the bytes of a generation of memoised words; a worker holds two at most.
MEMO_BYTES = 64 << 20
#: Signs that stand behind a word as one run; no letter, digit, apostrophe or white space is among them.
_MARKS = ".,;:!?%&*#$"
#: Control characters that str.split() takes for white space and the Unicode property does not.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    """A word-end BPE read from a tokenizer file."""

    _loaded: dict[str, "WordBpe"] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = {i: s for s, i in (self.vocab | self.special).items()}
        self.strings = [named.get(i, "") for i in range(1 + max(named))]
        #: What decoding puts down for each id: its string and the space behind it.
        self.spaced = pa.array([s + " " for s in self.strings], pa.large_string())
        self.four = [i.to_bytes(4, "little") for i in range(len(self.strings))]
        #: The rank of a pair of symbols, left in the bits above right, and the symbol that each rank makes.
        self.bits = len(self.strings).bit_length()
        merges = list(map(tuple, model["merges"]))
        self.ranks = {self.vocab[a] << self.bits | self.vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [self.vocab[a + b] for a, b in merges]
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        visible = visible_bytes()
        self.inner = [self.vocab[visible[b]] for b in range(256)]
        self.last = [self.vocab[visible[b] + self.end] for b in range(256)]
        self.memo = Generations(self._word, MEMO_BYTES)

    @classmethod
    def load(cls, path: str) -> "WordBpe":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, lowest rank first, leftmost first among equals."""
        n, bits, find, made_by = len(symbols), self.bits, self.ranks.get, self.made
        wide = n.bit_length()
        mask = (1 << wide) - 1
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        # The rank of the pair that begins at each place; an entry of the queue is the rank, then the place in `wide` bits.
        ranks = [find(a << bits | b, -1) for a, b in pairwise(symbols)]
        ranks.append(-1)
        queue = [r << wide | i for i, r in enumerate(ranks) if r >= 0]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            rank, i = entry >> wide, entry & mask
            if ranks[i] != rank:
                continue  # stale
            j = after[i]
            symbols[i] = made = made_by[rank]
            symbols[j] = ranks[j] = ranks[i] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := find(made << bits | symbols[k], -1)) >= 0:
                    ranks[i] = r
                    heappush(queue, r << wide | i)
            if (h := before[i]) >= 0:
                ranks[h] = r = find(symbols[h] << bits | made, -1)
                if r >= 0:
                    heappush(queue, r << wide | h)
        return [s for s in symbols if s >= 0]

    def _word(self, word: str) -> bytes:
        """Ids as bytes of one word of the pattern."""
        *data, end = word.encode("utf-8", "replace")
        inner, four = self.inner, self.four
        return b"".join([four[i] for i in self.merge([*[inner[b] for b in data], self.last[end]])])

    def normalize(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # its lower case would depend on what follows
                return "".join(map(str.lower, text))
        return text.lower()

    def _piece(self, piece: str) -> bytes:
        """Ids as bytes of a piece of text without white space."""
        text = self.normalize(piece)
        if text.isalpha():
            return self.memo[text]
        word = text.rstrip(_MARKS)
        if word.isalpha():
            return self.memo[word] + self.memo[text[len(word) :]]
        return b"".join(map(self.memo.__getitem__, self.words.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for k, part in enumerate(self.split.split(text)):
            if k % 2:
                out.append(self.four[self.special[part]])
            else:
                out += map(self._piece, part.split() if not _SEPARATORS.search(part) else _SPACE.split(part))
        return b"".join(out)

    def encode_both(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        ids = self.encode(text)
        return ids, self.decode(np.frombuffer(ids, "<u4").tolist())

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])

    def encode_all(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The ids (bytes) of many texts (null: empty), and the decoded texts."""
        texts = pc.fill_null(texts, "")
        whole = self._whole(texts)
        lists = pc.utf8_split_whitespace(pc.if_else(whole, "", texts))
        coded = pc.dictionary_encode(lists.flatten())
        codes = coded.indices.to_numpy().copy()
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()  # splitting makes a piece of any text
        made = list(map(self._piece, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        odd = texts.filter(whole).to_pylist()
        codes[starts[:-1][whole.to_numpy(zero_copy_only=False)]] = len(made) + np.arange(len(odd))
        made += map(self.encode, odd)
        _, ends, data = pa.array(made, pa.large_binary()).take(pa.array(codes)).buffers()
        ends = np.frombuffer(ends, np.int64)[starts]
        _, at, shown = self.spaced.take(pa.array(np.frombuffer(data or b"", "<u4", ends[-1] // 4))).buffers()
        at = np.frombuffer(at, np.int64)[ends // 4]
        ids, spaced = (pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(o), d]).cast(pa.binary()) for o, d in ((ends, data), (at, shown)))
        return ids, pc.binary_slice(spaced, 0, -1).cast(pa.string())

    def _whole(self, texts: pa.Array) -> pa.BooleanArray:
        """Which texts hold special tokens, or control characters that aren't white space to the library."""
        held = [pc.match_substring(texts, s) for s in [*self.special, *map(chr, range(0x1C, 0x20))]]
        return functools.reduce(pc.or_, held)


def encode_decode(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (bytes), decoded."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(path)
        for batch in batches:
            at = 0
            for texts in pieces_of(batch["text"]):
                ids, decoded = bpe.encode_all(texts)
                n_tokens = pc.cast(pc.divide(pc.binary_length(ids), 4), pa.int64())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(texts)), n_tokens, ids, decoded], ["doc_id", "n_tokens", "ids", "decoded"])
                at += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
