"""Byte-level BPE ids of whole texts through the tokenizers library, a distinct word at a time.

The library spends most of its time on bookkeeping for spans. Pre-tokenisation never joins text across a single space
between two visible characters, so texts may be cut there. A batch of texts is cut and its pieces are numbered by Arrow;
only its distinct pieces are looked at in Python, their words' ids come from the library's model and are kept in a
two-generation memo that is bounded in bytes; numpy lays the ids of all pieces end to end. Results equal those of the
library's own encode().
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: A space between visible characters; Python's white space includes all that the library knows.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Signs that stand behind a word as one run; no letter, digit or white space is among them.
_MARKS = ".,;:!?%&*#$"
#: Bound on the bytes of a generation of words (a worker holds two at most), and of a generation of other parts.
WORD_BYTES = 56 << 20
PART_BYTES = 12 << 20
#: Characters of texts that are worked on together (a longer text is alone).
BATCH_CHARS = 8 << 20
#: Longer keys seldom recur and aren't kept.
LONGEST_KEY = 40
#: What an entry takes besides the characters of its key and its value: two objects and a place in the table.
_ENTRY = 200


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


class Generations(dict):
    """Memo of make(key), bounded in bytes: when full it becomes the old generation, from which entries in use are taken
    over. Long keys are not kept."""

    def __init__(self, make, size: int, weigh=len):
        super().__init__()
        self.make, self.size, self.weigh, self.old, self.held = make, size, weigh, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONGEST_KEY:
                return value
        if self.held >= self.size:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = value
        self.held += _ENTRY + 2 * len(key) + self.weigh(value)
        return value


def visible_bytes() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ByteBpe:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers; encode_all(texts) those of many texts."""

    _loaded: dict[str, "ByteBpe"] = {}

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.visible = visible_bytes()
        self.space = self.visible[32]
        self.four = [i.to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab().values()))]
        self.parts = Generations(self._part, PART_BYTES)
        self.spaced_words = Generations(self._spaced_word, WORD_BYTES)

    @classmethod
    def load(cls, path: str) -> "ByteBpe":
        """One encoder a worker process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _ids(self, shown: str) -> bytes:
        four = self.four
        return b"".join([four[t.id] for t in self.model.tokenize(shown)])

    def _part(self, word: str) -> bytes:
        """A word of the pattern."""
        return self._ids(word.encode("utf-8", "replace").decode("latin-1").translate(self.visible))

    def _piece(self, piece: str) -> bytes:
        """Any piece that stands between cuts, with its leading space if it has one."""
        if any(s in piece for s in self.special):
            return b"".join([self.four[i] for i in self.tokenizer.encode(piece, add_special_tokens=False).ids])
        return b"".join(map(self.parts.__getitem__, self.words.findall(piece)))

    def _spaced_word(self, word: str) -> bytes:
        """A word of letters that follows a space."""
        return self._ids(self.space + word) if word.isascii() else self._part(" " + word)

    def _spaced(self, piece: str) -> bytes | None:
        """A piece that follows a space, cut at spaces; none if it is empty or white space is at one of its ends."""
        if piece.isalpha():
            return self.spaced_words[piece]
        word = piece.rstrip(_MARKS)
        if word.isalpha():
            return self.spaced_words[word] + self.parts[piece[len(word) :]]
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        head, line, rest = piece.partition("\n")
        if line and not head[-1].isspace() and not rest[0].isspace() and not any(s in piece for s in self.special):
            return self._spaced(head) + self.parts["\n"] + self._piece(rest)
        return self._piece(" " + piece)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = _CUT.split(text)
        out = [self._piece(first)]
        for piece in rest:
            got = self._spaced(piece)
            out.append(self._piece(" " + piece) if got is None else got)  # white space at the end of the text
        return b"".join(out)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) end to end, and how many each has."""
        n = len(texts)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        pieces = lists.flatten()
        starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()  # splitting makes a piece of any text
        coded = pc.dictionary_encode(pieces)
        made = list(map(self._spaced, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        codes = coded.indices.to_numpy(zero_copy_only=False).copy()
        firsts = pieces.take(pa.array(starts)).to_pylist()
        # The first piece has no space before it; a text with more white space than single spaces stands as one piece.
        irregular = np.array([m is None for m in made], bool)
        odd = irregular[codes]
        odd[starts] = [not f or f[-1].isspace() for f in firsts]
        whole = np.add.reduceat(odd, starts, dtype=np.int64) > 0
        codes[starts] = np.arange(n) + len(made)
        if whole.any():
            inner = np.repeat(whole, np.diff(np.append(starts, len(codes))))
            inner[starts] = False
            codes[inner] = len(made) + n
        made += [self.encode(texts[i].as_py() or "") if whole[i] else self._piece(f) for i, f in enumerate(firsts)]
        every = pa.array([*made, b""], pa.large_binary()).take(pa.array(codes))
        _, ends, data = every.buffers()
        at = np.frombuffer(ends, np.int64, len(codes) + 1)
        lengths = np.diff(np.append(at[starts], at[-1])) // 4
        return np.frombuffer(data, "<u4", int(at[-1]) // 4) if at[-1] else np.zeros(0, "<u4"), lengths


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and lengths of texts, each followed by an end id."""
    out = np.full(len(ids) + len(lengths), end_id, "<u4")
    own = np.ones(len(out), bool)
    own[np.cumsum(lengths + 1) - 1] = False
    out[own] = ids
    return out, lengths + 1
