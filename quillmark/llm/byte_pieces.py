"""Byte-level BPE by a sentencepiece model that is serialised from a vocabulary of ranks, and decoding.

The model's pieces are the vocabulary's byte strings, each byte as one visible character, scored by negative rank;
normalisation is the identity, so sentencepiece merges the pair whose joint piece has the lowest rank, leftmost first.
A text is cut into the matches of the pattern; each distinct match is encoded once (a match that is itself a piece is
that piece), and the ids of all matches are laid end to end. Decoding maps each id's piece back to its bytes.

Rows: a null text counts as empty; an empty text has no ids and decodes to no bytes; texts of any length are encoded
whole, each alone if it is long; strings that name special tokens are plain text; repeated rows give repeated results;
a null doc_id is kept; columns besides doc_id and text are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as messages

from . import tokens
from ._common import pieces_of

#: Stands for what no piece covers; every byte is a piece, so it is never met.
UNKNOWN = "⁇"


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    return [ranks[i] for i in range(len(ranks))]


def serialise(pieces: list[str]) -> bytes:
    """A sentencepiece BPE model of these pieces, best first, that changes nothing in the texts it encodes."""
    model = messages.ModelProto()
    for rank, piece in enumerate(pieces):
        model.pieces.add(piece=piece, score=-rank)
    model.pieces.add(piece=UNKNOWN, score=-len(pieces), type=messages.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = messages.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(pieces)
    model.trainer_spec.unk_piece = UNKNOWN
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = model.normalizer_spec.remove_extra_whitespaces = model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class BytePieces(tokens.ByteBpe):
    """encode_all(texts) gives ids as tokens.ByteBpe does; decode_all(ids) their bytes."""

    _loaded: dict[str, "BytePieces"] = {}

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.special: list[str] = []
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.visible = tokens.visible_bytes()
        self.space = self.visible[32]
        shown = [token.decode("latin-1").translate(self.visible) for token in ranks]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(shown))
        self.four = [i.to_bytes(4, "little") for i in range(len(shown))]
        self.whole = dict(zip(shown, self.four, strict=True))
        self.parts = tokens.Generations(self._part, tokens.PART_BYTES)
        self.spaced_words = tokens.Generations(self._spaced_word, tokens.WORD_BYTES)
        hidden = {c: b for b, c in self.visible.items()}
        self.bytes_of = pa.array([bytes(hidden[c] for c in self.model.id_to_piece(i)) for i in range(len(shown))], pa.large_binary())

    def _ids(self, shown: str) -> bytes:
        """A match of the pattern; one that is a piece stays whole even where no merges lead to it."""
        return self.whole.get(shown) or np.array(self.model.encode(shown, out_type=int), "<u4").tobytes()

    def decode_all(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
        """The bytes of all texts end to end, and where each begins and the last ends."""
        made = self.bytes_of.take(pa.array(ids))
        _, ends, data = made.buffers()
        at = np.frombuffer(ends, np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
        return data or pa.py_buffer(b""), at[np.concatenate(([0], np.cumsum(lengths)))]


def _rows_of(data, borders: np.ndarray) -> pa.Array:
    """Binary values that lie end to end; the texts of a slice are far below the 2 GB that a row's bytes may have."""
    return pa.Array.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(np.ascontiguousarray(borders, np.int64)), data]).cast(pa.binary())


def encode_decode(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (bytes)."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BytePieces.load(path)
        for batch in batches:
            first = 0
            for texts in pieces_of(batch["text"], tokens.BATCH_CHARS // 2):
                ids, lengths = coder.encode_all(texts)
                data, borders = coder.decode_all(ids, lengths)
                id_rows = _rows_of(pa.py_buffer(np.ascontiguousarray(ids)), 4 * np.concatenate(([0], np.cumsum(lengths))))
                names = batch["doc_id"].slice(first, len(texts))
                first += len(texts)
                yield pa.RecordBatch.from_arrays([names, pa.array(lengths, pa.int64()), id_rows, _rows_of(data, borders)], ["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
