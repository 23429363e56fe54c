"""Token-id files: whole texts as Simple-8b words, in ascending doc_id order.

A file row is a shard of consecutive documents: `payload` is a header, the documents' ids and lengths, the offsets (in
ids and in words) of each block of about BLOCK ids, and the words. Blocks begin at word borders, so a block can be
decoded by itself.

Rows: a null text counts as empty; an empty text has the end id alone; a text of any length is written whole (one of
more than SHARD_IDS ids ends its shard); rows that repeat a doc_id are written each, in order of a hash of their texts,
and spread over tasks however many they are; a null doc_id comes first. Columns besides doc_id and text are ignored, an
empty table gives none.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simple8b, tokens
from ._common import pieces_of

MAGIC = b"QM8B"
BLOCK = 4096
#: Ids after which a shard is closed.
SHARD_IDS = 262_144
NO_DOC = -(1 << 63)
_SHARDS = "part int, seq int, ids_before long, n_ids long, payload binary"


def pack_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard's bytes: MAGIC, counts of documents, ids and blocks, doc_ids, lengths, block offsets, words."""
    words, ids_before, words_before = simple8b.encode_blocks(ids, BLOCK)
    head = MAGIC + struct.pack("<QQQ", len(doc_ids), len(ids), len(ids_before) - 1)
    return b"".join((head, *(x.astype(t).tobytes() for x, t in ((doc_ids, "<i8"), (lengths, "<u8"), (ids_before, "<u8"), (words_before, "<u8"), (words, "<u8")))))


def _parts_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, lengths, block offsets in ids and in words, and words of a shard."""
    if data[:4] != MAGIC:
        raise ValueError("not a token shard")
    n_docs, _, n_blocks = struct.unpack_from("<QQQ", data, 4)
    at, out = 28, []
    for n, kind in ((n_docs, "<i8"), (n_docs, "<u8"), (n_blocks + 1, "<u8"), (n_blocks + 1, "<u8")):
        out.append(np.frombuffer(data, kind, n, at).astype(np.int64))
        at += 8 * n
    return *out, np.frombuffer(data, "<u8", int(out[3][-1]), at)


def unpack_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids (NO_DOC for null), lengths and ids (uint32) of a shard."""
    docs, lengths, ids_before, _, words = _parts_of(data)
    return docs, lengths, simple8b.decode(words, int(ids_before[-1])).astype("<u4")


def read_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block of a shard, without decoding the others."""
    _, _, ids_before, words_before, words = _parts_of(data)
    return simple8b.decode(words[words_before[block] : words_before[block + 1]], int(ids_before[block + 1] - ids_before[block])).astype("<u4")


def shards(docs: DataFrame, *, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Shard rows (part, seq, ids_before in the part, n_ids, payload) in ascending doc_id order by part, seq."""
    path = tokenizer or tokens.default_path()
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokens.ByteBpe.load(path), TaskContext.get().partitionId()
        seq, before, size = 0, 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def shard() -> pa.RecordBatch:
            docs, lengths, ids = (np.concatenate(c) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([part], [seq], [before], [len(ids)], [pack_shard(docs, lengths, ids)]), schema, strict=True)], schema=schema)

        for batch in batches:
            names = pc.fill_null(batch["doc_id"], NO_DOC).to_numpy(zero_copy_only=False)
            first = 0
            for texts in pieces_of(batch["text"], tokens.BATCH_CHARS):
                ids, lengths = tokens.with_end(*encoder.encode_all(texts), end_id)
                ends, done = np.cumsum(lengths), 0
                while done < len(lengths):
                    start = int(ends[done - 1]) if done else 0
                    to = min(len(lengths), int(np.searchsorted(ends, start + SHARD_IDS - size)) + 1)
                    held.append((names[first + done : first + to], lengths[done:to], ids[start : ends[to - 1]]))
                    size += int(ends[to - 1]) - start
                    done = to
                    if size >= SHARD_IDS:
                        yield shard()
                        seq, before, size = seq + 1, before + size, 0
                        held.clear()
                first += len(lengths)
        if held:
            yield shard()

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "hash", "row"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(pack, _SHARDS)


def read_shards(files: DataFrame) -> DataFrame:
    """Per document doc_id, start, n_tokens, ids_crc32 from shard rows that were written."""
    # One row a part: at most as many as there were shuffle partitions.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    offset, at = {}, 0
    for row in sorted(totals, key=lambda r: r["part"]):
        offset[row["part"]] = at
        at += row["n"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, payload in zip(batch["part"].to_pylist(), batch["ids_before"].to_pylist(), batch["payload"], strict=True):
                names, lengths, ids = unpack_shard(payload.as_py())
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crc = [zlib.crc32(ids[b:e]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                docs = pa.array(names, pa.int64(), mask=names == NO_DOC)
                yield pa.RecordBatch.from_arrays([docs, pa.array(begins + (offset[part] + before)), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "ids_before", "payload").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_token_files(docs: DataFrame, path: str, **options) -> DataFrame:
    """Writes the shards of docs as a table at path and returns it as read back."""
    out = shards(docs, **options)
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)
