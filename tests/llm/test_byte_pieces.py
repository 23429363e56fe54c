"""A sentencepiece model made of ranks against tiktoken."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quillmark.llm import byte_pieces, queries

from .test_tokens import TEXTS, documents, mixed


@pytest.fixture(scope="module")
def library():
    ranks = {t: i for i, t in enumerate(byte_pieces.read_ranks(byte_pieces.default_path()))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(spark, library):
    rng = random.Random(4)
    odd = ["\x00", "⁇ <unk> ▁", "ไทย हिन्दी", "ab" * 20_000, "".join(chr(rng.randrange(33, 0xD000)) for _ in range(4000))]
    texts = TEXTS + mixed(400, 5) + odd
    got = {r["doc_id"]: r for r in byte_pieces.encode_decode(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = library.encode_ordinary(text or "")
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == want, repr(text)
        assert got[i]["n_tokens"] == len(want) and bytes(got[i]["decoded"]) == (text or "").encode()


def test_a_piece_without_merges_stays_whole(tmp_path, spark):
    """b and c never join, but abc is a piece: a match that is a piece is taken as it is."""
    import base64

    ranks = [bytes([b]) for b in range(256)] + [b"abc", b"xa"]
    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(ranks)))
    own = tiktoken.Encoding("few", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    texts = ["abc", "abcd", "xabc abc", "xa"]
    rows = byte_pieces.encode_decode(documents(spark, texts), tokenizer=str(path)).orderBy("doc_id").collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in rows] == [own.encode_ordinary(t) for t in texts]


def test_rows_of_every_kind(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (1, None), (2, "")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_tokens"], bytes(r["decoded"])) for r in byte_pieces.encode_decode(docs).collect()) == [("1", 0, b""), ("1", 0, b""), ("2", 0, b""), ("None", 2, b"a b")]
    assert byte_pieces.encode_decode(docs.limit(0)).collect() == []


def test_query_on_given_documents(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op12_byte_pieces(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
