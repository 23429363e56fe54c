"""Token operators against the tokenizers library: files, packing, byte-pair encoding."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmark.llm import bpe, packing, simple8b, token_files, tokens
from quillmark.llm._common import pieces_of

PIECES = [" ", "  ", "\n", "\t", " \n", "a", "it's", "don't", "Été", "日本", "12", "!!", "<|endoftext|>", "\x1c", "\x85", "é", "foo", '"', "😀", "​", "İ", "ΣΟΣ", "́", "²"]
TEXTS = [None, "", " ", "\n\n", "plain words, here.", "plain words, here.", "x" * 5000, "word " * 9000, "tail space ", " lead", "two  spaces\n\nand lines", "<|endoftext|> in text"]


def documents(spark, texts=TEXTS):
    rows = [(i, t, "src", "clash", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, ids string, part int, n_tokens int").repartition(3)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_path())


def mixed(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_byte_bpe_equals_the_library(library):
    own = tokens.ByteBpe.load(tokens.default_path())
    for text in mixed(3000) + [t for t in TEXTS if t]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def check_batch(own, library, texts):
    ids, lengths = own.encode_all(pa.array(texts, pa.string()))
    at = 0
    for text, n in zip(texts, lengths.tolist(), strict=True):
        assert ids[at : at + n].tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)
        at += n
    assert at == len(ids)


def test_batches_equal_the_library(library):
    own = tokens.ByteBpe.load(tokens.default_path())
    for texts in (mixed(3000) + TEXTS, [None], ["", ""], [], ["a" * 200_000, "ab " * 100_000]):
        check_batch(own, library, texts)
    sliced = pa.array(TEXTS).slice(3, 4)
    assert own.encode_all(sliced)[1].tolist() == [len(library.encode(t or "").ids) for t in TEXTS[3:7]]


def test_pieces_of_are_whole_texts():
    texts = pa.array(["x" * 30, None, "", "abc", "defgh", "ijklm", "n" * 9])
    parts = [p.to_pylist() for p in pieces_of(texts, 10)]
    assert sum(parts, []) == texts.to_pylist() and len(parts) > 3


def test_memo_is_bounded_in_bytes(library, monkeypatch):
    monkeypatch.setattr(tokens, "WORD_BYTES", 700)
    monkeypatch.setattr(tokens, "PART_BYTES", 700)
    own = tokens.ByteBpe(tokens.default_path())
    check_batch(own, library, mixed(200, 5) + ["one two three four five six seven eight " * 3, "z" * 500 + " " + "y" * 500])
    for memo in (own.parts, own.spaced_words):
        assert memo.held <= 700 + 1000 and len(memo) < 8 and not any(len(k) > tokens.LONGEST_KEY for k in (*memo, *memo.old))


def test_word_bpe_equals_the_library():
    own, lib = bpe.WordBpe.load(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    for text in mixed(3000, 4):
        ids, shown = own.encode_both(text)
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert shown == lib.decode(want, skip_special_tokens=False), repr(text)


def test_word_bpe_batches_equal_the_library():
    own, lib = bpe.WordBpe.load(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    spaces = [f"A{c}b{c}{c}.{c}" for c in map(chr, range(0x3001)) if c.isspace()]
    odd = ["J\u030cT\u0308 W\u030a", "<|startoftext|>A<|endoftext|> <|endoftext|>", "no<|end oftext|>", "we'll it's' 'S.,", "x1.5%...", "Word.'s,;"]
    for texts in (mixed(3000, 6) + TEXTS + spaces + odd, [None], ["", ""], [" "], ["<|endoftext|>"], ["\x1c"], [], ["a" * 200_000, "ab " * 100_000]):
        for column in (pa.array(texts, pa.string()), pa.array(["cut off", *texts], pa.string())[1:]):
            ids, shown = own.encode_all(column)
            assert len(ids) == len(shown) == len(texts)
            for text, i, s in zip(texts, ids.to_pylist(), shown.to_pylist(), strict=True):
                want = lib.encode(text or "", add_special_tokens=False).ids
                assert np.frombuffer(i, "<u4").tolist() == want, repr(text)
                assert s == lib.decode(want, skip_special_tokens=False), repr(text)


def test_word_bpe_looks_at_a_piece_once(monkeypatch):
    """However little the memo holds, a slice's work on words grows with its distinct pieces."""
    monkeypatch.setattr(bpe, "MEMO_BYTES", 1)
    own, seen = bpe.WordBpe(bpe.default_path()), []
    monkeypatch.setattr(own, "normalize", lambda piece: seen.append(piece) or bpe.WordBpe.normalize(own, piece))
    ids, _ = own.encode_all(pa.array(["Every word, every text."] * 500))
    assert len(set(ids.to_pylist())) == 1 and sorted(seen) == ["Every", "every", "text.", "word,"]
    assert len(own.memo) <= 1 and len(own.memo.old) <= 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=700))
def test_simple8b_round_trip(values):
    ids = np.array(values, np.uint64)
    assert (simple8b.decode(simple8b.encode(ids), len(ids)) == ids).all()


def plain_simple8b(ids):
    """Word by word: the first selector whose ids all fit."""
    out, at = [], 0
    while at < len(ids):
        for s, (count, bits) in enumerate(zip(simple8b.COUNTS, simple8b.BITS, strict=True)):
            part = ids[at : at + count]
            if all(x < 1 << bits for x in part):
                out.append(s << 60 | sum(x << k * bits for k, x in enumerate(part)))
                at += count
                break
        else:
            out += [simple8b.ESCAPE << 60, ids[at]]
            at += 1
    return out


def test_simple8b_equals_plain_coding_and_blocks_stand_alone():
    rng = random.Random(2)
    for n in (0, 1, 2, 59, 240, 241, 700):
        ids = [rng.getrandbits(rng.choice((0, 1, 3, 8, 15, 16, 30, 34, 64))) for _ in range(n)]
        words, ids_before, words_before = simple8b.encode_blocks(np.array(ids, np.uint64), 50)
        assert words.tolist() == plain_simple8b(ids)
        for i, j, v, w in zip(ids_before, ids_before[1:], words_before, words_before[1:], strict=False):
            assert simple8b.decode(words[v:w], int(j - i)).tolist() == ids[i:j]


def test_simple8b_long_runs_are_short():
    assert len(simple8b.encode(np.zeros(2400, np.uint64))) == 10


def test_shards_round_trip():
    ids = np.arange(10_000, dtype=np.uint32) * 5 % 50_000
    data = token_files.pack_shard(np.array([token_files.NO_DOC, 3]), np.array([4000, 6000]), ids)
    assert [x.tolist() for x in token_files.unpack_shard(data)] == [[token_files.NO_DOC, 3], [4000, 6000], ids.tolist()]
    blocks = [token_files.read_block(data, b) for b in range(3)]
    assert np.concatenate(blocks).tolist() == ids.tolist() and all(len(b) >= 1800 for b in blocks)
    with pytest.raises(ValueError):
        token_files.unpack_shard(b"none of these")


@pytest.mark.parametrize("limit", [50, 1 << 18])
def test_token_files(spark, library, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(token_files, "SHARD_IDS", limit)
    rows = {r["doc_id"]: r for r in token_files.read_shards(token_files.write_token_files(documents(spark), f"file://{tmp_path}/t")).collect()}
    at = 0
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_of_repeated_and_null_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a"), (5, "b"), (5, "b"), (5, "a")], "doc_id long, text string")
    rows = token_files.read_shards(token_files.write_token_files(docs, f"file://{tmp_path}/t")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 5, 5, 5] and [r["start"] for r in rows] == [0, 2, 4, 6]
    hot = spark.range(4000).selectExpr("cast(7 as bigint) doc_id", "'same' text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    files = token_files.write_token_files(hot, f"file://{tmp_path}/h")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.select("part").distinct().count() > 1 and token_files.read_shards(files).select("start").distinct().count() == 4000
    assert token_files.read_shards(token_files.write_token_files(docs.limit(0), f"file://{tmp_path}/e")).count() == 0


def check_packing(pieces, want, length):
    at, full = dict.fromkeys(want, 0), 0
    for p in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        ids = want[p["doc_id"]]
        assert p["start"] == at[p["doc_id"]] and p["doc_tokens"] == len(ids) and 0 < p["length"] <= length
        assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
        at[p["doc_id"]] += p["length"]
    assert at == {d: len(i) for d, i in want.items()}
    ends = {}
    for p in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert p["offset"] == ends.get(p["sequence_id"], 0)
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(ends.values(), default=0) <= length and sorted(ends) == list(range(len(ends)))
    return sum(0 if n & (n - 1) == 0 else length - n for n in ends.values())


@pytest.mark.parametrize("length", [8, 64, 1024])
def test_packing(spark, library, length):
    texts = TEXTS + mixed(60, 9) + ["the same length of text"] * 40
    want = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    assert check_packing(packing.pack(documents(spark, texts), length=length).collect(), want, length) == 0


def test_few_tails_are_moved(spark, library):
    """Of 3,000 documents only the spare tails keep their ids until places are known."""
    texts = [" ".join(["word"] * (i % 37)) for i in range(3000)]
    want = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    assert check_packing(packing.pack(documents(spark, texts), length=64).collect(), want, 64) == 0


def test_packing_of_nothing(spark):
    assert packing.pack(documents(spark).limit(0)).count() == 0


def test_plan_uses_no_more_than_there_is():
    rng = np.random.default_rng(1)
    histogram = np.bincount(rng.integers(1, 64, 3000), minlength=64)
    histogram[40] += 5000
    plan = packing.plan_packing(histogram)
    used = np.zeros(64, np.int64)
    for combo, times in plan:
        assert sum(combo) == 64 or sum(combo) & (sum(combo) - 1) == 0
        for n in combo:
            used[n] += times
    assert (used <= histogram).all() and used.sum() > 2000


def test_bpe_operator(spark):
    lib = Tokenizer.from_file(bpe.default_path())
    rows = {r["doc_id"]: r for r in bpe.encode_decode(documents(spark)).collect()}
    for i, text in enumerate(TEXTS):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids) and bytes(rows[i]["ids"]) == np.array(ids, "<u4").tobytes() and rows[i]["decoded"] == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(documents(spark).limit(0)).count() == 0
