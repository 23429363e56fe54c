"""Alignment of two tokenizers against a plain version that compares token by token."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillmark.llm import alignment, queries, tokens

from .test_tokens import TEXTS, mixed

ODD = ["▁ marked", "a  b", " ", "a\n\nb c", "x <|endoftext|> <s> <unk> y", "日本語 text", "🙂 🙂", "\x00 \x1c", "end ", "aaaaaaaa bbbbbbbb", "İstanbul ΣΟΣ", "don't don't"]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(tokens.default_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(tools, rows):
    """Rows as the contract says them, each token held against each."""
    a, b = tools
    shown = {c: x for x, c in tokens.visible_bytes().items()}
    names = {i: n for n, i in a.get_vocab(with_added_tokens=False).items()}
    docs, held = [], collections.Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        spans = []
        for side, one in enumerate(ids):
            data, at = [], 0
            for i in one:
                name = names[i] if side == 0 else b.id_to_piece(i)
                t = bytes(shown[c] for c in name) if side == 0 else bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()
                data.append((i, at, at + len(t), t))
                at += len(t)
            spans.append(data)
        if not text or any(b"".join(s[3] for s in side) != whole for side in spans):
            spans = [[], []]
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        groups, begun = [], 0
        for end in sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]}):
            groups.append("|".join(",".join(str(s[0]) for s in side if begun < s[2] <= end) for side in spans))
            begun = end
        held.update(set(links))
        docs.append((doc_id, len(spans[0]), len(spans[1]), links, groups))
    best = collections.defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [
        (d, n_a, n_b, len(g), len(k), sum(held[p] == best[p[0]] for p in k), sum(held[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, n_a, n_b, k, g in docs
    ]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def order(rows):
    return sorted(rows, key=repr)


def test_rows_equal_the_plain_version(spark, tools):
    texts = [t[:4000] if t else t for t in TEXTS] + ODD + mixed(120, 7) + ["the same text here"] * 40
    rows = [(None if i == 5 else i // 2 if i < 9 else i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "p", 1, [2]) for r in rows], "doc_id long, text string, part string, pair int, pairs array<int>").repartition(5)
    got = alignment.align(docs)
    assert got.columns == COLUMNS
    assert order(map(tuple, got.collect())) == order(plain(tools, rows))


def test_an_empty_table_gives_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_on_given_documents(spark, sf, tools):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    few = [r for r in rows if len(r[1] or "") < 3000]
    got = alignment.align(spark.createDataFrame(few, "doc_id long, text string"))
    assert order(map(tuple, got.collect())) == order(plain(tools, few))
    whole = queries.op11_alignment(spark, sf).toPandas().set_index("doc_id")
    assert len(whole) == len(rows)
    assert (whole["n_links"] >= whole[["n_a", "n_b"]].max(axis=1)).all() and (whole["n_best"] <= whole["n_links"]).all()


def test_words_equal_whole_texts(tools):
    """Ids that are made word by word are those of the libraries on whole texts, memo full or not."""
    aligner = alignment.Aligner.load(tokens.default_path(), public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t for t in mixed(2000, 11) + ODD + [t for t in TEXTS if t]]
    kept = aligner.b.memo.size
    aligner.b.memo.size = 5000
    for _ in range(2):
        (a, n_a), (b, n_b) = alignment.encode_spaced(pa.array(texts), aligner.makers)
        at_a, at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        for i, text in enumerate(texts):
            assert a[at_a[i] : at_a[i] + n_a[i]].tolist() == tools[0].encode(" " + text, add_special_tokens=False).ids, repr(text)
            assert b[at_b[i] : at_b[i] + n_b[i]].tolist() == tools[1].encode(text), repr(text)
    aligner.b.memo.size = kept


def test_a_very_long_text(spark, tools):
    text = "alpha beta, gamma\n" * 30_000 + "z" * 3000
    row = alignment.align(spark.createDataFrame([(1, text), (2, "alpha beta")], "doc_id long, text string")).where("doc_id = 1").first()
    assert row["n_a"] == len(tools[0].encode(" " + text, add_special_tokens=False).ids) and row["n_b"] == len(tools[1].encode(text))


def test_docs_with_a_pair_are_counted_once_each(spark):
    docs = spark.createDataFrame([(i, "yes yes yes") for i in range(60)], "doc_id long, text string").repartition(6)
    rows = alignment.align(docs).collect()
    assert {r["n_links"] for r in rows} == {3} and {r["count_sum"] for r in rows} == {180} and {r["n_best"] for r in rows} == {3}
