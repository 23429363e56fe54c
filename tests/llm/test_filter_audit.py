"""The audit of filters against each order applied to the documents, and against its SQL."""

import re
from itertools import permutations

import duckdb
import numpy as np
import pytest

from quillmark.llm import filter_audit, queries

from ..conftest import DATA

LONG = " ".join(f"word{i}" for i in range(210))
TEXTS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (3, LONG, "fr"), (None, LONG, "en"), (None, LONG, None), (4, None, "en"), (5, "", ""), (6, "", None), (7, "same " * 300, "en"), (8, LONG.upper(), "en"),
    (9, LONG + " 5% off & more", "fr"), (10, "A | B", "fr"), (11, "\t\n " + LONG + "\r\n", "en"), (12, LONG.replace(" ", "\x0b\x0c"), "en"), (13, LONG + " nbsp", "en"), (14, ("ab " * 100) + LONG, "en"), (15, "Été " * 400, "fr"), (16, "x" * 300_000, "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (7, None, 1), (8, 1, None), (None, 1, 1), (99, 1, 1), (6, 1, 1)]


def brute(rows, labels):
    """Applies every order, a document at a time."""
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    docs = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in rows) else set()
        docs.append((lang or "", fails, doc_id in good, doc_id in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own, shapley = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = sum(f in d[1] for d in own)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[f] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def collected(frame):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in frame.collect()}


def test_counts_equal_every_order_applied(spark):
    docs = spark.createDataFrame([(*r, 1, "x", b"c") for r in TEXTS], "doc_id long, text string, lang string, own int, part string, copy binary").repartition(4)
    labels = spark.createDataFrame([(*r, "en") for r in LABELS], "doc_id long, quality int, toxic int, lang string")
    got = collected(filter_audit.audit(docs, labels))
    assert got == brute(TEXTS, LABELS) and len(got) == 3 * 600


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "a", "en")], docs.schema)
    assert collected(filter_audit.audit(one, labels))["en", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 26, 1000, 4099])
def test_positional_counts(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, np.uint32)
    assert filter_audit.positional_counts(words).tolist() == [int(((words >> b) & 1).sum()) for b in range(32)]


def test_query_equals_its_sql(spark, sf):
    duck = duckdb.connect()
    for name in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/sf0.001/{name}.parquet'")
    got, want = queries.op13_filter_audit(spark, sf).toPandas(), duck.sql(queries.oracle_sql()["op13_filter_audit"]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns) and len(got) == len(want) > 0
    assert sorted(map(tuple, got[names].astype(str).to_numpy().tolist())) == sorted(map(tuple, want[names].astype(str).to_numpy().tolist()))
