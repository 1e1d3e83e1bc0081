"""Operator 11: products and counts against loops over tokens, encodings against the libraries."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskweave.llm import alignment as A
from riskweave.llm import tokencount as T
from riskweave.sources.tables import read_table

TEXTS = ["Hello, world! It's 3.14.", " two  spaces\n\n and\ttabs ", "日本語テキスト🙂 naïve", "", None, "<|endoftext|> <s> </s> <unk>",
         "a", " ", "the ▁ sign", "Hello, world! It's 3.14.", "x\x00y \x1f", "ÀÉ " * 50, "antidisestablishmentarianism " * 9]


@pytest.fixture(scope="module")
def libs():
    a = Tokenizer.from_file(T.tokenizer_path(A.FILE_A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=T.tokenizer_path(A.FILE_B))


@pytest.fixture(scope="module")
def encoder():
    with open(T.tokenizer_path(A.FILE_B), "rb") as f:
        return A.Encoder(T.Vocabulary(T.tokenizer_path(A.FILE_A), specials=False), f.read())


def brute_tokens(libs, text):
    """(id, bytes) of both encodings; none if they don't give the text back."""
    if not text:
        return [], []
    letters = T.byte_letters()
    a = [(i, bytes(letters[c] for c in libs[0].id_to_token(i))) for i in libs[0].encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in libs[1].encode(text):
        p = libs[1].id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if libs[1].is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def brute(libs, rows):
    """The contract by loops: rows of (doc_id, text)."""
    per, pairs = [], Counter()
    for doc, text in rows:
        a, b = brute_tokens(libs, text)
        ends_a, ends_b = np.cumsum([len(x) for _, x in a]).tolist(), np.cumsum([len(x) for _, x in b]).tolist()
        links = [(a[i][0], b[ends_b.index(e)][0]) for i, e in enumerate(ends_a) if e in set(ends_b)]
        pairs.update(links)
        groups, i, j = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            ga, gb = [], []
            while i < len(a) and ends_a[i] <= e:
                ga.append(str(a[i][0]))
                i += 1
            while j < len(b) and ends_b[j] <= e:
                gb.append(str(b[j][0]))
                j += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        overlaps = sum(max(0, min(ea, eb) - max(ea - len(x), eb - len(y))) > 0
                       for (_, x), ea in zip(a, ends_a) for (_, y), eb in zip(b, ends_b)) if len(a) < 200 else None
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        per.append((doc, len(a), len(b), len(groups), links, digest, overlaps))
    top = Counter()
    for (x, y), n in pairs.items():
        top[y] = max(top[y], n)
    return [(doc, na, nb, ng, len(ln), sum(pairs[p] == top[p[1]] for p in ln), sum(pairs[p] for p in ln), digest, ov)
            for doc, na, nb, ng, ln, digest, ov in per]


def check(spark, libs, rows, df):
    got = A.align(df).collect()
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda r: tuple((x is not None, x) for x in r)
    want = brute(libs, rows)
    assert sorted((tuple(r[c] for c in cols) for r in got), key=key) == sorted((r[:8] for r in want), key=key)
    assert sum(r.n_overlaps for r in got if r.n_a < 200) == sum(r[8] for r in want if r[1] < 200)


def test_product_is_the_matrix_product():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x, y = (rng.random((rng.integers(1, 8), 9)) < .4).astype(int), (rng.random((9, rng.integers(1, 7))) < .4).astype(int)
        a, b = (A.Csr(np.append(0, np.cumsum(m.sum(1))), np.nonzero(m)[1], m.shape[1]) for m in (x, y))
        r, c, v = A.product(a, b)
        full = np.zeros((len(x), y.shape[1]), int)
        full[r, c] = v
        assert (full == x @ y).all() and (v > 0).all() and (A.product_sizes(a, b) == (x @ y).sum(1)).all()
        t = a.transpose()
        assert all((np.flatnonzero(x[:, j]) == t.cols[t.start[j]:t.start[j + 1]]).all() for j in range(9))


@pytest.mark.parametrize("window", [1, 16, 1 << 20])
def test_hard_texts(spark, libs, monkeypatch, window):
    monkeypatch.setattr(A, "_WINDOW", window)
    monkeypatch.setattr(A, "BLOCK_BYTES", 40 * window)
    monkeypatch.setattr(A, "_JOIN", 1 + window)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, block long, pairs string").repartition(3)
    check(spark, libs, rows, df)


def test_table_equals_loops(spark, libs):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents", ["doc_id", "text"])
    check(spark, libs, [(r.doc_id, r.text) for r in docs.collect()], docs)


def test_units_give_the_ids_of_whole_texts(spark, libs, encoder, monkeypatch):
    monkeypatch.setattr(A, "_CACHED", 50)
    texts = [r.text for r in read_table(spark, "/root/testdata/sf0.001", "documents", ["text"]).collect() if r.text]
    texts += ["Once upon  a time,\nin a land   far away… " * 40 + "z" * 500, "  lead", "trail   ", "\t tab \u3000 wide\u00a0x"]
    assert encoder.b.cuts
    for block in (texts[:50], texts[50:]):
        al = encoder.align([t.encode() for t in block])
        for i, t in enumerate(block):
            a, b = brute_tokens(libs, t)
            assert al.a[al.off_a[i]:al.off_a[i + 1]].tolist() == [x for x, _ in a]
            assert al.b[al.off_b[i]:al.off_b[i + 1]].tolist() == [x for x, _ in b]


def test_very_long_texts(encoder):
    al = encoder.align([("word " * 50_000).encode(), b"", ("日本" * 30_000).encode(), b"\xff bad", b"ok"])
    assert np.diff(al.off_a).tolist()[1] == np.diff(al.off_b).tolist()[3] == 0
    assert al.end_a[-1] == al.end_b[-1] == 250_001 + 180_001 + 3


def test_links(spark, libs, monkeypatch):
    monkeypatch.setattr(A, "_WINDOW", 8)
    text = "Überraschung! tokenization"
    a, b = brute_tokens(libs, text)
    df = spark.createDataFrame([("d1", text), ("d2", None)], "doc_id string, text string")
    over = A.overlap_links(df)
    ea, eb = np.cumsum([len(x) for _, x in a]), np.cumsum([len(x) for _, x in b])
    want = {(i, j, min(ea[i], eb[j]) - max(ea[i] - len(a[i][1]), eb[j] - len(b[j][1])), int(ea[i] == eb[j]))
            for i in range(len(a)) for j in range(len(b))}
    assert {(r.a_at, r.b_at, r.n_bytes, r.end_together) for r in over.collect()} == {w for w in want if w[2] > 0}
    both = A.shared_group_links(df).collect()
    ends = sorted(set(ea.tolist()) & set(eb.tolist()))
    assert {(r.a_at, r.b_at) for r in both} == {(i, j) for i in range(len(a)) for j in range(len(b))
                                               if np.searchsorted(ends, ea[i]) == np.searchsorted(ends, eb[j])}
    assert A.align(df).agg(F.sum("n_shared")).first()[0] == len(both) and {r.doc_id for r in both} == {"d1"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert A.align(df).count() == 0 and A.overlap_links(df).count() == 0
