"""Operator 13: counts equal to the tokenizer library's, on whole tables and on hard texts."""

import random

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, pre_tokenizers

from riskweave.llm import tokencount as T
from riskweave.sources.tables import read_table

HARD = ["", " ", "   ", "a  b", "a \n b", "\n\n x", "it's we'll I'd 'tis 'sab ' s ''s !'s  's \t's", "they're've'll'm", "é'été  ñ",
        "<|endoftext|>", "a<|endoftext|><|endoftext|> b  <|endoftext|>  ", "日本語テキスト。  全角　空白", "1,234.56 ٣٤ ½", "aaaaaaa" * 9,
        "x" * 700, "ab" * 2000, " " * 900 + "q", "   z", "🙂🙃 é \x00\x1c", "'", "'s", "s'", "don't'", "don'"]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(T.tokenizer_path())


@pytest.fixture(scope="module")
def vocabulary():
    return T.Vocabulary(T.tokenizer_path())


def by_library(lib, texts):
    return [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_classes_are_the_librarys(vocabulary):
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False)
    for cp in [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c > 0x9FFF) and c < 0x33000]:
        joins = [k for k, m in ((T.LETTER, "a"), (T.DIGIT, "1"), (T.OTHER, "!")) if len(cut.pre_tokenize_str(m + chr(cp))) == 1]
        assert vocabulary.classes[cp] == (joins[0] if joins else T.WHITE), hex(cp)


def test_hard_texts(lib, vocabulary):
    got = T.Counter(vocabulary).texts([t.encode() for t in HARD])
    assert got.tolist() == by_library(lib, HARD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("' sStrevlmd\n\t!a1é。"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_any_text(lib, vocabulary, texts):
    assert T.Counter(vocabulary).texts([t.encode() for t in texts]).tolist() == by_library(lib, texts)
    for t in texts:
        if all(ord(c) < 0x500 for c in t):  # Unicode versions agree there
            assert vocabulary.cut([t])[0] == regex.findall(T.PATTERN, t)


@pytest.mark.parametrize("chars", [7, 50, 1 << 18])
def test_windows_and_caches_change_nothing(lib, vocabulary, monkeypatch, chars):
    monkeypatch.setattr(T, "_CHARS", chars)
    monkeypatch.setattr(T, "_CACHED", 20)
    texts = [*HARD, " ".join(HARD), "".join(HARD)]
    assert T.Counter(vocabulary).texts([t.encode() for t in texts]).tolist() == by_library(lib, texts)


def test_long_runs_merge_alike(lib, vocabulary):
    rng = random.Random(5)
    runs = ["".join(rng.choices("abcdeinorst", k=n)) for n in (600, 5000, 40_000)] + ["a" * 10_001, "ab" * 5000 + "b" * 333]
    for t in runs:
        want = lib.encode(t, add_special_tokens=False).ids
        sym = vocabulary.byte_id[np.frombuffer(t.encode(), np.uint8)]
        assert vocabulary.merge_long(sym).tolist() == want
    small = [t[:300].encode() for t in runs]
    ids, count = vocabulary.merge(small)
    assert np.split(ids, np.cumsum(count)[:-1])[1].tolist() == lib.encode(small[1].decode(), add_special_tokens=False).ids


def test_whole_table(spark, lib):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents", ["doc_id", "text"])
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], by_library(lib, [r.text or "" for r in rows])))
    got = T.count_tokens(docs).collect()
    assert len(got) == len(rows) and all(want[r.doc_id] == r.n_tokens for r in got)
    size = {r.doc_id: len((r.text or "").encode()) for r in rows}
    assert all(r.n_bytes == size[r.doc_id] and r.over_limit == (r.n_tokens > 1024) for r in got)


def test_edge_rows(spark, lib):
    long = "lorem ipsum " * 100_000
    df = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (None, "a b", "x", 1), (3, long, "x", 1), (3, long, "x", 1)],
                               "doc_id long, text string, n_tokens string, _out int")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in T.count_tokens(df).collect()))
    n = by_library(lib, [long])[0]
    assert got == [(0, 3, 2, False), (1, 0, 0, False), (2, 0, 0, False), (3, len(long), n, True), (3, len(long), n, True)]
    assert T.count_tokens(df.limit(0)).count() == 0
