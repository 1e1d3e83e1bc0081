"""Operator 8: exact vectors, and accuracy on held-out rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import langid as L
from riskweave.sources.tables import read_table


def brute_vector(v, text):
    s = "".join(c if c.isalpha() else " " for c in text.lower())
    s = [0] + [ord(c) if c != " " else 0 for c in " ".join(s.split())] + [0]
    s += [0] * (3 - len(s))
    out = np.zeros(v.dim)
    for a, b, c in zip(s, s[1:], s[2:]):
        out += np.roll(v.letter(a), 2).astype(int) * np.roll(v.letter(b), 1) * v.letter(c)
    return out


@pytest.mark.parametrize("chars", [5, 1 << 18])
def test_bundles_match_brute_force(chars, monkeypatch):
    monkeypatch.setattr(L, "_CHARS", chars)
    v = L.Vectors(dim=64)
    texts = ["Über den Fluß, 12 Boote!", "a", "  -- ", "", "ñandú ñandú ñandú", "x1y2z3 ", "日本語 text"]
    got, found = v.bundles(texts)
    for t, g, f in zip(texts, got, found):
        assert f == any(c.isalpha() for c in t)
        if f:
            assert np.array_equal(g, brute_vector(v, t)), t


def test_small_cache_gives_the_same(monkeypatch):
    texts = ["the quick brown fox jumps over the lazy dog", "der schnelle braune Fuchs"]
    want, _ = L.Vectors(dim=64).bundles(texts)
    monkeypatch.setattr(L, "_CACHE", 8)
    got, _ = L.Vectors(dim=64).bundles(texts)
    assert np.array_equal(got, want)


def test_held_out_accuracy_and_shape(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents", ["doc_id", "text", "lang"])
    out = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in out)


def test_edge_rows(spark):
    train = [(i, t, k) for i in range(40) for t, k in (("the cat and the dog", "en"), ("le chat et le chien", "fr"))]
    rows = train + [(900, None, "en"), (901, "", None), (902, "123 ?!", "fr"), (None, "the cat", None), (903, "the cat", None),
                    (903, "the cat", None)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, score string")
    got = L.identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert by[None].lang_pred == by[903].lang_pred == "en" and by[None].held_out
    assert L.keep_identified(df).count() == len(rows) - 3 and L.keep_identified(df).columns == df.columns
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.identify(none).collect()} == {"und"}
    assert L.identify(df.limit(0)).count() == 0


def test_letters_of_all_planes(spark):
    table = L._letters()
    import unicodedata
    assert all(table[c] for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L")
    assert table[0x32100] and table[0x323AF] and not table[ord("1")] and not table[0x1F600]
    far = "".join(chr(0x32100 + i % 7) for i in range(40))
    rows = [(i, t, k) for i in range(40) for t, k in (("the cat and the dog", "en"), (far, "xx"))] + [(900, far[3:], None)]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[900].lang_pred == "xx" and got[900].score > 0.5


def test_a_dirty_lang_column_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGS", 2)
    rows = [(i, t, k) for i in range(60) for t, k in (("the cat and the dog", "en"), ("le chat et le chien", "fr"))]
    rows += [(1000 + i, "junk text", f"junk{i}") for i in range(50)]
    langs, protos = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langs == ["en", "fr"] and len(protos) == 2
