"""The pipeline, stage by stage, against brute force on its own input."""

import corpus_pipeline as P
import pytest
from riskweave.llm import langid, mixing, sharding
from riskweave.llm.common import prepare
from riskweave.llm.registry import QUERIES
from riskweave.sources.tables import read_table
from test_fmindex import brute as brute_hits
from test_simhash import brute_components, brute_print


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """(name, input rows, output rows) of each stage, rows as dicts."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    junk = spark.createDataFrame([(10 ** 6, "123 456 ?!", "en", "src0", 10), (10 ** 6 + 1, None, None, None, None)], docs.schema)
    docs, out = docs.union(junk).cache(), []
    for name, f in P.STAGES:
        got = f(spark, docs, sf_dir).cache()
        out.append((name, [r.asDict() for r in docs.collect()], [r.asDict() for r in got.collect()], docs, got))
        docs = got
    return out


def test_stages_and_columns(stages, spark, sf_dir):
    assert [n for n, _ in P.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "mixing sources", "sharding"]
    columns = read_table(spark, sf_dir, "documents").columns
    for name, _, _, _, got in stages[:-1]:
        assert got.columns == columns, name
    assert stages[-1][4].columns == [*columns, "shard"]


def test_language_stage_drops_what_has_no_letter(stages):
    _, before, after, _, _ = stages[0]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert gone == {r["doc_id"] for r in before if not any(c.isalpha() for c in r["text"] or "")} >= {10 ** 6, 10 ** 6 + 1}


def test_dedup_stage_keeps_one_of_each_class(stages):
    _, before, after, _, _ = stages[1]
    ids = [r["doc_id"] for r in before]
    want = set(brute_components(ids, [brute_print(r["text"]) for r in before]))
    assert sorted(r["doc_id"] for r in after) == sorted(want) and len(want) < len(ids)


def test_decontamination_stage(stages, spark, sf_dir):
    _, before, after, _, _ = stages[2]
    bench = [(r.item_id, r.text) for r in read_table(spark, sf_dir, "benchmark").collect()]
    hits = brute_hits([(r["doc_id"], r["text"]) for r in before], bench)
    assert sorted(r["doc_id"] for r in after) == sorted(h[0] for h in hits if not h[-1])
    assert any(h[-1] for h in hits)


def test_mix_and_shard_stages(stages):
    _, _, after, docs, _ = stages[3]
    want = sorted(r.doc_id for r in mixing.mix(docs).collect() for _ in range(r.copies))
    assert sorted(r["doc_id"] for r in after) == want
    _, before, last, docs, _ = stages[4]
    assert len(last) == len(before)
    at = {r.doc_id: r.shard for r in sharding.place(docs.select("doc_id")).collect()}
    assert all(r["shard"] == at[r["doc_id"]] for r in last)


def test_run_and_empty_documents(spark, sf_dir):
    out = QUERIES["pipeline"](spark, sf_dir)
    assert out.count() > 0 and "shard" in out.columns
    docs = read_table(spark, sf_dir, "documents").limit(0)
    for _, f in P.STAGES:
        docs = f(spark, docs, sf_dir)
        assert docs.count() == 0
    assert langid.keep_identified(docs).count() == 0


def test_last_stage_keeps_a_column_named_slot(spark, sf_dir):
    docs = spark.createDataFrame([(1, "t", 5, "old")], "doc_id long, text string, _slot int, Shard string")
    assert P.STAGES[-1][1](spark, docs, sf_dir).columns == ["doc_id", "text", "_slot", "shard"]
