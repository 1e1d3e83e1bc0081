"""Registered queries: every one with SQL agrees with DuckDB at sf0.001, no plan has a
cartesian product, and the feature job scans each raw table once."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as E
from riskweave.plans import base as B
from riskweave.plans.registry import load_all
from riskweave.session import drop_scratch
from riskweave.sources import cohort
from riskweave.sources.tables import TABLES

WITH_SQL = sorted(n for n, q in load_all().items() if q.sql)


@pytest.fixture(scope="module", autouse=True)
def one_feature_table(spark):
    """The feature job runs once for all queries of a data folder; gives the job itself."""
    real, made = B.feature_table, {}

    def once(s, sf_dir):
        if sf_dir not in made:
            made[sf_dir] = real(s, sf_dir).cache()
        return made[sf_dir]

    B.feature_table = once
    yield real
    B.feature_table = real
    drop_scratch(spark)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "student_key" in df.columns


def test_every_query_has_a_docstring_and_sql_names_match():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert all((q.__doc__ or "").strip() for q in qs.values())


def test_no_date_literals_in_queries():
    import riskweave.plans as P
    import glob
    import os
    for path in glob.glob(os.path.join(os.path.dirname(P.__file__), "*.py")):
        text = open(path).read().replace("1970-01-01", "")
        assert not re.search(r"[\"' ](19|20)\d\d-\d\d-\d\d", text), path


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_oracle_without_cross_join(spark, sf_dir, duck, name):
    sdf = E.queries()[name](spark, sf_dir)
    plan = sdf._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rel = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(sdf.columns) == sorted(dcols)
    order = sorted(dcols)
    got = sorted(tuple(canon(r[c]) for c in order) for r in sdf.collect())
    want = sorted(tuple(canon(r[dcols.index(c)]) for c in order) for r in rel.fetchall())
    assert got == want


def test_feature_job_scans_each_raw_table_once(spark, sf_dir, monkeypatch, one_feature_table):
    from riskweave.operators import features as FE
    profile = cohort.student_profile(spark, sf_dir, *FE.numbered(cohort.assessments(spark, sf_dir)))
    plan = profile._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan parquet", plan)) == 4  # lineitem, orders, customer, the numbered assessments
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", re.sub(r"#\d+L?", "", plan))
    assert [k for k in keys if "code_module" in k] == ["id_student, code_module, 8"]  # once, after a partial aggregate
    # Only tables of entity size (or smaller) are written, none of the lines.
    written = {}
    real = FE.cut_lineage

    def counted(df, name="stage"):
        written[name] = (out := real(df, name)).count()
        return out

    monkeypatch.setattr(FE, "cut_lineage", counted)
    one_feature_table(spark, sf_dir)
    entities = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "event_id % 5").distinct().count()
    assert set(written) == {"assessments", "entity-profile", "entity-activity", "entity-features"} and written["entity-activity"] == entities
    assert written["entity-features"] == written["entity-profile"] == profile.count()


def test_submitted_assessments_by_bits_or_distinct(spark):
    from pyspark.sql import functions as F

    from riskweave.operators import features as FE
    meta = spark.range(150).select(F.col("id").alias("id_assessment"), F.lit("M").alias("code_module"), F.lit("P").alias("code_presentation"),
                                   F.lit("2").alias("weight"))
    places, words = FE.numbered(meta)
    assert words == 3
    rows = spark.range(4000).select((F.col("id") % 7).alias("id_student"), (F.xxhash64("id") % 200).alias("id_assessment"),
                                    F.when(F.col("id") % 3 > 0, "5").otherwise("?").alias("score"))
    j = rows.join(places, "id_assessment", "left").select("id_student", "id_assessment", "place", F.col("code_module").isNotNull().alias("known"), *FE.score_and_weight())
    got = [sorted(j.groupBy("id_student").agg(*FE.total_aggregates(F.col("known"), w)).collect()) for w in (words, None)]
    assert got[0] == got[1] and max(r.submitted_assessments for r in got[0]) > 64


def test_feature_job_is_few_jobs(spark, sf_dir, one_feature_table):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    one_feature_table(spark, sf_dir).collect()
    assert 10 < len(set(tracker.getJobIdsForGroup(None)) - before) < 36


def test_dimension_join_shuffles_no_fact_rows(spark, sf_dir):
    from riskweave.operators import features as FE
    lines = cohort.lines_with_orders(spark, sf_dir)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = FE.assessed(cohort.student_assessment(lines), cohort.assessments(spark, sf_dir))
        assert "hashpartitioning(id_assessment" not in re.sub(r"#\d+L?", "", j._jdf.queryExecution().executedPlan().toString()).split("BroadcastExchange")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
