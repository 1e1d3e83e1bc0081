"""A corpus pipeline over ``documents``: each stage calls one operator of riskweave.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes
as Parquet in the shared checkpoint folder and reads back as the next stage's
docs. All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import fmindex, langid, mixing, sharding, simhash
from riskweave.llm.common import prepare, step
from riskweave.sources.tables import read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents whose language can't be told go."""
    return langid.keep_identified(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of each near-duplicate class the document of the smallest id stays."""
    return simhash.dedupe(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark window go."""
    return fmindex.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document as often as the mix takes it."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: adds the shard of each document."""
    return sharding.place(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

# SimHash classes, FM-index search and pivotal rounding are not expressible in SQL;
# tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``documents`` after all stages."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = step(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
