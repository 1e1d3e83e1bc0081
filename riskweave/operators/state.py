"""Set-based maintenance of state tables.

Each change is one join: incoming rows are de-duplicated by key under an
explicit order, joined to the current table, and every output column is a
``coalesce`` / ``when`` of the two sides. The result is a new table version;
a table being read is never overwritten (``sources.versioned``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .explain import EXPLANATION_TYPE


def last_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Keep the last row per key under ``order`` (the latest upload row wins).

    ``max_by`` over a struct ordering is a partial aggregate: a key holding a
    large share of the rows is reduced map-side, never sorted in one task.
    """
    cols = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*order))
    return df.groupBy(key).agg(best.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def upsert(current: DataFrame, incoming: DataFrame, key: str, features: list[str],
           optional: list[str], order: list[Column]) -> DataFrame:
    """Update by key, else insert. Adds ``_action`` in {insert, update, keep}.

    - features: the new value when given, else the old value; 0.0 on insert
      when absent (the original overwrote absent features with 0.0 on update)
    - optional columns (label, phone): only a non-null new value replaces
    Incoming keys are de-duplicated first (last row under ``order`` wins).
    """
    inc = last_per_key(incoming, key, order)
    cur_cols = [c for c in current.columns if c != key]
    c = current.select(key, *[F.col(x).alias(f"_c_{x}") for x in cur_cols], F.lit(True).alias("_has_cur"))
    n = inc.select(key, *[F.col(x).alias(f"_n_{x}") for x in features + optional if x in inc.columns],
                   F.lit(True).alias("_has_new"))
    j = c.join(n, key, "full_outer")
    has_cur, has_new = F.coalesce(F.col("_has_cur"), F.lit(False)), F.coalesce(F.col("_has_new"), F.lit(False))
    action = F.when(has_cur & has_new, "update").when(has_new, "insert").otherwise("keep")
    out = [F.col(key)]
    for x in cur_cols:
        old = F.col(f"_c_{x}")
        if x in features and f"_n_{x}" in j.columns:
            out.append(F.when(has_cur, F.coalesce(F.col(f"_n_{x}"), old))
                        .otherwise(F.coalesce(F.col(f"_n_{x}"), F.lit(0.0))).alias(x))
        elif x in optional and f"_n_{x}" in j.columns:
            out.append(F.coalesce(F.col(f"_n_{x}"), old).alias(x))
        elif x in features:
            out.append(F.when(has_cur, old).otherwise(F.lit(0.0)).alias(x))
        else:
            out.append(old.alias(x))
    return j.select(*out, action.alias("_action"))


def load_summary(merged: DataFrame, scored_col: str = "risk_score", warnings: int = 0) -> DataFrame:
    """Inserted, updated, unchanged, scored and total rows of a merge, and the
    number of warnings of its upload."""
    return merged.agg(
        F.count_if(F.col("_action") == "insert").alias("inserted"),
        F.count_if(F.col("_action") == "update").alias("updated"),
        F.count_if(F.col("_action") == "keep").alias("unchanged"),
        F.count_if(F.col("_action").isin("insert", "update") & F.col(scored_col).isNotNull()).alias("scored"),
        F.count(F.lit(1)).alias("total_rows"), F.max(F.lit(warnings)).alias("warnings"))


def members(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``key IN (keys)`` as a left-semi join."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def duplicate_guard(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``incoming`` with ``decision``: accepted if its key is not present yet,
    else rejected (one left join; ``existing`` has one row per key)."""
    ex = existing.select(key, F.lit(True).alias("_there"))
    return (incoming.join(ex, key, "left")
                    .withColumn("decision", F.when(F.col("_there"), "rejected").otherwise("accepted")).drop("_there"))


def referential_check(children: DataFrame, parents: DataFrame, fk: str, pk: str,
                      copy_cols: list[str]) -> DataFrame:
    """Children with the parent's columns and ``status`` ok, or orphan with nulls
    (one left join; ``parents`` has one row per key)."""
    p = parents.select(F.col(pk).alias(fk), *copy_cols, F.lit(True).alias("_there"))
    return (children.join(p, fk, "left")
                    .withColumn("status", F.when(F.col("_there"), "ok").otherwise("orphan")).drop("_there"))


def latest_with_default(entities: DataFrame, log: DataFrame, key: str, ts: str, cols: list[str],
                        defaults: dict[str, Column]) -> DataFrame:
    """J10 + W3: newest log row per entity (``max_by``, skew-safe); entities
    without one get a minimal default row (``_inserted`` = true)."""
    st = F.struct(*[F.col(c) for c in [ts] + cols])
    latest = log.groupBy(key).agg(F.max_by(st, F.col(ts)).alias("_s"))
    j = entities.select(key).distinct().join(latest, key, "left")
    out = [F.col(key)]
    for c in [ts] + cols:
        v = F.col(f"_s.{c}")
        out.append((F.coalesce(v, defaults[c]) if c in defaults else v).alias(c))
    return j.select(*out, F.col("_s").isNull().alias("_inserted"))


def feedback_labels(base: DataFrame, interventions: DataFrame, base_key: str, fk: str,
                    label: str = "dropout_label") -> tuple[DataFrame, DataFrame]:
    """Any SUCCESSFUL intervention sets the label to 0; UNSUCCESSFUL leaves
    it; other outcomes count as pending. Null / 0 ids are skipped.

    Returns (relabelled base, one-row stats). Outcomes are aggregated per
    entity first (partial aggregation), so the join is key-unique.
    """
    valid = interventions.where(F.col(fk).isNotNull() & (F.col(fk) != 0))
    per = valid.groupBy(fk).agg(
        F.max(F.when(F.col("outcome") == "SUCCESSFUL", 1).otherwise(0)).alias("_succ"),
        F.count_if(F.col("outcome") == "SUCCESSFUL").alias("_n_succ"),
        F.count_if(F.col("outcome") == "UNSUCCESSFUL").alias("_n_unsucc"),
        F.count_if(~F.col("outcome").isin("SUCCESSFUL", "UNSUCCESSFUL") | F.col("outcome").isNull()).alias("_n_pend"))
    j = base.join(per.withColumnRenamed(fk, base_key), base_key, "left")
    changed = (F.col("_succ") == 1) & (F.col(label) == 1)
    out = j.withColumn("_changed", F.coalesce(changed, F.lit(False))) \
           .withColumn(label, F.when(F.col("_succ") == 1, F.lit(0)).otherwise(F.col(label)).cast("int"))
    stats = out.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_changed")).alias("labels_overridden"),
        F.count_if(F.col("_succ") == 1).alias("rows_with_success"),
        F.count_if(F.col("_n_unsucc") > 0).alias("rows_with_unsuccessful"))
    pending = per.agg(F.sum("_n_pend").cast("long").alias("pending_outcomes"))
    stats = stats.unpivot([], ["rows", "labels_overridden", "rows_with_success", "rows_with_unsuccessful"],
                          "metric", "value").unionByName(
        pending.unpivot([], ["pending_outcomes"], "metric", "value"))
    return out.drop("_succ", "_n_succ", "_n_unsucc", "_n_pend", "_changed"), stats


def partial_update(current: DataFrame, changes: DataFrame, key: str, fields: list[str],
                   as_of: str, completed_col: str = "completed_at") -> DataFrame:
    """Apply sparse change rows (null = not set); ``completed_at`` is
    stamped when the status becomes COMPLETED (kept when already set)."""
    ch = changes.select(key, *[F.col(f).alias(f"_ch_{f}") for f in fields])
    j = current.join(ch, key, "left")
    out = j
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f"_ch_{f}"), F.col(f)))
    if "status" in fields:
        stamp = (F.col("_ch_status") == "COMPLETED")
        prev = F.col(completed_col) if completed_col in current.columns else F.lit(None).cast("timestamp")
        out = out.withColumn(completed_col, F.when(stamp & prev.isNull(), F.to_timestamp(F.lit(as_of))).otherwise(prev))
    return out.drop(*[f"_ch_{f}" for f in fields])


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Delete by id as a left-anti rewrite."""
    return df.join(keys.select(key), key, "left_anti")


def delete_orphans(df: DataFrame, parents: DataFrame, fk: str, pk: str) -> DataFrame:
    """Keep the rows whose parent exists (one semi join)."""
    return df.join(parents.select(F.col(pk).alias(fk)), fk, "left_semi")


def truncate(df: DataFrame) -> DataFrame:
    """The empty version of a table, schema kept."""
    return df.limit(0)


def explain_latest(log: DataFrame, explanations: DataFrame, key: str, ts: str, field: str,
                   defaults: dict[str, Column]) -> DataFrame:
    """A log with ``field`` of the newest row of each key replaced by the new
    explanation; all other rows stay as they are, and a key without any row gets a
    new one from ``defaults``. Equal newest times: all rows of that time are updated.
    """
    newest = log.groupBy(key).agg(F.max(ts).alias("_newest"))
    new = explanations.select(key, F.col(field).alias("_new"))
    j = log.join(newest.join(new, key, "full"), key, "full")
    take = F.col("_new").isNotNull() & (F.col("_newest").isNull() | (F.col(ts) == F.col("_newest")))
    inserted = F.col("_newest").isNull()
    out = [F.col(key)]
    for c in log.columns:
        if c == field:
            out.append(F.when(take, F.col("_new")).otherwise(F.col(c)).alias(c))
        elif c != key:
            out.append((F.when(inserted, defaults[c]).otherwise(F.col(c)) if c in defaults else F.col(c)).alias(c))
    return j.select(*out, inserted.alias("_inserted"), (take & ~inserted).alias("_updated"))


def mark_read(alerts: DataFrame, predicate: Column) -> DataFrame:
    """Conditional bulk update; dismissing implies read."""
    return (alerts.withColumn("is_read", F.col("is_read") | predicate | F.col("is_dismissed")))


def newest_rows(df: DataFrame, key: str, order: list[Column], n: int, fields: list[str], out: str) -> DataFrame:
    """(key, out): the first ``n`` rows of each key as a list of structs, in order.

    The rank limit is applied in every task before the rows are shuffled, so a hot
    key costs ``n`` rows per task; lists never hold more than ``n`` rows.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    top = df.select(key, rank.alias("_rank"), *fields).where(F.col("_rank") <= n)
    listed = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_rank", *fields))).alias("_l"))
    return listed.select(key, F.transform("_l", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(out))


def entity_360(persons: DataFrame, predictions: DataFrame, interventions: DataFrame, key: str, n: int = 10) -> DataFrame:
    """One row per entity: counts, the newest ``n`` predictions and interventions as
    lists (newest first), and the explanation of the newest prediction that has one.

    ``predictions``: key, ts, risk_score, explanation (JSON text or null). Child tables
    are reduced per entity before the joins, by aggregates with partial results and by
    ``newest_rows``, so that no task holds a hot entity's rows.
    """
    p = predictions.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_predictions"), F.max_by("risk_score", "ts").alias("latest_score"), F.max("ts").alias("latest_ts"),
        F.max_by(F.when(F.col("explanation").isNotNull(), F.col("explanation")),
                 F.when(F.col("explanation").isNotNull(), F.col("ts"))).alias("_explanation"))
    i = interventions.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_interventions"),
        F.count_if(F.col("outcome") == "SUCCESSFUL").alias("n_successful"),
        F.max_by("intervention_type", F.struct("created_at", "id")).alias("latest_intervention_type"))
    scores = newest_rows(predictions, key, [F.col("ts").desc()], n, ["ts", "risk_score"], "predictions")
    steps = newest_rows(interventions, key, [F.col("created_at").desc(), F.col("id").desc()], n,
                        ["id", "intervention_type", "status", "outcome", "created_at"], "interventions")
    out = persons
    for child in (p, i, scores, steps):
        out = out.join(child, key, "left")
    decoded = F.from_json("_explanation", EXPLANATION_TYPE, {"mode": "PERMISSIVE"})
    return out.withColumn("explanation", decoded).drop("_explanation")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def scored_writeback(students: DataFrame, scored: DataFrame, key: str, run_ts: str,
                     version: str = "v1") -> tuple[DataFrame, DataFrame]:
    """M10 + S8: new score, band and flag written back by key; prediction log rows."""
    s = scored.select(key, F.col("risk_score").alias("_s"), F.col("risk_band").alias("_b"))
    j = students.join(s, key, "left")
    new = (j.withColumn("risk_score", F.coalesce("_s", "risk_score"))
            .withColumn("risk_band", F.coalesce("_b", "risk_band"))
            .withColumn("is_flagged", F.coalesce(F.col("_b") == "HIGH", F.col("is_flagged")))
            .drop("_s", "_b"))
    log = scored.select(key, "anon_id", "risk_score", "risk_band", F.lit(version).alias("model_version"),
                        F.to_timestamp(F.lit(run_ts)).alias("created_at"))
    return new, log

