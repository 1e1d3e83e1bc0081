"""Upload CSV ingest: read as text, validate, resolve the id, clean, impute,
anonymise (S1, S5, S6, P1-P3, P6, P7, A6, F1, F25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import clip, hash_id, surrogate_id, to_double
from ..operators.features import impute_median, ranked_medians


def read_upload(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Every column as text (no schema inference pass); types come later by try_cast."""
    return spark.read.option("header", str(header).lower()).option("inferSchema", "false").csv(path)


def validate_columns(df: DataFrame) -> list[tuple[str, str]]:
    """(severity, message) per problem: no identifier column is an error,
    each missing feature a warning."""
    out = []
    if not any(c in df.columns for c in K.ID_COLUMN_FALLBACK):
        out.append(("error", f"no identifier column (one of {', '.join(K.ID_COLUMN_FALLBACK)})"))
    for f in K.BASE_FEATURES:
        if f not in df.columns:
            out.append(("warning", f"missing feature column: {f}"))
    return out


def resolve_id_column(df: DataFrame) -> str | None:
    """The first identifier column that exists (not the first non-null value)."""
    return next((c for c in K.ID_COLUMN_FALLBACK if c in df.columns), None)


def clean_features(df: DataFrame) -> DataFrame:
    """P3 + P6: coerce to number (bad -> null), clip the three percentages to
    [0, 100] and the other two at >= 0; absent feature columns appear as null."""
    out = df
    for f in K.BASE_FEATURES:
        c = to_double(f) if f in df.columns else F.lit(None).cast("double")
        out = out.withColumn(f, clip(c, 0, 100) if f in K.PERCENT_FEATURES else clip(c, 0, None))
    return out


def contact(df: DataFrame) -> F.Column:
    """phone_number, else phone, as text."""
    cols = [F.col(c).cast("string") for c in ("phone_number", "phone") if c in df.columns]
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


def ingest(df: DataFrame, salt: str) -> DataFrame:
    """S1 -> P1/P2 -> P3 -> A6 -> F1: the cleaned, imputed, anonymised upload.

    Raises ValueError when no identifier column exists (the load is aborted).
    Rows without an identifier value get a deterministic surrogate (F25).
    """
    errors = [m for s, m in validate_columns(df) if s == "error"]
    if errors:
        raise ValueError("; ".join(errors))
    idc = resolve_id_column(df)
    cleaned = clean_features(df)
    imputed = impute_median(cleaned, K.BASE_FEATURES, ranked_medians(cleaned, K.BASE_FEATURES))
    raw_id = F.coalesce(F.col(idc).cast("string"), surrogate_id(*[F.col(c) for c in df.columns]))
    label = to_double("dropout_label").cast("int") if "dropout_label" in df.columns else F.lit(None).cast("int")
    return imputed.select(hash_id(raw_id, salt).alias("anon_id"), *K.BASE_FEATURES,
                          contact(df).alias("phone_number"), label.alias("dropout_label"))


def append_processed(df: DataFrame, path: str) -> None:
    """Rows appended to the processed CSV folder."""
    df.write.mode("append").option("header", "true").csv(path)


def read_processed(spark: SparkSession, path: str, schema: str, label: str = "dropout_label") -> DataFrame:
    """Processed CSV with its schema; rows without a label dropped, the label as integer."""
    df = spark.read.schema(schema).option("header", "true").csv(path)
    return df.dropna(subset=[label]).withColumn(label, F.col(label).cast("int"))


def write_processed(df: DataFrame, path: str) -> None:
    """Processed output (CSV with header)."""
    df.write.mode("overwrite").option("header", "true").csv(path)
