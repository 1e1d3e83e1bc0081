"""Record validation and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import enum_check


def range_errors(features: list[str] = K.BASE_FEATURES) -> Column:
    """Array of messages: a feature that is missing, outside [0, 100]
    (percentages) or negative (the others)."""
    out = []
    for f in features:
        bad = ~F.col(f).between(0, 100) if f in K.PERCENT_FEATURES else F.col(f) < 0
        text = "outside 0..100" if f in K.PERCENT_FEATURES else "negative"
        out.append(F.when(F.col(f).isNull(), F.lit(f"{f} missing")).when(bad, F.lit(f"{f} {text}")))
    return F.array_compact(F.array(*out))


def enum_error(col: str, values: list[str]) -> Column:
    """A message if a value that is given isn't one of the enum."""
    return F.when(~enum_check(col, values), F.concat(F.lit(f"{col} unknown: "), F.col(col)))


def validate(df: DataFrame, enums: dict[str, list[str]] | None = None) -> DataFrame:
    """P8 + P9: adds ``errors`` (array, empty for a valid record)."""
    found = F.array_compact(F.array(*[enum_error(c, v) for c, v in (enums or {}).items()])) if enums else None
    errors = range_errors()
    return df.withColumn("errors", F.concat(errors, found) if found is not None else errors)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with their errors) of validated records."""
    ok = F.size("errors") == 0
    return df.where(ok).drop("errors"), df.where(~ok)


def lookup(df: DataFrame, value: Column, *cols: str) -> DataFrame:
    """Rows of which one of ``cols`` (as text) is the value: an id, an anonymised id, or either."""
    match = F.lit(False)
    for c in cols:
        match = match | F.col(c).cast("string").eqNullSafe(value)
    return df.where(match)


def default_score(score: str = "risk_score") -> Column:
    """A missing score counts as 0.5 (0 is a score)."""
    return F.coalesce(F.col(score), F.lit(0.5))


def parse_iso(text: str) -> Column:
    """ISO-8601 text with ``Z`` or an offset to a timestamp; anything else is null."""
    return F.try_to_timestamp(F.col(text), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX"))


def version_stamp(ts: Column) -> Column:
    """model version of a time, vYYYYMMDD_HHMMSS."""
    return F.concat(F.lit("v"), F.date_format(ts, "yyyyMMdd_HHmmss"))
