"""Scalar column functions (F1-F25). All are JVM-side expressions: no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """clamp into [lo, hi]; null stays null (greatest/least skip nulls)."""
    x = col_(c)
    out = x
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    return F.when(x.isNotNull(), out)


def to_double(c: str | Column) -> Column:
    """numeric coercion; text that is no finite number ('?', 'NaN', 'Infinity') -> null."""
    x = col_(c).try_cast("double")
    return F.when(F.abs(x) < float("inf"), x)  # false for NaN, which sorts above infinity


def risk_band(score: str | Column, tau: float = K.TAU) -> Column:
    """HIGH at >= tau, MEDIUM at >= 0.6 tau, else LOW; null score -> null."""
    s = col_(score)
    return (F.when(s.isNull(), F.lit(None).cast("string"))
            .when(s >= F.lit(tau), "HIGH")
            .when(s >= F.lit(tau * K.MEDIUM_FACTOR), "MEDIUM")
            .otherwise("LOW"))


def heat_band(score: str | Column) -> Column:
    """Four-level heat-map band."""
    s = col_(score)
    out = F.when(s.isNull(), F.lit(None).cast("string"))
    for bound, label in K.HEAT_BANDS:
        out = out.when(s >= F.lit(bound), label)
    return out.otherwise(K.HEAT_DEFAULT)


def hash_id(raw: str | Column, salt: str) -> Column:
    """salted SHA-256 hex of ``salt:raw``. The salt is a required argument."""
    return F.sha2(F.concat(F.lit(salt), F.lit(":"), col_(raw).cast("string")), 256)


def mask_id(anon: str | Column) -> Column:
    """first 8 + '...' + last 5 characters; unchanged when length <= 16."""
    a = col_(anon)
    masked = F.concat(F.substring(a, 1, K.MASK_VISIBLE), F.lit("..."),
                      F.substring(a, -K.MASK_TAIL, K.MASK_TAIL))
    return F.when(F.length(a) <= K.MASK_MIN_LENGTH, a).otherwise(masked)


def short_id(anon: str | Column, n: int = 8) -> Column:
    """id prefix followed by an ellipsis."""
    return F.concat(F.substring(col_(anon), 1, n), F.lit("…"))


def pct_change(new: str | Column, old: str | Column, zero: float | None = 0.0) -> Column:
    """(new - old) / old * 100; ``zero`` when old is 0 (None -> null)."""
    n, o = col_(new), col_(old)
    fallback = F.lit(zero) if zero is not None else F.lit(None).cast("double")
    return F.when(o == 0, fallback).otherwise((n - o) / o * 100)


def display_name(feature: str | Column) -> Column:
    """display label of a feature key; title-cased key when not in the map."""
    f = col_(feature)
    lookup = F.create_map(*[F.lit(x) for kv in K.FEATURE_LABELS.items() for x in kv])
    return F.coalesce(lookup[f], F.initcap(F.regexp_replace(f, "_", " ")))


def surrogate_id(*key_cols: str | Column) -> Column:
    """'manual-' + 12 hex characters of a stable hash of the row key."""
    key = F.concat_ws("|", *[col_(c).cast("string") for c in key_cols])
    return F.concat(F.lit("manual-"), F.substring(F.sha2(key, 256), 1, 12))


def enum_check(c: str | Column, values: list[str]) -> Column:
    """Full-match of an enum by regular expression."""
    return col_(c).rlike("^(" + "|".join(values) + ")$")


def percent(num: Column, den: Column, digits: int = 2) -> Column:
    """num / den * 100 rounded; null when den is 0 or null."""
    return fround(num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)) * 100, digits)


def fround(c: str | Column, digits: int) -> Column:
    """round half up as floor(x * 10^d + 0.5) / 10^d.

    Plain IEEE arithmetic, so every engine that evaluates the same formula gets
    the same double (``round`` differs between engines on values such as
    0.285 whose binary form lies just below the decimal half).
    """
    scale = float(10 ** digits)
    x = col_(c)
    return F.when(x.isNotNull(), F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale))
