"""Projection helpers (P2–P9): one-hot, recodes, ratios with explicit zero
policies, fills and flags.  All return built-in Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _label(v) -> str:
    if isinstance(v, float) and v.is_integer():
        v = int(v)
    return str(v)


def one_hot(col, vocab, prefix: str) -> list[Column]:
    """One 0/1 int column per vocabulary value; NULL input -> all zeros.

    The schema is fixed by ``vocab`` (not by the values that occur)."""
    c = _c(col)
    return [F.coalesce((c == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix}_{_label(v)}")
            for v in vocab]


def recode(col, mapping: dict, default=None) -> Column:
    """Map values through a fixed dictionary (``create_map`` lookup)."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    # element_at raises on a missing key under ANSI; try_element_at returns NULL
    looked = F.try_element_at(F.create_map(*pairs), _c(col))
    return looked if default is None else F.coalesce(looked, F.lit(default))


def row_sum(cols) -> Column:
    """Sum of several columns in one row."""
    return reduce(add, [_c(c) for c in cols])


def safe_ratio(num, den, on_zero: str = "null") -> Column:
    """P5: ``num / den`` under an explicit division-by-zero policy.

    * ``"null"`` — x/0 -> NULL (NaN and inf both become NULL);
    * ``"zero"`` — x/0 -> 0 (inf and NaN replaced by 0);
    * ``"inf"``  — x/0 -> +inf when x > 0, NULL when x = 0 (pandas float
      division, with NaN represented as NULL).
    """
    n, d = _c(num).cast("double"), _c(den).cast("double")
    q = F.try_divide(n, d)
    if on_zero == "null":
        return q
    if on_zero == "zero":
        return F.coalesce(q, F.lit(0.0))
    if on_zero == "inf":
        return (F.when(d == 0, F.when(n > 0, F.lit(float("inf")))
                       .when(n < 0, F.lit(float("-inf"))))
                .otherwise(q))
    raise ValueError(on_zero)


def nonpositive_to(col, value=-1) -> Column:
    """Values <= 0 (or NULL) -> ``value``."""
    c = _c(col)
    return F.when(c.isNull() | (c <= 0), F.lit(value)).otherwise(c)


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int (NULL -> 0)."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (for stable comparison / export)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)
