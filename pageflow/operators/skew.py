"""Joins whose left side may hold one key in a large part of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``left.join(right, on, how)`` for a ``right`` with few rows per key: each of its rows comes once
    per salt, and a hot key of ``left`` is dealt over ``salts`` tasks. ``how``: inner, left, left_semi, left_anti.
    """
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    each = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(each, [*on, "_salt"], how).drop("_salt")
