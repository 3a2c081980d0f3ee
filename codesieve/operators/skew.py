"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is dealt to several tasks.
HOT_ROWS = 1_000_000


def hot_keys(counted: DataFrame, on: Sequence[str], count: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, and into how many parts each goes.

    Of n rows at most n / hot_rows keys can be hot.  Whether that table is small enough to be
    broadcast is left to Spark, which knows its size.
    """
    parts = F.ceil(F.col(count) / hot_rows).cast("int")
    return counted.where(F.col(count) > hot_rows).select(*on, parts.alias("__parts"))


def spread_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Sequence[str],
                how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """Equi-join that deals the rows of hot keys to several tasks.

    Only rows of ``small`` under a hot key are repeated, once per part; all
    others join as usual.  ``spread_by`` are columns that differ between rows of
    the same key: the part is a hash of them, so a task that runs again deals
    the same way.  ``hot`` comes from :func:`hot_keys`; without it the keys of
    ``big`` are counted, which is combined on the map side.  Only for joins that
    keep or drop rows of ``big`` (inner, left, left_semi, left_anti).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"spread_join cannot do a {how} join")
    on = list(on)
    if hot is None:
        hot = hot_keys(big.groupBy(*on).agg(F.count("*").alias("__n")), on, "__n")
    parts = F.coalesce("__parts", F.lit(1))
    dealt = big.join(hot, on, "left").withColumn("__part", F.pmod(F.xxhash64(*spread_by), parts).cast("int"))
    repeated = small.join(hot, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("__parts").join(repeated.drop("__parts"), [*on, "__part"], how).drop("__part")
