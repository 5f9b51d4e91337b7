"""Small helpers for joins and category look-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on `keys` where NULL equals NULL; the keys are kept once.

    Without keys the right side is the single row of a global aggregate and is attached to every row; a second row is
    an error, no row gives NULLs.
    """
    if not keys:
        one = right.select(F.struct(*right.columns).alias("_one")).scalar()
        return left.withColumn("_one", one).select(*left.columns, "_one.*")
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def lookup(column: Column, table: dict) -> Column:
    """Map a closed set of keys to values; anything else becomes NULL."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), column)


def level_order(column: Column, levels) -> Column:
    """1-based position in a closed level list, NULL when unknown."""
    pos = F.array_position(F.array(*[F.lit(x) for x in levels]), column)
    return F.when(pos > 0, pos)


def md5_key(seed: str, *columns: Column | str) -> Column:
    """Engine-independent hash order for choices that must look random but be repeatable."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns]))


def rounded(column: Column, digits: int = 6) -> Column:
    """Round and fold -0.0 into 0.0. A first finer rounding settles values that sit on a rounding edge."""
    return F.round(F.round(column, digits + 4), digits) + F.lit(0.0)
