"""Per-key results when a few keys hold most rows.

Heavy keys are detected with a mergeable frequent-items sketch (one pass, one small partial result per task). Rows of heavy
keys go through a broadcast join with the heavy keys' short list, which also gives them a salt, so that each heavy key is
worked on by many tasks and only its partial results meet; all other rows go through an ordinary shuffle; both are united.

The list is bounded by construction: at most ``1/share`` keys can hold ``share`` of the rows, and the sketch adds a few
more that come close, so the broadcast can't grow with the data.

Nulls: a null key is a key like any other. An empty table gives an empty result. Extra columns are left alone; columns
named with the prefix ``__skew`` are reserved.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of the sketch: its error is at most 3.5/TRACKED of all rows, far below any share in use here.
TRACKED = 16_384


def _key(name: str) -> Column:
    """The key as text that tells null from every string."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def _text(key: str | list[str]) -> Column:
    """One key, or several together, each after its length, as text."""
    if isinstance(key, str):
        return _key(key)
    return F.concat(*[x for k in key for x in (F.length(_key(k)).cast("string"), _key(k))])


def _names(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def heavy_keys(df: DataFrame, key: str | list[str], share: float) -> tuple[list[str], int]:
    """Every key that may hold ``share`` of the rows, as text, and the number of rows.

    The sketch overestimates by at most its error and never misses a key above it, so no heavy key is lost; one that is
    listed without need only takes the other way to the same result.
    """
    most = math.ceil(2 / share)
    found = df.select(_text(key).alias("k")).agg(F.call_function("approx_top_k", F.col("k"), F.lit(most), F.lit(TRACKED)).alias("top"), F.count(F.lit(1)).alias("n")).first()
    rows = found["n"]
    least = rows * max(share - 4 / TRACKED, share / 2)
    return [x["item"] for x in found["top"] or [] if x["count"] >= least], rows


def _split(df: DataFrame, key: str | list[str], heavy: list[str], salts: int) -> tuple[DataFrame, DataFrame]:
    """Rows of heavy keys with a salt, by broadcast join with the short list, and the rest, by broadcast anti-join."""
    spark = df.sparkSession
    short = F.broadcast(spark.createDataFrame([(k,) for k in heavy], "__skew_key string"))
    on = _text(key) == F.col("__skew_key")
    salted = df.join(short, on).drop("__skew_key").withColumn("__skew_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)).cast("int"))
    return salted, df.join(short, on, "left_anti")


def skew_aggregate(df: DataFrame, key: str | list[str], partial: dict[str, Column], final: dict[str, Column], share: float = 1 / 50, salts: int = 32) -> DataFrame:
    """One row per ``key``, a column or several. ``partial`` are aggregates of the rows, ``final`` aggregates of the partial columns."""
    heavy, _ = heavy_keys(df, key, share)
    return _aggregated(df, key, heavy, partial, final, salts)


def _aggregated(df: DataFrame, key: str | list[str], heavy: list[str], partial: dict[str, Column], final: dict[str, Column], salts: int = 32) -> DataFrame:
    """Rows of the heavy keys in salted parts, the rest by an ordinary shuffle, both united."""
    salted, rest = _split(df, key, heavy, salts)
    by = _names(key)
    finals = [e.alias(n) for n, e in final.items()]
    parts = [e.alias(n) for n, e in partial.items()]
    of_heavy = salted.groupBy(*by, "__skew_salt").agg(*parts).groupBy(*by).agg(*finals)
    of_rest = rest.groupBy(*by).agg(*parts).groupBy(*by).agg(*finals)
    return of_heavy.unionByName(of_rest)


def _only(df: DataFrame, by: list[str]) -> DataFrame:
    """``df``, which must have one row per key: a second one is an error, so a list of keys bounds the rows."""
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("more than one row per key on the joined side"))).otherwise(F.lit(True))
    return df.groupBy(*by).agg(once.alias("__skew_once"), *[F.first(c).alias(c) for c in df.columns if c not in by]).where("__skew_once").drop("__skew_once")


def skew_join(facts: DataFrame, dimension: DataFrame, key: str | list[str], share: float = 1 / 50, how: str = "left") -> DataFrame:
    """Join of ``facts`` with ``dimension``, which has at most one row per ``key`` and no other column of a fact's name; ``how`` is left or left_semi.

    The dimension's rows of heavy keys are broadcast: at most ``2/share``, as more than one for a key is an error. The rest is an ordinary shuffle join.
    """
    by = _names(key)
    if clash := sorted(set(facts.columns) & set(dimension.columns) - set(by)):
        raise ValueError(f"columns on both sides: {clash}")
    heavy, _ = heavy_keys(facts, key, share)
    theirs = [f"__skew_{i}" for i in range(len(by))]
    renamed = dimension.withColumnsRenamed(dict(zip(by, theirs, strict=True)))
    same = F.lit(True)
    for k, t in zip(by, theirs, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(t))
    short = F.broadcast(facts.sparkSession.createDataFrame([(k,) for k in heavy], "__skew_key string"))
    of_heavy = _only(renamed.join(short, _text(theirs if len(by) > 1 else theirs[0]) == F.col("__skew_key"), "left_semi"), theirs)
    on_list = _text(key) == F.col("__skew_key")
    joined_heavy = facts.join(short, on_list, "left_semi").join(F.broadcast(of_heavy), same, how)
    joined_rest = facts.join(short, on_list, "left_anti").join(renamed, same, how)
    return joined_heavy.unionByName(joined_rest).drop(*theirs)


def keys_with_share(df: DataFrame, key: str, share: float = 1 / 50) -> DataFrame:
    """(key, rows): every key that holds at least ``share`` of all rows, by the totals of the heavy keys and of the rest."""
    heavy, rows = heavy_keys(df, key, share)
    totals = _aggregated(df.select(key), key, heavy, {"n": F.count(F.lit(1))}, {"rows": F.sum("n")})
    return totals.where(F.col("rows") >= math.ceil(rows * Fraction(share).limit_denominator(1_000_000)))
