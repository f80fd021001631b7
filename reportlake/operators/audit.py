"""Word-loss audit between a source text and what was made of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.functions.text import tokens


def bag(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, token, n``: the multiset of tokens of each text."""
    return texts.where(F.col(text).isNotNull()).select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def bag_difference(source: DataFrame, output: DataFrame, key: str, text: str) -> DataFrame:
    """``key, token, missing, added``: tokens that one text has more often than the other.

    Both bags are counted in one aggregation with signed counts, so no join is needed."""
    a = source.where(F.col(text).isNotNull()).select(key, F.explode(tokens(F.col(text))).alias("token"), F.lit(1).alias("d"))
    b = output.where(F.col(text).isNotNull()).select(key, F.explode(tokens(F.col(text))).alias("token"), F.lit(-1).alias("d"))
    d = F.col("d")
    return (
        a.unionByName(b).groupBy(key, "token").agg(F.sum("d").cast("bigint").alias("d")).where(d != 0)
        .select(key, "token", F.greatest(d, F.lit(0)).alias("missing"), F.greatest(-d, F.lit(0)).alias("added"))
    )


def missing_numbers(source: DataFrame, output: DataFrame, key: str, text: str) -> DataFrame:
    """``key, number``: numbers of the source that its output lacks."""
    return bag_difference(source, output, key, text).where((F.col("missing") > 0) & F.col("token").rlike(r"^\d+(\.\d+)?$")).select(key, F.col("token").alias("number"))
