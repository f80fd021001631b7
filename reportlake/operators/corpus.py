"""Library operators: n-grams, chunk packing, hash vectors, passage search, memory scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters a packed chunk holds, and buckets of a hash vector.
CHUNK_CHARS = 1_400
HASH_DIM = 256
#: Queries compared with the rows at once.
QUERY_BLOCK = 512
HALF_LIFE_DAYS = 180.0


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z'\-]{2,}|\d+(?:\.\d+)?)"), 1)


def ngrams(texts: DataFrame, text: str, n: int, min_count: int) -> DataFrame:
    """``gram, n`` of the runs of ``n`` words that occur ``min_count`` times."""
    w = texts.where(F.col(text).isNotNull()).select(words(F.col(text)).alias("w")).where(F.size("w") >= n)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    return w.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def pack_chunks(docs: DataFrame, key: str, text: str, size: int = CHUNK_CHARS) -> DataFrame:
    """``key, seq, chunk``: paragraphs packed to ``size`` characters, the last one carried over.

    A fold over each document's paragraphs inside the JVM; null texts give no rows."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit("").alias("last"))

    def step(s: Column, p: Column) -> Column:
        full = (s.now != "") & (F.length(s.now) + F.length(p) + 2 > size)
        carried = F.when(s["last"] != "", F.concat(s["last"], F.lit("\n\n"), p)).otherwise(p)
        longer = F.when(s.now != "", F.concat(s.now, F.lit("\n\n"), p)).otherwise(p)
        return F.struct(
            F.when(full, F.concat(s.done, F.array(s.now))).otherwise(s.done).alias("done"), F.when(full, carried).otherwise(longer).alias("now"), p.alias("last")
        )

    end = lambda s: F.when(s.now != "", F.concat(s.done, F.array(s.now))).otherwise(s.done)
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.aggregate(parts, start, step, end)).alias("seq", "chunk"))


def hash_vectors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, bucket, weight``: sparse unit vectors, each word in the bucket of its hash."""
    bucket = F.conv(F.right(F.sha1("w"), F.lit(2)), 16, 10).cast("int")
    counted = docs.where(F.col(text).isNotNull()).select(key, F.explode(words(F.col(text))).alias("w")).groupBy(key, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counted.select(key, "bucket", (F.col("n") / norm).alias("weight"))


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """``query, id, rank, score``: the k most similar rows of every query by cosine.

    Queries form blocks of ``QUERY_BLOCK`` vectors; every row batch is multiplied with
    every block and keeps its k best, so what is shuffled is k rows per query and task."""
    width = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    blocks = queries.where(F.col(vector).isNotNull()).groupBy(F.pmod(F.xxhash64(key), F.lit(width)).cast("int").alias("block")).agg(
        F.collect_list(F.struct(F.col(key).alias("q"), F.col(vector).alias("v"))).alias("members")
    )
    spread = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("block"))

    def multiply(key_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "id": [], "score": []})
        left = left.sort_values("id")
        members = right["members"].iat[0]
        q, ids = np.array([m["q"] for m in members]), left["id"].to_numpy()
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        s = unit(np.array([m["v"] for m in members], dtype=np.float64)) @ unit(np.stack(left["v"].to_numpy()).astype(np.float64)).T
        s[q[:, None] == ids[None, :]] = -2
        n = min(k, len(ids))
        best = np.argsort(-s.round(6), axis=1, kind="stable")[:, :n]
        return pd.DataFrame({"query": np.repeat(q, n), "id": ids[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()})

    parts = max(8, rows.sparkSession.sparkContext.defaultParallelism)
    salted = spread.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    wide = blocks.select("block", "members", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    part = salted.groupBy("block", "part").cogroup(wide.groupBy("block", "part")).applyInPandas(multiply, "query bigint, id bigint, score double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 6)), "id")
    return part.where("score > -2").withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).select("query", "id", "rank", F.round("score", 4).alias("score"))


def memory_strength(memories: DataFrame, today: str) -> DataFrame:
    """``memory_id, strength``: confidence halved every 180 days since last use (or creation)."""
    seen = F.left(F.coalesce(F.nullif("last_used", F.lit("")), F.col("created")), F.lit(10))
    age = F.greatest(F.datediff(F.lit(today).cast("date"), F.try_to_date(seen)), F.lit(0))
    return memories.where("memory_id is not null").select("memory_id", F.round(F.col("confidence") * F.exp(-math.log(2) / HALF_LIFE_DAYS * age), 4).alias("strength")).distinct()

