"""Memories of preferences: confirmation and supersession as a replay, retrieval, archives, owners."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_LIFE_DAYS = 180.0
MIN_SCORE = 0.05


def content_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"\.+$", ""))


def replayed(log: DataFrame, kinds: tuple[str, ...] = ("style_rule",)) -> DataFrame:
    """``owner, kind, concept, content, confidence, seq`` from a log ``seq, owner, kind,
    concept, content`` of things to remember.

    The same content of an owner and kind is one memory, confirmed anew at its last
    entry; a new content under the same concept (of ``kinds``) halves the confidence of the
    memories of that concept that exist by then.  So a memory's confidence is 0.5 to the
    number of other contents first seen after its last confirmation.  Blank contents
    teach nothing; entries without concept supersede nothing."""
    rows = log.where(F.col("content").isNotNull() & (F.trim("content") != "")).select(
        "seq", "owner", "kind", F.trim(F.coalesce("concept", F.lit(""))).alias("concept"), F.trim("content").alias("content"), content_key(F.col("content")).alias("k")
    )
    one = rows.groupBy("owner", "kind", "k").agg(
        F.min("seq").alias("first"), F.max("seq").alias("last"), F.min_by("content", "seq").alias("content"), F.min_by("concept", "seq").alias("concept")
    )
    # memories of the concept first seen after this one's last confirmation, by a running
    # count from the newest on; at one time the confirmation comes before the first mention
    group = ["owner", "kind", F.lower("concept").alias("c")]
    events = one.select(*group, "k", F.col("last").alias("at"), F.lit(0).alias("new")).unionByName(
        one.select(*group, F.lit(None).cast("string").alias("k"), F.col("first").alias("at"), F.lit(1).alias("new"))
    )
    back = Window.partitionBy("owner", "kind", "c").orderBy(F.desc("at"), "new").rowsBetween(Window.unboundedPreceding, 0)
    later = events.withColumn("later", F.sum("new").over(back)).where("new = 0").select("owner", "kind", "k", "later")
    rules = F.col("kind").isin(*kinds) & (F.col("concept") != "")
    return one.join(later, ["owner", "kind", "k"]).select(
        "owner", "kind", "concept", "content", F.when(rules, F.pow(F.lit(0.5), F.col("later"))).otherwise(1.0).alias("confidence"), F.col("first").alias("seq")
    )


def overlap(a: Column, b: Column) -> Column:
    """Shared words of two word sets over the geometric mean of their sizes."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.sqrt(F.size(a).cast("double") * F.size(b))).otherwise(0.0)


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z'\-]{2,}|\d+(?:\.\d+)?)"), 1))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one is empty or all zero, or the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def retrieved(queries: DataFrame, memories: DataFrame, today: str, k: int = 5, min_score: float = MIN_SCORE) -> DataFrame:
    """``query, memory_id, score, rank``: the k memories that serve each query best.

    ``queries``: query, owner, text and optionally embedder and vector; ``memories``:
    memory_id, owner, content, embedder, vector, confidence, last_used, created.  Cosine
    where both come from one embedder, else the overlap of their words; times confidence
    and the decay since the last use.  Only an owner's own memories are compared, in an
    equality join; top k by score, then by content."""
    q = queries.select("query", "owner", word_set(F.col("text")).alias("qw"), *(F.col(c).alias(f"q_{c}") for c in ("embedder", "vector")))
    seen = F.left(F.coalesce(F.nullif("last_used", F.lit("")), F.col("created")), F.lit(10))
    age = F.greatest(F.coalesce(F.datediff(F.lit(today).cast("date"), F.try_to_date(seen)), F.lit(0)), F.lit(0))
    m = memories.select("memory_id", "owner", "content", word_set(F.col("content")).alias("mw"), "embedder", "vector", "confidence", age.alias("age")).dropDuplicates(["memory_id"])
    alike = F.when((F.col("embedder") == F.col("q_embedder")) & F.col("vector").isNotNull(), cosine(F.col("vector"), F.col("q_vector"))).otherwise(overlap(F.col("qw"), F.col("mw")))
    score = F.bround(alike * F.exp(-math.log(2) / HALF_LIFE_DAYS * F.col("age")) * F.col("confidence"), 4)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.lower("content"), "memory_id")
    scored = q.join(m, "owner").withColumn("score", score).where(F.col("score") >= min_score)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "memory_id", "score", F.col("rank").cast("bigint").alias("rank"))


def reinforced(memories: DataFrame, hits: DataFrame, now: str) -> DataFrame:
    """The memories with ``uses`` raised by their retrievals and ``last_used`` set: what
    keeps being useful stays fresh."""
    n = hits.groupBy("memory_id").agg(F.count(F.lit(1)).cast("int").alias("__hits"))
    joined = memories.join(n, "memory_id", "left")
    return joined.withColumns(
        {"uses": F.coalesce("uses", F.lit(0)) + F.coalesce("__hits", F.lit(0)), "last_used": F.when(F.col("__hits").isNotNull(), F.lit(now)).otherwise(F.col("last_used"))}
    ).drop("__hits")


def forgotten(memories: DataFrame, gone: DataFrame) -> DataFrame:
    """Memories without those whose owner and content ``gone`` names."""
    keys = gone.select(F.col("owner").alias("__o"), content_key(F.col("content")).alias("__k")).distinct()
    return memories.join(keys, (F.col("owner") == F.col("__o")) & (content_key(F.col("content")) == F.col("__k")), "left_anti")


def renamed(collections: dict[str, DataFrame], old: str, new: str) -> tuple[dict[str, DataFrame], dict[str, Column]]:
    """Collections with the owner renamed, and for each the count of changed rows as an
    aggregate to apply to the collection as it was."""
    change = {n: df.withColumn("owner", F.when(F.col("owner") == old, F.lit(new)).otherwise(F.col("owner"))) for n, df in collections.items()}
    return change, {n: F.count_if(F.col("owner") == old).alias("changed") for n in collections}


def without_owner(collections: dict[str, DataFrame], owner: str) -> dict[str, DataFrame]:
    return {n: df.where(~F.col("owner").eqNullSafe(F.lit(owner))) for n, df in collections.items()}


def archived(rows: DataFrame, before: str, after: str, keep: int) -> DataFrame:
    """The newest ``keep`` pairs of every owner whose two texts are filled and differ."""
    filled = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    order = Window.partitionBy("owner").orderBy(F.desc("seq"))
    real = rows.where(filled(before) & filled(after) & (F.trim(before) != F.trim(after)))
    return real.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= keep).drop("__n")


def preference_json(pairs: DataFrame) -> DataFrame:
    """``owner, line``: one JSON line of a preference set per pair."""
    named = {"prompt": "raw_prompt", "rejected": "ai_draft", "chosen": "final_edit", "rule": "rule", "doctor": "owner", "when": "when_"}
    return pairs.select("owner", F.to_json(F.struct(*(F.coalesce(c, F.lit("")).alias(k) for k, c in named.items()))).alias("line"))
