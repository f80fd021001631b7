"""Mixing sources to target weights by temperature and block permutations.

The source token shares are exponentiated: one exponent is bisected until the entropy of
the shares is that of the targets.  From this tempered mix the shares move on to the
targets along ``tempered^(1-a) * target^a``; ``a`` is bisected to the largest value at
which no source needs more repeats than it may have.  Sources at their limit are pinned
there and both exponents are bisected again for the others, until ``a`` reaches 1, where
the remaining shares stand to each other as the targets do.  Each share becomes a budget
of tokens, spent on whole passes of the source, each over a block permutation of its
own, and one partial pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportlake.llm.bpe import DEFAULT_VOCABULARY, token_counts
from reportlake.session import cut

#: Part of all tokens that a mix holds at least, if no total is asked for.
MIN_FILL = 0.5
#: Documents in a block of the permutation, on average.
BLOCK_DOCS = 2_000
#: Parts of a pass whose sizes are summed up apart before the blocks inside them.
SPANS = 1_024
#: Sources that a weights table may list; only their totals come to the driver.
MAX_SOURCES = 100_000
#: Exponents between which the temperature is searched.
EXPONENTS = (0.0, 8.0)


@dataclass
class Source:
    name: str
    tokens: int
    target: float
    max_repeats: int
    share: float = 0.0


def entropy(shares: list[float]) -> float:
    """Shannon entropy in nats."""
    return -sum(s * math.log(s) for s in shares if s > 0)


def tempered(tokens: list[float], target_entropy: float) -> list[float]:
    """Token shares to the power whose entropy is nearest to ``target_entropy``.

    The power 0 gives equal shares, 1 the shares as they are; entropy falls as it grows."""
    largest = max(tokens)

    def at(power: float) -> list[float]:
        raw = [(t / largest) ** power for t in tokens]
        return [r / sum(raw) for r in raw]

    low, high = EXPONENTS
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(at(middle)) > target_entropy else (low, middle)
    return at((low + high) / 2)


def plan_shares(sources: list[Source], total: int | None = None, min_fill: float = MIN_FILL) -> tuple[int, list[Source]]:
    """Total tokens and the sources with ``share`` set (of the total, in sum 1 where
    the repetition limits allow it).

    Sources without tokens or with target 0 get share 0.  Without ``total`` it is the
    largest at which every other target is met exactly, but ``min_fill`` of all tokens
    at least."""
    live = [s for s in sources if s.tokens > 0 and s.target > 0 and s.max_repeats > 0]
    if not live:
        return 0, sources
    weight = sum(s.target for s in live)
    if total is None:
        exact = min(s.max_repeats * s.tokens * weight / s.target for s in live)
        total = int(max(exact, min_fill * sum(s.tokens for s in live)))
    free, left = list(live), float(total)
    while free and left > 0:
        weight = sum(s.target for s in free)
        target = [s.target / weight for s in free]
        start = tempered([s.tokens for s in free], entropy(target))

        def at(a: float, start=start, target=target) -> list[float]:
            raw = [b ** (1 - a) * t**a for b, t in zip(start, target, strict=True)]
            return [r / sum(raw) for r in raw]

        def load(shares: list[float], free=free, left=left) -> list[float]:
            return [q * left / (s.max_repeats * s.tokens) for q, s in zip(shares, free, strict=True)]

        if max(load(target)) <= 1 + 1e-12:
            for s, q in zip(free, target, strict=True):
                s.share = q * left / total
            break
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if max(load(at(middle))) <= 1 + 1e-12 else (low, middle)
        # pin what the exponent stopped at (those nearest to their limit) and go on with the others
        loads = load(at(low))
        pinned = [s for s, x in zip(free, loads, strict=True) if x >= max(loads) - 1e-9]
        for s in pinned:
            s.share = min(s.max_repeats * s.tokens, left) / total
            left -= s.share * total
        free = [s for s in free if s not in pinned]
    return total, sources


def sized(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id, source, tokens``, written once: totals, blocks and picks all read it."""
    return cut(token_counts(docs, ["doc_id", "source"], vocabulary))


def mix(
    docs: DataFrame,
    weights: DataFrame,
    total: int | None = None,
    seed: int = 7,
    vocabulary: str = DEFAULT_VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """(uses, report) of a mix.

    uses: ``doc_id, source, use_no, turn, block_no, tokens``, one row per use of a
    document; ``turn`` is the place of its block in the permutation of that pass.
    report: ``source, target_share, max_repeats, tokens, share, budget, used_tokens,
    actual_share, documents, uses``; a source of the documents that is not listed, or
    listed without documents, is reported with share 0.

    Null, empty texts have 0 tokens and ride along with their block; documents with a
    null source are never drawn.  Repeated rows are separate documents.  Empty tables
    give an empty mix."""
    spark = docs.sparkSession
    docs = sized(docs, vocabulary)
    listed = weights.where("source is not null").groupBy("source").agg(
        F.sum("target_share").alias("target"), F.max("max_repeats").alias("repeats")
    )
    totals = docs.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    rows = listed.join(totals, "source", "full_outer").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = [Source(r.source, r.tokens or 0, r.target or 0.0, r.repeats or 0) for r in rows]
    total, sources = plan_shares(sources, total)
    blocks = {r.source: max(1, -(-(r.n or 0) // BLOCK_DOCS)) for r in rows}
    budget = {s.name: min(round(s.share * total), s.max_repeats * s.tokens) for s in sources}
    plan = spark.createDataFrame(
        [
            (s.name, float(s.target), int(s.max_repeats), int(s.tokens), float(s.share), int(budget[s.name]),
             int(budget[s.name] // s.tokens) if s.tokens else 0, int(budget[s.name] % s.tokens) if s.tokens else 0, int(blocks[s.name]))
            for s in sources
        ],
        "source string, target_share double, max_repeats int, tokens bigint, share double, budget bigint, whole int, part bigint, blocks bigint",
    )
    # at most MAX_SOURCES rows, checked above
    chosen = F.broadcast(plan.where("budget > 0").select("source", "whole", "part", "blocks"))
    placed = docs.join(chosen, "source").select(
        "doc_id", "source", "tokens", "whole", "part",
        F.pmod(F.xxhash64("source", "doc_id", F.lit(seed)), F.col("blocks")).alias("block_no"),
        F.xxhash64("doc_id", "source", F.lit(seed + 1)).alias("rank"),
    )
    sizes = placed.groupBy("source", "block_no").agg(F.sum("tokens").alias("block_tokens"), F.first("whole").alias("whole"), F.first("part").alias("part"))
    # every pass takes the blocks in an order of its own; sums run over spans of a pass, then inside each
    turn = F.xxhash64("block_no", "use_no", F.lit(seed + 2))
    passes = sizes.withColumn("use_no", F.explode(F.sequence(F.lit(0), F.col("whole")))).where("use_no < whole or part > 0").withColumns(
        {"turn": turn, "span": F.pmod(F.shiftright(turn, 20), F.lit(SPANS))}
    )
    in_span = Window.partitionBy("source", "use_no", "span").orderBy("turn", "block_no")
    spans = passes.groupBy("source", "use_no", "span").agg(F.sum("block_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("source", "use_no").orderBy("span")
    starts = spans.select("source", "use_no", "span", (F.sum("t").over(over) - F.col("t")).alias("t0"), (F.sum("n").over(over) - F.col("n")).alias("n0"))
    ordered = passes.join(starts, ["source", "use_no", "span"]).select(
        "source", "use_no", "block_no", "block_tokens", "whole", "part",
        (F.col("t0") + F.sum("block_tokens").over(in_span) - F.col("block_tokens")).alias("block_start"), (F.col("n0") + F.row_number().over(in_span) - 1).alias("turn"),
    )
    taken = ordered.where("use_no < whole or block_start < part").withColumn(
        "room", F.when(F.col("use_no") < F.col("whole"), F.col("block_tokens")).otherwise(F.least(F.col("block_tokens"), F.col("part") - F.col("block_start")))
    )
    spread = placed.select("doc_id", "source", "tokens", "block_no", "rank").join(taken.select("source", "block_no", "use_no", "turn", "room", "block_tokens"), ["source", "block_no"])
    within = Window.partitionBy("source", "use_no", "block_no").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    columns = ["doc_id", "source", "use_no", "turn", "block_no", "tokens"]
    full = spread.where("room = block_tokens").select(*columns)
    partial = spread.where("room < block_tokens").withColumn("upto", F.sum("tokens").over(within)).where("upto <= room").select(*columns)
    uses = full.unionByName(partial)
    spent = uses.groupBy("source").agg(
        F.sum("tokens").alias("used_tokens"), F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("uses")
    )
    report = plan.join(spent, "source", "left").select(
        "source", "target_share", "max_repeats", "tokens", "share", "budget",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("used_tokens", "documents", "uses")),
    )
    everything = Window.partitionBy()  # one row per source
    report = report.withColumn("actual_share", F.col("used_tokens") / F.nullif(F.sum("used_tokens").over(everything), F.lit(0)))
    return uses, report
