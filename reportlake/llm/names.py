"""Variant spellings of names linked by n-gram cosines and average linkage.

A name is reduced to a bag of words and initials, and the bag to a sparse vector of
character bigrams weighted by their rarity.  The similarity join runs over an inverted
index of prefix features: parts of the vectors (bigrams of one word next to the other
word) chosen so that any two names which may be one entity share one.  Pairs get their
cosine, those below the threshold fall out, an exact comparison word by word follows, and
average linkage over the remaining strengths groups each connected component.

Lists of partners are not cut at a fixed n: all partners above the threshold stay, since
a cut would lose links.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.operators.graph import components
from reportlake.session import cut, release

# Words around a name that are not part of it.
TITLES = frozenset("mr mrs ms miss master mister missus shri smt sri dr prof doctor professor kumari baby".split())
PLACEHOLDERS = frozenset("unknown unnamed anonymous test self opd casualty none nil na".split())
LABELS = (
    r"mrn|uhid|reg|ip no|op|opd no|ip|opd|hosp|hospital|identity|national|passport|health id|insurance|resident|id proof|"
    r"file|ph|tel|mob|mobile|contact|phone"
)

#: Entries of a list of short forms or places at most.
MAX_LIST = 20_000
#: Letters from which a word may have one edit, and two.
ONE_EDIT, TWO_EDITS = 4, 6
#: Cosine below which two names are no candidates, and strength that average linkage needs.
MIN_COSINE = 0.35
MIN_LINK = 0.40
#: Bigrams in less than this part of all names weigh alike, so at most (bigrams of a
#: name) / RARE_SHARE of them have a weight of their own.
RARE_SHARE = 0.002
#: Years by which birth dates worked out from two records of a person may differ.
AGE_SLACK = 2.0
#: Years of a birth block: two nodes that fit begin within it of each other.
BLOCK_YEARS = 4
#: Links of a component that one task groups in memory; larger ones are grouped by Spark.
MAX_LOCAL_LINKS = 200_000


# names as bags of words


def _bounded(rows: DataFrame) -> list:
    """The rows of a list of common knowledge (short forms, places), which does not
    grow with the records; more than ``MAX_LIST`` are refused."""
    got = rows.limit(MAX_LIST + 1).collect()
    if len(got) > MAX_LIST:
        raise ValueError(f"more than {MAX_LIST} entries in a list of short forms or places")
    return got


def short_forms(aliases: DataFrame | None) -> dict[str, tuple[str, ...]]:
    """Short form -> given names it stands for."""
    if aliases is None:
        return {}
    pairs = aliases.where("given_name is not null and short_name is not null").select(
        F.lower(F.trim("short_name")).alias("short"), F.lower(F.trim("given_name")).alias("given")
    )
    out: dict[str, set[str]] = defaultdict(set)
    for r in _bounded(pairs.distinct()):
        out[r.short].add(r.given)
    return {s: tuple(sorted(g)) for s, g in out.items()}


_CUT_OFF = re.compile(rf"(?:\s(?:{LABELS})\b[\s.:#-].*|\s[wsdc]/o\b.*|\s*[(/+\d].*)$", re.S)
_INNER_MARK = re.compile(r"(?<=[^\W\d_])[-'’](?=[^\W\d_])")
_LETTERS = re.compile(r"[^\W\d_]+")


def bag_of(name: str, short: dict[str, tuple[str, ...]], drop: frozenset = frozenset()) -> tuple[list[str], list[str]]:
    """(words, initials) of a typed name, both sorted.

    Numbers, labels, relatives and brackets behind the name are cut off, titles dropped,
    short forms replaced by the given name; one that stands for several names becomes
    the initial they share."""
    plain = _CUT_OFF.sub("", " ".join(name.lower().split()), count=1)
    found = [w for w in _LETTERS.findall(_INNER_MARK.sub("", plain)) if w not in TITLES and w not in drop]
    words, initials = [], []
    for w in found:
        given = short.get(w, (w,))
        if len(w) == 1 or len(given) > 1:
            initials.append(given[0][:1])
        else:
            words.append(given[0])
    return sorted(words), sorted(initials)


def with_bags(rows: DataFrame, name: str, short: dict, drop: frozenset = frozenset()) -> DataFrame:
    """Adds ``words``, ``initials`` and their joint ``key``; rows without words, and
    those that hold a placeholder, are left out."""
    kept = list(rows.columns)
    known = rows.sparkSession.sparkContext.broadcast((short, drop))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = lru_cache(50_000)(lambda t: bag_of(t, *known.value))
        for b in batches:
            bags = [read(t) for t in b[name]]
            ok = [bool(w) and PLACEHOLDERS.isdisjoint(w) for w, _ in bags]
            out = b[ok].copy()
            bags = [x for x, good in zip(bags, ok, strict=True) if good]
            out["words"], out["initials"] = [w for w, _ in bags], [i for _, i in bags]
            out["key"] = [" ".join([*w, *i]) for w, i in bags]
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.select(*kept).mapInPandas(parse, f"{schema}, words array<string>, initials array<string>, key string")


# the vectors and their index


def _bigrams(word: str) -> list[str]:
    whole = f"^{word}$"
    return [whole[i : i + 2] for i in range(len(word) + 1)]


def bigram_weights(nodes: DataFrame, share: float = RARE_SHARE) -> tuple[dict[str, float], float]:
    """(weight of each bigram that stands in at least ``share`` of all names, weight of
    all others): the log of how rare it is, counted over all names."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for words, initials in zip(b["words"], b["initials"], strict=True):
                seen.update({g for w in words for g in _bigrams(w)} | {f"^{i}" for i in initials})
            yield pd.DataFrame({"g": list(seen), "n": list(seen.values())})

    total = nodes.count()
    counted = nodes.select("words", "initials").mapInPandas(count, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n"))
    common = counted.where(F.col("n") >= max(2.0, share * total)).collect()
    return {r.g: math.log(1 + total / r.n) for r in common}, math.log(1 + min(total, 1 / share))


def _readings(words: list[str]) -> list[tuple[str, str | None]]:
    """The ways to read a bag as two words: three words may be two with one split."""
    if len(words) == 1:
        return [(words[0], None)]
    if len(words) == 3:
        orders = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))
        return [(words[a], words[b] + words[c]) for a, b, c in orders]
    return [(words[0], "".join(words[1:]))]


class Vectors:
    """Weighted bigram vectors of bags, their cosines, prefix features and comparison."""

    def __init__(self, weights: dict[str, float], rare: float) -> None:
        self.weights, self.rare = weights, rare
        self.marks = lru_cache(100_000)(self._marks)
        self.halves = lru_cache(100_000)(self._halves)
        self.edits = lru_cache(500_000)(same_word)

    def vector(self, words: list[str], initials: list[str]) -> tuple[dict[str, float], float]:
        v: dict[str, float] = {}
        for g in [g for w in words for g in _bigrams(w)] + [f"^{i}" for i in initials]:
            v[g] = v.get(g, 0.0) + self.weights.get(g, self.rare)
        return v, math.sqrt(sum(x * x for x in v.values()))

    @staticmethod
    def cosine(a: tuple[dict[str, float], float], b: tuple[dict[str, float], float]) -> float:
        (va, na), (vb, nb) = a, b
        if len(va) > len(vb):
            va, vb = vb, va
        return sum(x * vb[g] for g, x in va.items() if g in vb) / (na * nb) if na and nb else 0.0

    def _marks(self, word: str) -> list[str]:
        """The rarest bigrams of a word, one of which any word within its edits has too:
        an edit touches two bigrams, so of 2e + 1 in a fixed order one is left."""
        if len(word) < ONE_EDIT:
            return [word]
        seen: Counter = Counter()
        counted = []
        for g in _bigrams(word):
            seen[g] += 1
            counted.append((-self.weights.get(g, self.rare), f"{g}{seen[g]}"))
        return [g for _, g in sorted(counted)[: 5 if len(word) >= TWO_EDITS else 3]]

    @staticmethod
    def _halves(word: str) -> list[str]:
        """Starts and ends of which two words one edit apart share one."""
        n = len(word)
        return sorted({x for m in (n // 2, (n - 1) // 2) for x in (f"^{word[:m]}", f"{word[n - m:]}$")})

    def features(self, words: list[str], initials: list[str]) -> tuple[list[int], list[int], bool]:
        """(full, short, one): names that ``strength`` accepts share a full feature, or a
        short one where one of them has a single word (``one``).  A full feature is a
        word with a mark of the other, or halves of both; a short one the initial of a
        word with a mark of the other."""
        full, short = set(), set()
        if len(words) == 1:
            short = {f"i {i} {m}" for i in initials for m in self.marks(words[0])}
        else:
            for p, q in _readings(words):
                short.update(f"i {a[0]} {m}" for a, b in ((p, q), (q, p)) for m in self.marks(b))
                full.update(f"e {a} {m}" for a, b in ((p, q), (q, p)) for m in self.marks(b))
                if min(len(p), len(q)) >= ONE_EDIT:
                    full.update(f"h {min(x, y)} {max(x, y)}" for x in self.halves(p) for y in self.halves(q))
        return [_hash(x) for x in sorted(full)], [_hash(x) for x in sorted(short)], len(words) == 1

    def agreement(self, a: tuple[list[str], list[str]], b: tuple[list[str], list[str]]) -> float | None:
        """1 for equal names, less for each edit or abbreviation, None for different ones.

        Both words must be found in the other name (as such, with few edits, or as an
        initial); a name of one word without initial fits nothing here."""
        best = None
        for p, q in _readings(a[0]):
            for r, s in _readings(b[0]):
                if q and s:
                    got = max(filter(None, (self._two(p, r, q, s), self._two(p, s, q, r))), default=None)
                elif q or s:
                    long, one, init = ((p, q), r, b[1]) if q else ((r, s), p, a[1])
                    got = max(filter(None, (self._short(long[0], long[1], one, init), self._short(long[1], long[0], one, init))), default=None)
                else:
                    e = self.edits(p, r)
                    got = 0.8 - 0.08 * e if e is not None and not set(a[1]).isdisjoint(b[1]) else None
                if got is not None and (best is None or got > best):
                    best = got
        return best

    def _two(self, p: str, r: str, q: str, s: str) -> float | None:
        e = self.edits(p, r)
        if e is None:
            return None
        f = self.edits(q, s)
        if f is None or (min(e, f) > 0 and max(e, f) > 1):
            return None
        return 1.0 - 0.08 * (e + f)

    def _short(self, word: str, other: str, one: str, initials: list[str]) -> float | None:
        if other[0] not in initials:
            return None
        e = self.edits(word, one)
        return None if e is None else 0.85 - 0.08 * e


def same_word(x: str, y: str) -> int | None:
    """Edits between two words if they may be one, else None."""
    if x == y:
        return 0
    if len(x) > len(y):
        x, y = y, x
    most = 2 if len(x) >= TWO_EDITS else 1 if len(x) >= ONE_EDIT else 0
    if len(y) - len(x) > most:
        return None
    i, n = 0, len(x)
    while i < n and x[i] == y[i]:
        i += 1
    j = 0
    while j < n - i and x[-1 - j] == y[-1 - j]:
        j += 1
    x, y = x[i : n - j], y[i : len(y) - j]
    if len(y) <= 1:
        return len(y) if len(y) <= most else None
    if most < 2:
        return None
    row = list(range(len(x) + 1))
    for k, c in enumerate(y, 1):
        last, row[0] = row[0], k
        for m, d in enumerate(x, 1):
            last, row[m] = row[m], min(last + (c != d), row[m] + 1, row[m - 1] + 1)
        if min(row) > most:
            return None
    return row[-1] if row[-1] <= most else None


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >= 1 << 63 else h


def with_features(nodes: DataFrame, weights) -> DataFrame:
    """``no, space, lo, one, full, short`` (see ``Vectors.features``)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = Vectors(*weights.value)
        for b in batches:
            got = [vectors.features(list(w), list(i)) for w, i in zip(b["words"], b["initials"], strict=True)]
            out = b[["no", "space", "lo"]].copy()
            out["one"], out["full"], out["short"] = [g[2] for g in got], [g[0] for g in got], [g[1] for g in got]
            yield out

    src = nodes.select("no", "space", "lo", "words", "initials")
    return src.mapInPandas(make, "no bigint, space string, lo double, one boolean, full array<bigint>, short array<bigint>")


def _sided(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(F.col("no").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in nodes.columns if c != "no"))


def candidates(nodes: DataFrame, weights, listed: DataFrame | None = None) -> DataFrame:
    """``a, b``: numbers of nodes of one space that share an index feature and whose
    births may fit; with ``listed`` (nodes without births), of a node and a listed one.

    Every node is stored in the block of its first birth.  Two nodes that fit begin within
    ``BLOCK_YEARS`` of each other (their runs and the slack are two years each), so of two
    full names the earlier one asks its own block and the next; a name of one word asks
    the block before, too.  Nodes without birth ask all blocks that their space has.
    Names of two words do not meet each other by short features."""
    keyed = cut(with_features(nodes, weights))
    slot = F.coalesce(F.floor(F.col("lo") / BLOCK_YEARS).cast("int"), F.lit(-1))
    placed = keyed.withColumn("slot", slot)
    held = with_features(listed, weights).withColumn("slot", F.lit(-1)) if listed is not None else placed
    # space, block and feature travel as one number; spaces are compared again with the pair
    at = lambda features, kind: F.transform(features, lambda k: F.xxhash64("space", "slot", F.lit(kind), k))
    full, to_one, to_full = at("full", "full"), at("short", "one"), at("short", "two")
    stored = held.select(F.col("no").alias("b"), F.explode(F.when(F.col("one"), to_one).otherwise(F.concat(full, to_full))).alias("at"))
    dated = placed.where("lo is not null").withColumn(
        "slot", F.explode(F.when(F.col("one"), F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).otherwise(F.array(F.col("slot"), F.col("slot") + 1)))
    )
    blocks = placed.select(F.col("space").alias("s"), F.col("slot").alias("t")).distinct()
    undated = placed.where("lo is null")
    if listed is None:
        undated = undated.join(blocks, F.col("space").eqNullSafe(F.col("s"))).withColumn("slot", F.col("t")).drop("s", "t")
    asks = lambda df, one, two: df.select(F.col("no").alias("a"), F.explode(F.when(F.col("one"), one).otherwise(two)).alias("at"))
    asked = asks(dated, F.concat(to_one, to_full), full).unionByName(asks(undated, F.concat(to_one, to_full), F.concat(full, to_one)))
    met = asked.join(stored, "at")
    if listed is None:
        met = met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    met = cut(met.select("a", "b").distinct())
    release(keyed)
    return met


def linked(nodes: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """``a, b, cosine, agreement, strength, a_weight, b_weight``: the similarity join of
    the nodes ``node, space, words, initials, lo, hi, sex, weight`` with each other, or
    with the listed nodes.

    Pairs of one space whose ages and sexes fit, with a cosine of ``MIN_COSINE`` and an
    agreement word by word; the strength is their mean.  A word standing alone agrees
    with a listed name that ends with it (``last`` of the listed nodes)."""
    # numbers that compress better than the hashes, fixed by the checkpoint
    nodes = cut(nodes.withColumn("no", F.monotonically_increasing_id()))
    if listed is not None:
        listed = cut(listed.withColumn("no", F.monotonically_increasing_id()))
    weights = nodes.sparkSession.sparkContext.broadcast(bigram_weights(nodes))
    met = candidates(nodes, weights, listed)
    if listed is not None:
        met = met.unionByName(_lone_candidates(nodes, listed)).distinct()
    pairs = met.join(_sided(nodes, "a"), "a").join(_sided(nodes if listed is None else listed, "b"), "b").where("a_space <=> b_space")
    ages_fit = F.coalesce(
        (F.greatest("a_hi", "b_hi") - F.least("a_lo", "b_lo")) <= AGE_SLACK + F.greatest(F.col("a_hi") - F.col("a_lo"), F.col("b_hi") - F.col("b_lo")),
        F.lit(True),
    )
    sexes_fit = F.coalesce(F.col("a_sex") == F.col("b_sex"), F.lit(True))
    last = ["b_last"] if listed is not None else []

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = Vectors(*weights.value)
        known = lru_cache(100_000)(vectors.vector)
        for b in batches:
            out = []
            bags = [[tuple(x) for x in b[c]] for c in ("a_words", "a_initials", "b_words", "b_initials")]
            for k, (a, o, na, nb, wa, ia, wb, ib) in enumerate(zip(*(b[c].tolist() for c in ("a_node", "b_node", "a_weight", "b_weight")), *bags, strict=True)):
                cosine = vectors.cosine(known(wa, ia), known(wb, ib))
                if cosine < MIN_COSINE:
                    continue
                agrees = vectors.agreement((wa, ia), (wb, ib))
                if last and agrees is None and len(wa) == 1 and not ia:
                    e = vectors.edits(wa[0], b["b_last"].iat[k])
                    agrees = None if e is None else 0.7 - 0.08 * e
                elif last and agrees is not None and len(wa) > 1 and ia and ib and set(ia).isdisjoint(ib):
                    agrees -= 0.2
                if agrees is not None:
                    out.append((a, o, cosine, agrees, (cosine + agrees) / 2, na, nb))
            yield pd.DataFrame(out, columns=["a", "b", "cosine", "agreement", "strength", "a_weight", "b_weight"])

    src = pairs.where(ages_fit & sexes_fit).select("a_node", "b_node", "a_weight", "b_weight", "a_words", "a_initials", "b_words", "b_initials", *last)
    return src.mapInPandas(compare, "a bigint, b bigint, cosine double, agreement double, strength double, a_weight bigint, b_weight bigint")


def _lone_candidates(nodes: DataFrame, listed: DataFrame) -> DataFrame:
    """``a, b``: words standing alone with the listed names whose last words share a mark."""

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = Vectors({}, 1.0)
        for b in batches:
            out = [(n, m) for n, w in zip(b["no"].tolist(), b["word"], strict=True) for m in vectors.marks(w)]
            yield pd.DataFrame(out, columns=["no", "mark"])

    marked = lambda df, word, side: df.select("no", word.alias("word")).mapInPandas(marks, "no bigint, mark string").withColumnRenamed("no", side)
    lone = nodes.where("size(words) = 1 and size(initials) = 0")
    return marked(lone, F.get("words", F.lit(0)), "a").join(marked(listed.where("last <> ''"), F.col("last"), "b"), "mark").select("a", "b").distinct()


# average linkage


def _linkage(rows: list[tuple[int, int, float, int, int]], min_link: float, apart: frozenset = frozenset()) -> list[tuple[int, int]]:
    """(node, cluster) by average linkage of one component's edges (a, b, strength and
    weights); clusters that both hold a node of ``apart`` stay apart."""
    near: dict[int, dict[int, float]] = defaultdict(dict)
    weight: dict[int, int] = {}
    for a, b, s, na, nb in rows:
        weight[a], weight[b] = na, nb
        near[a][b] = near[b][a] = max(s * na * nb, near[a].get(b, 0.0))
    members = {n: [n] for n in near}
    heap = [(-s / (weight[a] * weight[b]), a, b, weight[a], weight[b]) for a in near for b, s in near[a].items() if a < b]
    heapq.heapify(heap)
    while heap:
        s, a, b, na, nb = heapq.heappop(heap)
        if -s < min_link:
            break
        if a not in members or b not in members or weight[a] != na or weight[b] != nb:
            continue
        if apart and not apart.isdisjoint(members[a]) and not apart.isdisjoint(members[b]):
            continue
        members[a] += members.pop(b)
        weight[a] += nb
        sums = near[a]
        for c, total in near.pop(b).items():
            if c != a:
                sums[c] = sums.get(c, 0.0) + total
                near[c].pop(b, None)
        sums.pop(b, None)
        for c, total in sums.items():
            near[c][a] = total
            x, y = min(a, c), max(a, c)
            heapq.heappush(heap, (-total / (weight[a] * weight[c]), x, y, weight[x], weight[y]))
    return [(n, min(ns)) for ns in members.values() for n in ns]


def linkage_by_rounds(edges: DataFrame, min_link: float = MIN_LINK) -> DataFrame:
    """``node, cluster`` by average linkage, for components of any size: in each round,
    clusters that are each other's nearest merge.

    Average linkage merges reciprocal nearest neighbours in any order to the same tree,
    so this equals the one-by-one order up to ties; ties go to the smaller numbers."""
    edges = edges.where("a <> b")
    links = cut(
        edges.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        .agg(F.max(F.col("strength") * F.col("a_weight") * F.col("b_weight")).alias("total")).toDF("a", "b", "total")
    )
    ends = edges.select("a", F.col("a_weight").alias("weight")).unionByName(edges.select(F.col("b").alias("a"), F.col("b_weight").alias("weight"))).distinct()
    placed = cut(ends.select(F.col("a").alias("node"), F.col("a").alias("cluster"), "weight"))
    while True:
        size = placed.groupBy("cluster").agg(F.sum("weight").alias("n"))
        named = lambda c: size.select(F.col("cluster").alias(c), F.col("n").alias(f"n_{c}"))
        near = links.join(named("a"), "a").join(named("b"), "b").select("a", "b", (F.col("total") / (F.col("n_a") * F.col("n_b"))).alias("s")).where(F.col("s") >= min_link)
        rank = F.struct("s", (-F.least("a", "b")).alias("x"), (-F.greatest("a", "b")).alias("y"))
        best = (
            near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
            .groupBy("a").agg(F.max_by("b", rank).alias("b"))
        )
        merges = cut(best.join(best.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"]).where("a < b"))
        if merges.isEmpty():
            return placed.join(placed.groupBy("cluster").agg(F.min("node").alias("least")), "cluster").select("node", F.col("least").alias("cluster"))
        to = merges.select(F.col("b").alias("cluster"), F.col("a").alias("into"))
        placed = cut(placed.join(to, "cluster", "left").select("node", F.coalesce("into", "cluster").alias("cluster"), "weight"))
        moved = lambda c: to.select(F.col("cluster").alias(c), F.col("into").alias(f"to_{c}"))
        a, b = F.coalesce("to_a", "a"), F.coalesce("to_b", "b")
        links = cut(
            links.join(moved("a"), "a", "left").join(moved("b"), "b", "left").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "total")
            .where("a <> b").groupBy("a", "b").agg(F.sum("total").alias("total"))
        )


def average_linkage(edges: DataFrame, min_link: float = MIN_LINK, apart: DataFrame | None = None, most: int = MAX_LOCAL_LINKS) -> DataFrame:
    """``node, cluster``: each connected component of the edges ``a, b, strength,
    a_weight, b_weight`` grouped by average linkage; pairs without an edge count 0, and a
    node counts as often as its weight says (equal spellings are one node).

    Components of up to ``most`` edges stream through one Python worker per task, larger
    ones go through ``linkage_by_rounds``.  Nodes of ``apart`` (a bounded list, see
    ``_bounded``) never share a cluster."""
    comps = components(edges)
    placed = edges.join(comps.withColumnRenamed("node", "a"), "a").select("component", "a", "b", "strength", "a_weight", "b_weight")
    placed = cut(placed)
    large = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("component")
    large = cut(large)
    lone = edges.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in _bounded(apart)) if apart is not None else frozenset())

    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, out = None, [], []
        for batch in batches:
            for c, *row in zip(*(batch[k].tolist() for k in ("component", "a", "b", "strength", "a_weight", "b_weight")), strict=True):
                if c != now:
                    out += _linkage(rows, min_link, lone.value)
                    now, rows = c, []
                rows.append(tuple(row))
            yield pd.DataFrame(out, columns=["node", "cluster"])
            out = []
        yield pd.DataFrame(_linkage(rows, min_link, lone.value), columns=["node", "cluster"])

    small = placed if large.isEmpty() else placed.join(large, "component", "left_anti")
    out = small.repartition("component").sortWithinPartitions("component").mapInPandas(group, "node bigint, cluster bigint")
    if large.isEmpty():
        return out
    if apart is not None:
        raise ValueError("a component around nodes that stay apart is too large")
    return out.unionByName(linkage_by_rounds(placed.join(large, "component", "left_semi"), min_link))


# patients


def patient_mentions(records: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``tenant, id, patient, words, initials, key, sex, born`` of each record with a
    usable patient name, repeated rows once.

    ``born`` is the fractional year of creation less the age, null where either is
    missing.  Null, blank and placeholder names are left out."""
    age = F.regexp_extract("age_sex", r"(\d{1,3})", 1).try_cast("double")
    sex_word = F.lower(F.regexp_extract("age_sex", r"(?i)(female|male|(?<![a-z])[mf](?![a-z]))", 1))
    title = F.lower(F.regexp_extract("patient", r"^\s*(\p{L}+)", 1))
    sex = F.coalesce(
        F.nullif(F.substring(sex_word, 1, 1), F.lit("")),
        F.when(title.isin("mr", "shri", "master", "mister", "sri"), "m").when(title.isin("mrs", "ms", "miss", "smt", "missus", "kumari"), "f"),
    )
    year = F.regexp_extract("created", r"^(\d{4})-", 1).try_cast("double") + (
        F.regexp_extract("created", r"^\d{4}-(\d\d)", 1).try_cast("double") - 1
    ) / 12
    rows = (
        records.where("id is not null and patient is not null")
        .select("tenant", "id", "patient", sex.alias("sex"), F.round(year - age, 1).alias("born"))
        .distinct()
    )
    return with_bags(rows, "patient", short_forms(aliases))


def people_nodes(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, mention -> node): equal bags of one tenant, split where birth dates do
    not fit: a node's births lie within ``AGE_SLACK`` of its first.  Lists of births hold
    distinct tenths of a year, which no number of records makes longer."""
    bag = (F.first("words").alias("words"), F.first("initials").alias("initials"))
    seen = cut(mentions.groupBy("tenant", "key", "born").agg(F.min("sex").alias("sex"), F.count(F.lit(1)).alias("weight"), *bag))
    named = seen.where("born is not null").groupBy("tenant", "key").agg(F.sort_array(F.collect_list("born")).alias("births"))
    last = lambda starts: F.get(starts, F.size(starts) - 1)
    starts = F.aggregate(
        "births", F.array().cast("array<double>"),
        lambda acc, b: F.when((F.size(acc) == 0) | (F.round(b - last(acc), 1) > AGE_SLACK), F.concat(acc, F.array(b))).otherwise(acc),
    )
    runs = named.select("tenant", "key", starts.alias("starts"))
    same = (F.col("tenant").eqNullSafe(F.col("r_tenant"))) & (F.col("key") == F.col("r_key"))
    known = seen.join(runs.toDF("r_tenant", "r_key", "starts"), same, "left")
    # without birth: to the only run of the name, or a run of its own
    run = (
        F.when(F.col("born").isNotNull(), F.size(F.filter("starts", lambda s: s <= F.col("born"))) - 1)
        .when(F.size("starts") == 1, 0).otherwise(-1)
    )
    placed = cut(known.withColumn("node", F.xxhash64("tenant", "key", run)).select("tenant", "key", "born", "sex", "words", "initials", "weight", "node"))
    nodes = placed.groupBy("node").agg(
        F.first("tenant").alias("space"), *bag, F.min("born").alias("lo"), F.max("born").alias("hi"),
        F.coalesce(F.min(F.when(F.col("born").isNotNull(), F.col("sex"))), F.min("sex")).alias("sex"), F.sum("weight").alias("weight"),
    )
    return nodes, placed.select("tenant", "key", "born", "node")


def patients(records: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``tenant, id, patient, person``: person is one number for all spellings of a patient."""
    mentions = cut(patient_mentions(records, aliases))
    nodes, where_to = people_nodes(mentions)
    clusters = average_linkage(cut(linked(nodes).drop("cosine", "agreement")))
    where_to = where_to.toDF("t", "k", "y", "node")
    placed = mentions.join(
        where_to, F.col("tenant").eqNullSafe(F.col("t")) & (F.col("key") == F.col("k")) & F.col("born").eqNullSafe(F.col("y"))
    ).select("tenant", "id", "patient", "node")
    return placed.join(clusters, "node", "left").select("tenant", "id", "patient", F.coalesce("cluster", "node").alias("person"))


def patient_pairs(records: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``key_a, key_b``: two records of one person, one tenant, differently typed."""
    people = cut(patients(records, aliases))
    several = people.groupBy("tenant", "person").agg(F.min("patient").alias("x"), F.max("patient").alias("y")).where("x <> y").select("tenant", "person")
    members = people.join(several, ["tenant", "person"], "left_semi")
    a = members.select("tenant", "person", F.col("id").alias("key_a"), F.col("patient").alias("pa"))
    b = members.select("tenant", "person", F.col("id").alias("key_b"), F.col("patient").alias("pb"))
    return a.join(b, ["tenant", "person"]).where("key_a < key_b and pa <> pb").select("key_a", "key_b").distinct()


# referring doctors


def referrer_spellings(records: DataFrame, directory: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``referrer, referrer_id``: spellings with the doctor of the directory they mean.

    Distinct spellings are joined with the directory and grouped like patients.  Spellings
    are not held against each other, which would be quadratic in the misspellings of one
    doctor: a directory name weighs as much as all records, so a cluster forms around
    it, and two of them never share one.  A spelling that agrees with several doctors
    equally well (surname alone, say) is linked to none."""
    places = frozenset(
        r.w
        for r in _bounded(
            directory.select(F.explode(F.split(F.lower(F.concat_ws(" ", "city", "qualification")), r"[^\p{L}]+")).alias("w"))
            .where("w <> ''").distinct()
        )
    )
    short = short_forms(aliases)
    one = lambda df, c: with_bags(df.select(F.regexp_replace(c, r"\(.*$", "").alias("name"), *df.columns), "name", short, places)
    listed = directory.where("referrer_id is not null and full_name is not null").select("referrer_id", "full_name").distinct()
    doctors = cut(one(listed, "full_name").withColumn("node", F.xxhash64(F.lit("doctor"), "referrer_id")))
    mentions = records.where(r"id is not null and referrer rlike '\\p{L}'").groupBy("referrer").agg(F.count(F.lit(1)).alias("weight"))
    typed = cut(one(mentions, "referrer").withColumn("node", F.xxhash64(F.lit("typed"), "key")))
    bags = typed.groupBy("node").agg(F.first("words").alias("words"), F.first("initials").alias("initials"), F.sum("weight").alias("weight"))
    nobody = lambda t: F.lit(None).cast(t)
    ends = F.regexp_extract(F.lower("full_name"), r"(\p{L}+)\s*$", 1)
    shape = lambda df, last: df.select(
        "node", F.lit("").alias("space"), "words", "initials", nobody("double").alias("lo"), nobody("double").alias("hi"), nobody("string").alias("sex"), last.alias("last"), "weight"
    )
    spellings = shape(bags, F.lit(None).cast("string"))
    total = spellings.agg(F.coalesce(F.sum("weight"), F.lit(0)) + 1).scalar()
    edges = cut(linked(spellings, shape(doctors.withColumn("weight", total), ends)))
    ids = doctors.select(F.col("node").alias("doctor"), "referrer_id")
    touching = edges.select(F.col("a").alias("node"), F.col("b").alias("doctor"), "agreement")
    best = Window.partitionBy("node")
    vague = (
        touching.withColumn("top", F.max("agreement").over(best)).where(F.col("agreement") >= F.col("top") - 0.001)
        .groupBy("node").agg(F.count_distinct("doctor").alias("n")).where("n > 1").select("node")
    )
    clear = edges.join(vague.withColumnRenamed("node", "a"), "a", "left_anti")
    clusters = cut(average_linkage(cut(clear.drop("cosine", "agreement")), apart=ids.select("doctor")))
    owner = clusters.join(ids.withColumnRenamed("doctor", "node"), "node").select("cluster", "referrer_id")
    return typed.select("referrer", "node").join(clusters, "node").join(owner, "cluster").select("referrer", "referrer_id").distinct()


def referrer_links(records: DataFrame, directory: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``key_a, key_b``: record id and referrer_id, where the record names that doctor
    in another way than the directory."""
    meant = referrer_spellings(records, directory, aliases)
    names = directory.select("referrer_id", "full_name").distinct()
    other = meant.join(names, "referrer_id").where("referrer <> full_name").select("referrer", F.col("referrer_id").alias("key_b"))
    rows = records.where("id is not null and referrer is not null").select(F.col("id").alias("key_a"), "referrer").distinct()
    return rows.join(other, "referrer").select("key_a", "key_b").distinct()


def linked_names(records: DataFrame, directory: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``entity, key_a, key_b`` over patients and referring doctors."""
    records = records.select("tenant", "id", "patient", "age_sex", "created", "referrer")
    people = patient_pairs(records, aliases).select(F.lit("patient").alias("entity"), "key_a", "key_b")
    doctors = referrer_links(records, directory, aliases).select(F.lit("referrer").alias("entity"), "key_a", "key_b")
    return people.unionByName(doctors)
