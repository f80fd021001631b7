"""Most similar vectors by NN-descent: a neighbour graph refined by local joins.

Vectors are brought to unit length, and equal ones become one node.  A forest of
random projection buckets gives each node its first neighbours; then, round by
round, every node brings its neighbours and those it is a neighbour of together,
and pairs among them that are closer than what either has replace it.  A round
ships each vector to its 2k or so neighbourhoods, in one byte a component; what is close
in the end is measured again with the whole vectors.  Neighbourhoods and buckets beyond
``BLOCK`` members are cut into blocks, anew in every round, so no task holds more than
one block at a time and members of a hub meet others each round.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportlake.session import cut, release, sweep

#: Neighbours kept for each node while the graph is built.
GRAPH_K = 20
TREES = 6
BUCKET = 256
#: Members of a bucket or neighbourhood compared at once.
BLOCK = 512
ROUNDS = 5
#: Rounds end when fewer than this part of all neighbours is new.
SETTLED = 0.02
#: Rows the projections are centred on, at most, over all spaces.
CENTRE_SAMPLE = 16_000
#: What the similarity of one-byte vectors may be off by.
CODE_ERROR = 0.02
#: Spaces (table, embedder, length) that may occur.
MAX_SPACES = 1_000
SEED = 5

NODE = "space int, node bigint"


def packed(vec: bytes) -> bytes:
    """float32 bytes, compressed where that is shorter; then their number is no multiple of 4."""
    short = zlib.compress(vec, 1)
    short = b"\0" * (-(len(short) - 1) % 4) + short
    return short if len(short) < len(vec) else vec


def vector(data: bytes) -> np.ndarray:
    return np.frombuffer(data if len(data) % 4 == 0 else zlib.decompress(data.lstrip(b"\0")), dtype=np.float32)


def unit_vectors(rows: DataFrame) -> DataFrame:
    """``space_key, id, cls, vec, code, step``: unit vector as ``packed`` bytes, its digest,
    and its components in one byte each, as multiples of ``step``.

    ``rows``: src, id, embedder, vector.  Null, all-zero vectors and such with null or
    infinite parts take no part; a repeated id counts once (its first row by digest)."""

    def norm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for src, i, e, v in zip(b["src"], b["id"], b["embedder"], b["vector"], strict=True):
                x = np.asarray(v, dtype=np.float64)
                size = float(np.sqrt((x * x).sum()))
                if not np.isfinite(size) or size == 0:
                    continue
                u = (x / size).round(7).astype(np.float32) + np.float32(0)
                step = float(np.abs(u).max()) / 127
                code = np.rint(u / step).astype(np.int8).tobytes()
                out.append((f"{src}|{e}|{len(u)}", i, hashlib.blake2b(u.tobytes(), digest_size=16).digest(), packed(u.tobytes()), code, step))
            yield pd.DataFrame(out, columns=["space_key", "id", "cls", "vec", "code", "step"])

    src = rows.where("id is not null and vector is not null and size(vector) > 0").select("src", "id", "embedder", "vector")
    got = src.mapInPandas(norm, "space_key string, id bigint, cls binary, vec binary, code binary, step float")
    return got.groupBy("space_key", "id").agg(F.min(F.struct("cls", "vec", "code", "step")).alias("x")).select("space_key", "id", "x.*")


def _numbered(rows: DataFrame) -> tuple[DataFrame, dict[int, tuple[str, int]]]:
    """Rows with a small ``space`` number, and the key and length of each space."""
    spaces = rows.select("space_key").distinct().limit(MAX_SPACES + 1).collect()
    if len(spaces) > MAX_SPACES:
        raise ValueError(f"more than {MAX_SPACES} kinds of vectors")
    keys = sorted(r.space_key for r in spaces)
    known = {i: (k, int(k.rsplit("|", 1)[1])) for i, k in enumerate(keys)}
    number = F.create_map(*(F.lit(x) for i, k in enumerate(keys) for x in (k, i)))[F.col("space_key")] if keys else F.lit(0)
    return rows.withColumn("space", number.cast("int")).drop("space_key"), known


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame, dict[int, tuple[str, int]]]:
    """(nodes ``space, node, vec, code, step``; members ``space, node, id``; spaces).

    A node is named by the smallest id with its vector."""
    written = cut(unit_vectors(rows))
    units, spaces = _numbered(written)
    nodes = cut(units.groupBy("space", "cls").agg(F.min("id").alias("node"), *(F.first(c).alias(c) for c in ("vec", "code", "step"))))
    members = cut(units.select("space", "cls", "id").join(nodes.select("space", "cls", "node"), ["space", "cls"]).select("space", "node", "id"))
    release(written)
    sweep(rows.sparkSession)
    return nodes.select("space", "node", "vec", "code", "step"), members, spaces


def _planes(nodes: DataFrame, spaces: dict[int, tuple[str, int]], trees: int) -> dict[int, list[tuple]]:
    """For each space and tree: centre, hyperplanes and thresholds."""
    sizes = {r.space: r.n for r in nodes.groupBy("space").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = Window.partitionBy("space").orderBy(F.xxhash64("node", F.lit(SEED)))
    share = max(1, CENTRE_SAMPLE // max(1, len(sizes)))
    drawn: dict[int, list] = {space: [] for space in sizes}
    for r in nodes.withColumn("r", F.row_number().over(order)).where(F.col("r") <= share).select("space", "vec").collect():
        drawn[r.space].append(vector(r.vec))
    out: dict[int, list[tuple]] = {}
    for space, n in sizes.items():
        x = np.stack(drawn[space])
        bits = min(60, max(0, int(np.ceil(np.log2(max(1, n) / BUCKET)))))
        rng = np.random.default_rng(SEED + space)
        forest = []
        for _ in range(trees):
            h = rng.standard_normal((spaces[space][1], bits)).astype(np.float32)
            forest.append((h, np.median(x @ h, axis=0)))
        out[space] = forest
    return out


def _blocks(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal keys, from batches sorted by them."""
    rest: pd.DataFrame | None = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        k = b[keys].to_numpy()
        edge = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        at = 0
        for e in edge:
            yield b.iloc[at:e]
            at = e
        rest = b.iloc[at:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _matrix(vecs: pd.Series) -> np.ndarray:
    return np.stack([vector(v) for v in vecs])


def _decoded(g: pd.DataFrame) -> np.ndarray:
    """Vectors from one byte a component, each times its step."""
    codes = np.frombuffer(b"".join(g["code"]), dtype=np.int8).reshape(len(g), -1)
    return codes.astype(np.float32) * g["step"].to_numpy(np.float32)[:, None]


class _Gains:
    """Candidates of one task, repeated ones and all but the best of a node removed now and then."""

    def __init__(self, keep: int) -> None:
        self.keep, self.parts, self.rows = keep, [], 0

    def add(self, space, src, dst, sim) -> None:
        self.parts.append((np.full(len(src), space, dtype=np.int32), src, dst, sim))
        self.rows += len(src)

    def take(self) -> pd.DataFrame:
        if not self.parts:
            return pd.DataFrame({"space": [], "src": [], "dst": [], "sim": []}).astype({"space": "int32", "src": "int64", "dst": "int64", "sim": "float32"})
        space, src, dst, sim = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.rows = [], 0
        o = np.lexsort((dst, -sim, src, space))
        space, src, dst, sim = space[o], src[o], dst[o], sim[o]
        same = np.zeros(len(o), dtype=bool)
        same[1:] = (space[1:] == space[:-1]) & (src[1:] == src[:-1]) & (dst[1:] == dst[:-1])
        space, src, dst, sim = space[~same], src[~same], dst[~same], sim[~same]
        new = np.ones(len(src), dtype=bool)
        new[1:] = (space[1:] != space[:-1]) | (src[1:] != src[:-1])
        start = np.flatnonzero(new)
        rank = np.arange(len(src)) - np.repeat(start, np.diff(np.append(start, len(src))))
        best = rank < self.keep
        return pd.DataFrame({"space": space[best], "src": src[best], "dst": dst[best], "sim": sim[best]})


EDGES = "space int, src bigint, dst bigint, sim float"


def _bucket_pairs(k: int):
    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gains = _Gains(k)
        for g in _blocks(batches, ["space", "tree", "bucket", "chunk"]):
            if len(g) < 2:
                continue
            ids, m = g["node"].to_numpy(np.int64), _decoded(g)
            s = m @ m.T
            np.fill_diagonal(s, -3)
            n = min(k, len(ids) - 1)
            t = np.argpartition(-s, n - 1, axis=1)[:, :n]
            gains.add(int(g["space"].iat[0]), np.repeat(ids, n), ids[t].ravel(), np.take_along_axis(s, t, 1).ravel().astype(np.float32))
            if gains.rows > 400_000:
                yield gains.take()
        yield gains.take()

    return pairs


def first_graph(nodes: DataFrame, spaces: dict[int, tuple[str, int]], k: int, trees: int) -> DataFrame:
    """The best edges found inside the buckets of a random projection forest, ``_written``."""
    spark = nodes.sparkSession
    planes = spark.sparkContext.broadcast(_planes(nodes, spaces, trees))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for space, g in b.groupby("space"):
                m = _matrix(g["vec"])
                found = [
                    ((m @ h > middle) @ (1 << np.arange(h.shape[1], dtype=np.int64))).astype(np.int64) if h.shape[1] else np.zeros(len(g), np.int64)
                    for h, middle in planes.value[space]
                ]
                yield pd.DataFrame({"space": space, "node": g["node"].to_numpy(), "buckets": list(np.stack(found, axis=1))})

    # a row for each node is written, not one for each tree
    written = cut(nodes.select("space", "node", "vec").mapInPandas(place, f"{NODE}, buckets array<bigint>"))
    codes = written.select("space", "node", F.posexplode("buckets").alias("tree", "bucket"))
    counts = codes.groupBy("space", "tree", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("chunks"))
    placed = codes.join(counts, ["space", "tree", "bucket"]).select(
        "space", "tree", "bucket", "node", F.pmod(F.xxhash64("node", "tree"), F.col("chunks")).alias("chunk")
    )
    keys = ["space", "tree", "bucket", "chunk"]
    ready = placed.join(nodes.drop("vec"), ["space", "node"]).repartition(*keys).sortWithinPartitions(*keys)
    graph = _written(_best(ready.mapInPandas(_bucket_pairs(k), EDGES).withColumn("new", F.lit(True)), k))
    release(written)
    return graph


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k best edges of every source; repeated ones once, ``new`` if found only now."""
    one = edges.repartition("space", "src").groupBy("space", "src", "dst").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    order = Window.partitionBy("space", "src").orderBy(F.desc("sim"), "dst")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def _written(edges: DataFrame) -> DataFrame:
    """Edges written with one row a source, a third of what rows of single edges take; see ``_edges``."""
    one = edges.groupBy("space", "src").agg(F.collect_list(F.struct("dst", "sim", "new")).alias("x"))
    return cut(one.select("space", "src", "x.dst", "x.sim", "x.new"))


def _edges(written: DataFrame) -> DataFrame:
    return written.select("space", "src", F.inline(F.arrays_zip("dst", "sim", "new")))


def _local_join(k: int):
    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gains = _Gains(k)
        for g in _blocks(batches, ["space", "v", "chunk"]):
            new = g["new"].to_numpy(bool)
            if len(g) < 2 or not new.any():
                continue
            ids, m, floor = g["u"].to_numpy(np.int64), _decoded(g), g["kth"].to_numpy(np.float32)
            s = m @ m.T
            np.fill_diagonal(s, -3)
            s[~(new[:, None] | new[None, :])] = -3
            n = min(k, len(ids) - 1)
            t = np.argpartition(-s, n - 1, axis=1)[:, :n]
            got = np.take_along_axis(s, t, 1)
            ok = got > floor[:, None]
            if ok.any():
                gains.add(int(g["space"].iat[0]), np.repeat(ids, n)[ok.ravel()], ids[t][ok], got[ok].astype(np.float32))
            if gains.rows > 400_000:
                yield gains.take()
        yield gains.take()

    return join


def refine(graph: DataFrame, nodes: DataFrame, k: int, turn: int = 0) -> DataFrame:
    """One round: neighbours of neighbours that are closer."""
    around = (
        graph.select("space", F.col("src").alias("v"), F.col("dst").alias("u"), "new")
        .unionByName(graph.select("space", F.col("dst").alias("v"), F.col("src").alias("u"), "new"))
        .groupBy("space", "v", "u").agg(F.max("new").alias("new"))
    )
    degree = around.groupBy("space", "v").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("chunks"), F.max("new").alias("any"))
    kth = graph.groupBy("space", F.col("src").alias("u")).agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("kth"))
    member = nodes.select("space", F.col("node").alias("u"), "code", "step").join(kth, ["space", "u"], "left").withColumn(
        "kth", F.coalesce("kth", F.lit(-2.0)).cast("float")
    )
    placed = around.join(degree.where("any"), ["space", "v"]).select(
        "space", "v", "u", "new", F.pmod(F.xxhash64("u", "v", F.lit(turn)), F.col("chunks")).alias("chunk")
    )
    keys = ["space", "v", "chunk"]
    ready = placed.join(member, ["space", "u"]).repartition(*keys).sortWithinPartitions(*keys)
    found = ready.mapInPandas(_local_join(k), EDGES)
    return _best(graph.withColumn("new", F.lit(False)).unionByName(found.withColumn("new", F.lit(True))), k)


def neighbour_graph(nodes: DataFrame, spaces: dict[int, tuple[str, int]], k: int = GRAPH_K, trees: int = TREES, rounds: int = ROUNDS) -> DataFrame:
    """``space, src, dst, sim, new``: the k nearest nodes of every node, nearly all found."""
    written = first_graph(nodes, spaces, k, trees)
    for turn in range(rounds):
        sweep(nodes.sparkSession)
        last, written = written, _written(refine(_edges(written), nodes, k, turn))
        release(last)
        r = _edges(written).agg(F.avg(F.col("new").cast("int")).alias("x")).first()
        if (r.x or 0.0) < SETTLED:
            break
    sweep(nodes.sparkSession)
    return _edges(written)


def measured(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``space, src, dst, sim`` with the similarity of the whole vectors."""

    def dots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sims = [float(vector(x) @ vector(y)) for x, y in zip(b["sv"], b["dv"], strict=True)]
            yield pd.DataFrame({"space": b["space"], "src": b["src"], "dst": b["dst"], "sim": sims})

    # each pair once, the smaller number first
    once = edges.select("space", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    side = lambda c, vec: nodes.select("space", F.col("node").alias(c), F.col("vec").alias(vec))
    got = once.join(side("src", "sv"), ["space", "src"]).join(side("dst", "dv"), ["space", "dst"]).mapInPandas(dots, "space int, src bigint, dst bigint, sim double")
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), "sim")
    both = got.select("space", F.inline(F.array(way("src", "dst"), way("dst", "src"))))
    return edges.select("space", "src", "dst").join(both, ["space", "src", "dst"])


def vector_rows(chunks: DataFrame, memories: DataFrame) -> DataFrame:
    """``src, id, embedder, vector`` of both tables."""
    part = lambda df, src, key: df.select(F.lit(src).alias("src"), F.col(key).alias("id"), "embedder", "vector")
    return part(chunks, "chunks", "chunk_id").unionByName(part(memories, "memories", "memory_id"))


def mutual_neighbours(rows: DataFrame, k: int = 10, min_sim: float = 0.8) -> DataFrame:
    """``src, id_a, id_b``: ids each among the other's k most similar, cosine at least
    ``min_sim``; equal similarities rank by id.

    Of equal vectors only the k + 1 smallest ids can be in anybody's list, so larger
    classes add no more.  Ranks are counted among pairs above ``min_sim``, which leaves
    them as they are."""
    nodes, members, spaces = classes(rows)
    if not spaces:
        return rows.sparkSession.createDataFrame([], "src string, id_a bigint, id_b bigint")
    graph = neighbour_graph(nodes, spaces)
    smallest = Window.partitionBy("space", "node").orderBy("id")
    few = members.withColumn("rank", F.row_number().over(smallest)).where(F.col("rank") <= k + 1).select("space", "node", "id")
    near = graph.where(F.col("sim") >= min_sim - CODE_ERROR)
    close = measured(near, nodes).where(F.col("sim") >= min_sim - 1e-6).select("space", "src", "dst", F.round("sim", 6).alias("sim"))
    several = few.groupBy("space", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = several.select("space", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("sim"))
    links = close.unionByName(own)
    a = few.select("space", F.col("node").alias("src"), F.col("id").alias("a"))
    b = few.select("space", F.col("node").alias("dst"), F.col("id").alias("b"))
    by_sim = Window.partitionBy("space", "a").orderBy(F.desc("sim"), "b")
    directed = (
        links.join(a, ["space", "src"]).join(b, ["space", "dst"]).where("a <> b")
        .withColumn("rank", F.row_number().over(by_sim)).where(F.col("rank") <= k)
        .select("space", "a", "b")
    )
    forth = directed.where("a < b")
    back = directed.where("a > b").select("space", F.col("b").alias("a"), F.col("a").alias("b"))
    tables = [key.split("|", 1)[0] for key, _ in sorted(spaces.values())]
    return (
        forth.join(back, ["space", "a", "b"])
        .select(F.element_at(F.array(*map(F.lit, tables)), F.col("space") + 1).alias("src"), F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    )


#: Greedy search: candidates kept for a query, of which so many are expanded a hop, and hops.
BEAM = 40
EXPAND = 8
HOPS = 4
#: Entry nodes of a space for queries that are no rows of the collection.
ENTRIES = 32


def greedy_search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """``space, query, node, sim``: the k best nodes found from each query's entry by
    following the graph.

    ``queries``: space, query, vec and entry (a node, or null).  Each hop expands the
    best candidates not yet expanded, over edges in both directions, and keeps the
    ``BEAM`` best; a hop moves (query, candidate) pairs, never the collection."""
    both = cut(
        graph.select("space", "src", "dst").unionByName(graph.select("space", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    )
    firsts = nodes.withColumn("r", F.row_number().over(Window.partitionBy("space").orderBy(F.xxhash64("node", F.lit(SEED))))).where(F.col("r") <= ENTRIES)
    asked = queries.select("space", "query", F.col("vec").alias("qv"))
    start = queries.where("entry is not null").select("space", "query", F.col("entry").alias("node")).unionByName(
        queries.where("entry is null").select("space", "query").join(firsts.select("space", "node"), "space")
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sims = [float(vector(q) @ vector(v)) for q, v in zip(b["qv"], b["vec"], strict=True)]
            yield pd.DataFrame({"space": b["space"], "query": b["query"], "node": b["node"], "sim": sims})

    def scored(pairs: DataFrame) -> DataFrame:
        ready = pairs.join(nodes, ["space", "node"]).join(asked, ["space", "query"]).select("space", "query", "node", "vec", "qv")
        return ready.mapInPandas(score, "space int, query bigint, node bigint, sim double").withColumn("done", F.lit(False))

    best = Window.partitionBy("space", "query").orderBy(F.desc("sim"), "node")
    beam = cut(scored(start))
    for _ in range(HOPS):
        ranked = beam.withColumn("turn", F.when(~F.col("done"), F.row_number().over(Window.partitionBy("space", "query", "done").orderBy(F.desc("sim"), "node"))))
        ranked = cut(ranked.withColumn("now", F.coalesce(F.col("turn") <= EXPAND, F.lit(False))))
        near = ranked.where("now").select("space", "query", F.col("node").alias("src")).join(both, ["space", "src"]).select("space", "query", F.col("dst").alias("node")).distinct()
        fresh = scored(near.join(ranked.select("space", "query", "node"), ["space", "query", "node"], "left_anti"))
        held = ranked.select("space", "query", "node", "sim", (F.col("done") | F.col("now")).alias("done"))
        beam = cut(held.unionByName(fresh).withColumn("r", F.row_number().over(best)).where(F.col("r") <= BEAM).drop("r"))
    return beam.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("space", "query", "node", "sim")


def search_rows(rows: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """``src, query, rank, id, sim``: for every row whose id is divisible by ``every``,
    its k most similar rows of all rows, by greedy search from its own node.

    Rows without a usable vector ask nothing and are found by nobody."""
    nodes, members, spaces = classes(rows)
    if not spaces:
        return rows.sparkSession.createDataFrame([], "src string, query bigint, rank bigint, id bigint, sim double")
    graph = neighbour_graph(nodes, spaces)
    asking = members.where(F.col("id") % every == 0).join(nodes, ["space", "node"]).select("space", F.col("id").alias("query"), "vec", F.col("node").alias("entry"))
    found = greedy_search(cut(asking), graph, nodes, k)
    few = members.withColumn("r", F.row_number().over(Window.partitionBy("space", "node").orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    order = Window.partitionBy("space", "query").orderBy(F.desc("sim"), "id")
    ids = found.join(few, ["space", "node"]).where("id <> query").withColumn("sim", F.round("sim", 6)).withColumn("rank", F.row_number().over(order).cast("bigint"))
    tables = [key.split("|", 1)[0] for key, _ in sorted(spaces.values())]
    return ids.where(F.col("rank") <= k).select(F.element_at(F.array(*map(F.lit, tables)), F.col("space") + 1).alias("src"), "query", "rank", "id", "sim")
