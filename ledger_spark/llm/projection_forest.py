"""Approximate nearest neighbours by a forest of random-projection trees.

Inner products become distances by one more component per vector, which gives all vectors the largest norm.  Trees are built
on a bounded sample (`SAMPLE` distinct vectors): a node splits at the median of the projections on the difference of two of its
vectors.  Every distinct vector is then routed to one leaf per tree, in parallel.  A query puts the roots of all trees into
one priority queue, ordered by how far the query lies from the planes passed on the way, and opens leaves until they hold enough vectors.
The members of opened leaves are compared with the query by their exact inner products in double precision.

Equal vectors are one member of the index, with the k + 1 smallest ids of its rows: ties go to the smaller id, so
no other row of it can be among the nearest k.  Equal queries are one query.  Leaves and the queries that open them meet in
blocks of about `CHUNK` rows; a task keeps the best of what it has compared so far and sends on k + 1 members per query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ledger_spark.llm.shipping import ship
from ledger_spark.session import written

SAMPLE = 16_384
LEAF = 128
TREES = 8
#: Share of all members that a query opens, over all trees.
OPEN = 1.0
CHUNK = 256


class Tree:
    """Planes of one tree as arrays; a child below zero is the leaf -1 - child."""

    def __init__(self, points: np.ndarray, rng: np.random.Generator) -> None:
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.root = self._grow(points, np.arange(len(points)), rng)
        self.normals = np.array(self.normals, np.float32).reshape(len(self.offsets), points.shape[1])

    def _grow(self, points: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> int:
        if len(rows) > LEAF:
            for _ in range(8):
                a, b = points[rng.choice(rows, 2, replace=False)]
                normal = a - b
                size = np.linalg.norm(normal)
                if size == 0:
                    continue
                normal = normal / size
                heights = points[rows] @ normal
                offset = float(np.median(heights))
                left = heights < offset
                if 0 < left.sum() < len(rows):
                    at = len(self.offsets)
                    self.normals.append(normal)
                    self.offsets.append(offset)
                    self.children.append([0, 0])
                    self.children[at] = [self._grow(points, rows[left], rng), self._grow(points, rows[~left], rng)]
                    return at
        self.leaves += 1
        return -self.leaves

    def route(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        at = np.full(len(points), self.root)
        moving = np.flatnonzero(at >= 0)
        children, offsets = np.array(self.children).reshape(-1, 2), np.array(self.offsets)
        while len(moving):
            node = at[moving]
            height = np.einsum("ij,ij->i", points[moving], self.normals[node])
            at[moving] = children[node, (height >= offsets[node]).astype(int)]
            moving = moving[at[moving] >= 0]
        return -1 - at


def leaves_for(trees: list[Tree], sizes: dict[tuple[int, int], int], point: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """The (tree, leaf) pairs that a query opens: nearest first by one queue over all trees, until they hold `enough` members."""
    heights = [t.normals @ point for t in trees]
    queue = [(0.0, i, t.root) for i, t in enumerate(trees)]
    heapq.heapify(queue)
    out, held = [], 0
    while queue and held < enough:
        far, i, node = heapq.heappop(queue)
        if node < 0:
            out.append((i, -1 - node))
            held += sizes.get((i, -1 - node), 0)
            continue
        gap = heights[i][node] - trees[i].offsets[node]
        near, other = trees[i].children[node][::-1] if gap >= 0 else trees[i].children[node]
        heapq.heappush(queue, (far, i, near))
        heapq.heappush(queue, (max(far, abs(gap)), i, other))
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors that are not null, empty or zero, without null or non-finite components, of the commonest length."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    lengths = good.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    return good.where(F.size("v") == (lengths[0].length if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long vectors as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _best(rows: list[tuple[np.ndarray, ...]], k: int) -> list[tuple[np.ndarray, ...]]:
    """Of (query, member, score) the k best distinct members of each query."""
    query, member, score = map(np.concatenate, zip(*rows))
    order = np.lexsort((member, -score, query))
    query, member, score = query[order], member[order], score[order]
    fresh = np.append(True, (query[1:] != query[:-1]) | (member[1:] != member[:-1]))
    query, member, score = query[fresh], member[fresh], score[fresh]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return [(query[rank < k], member[rank < k], score[rank < k])]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float = OPEN, trees: int = TREES, seed: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` (vec_id, v) its k nearest of `vectors` by inner product.

    A query's own id is no candidate; repeated rows of a vec_id count once (its smallest vector); an empty index or no queries give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    keyed = written(vectors.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("h", F.xxhash64("v", F.hash("v"))), "keyed")
    salted = keyed.select("vec_id", "h", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).withColumn(
        "r", F.row_number().over(W.partitionBy("h", "salt").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    copies = salted.groupBy("h").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    copies = written(copies.select("h", "ids", F.col("ids")[0].alias("member")), "copies")
    members = written(keyed.drop("h").join(copies.select(F.col("member").alias("vec_id"), "h"), "vec_id").select(
        F.col("vec_id").alias("member"), "h", "v"), "members")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    count, longest = members.agg(F.count("*"), F.max(norm)).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chance = F.pmod(F.hash("h"), F.lit(1 << 30)) / float(1 << 30)
    sample = [r.v for r in members.where(chance < 1.0 * SAMPLE / count).select("h", "v").orderBy("h").limit(2 * SAMPLE).collect()]
    sample = np.array(sample or [members.orderBy("member").first().v])

    def lifted(points: np.ndarray) -> np.ndarray:
        return np.column_stack([points, np.sqrt(np.maximum(0.0, longest ** 2 - (points ** 2).sum(1)))])

    rng = np.random.default_rng(seed)
    shared = spark.sparkContext.broadcast([Tree(lifted(sample), rng) for _ in range(trees)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = lifted(_matrix(batch.column("v"))) if len(batch) else None
            for i, tree in enumerate(shared.value if len(batch) else ()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(batch), i, np.int32)), pa.array(tree.route(points).astype(np.int64)), batch.column("member"), batch.column("v")],
                    names=["tree", "leaf", "member", "v"])

    placed = written(members.select("member", "v").mapInArrow(place, "tree int, leaf long, member long, v array<double>"), "leaves")
    sizes = {(r.tree, r.leaf): r["count"] for r in placed.groupBy("tree", "leaf").count().collect()}  # bounded by the forest
    enough = max(share * count, 4.0 * k * trees)
    lookup = spark.sparkContext.broadcast(sizes)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = lifted(_matrix(batch.column("v"))) if len(batch) else ()
            opened = [leaves_for(shared.value, lookup.value, p, enough) for p in points]
            at = np.repeat(np.arange(len(batch)), [len(x) for x in opened])
            tree, leaf = (pa.array([x[j] for o in opened for x in o], t) for j, t in ((0, pa.int32()), (1, pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("h").take(pa.array(at)), batch.column("v").take(pa.array(at)), tree, leaf],
                                             names=["h", "v", "tree", "leaf"])

    asked = keyed.join(queries.select("vec_id").distinct(), "vec_id").select(F.col("vec_id").alias("query_id"), "h")
    points = members.join(asked.select("h").distinct(), "h", "left_semi").select("h", "v")
    opened = points.repartition(F.col("h")).mapInArrow(find, "h long, v array<double>, tree int, leaf long")

    def blocks(rows: DataFrame, key: str, name: str, total: int) -> DataFrame:
        part = F.pmod(F.xxhash64(key), F.lit(max(1, total // CHUNK))).cast("int")
        return rows.groupBy("tree", "leaf", part.alias(f"{name}_part")).agg(
            F.collect_list(F.struct(F.col(key).alias("id"), F.col("v"))).alias(name)).drop(f"{name}_part")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            sides = [batch.column(c) for c in ("held", "asked")]
            for i in range(len(batch)):
                (ids, points), (query, asked) = ((side.slice(i, 1).flatten().field(0).to_numpy(), _matrix(side.slice(i, 1).flatten().field(1)))
                                                 for side in sides)
                scores = asked @ points.T
                most = min(k + 1, len(ids))
                top = np.argpartition(-scores, most - 1, axis=1)[:, :most]
                # All members tied with the last one stay, for ties go by id.
                row, col = np.nonzero(scores >= np.take_along_axis(scores, top, 1).min(1, keepdims=True))
                kept.append((query[row], ids[col], scores[row, col]))
                size += len(row)
                if size > 1_000_000:
                    kept = _best(kept, k + 1)
                    size = len(kept[0][0])
                    if size > 500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept[0]], names=["h", "member", "score"])
                        kept, size = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(kept, k + 1)[0]], names=["h", "member", "score"])

    met = blocks(placed, "member", "held", max(sizes.values())).join(
        blocks(opened, "h", "asked", max(1, count // 20)), ["tree", "leaf"])
    found = met.select("held", "asked").mapInArrow(compare, "h long, member long, score double")
    found = found.groupBy("h", "member").agg(F.max("score").alias("score"))
    by = W.partitionBy("h").orderBy(F.desc("score"), "member")
    top = found.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    each = top.join(copies.drop("h"), "member").select("h", "score", F.explode("ids").alias("vec_id"))
    lists = each.withColumn("r", F.row_number().over(W.partitionBy("h").orderBy(F.desc("score"), "vec_id"))).where(
        F.col("r") <= k + 1).groupBy("h").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return asked.join(lists, "h").select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id"), F.col("x.score"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
