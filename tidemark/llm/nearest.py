"""Approximate nearest neighbours by largest inner product, over a hierarchical k-means tree.

The tree is fitted on a bounded sample and every row is put into one of its leaves. A query visits leaves best bin first: a
priority queue holds the branches it has passed, nearest centre on top. How many leaves it visits is calibrated: queries of a
sample are answered by brute force, and visits are doubled until enough of the true neighbours lie in visited leaves. Leaves
meet their queries in tiles of bounded size.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

BRANCHES, LEAF_ROWS = 16, 24


class Tree:
    """Centres by node; a child is a node's number, or -1 - leaf."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 6):
        # with this component all rows have one length, so the largest inner product is the least distance
        self.longest = longest
        self.nodes: list[tuple[np.ndarray, np.ndarray]] = []
        self.leaves = 0
        self.rng = np.random.default_rng(seed)
        if len(sample):
            self.grow(self.lifted(sample))
        del self.rng

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        return np.hstack([rows, np.sqrt(np.maximum(self.longest - (rows**2).sum(1), 0))[:, None]])

    def grow(self, rows: np.ndarray) -> int:
        number = len(self.nodes)
        self.nodes.append((np.zeros(0), np.zeros(0)))
        centres = rows[self.rng.permutation(len(rows))[: min(BRANCHES, max(1, len(rows) // LEAF_ROWS))]]
        for _ in range(12):
            near = nearest_centre(rows, centres)
            centres = np.stack([rows[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        near = nearest_centre(rows, centres)
        used = np.unique(near)
        children = []
        for c in used:
            part = rows[near == c]
            if len(used) > 1 and len(part) > 2 * LEAF_ROWS:
                children.append(self.grow(part))
            else:
                children.append(-1 - self.leaves)
                self.leaves += 1
        self.nodes[number] = (centres[used], np.array(children))
        return number

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        rows, out = self.lifted(rows), np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            centres, children = self.nodes[node]
            near = nearest_centre(rows[at], centres)
            for c, child in enumerate(children.tolist()):
                part = at[near == c]
                if child < 0:
                    out[part] = -1 - child
                elif len(part):
                    todo.append((child, part))
        return out

    def visit(self, query: np.ndarray, visits: int, rows: list[int], least: int) -> list[int]:
        """Leaves in best-bin-first order: `visits` of them, or more until they hold `least` rows."""
        query = np.append(query, 0.0)
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or held < least):
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                held += rows[-1 - node]
                continue
            centres, children = self.nodes[node]
            for far, child in zip(((centres - query) ** 2).sum(1).tolist(), children.tolist(), strict=True):
                heapq.heappush(queue, (far, child))
        return out


def nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy().astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of each query's k best rows among these, its own left out; ties to smaller ids.

    A matrix product proposes rows, with room for its rounding; their scores are then summed in one fixed order.
    """
    out = []
    for i in range(0, len(queries), 256):
        near = queries[i : i + 256] @ rows.T
        near[query_ids[i : i + 256, None] == ids[None]] = -np.inf
        if len(ids) > k:
            edge = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k]
            edge = edge - 1e-9 * (1 + np.abs(edge))
            q, r = np.nonzero((near >= edge[:, None]) & np.isfinite(near))
        else:
            q, r = np.nonzero(np.isfinite(near))
        score = (queries[i : i + 256][q] * rows[r]).sum(1)
        order = np.lexsort((ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        out.append((q[rank < k] + i, r[rank < k], score[rank < k]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v of the rows that take part: finite, not zero, of the commonest length."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    # a row for each length
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("v") == (sizes["size"] if sizes else 0))


def fit(rows: DataFrame, most: int, cells: int) -> Tree:
    """A tree over about `most` rows chosen by a hash of the id, fewer if they would have more than `cells` numbers."""
    total, width, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not total:
        return Tree(np.zeros((0, 0)), 0.0)
    share = min(1.0, min(most, cells // width) / total)
    draw = F.pmod(F.xxhash64("vec_id", F.lit("tree")), F.lit(1 << 20)) / float(1 << 20)
    table = rows.where(draw < share).toArrow().combine_chunks()
    if not table.num_rows:
        table = rows.limit(1).toArrow().combine_chunks()
    sample = matrix(table["v"].combine_chunks())
    return Tree(sample[np.argsort(table["vec_id"].to_numpy(), kind="stable")], longest)


def calibrated(placed: DataFrame, queries: DataFrame, tree, k: int, recall: float, most: int) -> int:
    """Leaf visits at which the queries of a sample find `recall` of their true neighbours."""
    count = queries.count()
    draw = F.pmod(F.xxhash64("vec_id", F.lit("calibrate")), F.lit(1 << 20)) / float(1 << 20)
    some = queries.where(draw < min(1.0, most / max(count, 1))).toArrow().combine_chunks()
    if not some.num_rows:
        return 4
    asked, asked_ids = matrix(some["v"].combine_chunks()), some["vec_id"].to_numpy()

    def truth(batches):
        for batch in batches:
            rows, ids, leaf = matrix(batch.column(1)), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            if len(rows):
                q, r, score = best(asked, asked_ids, rows, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[r]), pa.array(leaf[r]), pa.array(score)], names=["q", "id", "leaf", "score"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    near = placed.select("vec_id", "v", "leaf").mapInArrow(truth, "q long, id long, leaf long, score double")
    # k leaves for each query of the sample
    found = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "leaf").toArrow()
    rank = np.full((len(asked), tree.value.leaves), tree.value.leaves)
    for i, query in enumerate(asked):
        for at, leaf in enumerate(tree.value.visit(query, tree.value.leaves, [0] * tree.value.leaves, 0)):
            rank[i, leaf] = at
    place = rank[found["q"].to_numpy(), found["leaf"].to_numpy()]
    visits = 4
    while visits < tree.value.leaves and (place < visits).mean() < recall:
        visits = min(2 * visits, tree.value.leaves)
    return visits


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.97, sample: int = 20_000, cells: int = 4_000_000, calibrate: int = 200, tile: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found, nearest first, ties to smaller ids.

    vectors: vec_id, embedding; `is_query` picks the queries. A query's candidates are all rows but those of its own id; it gets
    all of them if there are not more than k. Rows with a null id or vector, a null or non-finite component, only zeros, or
    another length than most take no part. Repeated rows count once. An empty table gives none.

    Bounds: the tree's sample has about `sample` rows and `cells` numbers, calibration about `calibrate` queries, a tile
    `tile` rows and queries. Equal vectors are moved only as far as k results can name them.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(usable(vectors.select("vec_id", "embedding")).distinct())
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    tree = spark.sparkContext.broadcast(fit(rows, sample, cells))
    if not tree.value.leaves:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # of equal vectors the k + 1 smallest ids are enough for any query
    twins = Window.partitionBy("v").orderBy("vec_id")
    needed = rows.withColumn("twin", F.row_number().over(twins)).where(F.col("twin") <= k + 1).select("vec_id", "v")

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = tree.value.leaf_of(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf)], names=["vec_id", "v", "leaf"])

    placed = cut_lineage(needed.mapInArrow(place, "vec_id long, v array<double>, leaf long"))
    held = [0] * tree.value.leaves
    for row in placed.groupBy("leaf").count().collect():
        held[row["leaf"]] = row["count"]
    visits = calibrated(placed, queries, tree, k, recall, calibrate)

    def route(batches):
        for batch in batches:
            lists = [tree.value.visit(q, visits, held, k + 1) for q in matrix(batch.column(1))]
            if lists:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int64()))], names=["vec_id", "v", "leaves"])

    routed = queries.mapInArrow(route, "vec_id long, v array<double>, leaves array<long>").withColumn("leaf", F.explode("leaves")).drop("leaves")
    routed = cut_lineage(routed)
    asked = routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / tile).alias("parts"))
    blocks = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / tile).alias("blocks"))
    sizes = F.broadcast(asked.join(blocks, "leaf"))  # a row for each leaf, as many as the sample allows
    part, block = F.pmod(F.xxhash64("vec_id", F.lit("part")), "parts"), F.pmod(F.xxhash64("vec_id", F.lit("block")), "blocks")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = routed.join(sizes, "leaf").select("leaf", part.alias("part"), each("blocks").alias("block"), F.lit(0).alias("kind"), "vec_id", "v")
    two = placed.join(sizes, "leaf").select("leaf", each("parts").alias("part"), block.alias("block"), F.lit(1).alias("kind"), "vec_id", "v")
    tiles = one.union(two).repartition("leaf", "part", "block").sortWithinPartitions("leaf", "part", "block", "kind")

    def solve(held):
        table = pa.Table.from_batches(held).combine_chunks()
        v, ids, kind = matrix(table["v"].combine_chunks()), table["vec_id"].to_numpy(), table["kind"].to_numpy()
        n = int((kind == 0).sum())
        if not n or n == len(kind):
            return None
        q, r, score = best(v[:n], ids[:n], v[n:], ids[n:], k)
        return pa.RecordBatch.from_arrays([pa.array(ids[:n][q]), pa.array(ids[n:][r]), pa.array(score)], names=["query_id", "vec_id", "score"])

    def search(batches):
        kept, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if b == a:
                    continue
                now = tuple(keys[a].tolist())
                if now != key and kept:
                    made = solve(kept)
                    if made is not None:
                        yield made
                    kept = []
                key = now
                kept.append(batch.slice(a, b - a))
        if kept:
            made = solve(kept)
            if made is not None:
                yield made

    found = tiles.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
